import re

import pytest

from headway.llm.pii import _luhn, base_spans, disclosing_terms, sanitise

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [("email", m.start(), m.end()) for m in EMAIL.finditer(text)]
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
    out += [("card", m.start(), m.end()) for m in CARD.finditer(text) if 13 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [("phone", m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(digits(m[0])) <= 15]
    return out


CASES = [
    "", "a@b", "a@b.c", "x a.b+c@d-e.f.g. y", "a@@b.c", "a@b@c.d@e.f", "a@b.c@d.e", "@a.b", "é@a.b", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1 1.1.1.256 01.002.3.4",
    "0001.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111 4111111111111112", "+1 (743) 555-3824.", "+1", "+49 30 1", "+(1) 2 +1234567890123456", "12.34.56.78+1 222 333 4444", "a" * 5000, "1" * 5000, "1." * 2000, "+1" + "(" * 3000,
]


@pytest.mark.parametrize("text", CASES)
def test_base_spans_follow_the_patterns(text):
    assert base_spans(text) == plain(text)


def test_base_spans_on_random_text():
    import random

    r = random.Random(3)
    for _ in range(3000):
        text = "".join(r.choice("aA1 2.3@-+()45é%\n") for _ in range(r.randrange(60)))
        assert base_spans(text) == plain(text), text


def test_disclosing_terms(spark):
    hot = [f"common words here and there {i}\nfiller line {i}" for i in range(40)]
    rows = [(i, t) for i, t in enumerate(hot)] + [(100 + i, "Zorblatt writes from zor@example.com to the common words") for i in range(4)] + [(200, None), (201, ""), (202, "the common words without any data")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r["term"] for r in disclosing_terms(docs).collect()}
    assert "zorblatt" in terms and "common" not in terms and "words" not in terms
    out = {r["doc_id"]: r for r in sanitise(docs).collect()}
    assert len(out) == len(rows)
    assert out[100]["n_email"] == 1 and "term:0:8" in out[100]["spans"]
    assert "zor@example.com" not in out[100]["clean_text"] and "Zorblatt" not in out[100]["clean_text"]
    assert out[0]["n_terms"] == 0 and out[0]["clean_text"] == hot[0] and out[200]["clean_text"] == "" and out[202]["spans"] == ""


def test_shuffled_disclosure_table_agrees(spark, monkeypatch):
    import headway.llm.pii as pii

    docs = spark.createDataFrame([(i, f"Zorblatt writes from zor@example.com {i}") for i in range(4)] + [(9, "other text")] * 3 + [(7, None)], "doc_id long, text string")
    whole = sorted(map(tuple, sanitise(docs).collect()), key=repr)
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, sanitise(docs).collect()), key=repr) == whole


def test_a_disclosing_term_goes_from_every_line_of_a_document_with_data(spark):
    far = " ".join(["then"] * 20)
    told = [(i, f"Zorblatt said {far} zor@example.com {i}") for i in range(4)]
    rows = [*told, (10, "mail 10.0.0.1\nby ZORBLATT himself"), (12, "other text")]
    rows += [(100 + i, f"then said nobody {i}") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["term"] for r in disclosing_terms(docs).collect()} == {"zorblatt"}
    out = {r["doc_id"]: r for r in sanitise(docs).collect()}
    assert [i for i in sorted(out) if out[i]["n_terms"]] == [0, 1, 2, 3, 10]
    assert out[10]["spans"] == "ip:5:13,term:17:25" and not any("zorblatt" in r["clean_text"].lower() for r in out.values())


def test_terms_within_data_count_on_neither_side(spark):
    rows = [(i, f"zorblatt@example.com {i}") for i in range(12)] + [(20 + i, f"Zorblatt is zorblatt@example.com {i}") for i in range(3)] + [(100 + i, f"is text {i}") for i in range(60)]
    shares = {(r["term"], r["entity"]): r["share"] for r in disclosing_terms(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert shares == {("zorblatt", "email:zorblatt@example.com"): 1.0}


def test_shuffled_disclosure_table_agrees_on_quotes_and_hyphens(spark, monkeypatch):
    import headway.llm.pii as pii

    forms = ["'Zorblatt'", "Zorblatt--who", "Zorblatt-", "-Zorblatt", "Zorblatt''s", "zor_Zorblatt", "O'Zorb-Blatt", "'O'Zorb-Blatt'"]
    rows = [(i, f"{form} writes to zor@example.com {i}") for i, form in enumerate(forms * 3)] + [(100 + i, f"other text {i}") for i in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    whole = sorted(map(tuple, sanitise(docs).collect()))
    assert all("term:" in r[6] and "zorb" not in r[8].lower() for r in whole[:24])
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert sorted(map(tuple, sanitise(docs).collect())) == whole


def test_op1_takes_a_disclosing_term_from_every_document(spark, tmp_path, monkeypatch):
    """Also from those without data, and whatever its length."""
    import headway.llm.pii as pii

    told = [(i, f"Zorblatt and Bo and \u738b told zor@example.com {i}") for i in range(4)]
    rows = [*told, (10, "\u738b met\nBO with Zorblatt"), (11, "told and met"), (12, None), (13, "")]
    rows += [(100 + i, f"and told nobody {i}") for i in range(60)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in pii.op1_pii(spark, str(tmp_path)).collect()}
    assert len(out) == len(rows) and [i for i in sorted(out) if out[i]["n_terms"]] == [0, 1, 2, 3, 10]
    assert out[10]["spans"] == "term:0:1,term:6:8,term:14:22" and out[10]["n_email"] == 0
    monkeypatch.setattr(pii, "BROADCAST_ROWS", 0)
    assert {r["doc_id"]: r for r in pii.op1_pii(spark, str(tmp_path)).collect()} == out


def test_empty_table(spark):
    assert sanitise(spark.createDataFrame([], "doc_id long, text string, spans int")).count() == 0
