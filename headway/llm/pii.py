"""Information-theoretic sanitisation: personal data, and the terms that disclose it."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import materialize

KINDS = ("email", "ip", "card", "phone")
#: A term discloses an entity if their pointwise mutual information reaches this share of the entity's own information.
DISCLOSURE = 0.8
#: They must meet in so many contexts at least, and a context is a line, cut after so many words.
LEAST_SUPPORT = 3
CONTEXT_WORDS = 64
#: Rows of the disclosure table up to which it is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# A match can only start where a run of digits does, which the look-behinds say: long runs then cost one look each.
_IP = re.compile(r"(?<![0-9])([0-9]+)\.([0-9]+)\.([0-9]+)\.([0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W_]+(?:[-'][^\W_]+)*")
_NOT_DIGIT = re.compile(r"[^0-9]")


def _emails(text: str) -> list[tuple[int, int]]:
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            found.append((start, end))
        at = text.find("@", at + 1)
    return found


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _is_octet(digits: str) -> bool:
    digits = digits.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of personal data by kind, then start: leftmost, not overlapping within a kind, linear in the text."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", m.start(), m.end()) for m in _IP.finditer(text) if all(_is_octet(x) for x in m.groups())]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(digits := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        found += [("phone", m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return found


def _entity(kind: str, raw: str) -> str:
    return f"{kind}:{raw.lower() if kind == 'email' else raw if kind == 'ip' else _NOT_DIGIT.sub('', raw)}"


def _outside(terms: Iterable[re.Match], places: list[tuple[int, int]]) -> Iterator[re.Match]:
    """The terms that overlap none of the sorted places; both in order."""
    i = 0
    for t in terms:
        while i < len(places) and places[i][1] <= t.start():
            i += 1
        if i == len(places) or places[i][0] >= t.end():
            yield t


def _contexts(text: str) -> Iterator[list[re.Match]]:
    """The terms of each context that has any: lines, cut after CONTEXT_WORDS words."""
    at = 0
    for line in text.split("\n"):
        terms = list(_TERM.finditer(text, at, at + len(line)))
        for i in range(0, len(terms), CONTEXT_WORDS):
            yield terms[i : i + CONTEXT_WORDS]
        at += len(line) + 1


def _terms_of_contexts(text: str, places: list[tuple[int, int]]) -> Iterator[set[str]]:
    """The lower-cased terms of each context, without what stands in personal data only."""
    if places:
        for terms in _contexts(text):
            yield {t[0].lower() for t in _outside(terms, places)}
        return
    for line in text.split("\n"):
        terms = [t.lower() for t in _TERM.findall(line)]
        for i in range(0, len(terms), CONTEXT_WORDS):
            yield set(terms[i : i + CONTEXT_WORDS])


def _meetings(text: str) -> set[tuple[str, str, int]]:
    """(entity, term, context) where a term stands in a context of an entity; the term is empty once for each context of an entity."""
    spans = sorted((a, b, _entity(k, text[a:b])) for k, a, b in base_spans(text))
    out: set[tuple[str, str, int]] = set()
    if not spans:
        return out
    places = [x[:2] for x in spans]
    first = 0
    for number, terms in enumerate(_contexts(text)):
        lo, hi = terms[0].start(), terms[-1].end()
        while first < len(spans) and spans[first][1] <= lo:
            first += 1
        k, entities = first, set()
        while k < len(spans) and spans[k][0] < hi:
            if spans[k][1] > lo:
                entities.add(spans[k][2])
            k += 1
        if entities:
            names = {"", *(t[0].lower() for t in _outside(terms, places[first:k]))}
            out.update((entity, name, number) for entity in entities for name in names)
    return out


def disclosing_terms(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = LEAST_SUPPORT) -> DataFrame:
    """``term, entity, kind, share``: terms whose presence gives away so much of an entity's information.

    Over all contexts of all documents, ``n_ct`` as ``n_t``: ``PMI(c; t) = log(N n_ct / (n_c n_t))`` and ``IC(c) = log(N / n_c)``; the share
    is their quotient, 1 where the term occurs with the entity only. Terms of any length count: a name may have two letters.
    Meetings and counts are summed in each Arrow batch and again before the shuffle, so that a frequent term or entity
    costs one row a task.
    """

    def meet(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n: dict[tuple[str, str], int] = {}
            for text in batch.column("text").to_pylist():
                if text and ("@" in text or any(d in text for d in "0123456789")):
                    for entity, term, _ in _meetings(text):
                        n[entity, term] = n.get((entity, term), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in n], pa.string()), pa.array([k[1] for k in n], pa.string()), pa.array(list(n.values()), pa.int64())], ["entity", "term", "n"])

    met = materialize(docs.select("text").mapInArrow(meet, "entity string, term string, n long").groupBy("entity", "term").agg(F.sum("n").alias("n")), "pii-meetings")
    of_entity = met.where("term = ''").select("entity", F.col("n").alias("n_c"))
    pairs = met.where(f"term <> '' and n >= {int(support)}").select("entity", "term", F.col("n").alias("n_ct"))
    pairs = materialize(pairs.join(of_entity, "entity"), "pii-pairs")
    candidates = pairs.select("term").distinct()
    rows = pairs.count()
    few = rows <= BROADCAST_ROWS
    wanted = candidates.sparkSession.sparkContext.broadcast(frozenset(r["term"] for r in candidates.toLocalIterator())) if few else None

    def occur(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n: dict[str, int] = {"": 0}
            for text in batch.column("text").to_pylist():
                for present in _terms_of_contexts(text or "", sorted((a, b) for _, a, b in base_spans(text or ""))):
                    n[""] += 1
                    for t in present & wanted.value if wanted else present:
                        n[t] = n.get(t, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["term", "n"])

    if not rows:
        return pairs.select("term", "entity", F.lit("").alias("kind"), F.lit(0.0).alias("share")).limit(0)
    counts = materialize(docs.select("text").mapInArrow(occur, "term string, n long").groupBy("term").agg(F.sum("n").alias("n_t")), "pii-terms-counted")
    n = float(max(1, counts.where("term = ''").agg(F.sum("n_t")).first()[0] or 0))
    known = pairs.join(counts, "term").withColumn("ic", F.log(F.lit(n) / F.col("n_c"))).withColumn("pmi", F.log(F.lit(n) * F.col("n_ct") / (F.col("n_c") * F.col("n_t"))))
    share = F.when(F.col("ic") > 0, F.col("pmi") / F.col("ic")).otherwise(0.0)
    known = known.select("term", "entity", F.substring_index("entity", ":", 1).alias("kind"), share.alias("share"))
    return known.where(F.col("share") >= disclosure)


def sanitise(docs: DataFrame, disclosure: float = DISCLOSURE, support: int = LEAST_SUPPORT, everywhere: bool = False) -> DataFrame:
    """``doc_id``, counts of each kind, ``base_sha256``, ``spans``, and ``clean_text`` for every row of ``docs(doc_id, text)``.

    Spans of personal data come from the patterns. A term that discloses a protected entity beyond the threshold adds
    its own span ``term:start:end`` wherever it stands in a document that holds personal data, in any line of it, unless
    it overlaps another span; with ``everywhere`` in any document, as the term gives the entity away there as well. In
    ``clean_text`` the data are generalised to their kind in brackets; a disclosing term becomes ``[term]`` up to the share
    (1 + disclosure) / 2, and is removed beyond.

    Null text counts as empty and gives no spans; repeated rows count as separate documents.
    """
    table = materialize(disclosing_terms(docs, disclosure, support).groupBy("term").agg(F.max("share").alias("share")), "pii-terms")
    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_terms long, clean_text string"
    few = table.count() <= BROADCAST_ROWS
    shared = docs.sparkSession.sparkContext.broadcast({r["term"]: r["share"] for r in table.toLocalIterator()} if few else None)
    limit = (1 + disclosure) / 2

    def clean(doc_id, text: str, share: dict) -> tuple:
        base = base_spans(text)
        n = {k: 0 for k in KINDS}
        for k, _, _ in base:
            n[k] += 1
        extra = []
        if (base or everywhere) and share and not share.keys().isdisjoint(t.lower() for t in _TERM.findall(text)):
            places = sorted((a, b) for _, a, b in base)
            extra = [("term", t.start(), t.end()) for t in _outside(_TERM.finditer(text), places) if t[0].lower() in share]
        code = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        every = base + extra
        out, at = [], 0
        for k, a, b in sorted(every, key=lambda x: x[1:]):
            if b <= at:
                continue
            out.append(text[at : max(a, at)])
            out.append("" if k == "term" and share[text[a:b].lower()] > limit else f"[{k}]")
            at = b
        out.append(text[at:])
        return (doc_id, *(n[k] for k in KINDS), hashlib.sha256(code.encode()).hexdigest(), ",".join(f"{k}:{a}:{b}" for k, a, b in every), len(extra), "".join(out))

    def batch_of(rows: list[tuple]):
        import pyarrow as pa

        types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.int64(), pa.string()]
        names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms", "clean_text"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows, strict=True)) if rows else [[]] * 9, types, strict=True)], names)

    def run(batches: Iterator) -> Iterator:
        share = shared.value
        for batch in batches:
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
            shares = batch.column("shares").to_pylist() if share is None else None
            yield batch_of([clean(i, t or "", share if share is not None else dict(shares[j] or ())) for j, (i, t) in enumerate(zip(ids, texts, strict=True))])

    def terms_of(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            found = [(r, t) for r, text in zip(batch.column("row").to_pylist(), batch.column("text").to_pylist(), strict=True) for t in {t.lower() for t in _TERM.findall(text)}]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["row", "term"])

    rows = docs.select("doc_id", "text")
    if not few:
        keyed = rows.withColumn("row", F.xxhash64("doc_id", "text"))
        held = keyed.where("text IS NOT NULL" if everywhere else "text rlike '[0-9@]'")
        terms = held.select("row", "text").mapInArrow(terms_of, "row long, term string")
        of_row = terms.join(table, "term").groupBy("row").agg(F.map_from_entries(F.collect_set(F.struct("term", "share"))).alias("shares"))
        rows = keyed.join(of_row, "row", "left").select("doc_id", "text", "shares")
    return rows.mapInArrow(run, schema)


def op1_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return sanitise(docs, everywhere=True).select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_terms")
