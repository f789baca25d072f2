import random
import re
import zlib
from collections import Counter

import numpy as np

from headway.llm.spelling import WaveletMatrix, count_words, near_words, op13_spelling_variants, spelling_variants

SF = "/root/testdata/sf0.01"


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(words):
    """Variants by trying every single edit of every word."""
    left_out, found = {}, {}
    for w in words:
        for i in range(len(w)):
            left_out.setdefault(("=", i, w[:i] + w[i + 1 :]), set()).add(w)
            left_out.setdefault(("-", w[:i] + w[i + 1 :]), set()).add(w)
    for w in words:
        near = set().union(*(left_out.get(("=", i, w[:i] + w[i + 1 :]), set()) for i in range(len(w))), left_out.get(("-", w), set()), {w[:i] + w[i + 1 :] for i in range(len(w))} & words.keys()) - {w}
        best = min(near, key=lambda v: (-words[v], v), default=None)
        found[w] = (best if best is not None and words[best] >= 5 * words[w] else None, len(near))
    out = {}
    for w, (form, n_near) in found.items():
        root = w
        while found[root][0] is not None:
            root = found[root][0]
        out[w] = (form, root, words[w], n_near, words[form] if form else None)
    return out


def test_wavelet_ranges():
    pick = np.random.default_rng(3)
    for n in (1, 2, 3, 17, 64, 200):
        values = pick.permutation(n)
        low, least = pick.integers(0, n + 1, 50), pick.integers(0, n + 1, 50)
        high, most = np.minimum(n, low + pick.integers(0, n + 1, 50)), np.minimum(n, least + pick.integers(0, n + 1, 50))
        query, value = WaveletMatrix(values).report(low, high, least, most)
        want = {(q, v) for q in range(50) for v in values[low[q] : high[q]].tolist() if least[q] <= v < most[q]}
        assert set(zip(query.tolist(), value.tolist(), strict=True)) == want and len(query) == len(want)


def test_near_words_against_all_pairs(spark):
    pick = random.Random(13)
    words = {"".join(pick.choice("abé") for _ in range(pick.randint(4, 9))) for _ in range(700)} | {"aaaaaaa" * k + "b" * j for k in (1, 2) for j in range(4)} | {"x" * 3000, "x" * 3001, "x" * 1500 + "y" + "x" * 1500, "ﬀ𝒳abcd", "ﬀ𝒴abcd"}
    df = spark.createDataFrame([(w, i) for i, w in enumerate(sorted(words))], "word string, n long")
    order = sorted(words)
    want = sorted((a, b, order.index(b)) for a in words for b in words if one_edit(a, b))
    for family in (4096, 40, 2):
        assert sorted(tuple(r) for r in near_words(df, family=family).collect()) == want
    assert near_words(df.limit(0)).count() == 0


def test_variants_and_chains(spark):
    """Chains of forms, ties, words without neighbours, empty tables."""
    counts = {"letter": 700, "lettre": 700, "leter": 9, "lettter": 28, "letttter": 5, "lettar": 140, "aettar": 141, "bettar": 28, "single": 5}
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    got = {r["word"]: tuple(r)[1:] for r in spelling_variants(df).collect()}
    assert got == brute(counts)
    assert got["letttter"][:2] == ("lettter", "letter") and got["bettar"][:2] == ("aettar", "aettar") and got["single"] == (None, "single", 5, 0, None)
    assert spelling_variants(df.limit(0)).count() == 0


def test_words_are_counted_whole(spark):
    rows = [(1, "Ünïted ÜNïTED United-united a1bcdefg ×÷×÷×÷", "x"), (1, "Ünïted ÜNïTED United-united a1bcdefg ×÷×÷×÷", "x"), (2, None, "x"), (3, "", "x"), (None, "nations", "x"), (4, "letters " * 50_000, "x")]
    got = {r["word"]: r["n"] for r in count_words(spark.createDataFrame(rows, "doc_id long, text string, word string")).collect()}
    assert got == {"Ünïted": 4, "united": 4, "bcdefg": 2, "×÷×÷×÷": 2, "nations": 1, "letters": 50_000}


def test_query_against_brute_force(spark):
    counts = Counter()
    for doc_id, text in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{doc_id}:{w}".encode())
            if h % 199 == 0:
                at = h % len(w)
                w = w[:at] + w[at + 1 :]
            counts[w] += 1
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    out = op13_spelling_variants(spark, SF)
    got = {r["word"]: tuple(r)[1:] for r in out.collect()}
    want = brute(words)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20
    assert dict(out.dtypes) == {"word": "string", "form": "string", "root": "string", "n": "bigint", "n_near": "bigint", "form_n": "bigint"}
