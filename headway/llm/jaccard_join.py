"""N-gram Jaccard join: universe-partition pigeonhole signatures, verified exactly."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from headway.llm.common import components, discard, materialize, mix64, shingles, text_chunks

#: Documents link at 100 I >= 75 U, that is 7 I >= 3 (A + B): their sets then differ in (A + B) / 7 shingles at most.
OVERLAP, OF_BOTH = 7, 3
#: What a signature of a single shingle costs, in signatures of several: it meets every set that has the shingle.
SINGLE_COST = 4.0
#: Ids up to which a list of documents is broadcast to filter the texts; a longer one is joined by a shuffle.
BROADCAST_IDS = 500_000


class Plan:
    """How the sets of one band of sizes, [2**b, 2**(b+1)), and their larger partners above it are signed.

    The universe is cut into segments by hash. Either every segment that isn't empty is a signature (``deletions``
    false), and of two linked sets at least ``m - H`` segments are equal; or there are about half as many segments, and
    a segment's signatures are itself and what remains without one of its shingles: then at least ``m - H // 2``
    segments are equal or one shingle apart. The cheaper way is taken by the signatures expected, where those of a
    single shingle count SINGLE_COST.
    """

    def __init__(self, band: int):
        self.band, self.low, self.high = band, 1 << band, (2 << band) - 1
        n = 1.4 * self.low
        exact = math.ceil(0.42 * self.high) + 3
        rate = n / exact
        cost = exact * (1 - math.exp(-rate)) + SINGLE_COST * n * math.exp(-rate)
        few = self.differ(self.high) // 2 + 1 + (band > 2)
        rate = n / few
        cost_less = few + n + SINGLE_COST * (n * math.exp(-rate) + 2 * few * rate**2 / 2 * math.exp(-rate))
        self.deletions = cost_less < cost
        self.m = few if self.deletions else exact

    def differ(self, n):
        """Shingles in which a set of ``n`` may differ from a partner signed by this plan."""
        partner = np.where(n > self.high, self.high, 4 * n // 3)
        return (n + partner) // OVERLAP

    def joins(self, n):
        """Whether a set of ``n`` can be in a pair whose smaller set lies in the band."""
        return (n >= self.low) & (3 * n <= 4 * self.high)


#: Band of the signatures of deficient rows' prefixes; and where band and need lie in ``info``, above the size.
PREFIX, BAND_AT, NEED_AT = 63, 56, 28
#: Signatures that a pair must share, where so many are needed, after frequent ones are left out.
LEAST_SHARED = 4
#: Rounds in which a signature's members meet one of them, another each time, before they are paired.
STARS = 4


def signatures(row: np.ndarray, token: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, signature and info (band, need, size), for distinct tokens sorted by row.

    Linked rows share as many signatures in the band of the smaller one as either's need says, and one at least.

    Empty segments, and those of one shingle less one, aren't signed. A row for which they may be all that it shares
    with a partner is deficient; as a pair is safe if either side is not, deficient rows sign the prefix of their
    sorted shingles besides, which any two linked sets share.
    """
    size = np.bincount(row, minlength=rows)
    out_row, out_sig, out_info = [], [], []
    for band in range(int(size.max(initial=0)).bit_length()):
        plan = Plan(band)
        takes = plan.joins(size)
        if not takes.any():
            continue
        here = takes[row]
        r, t = row[here], token[here]
        mixed = mix64(t + np.uint64(0x51ED270B * (band + 1)))
        segment = ((mixed >> np.uint64(33)) % np.uint64(plan.m)).astype(np.int64)
        order = np.argsort(r * plan.m + segment, kind="stable")
        r, segment, mixed = r[order], segment[order], mix64(mixed[order])
        key = r * plan.m + segment
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        sums = np.add.reduceat(mixed, first)
        count = np.diff(np.append(first, len(key)))
        place = np.uint64(band << 40) + segment[first].astype(np.uint64) + np.uint64(1)
        sign = lambda total, at: mix64(mix64(total) + at * np.uint64(0x9E3779B97F4A7C15))
        differ = plan.differ(size)
        if plan.deletions:
            need = plan.m - differ // 2 - (plan.m - np.bincount(r[first], weights=count > 1, minlength=rows).astype(np.int64))
        else:
            need = plan.m - differ - (plan.m - np.bincount(r[first], minlength=rows))
        info = (np.int64(band) << BAND_AT) | (np.maximum(need, 1) << NEED_AT) | size
        out_row.append(r[first])
        out_sig.append(sign(sums, place))
        out_info.append(info[r[first]])
        if plan.deletions:
            which = np.repeat(np.arange(len(first)), count)
            more = count[which] > 1
            out_row.append(r[more])
            out_sig.append(sign(sums[which][more] - mixed[more], place[which][more]))
            out_info.append(info[r[more]])
        deficient = takes & (need < 1)
        if deficient.any():
            rows_d = np.flatnonzero(deficient)
            begin = np.searchsorted(row, rows_d)
            for i, x in zip(begin, rows_d, strict=True):
                n = int(size[x])
                prefix = np.sort(mix64(token[i : i + n]))[: n - -(-3 * n // 4) + 1]
                out_row.append(np.full(len(prefix), x))
                out_sig.append(mix64(prefix + np.uint64(77)))
                out_info.append(np.full(len(prefix), (PREFIX << BAND_AT) | (1 << NEED_AT) | n, np.int64))
    if not out_row:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(out_row), np.concatenate(out_sig), np.concatenate(out_info)


def _sets(column) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, and (row, token) of the distinct shingles, sorted, for pieces of an Arrow column."""
    for first, data, offsets in text_chunks(column):
        row, token = shingles(data, offsets)
        order = np.lexsort((token, row))
        row, token = row[order], token[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (token[1:] != token[:-1])
        yield first, len(offsets) - 1, row[new], token[new]


def _digest(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        n, s1, s2 = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
        for first, rows, row, token in _sets(batch.column("text")):
            some = np.flatnonzero(np.bincount(row, minlength=rows))
            if len(some):
                at = np.searchsorted(row, some)
                n[first + some] = np.bincount(row, minlength=rows)[some]
                s1[first + some] = mix64(np.add.reduceat(mix64(token), at)).view(np.int64)
                s2[first + some] = mix64(np.add.reduceat(mix64(token + np.uint64(99)), at)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n), pa.array(s1), pa.array(s2)], ["doc_id", "n_shingles", "s1", "s2"])


def _sign(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for first, rows, row, token in _sets(batch.column("text")):
            at, sig, info = signatures(row, token, rows)
            for a in range(0, len(at), 65536):
                part = at[a : a + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(sig[a : a + 65536].view(np.int64)), pa.array(ids[first + part]), pa.array(info[a : a + 65536])], ["sig", "id", "info"])


def _elements(batches: Iterator) -> Iterator:
    """The distinct shingles of each text, with a number for the set and its size."""
    import pyarrow as pa

    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        for first, rows, row, token in _sets(batch.column("text")):
            n = np.bincount(row, minlength=rows)
            total = np.zeros(rows, np.uint64)
            np.add.at(total, row, mix64(token))
            for a in range(0, len(row), 65536):
                at = row[a : a + 65536]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids[first + at], total[at].view(np.int64), token[a : a + 65536].view(np.int64), n[at])], ["doc_id", "set", "token", "n"])


def _shingle_set(text: bytes | None) -> set:
    w = (text or b"").lower().split()
    return set(zip(w, w[1:], w[2:], w[3:], w[4:], strict=False)) if len(w) >= 5 else {tuple(w)} if w else set()


def _verify(batches: Iterator) -> Iterator:
    """Keeps the pairs whose texts link, by the shingles themselves."""
    import pyarrow as pa

    last, known = None, set()
    for batch in batches:
        a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
        left, right = batch.column("text_a").cast(pa.large_binary()), batch.column("text_b").cast(pa.large_binary())
        keep = []
        for i in range(len(a)):
            text = left[i].as_py()
            if text != last:
                last, known = text, _shingle_set(text)
            other = _shingle_set(right[i].as_py())
            both = len(known & other)
            if both and OVERLAP * both >= OF_BOTH * (len(known) + len(other)):
                keep.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.int64()), pa.array([b[i] for i in keep], pa.int64())], ["a", "b"])


def _having(texts: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``texts`` whose doc_id is in ``ids(doc_id)``: by broadcast up to BROADCAST_IDS, else by a shuffle."""
    return texts.join(F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids, "doc_id", "left_semi")


def _linked(pairs: DataFrame, texts: DataFrame, label: str) -> DataFrame:
    pairs = materialize(pairs, f"{label}-pairs")
    ids = materialize(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), f"{label}-ids")
    known = _having(texts, ids)
    right = pairs.join(known.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b")
    whole = right.join(known.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a")), "a")
    links = materialize(whole.select("a", "b", "text_a", "text_b").mapInArrow(_verify, "a long, b long"), f"{label}-links")
    discard(pairs, ids)
    return links


def _size(info: str):
    return F.col(info).bitwiseAND((1 << NEED_AT) - 1)


def _fits(x: str, y: str):
    """Whether sizes allow a link, and the signature's band is that of the smaller set, or it is of the prefix."""
    low, high = F.least(_size(x), _size(y)), F.greatest(_size(x), _size(y))
    band = F.shiftright(x, BAND_AT)
    return (4 * low >= 3 * high) & ((band == PREFIX) | (F.call_function("shiftright", low, band.cast("int")) == 1))


def _need(info: str):
    return F.shiftright(info, NEED_AT).bitwiseAND((1 << (BAND_AT - NEED_AT)) - 1)


def _rarest(met: DataFrame) -> DataFrame:
    """Each set's signatures in a band less the most frequent ones, so many that any partner still shares LEAST_SHARED.

    Cost-based allocation: of two linked sets' shared signatures either side leaves out the most frequent first, so
    both leave out the same ones. A set with fewer shared signatures than it needs has no partner, and goes.

    ``pop`` sums how often a set's signatures occur: the least altered copy of a group has the greatest sum. ``front``
    numbers the kept signatures from the most frequent one, ``rest`` counts those that follow.
    """
    often = met.groupBy("sig").agg(F.count("*").alias("f"))
    of_set = Window.partitionBy("id", F.shiftright("info", BAND_AT))
    ranked = met.join(often, "sig").withColumn("rank", F.row_number().over(of_set.orderBy(F.desc("f"), "sig"))).withColumn("pop", F.sum("f").over(of_set))
    ranked = ranked.withColumn("rest", (F.count("*").over(of_set) - F.col("rank")).cast("int")).withColumn("front", (F.col("rank") - _left_out("info")).cast("int"))
    return ranked.where((F.shiftright("info", BAND_AT) == PREFIX) | (F.col("front") > 0)).select("sig", "id", "info", "pop", "front", "rest")


def _left_out(info: str):
    """How many of a set's most frequent signatures it leaves out."""
    return _need(info) - F.least(_need(info), F.lit(LEAST_SHARED))


def _pair_need():
    """Kept signatures that two linked sets of just these sizes share at least.

    ``need`` allows for the largest partner; less may differ from one of this size, but where ``need`` is 1, which may
    stand for less, or segments may be one shingle apart. A shared signature that isn't kept is among those that the
    side which leaves out more has left out, as both rank by frequency alike.
    """
    band = F.shiftright("info_a", BAND_AT)
    high = F.call_function("shiftleft", F.lit(2).cast("long"), band.cast("int")) - 1
    fewest = F.least(F.greatest(_need("info_a"), _need("info_b")), F.lit(LEAST_SHARED))

    def segments(info: str):
        n = _size(info)
        differ = F.floor((n + F.when(n > high, high).otherwise(F.floor(4 * n / 3))) / OVERLAP)
        return F.when(_need(info) > 1, _need(info) + differ).otherwise(0)

    exact = F.greatest(segments("info_a"), segments("info_b")) - F.floor((_size("info_a") + _size("info_b")) / OVERLAP) - F.greatest(_left_out("info_a"), _left_out("info_b"))
    return F.when(band.isin([b for b in range(40) if Plan(b).deletions]), fewest).otherwise(F.greatest(fewest, exact))


def _can_share():
    """Whether two sets that meet at a signature can share as many as they need: those before it and after it bound the number."""
    most = F.least("front_a", "front_b") + F.least("rest_a", "rest_b")
    return _fits("info_a", "info_b") & ((F.shiftright("info_a", BAND_AT) == PREFIX) | (most >= _pair_need()))


def _likely(pairs: DataFrame, share: float) -> DataFrame:
    """``a, b`` of ``pairs``, a row for each kept signature shared with both sides' info, front and rest, with that share of those needed."""
    pairs = pairs.where(_can_share())
    prefix = F.shiftright("info_a", BAND_AT) == PREFIX
    counted = pairs.groupBy("a", "b").agg(F.count_if(~prefix).alias("n"), F.max(F.when(~prefix, _pair_need())).alias("need"), F.max(prefix).alias("by_prefix"))
    return counted.where(F.col("by_prefix") | (F.col("n") >= share * F.col("need"))).select("a", "b")


def _class(n: str) -> Column:
    """Classes of sizes, four in a hundred wide."""
    return F.floor(25 * F.log(n)).cast("int")


def _crossing(crowd: DataFrame, texts: DataFrame) -> DataFrame:
    """``a, b``: sets of different components that meet at a signature of ``crowd(sig, id, c)`` or may link all the same.

    Linked sets share OF_BOTH / OVERLAP of both sizes at least, so each has one of the shared shingles among its rarest
    ones, of which so few count that the others don't suffice. What a copy has changed is rare, what it has left as it
    was is frequent; copies that differ too much meet by nothing of the former. A shingle meets only those of the sizes
    for which it is among the rarest, by classes of sizes.
    """
    mixed = crowd.groupBy("sig").agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select("sig")
    among = materialize(crowd.join(mixed, "sig", "left_semi").select(F.col("id").alias("doc_id"), "c").distinct(), "open-sets")
    tokens = materialize(_having(texts, among.select("doc_id")).mapInArrow(_elements, "doc_id long, set long, token long, n long"), "open-shingles")
    often = tokens.groupBy("token").agg(F.count("*").alias("f")).where("f > 1")
    of_set = Window.partitionBy("doc_id", "set").orderBy(F.coalesce("f", F.lit(1)), "token")
    ranked = tokens.join(often, "token", "left").withColumn("rank", F.dense_rank().over(of_set).cast("long")).where("f > 1")
    least = F.expr("(3 * n + 3) div 4")
    most = F.least(F.expr("4 * n div 3"), F.expr(f"{OVERLAP} * (n + 1 - rank) div {OF_BOTH} - n"))
    ranked = ranked.withColumn("least", least).withColumn("most", most).where("least <= most")
    keyed = ranked.join(among, "doc_id").select("token", "doc_id", "c", "n", "most", _class("n").alias("own"), F.explode(F.sequence(_class("least"), _class("most"))).alias("other"))
    met = materialize(keyed.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other")), "open-rarest")
    key = ["token", "low", "high"]
    several = met.groupBy(*key).agg(F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2").select(*key)
    keyed = materialize(met.join(several, key, "left_semi"), "open-prefixes")
    side = lambda x: keyed.where("own = low" if x == "a" else "own = high").select(*key, *(F.col(v).alias(f"{v}_{x}") for v in ("doc_id", "c", "n", "most")))
    fit = (F.col("n_b") <= F.col("most_a")) & (F.col("n_a") <= F.col("most_b")) & (4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    close = side("a").join(side("b"), key).where((F.col("c_a") != F.col("c_b")) & fit & ((F.col("low") < F.col("high")) | (F.col("doc_id_a") < F.col("doc_id_b"))))
    pairs = materialize(close.select(F.least("doc_id_a", "doc_id_b").alias("a"), F.greatest("doc_id_a", "doc_id_b").alias("b")).distinct(), "cross-candidates")
    discard(among, tokens, met, keyed)
    return pairs


def similar_documents(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs(doc_id, text)``.

    Documents with the same set are one class, of which the least doc_id is signed. A signature's members first
    meet the one whose signatures occur most often, which in a group of altered copies is the one least altered; then
    another, chosen by hash, in each of a few rounds; of those that then still lie in different components, sets are
    verified that share one of the rarest shingles of both. So a group of copies costs a star, as do copies that differ
    too much from it by changes of their own, and no link between different texts is lost: the result is exact.

    Null and empty texts have no shingles and link with nothing; a row with a null doc_id neither; rows that share a
    doc_id are one node.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    digest = materialize(texts.mapInArrow(_digest, "doc_id long, n_shingles long, s1 long, s2 long"), "shingle-sets")
    known = digest.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = materialize(known.groupBy("n_shingles", "s1", "s2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "shingle-classes")
    reps = classes.select(F.col("rep").alias("doc_id")).distinct()
    texts = texts.where("doc_id IS NOT NULL AND text IS NOT NULL")
    signed = _having(texts, reps).mapInArrow(_sign, "sig long, id long, info long")
    by_sig = Window.partitionBy("sig").orderBy("id")
    met = signed.select("sig", "id", "info", F.lag("id").over(by_sig).alias("before"), F.lead("id").over(by_sig).alias("next"))
    met = materialize(met.where("before IS NOT NULL OR next IS NOT NULL").select("sig", "id", "info"), "shared-signatures")
    kept = materialize(_rarest(met), "kept-signatures")
    discard(met)
    links, tested, reach, stars = None, None, None, []
    crowd = kept.withColumn("c", F.col("id"))
    for n in range(STARS):
        first = F.col("pop") if n == 0 else F.xxhash64("id", F.lit(n))
        centre = crowd.groupBy("sig").agg(F.max(F.struct(first.alias("h"), "id", "info", "c", "front", "rest")).alias("m"), F.min("c").alias("c1"), F.max("c").alias("c2")).where("c1 < c2")
        centre = centre.select("sig", F.col("m.id").alias("a"), *(F.col(f"m.{x}").alias(f"{x}_a") for x in ("info", "c", "front", "rest")))
        star = crowd.join(centre, "sig").where("c <> c_a").select(F.least("a", "id").alias("a"), F.greatest("a", "id").alias("b"), "info_a", "front_a", "rest_a", *(F.col(x).alias(f"{x}_b") for x in ("info", "front", "rest")))
        star = _likely(star, 0.5)
        star = materialize(star if tested is None else star.join(tested, ["a", "b"], "left_anti"), f"star{n}-candidates")
        new = _linked(star, texts, f"star{n}")
        links, tested = (new, star) if n == 0 else (links.unionByName(new), tested.unionByName(star))
        stars += [star, new]
        discard(reach)
        reach = components(links, f"star{n}-components")
        before, crowd = crowd, materialize(kept.join(reach, "id", "left").select("sig", "id", "info", "pop", "front", "rest", F.coalesce("component", "id").alias("c")), f"star{n}-signatures")
        discard(before)
        if new.isEmpty():
            break
    discard(kept, reach)
    candidates = _crossing(crowd, texts)
    crossed = _linked(candidates.join(tested, ["a", "b"], "left_anti"), texts, "cross")
    reach = components(links.unionByName(crossed), "jaccard-components")
    solved = materialize(classes.join(reach, classes["rep"] == reach["id"], "left").select("n_shingles", "s1", "s2", F.coalesce("component", "rep").alias("component_id")), "jaccard-solved")
    discard(crowd, crossed, candidates, reach, classes, *stars)
    linked = digest.where("n_shingles > 0").join(solved, ["n_shingles", "s1", "s2"], "left").select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
    return linked.unionByName(digest.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op4_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return similar_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, CASE WHEN len(w) >= 5 THEN array_to_string(w[k:k+4], ' ') ELSE array_to_string(w, ' ') END AS s
      FROM d, LATERAL (SELECT unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id
          JOIN n na ON na.doc_id = a.doc_id JOIN n nb ON nb.doc_id = b.doc_id
          GROUP BY a.doc_id, b.doc_id, na.n, nb.n HAVING 100 * count(*) >= 75 * (na.n + nb.n - count(*))),
reach AS (WITH RECURSIVE r(doc_id, c) AS (SELECT a, a FROM links UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.doc_id WHERE r.c < l.b)
          SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n.n, 0)::BIGINT AS n_shingles, COALESCE(r.c, d.doc_id) AS component_id
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN reach r ON r.doc_id = d.doc_id
"""
