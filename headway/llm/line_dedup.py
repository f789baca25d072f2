"""Fuzzy line deduplication: SimHash blocks, edit similarity, one occurrence a group. Votes and edit distances are NumPy and Python inside tasks."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import combinations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from headway.llm.common import components, discard, materialize, text_chunks

#: Lines of so many words are compared fuzzily; shorter ones only group with equal ones.
LEAST_WORDS = 5
#: Of the 64 bits of two lines' SimHash values so many may differ; and of the bits of all their blocks.
MOST_BITS, MOST_BLOCK_BITS = 18, 40
#: The words' universe is cut by hash into so many parts; the words of each vote on a block of so many bits of their own.
PARTS, BLOCK_BITS = 6, 24
BLOCK_COLUMNS = ("f0", "f1", "f2", "n_words")
#: How many blocks candidates have equal, for lines of different words from and below such numbers.
BUCKETS = ((1, 28, 1 << 60), (2, 14, 32), (4, 0, 18))
#: What counts as a space beside the space itself.
MARKS = ".,;:!?"
#: Least edit similarity: one less the edit distance over the longer length, in code points.
SIMILARITY = 0.8
#: Rows up to which a list of line places is broadcast to fetch their texts; a longer one is joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def _normalised(line: str) -> Column:
    """Lower case, tabs and carriage returns as spaces, outer ones cut; ``replace`` finds nothing far sooner than ``translate``."""
    spaced = F.replace(F.replace(line, F.lit("\t"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    return F.lower(F.trim(spaced))


def _lines(docs: DataFrame) -> DataFrame:
    """``doc_id, pos, norm, k1, k2`` for every line that isn't blank: lower-cased, outer white space cut."""
    line = docs.where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    line = line.where(F.trim("line", F.lit(" \t\r")) != "").select("doc_id", "pos", _normalised("line").alias("norm"))
    return line.withColumn("k1", F.xxhash64("norm")).withColumn("k2", F.hash("norm"))


def _words(norm: str) -> Column:
    """Words between spaces, less the marks in MARKS; a pattern or ``translate`` takes several times as long."""
    spaced = reduce(lambda x, mark: F.replace(x, F.lit(mark), F.lit(" ")), MARKS, F.col(norm))
    return F.array_remove(F.split(spaced, " "), "")


_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))
_LANES = [np.uint64(x % (1 << 64)) for x in (int(_P1) + int(_P2), int(_P2), 0, -int(_P1))]
_EACH_BYTE = np.uint64(0x0101010101010101)
_BREAKS = np.zeros(256, bool)
_BREAKS[list(b" " + MARKS.encode())] = True
_EDGES = np.array([-(1 << 63) + (1 << 64) * p // PARTS for p in range(1, PARTS)], np.int64)


def _turned(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What Spark's ``xxhash64`` gives for the strings of these bytes."""
    size = ends - starts
    data = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = lambda at: np.lib.stride_tricks.sliding_window_view(data, 8)[at].view("<u8").reshape(-1)
    h = size.astype(np.uint64) + np.uint64(42) + _P5
    at = starts.copy()
    mixed = lambda x: _turned(x * _P2, 31) * _P1
    long = np.flatnonzero(size >= 32)
    if len(long):
        v = [np.full(len(long), 42, np.uint64) + x for x in _LANES]
        live = np.arange(len(long))
        while len(live):
            for j in range(4):
                v[j][live] = _turned(v[j][live] + eight(at[long[live]] + 8 * j) * _P2, 31) * _P1
            at[long[live]] += 32
            live = live[ends[long[live]] - at[long[live]] >= 32]
        x = sum(_turned(y, by) for y, by in zip(v, (1, 7, 12, 18), strict=True))
        for y in v:
            x = (x ^ mixed(y)) * _P1 + _P4
        h[long] = x + size[long].astype(np.uint64)
    live = np.flatnonzero(ends - at >= 8)
    while len(live):
        h[live] = _turned(h[live] ^ mixed(eight(at[live])), 27) * _P1 + _P4
        at[live] += 8
        live = live[ends[live] - at[live] >= 8]
    live = np.flatnonzero(ends - at >= 4)
    h[live] = _turned(h[live] ^ ((eight(at[live]) & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
    at[live] += 4
    live = np.flatnonzero(ends > at)
    while len(live):
        h[live] = _turned(h[live] ^ (data[at[live]].astype(np.uint64) * _P5), 11) * _P1
        at[live] += 1
        live = live[ends[live] > at[live]]
    h = (h ^ (h >> np.uint64(33))) * _P2
    h = (h ^ (h >> np.uint64(29))) * _P3
    return h ^ (h >> np.uint64(32))


def _majority(hashes: np.ndarray, first: np.ndarray, shifts: range) -> np.ndarray:
    """For each run of hashes from ``first`` on, the bits ``shift + 8 * lane`` on which more than half of them vote: a byte counts the votes of a lane, up to 255."""
    count = np.diff(np.append(first, len(hashes)))
    out = np.zeros(len(first), np.uint64)
    for s in map(np.uint64, shifts):
        votes = np.add.reduceat((hashes >> s) & _EACH_BYTE, first).view(np.uint8).reshape(-1, 8)
        out |= (2 * votes.astype(np.int64) > count[:, None]).astype(np.uint8).view("<u8").reshape(-1) << s
    for i in np.flatnonzero(count > 255):
        own, out[i] = hashes[first[i] : first[i] + count[i]], 0
        for bit in (s + 8 * lane for s in shifts for lane in range(8)):
            out[i] |= np.uint64(int(2 * int(((own >> np.uint64(bit)) & np.uint64(1)).sum()) > count[i]) << bit)
    return out


def _voted(column) -> Iterator[tuple]:
    """First row, number of rows, row and hash of their different words by row and hash, and the number of all words, for pieces of an Arrow column."""
    for first, data, offsets in text_chunks(column):
        rows, n = len(offsets) - 1, len(data)
        inside = ~_BREAKS[data]
        before, after = np.zeros(n, bool), np.zeros(n, bool)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        edge = offsets[1:-1]
        before[edge[edge < n]] = False
        after[edge[edge > 0] - 1] = False
        starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        row = np.searchsorted(offsets, starts, side="right") - 1
        hashes = _xxhash64(data, starts, ends)
        order = np.lexsort((hashes.view(np.int64), row))
        row_, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row_[1:] != row_[:-1]) | (hashes[1:] != hashes[:-1])
        yield first, rows, row_[new], hashes[new], np.bincount(row, minlength=rows)


def _runs(key: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def _with_simhash(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        out = np.zeros(batch.num_rows, np.uint64)
        for at, _, row, hashes, _ in _voted(batch.column("norm")):
            if len(row):
                out[at + row[_runs(row)]] = _majority(hashes, _runs(row), range(8))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out.view(np.int64))], [*batch.schema.names, "simhash"])


def _add_simhash(lines: DataFrame) -> DataFrame:
    """``lines`` with ``simhash`` of ``norm``: each bit is the majority of the different words' hashes there."""
    return lines.mapInArrow(_with_simhash, StructType([*lines.schema.fields, StructField("simhash", LongType())]))


def sim_hash(lines: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``id, simhash`` for the lines of ``lines(id, norm)`` with ``least_words`` words or more: each bit is the majority of the different words' hashes there."""
    return _add_simhash(lines.where(F.size(_words("norm")) >= least_words).select("id", "norm")).select("id", "simhash")


def _blocks(batches: Iterator) -> Iterator:
    """SimHash blocks of the parts of a line's words, two to a long, and the number of its different words, in place of ``norm``; null if it has under LEAST_WORDS.

    The words of a part vote on their block only: an edit of one word leaves all blocks but two as they are, however few
    words a line has, and however many. A part is a range of hashes, so that those of sorted hashes lie together.
    """
    import pyarrow as pa

    for batch in batches:
        block = np.zeros((batch.num_rows, PARTS), np.uint64)
        different = np.zeros(batch.num_rows, np.int32)
        n_all = np.zeros(batch.num_rows, np.int64)
        for at, rows, row, hashes, count in _voted(batch.column("norm")):
            n_all[at : at + rows] = count
            if not len(row):
                continue
            part = np.searchsorted(_EDGES, hashes.view(np.int64), side="right")
            first = _runs(row * PARTS + part)
            block[at + row[first], part[first]] = _majority(hashes, first, range(BLOCK_BITS // 8))
            different[at : at + rows] = np.bincount(row, minlength=rows)
        none = n_all < LEAST_WORDS
        pairs = [pa.array((block[:, p] | block[:, p + 1] << np.uint64(BLOCK_BITS // 8)).view(np.int64), mask=none) for p in range(0, PARTS, 2)]
        rest = [c for c in batch.schema.names if c != "norm"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *pairs, pa.array(different, mask=none)], [*rest, *BLOCK_COLUMNS])


def _add_blocks(lines: DataFrame) -> DataFrame:
    """``lines`` with BLOCK_COLUMNS in place of ``norm``."""
    types = [LongType()] * (PARTS // 2) + [IntegerType()]
    rest = [x for x in lines.schema.fields if x.name != "norm"]
    return lines.mapInArrow(_blocks, StructType([*rest, *(StructField(c, t) for c, t in zip(BLOCK_COLUMNS, types, strict=True))]))


def _buckets(hashed: DataFrame) -> DataFrame:
    """``bucket, id`` for each choice of blocks, the bucket being a hash of the blocks' bits and which they are.

    The fewer words a line has, the more blocks make a bucket; lines on the border between two numbers do both.
    """
    mask = sum(((1 << BLOCK_BITS // 8) - 1) << 8 * i for i in range(8))
    mask -= (mask >> 63) << 64
    block = lambda p: F.shiftrightunsigned(f"f{p // 2}", BLOCK_BITS // 8 * (p % 2)).bitwiseAND(mask)
    none = F.array().cast("array<bigint>")
    chosen = [F.when((F.col("n_words") >= low) & (F.col("n_words") < high), F.array(*(F.xxhash64(F.lit(f"{c}"), *map(block, c)) for c in combinations(range(PARTS), k)))).otherwise(none) for k, low, high in BUCKETS]
    return hashed.select("id", F.explode(F.concat(*chosen)).alias("bucket"))


def _within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of two texts is ``most`` at most: a column of the table is two integers of a bit for each row (Myers)."""
    if abs(len(a) - len(b)) > most:
        return False
    if not a or not b:
        return True
    at: dict[str, int] = {}
    for i, x in enumerate(a):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    up, down, distance = full, 0, len(a)
    for left, x in zip(range(len(b) - 1, -1, -1), b, strict=True):
        eq = at.get(x, 0)
        same = eq | down
        across = (((eq & up) + up) ^ up) | eq
        plus = down | (full & ~(across | up))
        minus = up & across
        if plus & top:
            distance += 1
        elif minus & top:
            distance -= 1
        if distance - left > most:
            return False
        plus = plus << 1 & full | 1
        minus = minus << 1 & full
        up = minus | (full & ~(same | plus))
        down = plus & same
    return distance <= most


def similar(a: str, b: str, similarity: float = SIMILARITY) -> bool:
    """Whether two lines have that edit similarity.

    Words that both begin and end with need no table of distances. If so few of the others differ that even the longest
    ones would do, characters needn't be compared.
    """
    most = math.floor((1 - similarity) * max(len(a), len(b)) + 1e-9)
    if abs(len(a) - len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    first, last = 0, min(len(x), len(y))
    while first < last and x[first] == y[first]:
        first += 1
    end = 0
    while end < last - first and x[-1 - end] == y[-1 - end]:
        end += 1
    x, y = x[first : len(x) - end], y[first : len(y) - end]
    a, b = " ".join(x), " ".join(y)
    if max(len(a), len(b)) <= most:
        return True
    if len(x) == len(y) and sum(max(len(v), len(w)) for v, w in zip(x, y, strict=True) if v != w) <= most:
        return True
    return _within(a, b, most)


def _keep_similar(similarity: float):
    def keep(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            pairs = zip(batch.column("norm_a").to_pylist(), batch.column("norm_b").to_pylist(), strict=True)
            yield batch.select(["a", "b"]).filter(pa.array([similar(x, y, similarity) for x, y in pairs], pa.bool_()))

    return keep


def _verified(pairs: DataFrame, places: DataFrame, docs: DataFrame, similarity: float, label: str) -> DataFrame:
    """The pairs whose lines are as similar as that by edit distance; ``places(id, doc_id, pos)`` says where they stand."""
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    wanted = materialize(places.join(ids, "id", "left_semi").groupBy("doc_id").agg(F.collect_list(F.struct("id", "pos")).alias("wanted")), f"{label}-places")
    few = wanted.agg(F.coalesce(F.sum(F.size("wanted")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    by_doc = wanted.withColumnRenamed("doc_id", "d")
    found = docs.where("text IS NOT NULL").join(F.broadcast(by_doc) if few else by_doc, F.col("doc_id").eqNullSafe(F.col("d")))
    found = found.select(F.split("text", "\n").alias("lines"), F.explode("wanted").alias("p")).select(F.col("p.id").alias("id"), F.get("lines", F.col("p.pos")).alias("line"))
    norms = found.select("id", _normalised("line").alias("norm")).where("norm <> ''").dropDuplicates(["id"])
    norms = materialize(_add_simhash(norms), f"{label}-texts")
    side = lambda x: norms.select(F.col("id").alias(x), F.col("norm").alias(f"norm_{x}"), F.col("simhash").alias(f"simhash_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").where(F.bit_count(F.col("simhash_a").bitwiseXOR(F.col("simhash_b"))) <= MOST_BITS)
    links = materialize(both.select("a", "b", "norm_a", "norm_b").mapInArrow(_keep_similar(similarity), "a long, b long"), f"{label}-links")
    discard(wanted, norms)
    return links


def group_lines(docs: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Occurrences ``doc_id, pos, k1, k2`` of lines, and ``k1, k2, keep_doc, keep_pos`` for the lines of groups over one.

    Equal lines are counted first. Distinct ones meet in buckets of equal SimHash blocks: in each, all are compared with
    the least one, and after that only lines of different groups with each other, so that a bucket of copies costs a
    star. Lengths and SimHash values rule out most candidates; texts are fetched for the others only.
    """
    lines = _lines(docs)
    whole = materialize(_add_blocks(lines.select("doc_id", "pos", "k1", "k2", F.length("norm").alias("len"), "norm")), "line-places")
    occurrences = whole.select("doc_id", "pos", "k1", "k2")
    values = list(BLOCK_COLUMNS)
    first = whole.groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("first"), F.min("len").alias("len"), *(F.min(c).alias(c) for c in values))
    first = materialize(first.select(F.xxhash64("k1", "k2").alias("id"), "k1", "k2", "n", "first", "len", *values), "line-firsts")
    places = first.select("id", "first.doc_id", "first.pos")
    hashed = first.where("f0 IS NOT NULL AND f1 IS NOT NULL AND f2 IS NOT NULL").select("id", "len", *values)
    by_bucket = Window.partitionBy("bucket").orderBy("id")
    shared = _buckets(hashed).select("bucket", "id", F.lag("id").over(by_bucket).alias("before"), F.lead("id").over(by_bucket).alias("next"))
    shared = materialize(shared.where("before IS NOT NULL OR next IS NOT NULL").select("bucket", "id"), "line-buckets")
    bits = ["f0", "f1", "f2"]
    keyed = materialize(shared.join(hashed.select("id", "len", *bits), "id"), "line-buckets-hashed")
    discard(shared)

    def near(x: str, y: str) -> Column:
        differ = sum(F.bit_count(F.col(f"{f}{x}").bitwiseXOR(F.col(f"{f}{y}"))) for f in bits)
        return (differ <= MOST_BLOCK_BITS) & (F.greatest(f"len{x}", f"len{y}") - F.least(f"len{x}", f"len{y}") <= (1 - similarity) * F.greatest(f"len{x}", f"len{y}") + 1e-9)

    least = keyed.groupBy("bucket").agg(F.min(F.struct("id", "len", *bits)).alias("m")).select("bucket", F.col("m.id").alias("a"), *(F.col(f"m.{c}").alias(f"{c}_a") for c in ("len", *bits)))
    star = materialize(keyed.join(least, "bucket").where((F.col("id") != F.col("a")) & near("", "_a")).select("a", F.col("id").alias("b")).distinct(), "line-star-pairs")
    star_links = _verified(star, places, docs, similarity, "line-star")
    reach = components(star_links, "line-star-groups")
    crowd = keyed.join(reach, "id", "left").select("bucket", "id", "len", *bits, F.coalesce("component", "id").alias("c"))
    mixed = Window.partitionBy("bucket")
    crowd = materialize(crowd.withColumn("c1", F.min("c").over(mixed)).withColumn("c2", F.max("c").over(mixed)).where("c1 < c2").drop("c1", "c2"), "line-buckets-grouped")
    other = crowd.select("bucket", *(F.col(c).alias(f"{c}_b") for c in ("id", "len", *bits, "c")))
    cross = crowd.join(other, "bucket").where((F.col("id") < F.col("id_b")) & (F.col("c") != F.col("c_b")) & near("", "_b")).select(F.col("id").alias("a"), F.col("id_b").alias("b")).distinct()
    cross = materialize(cross.join(star, ["a", "b"], "left_anti"), "line-cross-pairs")
    discard(keyed, crowd, star)
    links = star_links.unionByName(_verified(cross, places, docs, similarity, "line-cross"))
    reach = components(links, "line-groups")
    grouped = first.join(reach, "id", "left").select("k1", "k2", "n", "first", "component")
    keep = reach.join(first.select("id", "first"), "id").groupBy("component").agg(F.min("first").alias("keep"))
    several = grouped.where("component IS NOT NULL").join(keep, "component").select("k1", "k2", "keep")
    of_groups = several.unionByName(grouped.where("component IS NULL AND n > 1").select("k1", "k2", F.col("first").alias("keep")))
    keeps = materialize(of_groups.select("k1", "k2", F.col("keep.doc_id").alias("keep_doc"), F.col("keep.pos").alias("keep_pos")), "line-keeps")
    discard(cross, star_links, first)
    return occurrences, keeps


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """All columns of ``docs`` with ``text`` less its repeated lines, and ``n_lines, n_removed``.

    Similar lines are found if they have LEAST_WORDS words, share enough blocks and differ in MOST_BITS bits of SimHash
    at most: recall is in the README. Lines in scripts without spaces have too few words to be compared but for equality.

    Of each group of equal or similar lines the first occurrence stays, by doc_id (null first) and place. Blank lines
    stay where they are. A text all of whose lines go becomes empty. Null text stays null, with no lines. Rows that
    share a doc_id count as one document: they lose lines at the same places. Columns named like the added ones are
    replaced.
    """
    occurrences, keeps = group_lines(docs.select("doc_id", "text"), similarity)
    goes = occurrences.join(keeps, ["k1", "k2"]).where(~(F.col("doc_id").eqNullSafe(F.col("keep_doc")) & (F.col("pos") == F.col("keep_pos"))))
    removed = goes.groupBy("doc_id").agg(F.array_sort(F.collect_set("pos")).alias("goes"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    whole = docs.select(*columns).join(removed.withColumnRenamed("doc_id", "goes_from"), F.col("doc_id").eqNullSafe(F.col("goes_from")), "left")
    lines = F.split("text", "\n")
    rest = F.array_join(F.expr("filter(split(text, '\\n'), (x, i) -> NOT array_contains(goes, i))"), "\n")
    whole = whole.withColumn("n_lines", F.when(F.col("text").isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("n_removed", F.coalesce(F.size("goes"), F.lit(0)).cast("long"))
    whole = whole.withColumn("n_removed", F.when(F.col("text").isNull() | F.col("goes").isNull(), F.lit(0)).otherwise(F.col("n_removed")).cast("long"))
    return whole.withColumn("text", F.when(F.col("goes").isNull(), F.col("text")).otherwise(rest)).select(*columns, "n_lines", "n_removed")


def op2_line_dedup(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs)
