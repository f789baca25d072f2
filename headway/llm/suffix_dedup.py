"""Removal of repeated byte strings by a sampled suffix array: deep-shallow sorting of anchored suffixes."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import _BYTES, CHUNK_BYTES, _powers, materialize, mix64, text_chunks

#: Bytes of a repeated string, and of the part of it whose hash picks its anchor.
LENGTH, ANCHOR = 400, 64
#: Bytes of common prefix up to which multikey quicksort goes before blind tries take over.
SHALLOW = ANCHOR + 32
#: Suffixes of an anchor that one task sorts together; more are split by longer common strings first.
GROUP_ROWS = 1024
#: Rows of the Arrow batches that bring whole texts or contexts to Python.
BATCH_ROWS = 2000
BROADCAST_ROWS = 1_000_000


# ---- anchors


def _range_hash(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Row, anchor, first and last window start, hash at the anchor, hash of all that the windows cover.

    A window of LENGTH bytes is anchored at the least hash of ANCHOR bytes in it, the leftmost of equals. Equal windows
    have their anchors at the same place, so repeats are found among windows whose anchors have the same hash.
    Consecutive windows mostly share an anchor; they make one row.
    """
    n = len(data)
    z = np.zeros(0, np.int64)
    if n < LENGTH:
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[data] * up[:n], out=sums[1:])
    count = n - ANCHOR + 1
    gram = mix64((sums[ANCHOR:] - sums[:count]) * down[:count])
    bits = max(1, int(n).bit_length())
    key = ((gram >> np.uint64(bits)) << np.uint64(bits)) | np.arange(count, dtype=np.uint64)
    w = LENGTH - ANCHOR + 1
    padded = np.full(-(-count // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:count] = key
    blocks = padded.reshape(-1, w)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    from_here = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - LENGTH + 1
    at = (np.minimum(from_here[:starts], upto[w - 1 : w - 1 + starts]) & np.uint64((1 << bits) - 1)).astype(np.int64)
    begin = np.arange(starts)
    row = np.searchsorted(offsets, begin, side="right") - 1
    inside = begin + LENGTH <= offsets[row + 1]
    begin, at, row = begin[inside], at[inside], row[inside]
    if not len(begin):
        return z, z, z, z, z.astype(np.uint64), z.astype(np.uint64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.append(first[1:], len(begin)) - 1
    s, e, p = begin[first], begin[last], at[first]
    whole = mix64(_range_hash(sums, down, s, e + LENGTH) + (p - s).astype(np.uint64) * np.uint64(1_000_003) + (e - s).astype(np.uint64))
    start = offsets[row[first]]
    return row[first], p - start, s - start, e - start, gram[p], whole


def _anchor_rows(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        ids, keys = batch.column("doc_id"), batch.column("key").to_numpy()
        for first, data, offsets in text_chunks(batch.column("text"), CHUNK_BYTES // 4):
            row, p, s, e, gram, whole = anchors(data, offsets)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(first + row)), pa.array(keys[first + row]), *(pa.array(x.astype(np.int32)) for x in (p, s, e)), pa.array(gram.view(np.int64)), pa.array(whole.view(np.int64))],
                ["doc_id", "key", "pos", "s", "e", "gram", "whole"],
            )


def _contexts(batches: Iterator) -> Iterator:
    """The bytes of the windows of each anchor wanted, ``wanted`` being a list of structs beside the text."""
    import pyarrow as pa

    for batch in batches:
        texts, keys = batch.column("text").cast(pa.large_binary()), batch.column("key").to_pylist()
        rows: list[tuple] = []
        for i, wanted in enumerate(batch.column("wanted").to_pylist()):
            text = texts[i].as_py()
            rows += [(w["gram"], w["pos"] - w["s"], keys[i], w["s"], text[w["s"] : w["e"] + LENGTH]) for w in wanted]
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary()], strict=True)], ["grp", "off", "key", "at", "ctx"])


# ---- deep-shallow sorting


def lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def blind_trie_order(strings: list[bytes], members: list[int]) -> list[int]:
    """Order of ``members`` by their strings, through a trie that holds branching depths and first bytes only."""
    leaf = [members[0]]
    root: list = [None, leaf]  # [branching depth, or None at a leaf; children by byte, or the members]
    for x in members[1:]:
        text = strings[x]
        node = root
        while node[0] is not None:
            byte = text[node[0]] if node[0] < len(text) else -1
            node = node[1].get(byte) or next(iter(node[1].values()))
        other = strings[node[1][0]]
        depth = lcp(text, other)
        if depth == len(text) == len(other):
            node[1].append(x)
            continue
        node = root
        while node[0] is not None and node[0] < depth:
            node = node[1][text[node[0]]]
        mine = text[depth] if depth < len(text) else -1
        if node[0] == depth:
            node[1][mine] = [None, [x]]
        else:
            down = list(node)
            node[0], node[1] = depth, {(other[depth] if depth < len(other) else -1): down, mine: [None, [x]]}
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if node[0] is None:
            out += node[1]
        else:
            stack += [node[1][k] for k in sorted(node[1], reverse=True)]
    return out


def deep_shallow_order(strings: list[bytes], depth: int = 0, shallow: int = SHALLOW) -> list[int]:
    """Indices of ``strings`` in order: multikey quicksort, eight bytes at a time, to a shallow depth; then blind tries."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), depth)]
    while stack:
        members, d = stack.pop()
        if len(members) < 2:
            out += members
            continue
        if d >= shallow:
            out += blind_trie_order(strings, members)
            continue
        words = [strings[i][d : d + 8] for i in members]
        pivot = sorted((words[0], words[len(words) // 2], words[-1]))[1]
        less, same, more = [], [], []
        for i, w in zip(members, words, strict=True):
            (less if w < pivot else same if w == pivot else more).append(i)
        stack.append((more, d))
        if len(pivot) < 8:
            stack += [([i], d) for i in reversed(same)]
        else:
            stack.append((same, d + 8))
        stack.append((less, d))
    return out


def shared_spans(group: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
    """(member, start, end) for what members share in LENGTH bytes or more across their anchors.

    A member is its anchor's offset in its context, and the context. Suffixes from the anchors are sorted; neighbours
    are united from the longest common prefix down, the smaller side moving into the larger, which is kept in the order
    of the contexts read backwards from the anchors. A moved suffix meets its two neighbours there: of all suffixes with
    that prefix they agree with it furthest to the left. So every repeat is found without comparing all pairs.
    """
    right = [c[o:] for o, c in group]
    left = [c[:o][::-1] for o, c in group]
    out: list[tuple[int, int, int]] = []

    def meet(x: int, y: int, r: int):
        k = lcp(left[x], left[y])
        if k + r >= LENGTH:
            out.append((x, group[x][0] - k, group[x][0] + r))
            out.append((y, group[y][0] - k, group[y][0] + r))

    if len(group) == 2:
        meet(0, 1, lcp(right[0], right[1]))
        return out
    order = deep_shallow_order(right)
    rank = [0] * len(group)
    for i, x in enumerate(deep_shallow_order(left)):
        rank[x] = i
    by_rank = {r: x for x, r in enumerate(rank)}
    edges = sorted(((lcp(right[a], right[b]), a, b) for a, b in zip(order, order[1:], strict=False)), reverse=True)
    head = list(range(len(group)))
    held = {i: [rank[i]] for i in range(len(group))}

    def find(x: int) -> int:
        while head[x] != x:
            head[x] = head[head[x]]
            x = head[x]
        return x

    for r, a, b in edges:
        if r + max(o for o, _ in group) < LENGTH:
            break
        a, b = find(a), find(b)
        if len(held[a]) < len(held[b]):
            a, b = b, a
        into = held[a]
        for k in held.pop(b):
            i = bisect_left(into, k)
            if i:
                meet(by_rank[k], by_rank[into[i - 1]], r)
            if i < len(into):
                meet(by_rank[k], by_rank[into[i]], r)
            into.insert(i, k)
        head[b] = a
    return out


_SPAN = "key long, a int, b int"


def _spans_of_groups(batches: Iterator) -> Iterator:
    """Spans from rows that arrive sorted by ``grp``."""
    import pyarrow as pa

    def solved(rows: list[tuple]) -> list[tuple]:
        rows = list({(r[1], r[2]): r for r in rows}.values())
        if len(rows) < 2:
            return []
        return [(rows[x][1], rows[x][2] + a, rows[x][2] + b) for x, a, b in set(shared_spans([(r[0], r[3]) for r in rows]))]

    def table(rows: list[tuple]):
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int32(), pa.int32()], strict=True)], ["key", "a", "b"])

    current, held, out = None, [], []
    for batch in batches:
        for g, *row in zip(*(batch.column(c).to_pylist() for c in ("grp", "off", "key", "at", "ctx")), strict=True):
            if g != current:
                out += solved(held)
                current, held = g, []
            held.append(row)
        if len(out) > 10_000:
            yield table(out)
            out = []
    yield table(out + solved(held))


def _halves(batches: Iterator) -> Iterator:
    """Each row of a crowded group for either half of its band of offsets: cut to the half's windows, and grouped by what all of them contain.

    ``lo`` and ``hi`` bound the distance from a window's start to the anchor.
    """
    import pyarrow as pa

    h = lambda *x: int.from_bytes(hashlib.blake2b(b"|".join(x), digest_size=8).digest(), "big", signed=True)
    for batch in batches:
        rows: list[tuple] = []
        for g, off, key, at, ctx, lo, hi in zip(*(batch.column(c).to_pylist() for c in ("grp", "off", "key", "at", "ctx", "lo", "hi")), strict=True):
            mid = (lo + hi + 1) // 2
            for a, b in ((lo, mid), (mid, hi)):
                low, high = max(a, off - (len(ctx) - LENGTH)), min(b - 1, off)
                if a < b and low <= high:
                    cut = ctx[off - high : off - low + LENGTH]
                    core = ctx[off - a if a <= off else 0 : off + LENGTH - b + 1] if low == a and high == b - 1 else cut[high - a : high - a + LENGTH - (b - 1 - a)]
                    rows.append((h(str(g).encode(), str(a).encode(), core), high, key, at + off - high, cut, a, b, h(str(high).encode(), cut)))
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 8
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.int32(), pa.int32(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["grp", "off", "key", "at", "ctx", "lo", "hi", "whole"])


_ROW = "grp long, off int, key long, at int, ctx binary"


def _crowded(rows: DataFrame, group_rows: int) -> tuple[list[DataFrame], DataFrame | None]:
    """Spans of exact repeats, and rows in groups that are small enough, from rows of groups that are too large."""
    spans, small = [], None
    rows = rows.withColumn("lo", F.lit(0)).withColumn("hi", F.lit(LENGTH - ANCHOR + 1))
    for level in range((LENGTH - ANCHOR).bit_length() + 1):
        split = materialize(rows.mapInArrow(_halves, f"{_ROW}, lo int, hi int, whole long"), f"halves{level}", BATCH_ROWS)
        same = split.groupBy("grp", "whole").agg(F.count_distinct("key", "at").alias("n"), F.min(F.struct("key", "at")).alias("one"))
        same = materialize(same, f"halves{level}-same")
        repeated = split.select("grp", "whole", "key", F.col("at").alias("a"), (F.col("at") + F.length("ctx")).alias("b")).join(same.where("n > 1").select("grp", "whole"), ["grp", "whole"])
        spans.append(materialize(repeated.select("key", "a", "b").distinct(), f"halves{level}-spans"))
        sizes = materialize(same.groupBy("grp").agg(F.count("*").alias("size")).where("size > 1"), f"halves{level}-sizes")
        one = split.join(same.select("grp", "whole", F.col("one.key").alias("key"), F.col("one.at").alias("at")), ["grp", "whole", "key", "at"]).join(sizes, "grp")
        one = materialize(one.select(*(c.split()[0] for c in _ROW.split(", ")), "lo", "hi", "size"), f"halves{level}-rows")
        few = one.where(F.col("size") <= group_rows).drop("lo", "hi", "size")
        small = few if small is None else small.unionByName(few)
        rows = one.where(F.col("size") > group_rows).drop("size")
        if rows.isEmpty():
            break
    return spans, small


def repeated_spans(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``key, spans``: for each text (by the key of :func:`with_key`), the maximal runs of bytes that repeated strings cover."""
    found = materialize(docs.mapInArrow(_anchor_rows, "doc_id long, key long, pos int, s int, e int, gram long, whole long"), "anchors", BATCH_ROWS)
    wholes = found.groupBy("gram", "whole").agg(F.count("*").alias("n"), F.min(F.struct("key", F.coalesce("doc_id", F.lit(-1)).alias("id"), "pos", "s", "e")).alias("one"))
    wholes = materialize(wholes, "anchor-contexts")
    repeated = found.select("gram", "whole", "key", F.col("s").alias("a"), (F.col("e") + LENGTH).alias("b")).join(wholes.where("n > 1").select("gram", "whole"), ["gram", "whole"]).select("key", "a", "b")
    sizes = materialize(wholes.groupBy("gram").agg(F.count("*").alias("size")).where("size > 1"), "anchor-groups")
    members = materialize(wholes.join(sizes, "gram").select("gram", "size", "one.*"), "anchor-members")
    texts = docs.withColumn("id", F.coalesce("doc_id", F.lit(-1)))

    def contexts(wanted: DataFrame) -> DataFrame:
        of_text = wanted.groupBy("key", "id").agg(F.collect_list(F.struct("gram", "pos", "s", "e")).alias("wanted"))
        of_text = F.broadcast(of_text) if wanted.count() <= BROADCAST_ROWS else of_text
        return texts.join(of_text, ["key", "id"]).select("key", "text", "wanted").mapInArrow(_contexts, _ROW)

    small, spans = contexts(members.where(F.col("size") <= group_rows)), [repeated]
    large = members.where(F.col("size") > group_rows)
    if not large.isEmpty():
        more, cut = _crowded(contexts(large), group_rows)
        spans += more
        small = small.unionByName(cut)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    spans.append(small.repartition(parts, "grp").sortWithinPartitions("grp").mapInArrow(_spans_of_groups, _SPAN))
    every = spans[0]
    for s in spans[1:]:
        every = every.unionByName(s)
    merge = """aggregate(array_sort(collect_list(struct(a, b))), cast(array() as array<struct<a:int,b:int>>), (acc, x) ->
        CASE WHEN size(acc) = 0 OR x.a > element_at(acc, -1).b THEN concat(acc, array(x))
             ELSE concat(slice(acc, 1, size(acc) - 1), array(named_struct('a', element_at(acc, -1).a, 'b', greatest(element_at(acc, -1).b, x.b)))) END)"""
    return materialize(every.distinct().groupBy("key").agg(F.expr(merge).alias("spans")), "repeated-spans", BATCH_ROWS)


def with_key(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("key", F.xxhash64("text", F.hash("text")))


def _cut(batches: Iterator) -> Iterator:
    import pyarrow as pa

    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary())
        n, removed, runs, kept = [], [], [], []
        for i, spans in enumerate(batch.column("spans").to_pylist()):
            text, at, parts = texts[i].as_py(), 0, []
            for s in spans or ():
                parts.append(text[at : s["a"]])
                at = s["b"]
            parts.append(text[at:])
            rest = b"".join(parts)
            n.append(len(text))
            removed.append(len(text) - len(rest))
            runs.append(len(spans or ()))
            kept.append(hashlib.sha256(rest).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(kept, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def remove_repeats(docs: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row of ``docs(doc_id, text)``, as UTF-8 bytes.

    Each byte goes that a string of LENGTH bytes covers which also starts anywhere else, in any row. Windows are
    sampled by anchors; equal contexts of anchors are counted before they are shuffled, so that copies and frequent
    passages cost a sum; different contexts of one anchor are sorted together, or, if too many, split by halving the
    band of window offsets, by what all windows of a half contain. Decisions are taken on the input.

    Null text is empty; texts under LENGTH bytes lose nothing; repeated rows are repeats of each other.
    """
    docs = with_key(docs)
    spans = repeated_spans(docs, group_rows)
    spans = F.broadcast(spans) if spans.count() <= BROADCAST_ROWS // 4 else spans
    return docs.join(spans, "key", "left").select("doc_id", "text", "spans").mapInArrow(_cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
