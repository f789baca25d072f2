"""Periodic runs of words, by Lyndon arrays over ordered alphabets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A run has so many words, and so many times its period, at least.
LEAST_LENGTH = 6
LEAST_EXPONENT = 4


def long_edges(x: list, exponent: int) -> list[tuple[int, int, int]]:
    """``(i, j, k)``: the longest Lyndon word at ``i`` ends before ``j``, and the suffixes at ``i`` and ``j`` share ``k``
    letters, for those with ``k >= (exponent - 2) * (j - i)`` and ``k > 0``.

    One pass to the right keeps the chain of previous smaller suffixes and links each suffix that leaves it to the one
    that made it leave; an exhausted suffix counts as smaller. Only order and equality of letters are used.

    The letters from the last suffix compared up to ``end`` repeat those ``shift`` before them. A comparison that ends
    below ``end`` is read off its twin; others go on from ``end``, and each letter that matches moves it. Of two known
    extensions at one suffix the shorter decides unless they are equal, in which case letters are compared from there
    on, which again is ``end``. So all comparisons together take linear time.
    """
    n, times, found = len(x), exponent - 2, []
    after, shared_after = [n] * n, [0] * n  # next smaller suffix, and the letters shared with it
    before, shared_before = [-1] * n, [0] * n  # previous smaller suffix, likewise
    end = shift = 0
    for r in range(1, n):
        left = r - 1
        if r >= end:
            if x[left] < x[r]:
                before[r] = left
                continue
            known = 0
        else:
            twin = r - shift
            known = -1
            while known < 0:
                at = left - shift
                if after[at] == twin:
                    k = shared_after[at]
                    if r + k >= end:
                        known = end - r
                    else:
                        after[left] = r
                        if k:
                            shared_after[left] = k
                            if k >= times * (r - left):
                                found.append((left, r, k))
                        left = before[left]
                else:
                    k = shared_before[twin]
                    if r + k >= end:
                        known = end - r
                    else:
                        before[r], shared_before[r] = left, k
                        break
            if known < 0:
                continue
        most = n - r
        while True:
            while known < most and x[left + known] == x[r + known]:
                known += 1
            end, shift = r + known, r - left
            if known < most and x[left + known] < x[r + known]:
                before[r], shared_before[r] = left, known
                break
            k = known
            while k >= known:
                after[left] = r
                if known:
                    shared_after[left] = known
                    if known >= times * (r - left):
                        found.append((left, r, known))
                k = shared_before[left]
                left = before[left]
                if left < 0 or k == known:
                    break
            if left < 0:
                break
            if k < known:
                before[r], shared_before[r] = left, k
                break
    return found


def runs_of(letters: list, least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> list[tuple[int, int, int]]:
    """``(start, length, period)`` of every run of ``letters``, by start, then period.

    Letters are numbered as they first occur, which is as good an order as any. Under this order or the reverse one, a
    run holds Lyndon words of its period's length whose next smaller suffix stands one period on; the first of them has
    less than a period of the run before it, which is found by comparing letters backwards.
    """
    numbers: dict = {}
    x = [numbers.setdefault(w, len(numbers)) for w in letters]
    found = set()
    for order in (x, [-v for v in x]):
        for i, j, k in long_edges(order, least_exponent):
            p, back = j - i, 0
            while back < p and back < i and x[i - 1 - back] == x[j - 1 - back]:
                back += 1
            if back < p and back + p + k >= max(least_length, least_exponent * p):
                found.add((i - back, back + p + k, p))
    return sorted(found, key=lambda run: (run[0], run[2]))


def collapse(letters: list, runs: list[tuple[int, int, int]]) -> list:
    """``letters`` without those that some run holds after its first period."""
    if not runs:
        return letters
    drop = bytearray(len(letters))
    for start, length, period in runs:
        drop[start + period : start + length] = b"\1" * (length - period)
    return [w for w, d in zip(letters, drop, strict=True) if not d]


def periodic_runs(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", least_length: int = LEAST_LENGTH, least_exponent: int = LEAST_EXPONENT) -> DataFrame:
    """The columns ``keep`` of ``docs``, and ``n_words``, ``runs`` (start, length, period in words) and ``collapsed``.

    Words are maximal runs of anything but space and the five ASCII controls 9 to 13, compared as they stand. A run is
    a stretch whose smallest period is ``period``, at least ``least_exponent`` (2 or more) times that long and of
    ``least_length`` words or more, which no neighbouring word extends. ``collapsed`` has the words outside of runs and
    the first period of each, joined by single spaces. Whole texts are handled, one after the other, in time linear in
    their words for each of the two orders and with some hundred bytes for each word of one text at a time.

    Null and blank texts have no words, no runs and an empty ``collapsed``. Every row counts on its own, so equal rows
    have equal results; columns of ``docs`` called like a result are left out, other columns stay if kept by name.
    """
    if least_exponent < 2:
        raise ValueError("a run is two periods long at least")
    keep = tuple(c for c in keep if c not in ("n_words", "runs", "collapsed"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema.fields)

    def scan(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            n_words, flat, offsets, rest = [], [], [0], []
            for value in batch.column(len(keep)):
                words = (value.as_py() or "").encode().split()
                runs = runs_of(words, least_length, least_exponent) if len(words) >= least_length else []
                n_words.append(len(words))
                flat += runs
                offsets.append(len(flat))
                rest.append(b" ".join(collapse(words, runs)).decode())
            parts = [pa.array(c, pa.int64()) for c in (zip(*flat, strict=True) if flat else ([], [], []))]
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(parts, ["start", "length", "period"]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(n_words, pa.int64()), runs, pa.array(rest, pa.string())], [*keep, "n_words", "runs", "collapsed"])

    source = docs.select(*keep, F.col(text).alias("text:scanned"))
    return source.mapInArrow(scan, f"{schema}{', ' * bool(keep)}n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def _with_planted_runs(docs: DataFrame) -> DataFrame:
    """One text in ten, by the crc32 of its doc_id, repeats a stretch of its words up to its end. Null ids change nothing."""
    h = F.crc32(F.col("doc_id").cast("string"))
    chosen = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")).alias("w"))
    sized = chosen.withColumns({"n": F.size("w"), "g": F.expr("h div 10")}).withColumn("a", F.expr("if(n > 0, cast(g % n as int), 0)")).withColumn("p", F.expr("if(n > 0, cast(1 + (n - a) div (3 + g % 8) as int), 1)"))
    altered = "array_join(slice(concat(slice(w, 1, a), flatten(array_repeat(slice(w, a + 1, p), cast((n - a + p - 1) div p as int)))), 1, n), ' ')"
    return sized.select("doc_id", F.expr(f"CASE WHEN n > 0 THEN {altered} ELSE text END").alias("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of the documents, a tenth of which are given runs by rule first; the digests that the contract asks for."""
    found = periodic_runs(_with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet")))
    longest = F.expr("aggregate(runs, cast(null AS struct<start: bigint, length: bigint, period: bigint>), (best, r) -> IF(best IS NULL OR r.length > best.length, r, best))")
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("longest", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "longest.start", "longest.length", "longest.period", F.expr("1000 * longest.length div longest.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2(F.col("collapsed"), 256).alias("collapsed_sha256"),
    )
