"""Spelling variants: words one edit apart by two-dimensional range reporting, grouped under their commonest form."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from headway.llm.common import discard, materialize

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LETTERS = 6
LEAST_COUNT = 5
#: A form is so many times as frequent as the word at least.
RATIO = 5
#: Words that agree outside of a block of positions are searched together; larger families are split by half blocks.
FAMILY = 4096
#: Different words that a task counts before it hands the counts on.
COUNTED = 100_000

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def count_words(docs: DataFrame, least_letters: int = LEAST_LETTERS, alter: Callable[[int | None, str], str] | None = None) -> DataFrame:
    """``word, n``: occurrences of the words of ``least_letters`` letters or more in the whole texts.

    A word is a maximal run of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. ``alter(doc_id, word)`` may shorten
    a document's words before they are counted. Null and empty texts have no words, repeated rows count again. Each
    task adds up what it reads, at most COUNTED different words at a time.
    """
    run = re.compile(f"[{LETTERS}]{{{least_letters},}}")

    def count(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], ["word", "n"])

        total: Counter = Counter()
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id"), batch.column("text"), strict=True):
                if text.is_valid:
                    own = Counter(run.findall(text.as_py().encode().translate(_LOWER).decode()))
                    if alter is None:
                        total.update(own)
                    else:
                        key = doc_id.as_py()
                        for word, n in own.items():
                            word = alter(key, word)
                            if len(word) >= least_letters:
                                total[word] += n
                if len(total) >= COUNTED:
                    yield out()
                    total.clear()
        yield out()

    return docs.select("doc_id", "text").mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


class WaveletMatrix:
    """Distinct integers below ``2 ** bits`` in order of position; reports those in a range of positions and of values."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length())
        self.levels = []
        for bit in reversed(range(self.bits)):
            ones = ((values >> bit) & 1).astype(bool)
            rank = np.zeros(len(values) + 1, np.int64)
            np.cumsum(~ones, out=rank[1:])
            self.levels.append(rank)
            values = np.concatenate([values[~ones], values[ones]])

    def report(self, low: np.ndarray, high: np.ndarray, least: np.ndarray, most: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the query and value, for each value in ``[least, most)`` at a position in ``[low, high)`` of a query."""
        query, value = np.arange(len(low)), np.zeros(len(low), np.int64)
        for level, rank in enumerate(self.levels):
            half = 1 << (self.bits - 1 - level)
            zeros, low0, high0 = rank[-1], rank[low], rank[high]
            to0 = (high0 > low0) & (value + half > least[query]) & (value < most[query])
            low1, high1, value1 = zeros + low - low0, zeros + high - high0, value + half
            to1 = (high1 > low1) & (value1 + half > least[query]) & (value1 < most[query])
            query, value = np.concatenate([query[to0], query[to1]]), np.concatenate([value[to0], value1[to1]])
            low, high = np.concatenate([low0[to0], low1[to1]]), np.concatenate([high0[to0], high1[to1]])
        return query, value


def _shared_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    step, k = 1 << max(0, n.bit_length() - 1), 0
    while step:
        if a[k : k + step] == b[k : k + step] and k + step <= n:
            k += step
        step >>= 1
    return k


def _ordered(family: list[int], strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Rows by family and string, and how many letters each shares with the one before; -1 at a family's first."""
    order = sorted(range(len(strings)), key=lambda i: (family[i], strings[i]))
    shared = [-1] * len(order)
    for k in range(1, len(order)):
        i, j = order[k - 1], order[k]
        if family[i] == family[j]:
            shared[k] = _shared_prefix(strings[i], strings[j])
    return np.array(order), np.array(shared)


def _intervals(order: np.ndarray, shared: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """For each row, the range of the order that has its family and its first ``depth`` letters."""
    first = np.flatnonzero(shared < depth)
    group = np.cumsum(shared < depth) - 1
    low, high = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    low[order], high[order] = first[group], np.append(first[1:], len(order))[group]
    return low, high


def near_in_families(family: list[int], words: list[str], starts: list[int], stops: list[int], full: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows whose words are one edit apart within their family's block of positions, in both directions.

    All words of a family agree before ``start`` and behind ``stop``; those with ``full`` have a letter at each
    position of the block, the others one letter less. For each full word and position of the block, the prefix up to
    it is an interval of the forward order of middles and the suffix behind it one of the backward order; a wavelet
    matrix over the points (forward rank, backward rank) reports what lies in both: full words with another letter
    there, and the word without that letter. In a stretch of equal letters only the last counts as left out, so each
    pair is reported once over all blocks.
    """
    middles = [w[a : b if f else b - 1] for w, a, b, f in zip(words, starts, stops, full, strict=True)]
    forward, shared_forward = _ordered(family, middles)
    backward, shared_backward = _ordered(family, [m[::-1] for m in middles])
    rank = np.empty(len(words), np.int64)
    rank[backward] = np.arange(len(words))
    tree = WaveletMatrix(rank[forward])
    full_rows, width, start = np.array(full), np.array(stops) - np.array(starts), np.array(starts)
    deepest = int(width.max())
    suffixes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    ones, others = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for depth in range(deepest):
        rows = np.flatnonzero(full_rows & (width > depth))
        low, high = _intervals(forward, shared_forward, depth)
        behind = width[rows] - 1 - depth
        for rest in np.unique(behind):
            if rest not in suffixes:
                suffixes[rest] = _intervals(backward, shared_backward, rest)
            least, most = suffixes[rest]
            own = rows[behind == rest]
            query, value = tree.report(low[own], high[own], least[own], most[own])
            one, other = own[query], backward[value]
            away = one != other
            one, other = one[away], other[away]
            short = ~full_rows[other]
            at = start[one] + depth
            counts = np.array([not s or i + 1 == len(words[r]) or words[r][i + 1] != words[r][i] for r, i, s in zip(one.tolist(), at.tolist(), short.tolist(), strict=True)], bool)
            one, other, short = one[counts], other[counts], short[counts]
            ones += [one, other[short]]
            others += [other, one[short]]
    return np.concatenate(ones), np.concatenate(others)


def _families(words: DataFrame) -> DataFrame:
    """Each word in the families of its own length, and as one with a letter left out in those of the next; by half blocks."""
    sized = words.select("word", "n", F.explode(F.array(F.struct(F.length("word").alias("size"), F.lit(True).alias("full")), F.struct((F.length("word") + 1).alias("size"), F.lit(False).alias("full")))).alias("x")).select("word", "n", "x.*")
    return _keyed(sized.withColumn("b", F.explode(F.expr("array(struct(0 AS start, size div 2 AS stop), struct(size div 2 AS start, size AS stop))"))).select("word", "n", "size", "full", "b.*"))


def _keyed(rows: DataFrame) -> DataFrame:
    """With the family's name: length, block, and the letters outside of the block."""
    tail = F.expr("substring(word, if(full, stop, stop - 1) + 1)")
    return rows.withColumn("family", F.concat_ws(":", "size", "start", F.expr("substring(word, 1, start)"), tail))


def near_words(words: DataFrame, family: int = FAMILY) -> DataFrame:
    """``word, near, near_n`` for each two of ``words(word, n)`` that one inserted, deleted or replaced code point turns into each other.

    Both directions are given, each once. ``words`` must be distinct and not null. Two such words agree in all but one
    half of the positions of the longer; families of words that do so are dealt over tasks, and those of more than
    ``family`` words are first split into the families of half their block, down to a single position, where no more
    words can meet than there are letters. So no task holds more than a few families at a time and none is cut off.
    """
    rows = materialize(_families(words), "spelling-families")
    done, tables = [], [rows]
    while True:
        sizes = rows.groupBy("family").agg(F.count("*").alias("members"), F.max(F.col("stop") - F.col("start")).alias("width")).where(F.col("members") > 1)
        sizes = materialize(sizes.select("family", ((F.col("members") > family) & (F.col("width") > 1)).alias("crowded")), "spelling-sizes")
        tables.append(sizes)
        sized = rows.join(sizes, "family")
        done.append(sized.where(~F.col("crowded")).drop("crowded"))
        if not sizes.where("crowded").limit(1).count():
            break
        halves = F.expr("array(struct(start, (start + stop) div 2 AS stop), struct((start + stop) div 2 AS start, stop))")
        split = sized.where("crowded").withColumn("b", F.explode(halves)).select("word", "n", "size", "full", "b.*")
        rows = materialize(_keyed(split), "spelling-families")
        tables.append(rows)
    members = done[0]
    for more in done[1:]:
        members = members.unionByName(more.select(*members.columns))
    members = members.repartition("family").sortWithinPartitions("family").select("family", "word", "n", "start", "stop", "full")

    def search(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def pairs(table):
            names = table.column("family").to_pylist()
            numbers = np.cumsum([0] + [a != b for a, b in zip(names, names[1:], strict=False)]).tolist()
            one, other = near_in_families(numbers, table.column("word").to_pylist(), *(table.column(c).to_pylist() for c in ("start", "stop", "full")))
            word = table.column("word").combine_chunks()
            return pa.RecordBatch.from_arrays([word.take(pa.array(one)), word.take(pa.array(other)), table.column("n").combine_chunks().take(pa.array(other))], ["word", "near", "near_n"])

        rest = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if rest is None else pa.concat_tables([rest, table]).combine_chunks()
            names = table.column("family").to_pylist()
            last = len(names) - 1
            while last > 0 and names[last - 1] == names[-1]:
                last -= 1
            rest = table.slice(last)
            if last:
                yield pairs(table.slice(0, last).combine_chunks())
        if rest is not None and len(rest):
            yield pairs(rest.combine_chunks())

    found = materialize(members.mapInArrow(search, "word string, near string, near_n long"), "spelling-near")
    discard(*tables)
    return found


def spelling_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for each of ``words(word, n)``, which must be distinct and not null.

    ``form`` is the most frequent near word (of equals the first by code points) if it is ``ratio`` times (above 1) as
    frequent as the word or more, else null; ``root`` is where following the forms ends. Frequencies grow along forms,
    so there are no circles, and since counts are below 2**63 the doublings of the path can be numbered beforehand.
    """
    if ratio <= 1:
        raise ValueError("forms must be more frequent than their variants")
    near = near_words(words)
    best = near.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    found = words.join(best, "word", "left").withColumn("taken", F.coalesce(-F.col("best.less") >= ratio * F.col("n"), F.lit(False)))
    found = materialize(found.select("word", F.when(F.col("taken"), F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(F.col("taken"), -F.col("best.less")).alias("form_n")), "spelling-forms")
    discard(near)
    up = found.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(math.ceil(math.log2(63 / math.log2(ratio) + 1))):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up, before = materialize(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots"), up
        discard(before)
        if not up.where("moved").limit(1).count():
            break
        up, moved = up.select("word", "root"), up
        up.written_to = moved.written_to
    return found.join(up.select("word", "root"), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def _planted(doc_id: int | None, word: str) -> str:
    """Without one of its letters if 199 divides the crc32 of the document's id and the word; a null id counts as empty."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
    if h % 199:
        return word
    at = h % len(word)
    return word[:at] + word[at + 1 :]


def op13_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Variants among the words of all documents, some of which are misspelt by rule first."""
    words = count_words(spark.read.parquet(f"{sf_dir}/documents.parquet"), alter=_planted)
    return spelling_variants(materialize(words.where(F.col("n") >= LEAST_COUNT), "spelling-words"))
