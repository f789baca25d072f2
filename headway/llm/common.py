"""What the text operators share: materialised tables, word hashing in Arrow batches, connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of anything but space, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"
#: Words of a shingle, and the least similarity of near duplicates, unless a caller says otherwise.
SHINGLE_WORDS = 5
SIMILARITY = 0.75
#: Bytes of text that one NumPy step handles; its temporary arrays take about 60 times as much.
CHUNK_BYTES = 1 << 20
_OWN_ROOT: list[str] = []
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def work_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where it is unset on a local master one of its own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN_ROOT:
            _OWN_ROOT.append("file://" + tempfile.mkdtemp(prefix="headway-"))
            atexit.register(shutil.rmtree, _OWN_ROOT[0].removeprefix("file://"), ignore_errors=True)
        root = _OWN_ROOT[0]
    return root.rstrip("/")


def materialize(df: DataFrame, label: str, batch_rows: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, and gives the planner true sizes.

    Spark deletes the write's shuffle files at its end, as nothing else can read them, instead of at some later collection of garbage.
    ``batch_rows`` bounds the Arrow batches of this write, whose buffers executor and Python worker hold beside each other.
    """
    spark = df.sparkSession
    path = f"{work_root(spark)}/headway-{label}-{uuid.uuid4().hex}"
    wanted = {_CLEANUP: "true"} | ({_BATCH: str(batch_rows)} if batch_rows else {})
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete the files of materialised tables that nothing reads any more."""
    for df in tables:
        if path := getattr(df, "written_to", None):
            context = df.sparkSession.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of SplitMix64, elementwise over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random_table(n: int, seed: int) -> np.ndarray:
    """``n`` fixed pseudo-random uint64 values."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15))


_BYTES = random_table(256, 1)
_BASE = np.uint64(0x2545F4914F6CDD1B)
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64, and those of its inverse, up to ``n``."""
    if not _POWERS or len(_POWERS[0]) <= n:
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        size = max(n + 1, CHUNK_BYTES + 1)
        _POWERS[:] = [np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (_BASE, inverse)]
    return _POWERS[0], _POWERS[1]


def text_chunks(column, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Cut an Arrow string or binary array into runs of whole rows of about ``limit`` bytes.

    Yields the number of the first row, the bytes and the offsets of the rows in them. Null counts as empty;
    a longer row stands alone.
    """
    import pyarrow as pa

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary()) if not pa.types.is_large_binary(column.type) else column
    if column.null_count:
        column = column.fill_null(b"")
    buffers = column.buffers()
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1)
        last = min(last, len(column))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


_SEPARATES = np.zeros(256, bool)
_SEPARATES[[9, 10, 11, 12, 13, 32]] = True
#: Everything in ASCII but letters and digits; bytes of longer characters count as letters.
_NOT_ALNUM = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, alnum: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word; A-Z count as a-z. Words never cross rows."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z.astype(np.uint64)
    inside = ~(_NOT_ALNUM if alnum else _SEPARATES)[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = inside[:-1]
    edge = offsets[1:-1]
    before[edge[edge < n]] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = inside[1:]
    after[edge[(edge > 0)] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    up, down = _powers(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTES[_LOWER[data]] * up[:n], out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(data: np.ndarray, offsets: np.ndarray, k: int = SHINGLE_WORDS, alnum: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Row and 64-bit hash of every ``k``-word shingle, in order; fewer words than ``k`` make one of all of them."""
    starts, _, hashes = words(data, offsets, alnum)
    row = np.searchsorted(offsets, starts, side="right") - 1
    count = np.bincount(row, minlength=len(offsets) - 1)
    out_row, out = [], []
    full = max(0, len(hashes) - k + 1)
    if full:
        x = hashes[:full].copy()
        for i in range(1, k):
            x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + hashes[i : i + full])
        same = row[:full] == row[k - 1 :]
        out_row.append(row[:full][same])
        out.append(x[same])
    first = np.concatenate([[0], np.cumsum(count)])
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        with np.errstate(over="ignore"):
            for j, r in enumerate(short):
                x = hashes[first[r] : first[r] + 1].copy()
                for i in range(1, count[r]):
                    x = mix64(x * np.uint64(0x9E3779B97F4A7C15) + hashes[first[r] + i : first[r] + i + 1])
                whole[j] = mix64(x + np.uint64(count[r]))[0]
        out_row.append(short)
        out.append(whole)
    if not out:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    rows, values = np.concatenate(out_row), np.concatenate(out)
    order = np.argsort(rows, kind="stable")
    return rows[order], values[order]


def components(edges: DataFrame, label: str = "components", rounds: int = 60) -> DataFrame:
    """Connected components of the links ``(a, b)``: columns ``id`` and ``component``, the smallest id reachable.

    Alternates large stars and small stars, so that a chain of n nodes takes about log n rounds and no node's
    neighbours are ever gathered in one place: minima are aggregated before the shuffle and joined back. Each round
    is written out. Nodes without links are absent; loops and repeated links don't matter. ``discard`` takes the result.
    """
    edges = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    edges = materialize(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), label)
    seen = None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, materialize(small.where("a <> b").distinct(), label)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        discard(before)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    out = edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
    out.written_to = edges.written_to
    return out
