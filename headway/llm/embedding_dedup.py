"""Embedding near-duplicates: a subspace pigeonhole join of rotated vectors, verified exactly."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from headway.llm.common import components, discard, materialize

COSINE = 0.93
#: Dimensions of a block, and vectors of a label that make a chunk: a task compares one with itself or with another.
BLOCK_DIMS = 8
CHUNK_ROWS = 16_384
#: Vectors of a chunk for each cell, on average: sets how many signs of a block's coordinates make up its cells.
CELL_ROWS = 512
#: Linked pairs that a task holds before they shrink to a forest.
PAIRS_HELD = 1_000_000
#: Most shuffle partitions that groups of chunks ask for.
MOST_PARTITIONS = 2000


def rotation(dims: int) -> np.ndarray:
    """A fixed random rotation, which spreads distances evenly over the blocks."""
    q, r = np.linalg.qr(np.random.default_rng(12).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def _blocks(dims: int, budget: float) -> list[tuple[int, int, float]]:
    """(start, end, budget) of each block: the squared distance allowed is shared in proportion to the dimensions."""
    return [(a, min(a + BLOCK_DIMS, dims), budget * (min(a + BLOCK_DIMS, dims) - a) / dims * (1 + 1e-9) + 1e-12) for a in range(0, dims, BLOCK_DIMS)]


def _unit(batch_column) -> np.ndarray:
    """Rows of doubles of unit length; all rows of one batch group have the same dimension."""
    x = batch_column.combine_chunks() if hasattr(batch_column, "combine_chunks") else batch_column
    x = x.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(x), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _flips(values: np.ndarray, budget: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, mask) for the signs that vectors within the budget may have flipped: crossing zero in a coordinate costs its square."""
    masks = np.arange(1 << values.shape[1])
    bits = (masks[:, None] >> np.arange(values.shape[1])) & 1
    return np.nonzero((values**2) @ bits.T <= budget)


def _signs(values: np.ndarray) -> np.ndarray:
    return ((values >= 0) << np.arange(values.shape[1])).sum(1)


def _apart(rotated: np.ndarray, p: np.ndarray, q: np.ndarray, span: tuple[int, int, float]) -> np.ndarray:
    """Whether the pairs' distances in a block exceed its budget."""
    return ((rotated[p, span[0] : span[1]] - rotated[q, span[0] : span[1]]) ** 2).sum(1) > span[2]


def _met(x: np.ndarray, y: np.ndarray, most: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (indices into x and y) of squared distance ``most`` at most, up to 50,000 at a time: the distances are one matrix product."""
    y = np.column_stack([-2 * y, np.ones(len(y)), (y * y).sum(1)]).T
    x = np.column_stack([x, (x * x).sum(1), np.ones(len(x))])
    for a in range(0, len(x), 256):
        p, q = np.nonzero(x[a : a + 256] @ y <= most)
        for k in range(0, len(p), 50_000):
            yield p[k : k + 50_000] + a, q[k : k + 50_000]


def _links_within(unit: np.ndarray, rotated: np.ndarray, left: np.ndarray, right: np.ndarray, spans: list, signs: int, cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (indices) between rows ``left`` and ``right``, which may be the same: each once, from the first block whose budget it keeps to.

    In each block a left vector is at home in the cell of its coordinates' signs, and a right one visits all cells that
    its ball can reach; of the same rows, those of larger mask. Reach and distance have a little over the budget, so
    that rounding loses none of the pairs that :func:`_apart` lets pass.
    """
    same = left is right
    for j, span in enumerate(spans):
        lo, hi, most = span[0], span[1], span[2] * (1 + 1e-9) + 1e-12
        inner = slice(lo, min(hi, lo + signs))
        home = _signs(rotated[left, inner])
        row, mask = _flips(rotated[right, inner], most)
        cell = (home if same else _signs(rotated[right, inner]))[row] ^ mask
        if same:
            keep = (mask == 0) | (cell > home[row])
            row, mask, cell = row[keep], mask[keep], cell[keep]
        at_home, visit = np.argsort(home, kind="stable"), np.argsort(cell, kind="stable")
        row, visitor, edges = right[row[visit]], mask[visit] > 0, np.arange((1 << inner.stop - lo) + 1)
        of_home, of_visit = np.searchsorted(home[at_home], edges), np.searchsorted(cell[visit], edges)
        for c in range(len(edges) - 1):
            mine, guests = left[at_home[of_home[c] : of_home[c + 1]]], slice(of_visit[c], of_visit[c + 1])
            if not len(mine) or guests.start == guests.stop:
                continue
            theirs, foreign = row[guests], visitor[guests]
            for x, y in _met(rotated[mine, lo:hi], rotated[theirs, lo:hi], most):
                p, q = mine[x], theirs[y]
                if same:
                    once = foreign[y] | (p < q)
                    p, q = p[once], q[once]
                inside = ~_apart(rotated, p, q, span)
                p, q = p[inside], q[inside]
                for before in spans[:j]:
                    anew = _apart(rotated, p, q, before)
                    p, q = p[anew], q[anew]
                near = (unit[p] * unit[q]).sum(1) >= cosine
                yield p[near], q[near]


def _forest(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The smallest index that each of ``n`` nodes reaches over the pairs."""
    root = np.arange(n)
    p = np.concatenate([x for x, _ in pairs]) if pairs else np.zeros(0, int)
    q = np.concatenate([y for _, y in pairs]) if pairs else np.zeros(0, int)
    while len(p):
        low = np.minimum(root[p], root[q])
        new = root.copy()
        np.minimum.at(new, root[p], low)
        np.minimum.at(new, root[q], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
        differ = root[p] != root[q]
        p, q = p[differ], q[differ]
    return root


def _groups(own: Column, chunks: Column, apart: int) -> Column:
    """The groups that a row of chunk ``own`` goes to when chunks meet that lie so far apart on a circle: each is named by one of its chunks."""
    if not apart:
        return F.array(own)
    twice = F.array(own, F.pmod(own - apart, chunks).cast("int"))
    return F.when(chunks == 2 * apart, F.array(F.pmod(own, F.lit(apart)).cast("int"))).otherwise(twice)


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, cell_rows: int = CELL_ROWS, chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label and dimension are linked at this cosine or more, in double precision. Equal vectors are one
    class first, so that copies cost a count. The classes of a label are dealt into chunks by hash, and each chunk meets
    itself and every other one in a task of its own, which returns counts and a spanning forest, never pairs. There the
    unit vectors are rotated and cut into blocks of 8 coordinates; of two linked ones at least one block lies within its
    share of the squared distance ``2 - 2 cos``. In each block a vector is at home in the cell of its coordinates' signs
    and others visit the cells that their balls can reach, so that each pair meets in one cell of every block that
    qualifies, and counts in the first of them alone. More signs make the cells, the more vectors a chunk has.

    Chunks meet in rounds, in each of which a vector is shuffled twice at most, whatever the size of its label; Spark
    drops a round's shuffle files at its end. Of a label of n vectors every pair of chunks is compared: bounded in memory
    and disk, but the time grows with n squared.

    Vectors without label, null, empty, zero, or with null or non-finite components link with nothing. Rows that share
    a vec_id each count as a vector, and reach the same component. ``vectors`` is read twice; rows find their class by
    label and 128 bits of hash of the vector.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("e"), F.col("label"))
    ok = F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (F.size("e") > 0) & F.expr("NOT exists(e, x -> x IS NULL OR isnan(x) OR abs(x) = double('inf'))") & F.expr("exists(e, x -> x <> 0)")
    rows = rows.withColumn("ok", F.coalesce(ok, F.lit(False)))
    classes = materialize(rows.where("ok").groupBy("label", "e").agg(F.min("vec_id").alias("id"), F.count("*").alias("copies")), "vector-classes")
    sizes = classes.groupBy("label", F.size("e").alias("dims")).agg(F.ceil(F.count("*") / chunk_rows).cast("int").alias("chunks"))
    sizes = materialize(sizes, "vector-sizes")
    groups, most = sizes.agg(F.coalesce(F.sum("chunks"), F.lit(0)), F.coalesce(F.max("chunks"), F.lit(1))).first()
    crowded = sizes.where("chunks > 1").select(F.col("label").alias("l"), F.col("dims").alias("d"), "chunks")  # a row for chunk_rows vectors at most
    of_size = (F.col("label") == F.col("l")) & (F.size("e") == F.col("d"))
    chunked = classes.join(F.broadcast(crowded), of_size, "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    chunked = chunked.select("id", "copies", "label", F.size("e").alias("dims"), "chunks", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int").alias("own"), "e")
    partitions = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(2 * groups, MOST_PARTITIONS))
    budget = 2 - 2 * cosine

    def comparing(same: bool):
        def compare(keys, table):
            import pyarrow as pa

            d, c = keys[1].as_py(), keys[2].as_py()
            ids, copies, own = (table.column(x).to_numpy() for x in ("id", "copies", "own"))
            order = np.argsort(ids, kind="stable")
            ids, copies, own = ids[order], copies[order], own[order]
            unit = _unit(table.column("e"))[order]
            rotated = unit @ rotation(d)
            left = np.flatnonzero(own == c)
            right = left if same else np.flatnonzero(own != c)
            signs = int(np.clip(np.round(np.log2(max(len(left), len(right), 1) / cell_rows)), 0, BLOCK_DIMS))
            pairs, held, links = [], 0, np.zeros(len(ids), np.int64)
            for p, q in _links_within(unit, rotated, left, right, _blocks(d, budget), signs, cosine):
                links += np.bincount(p, copies[q], len(ids)).astype(np.int64) + np.bincount(q, copies[p], len(ids)).astype(np.int64) if len(p) else 0
                pairs.append((p, q))
                held += len(p)
                if held > PAIRS_HELD:
                    pairs, held = [(np.arange(len(ids)), _forest(len(ids), pairs))], 0
            root = _forest(len(ids), pairs)
            out = np.flatnonzero(links)
            return pa.table({"id": pa.array(ids[out], pa.int64()), "links": pa.array(links[out]), "root": pa.array(ids[root[out]], pa.int64())})

        return compare

    rounds = []
    for apart in range(most // 2 + 1):
        dealt = chunked.where(F.col("chunks") >= 2 * apart).withColumn("c", F.explode(_groups(F.col("own"), F.col("chunks"), apart)))
        dealt = dealt.select("id", "copies", "label", "dims", "c", "own", "e").repartition(partitions, "label", "dims", "c")
        rounds.append(materialize(dealt.groupBy("label", "dims", "c").applyInArrow(comparing(not apart), "id long, links long, root long"), "vector-links"))
    met = reduce(DataFrame.unionByName, rounds)
    reach = components(met.select(F.col("id").alias("a"), F.col("root").alias("b")), "vector-components")
    counts = met.groupBy("id").agg(F.sum("links").alias("links"))
    keyed = lambda table, *columns: table.select(*columns, "label", F.xxhash64("e").alias("k1"), F.xxhash64(F.lit(1), "e").alias("k2"))
    solved = keyed(classes, "id", "copies").join(counts, "id", "left").join(reach, "id", "left")
    solved = solved.select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    solved = materialize(solved, "vector-solved")
    discard(classes, sizes, reach, *rounds)
    linked = keyed(rows.where("ok"), "vec_id").join(solved, ["label", "k1", "k2"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op5_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP5_SQL = """
WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
           WHERE label IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
             AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (WITH RECURSIVE r(vec_id, c) AS (SELECT a, a FROM links UNION SELECT l.b, r.c FROM r JOIN links l ON l.a = r.vec_id WHERE r.c < l.b)
          SELECT vec_id, min(c) AS c FROM r GROUP BY vec_id),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, COALESCE(n.n, 0)::BIGINT AS n_links, COALESCE(r.c, e.vec_id) AS component_id, COALESCE(r.c, e.vec_id) = e.vec_id AS kept
FROM embeddings e LEFT JOIN n ON n.a = e.vec_id LEFT JOIN reach r ON r.vec_id = e.vec_id
"""
