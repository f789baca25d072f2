import numpy as np
import pytest
from pyspark.sql import functions as F

from headway.llm import embedding_dedup
from headway.llm.embedding_dedup import near_duplicates


def brute(rows):
    ok = [(i, np.array(e, float), lab) for i, e, lab in rows if lab is not None and e and all(x is not None and np.isfinite(x) for x in e) and any(e)]
    link = {k: [m for m, b in enumerate(ok) if m != k and b[2] == a[2] and len(b[1]) == len(a[1]) and a[1] @ b[1] / np.linalg.norm(a[1]) / np.linalg.norm(b[1]) >= 0.93] for k, a in enumerate(ok)}
    out = {i: (0, i) for i, _, _ in rows}
    for k in link:
        seen, todo = {k}, [k]
        while todo:
            for m in link[todo.pop()]:
                if m not in seen:
                    seen.add(m)
                    todo.append(m)
        out[ok[k][0]] = (len(link[k]), min(ok[m][0] for m in seen))
    return out


def test_against_brute_force(spark):
    r = np.random.default_rng(4)
    rows, i = [], 0
    for lab in (0, 1):
        centre = r.standard_normal((6, 20))
        for c in centre:
            for _ in range(25):
                rows.append((i, (c + r.standard_normal(20) * r.choice([0.1, 0.25, 0.4])).astype(np.float32).tolist(), lab))
                i += 1
    rows += [(i + k, rows[3][1], rows[3][2]) for k in range(40)]
    i += 40
    rows += [(i, None, 0), (i + 1, [], 0), (i + 2, [0.0] * 20, 0), (i + 3, [float("nan")] * 20, 0), (i + 4, [None] * 20, 0), (i + 5, rows[0][1], None), (i + 6, [float("inf")] + [1.0] * 19, 0), (i + 7, [1.0, 2.0], 0), (i + 8, [2.0, 4.0], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    want = brute([(a, None if e is None else [x if x is None else float(np.float32(x)) for x in e], lab) for a, e, lab in rows])
    for cells, chunk in ((512, 1024), (4, 8)):
        got = near_duplicates(df, cell_rows=cells, chunk_rows=chunk).collect()
        assert len(got) == len(rows)
        assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == want
        assert all(x["kept"] == (x["vec_id"] == x["component_id"]) for x in got)
    assert near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("chunks", [2, 3, 4, 5, 8])
def test_each_pair_of_chunks_meets_once(spark, chunks):
    rows = spark.range(chunks).select(F.col("id").cast("int").alias("own"), F.lit(chunks).alias("chunks"))
    met = []
    for apart in range(chunks // 2 + 1):
        groups = rows.withColumn("c", F.explode(embedding_dedup._groups(F.col("own"), F.col("chunks"), apart))).groupBy("c").agg(F.sort_array(F.collect_list("own")).alias("g"))
        met += [tuple(r["g"]) for r in groups.collect()]
        assert all(r["c"] in r["g"] for r in groups.collect())
    assert sorted(met) == sorted([(a,) for a in range(chunks)] + [(a, b) for a in range(chunks) for b in range(a + 1, chunks)])


def test_empty_chunks(spark):
    """Eight classes in eight chunks by hash: some are empty, some hold several."""
    rows = [(i, [1.0, 0.01 * i, 0.0], 0) for i in range(8)]
    got = near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"), chunk_rows=1).collect()
    assert {x["vec_id"]: (x["n_links"], x["component_id"]) for x in got} == brute(rows)


def test_rows_written_grow_with_the_vectors(spark, monkeypatch):
    """Nothing but the classes holds vectors, and nothing is written for a vector's visits to cells or for pairs of chunks without links."""
    wrote, held = {}, []

    def counted(df, label, *more, write=embedding_dedup.materialize):
        out = write(df, label, *more)
        wrote[label] = wrote.get(label, 0) + out.count()
        held.extend(label for kind in out.dtypes if kind[1].startswith("array"))
        return out

    monkeypatch.setattr(embedding_dedup, "materialize", counted)
    r = np.random.default_rng(5)
    rows = [(i, r.standard_normal(32).astype(np.float32).tolist(), 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    assert near_duplicates(df, cell_rows=8, chunk_rows=500).where("n_links = 0 AND kept").count() == 2000
    assert held == ["vector-classes"] and sum(wrote.values()) <= 2 * len(rows) + 1, wrote
