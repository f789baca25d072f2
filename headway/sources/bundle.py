"""The tables that a live feed serves from, as one version: written under a manifest, refused where they don't belong together."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from headway.models.trees import NUMERIC, score_trees
from headway.operators.serving import served_vector, with_bias

#: What :meth:`Bundle.serve` needs; other tables may come along.
SERVED = ("trees", "model", "priors", "codes", "bias", "stops", "lengths")
MANIFEST = "name string, n_rows long, digest string, schema string, version string, bundle string, fingerprint string, model_since string"


class MixedBundle(ValueError):
    """Tables are missing or aren't those that the manifest names."""


def table_digest(table: DataFrame) -> tuple[int, str]:
    """Rows, and a digest of the rows as a bag: no order of rows, columns or partitions changes it, a repeated row does.

    Each row's SHA-256 is added up in four parts of 60 bits, so that partitions need to hand on four sums only.
    """
    names = sorted(table.columns)
    options = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "timeZone": "UTC"}
    row = F.sha2(F.to_json(F.struct(*(F.col(f"`{c}`") for c in names)), options), 256)
    parts = [F.sum(F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(28,0)")).alias(f"s{i}") for i in range(4)]
    n, *sums = table.select(row.alias("h")).agg(F.count("*"), *parts).first()
    return n, hashlib.sha256(json.dumps([n, _schema(table), [str(s) for s in sums]]).encode()).hexdigest()


def _schema(table: DataFrame) -> str:
    return json.dumps(sorted((f.name, f.dataType.simpleString()) for f in table.schema.fields))


def _joint(rows: list[tuple[str, str]]) -> str:
    return hashlib.sha256(json.dumps(sorted(rows)).encode()).hexdigest()


def model_tables(spark: SparkSession, trees: list[list[tuple]], baseline: float, columns: tuple[str, ...] = NUMERIC) -> dict[str, DataFrame]:
    """An ensemble as tables: a row a node, and a row with the baseline and the inputs in their order."""
    nodes = [(t, i, int(f), float(at), int(left), int(right), bool(leaf), float(v)) for t, tree in enumerate(trees) for i, (f, at, left, right, leaf, v) in enumerate(tree)]
    return {
        "trees": spark.createDataFrame(nodes, "tree int, node int, feature int, threshold double, left int, right int, is_leaf boolean, value double"),
        "model": spark.createDataFrame([(float(baseline), list(columns), len(trees))], "baseline double, columns array<string>, n_trees int"),
    }


def model_of(tables: dict[str, DataFrame]) -> tuple[list[list[tuple]], float, tuple[str, ...]]:
    """What :func:`model_tables` was given; a model is of fixed size, so the driver holds it."""
    head = tables["model"].first()
    trees: list[list[tuple]] = [[] for _ in range(head["n_trees"])]
    for r in tables["trees"].orderBy("tree", "node").collect():
        trees[r["tree"]].append((r["feature"], r["threshold"], r["left"], r["right"], r["is_leaf"], r["value"]))
    return trees, head["baseline"], tuple(head["columns"])


def model_since(before: str | None, fingerprint_before: str | None, fingerprint: str, today: date) -> str:
    """The day from which reports tell of this model: kept over an export of the same trees, today for others."""
    return before if before and fingerprint == fingerprint_before else today.isoformat()


@dataclass
class Bundle:
    """One version's tables, read and checked. ``fingerprint`` is of the trees and the model alone."""

    version: str
    digest: str
    fingerprint: str | None
    model_since: str | None
    tables: dict[str, DataFrame]

    def serve(self, vehicles: DataFrame) -> DataFrame:
        """:func:`served_vector` of each vehicle with ``predicted, bias_sec`` and ``seconds``, the one less the other."""
        if missing := [t for t in SERVED if t not in self.tables]:
            raise MixedBundle(f"version {self.version} has no {', '.join(missing)}")
        t = self.tables
        trees, baseline, columns = model_of(t)
        rows = served_vector(vehicles, t["stops"], t["lengths"], t["priors"], t["codes"])
        scored = with_bias(score_trees(rows, trees, baseline, columns), t["bias"])
        return scored.withColumn("seconds", F.col("predicted") - F.col("bias_sec"))


def _manifest(spark: SparkSession, path: str, version: str) -> list | None:
    at = f"{path}/version={version}/manifest"
    context = spark.sparkContext
    done = context._jvm.org.apache.hadoop.fs.Path(f"{at}/_SUCCESS")
    if not done.getFileSystem(context._jsc.hadoopConfiguration()).exists(done):
        return None
    return spark.read.schema(MANIFEST).json(at).collect()  # a row a table


def versions(spark: SparkSession, path: str) -> list[str]:
    """Versions that were written to their end, in order of their names."""
    context = spark.sparkContext
    top = context._jvm.org.apache.hadoop.fs.Path(path)
    store = top.getFileSystem(context._jsc.hadoopConfiguration())
    found = store.globStatus(context._jvm.org.apache.hadoop.fs.Path(f"{path}/version=*/manifest/_SUCCESS"))
    return sorted(s.getPath().getParent().getParent().getName().removeprefix("version=") for s in found or [])


def write_bundle(spark: SparkSession, path: str, version: str, tables: dict[str, DataFrame], today: date) -> Bundle:
    """Writes ``tables`` as ``version``, the manifest last: until then no reader sees it, and a run that failed is repeated.

    A finished version never changes: the same tables again are no work, others are refused. ``model_since`` goes on from
    the version before where the trees are the same.
    """
    if "manifest" in tables or not tables:
        raise ValueError("a bundle needs tables, none of them named manifest")
    if _manifest(spark, path, version) is not None:
        old = read_bundle(spark, path, version)
        if {n: table_digest(t) for n, t in tables.items()} != {n: table_digest(t) for n, t in old.tables.items()}:
            raise MixedBundle(f"version {version} was written with other tables")
        return old
    found = []
    for name, table in tables.items():
        at = f"{path}/version={version}/{name}"
        table.write.mode("overwrite").parquet(at)
        stored = spark.read.schema(table.schema).parquet(at)
        found.append((name, *table_digest(stored), stored.schema.json()))
    digests = [(name, digest) for name, _, digest, _ in found]
    own = [x for x in digests if x[0] in ("trees", "model")]
    fingerprint = _joint(own) if len(own) == 2 else None
    since = None
    if fingerprint:
        before = [v for v in versions(spark, path) if v < version]
        last = _manifest(spark, path, before[-1])[0] if before else None
        since = model_since(last and last["model_since"], last and last["fingerprint"], fingerprint, today)
    rows = [(*x, version, _joint(digests), fingerprint, since) for x in found]
    spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").json(f"{path}/version={version}/manifest")
    return read_bundle(spark, path, version)


def read_bundle(spark: SparkSession, path: str, version: str | None = None, check: bool = True) -> Bundle:
    """A version, the last one unless it is named. Each table is read in full once to hold it against the manifest.

    ``check=False`` leaves that out, for what was just written.
    """
    if version is None:
        known = versions(spark, path)
        if not known:
            raise MixedBundle(f"no finished version in {path}")
        version = known[-1]
    rows = _manifest(spark, path, version)
    if not rows:
        raise MixedBundle(f"version {version} was not written to its end")
    if _joint([(r["name"], r["digest"]) for r in rows]) != rows[0]["bundle"] or len({(r["version"], r["bundle"]) for r in rows} | {(version, rows[0]["bundle"])}) > 1:
        raise MixedBundle(f"the manifest of version {version} is of several bundles")
    tables, wrong = {}, []
    for r in rows:
        try:
            table = spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).parquet(f"{path}/version={version}/{r['name']}")
        except AnalysisException:  # its folder is gone
            wrong.append(r["name"])
            continue
        if check and table_digest(table) != (r["n_rows"], r["digest"]):
            wrong.append(r["name"])
        tables[r["name"]] = table
    if wrong:
        raise MixedBundle(f"version {version} has other {', '.join(sorted(wrong))} than its manifest")
    return Bundle(version, rows[0]["bundle"], rows[0]["fingerprint"], rows[0]["model_since"], tables)
