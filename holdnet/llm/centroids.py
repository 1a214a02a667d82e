"""Centroid clustering by dimension-sharded Lloyd rounds in exact integers.

Vectors of ``dim`` components become integers floor(scale * x) and are cut into
column blocks of ``width`` components.  The blocks are written once, one folder a
block, bucketed by row, so that later joins on the row move only small columns.  A
round is two Spark jobs:

1. tasks of a column block compute the exact partial squared distances of their
   rows to their slice of the centroids; a reduce by row adds the blocks and takes
   the nearest centroid (ties: the smaller number); the assignments are written,
   bucketed like the blocks;
2. the blocks join the assignments in place and each adds its components per
   cluster; its slice of a centroid becomes floor(sum / count), an empty
   cluster keeps its slice.

No task ever holds more of the centroids than a block's slice.  What reaches the
driver is k x dim centroid components a round and k sums at the end; k and dim
are parameters.

Defined results: vectors that are null, have another length, or hold null or
non-finite entries are left out; rows are clustered one by one, so repeated rows
and repeated or null ids repeat.  With fewer than k rows there is one cluster per row;
an empty table gives an empty result.  Rows with equal digests (repeated ids) seed in order of their components; null ids seed
last.  Columns other than the id and the vector are ignored, whatever their names.
Integers of 2^26 and more are refused (ArithmeticError), as squared distances
would not fit into 64 bits.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from holdnet.llm.common import shared_folder

DIM, SCALE, CLUSTERS, ROUNDS = 64, 1024, 8, 10
#: Components of a column block.
WIDTH = 16
#: Rows of a block whose distances are computed at a time.
SLICE_ROWS = 8192
#: Bytes of components in a bucket, while there are no more buckets than shuffle partitions.
BUCKET_BYTES = 4 << 20
LARGEST = 1 << 26


@dataclass
class Clustering:
    """Final centroids (k x dim integers) and the assignments, one row per vector: ``id, cluster, distance``."""

    centroids: np.ndarray
    assigned: DataFrame


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", dim: int = DIM,
                    scale: int = SCALE) -> DataFrame:
    """``id, x``: floor(scale * component) as integers, of the vectors of ``dim`` finite components."""
    v = F.col(vector).cast("array<double>")
    kept = df.select(F.col(id_col).alias("id"), v.alias("v")).filter(F.col("v").isNotNull() & (F.size("v") == dim)).filter(
        F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))))
    too_large = F.raise_error(F.lit(f"a scaled component of {LARGEST} or more")).cast("int")
    return kept.select("id", F.transform("v", lambda c: F.when(
        F.abs(c * scale) < LARGEST, F.floor(c * scale).cast("int")).otherwise(too_large)).alias("x"))


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """Components of the k vectors with the smallest sha256 of ``<salt>:<id>``, in ascending order of it."""
    key = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")), 256)
    first = vectors.select(key.alias("key"), "x").orderBy(F.col("key").asc_nulls_last(), "x").limit(k).collect()
    return np.array([r["x"] for r in first], dtype=np.int64)


def _flat(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


class _Shards:
    """The column blocks as one external table of the session, dropped at the end (its files stay in the shared folder)."""

    def __init__(self, vectors: DataFrame, width: int):
        self.spark, self.width = vectors.sparkSession, width
        self.tables: list[str] = []
        self.base = shared_folder(self.spark, "centroids")
        vectors.withColumn("row", F.monotonically_increasing_id()).write.parquet(f"{self.base}/rows")
        self.rows = self.spark.read.parquet(f"{self.base}/rows")

    def write(self, df: DataFrame, label: str, parts: list[str] | None = None) -> str:
        """Write a table bucketed by row; its name."""
        name = f"centroids_{label}_{uuid.uuid4().hex[:12]}"
        out = df.write.bucketBy(self.buckets, "row").option("path", f"{self.base}/{name}")
        (out.partitionBy(*parts) if parts else out).saveAsTable(name)
        self.tables.append(name)
        return name

    def cut(self, dim: int) -> None:
        if 4 * LARGEST * LARGEST * dim >= 1 << 63:
            raise ValueError(f"squared distances of {dim} components do not fit into 64 bits")
        self.starts = list(range(0, dim, self.width))
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self.buckets = max(1, min(most, self.rows.count() * dim * 4 // BUCKET_BYTES + 1))
        block = F.explode(F.array(*[F.struct(F.lit(b).alias("block"), F.slice("x", s + 1, self.width).alias("part"))
                                    for b, s in enumerate(self.starts)])).alias("b")
        blocks = self.rows.select("row", block).select("row", "b.*")
        self.table = self.write(blocks.repartition(self.buckets, "row"), "blocks", ["block"])

    def block(self, b: int) -> DataFrame:
        return self.spark.table(self.table).filter(F.col("block") == b).select("row", "part")

    def drop(self) -> None:
        for name in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _partial(piece: np.ndarray):
    """Arrow function: rows of a block -> their partial squared distances to a slice of the centroids."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, SLICE_ROWS):
                batch = whole.slice(lo, SLICE_ROWS)
                x = _flat(batch.column("part"), piece.shape[1])
                cols = [pa.array(np.einsum("ij,ij->i", x - c, x - c), pa.int64()) for c in piece]
                yield pa.RecordBatch.from_arrays([batch.column("row"), *cols], names=["row", *[f"d{j}" for j in range(len(piece))]])
    return run


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def _assign(shards: _Shards, centroids: np.ndarray, label: str) -> str:
    """Name of the table ``row, cluster, distance`` of every vector's nearest centroid."""
    k = len(centroids)
    names = [f"d{j}" for j in range(k)]
    schema = "row long, " + ", ".join(f"{d} long" for d in names)
    parts = [shards.block(b).mapInArrow(_partial(centroids[:, s:s + shards.width]), schema) for b, s in enumerate(shards.starts)]
    whole = _union(parts).groupBy("row").agg(*[F.sum(d).alias(d) for d in names])
    least = F.least(*names) if k > 1 else F.col("d0")
    nearest = whole.select("row", F.array_position(F.array(*names), least).cast("int").alias("at"), least.alias("distance"))
    return shards.write(nearest.select("row", (F.col("at") - 1).alias("cluster"), "distance"), label)


def _update(shards: _Shards, centroids: np.ndarray, assigned: str) -> np.ndarray:
    """Every block's slice of the centroids: floor of the mean of its cluster's components, empty clusters as they were."""
    labels = shards.spark.table(assigned).select("row", "cluster")
    joined = shards.spark.table(shards.table).join(labels, "row")  # both bucketed by row: nothing moves
    n = F.count(F.lit(1)).alias("n")
    sums = joined.groupBy("block", "cluster").agg(n, *[F.sum(F.get("part", F.lit(i))).alias(f"s{i}") for i in range(shards.width)])
    means = sums.select("block", "cluster", *[F.expr(f"(s{i} - pmod(s{i}, n)) div n").alias(f"s{i}") for i in range(shards.width)])
    new = centroids.copy()
    for r in means.collect():  # at most k x blocks rows
        start = shards.starts[r["block"]]
        size = min(shards.width, new.shape[1] - start)
        new[r["cluster"], start:start + size] = [r[f"s{i}"] for i in range(size)]
    return new


def cluster(vectors: DataFrame, k: int = CLUSTERS, rounds: int = ROUNDS, salt: str = "3", width: int = WIDTH) -> Clustering:
    """Lloyd's rounds over a table ``id, x`` of integer vectors of one length (see :func:`integer_vectors`)."""
    spark = vectors.sparkSession
    shards = _Shards(vectors, width)
    centroids = seeds(shards.rows, k, salt)
    kind = dict(vectors.dtypes)["id"]
    if not len(centroids):
        return Clustering(centroids, spark.createDataFrame([], f"id {kind}, cluster int, distance long"))
    try:
        shards.cut(centroids.shape[1])
        for r in range(rounds):
            centroids = _update(shards, centroids, _assign(shards, centroids, f"round{r}"))
        last = _assign(shards, centroids, "last")
        out = f"{shards.base}/assigned"
        shards.rows.select("row", "id").join(spark.table(last), "row").select("id", "cluster", "distance").write.parquet(out)
    finally:
        shards.drop()
    return Clustering(centroids, spark.read.schema(f"id {kind}, cluster int, distance long").parquet(out))


def _pick(values: list[Column]) -> Column:
    """The cluster's entry of a list of k literals."""
    return F.element_at(F.array(*values), F.col("cluster") + 1)


def report(found: Clustering) -> DataFrame:
    """Per vector ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``."""
    k = len(found.centroids)
    names = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not k:
        return found.assigned.select(F.col("id").alias("vec_id"), "cluster", "distance", F.lit(0).cast("long").alias("cluster_inertia"),
                                     F.lit(0).cast("long").alias("inertia"), F.lit("").alias("centroid_sha256")).select(*names)
    sums = {r["cluster"]: int(r["s"]) for r in found.assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # at most k rows
    inertia = [sums.get(j, 0) for j in range(k)]
    digests = [hashlib.sha256(",".join(map(str, c.tolist())).encode()).hexdigest() for c in found.centroids]
    return found.assigned.select(
        F.col("id").alias("vec_id"), "cluster", "distance", _pick([F.lit(s).cast("long") for s in inertia]).alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("long").alias("inertia"), _pick([F.lit(d) for d in digests]).alias("centroid_sha256"))
