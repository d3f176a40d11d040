"""Exact integer k-means by a bisector tournament (operator 11).

Vectors become integers, floor(256 * x). For centroids ``a < b`` the vectors
at least as near to ``a`` lie on one side of the plane that bisects them:
``|x - a|^2 <= |x - b|^2`` is the linear test ``2 (b - a) . x <= |b|^2 - |a|^2``.

1. *Table.* Integer normals ``2 (b - a)`` and thresholds ``|b|^2 - |a|^2`` of
   all centroid pairs are computed once a round.
2. *Tournament.* A vector's champion, at first centroid 0, meets centroids
   1, 2, ... in turn: k - 1 sign tests, each of which eliminates the loser. A
   test that comes out as zero keeps the champion, whose number is smaller.
3. *Distance.* Only the winner's squared distance is computed, exactly.
4. *Centroids.* Each task adds up its vectors by cluster as it assigns them and
   emits one row a cluster and batch; Spark adds those, and the driver takes
   floor(sum / count) of k rows with Python's integers.

Every product and sum is exact: matrices are float64 while all partial sums
are provably below 2**53, and int64 otherwise.

Scale: rows are never exchanged, so equal vectors, however many, stay where
they are read. The integer vectors are stored once in the shared folder and
scanned once a round; what moves is k rows a batch. The table of pairs is
bounded by ``MAX_TABLE`` bytes whatever the number of rows, and more centroids
are refused. The driver holds k centroids.

Defined cases: vectors that are null, have another number of components than
``dims`` or hold a null or non-finite component take no part and have no row in
the result; so do those with a component whose integer is ``MAX_COMPONENT`` or
more in magnitude (their distances would not fit a long). Repeated vectors,
ids and rows each count; null ids are clustered but are the last choice as
first centroids; equal ids start in the order of their vectors. With fewer than
k vectors there are as many centroids as vectors. Empty centroids stay where
they are. An empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.session import stored

SCALE = 256
DIMS = 64
#: Integer components below this keep every test of up to 2**8 dims in int64.
MAX_COMPONENT = 1 << 26
MAX_DIMS = 1 << 8
#: Bytes of the table of centroid pairs (normals, int64).
MAX_TABLE = 64 << 20
#: Rows a tournament works on at once.
BLOCK = 4096


def integer_components(col: str | Column, dims: int = DIMS) -> Column:
    """floor(256 * x) of each component as int; null if the vector takes no part."""
    c = F.col(col) if isinstance(col, str) else col
    whole = F.transform(c, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")))
    # comparisons with null are null, NaN is the largest double
    fine = F.forall(
        c,
        lambda x: F.coalesce(
            (F.lit(float(SCALE)) * x.cast("double") < float(MAX_COMPONENT)) & (F.lit(float(SCALE)) * x.cast("double") > -float(MAX_COMPONENT)),
            F.lit(False),
        ),
    )
    return F.when((F.size(c) == dims) & fine, F.transform(whole, lambda x: x.cast("int")))


class Bisectors:
    """Normals and thresholds of all pairs of the given integer centroids."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids = np.asarray(centroids, dtype=np.int64)
        k, dims = centroids.shape
        if k * k * dims * 8 > MAX_TABLE or dims > MAX_DIMS:
            raise ValueError(f"{k} centroids of {dims} components need a table of pairs above {MAX_TABLE} bytes")
        square = (centroids * centroids).sum(1)
        # normals[b, a] and thresholds[b, a] for a < b; the rest is unused
        self.normals = 2 * (centroids[:, None, :] - centroids[None, :, :])
        self.thresholds = square[:, None] - square[None, :]

    def _exact_in_floats(self, x: np.ndarray) -> bool:
        top = max(int(np.abs(x).max(initial=0)), int(np.abs(self.centroids).max(initial=0)), 1)
        return 8 * x.shape[1] * top * top < 2**53

    def winners(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of the nearest centroid, squared distance) of each row."""
        kind = np.float64 if self._exact_in_floats(x) else np.int64
        points = x.astype(kind)
        champion = np.zeros(len(x), dtype=np.int64)
        for challenger in range(1, len(self.centroids)):
            normals, thresholds = self.normals[challenger].astype(kind), self.thresholds[challenger].astype(kind)
            side = np.einsum("nd,nd->n", points, normals[champion]) - thresholds[champion]
            champion[side > 0] = challenger
        gap = x - self.centroids[champion]
        return champion, (gap * gap).sum(1)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """An Arrow list column without nulls as an int64 matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def _sums(vectors: DataFrame, centroids: np.ndarray) -> DataFrame:
    """cluster, n and the sums of its components, one row a cluster and batch."""
    told = vectors.sparkSession.sparkContext.broadcast(centroids)
    k, dims = centroids.shape

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Bisectors(told.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            total, count = np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
            x = _matrix(batch.column(0), dims)
            for lo in range(0, len(x), BLOCK):
                part = x[lo : lo + BLOCK]
                cluster, _ = table.winners(part)
                np.add.at(total, cluster, part)
                count += np.bincount(cluster, minlength=k)
            used = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array(used.astype(np.int32)), pa.array(count[used]), pa.array(list(total[used]), type=pa.list_(pa.int64()))],
                names=["cluster", "n", "total"],
            )

    return vectors.select("v").mapInArrow(assign, "cluster int, n bigint, total array<bigint>")


def next_centroids(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """One round: floor(sum / count) of each non-empty cluster."""
    exact = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"s{i}") for i in range(centroids.shape[1])]
    found = _sums(vectors, centroids).groupBy("cluster").agg(F.sum("n").alias("n"), *exact).collect()  # at most k rows
    new = centroids.copy()
    for row in found:
        new[row["cluster"]] = [int(row[f"s{i}"]) // row["n"] for i in range(centroids.shape[1])]
    return new


def centroid_digest(centroid: np.ndarray) -> str:
    return hashlib.sha256(",".join(str(int(c)) for c in centroid).encode()).hexdigest()


def first_centroids(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of ``<salt>:<id>``, in that order."""
    order = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.orderBy(order.asc_nulls_last(), "v").limit(k).select("v").collect()  # k rows
    return np.array([r["v"] for r in rows], dtype=np.int64)


def cluster(
    vectors: DataFrame, k: int = 40, rounds: int = 5, salt: str = "2", dims: int = DIMS, vec_id: str = "vec_id", embedding: str = "embedding"
) -> tuple[DataFrame, np.ndarray]:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 per
    vector; the final centroids, k rows at most)."""
    spark = vectors.sparkSession
    data = vectors.select(F.col(vec_id).alias("vec_id"), integer_components(embedding, dims).alias("v")).where(F.col("v").isNotNull())
    data = stored(data, "bisector-vectors")
    centroids = first_centroids(data, k, salt)
    if not len(centroids):
        empty = data.select("vec_id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance"))
        empty = empty.select("*", F.col("distance").alias("cluster_inertia"), F.col("distance").alias("inertia"), F.lit("").alias("centroid_sha256"))
        return empty, np.zeros((0, dims), dtype=np.int64)
    for _ in range(rounds):
        centroids = next_centroids(data, centroids)
    told = spark.sparkContext.broadcast(centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Bisectors(told.value)
        for batch in batches:
            x = _matrix(batch.column(1), dims)
            for lo in range(0, len(x), BLOCK):
                number, distance = table.winners(x[lo : lo + BLOCK])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, len(number)), pa.array(number.astype(np.int32)), pa.array(distance)],
                    names=["vec_id", "cluster", "distance"],
                )

    kind = dict(data.dtypes)["vec_id"]
    assigned = stored(data.mapInArrow(assign, f"vec_id {kind}, cluster int, distance bigint"), "bisector-assigned")
    spread = assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()  # at most k rows
    every = int(sum(r["s"] for r in spread))
    table = [(r["cluster"], int(r["s"]), every, centroid_digest(centroids[r["cluster"]])) for r in spread]
    summary = spark.createDataFrame(table, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    result = assigned.join(F.broadcast(summary), "cluster")  # k rows at most
    return result.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), centroids


def cluster_sql(k: int = 40, rounds: int = 5, salt: str = "2", dims: int = DIMS) -> str:
    """DuckDB SQL of the same result: every distance of every round, stated plainly."""
    far = "list_sum(list_transform(list_zip(d.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    steps = [
        f"""d AS MATERIALIZED (
  SELECT row_number() OVER () AS nr, vec_id, list_transform(embedding, lambda x: CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {dims})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) - 1 AS cluster, v FROM d
  QUALIFY row_number() OVER (ORDER BY sha256('{salt}:' || vec_id), v) <= {k})""",
    ]
    for r in range(rounds + 1):
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT d.nr, d.vec_id, d.v, min(struct_pack(far := {far}, cluster := c.cluster)) AS best FROM d, c{r} c GROUP BY ALL)""")
        if r < rounds:
            steps.append(f"""s{r} AS MATERIALIZED (
  SELECT cluster, list(floor_of ORDER BY i) AS v FROM (
    SELECT cluster, i, CAST((s - ((s % n) + n) % n) // n AS BIGINT) AS floor_of FROM (
      SELECT best.cluster AS cluster, i, sum(CAST(v[i] AS HUGEINT)) AS s, count(*) AS n
      FROM a{r}, range(1, {dims + 1}) AS t(i) GROUP BY ALL)) GROUP BY cluster)""")
            steps.append(f"""c{r + 1} AS MATERIALIZED (
  SELECT c{r}.cluster, coalesce(s{r}.v, c{r}.v) AS v FROM c{r} LEFT JOIN s{r} USING (cluster))""")
    return f"""WITH {", ".join(steps)}
SELECT vec_id, CAST(best.cluster AS INTEGER) AS cluster, CAST(best.far AS BIGINT) AS distance,
  CAST(sum(best.far) OVER (PARTITION BY best.cluster) AS BIGINT) AS cluster_inertia, CAST(sum(best.far) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} ON c{rounds}.cluster = best.cluster"""
