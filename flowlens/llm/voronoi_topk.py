"""Exact inner-product top-k by a Voronoi kNN join (operator 8).

Vectors become integers, floor(1024 * x). A bounded set of pivots (the rows
with the smallest md5 of their id) splits the data into Voronoi cells.

1. *Summaries.* Each cell gets its row count, its radius (largest distance of
   a member from the pivot) and its largest norm, by one aggregate.
2. *Bounds.* For a query q and a cell with pivot p and radius r,
   ``<q,x> = <q,p> + <q,x-p> <= <q,p> + |q| r`` and ``<q,x> <= |q| max|x|``.
   A lower bound for the k-th best score comes from the query's exact scores
   against the pivots (they are rows themselves).
3. *Replication.* Queries are grouped with the pivots too (and a cell's
   queries in blocks); a data cell is sent to a query group only if the upper
   bound of one of its queries reaches that query's lower bound.
4. *Local solution.* A task gets one (query group, cell, slice) and solves it
   with a matrix product; the local lists of k are merged a window per
   query that keeps k rows on the map side already.

Any choice of pivots gives the same, exact result; they only decide how much
is replicated. Scores are integers: matrix products run in float64 while every
partial sum is provably below 2**53 and in int64 otherwise.

Scale: cells are cut into slices of at most about ``slice_rows`` rows, so a
cell that holds a third of all rows (one vector repeated) is many tasks; query
groups are cut into blocks of ``query_block``. Only pivots and their summaries
(at most ``max_pivots`` rows each) reach the driver.

Defined cases: vectors that are null or hold a null or non-finite component
take no part, neither as query nor as candidate; shorter vectors count as
padded with zeros; repeated ids are all candidates, but never for a query of
their own id, and a repeated query id is answered once for all its distinct
vectors' rows (one result list per distinct id, scores of its best vector);
ties go to the smaller vec_id; an empty table gives an empty result; extra
columns are ignored. Components must stay below 2**53 / 1024 in magnitude.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import cut

SCALE = 1024
MAX_PIVOTS = 256
ROWS_PER_PIVOT = 2048
SLICE_ROWS = 8192
QUERY_BLOCK = 4096


def integer_vector(col: str | Column) -> Column:
    """floor(1024 * x) of each component, null if the vector takes no part."""
    c = F.col(col) if isinstance(col, str) else col
    # every comparison with null is null and NaN is the largest double
    fine = F.forall(c, lambda x: F.coalesce(x.cast("double") < float("inf"), F.lit(False)) & (x.cast("double") > float("-inf")))
    return F.when(fine, F.transform(c, lambda x: F.floor(F.lit(float(SCALE)) * x.cast("double")).cast("bigint")))


def _matrix(vectors, width: int) -> np.ndarray:
    """Rows padded with zeros to ``width``, int64."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def _products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """a @ b.T exactly, as int64."""
    if a.size == 0 or b.size == 0:
        return np.zeros((len(a), len(b)), dtype=np.int64)
    bound = float(np.abs(a).max()) * float(np.abs(b).max()) * a.shape[1]
    if bound < 2**53:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    return a @ b.T


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Indices of the k best columns of one row: score down, id up."""
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        keep = np.flatnonzero(scores >= edge)
    else:
        keep = np.arange(len(scores))
    return keep[np.lexsort((ids[keep], -scores[keep]))][:k]


def exact_top_k(
    vectors: DataFrame,
    is_query: Column,
    k: int = 10,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
    max_pivots: int = MAX_PIVOTS,
    rows_per_pivot: int = ROWS_PER_PIVOT,
    slice_rows: int = SLICE_ROWS,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best rows for every query row."""
    spark = vectors.sparkSession
    data = vectors.select(
        F.col(vec_id).cast("bigint").alias("vec_id"), integer_vector(embedding).alias("v"), F.coalesce(is_query, F.lit(False)).alias("q")
    ).where(F.col("v").isNotNull() & F.col("vec_id").isNotNull())
    result = T.StructType(
        [T.StructField("query_id", T.LongType()), T.StructField("vec_id", T.LongType()), T.StructField("score", T.LongType())]
    )
    size = data.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n_pivots = max(2 * k, min(max_pivots, size["n"] // rows_per_pivot))
    # bounded: at most max_pivots rows (2k at least); any rows would do
    chosen = data.orderBy(F.md5(F.col("vec_id").cast("string")), "vec_id", "v").limit(n_pivots).collect()
    width = max(1, size["width"] or 0)
    if not chosen:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    pivots = _matrix([r["v"] for r in chosen], width)
    pivot_ids = np.array([r["vec_id"] for r in chosen], dtype=np.int64)
    _, keep = np.unique(pivots, axis=0, return_index=True)
    anchors = pivots[np.sort(keep)]  # cells: distinct pivots only
    shared = spark.sparkContext.broadcast((anchors, pivots, pivot_ids))

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centre = shared.value[0].astype(np.float64)
        for f in frames:
            if f.empty:
                continue
            m = _matrix(f["v"].tolist(), width).astype(np.float64)
            d = (m * m).sum(1)[:, None] - 2.0 * (m @ centre.T) + (centre * centre).sum(1)[None, :]
            cell = d.argmin(1)
            gap = np.sqrt(((m - centre[cell]) ** 2).sum(1))
            yield pd.DataFrame(
                {"vec_id": f["vec_id"], "v": f["v"], "q": f["q"], "cell": cell.astype(np.int32), "gap": gap, "norm": np.sqrt((m * m).sum(1))}
            )

    celled = cut(data.mapInPandas(assign, "vec_id bigint, v array<bigint>, q boolean, cell int, gap double, norm double"))
    found = {
        r["cell"]: r
        for r in celled.groupBy("cell")
        .agg(F.count(F.lit(1)).alias("n"), F.max("gap").alias("radius"), F.max("norm").alias("norm"), F.sum(F.col("q").cast("int")).alias("nq"))
        .collect()  # one row per pivot
    }
    cells = np.array(sorted(found), dtype=np.int64)
    radius = np.array([found[c]["radius"] for c in cells])
    norms = np.array([found[c]["norm"] for c in cells])
    bounds = spark.sparkContext.broadcast((cells, radius, norms))
    blocks = max(1, -(-int(sum(r["nq"] for r in found.values())) // query_block))

    def needed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Cells each query must see, from the summaries."""
        anchors, pivots, ids = shared.value
        cells, radius, norms = bounds.value
        for f in frames:
            if f.empty:
                continue
            m = _matrix(f["v"].tolist(), width)
            exact = _products(m, pivots)
            own = f["vec_id"].to_numpy()[:, None] == ids[None, :]
            lists = []
            size = np.sqrt((m.astype(np.float64) ** 2).sum(1))
            upper = np.minimum(
                m.astype(np.float64) @ anchors[cells].astype(np.float64).T + size[:, None] * radius[None, :], size[:, None] * norms[None, :]
            )
            for i in range(len(m)):
                seen = np.sort(exact[i][~own[i]])
                least = float(seen[-k]) if len(seen) >= k else -np.inf
                slack = 1e-6 * (1.0 + abs(least)) + 1e-9 * size[i] * size[i]
                lists.append(cells[upper[i] + slack >= least].astype(np.int32).tolist())
            yield pd.DataFrame({"vec_id": f["vec_id"], "v": f["v"], "cell": f["cell"], "need": lists})

    asks = celled.where("q").select("vec_id", "v", "cell").distinct()
    asks = asks.mapInPandas(needed, "vec_id bigint, v array<bigint>, cell int, need array<int>")
    # query group: the query's own cell, folded to as many groups as there are blocks
    asks = asks.withColumn("grp", F.pmod(F.xxhash64("cell", F.pmod(F.xxhash64("vec_id"), F.lit(blocks))), F.lit(blocks)).cast("int"))
    asks = asks.select("vec_id", "v", "grp", F.explode("need").alias("cell"))
    slices = spark.createDataFrame([(int(c), max(1, -(-int(found[c]["n"]) // slice_rows))) for c in cells], "cell int, slices int")
    slices = F.broadcast(slices)  # one row per pivot
    pairs = asks.select("grp", "cell").distinct()
    sent = (
        celled.select("vec_id", "v", "cell")
        .join(slices, "cell")
        .join(pairs, "cell")
        .withColumn("slice", F.pmod(F.xxhash64("vec_id", "v"), F.col("slices")).cast("int"))
        .select("grp", "cell", "slice", "vec_id", "v")
    )
    asked = (
        asks.join(slices, "cell")
        .withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)))
        .select("grp", "cell", "slice", "vec_id", "v")
    )

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        q, x = _matrix(left["v"].tolist(), width), _matrix(right["v"].tolist(), width)
        qid, ids = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        out = []
        for lo in range(0, len(q), 256):
            part = _products(q[lo : lo + 256], x)
            for i in range(len(part)):
                other = np.flatnonzero(ids != qid[lo + i])
                best = other[_best(part[i][other], ids[other], k)]
                out.append((np.full(len(best), qid[lo + i]), ids[best], part[i][best]))
        a, b, c = (np.concatenate(z) for z in zip(*out))
        return pd.DataFrame({"query_id": a, "vec_id": b, "score": c})

    key = ["grp", "cell", "slice"]
    sent = sent.select(*[F.col(c).alias(f"to_{c}") for c in key], F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))
    local = asked.groupBy(*key).cogroup(sent.groupBy(*[f"to_{c}" for c in key])).applyInPandas(solve, result)
    # each task gives at most k rows a query; the window keeps k on the map side
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
