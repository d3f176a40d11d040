"""Registered queries of whole jobs: written shuffles, writes that count what
they write, guards that are part of the plan, saved models, and streaming jobs
that can be restarted. Each has DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.names import light_clean
from flowlens.operators import clean as C
from flowlens.operators import guards as G
from flowlens.operators import model as ML
from flowlens.operators import sampling as S
from flowlens.operators import sets as ST
from flowlens.plans import catalog as Q
from flowlens.plans import oracle as O
from flowlens.plans import studies as X
from flowlens.plans import views as V
from flowlens.plans.catalog import register
from flowlens.session import ensure_checkpoint_dir, read_table
from flowlens.sources import tables as T
from flowlens.streaming import flows as SF


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---------------------------------------------------------------- shuffle ----


@register(
    "global_shuffle",
    O.with_views(
        "SELECT CAST(row_number() OVER (ORDER BY md5('42|' || row_id)) - 1 AS BIGINT) AS position, row_id FROM v_flow", "v_flow"
    ),
)
def q_global_shuffle(spark, sf_dir):
    """WIN-9: flows written in a seeded order; positions from the files' metadata."""
    written = S.written_shuffle(V.v_flow(spark, sf_dir), _folder(spark, "shuffled"))
    return S.shuffle_positions(written).select("position", "row_id")


# ----------------------------------------------------------------- guards ----


@register(
    "required_classes",
    O.with_views(
        f"""SELECT attack_family, CAST(count(*) AS BIGINT) AS "count" FROM v_flow
WHERE attack_family IN {tuple(L.INCLUDED_FAMILIES)} GROUP BY 1""",
        "v_flow",
    ),
)
def q_required_classes(spark, sf_dir):
    """FLT-9: every family of the study must have rows."""
    return G.required_counts(V.v_flow(spark, sf_dir), "attack_family", L.INCLUDED_FAMILIES)


@register(
    "two_class_weights",
    """SELECT toxic, n AS "count", CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n) AS weight
FROM (SELECT toxic, CAST(count(*) AS BIGINT) AS n FROM labels WHERE toxic IS NOT NULL GROUP BY 1) c""",
)
def q_two_class_weights(spark, sf_dir):
    """FLT-10, AGG-25: balanced weights, refused with fewer than two classes."""
    return G.two_class_weights(read_table(spark, sf_dir, "labels"), "toxic")


@register(
    "strict_pairs",
    O.with_views(
        'SELECT f.row_id, f."Label", p.y_pred, p.attack_probability FROM v_flow f JOIN v_pred p ON f.row_id = p.row_id', "v_flow", "v_pred"
    ),
)
def q_strict_pairs(spark, sf_dir):
    """JN-2: flows beside their predictions; one without its partner ends the job."""
    flows = V.v_flow(spark, sf_dir).select("row_id", "Label")
    return ST.paired(flows, V.v_pred(spark, sf_dir).select("row_id", "y_pred", "attack_probability"), "row_id")


_STRICT = ("c_value", "c_user", "c_k", "c_sparse")


@register(
    "strict_numbers",
    O.with_views("SELECT source_row, " + ", ".join(f"{O.num(c)} AS {c}" for c in _STRICT) + " FROM v_raw", "v_raw"),
)
def q_strict_numbers(spark, sf_dir):
    """PRJ-11: cells that are given must be numbers, checked in the projection."""
    return C.coerce_columns(V.v_raw(spark, sf_dir), _STRICT, keep=("source_row",), strict=True)


@register("numeric_union", O.with_views("SELECT c_k, c_user, c_value, label, source_row, source_file FROM v_raw", "v_raw"))
def q_numeric_union(spark, sf_dir):
    """PRJ-5, PRJ-10, PRJ-13: legacy headers cleaned lightly, columns that are
    not numeric dropped, files united over their sorted common columns."""
    raw = V.v_raw(spark, sf_dir)
    named = raw.toDF(*[f" {c.upper().replace('_', ' ')} " for c in raw.columns])
    clean = named.toDF(*[light_clean(c, lower_underscore=True) for c in named.columns])
    parts = {}
    for i in range(8):
        part = clean.where(F.col("source_file") == f"part-{i}").drop("source_file", *(["c_sparse"] if i == 3 else []))
        parts[f"part-{i}"] = T.drop_non_numeric(part, [c for c in V.RAW_FEATURES if c in part.columns])
    ST.common_columns(list(parts.values()), sort=True, required=("label",))
    return ST.union_common(parts, sort=True)


# ---------------------------------------------------------- counted write ----


@register(
    "counted_write",
    O.with_views(
        """SELECT 'rows' AS counter, CAST(count(*) AS BIGINT) AS observed, CAST(count(*) AS BIGINT) AS stored FROM cl WHERE clean
UNION ALL SELECT attack_family, count(*), count(*) FROM cl WHERE clean GROUP BY 1
UNION ALL SELECT CASE WHEN attack_family = 'Benign' THEN 'class 0' ELSE 'class 1' END, count(*), count(*) FROM cl WHERE clean GROUP BY 1""",
        "v_raw",
        ctes=Q._PREP_CTES,
    ),
)
def q_counted_write(spark, sf_dir):
    """AGG-2, SRC-11: clean rows written; class and family table of the same
    pass (``observed``) beside those of the stored table (``stored``)."""
    data = Q._prepared(spark, sf_dir).data
    counters = {f: F.col("attack_family") == f for f in L.INCLUDED_FAMILIES}
    counters |= {f"class {k}": F.col("Label") == k for k in (0, 1)}
    table, seen = T.write_counted(data, _folder(spark, "counted"), counters)
    told = spark.createDataFrame(list(seen.items()), "counter string, observed bigint")
    names = F.array(F.lit("rows"), F.col("attack_family"), F.concat(F.lit("class "), F.col("Label")))
    again = table.select(F.explode(names).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("stored"))
    return told.where("observed > 0").join(again, "counter", "full")


# ------------------------------------------------------------ saved model ----


@register(
    "reloaded_model",
    O.with_views('SELECT row_id, "Label" AS y_true, 1 AS same FROM ts', "v_flow", ctes=X._TEST_ROWS),
)
def q_reloaded_model(spark, sf_dir):
    """SRC-16: the test rows scored by a forest that was saved and loaded; ``same``
    says that class and probability are those of the forest before."""
    train, test = Q._flow_split(spark, sf_dir)
    model = Q._fit(train)
    path = _folder(spark, "forest")
    ML.save_model(model, path)
    scored = ML.score(ML.load_model(path), test).select(
        "row_id", *V.FLOW_FEATURES, "Label", F.col("y_pred").alias("_class"), F.col("attack_probability").alias("_p")
    )
    same = (F.col("y_pred") == F.col("_class")) & (F.col("attack_probability") == F.col("_p"))
    return ML.score(model, scored).select("row_id", "y_true", F.when(same, 1).otherwise(0).alias("same"))


# -------------------------------------------------------- restartable jobs ----


@register(
    "stream_file_report",
    O.with_views(
        f"""SELECT source_file, CAST(count(*) AS BIGINT) AS rows_before, {O.count_if('keep')} AS rows_after_label_filter,
       {O.count_if(f'keep AND {X._STUDY_FINITE}')} AS rows_after_cleaning, {O.count_if(f'keep AND {X._STUDY_FINITE}')} AS rows_stored
FROM k GROUP BY 1""",
        "v_raw",
        ctes={n: Q._PREP_CTES[n] for n in ("lab", "k")},
    ),
)
def q_stream_file_report(spark, sf_dir):
    """STR-1 with AGG-3: arriving files are marked, stored by batch and reported
    by batch; the sums of the reports beside the stored clean rows of each file."""
    raw = V.v_raw(spark, sf_dir).select("source_file", "source_row", "label", *X._STUDY_FEATURES)
    base = _folder(spark, "reported-stream")
    raw.repartition(X._STREAM_FILES, "source_row").write.parquet(f"{base}/in")
    stream = SF.read_stream(spark, f"{base}/in", raw.schema)
    marked = SF.marked_rows(stream, X._STUDY_FEATURES, keep=("source_file", "source_row"))
    SF.drain_reported(marked, f"{base}/out", f"{base}/progress")
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    report = spark.read.parquet(f"{base}/out/report").groupBy("source_file").agg(
        total("rows_before"), total("rows_after_label_filter"), total("rows_after_cleaning")
    )
    rows = spark.read.parquet(f"{base}/out/rows").where("status = 'clean'")
    return report.join(rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("rows_stored")), "source_file", "left").fillna(0)


@register(
    "resumed_confusion",
    O.with_views(
        "SELECT dataset, attack_family, threshold, tn, fp, fn, tp FROM cf", "v_pred", ctes={"cf": Q._COUNTS_BY_THRESHOLD}
    ),
)
def q_resumed_confusion(spark, sf_dir):
    """STR-2: counters drained once, more files arrive, drained again with the
    same checkpoint; the newest values are those of all rows."""
    e = read_table(spark, sf_dir, "events")
    base = _folder(spark, "resumed")
    keys = ["dataset", "attack_family", "threshold"]
    for early in (True, False):
        e.where((F.crc32(F.col("event_id").cast("string")) % 2 == 0) == F.lit(early)).write.mode("append").parquet(f"{base}/in")
        counts = SF.running_threshold_counts(Q._pred_from_events(SF.read_stream(spark, f"{base}/in", e.schema)))
        SF.drain_updates(counts, f"{base}/out", f"{base}/progress")
    return SF.latest_values(spark, f"{base}/out", keys).select(*keys, "tn", "fp", "fn", "tp")
