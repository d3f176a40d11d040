"""Named feature groups on a wide matrix, and experiments planned from a schema.

``v_wide`` deals the four columns of ``v_flow`` to all canonical flow headers
(78 of the alias table, without the label), so the study's groups keep their
names and sizes. Queries select the columns of their groups; the scan prunes
the rest to the four source columns.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import feature_groups as FG
from flowlens.functions.names import FEATURE_ALIASES, canonical_name
from flowlens.operators import experiments as XP
from flowlens.operators import importance as IM
from flowlens.operators import metrics as M
from flowlens.operators import model as ML
from flowlens.operators import permutation as PM
from flowlens.operators import sampling as S
from flowlens.operators import sets as ST
from flowlens.plans import catalog as Q
from flowlens.plans import oracle as O
from flowlens.plans import views as V
from flowlens.plans.catalog import register
from flowlens.session import stored

WIDE_FEATURES = tuple(dict.fromkeys(c for c in FEATURE_ALIASES.values() if c != "label"))
#: The study's groups under canonical names; a repeated header counts once.
GROUPS = {g: tuple(dict.fromkeys(canonical_name(c) for c in cols)) for g, cols in FG.FEATURE_GROUPS.items()}
PACKET_LENGTH = tuple(canonical_name(c) for c in FG.PACKET_LENGTH_FEATURES)
SIZE_VOLUME_RATE_HEADER = tuple(dict.fromkeys(canonical_name(c) for c in FG.SIZE_VOLUME_RATE_HEADER_FEATURES))


def _dealt(j: int) -> str:
    """Column j of the wide matrix; the same text in Spark and DuckDB."""
    return f"value * {1 + j % 7}e0 + user_id * {j % 5}e0 + hour * {1 + j % 3}e0 + k * {j % 11}e0"


def v_wide(spark, sf_dir: str) -> DataFrame:
    flow = V.v_flow(spark, sf_dir)
    return flow.select("row_id", "dataset", "attack_family", "Label", *[F.expr(_dealt(j)).alias(c) for j, c in enumerate(WIDE_FEATURES)])


_WIDE_SQL = 'SELECT row_id, dataset, attack_family, "Label", ' + ", ".join(f"{_dealt(j)} AS {c}" for j, c in enumerate(WIDE_FEATURES)) + " FROM v_flow"


def _members(groups: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"('{g}', {len(cols)})" for g, cols in groups.items())


@register(
    "feature_group_sums",
    O.with_views(
        " UNION ALL ".join(
            f"""SELECT '{g}' AS "group", CAST({len(cols)} AS INTEGER) AS n_features, CAST(count(*) AS BIGINT) AS rows,
  CAST(sum(CASE WHEN {' + '.join(cols)} > 1000 THEN 1 ELSE 0 END) AS BIGINT) AS large FROM w"""
            for g, cols in GROUPS.items()
        ),
        "v_flow",
        ctes={"w": _WIDE_SQL},
    ),
)
def q_feature_group_sums(spark, sf_dir):
    """PRJ-16/17/19: members of each named group in the wide matrix, and rows on
    which they add up to much; one aggregate over one scan."""
    wide = v_wide(spark, sf_dir)
    groups = FG.present(wide.columns, GROUPS)
    large = {}
    for g, cols in groups.items():
        total = F.col(cols[0])
        for c in cols[1:]:
            total = total + F.col(c)
        large[g] = F.sum(F.when(total > 1000, 1).otherwise(0)).cast("bigint").alias(f"large_{g}")
    one = wide.agg(F.count(F.lit(1)).alias("rows"), *large.values())
    entries = [
        F.struct(F.lit(g).alias("group"), F.lit(len(cols)).alias("n_features"), F.col("rows").alias("rows"), F.col(f"large_{g}").alias("large"))
        for g, cols in groups.items()
    ]
    return one.select(F.inline(F.array(*entries)))


@register(
    "wide_group_permutation",
    O.with_views(
        " UNION ALL ".join(
            f"""SELECT m."group", '{f}' AS feature, t.row_id, t.{f} AS value, d.{f} AS permuted_value
FROM partner m JOIN pos t ON t.pos = m.x JOIN pos d ON d.pos = m.donor WHERE m."group" = '{g}'"""
            for g, cols in GROUPS.items()
            for f in cols
        ),
        "v_flow",
        ctes={
            "w": _WIDE_SQL,
            "pos": "SELECT *, row_number() OVER (ORDER BY md5('42|' || row_id)) - 1 AS pos, count(*) OVER () AS n FROM w",
            "draws": f"""SELECT "group", {O.draw_keys("'42|' || " + '"group"')} AS keys FROM (VALUES {_members(GROUPS)}) g("group", members)""",
            "lng": 'SELECT pos AS x, pos AS donor, n, "group", keys FROM pos, draws',
            **O.swap_or_not("lng"),
            "partner": 'SELECT x, donor, "group" FROM x8',
        },
        materialized=("pos", "draws", "partner"),
    ),
)
def q_wide_group_permutation(spark, sf_dir):
    """ML-14's nine groups: every group moves together."""
    return PM.group_permuted_long(v_wide(spark, sf_dir), GROUPS, "row_id").select("group", "feature", "row_id", "value", "permuted_value")


def _wide_split(spark, sf_dir):
    wide = v_wide(spark, sf_dir)
    split = stored(S.stratified_split(wide, S.choose_stratum(wide)), "wide-split")
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


@register("feature_ablation")
def q_feature_ablation(spark, sf_dir):
    """ML-7: all features against those without the two named ones."""
    train, test = Q._split_for_fits(v_wide(spark, sf_dir), WIDE_FEATURES)
    kept = tuple(FG.without(WIDE_FEATURES, FG.ABLATION_REMOVED))
    sweeps = [
        M.threshold_sweep(ML.score(Q._fit(train, names, laid_out=True), test)).select("dataset", "threshold", *Q._CMP_COLS) for names in (WIDE_FEATURES, kept)
    ]
    return ST.compare_on(*sweeps, ["dataset", "threshold"])


@register("group_ablation")
def q_group_ablation(spark, sf_dir):
    """ML-8: without the packet lengths, and without all sizes, volumes, rates and headers."""
    train, test = Q._split_for_fits(v_wide(spark, sf_dir), WIDE_FEATURES)
    out = None
    for name, removed in (("packet_length", PACKET_LENGTH), ("size_volume_rate_header", SIZE_VOLUME_RATE_HEADER)):
        kept = tuple(FG.without(WIDE_FEATURES, removed))
        m = M.binary_metrics(ML.score(Q._fit(train, kept, balanced=False, laid_out=True), test), extended=False)
        m = m.select(F.lit(name).alias("removed_group"), F.lit(len(kept)).alias("n_features"), *m.columns)
        out = m if out is None else out.unionByName(m)
    return out


@register("group_permutation_importance")
def q_group_permutation_importance(spark, sf_dir):
    """ML-14: nine groups over the whole test split."""
    train, test = _wide_split(spark, sf_dir)
    return IM.group_permutation_importance(Q._fit(train, WIDE_FEATURES), test, GROUPS, WIDE_FEATURES, "row_id")


# ------------------------------------------------- conditional experiments ----


@register(
    "experiment_plan",
    O.with_views(
        f"""SELECT 'wide' AS matrix, 'Baseline' AS experiment_name, {len(WIDE_FEATURES)} AS n_features, CAST(NULL AS VARCHAR) AS removed, n AS rows FROM c
UNION ALL SELECT 'wide', 'No Destination Port', {len(WIDE_FEATURES) - 1}, 'dst_port', n FROM c
UNION ALL SELECT 'narrow', 'Baseline', {len(V.FLOW_FEATURES)}, NULL, n FROM c""",
        "v_flow",
        ctes={"c": "SELECT CAST(count(*) AS BIGINT) AS n FROM v_flow"},
    ),
)
def q_experiment_plan(spark, sf_dir):
    """PRJ-18, ML-6: a matrix with a port column has two experiments, one
    without has the baseline only."""
    out = None
    for name, matrix in (("wide", v_wide(spark, sf_dir)), ("narrow", V.v_flow(spark, sf_dir))):
        features = [c for c in matrix.columns if c in (WIDE_FEATURES if name == "wide" else V.FLOW_FEATURES)]
        plan = XP.planned_experiments(features)
        entries = [
            F.struct(
                F.lit(name).alias("matrix"), F.lit(x).alias("experiment_name"), F.lit(len(kept)).alias("n_features"),
                F.lit(next((c for c in features if c not in kept), None)).cast("string").alias("removed"), F.col("n").alias("rows"),
            )
            for x, kept in plan.items()
        ]
        rows = matrix.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*entries)))
        out = rows if out is None else out.unionByName(rows)
    return out


@register("feature_experiments")
def q_feature_experiments(spark, sf_dir):
    """ML-6: the experiments planned from the wide matrix, by seeds."""
    train, test = Q._split_for_fits(v_wide(spark, sf_dir), WIDE_FEATURES)
    return XP.feature_experiments(train, test, XP.planned_experiments(WIDE_FEATURES), num_trees=Q._TREES, max_depth=Q._DEPTH, laid_out=True)
