"""Registered queries of whole studies, each with DuckDB SQL.

* A fixed forest (three small trees, stated as node tables) is scored,
  evaluated, permuted and attributed over whole tables; the SQL states the same
  trees, and their Shapley values in closed form.
* Queries over trained forests return what does not depend on the fit: which
  rows were scored, the sizes and class totals behind every metric, whether
  probabilities and attributions are consistent.
* Source queries write a given table to the shared folder in the study's file
  forms and read it back.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.numeric import coerce_number, is_finite
from flowlens.operators import attribution as AT
from flowlens.operators import clean as C
from flowlens.operators import distributions as D
from flowlens.operators import examples as X
from flowlens.operators import experiments as XP
from flowlens.operators import importance as IM
from flowlens.operators import metrics as M
from flowlens.operators import model as ML
from flowlens.operators import profile as P
from flowlens.operators import sampling as S
from flowlens.plans import catalog as Q
from flowlens.plans import oracle as O
from flowlens.plans import views as V
from flowlens.plans.catalog import register
from flowlens.session import ensure_checkpoint_dir, stored
from flowlens.sources import flow_csv as FC
from flowlens.sources import tables as T
from flowlens.streaming import flows as SF

FEATURES = V.FLOW_FEATURES  # value, user_id, hour, k


def _folder(spark, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ------------------------------------------------------------ fixed forest ----


def _tree(*nodes) -> AT.PackedTree:
    """Nodes (left, right, feature, threshold, value, cover) in id order."""
    left, right, feature, threshold, value, cover = (np.array(c) for c in zip(*nodes))
    return AT.PackedTree(left, right, feature, threshold.astype(float), value.astype(float), cover.astype(float))


FIXED_FOREST = [
    # value <= 100: 0.9, else hour <= 12: 0.2, else 0.6
    _tree((1, 2, 0, 100, 0.49, 100), (-1, -1, -1, 0, 0.9, 30), (3, 4, 2, 12, 0.22 / 0.7, 70), (-1, -1, -1, 0, 0.2, 50), (-1, -1, -1, 0, 0.6, 20)),
    # hour <= 6: 0.7, else user_id <= 70: 0.3, else 0.45
    _tree((1, 2, 2, 6, 0.445, 100), (-1, -1, -1, 0, 0.7, 25), (3, 4, 1, 70, 0.36, 75), (-1, -1, -1, 0, 0.3, 45), (-1, -1, -1, 0, 0.45, 30)),
    # k <= 9: 0.25, else 0.8
    _tree((1, 2, 3, 9, 0.525, 100), (-1, -1, -1, 0, 0.25, 50), (-1, -1, -1, 0, 0.8, 50)),
]

_T1 = "CASE WHEN value <= 100 THEN 0.9e0 WHEN hour <= 12 THEN 0.2e0 ELSE 0.6e0 END"
_T2 = "CASE WHEN hour <= 6 THEN 0.7e0 WHEN user_id <= 70 THEN 0.3e0 ELSE 0.45e0 END"
_T3 = "CASE WHEN k <= 9 THEN 0.25e0 ELSE 0.8e0 END"
_FF_CTES = {
    "ff": f"""SELECT *, "Label" AS y_true, ({_T1} + {_T2} + {_T3}) / 3e0 AS attack_probability FROM v_flow""",
    "fs": "SELECT *, CAST(CASE WHEN attack_probability > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS y_pred FROM ff",
}


def _fixed_scored(spark, sf_dir):
    return ML.score(AT.probability_of(FIXED_FOREST, FEATURES), V.v_flow(spark, sf_dir))


@register(
    "fixed_forest_score",
    O.with_views("SELECT row_id, dataset, y_true, y_pred, round(attack_probability, 12) AS attack_probability FROM fs", "v_flow", ctes=_FF_CTES),
)
def q_fixed_forest_score(spark, sf_dir):
    return _fixed_scored(spark, sf_dir).select("row_id", "dataset", "y_true", "y_pred", F.round("attack_probability", 12).alias("attack_probability"))


_FF_COUNTS = f"""SELECT dataset, {O.count_if('y_true = 0 AND y_pred = 0')} AS tn, {O.count_if('y_true = 0 AND y_pred = 1')} AS fp,
         {O.count_if('y_true = 1 AND y_pred = 0')} AS fn, {O.count_if('y_true = 1 AND y_pred = 1')} AS tp FROM fs GROUP BY dataset"""


@register(
    "fixed_forest_evaluation",
    O.with_views(
        f"""SELECT dataset, samples, tn, fp, fn, tp, accuracy, precision, recall, f1_score, specificity, balanced_accuracy
FROM ({O.metrics_from('c', 'dataset')}) m""",
        "v_flow",
        ctes={**_FF_CTES, "c": _FF_COUNTS},
    ),
)
def q_fixed_forest_evaluation(spark, sf_dir):
    return M.binary_metrics(_fixed_scored(spark, sf_dir), ["dataset"]).select(
        "dataset", "samples", "tn", "fp", "fn", "tp", "accuracy", "precision", "recall", "f1_score", "specificity", "balanced_accuracy"
    )


_FF_FAMILY = f"""SELECT dataset, attack_family, CAST(count(*) AS BIGINT) AS samples, {O.count_if('y_true = 1 AND y_pred = 0')} AS false_negatives,
       {O.count_if('y_true = 0 AND y_pred = 1')} AS false_positives FROM fs GROUP BY 1, 2"""


@register("fixed_forest_families", O.with_views(_FF_FAMILY, "v_flow", ctes=_FF_CTES))
def q_fixed_forest_families(spark, sf_dir):
    stats = None
    scored = _fixed_scored(spark, sf_dir)
    for name in ("internal", "external"):
        part = M.family_stats(scored.where(F.col("dataset") == name)).withColumn("dataset", F.lit(name))
        stats = part if stats is None else stats.unionByName(part)
    return stats.select("dataset", "attack_family", "samples", "false_negatives", "false_positives")


_V1 = "CASE WHEN value <= 100 THEN 0.9e0 ELSE 0.22e0 / 0.7e0 END"
_H1 = "0.27e0 + 0.7e0 * CASE WHEN hour <= 12 THEN 0.2e0 ELSE 0.6e0 END"
_H2 = "CASE WHEN hour <= 6 THEN 0.7e0 ELSE 0.36e0 END"
_U2 = "0.175e0 + 0.75e0 * CASE WHEN user_id <= 70 THEN 0.3e0 ELSE 0.45e0 END"


def _shapley(own: str, other: str, none: str, both: str) -> str:
    return f"(({own}) - {none} + ({both}) - ({other})) / 2"


_PHI = {
    "value": f"{_shapley(_V1, _H1, '0.49e0', _T1)} / 3",
    "user_id": f"{_shapley(_U2, _H2, '0.445e0', _T2)} / 3",
    "hour": f"({_shapley(_H1, _V1, '0.49e0', _T1)} + {_shapley(_H2, _U2, '0.445e0', _T2)}) / 3",
    "k": f"({_T3} - 0.525e0) / 3",
}
_PHI_LONG = "\nUNION ALL ".join(
    f"SELECT row_id, dataset, attack_family, '{f}' AS feature, {f} AS feature_value, {sql} AS shap_value FROM v_flow" for f, sql in _PHI.items()
)


def _fixed_long(spark, sf_dir):
    return AT.attribution_long(spark, FIXED_FOREST, V.v_flow(spark, sf_dir), FEATURES, "row_id", keep=("dataset", "attack_family"))


@register(
    "fixed_forest_attribution",
    O.with_views("SELECT row_id, feature, feature_value, round(shap_value, 9) + 0e0 AS shap_value FROM ph", "v_flow", ctes={"ph": _PHI_LONG}),
)
def q_fixed_forest_attribution(spark, sf_dir):
    return _fixed_long(spark, sf_dir).select("row_id", "feature", "feature_value", (F.round("shap_value", 9) + F.lit(0.0)).alias("shap_value"))


@register(
    "fixed_forest_mean_attribution",
    O.with_views("SELECT feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap FROM ph GROUP BY 1", "v_flow", ctes={"ph": _PHI_LONG}),
)
def q_fixed_forest_mean_attribution(spark, sf_dir):
    return AT.mean_abs_by_feature(_fixed_long(spark, sf_dir)).select("feature", F.round("mean_abs_shap", 6).alias("mean_abs_shap"))


@register(
    "fixed_forest_family_attribution",
    O.with_views(
        """SELECT dataset, attack_family, feature, round(avg(abs(shap_value)), 6) AS mean_abs_shap, CAST(count(*) AS BIGINT) AS samples
FROM ph GROUP BY 1, 2, 3""",
        "v_flow",
        ctes={"ph": _PHI_LONG},
    ),
)
def q_fixed_forest_family_attribution(spark, sf_dir):
    table = AT.mean_abs_by_group(_fixed_long(spark, sf_dir), ["dataset", "attack_family"], "row_id")
    return table.withColumn("mean_abs_shap", F.round("mean_abs_shap", 6))


@register(
    "fixed_forest_dependence",
    O.with_views(
        """SELECT feature, feature_value AS x, round(shap_value, 9) + 0e0 AS shap_value FROM ph
WHERE feature = 'user_id' OR feature = (SELECT feature FROM ph GROUP BY 1 ORDER BY avg(abs(shap_value)) DESC, feature LIMIT 1)""",
        "v_flow",
        ctes={"ph": _PHI_LONG},
    ),
)
def q_fixed_forest_dependence(spark, sf_dir):
    """The best feature and a named one (the study's port)."""
    data = AT.dependence_data(stored(_fixed_long(spark, sf_dir), "attribution"), 1, always=("user_id",))
    return data.select("feature", "x", (F.round("shap_value", 9) + F.lit(0.0)).alias("shap_value"))


_LOCAL_CTES = {
    **_FF_CTES,
    "ph": _PHI_LONG,
    "ex": """SELECT dataset, row_id, example FROM (
  SELECT dataset, row_id, 'attack' AS example, row_number() OVER (PARTITION BY dataset ORDER BY
         CAST(y_true = y_pred AS INTEGER) DESC, attack_probability DESC, row_id) AS r FROM fs WHERE y_true = 1
  UNION ALL SELECT dataset, row_id, 'benign', row_number() OVER (PARTITION BY dataset ORDER BY
         CAST(y_true = y_pred AS INTEGER) DESC, attack_probability, row_id) FROM fs WHERE y_true = 0) e WHERE r = 1""",
}


@register(
    "fixed_forest_local_examples",
    O.with_views(
        """SELECT ex.dataset, ex.example, ph.row_id, ph.feature, ph.feature_value, round(ph.shap_value, 9) + 0e0 AS shap_value,
       round((0.49e0 + 0.445e0 + 0.525e0) / 3, 9) AS base_value FROM ph JOIN ex ON ph.row_id = ex.row_id""",
        "v_flow",
        ctes=_LOCAL_CTES,
    ),
)
def q_fixed_forest_local_examples(spark, sf_dir):
    chosen = X.extreme_examples(_fixed_scored(spark, sf_dir), prefer_correct=True).select("row_id", "dataset", "example")
    rows = V.v_flow(spark, sf_dir).join(chosen.select("row_id"), "row_id")
    long = AT.attribution_long(spark, FIXED_FOREST, rows, FEATURES, "row_id")
    local = AT.local_explanations(long, chosen, "row_id", AT.expected_value(FIXED_FOREST))
    return local.select(
        "dataset", "example", "row_id", "feature", "feature_value", (F.round("shap_value", 9) + F.lit(0.0)).alias("shap_value"),
        F.round("base_value", 9).alias("base_value"),
    )


BALANCED_CAP = Q._BALANCED_CAP  # rows of each class


@register(
    "balanced_attribution",
    O.with_views(
        """SELECT ph.row_id, b."Label", ph.feature, round(ph.shap_value, 9) + 0e0 AS shap_value
FROM ph JOIN b ON ph.row_id = b.row_id""",
        "v_flow",
        ctes={
            "ph": "\nUNION ALL ".join(
                f"SELECT row_id, '{f}' AS feature, ({sql}) * 3 / 2 AS shap_value FROM v_flow" for f, sql in _PHI.items() if f != "k"
            ),
            "b": f"""SELECT row_id, "Label" FROM (SELECT row_id, "Label", row_number() OVER (PARTITION BY "Label" ORDER BY {Q._MD5_ROW}) AS r
  FROM v_flow) s WHERE r <= {BALANCED_CAP}""",
        },
    ),
)
def q_balanced_attribution(spark, sf_dir):
    """ML-16: a class-balanced sample, explained on a reduced feature list."""
    sample = S.capped_sample(V.v_flow(spark, sf_dir), ["Label"], BALANCED_CAP)
    long = AT.attribution_long(spark, FIXED_FOREST[:2], sample, FEATURES[:3], "row_id", keep=("Label",))
    return long.select("row_id", F.col("Label").cast("int").alias("Label"), "feature", (F.round("shap_value", 9) + F.lit(0.0)).alias("shap_value"))


_REPEATS = 5


def _f1_of(rel: str, keys: str) -> str:
    return f"""SELECT {keys} {O.ratio('2 * tp', '2 * tp + fp + fn')} AS f1 FROM (SELECT {keys}
  {O.count_if('y = 1 AND p > 0.5')} AS tp, {O.count_if('y = 0 AND p > 0.5')} AS fp, {O.count_if('y = 1 AND NOT p > 0.5')} AS fn
  FROM {rel} {'GROUP BY ' + keys.rstrip(', ') if keys else ''}) c"""


_PERM_CTES = {
    **_FF_CTES,
    "pos": "SELECT *, row_number() OVER (ORDER BY md5('42|' || row_id)) - 1 AS pos, count(*) OVER () AS n FROM v_flow",
    "base": _f1_of('(SELECT y_true AS y, attack_probability AS p FROM fs)', ""),
}
_MOVED = ", ".join(f"CASE WHEN list_contains(m.moved, '{f}') THEN o.{f} ELSE d.{f} END AS {f}" for f in FEATURES)


def _permuted_sql(draws: str, names: str, text: str) -> dict[str, str]:
    """``draws``: VALUES rows of the names and the list of moved features;
    ``text`` names a draw. Position x receives the features of the donor."""
    own = ", ".join("m." + n.strip() for n in names.split(","))
    return {
        "draws": f"SELECT *, {O.draw_keys(f"'42|' || {text}")} AS keys FROM (VALUES {draws}) d({names}, moved)",
        "lng": f"SELECT pos AS x, pos AS donor, n, {names}, moved, keys FROM pos, draws",
        **O.swap_or_not("lng"),
        "pm": f"""SELECT {names}, "Label" AS y, ({_T1} + {_T2} + {_T3}) / 3e0 AS p FROM (
  SELECT {own}, d."Label", {_MOVED} FROM x8 m JOIN pos d ON d.pos = m.x JOIN pos o ON o.pos = m.donor) x""",
        "fp": _f1_of("pm", names + ","),
    }


@register(
    "fixed_forest_permutation",
    O.with_views(
        """SELECT feature, round(avg(base.f1 - fp.f1), 9) + 0e0 AS importance_mean, round(stddev_pop(base.f1 - fp.f1), 9) AS importance_std
FROM fp CROSS JOIN base GROUP BY 1""",
        "v_flow",
        ctes={
            **_PERM_CTES,
            **_permuted_sql(", ".join(f"('{f}', {r}, ['{f}'])" for f in FEATURES for r in range(_REPEATS)), "feature, repeat", "feature || '|' || repeat"),
        },
    ),
)
def q_fixed_forest_permutation(spark, sf_dir):
    table = IM.permutation_importance(AT.probability_of(FIXED_FOREST, FEATURES), V.v_flow(spark, sf_dir), FEATURES, "row_id", repeats=_REPEATS)
    return table.select(
        "feature", (F.round("importance_mean", 9) + F.lit(0.0)).alias("importance_mean"), F.round("importance_std", 9).alias("importance_std")
    )


@register(
    "fixed_forest_group_permutation",
    O.with_views(
        """SELECT "group", round(base.f1, 9) AS baseline_f1, round(fp.f1, 9) AS permuted_f1, round(base.f1 - fp.f1, 9) + 0e0 AS f1_drop
FROM fp CROSS JOIN base""",
        "v_flow",
        ctes={
            **_PERM_CTES,
            **_permuted_sql(", ".join(f"('{g}', [{', '.join(repr(c) for c in cols)}])" for g, cols in Q._FLOW_GROUPS.items()), '"group"', '"group"'),
        },
    ),
)
def q_fixed_forest_group_permutation(spark, sf_dir):
    model = AT.probability_of(FIXED_FOREST, FEATURES)
    table = IM.group_permutation_importance(model, V.v_flow(spark, sf_dir), Q._FLOW_GROUPS, FEATURES, "row_id")
    return table.select(
        "group", F.round("baseline_f1", 9).alias("baseline_f1"), F.round("permuted_f1", 9).alias("permuted_f1"),
        (F.round("f1_drop", 9) + F.lit(0.0)).alias("f1_drop"),
    )


# ---------------------------------------------------------- trained forests ----


def _flag(cond):
    return F.when(cond, 1).otherwise(0).cast("int")


_TEST_ROWS = {**Q._SPLIT_CTES, "ts": "SELECT v.* FROM v_flow v JOIN sp ON v.row_id = sp.row_id WHERE sp.split = 'test'"}


@register(
    "trained_score_rows",
    O.with_views('SELECT row_id, dataset, attack_family, "Label" AS y_true, 1 AS consistent FROM ts', "v_flow", ctes=_TEST_ROWS),
)
def q_trained_score_rows(spark, sf_dir):
    p = F.col("attack_probability")
    fits = p.between(0, 1) & (F.col("y_pred") == (p > 0.5).cast("int"))
    return Q.q_forest_score(spark, sf_dir).select("row_id", "dataset", "attack_family", "y_true", _flag(fits).alias("consistent"))


@register(
    "trained_evaluation_totals",
    O.with_views(
        f"""SELECT dataset, CAST(count(*) AS BIGINT) AS samples, {O.count_if('"Label" = 0')} AS negatives, {O.count_if('"Label" = 1')} AS positives
FROM (SELECT v.dataset, v."Label" FROM v_flow v JOIN sp ON v.row_id = sp.row_id WHERE sp.split = 'test' OR v.dataset <> 'internal') e GROUP BY 1""",
        "v_flow",
        ctes=Q._SPLIT_CTES,
    ),
)
def q_trained_evaluation_totals(spark, sf_dir):
    m = Q.q_external_eval(spark, sf_dir)
    return m.select("dataset", "samples", (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"))


@register(
    "trained_attribution_sums",
    O.with_views("SELECT row_id, CAST(4 AS BIGINT) AS features, 1 AS additive FROM ts", "v_flow", ctes=_TEST_ROWS),
)
def q_trained_attribution_sums(spark, sf_dir):
    """Base value plus attributions is the forest's probability, row by row."""
    train, test = Q._flow_split(spark, sf_dir)
    model = Q._fit(train)
    trees = AT.pack_forest(spark, model)
    sums = AT.attribution_long(spark, trees, test, FEATURES, "row_id").groupBy("row_id").agg(
        F.count(F.lit(1)).alias("features"), F.sum("shap_value").alias("total")
    )
    both = ML.score(model, test).select("row_id", "attack_probability").join(sums, "row_id")
    gap = F.abs(F.col("total") + F.lit(AT.expected_value(trees)) - F.col("attack_probability"))
    return both.select("row_id", "features", _flag(gap < 1e-6).alias("additive"))


def _split_sizes_sql(rel: str) -> str:
    """Train and test sizes and class totals of a split stratified on y."""
    return f"""SELECT CAST(sum(c - test_q) AS BIGINT) AS train_rows, CAST(sum(test_q) AS BIGINT) AS samples,
       CAST(sum(CASE WHEN y = 0 THEN test_q END) AS BIGINT) AS negatives, CAST(sum(CASE WHEN y = 1 THEN test_q END) AS BIGINT) AS positives
FROM (SELECT y, c, c - (fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, y) <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END) AS test_q
      FROM (SELECT y, c, n_train, (c * n_train) // n AS fl, (c * n_train) % n AS rem
            FROM (SELECT y, CAST(count(*) AS HUGEINT) AS c FROM {rel} GROUP BY 1) a,
                 (SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(*) AS BIGINT) - CAST(ceil(0.2e0 * count(*)) AS BIGINT) AS n_train FROM {rel}) b) s) q"""


_STUDY_FEATURES = ("c_value", "c_user", "c_k")
_STUDY_FINITE = " AND ".join(O.finite(O.num(c)) for c in _STUDY_FEATURES)


def _study_rel(classes: str) -> str:
    return f"(SELECT CASE WHEN {Q._LT.replace('raw_label', 'label')} = 'benign' THEN 0 ELSE 1 END AS y FROM v_raw WHERE {Q._LT.replace('raw_label', 'label')} IN {classes} AND {_STUDY_FINITE}) r"


@register(
    "attack_studies",
    O.with_views(
        f"""SELECT 'BruteForce' AS study, * FROM ({_split_sizes_sql(_study_rel("('benign', 'ftp-patator', 'ssh-patator', 'ftp-bruteforce', 'ssh-bruteforce')"))}) a
UNION ALL SELECT 'PortScan', * FROM ({_split_sizes_sql(_study_rel("('benign', 'portscan', 'port scan')"))}) b""",
        "v_raw",
    ),
)
def q_attack_studies(spark, sf_dir):
    """ML-4: a forest per single-attack study on its own label map."""
    raw = V.v_raw(spark, sf_dir).select(
        F.col("source_row").alias("row_id"), "label", *[coerce_number(F.col(c)).alias(c) for c in _STUDY_FEATURES]
    )
    for c in _STUDY_FEATURES:
        raw = raw.where(is_finite(F.col(c)))
    raw = stored(raw, "study-rows")
    out = None
    for target, mapped in (("BruteForce", L.bruteforce_map), ("PortScan", L.portscan_map)):
        m = XP.attack_study(raw, mapped(F.col("label")), target, _STUDY_FEATURES, num_trees=Q._TREES, max_depth=Q._DEPTH)
        out = m if out is None else out.unionByName(m)
    return out.select(
        "study", "train_rows", "samples", (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives")
    )


@register("subset_experiment_totals", O.with_views(_split_sizes_sql('(SELECT "Label" AS y FROM v_flow WHERE hour = 8) r'), "v_flow"))
def q_subset_experiment_totals(spark, sf_dir):
    m = Q.q_subset_experiment(spark, sf_dir)
    return m.select("train_rows", "samples", (F.col("tn") + F.col("fp")).alias("negatives"), (F.col("fn") + F.col("tp")).alias("positives"))


# --------------------------------------------------------- scaler and files ----


@register(
    "train_only_scaling",
    O.with_views(
        "SELECT row_key, "
        + ", ".join(f"round((te.{c} - p.m{i}) / CASE WHEN p.s{i} = 0 THEN 1e0 ELSE p.s{i} END, 6) + 0e0 AS {c}" for i, c in enumerate(V.LINE_FEATURES))
        + " FROM te CROSS JOIN p",
        "v_line",
        ctes={
            "te": f"SELECT * FROM v_line WHERE md5('42|' || row_key) < {Q._TEST_CUT}",
            "p": "SELECT "
            + ", ".join(f"avg({c}) AS m{i}, stddev_pop({c}) AS s{i}" for i, c in enumerate(V.LINE_FEATURES))
            + f" FROM v_line WHERE NOT md5('42|' || row_key) < {Q._TEST_CUT}",
        },
    ),
)
def q_train_only_scaling(spark, sf_dir):
    """ML-1 / SRC-16: fitted on the training rows, saved, loaded, applied to the test rows."""
    train, test = Q._line_split(spark, sf_dir)
    path = _folder(spark, "scaler")
    T.save_scaler(spark, P.fit_scaler(train, V.LINE_FEATURES), path)
    scaled = P.apply_scaler(test.select("row_key", *V.LINE_FEATURES), T.load_scaler(spark, path))
    return scaled.select("row_key", *[(F.round(c, 6) + F.lit(0.0)).alias(c) for c in V.LINE_FEATURES])


@register(
    "table_round_trip",
    O.with_views(
        """SELECT source_file, dataset, CAST(count(*) AS BIGINT) AS "rows", 4 AS n_features FROM v_flow GROUP BY 1, 2""", "v_flow"
    ),
)
def q_table_round_trip(spark, sf_dir):
    """SRC-5/6/9/11..15, PRJ-7: overwrite, append, per-file folders, read back."""
    flow = V.v_flow(spark, sf_dir)
    base = _folder(spark, "tables")
    T.write_table(flow.where(F.col("dataset") == "internal"), f"{base}/flows", partition_by=("source_file",))
    T.write_table(flow.where(F.col("dataset") == "external"), f"{base}/flows", mode="append", partition_by=("source_file",))
    features, label, meta = T.split_roles([c for c in flow.columns if c != "row_id"])
    T.save_feature_list(spark, features, f"{base}/features")
    present, _ = T.existing_files(spark, [f"{base}/flows", f"{base}/absent"])
    names = T.load_feature_list(spark, f"{base}/features")
    back = T.load_table(spark, present[0], required=[*names, label, *meta])
    complete = F.lit(True)
    for c in names:
        complete = complete & F.col(c).isNotNull()
    return back.where(complete).groupBy("source_file", "dataset").agg(F.count(F.lit(1)).alias("rows")).withColumn("n_features", F.lit(len(names)))


_CSV_COLUMNS = ("dst_port", "flow_duration", "fwd_header_len")
_CSV_FINITE = " AND ".join(O.finite(O.num(c)) for c in ("c_user", "c_value", "c_k"))


def _capture_folder(spark, sf_dir):
    """The raw rows as capture CSVs of two header styles (one with a repeated
    column), latin1 text, and a file that holds a header only."""
    raw = V.v_raw(spark, sf_dir)
    first = F.col("source_file").isin("part-0", "part-1", "part-2", "part-3")
    old = raw.where(first).select(
        F.col("c_user").alias(" Destination Port"), F.col("c_value").alias("Flow Duration"), F.col("c_k").alias("Fwd Header Length"),
        F.col("label").alias("Label"), F.col("c_text").alias("Fwd Header Length.1"),
    )
    new = raw.where(~first).select(
        F.col("c_user").alias("Dst Port"), F.col("c_value").alias("Flow Duration"), F.col("c_k").alias("Fwd Header Len"), F.col("label").alias("Label")
    )
    folder = _folder(spark, "captures")
    for part in (old, new, new.limit(0)):
        part.write.mode("append").option("header", True).option("encoding", FC.ENCODING).csv(folder)
    return folder


def _prepared_captures(spark, sf_dir):
    scan = FC.scan_directory(spark, _capture_folder(spark, sf_dir))
    return C.prepare_flows(scan.data, "captures", scan.candidates, duplicate_columns=scan.duplicates, absent=scan.absent, files=scan.names)


@register(
    "csv_round_trip",
    O.with_views(
        f"""SELECT {O.num('c_user')} AS dst_port, {O.num('c_value')} AS flow_duration, {O.num('c_k')} AS fwd_header_len,
       CAST(CASE WHEN attack_family = 'Benign' THEN 0 ELSE 1 END AS INTEGER) AS "Label", original_label, attack_family
FROM k WHERE keep AND {_CSV_FINITE}""",
        "v_raw",
        ctes={n: Q._PREP_CTES[n] for n in ("lab", "k")},
    ),
)
def q_csv_round_trip(spark, sf_dir):
    """SRC-1, PRJ-3/4/8/14: capture files through headers, labels and cleaning."""
    return _prepared_captures(spark, sf_dir).data.select(*_CSV_COLUMNS, "Label", "original_label", "attack_family")


@register(
    "csv_report_totals",
    O.with_views(
        f"""SELECT CAST(count(*) AS BIGINT) AS rows_before, {O.count_if('keep')} AS rows_after_label_filter,
       {O.count_if(f'keep AND {_CSV_FINITE}')} AS rows_after_cleaning, CAST(1 AS BIGINT) AS has_empty_files FROM k""",
        "v_raw",
        ctes={n: Q._PREP_CTES[n] for n in ("lab", "k")},
    ),
)
def q_csv_report_totals(spark, sf_dir):
    """AGG-3 over all files, those without data rows included."""
    report = _prepared_captures(spark, sf_dir).report
    total = lambda c: F.sum(c).cast("bigint").alias(c)
    return report.agg(
        total("rows_before"), total("rows_after_label_filter"), total("rows_after_cleaning"),
        F.max(F.when(F.col("rows_before") == 0, 1).otherwise(0)).cast("bigint").alias("has_empty_files"),
    )


@register(
    "file_report",
    O.with_views(
        """SELECT 'ok' AS status, CAST(count(*) AS BIGINT) AS rows, CAST(count(*) AS BIGINT) AS positions FROM v_raw
UNION ALL SELECT 'no label', 0, 0 UNION ALL SELECT 'empty', 0, 0""",
        "v_raw",
    ),
)
def q_file_report(spark, sf_dir):
    """SRC-5, WIN-1: files of the raw rows next to one without a label column
    and one without a line; positions in a file must be 0 .. n-1."""
    raw = V.v_raw(spark, sf_dir)
    folder = _folder(spark, "reported")
    told = raw.select(F.col("c_user").alias("Dst Port"), F.col("label").alias("Label"))
    told.write.option("header", True).option("encoding", FC.ENCODING).csv(folder)
    raw.limit(0).select(F.col("c_k").alias("Flow Duration")).write.mode("append").option("header", True).csv(folder)
    blank = raw.limit(1).select(F.lit("  ").alias("Label")).write.mode("append")
    blank.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(folder)
    scan = FC.scan_directory(spark, folder, strict=False)
    gapless = (F.min("source_row") == 0) & (F.max("source_row") == F.count(F.lit(1)) - 1) & (F.countDistinct("source_row") == F.count(F.lit(1)))
    placed = scan.data.groupBy(F.col("source_file").alias("file")).agg(F.when(gapless, F.count(F.lit(1))).alias("positions"))
    report = scan.files.join(placed, "file", "left").groupBy("status")
    return report.agg(F.sum("rows").alias("rows"), F.coalesce(F.sum("positions"), F.lit(0)).cast("bigint").alias("positions"))


@register(
    "legacy_clean_rows",
    O.with_views(
        "SELECT " + ", ".join(f"{O.num(c)} AS {c}" if c in Q._RAW_NUMERIC else c for c in Q._ALL_RAW) + f" FROM rt WHERE {Q._sql_row_ok()}",
        "v_raw",
        ctes=Q._RAW_TEXT_CTE,
    ),
)
def q_legacy_clean_rows(spark, sf_dir):
    """FLT-3: rows without any missing or infinite cell."""
    return C.clean_legacy(Q._raw_text(spark, sf_dir), Q._ALL_RAW)


_OVERLAP_SQL = ", ".join(Q._OVERLAP_FEATS)


@register(
    "overlapping_rows",
    O.with_views(
        f"SELECT row_key FROM te WHERE ({_OVERLAP_SQL}) IN (SELECT ({_OVERLAP_SQL}) FROM tr)",
        "v_line",
        ctes={
            "tr": f"SELECT * FROM v_line WHERE NOT md5('42|' || row_key) < {Q._TEST_CUT}",
            "te": f"SELECT * FROM v_line WHERE md5('42|' || row_key) < {Q._TEST_CUT}",
        },
    ),
)
def q_overlapping_rows(spark, sf_dir):
    """JN-3: the test rows whose features also occur in training."""
    return P.overlapping_rows(*Q._line_split(spark, sf_dir), Q._OVERLAP_FEATS).select("row_key")


@register("distinct_labels", O.with_views("SELECT CAST(count(DISTINCT raw_label) AS BIGINT) AS distinct_raw_label FROM v_label", "v_label"))
def q_distinct_labels(spark, sf_dir):
    """AGG-17."""
    return D.distinct_count(V.v_label(spark, sf_dir), "raw_label")


@register(
    "empty_metrics",
    O.with_views(
        f"""SELECT tn, fp, fn, tp, samples, accuracy, precision, recall, f1_score FROM ({O.metrics_from('c', '', extended=False)}) m""",
        "v_pred",
        ctes={
            "c": """SELECT CAST(count(*) FILTER (y_true = 0 AND y_pred = 0) AS BIGINT) AS tn, CAST(count(*) FILTER (y_true = 0 AND y_pred = 1) AS BIGINT) AS fp,
  CAST(count(*) FILTER (y_true = 1 AND y_pred = 0) AS BIGINT) AS fn, CAST(count(*) FILTER (y_true = 1 AND y_pred = 1) AS BIGINT) AS tp
  FROM v_pred WHERE attack_probability > 1"""
        },
    ),
)
def q_empty_metrics(spark, sf_dir):
    """AGG-6/7/10 over a selection without rows: zeros."""
    m = M.binary_metrics(V.v_pred(spark, sf_dir).where(F.col("attack_probability") > 1), extended=False)
    return m.select("tn", "fp", "fn", "tp", "samples", "accuracy", "precision", "recall", "f1_score")


_TRAIN_FILES = ("part-0", "part-1", "part-2", "part-3")
_STREAM_FILES = 4
_ROWS_PER_STREAM_FILE = 250_000


@register(
    "stream_prepared_scores",
    O.with_views(
        f"""SELECT a.source_row, CAST(CASE WHEN a.attack_family = 'Benign' THEN 0 ELSE 1 END AS INTEGER) AS y_true,
       round((a.c_value - p.m) / p.s, 6) + 0e0 AS c_value, 1 AS consistent
FROM nb a CROSS JOIN p WHERE a.source_file NOT IN {_TRAIN_FILES}""",
        "v_raw",
        ctes={
            **{n: Q._PREP_CTES[n] for n in ("lab", "k")},
            "nb": f"SELECT source_file, source_row, attack_family, {O.num('c_value')} AS c_value FROM k WHERE keep AND {_STUDY_FINITE}",
            "p": f"SELECT avg(c_value) AS m, stddev_pop(c_value) AS s FROM nb WHERE source_file IN {_TRAIN_FILES}",
        },
    ),
)
def q_stream_prepared_scores(spark, sf_dir):
    """STR-1: arriving files are cleaned, scaled as in training, scored and appended."""
    raw = V.v_raw(spark, sf_dir).select("source_file", "source_row", "label", *_STUDY_FEATURES)
    train = C.prepare_flows(raw.where(F.col("source_file").isin(*_TRAIN_FILES)), "train", _STUDY_FEATURES).data
    params = P.fit_scaler(train, _STUDY_FEATURES)
    cfg = ML.ForestConfig(_STUDY_FEATURES, key="source_row", num_trees=Q._TREES, max_depth=Q._DEPTH)
    model = ML.fit_forest(stored(P.apply_scaler(train, params), "scaled"), cfg)
    base = _folder(spark, "arriving")
    arriving = raw.where(~F.col("source_file").isin(*_TRAIN_FILES))
    # as many batches as ever, each of as many files as its rows need
    files = max(1, -(-arriving.count() // (_STREAM_FILES * _ROWS_PER_STREAM_FILE)))
    arriving.repartition(_STREAM_FILES * files, "source_row").write.parquet(f"{base}/in")
    stream = SF.read_stream(spark, f"{base}/in", raw.schema, max_files=files)
    scored = SF.stream_prepared_scores(stream, model, _STUDY_FEATURES, params, keep=("source_row",))
    scored = scored.select("source_row", "y_true", "y_pred", "c_value", "attack_probability")
    SF.drain_to_files(scored, f"{base}/out", f"{base}/progress")
    p = F.col("attack_probability")
    return spark.read.schema(scored.schema).parquet(f"{base}/out").select(
        "source_row", "y_true", (F.round("c_value", 6) + F.lit(0.0)).alias("c_value"),
        _flag(p.between(0, 1) & (F.col("y_pred") == (p > 0.5).cast("int"))).alias("consistent"),
    )
