"""Registered queries: name → Spark query, and name → DuckDB oracle SQL.

Each Spark query takes ``(spark, sf_dir)`` and returns a lazy DataFrame over
the driver's tables (through the surrogate views); the SQL states the same
result for DuckDB. Queries without SQL are checked by row count only (model
fits, attributions) and have brute-force tests in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.operators import distributions as D
from flowlens.operators import metrics as M
from flowlens.plans import oracle as O
from flowlens.plans import views as V

QueryFn = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return deco


# --------------------------------------------------------------- metrics ----

_HIT = "attack_probability >= threshold"
_COUNTS_BY_THRESHOLD = f"""
  SELECT dataset, threshold, attack_family,
         {O.count_if('y_true = 0')} - {O.count_if(f'y_true = 0 AND {_HIT}')} AS tn,
         {O.count_if(f'y_true = 0 AND {_HIT}')} AS fp,
         {O.count_if('y_true = 1')} - {O.count_if(f'y_true = 1 AND {_HIT}')} AS fn,
         {O.count_if(f'y_true = 1 AND {_HIT}')} AS tp
  FROM v_pred CROSS JOIN {O.thresholds_values()}
  GROUP BY dataset, threshold, attack_family"""


@register(
    "threshold_sweep",
    O.with_views(
        f"""SELECT dataset, threshold, samples, accuracy, precision, recall, f1_score, specificity,
       balanced_accuracy, tn, fp, fn, tp
FROM ({O.metrics_from('c', 'dataset, threshold')}) m
ORDER BY dataset, threshold DESC""",
        "v_pred",
        ctes={
            "cf": _COUNTS_BY_THRESHOLD,
            "c": """SELECT dataset, threshold, CAST(sum(tn) AS BIGINT) AS tn, CAST(sum(fp) AS BIGINT) AS fp,
       CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(tp) AS BIGINT) AS tp FROM cf GROUP BY dataset, threshold""",
        },
    ),
)
def q_threshold_sweep(spark, sf_dir):
    return M.threshold_sweep(V.v_pred(spark, sf_dir)).orderBy("dataset", F.desc("threshold"))


@register(
    "threshold_sweep_by_family",
    O.with_views(
        f"""SELECT dataset, threshold, attack_family, CAST(tn + fp + fn + tp AS BIGINT) AS samples,
       CASE WHEN tn + fp >= fn + tp THEN 0 ELSE 1 END AS expected_label,
       {O.ratio('tn + tp', 'tn + fp + fn + tp')} AS recall_or_specificity,
       fn AS false_negatives, fp AS false_positives
FROM cf ORDER BY dataset, threshold DESC, attack_family""",
        "v_pred",
        ctes={"cf": _COUNTS_BY_THRESHOLD},
    ),
)
def q_threshold_sweep_by_family(spark, sf_dir):
    return M.threshold_sweep_by_family(V.v_pred(spark, sf_dir)).orderBy(
        "dataset", F.desc("threshold"), "attack_family"
    )


_CONF = f"""
  SELECT dataset, {O.count_if('y_true = 0 AND y_pred = 0')} AS tn, {O.count_if('y_true = 0 AND y_pred = 1')} AS fp,
         {O.count_if('y_true = 1 AND y_pred = 0')} AS fn, {O.count_if('y_true = 1 AND y_pred = 1')} AS tp
  FROM v_pred GROUP BY dataset"""


@register(
    "confusion_matrix",
    O.with_views(
        """SELECT dataset, 'true_benign' AS true_class, tn AS pred_benign, fp AS pred_attack FROM c
UNION ALL SELECT dataset, 'true_attack', fn, tp FROM c""",
        "v_pred",
        ctes={"c": _CONF},
    ),
)
def q_confusion_matrix(spark, sf_dir):
    return M.confusion_matrix(V.v_pred(spark, sf_dir), ["dataset"])


@register(
    "binary_metrics",
    O.with_views(
        f"""SELECT dataset, tn, fp, fn, tp, samples, accuracy, precision, recall, f1_score, specificity,
       balanced_accuracy FROM ({O.metrics_from('c', 'dataset')}) m""",
        "v_pred",
        ctes={"c": _CONF},
    ),
)
def q_binary_metrics(spark, sf_dir):
    return M.binary_metrics(V.v_pred(spark, sf_dir), ["dataset"]).select(
        "dataset", "tn", "fp", "fn", "tp", "samples", "accuracy", "precision", "recall", "f1_score",
        "specificity", "balanced_accuracy",
    )


def _f1(p: str, r: str) -> str:
    return f"CASE WHEN {p} + {r} = 0 THEN CAST(0.0 AS DOUBLE) ELSE 2 * {p} * {r} / ({p} + {r}) END"


@register(
    "classification_report",
    O.with_views(
        f"""SELECT dataset, 'Benign' AS label, p0 AS precision, r0 AS recall, f0 AS f1_score, s0 AS support FROM k
UNION ALL SELECT dataset, 'Attack', p1, r1, f1, s1 FROM k
UNION ALL SELECT dataset, 'accuracy', acc, acc, acc, s0 + s1 FROM k
UNION ALL SELECT dataset, 'macro avg', (p0 + p1) / 2, (r0 + r1) / 2, (f0 + f1) / 2, s0 + s1 FROM k
UNION ALL SELECT dataset, 'weighted avg', (p0 * s0 + p1 * s1) / (s0 + s1), (r0 * s0 + r1 * s1) / (s0 + s1),
       (f0 * s0 + f1 * s1) / (s0 + s1), s0 + s1 FROM k""",
        "v_pred",
        ctes={
            "c": _CONF,
            "pr": f"""SELECT dataset, tn, tp, {O.ratio('tn', 'tn + fn')} AS p0, {O.ratio('tn', 'tn + fp')} AS r0,
       {O.ratio('tp', 'tp + fp')} AS p1, {O.ratio('tp', 'tp + fn')} AS r1,
       CAST(tn + fp AS BIGINT) AS s0, CAST(tp + fn AS BIGINT) AS s1 FROM c""",
            "k": f"""SELECT *, {_f1('p0', 'r0')} AS f0, {_f1('p1', 'r1')} AS f1,
       {O.ratio('tn + tp', 's0 + s1')} AS acc FROM pr""",
        },
    ),
)
def q_classification_report(spark, sf_dir):
    return M.classification_report(V.v_pred(spark, sf_dir), ["dataset"])


_FAMILY_STATS_SQL = f"""SELECT dataset, attack_family, CAST(count(*) AS BIGINT) AS samples,
       CASE WHEN {O.count_if('y_true = 0')} >= {O.count_if('y_true = 1')} THEN 0 ELSE 1 END AS expected_label,
       CAST({O.count_if('y_true = y_pred')} AS DOUBLE) / count(*) AS recall_or_specificity,
       {O.count_if('y_true = 1 AND y_pred = 0')} AS false_negatives,
       {O.count_if('y_true = 0 AND y_pred = 1')} AS false_positives
FROM v_pred GROUP BY dataset, attack_family ORDER BY dataset, attack_family"""


@register("family_stats", O.with_views(_FAMILY_STATS_SQL, "v_pred"))
def q_family_stats(spark, sf_dir):
    return M.family_stats(V.v_pred(spark, sf_dir), ["dataset"]).orderBy("dataset", "attack_family")


@register(
    "attack_crosstab",
    O.with_views(
        f"""SELECT original_label AS attack_type, {O.count_if('y_pred = 0')} AS pred_0,
       {O.count_if('y_pred = 1')} AS pred_1,
       {O.ratio(O.count_if('y_pred = 1'), 'count(*)')} AS recall
FROM v_pred WHERE y_true = 1 GROUP BY original_label""",
        "v_pred",
    ),
)
def q_attack_crosstab(spark, sf_dir):
    return M.attack_crosstab(V.v_pred(spark, sf_dir))


# ---------------------------------------------------------------- labels ----

_NORM = "trim(regexp_replace(lower(trim(coalesce(raw_label, 'nan'))), '[^a-z0-9]+', ' ', 'g'))"
_FAMILY_SQL = """CASE
    WHEN n = 'benign' THEN 'Benign'
    WHEN contains(n, 'ddos') THEN 'DDoS'
    WHEN starts_with(n, 'dos ') OR contains(' ' || n, ' slowloris') THEN 'DoS'
    WHEN contains(n, 'slowhttptest') OR contains(n, 'slowhttp') THEN 'DoS'
    WHEN contains(n, 'goldeneye') OR contains(n, 'hulk') THEN 'DoS'
    WHEN contains(n, 'ftp patator') OR contains(n, 'ssh patator') THEN 'BruteForce'
    WHEN contains(n, 'ftp bruteforce') OR contains(n, 'ssh bruteforce') THEN 'BruteForce'
    WHEN contains(n, 'ftp brute force') OR contains(n, 'ssh brute force') THEN 'BruteForce'
    WHEN contains(n, 'sql injection') THEN 'Other'
    WHEN contains(n, 'web attack brute force') OR contains(n, 'web attack xss') THEN 'WebAttack'
    WHEN n IN ('brute force xss', 'brute force web') THEN 'WebAttack'
    WHEN contains(' ' || n, ' xss') THEN 'WebAttack'
    ELSE 'Other' END"""


@register(
    "label_taxonomy",
    O.with_views(
        f"""SELECT raw_label, original_label, n AS normalized_label, {_FAMILY_SQL} AS attack_family,
       CAST(CASE WHEN ({_FAMILY_SQL}) = 'Benign' THEN 0 ELSE 1 END AS INTEGER) AS binary_label,
       "count"
FROM (SELECT raw_label, trim(coalesce(raw_label, 'nan')) AS original_label, {_NORM} AS n,
             CAST(count(*) AS BIGINT) AS "count" FROM v_label GROUP BY raw_label) g""",
        "v_label",
    ),
)
def q_label_taxonomy(spark, sf_dir):
    # Aggregate first: the taxonomy runs once per distinct raw label.
    g = V.v_label(spark, sf_dir).groupBy("raw_label").agg(F.count(F.lit(1)).alias("count"))
    raw = F.col("raw_label")
    fam = L.attack_family(raw)
    return g.select(
        "raw_label",
        L.label_text(raw).alias("original_label"),
        L.normalize_label(raw).alias("normalized_label"),
        fam.alias("attack_family"),
        L.binary_from_family(fam).alias("binary_label"),
        "count",
    )


_LT = "lower(trim(coalesce(raw_label, 'nan')))"


@register(
    "legacy_label_maps",
    O.with_views(
        f"""SELECT raw_label, bruteforce_class, portscan_class, web_attack_class,
       CAST(CASE WHEN lower(bruteforce_class) = 'benign' THEN 0 ELSE 1 END AS INTEGER) AS bruteforce_binary,
       "count"
FROM (
  SELECT raw_label,
         CASE WHEN t IN ('ftp-patator', 'ssh-patator', 'ftp-bruteforce', 'ssh-bruteforce') THEN 'BruteForce'
              WHEN t = 'benign' THEN 'Benign' ELSE 'Other' END AS bruteforce_class,
         CASE WHEN t IN ('portscan', 'port scan') THEN 'PortScan' WHEN t = 'benign' THEN 'Benign'
              ELSE 'Other' END AS portscan_class,
         CASE WHEN t = 'benign' THEN 'Benign'
              WHEN (contains(t, 'web attack') AND (contains(t, 'brute force') OR contains(t, 'xss')))
                OR (contains(t, 'bruteforce') AND (contains(t, 'web') OR contains(t, 'xss'))) THEN 'WebAttack'
              ELSE 'Other' END AS web_attack_class,
         "count"
  FROM (SELECT raw_label, {_LT} AS t, CAST(count(*) AS BIGINT) AS "count" FROM v_label GROUP BY raw_label) g
) m""",
        "v_label",
    ),
)
def q_legacy_label_maps(spark, sf_dir):
    g = V.v_label(spark, sf_dir).groupBy("raw_label").agg(F.count(F.lit(1)).alias("count"))
    raw = F.col("raw_label")
    bf = L.bruteforce_map(raw)
    return g.select(
        "raw_label",
        bf.alias("bruteforce_class"),
        L.portscan_map(raw).alias("portscan_class"),
        L.web_attack_map(raw).alias("web_attack_class"),
        L.legacy_binary(bf).alias("bruteforce_binary"),
        "count",
    )


# --------------------------------------------------------- distributions ----


@register(
    "class_distribution",
    O.with_views('SELECT "Label", CAST(count(*) AS BIGINT) AS "count" FROM v_flow GROUP BY "Label" ORDER BY 1', "v_flow"),
)
def q_class_distribution(spark, sf_dir):
    return D.class_distribution(V.v_flow(spark, sf_dir))


@register(
    "family_distribution",
    O.with_views(
        'SELECT attack_family, CAST(count(*) AS BIGINT) AS "count" FROM v_flow GROUP BY 1 ORDER BY 2 DESC, 1', "v_flow"
    ),
)
def q_family_distribution(spark, sf_dir):
    return D.family_distribution(V.v_flow(spark, sf_dir))


@register(
    "label_distribution",
    O.with_views(
        'SELECT attack_family, original_label, CAST(count(*) AS BIGINT) AS "count" FROM v_flow '
        "GROUP BY 1, 2 ORDER BY 1, 3 DESC, 2",
        "v_flow",
    ),
)
def q_label_distribution(spark, sf_dir):
    return D.label_distribution(V.v_flow(spark, sf_dir))


@register(
    "class_share",
    O.with_views(
        """SELECT l_returnflag, "count", CAST("count" AS DOUBLE) / sum("count") OVER () AS share
FROM (SELECT l_returnflag, CAST(count(*) AS BIGINT) AS "count" FROM v_line GROUP BY 1) g""",
        "v_line",
    ),
)
def q_class_share(spark, sf_dir):
    return D.value_share(V.v_line(spark, sf_dir), "l_returnflag")


@register(
    "top_values_per_class",
    O.with_views(
        """SELECT l_returnflag, l_quantity, "count", share, rank FROM (
  SELECT l_returnflag, l_quantity, "count",
         CAST("count" AS DOUBLE) / sum("count") OVER (PARTITION BY l_returnflag) AS share,
         CAST(row_number() OVER (PARTITION BY l_returnflag ORDER BY "count" DESC, l_quantity) AS INTEGER) AS rank
  FROM (SELECT l_returnflag, l_quantity, CAST(count(*) AS BIGINT) AS "count" FROM v_line GROUP BY 1, 2) g
) r WHERE rank <= 20""",
        "v_line",
    ),
)
def q_top_values_per_class(spark, sf_dir):
    return D.top_values_per_class(V.v_line(spark, sf_dir), "l_returnflag", "l_quantity", 20)


@register(
    "class_weights",
    """SELECT quality, "count", CAST(sum("count") OVER () AS DOUBLE) / (count(*) OVER () * "count") AS weight
FROM (SELECT quality, CAST(count(*) AS BIGINT) AS "count" FROM labels GROUP BY quality) g""",
)
def q_class_weights(spark, sf_dir):
    from flowlens.session import read_table

    return D.class_weights(read_table(spark, sf_dir, "labels"), "quality")


# -------------------------------------------------------------- cleaning ----

from flowlens.operators import clean as C  # noqa: E402

_RAW_DATASET = "raw_events"
_FAM_OF_LABEL = _FAMILY_SQL
_INCLUDED = "('Benign', 'DDoS', 'DoS', 'BruteForce', 'WebAttack')"
_CANDIDATES = V.RAW_FEATURES
_COMMON = ("c_value", "c_user", "c_hour", "c_k", "c_sparse")  # c_text is text in every file


def _prepared(spark, sf_dir):
    return C.prepare_flows(V.v_raw(spark, sf_dir), _RAW_DATASET, V.RAW_FEATURES)


_PREP_CTES = {
    "lab": f"SELECT *, {O.norm_label('label')} AS n FROM v_raw",
    "k": f"""SELECT source_file, source_row, trim(coalesce(label, 'nan')) AS original_label,
       {_FAM_OF_LABEL} AS attack_family, ({_FAM_OF_LABEL}) IN {_INCLUDED} AS keep,
       {', '.join(_CANDIDATES)} FROM lab""",
    "fs": "SELECT source_file, "
    + ", ".join(
        f"{O.count_if(f'keep AND NOT {O.missing_text(c)}')} > 0 AND {O.count_if(f'keep AND {O.num(c)} IS NOT NULL')} = 0 AS d_{c}"
        for c in _CANDIDATES
    )
    + " FROM k GROUP BY source_file",
    "j": "SELECT k.*, " + ", ".join(f"fs.d_{c}" for c in _CANDIDATES) + " FROM k JOIN fs ON k.source_file = fs.source_file",
    "cl": "SELECT *, keep AND "
    + " AND ".join(f"(d_{c} OR {O.finite(O.num(c))})" for c in _CANDIDATES)
    + " AS clean FROM j",
}


@register(
    "numeric_coercion",
    O.with_views(
        "SELECT source_file, source_row, " + ", ".join(f"{O.num(c)} AS {c}" for c in _CANDIDATES) + " FROM v_raw",
        "v_raw",
    ),
)
def q_numeric_coercion(spark, sf_dir):
    return C.coerce_columns(V.v_raw(spark, sf_dir), V.RAW_FEATURES, keep=("source_file", "source_row"))


@register(
    "clean_rows",
    O.with_views(
        "SELECT "
        + ", ".join(f"{O.num(c)} AS {c}" for c in _COMMON)
        + f""", CAST(CASE WHEN attack_family = 'Benign' THEN 0 ELSE 1 END AS INTEGER) AS "Label",
       '{_RAW_DATASET}' AS dataset, source_file, source_row, original_label, attack_family
FROM cl WHERE clean""",
        "v_raw",
        ctes=_PREP_CTES,
    ),
)
def q_clean_rows(spark, sf_dir):
    return _prepared(spark, sf_dir).data


@register(
    "cleaning_report",
    O.with_views(
        f"""SELECT source_file AS file, '{_RAW_DATASET}' AS dataset, CAST(count(*) AS BIGINT) AS rows_before,
       {O.count_if('keep')} AS rows_after_label_filter, {O.count_if('clean')} AS rows_after_cleaning,
       CAST(count(*) AS BIGINT) - {O.count_if('keep')} AS removed_label_rows,
       {O.count_if('keep')} - {O.count_if('clean')} AS removed_cleaning_rows,
       '' AS dropped_duplicate_columns,
       concat_ws(';', {', '.join(f"CASE WHEN d_{c} THEN '{c}' END" for c in _CANDIDATES)}) AS dropped_non_numeric_columns
FROM cl GROUP BY source_file, {', '.join(f'd_{c}' for c in _CANDIDATES)}""",
        "v_raw",
        ctes=_PREP_CTES,
    ),
)
def q_cleaning_report(spark, sf_dir):
    return _prepared(spark, sf_dir).report


_ALL_RAW = ("source_file", "source_row", "label", *V.RAW_FEATURES)
_RAW_NUMERIC = ("source_row", "c_value", "c_user", "c_k", "c_sparse")  # every non-missing cell parses


def _raw_text(spark, sf_dir):
    raw = V.v_raw(spark, sf_dir)
    return raw.select(*[F.col(c).cast("string").alias(c) for c in _ALL_RAW])


def _sql_missing(c: str) -> str:
    return f"{O.num(c)} IS NULL" if c in _RAW_NUMERIC else O.missing_text(c)


def _sql_row_ok(plus_inf_only: bool = False) -> str:
    parts = []
    for c in _ALL_RAW:
        if c in _RAW_NUMERIC:
            x = O.num(c)
            parts.append(
                f"({x} IS NOT NULL AND NOT isnan({x}) AND {x} <> CAST('Infinity' AS DOUBLE))"
                if plus_inf_only
                else O.finite(x)
            )
        else:
            parts.append(f"NOT {O.missing_text(c)}")
    return " AND ".join(parts)


_RAW_TEXT_CTE = {"rt": "SELECT " + ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in _ALL_RAW) + " FROM v_raw"}


@register(
    "cleaning_stats",
    O.with_views(
        f"""SELECT rows_before, rows_after, rows_before - rows_after AS removed_rows, missing_before, infinite_before,
       missing_after, infinite_after
FROM (SELECT CAST(count(*) AS BIGINT) AS rows_before, {O.count_if(_sql_row_ok())} AS rows_after,
             CAST(sum({' + '.join(f'CASE WHEN {_sql_missing(c)} THEN 1 ELSE 0 END' for c in _ALL_RAW)}) AS BIGINT) AS missing_before,
             CAST(sum({' + '.join(f'CASE WHEN isinf({O.num(c)}) THEN 1 ELSE 0 END' for c in _RAW_NUMERIC)}) AS BIGINT) AS infinite_before,
             CAST(sum({' + '.join(f'CASE WHEN ({_sql_row_ok()}) AND {_sql_missing(c)} THEN 1 ELSE 0 END' for c in _ALL_RAW)}) AS BIGINT) AS missing_after,
             CAST(sum({' + '.join(f'CASE WHEN ({_sql_row_ok()}) AND isinf({O.num(c)}) THEN 1 ELSE 0 END' for c in _RAW_NUMERIC)}) AS BIGINT) AS infinite_after
      FROM rt) a""",
        "v_raw",
        ctes=_RAW_TEXT_CTE,
    ),
)
def q_cleaning_stats(spark, sf_dir):
    return C.cleaning_stats(_raw_text(spark, sf_dir), _ALL_RAW)


def _profile_sql() -> str:
    ok = _sql_row_ok(plus_inf_only=True)
    sels = []
    for c in _ALL_RAW:
        for stage, cond in (("before", "TRUE"), ("after", ok)):
            sels.append(f"SELECT '{stage}' AS stage, '{c}' AS \"column\", 'missing' AS kind, "
                        f"{O.count_if(f'({cond}) AND {_sql_missing(c)}')} AS cells FROM rt")
            if c in _RAW_NUMERIC:
                sels.append(f"SELECT '{stage}' AS stage, '{c}' AS \"column\", 'infinite' AS kind, "
                            f"{O.count_if(f'({cond}) AND isinf({O.num(c)})')} AS cells FROM rt")
    return "SELECT * FROM (\n" + "\nUNION ALL ".join(sels) + "\n) p WHERE cells > 0"


@register("missing_inf_profile", O.with_views(_profile_sql(), "v_raw", ctes=_RAW_TEXT_CTE))
def q_missing_inf_profile(spark, sf_dir):
    return C.missing_inf_profile(_raw_text(spark, sf_dir), _ALL_RAW)


_LINE_PROJ = "l_quantity, l_discount, l_tax, l_returnflag"


@register(
    "dedup_rows",
    O.with_views(f"SELECT DISTINCT {_LINE_PROJ} FROM v_line", "v_line"),
)
def q_dedup_rows(spark, sf_dir):
    return C.drop_duplicate_rows(V.v_line(spark, sf_dir).select(*_LINE_PROJ.split(", ")))


@register(
    "dedup_report",
    O.with_views(
        f"""SELECT rows_before, rows_after, rows_before - rows_after AS removed_rows,
       {O.ratio('rows_before - rows_after', 'rows_before')} * 100 AS removed_percent
FROM (SELECT CAST(count(*) AS BIGINT) AS rows_before FROM v_line) b,
     (SELECT CAST(count(*) AS BIGINT) AS rows_after FROM (SELECT DISTINCT {_LINE_PROJ} FROM v_line) d) a""",
        "v_line",
    ),
)
def q_dedup_report(spark, sf_dir):
    return C.dedup_report(V.v_line(spark, sf_dir).select(*_LINE_PROJ.split(", ")))


# -------------------------------------------------------------- sampling ----

from flowlens.operators import profile as P  # noqa: E402
from flowlens.operators import sampling as S  # noqa: E402

_MD5_ROW = "md5('42|' || CAST(row_id AS VARCHAR))"
_CAP = S.MAX_SAMPLES_PER_SOURCE_LABEL  # 50,000, as in the study
_BALANCED_CAP = 5_000  # rows of a class, as in the study
_FAMILY_CAP = 2_000  # rows of a family
_BOUNDED_N = 20_000


def _flow_cols_sql() -> str:
    return ("row_id, value, user_id, hour, k, \"Label\", dataset, source_file, source_row, "
            "original_label, attack_family")


@register(
    "capped_sample",
    O.with_views(
        f"""SELECT {_flow_cols_sql()} FROM (
  SELECT *, row_number() OVER (PARTITION BY source_file, original_label, attack_family ORDER BY {_MD5_ROW}) AS rn
  FROM v_flow) s WHERE rn <= {_CAP}""",
        "v_flow",
    ),
)
def q_capped_sample(spark, sf_dir):
    return S.capped_sample(V.v_flow(spark, sf_dir), S.SOURCE_LABEL_KEYS, _CAP)


@register(
    "balanced_sample",
    O.with_views(
        f"""SELECT {_flow_cols_sql()} FROM (
  SELECT *, row_number() OVER (PARTITION BY "Label" ORDER BY {_MD5_ROW}) AS rn FROM v_flow) s
WHERE rn <= {_BALANCED_CAP}""",
        "v_flow",
    ),
)
def q_balanced_sample(spark, sf_dir):
    return S.capped_sample(V.v_flow(spark, sf_dir), ["Label"], _BALANCED_CAP)


@register(
    "family_sample",
    O.with_views(
        f"""SELECT {_flow_cols_sql()} FROM (
  SELECT *, row_number() OVER (PARTITION BY attack_family ORDER BY {_MD5_ROW}) AS rn FROM v_flow) s
WHERE rn <= {_FAMILY_CAP}""",
        "v_flow",
    ),
)
def q_family_sample(spark, sf_dir):
    return S.capped_sample(V.v_flow(spark, sf_dir), ["attack_family"], _FAMILY_CAP)


@register(
    "bounded_sample",
    O.with_views(
        f"""SELECT row_key, l_quantity, l_extendedprice, l_discount, l_tax, label FROM v_line
ORDER BY md5('42|' || row_key) LIMIT {_BOUNDED_N}""",
        "v_line",
    ),
)
def q_bounded_sample(spark, sf_dir):
    line = V.v_line(spark, sf_dir).select("row_key", *V.LINE_FEATURES, "label")
    return S.bounded_sample(line, _BOUNDED_N, key="row_key")


@register(
    "source_row_ids",
    """SELECT o_orderkey, o_orderstatus,
       CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS BIGINT) AS source_row
FROM orders""",
)
def q_source_row_ids(spark, sf_dir):
    from flowlens.session import read_table

    orders = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus")
    return S.row_number_in_file(orders, "o_orderstatus", "o_orderkey", "source_row")


@register(
    "global_row_ids",
    O.with_views(
        """SELECT CAST(row_number() OVER (ORDER BY source_file, source_row) - 1 AS BIGINT) AS row_id,
       source_file, source_row, attack_family FROM v_flow WHERE attack_family <> 'Benign'""",
        "v_flow",
    ),
)
def q_global_row_ids(spark, sf_dir):
    kept = V.v_flow(spark, sf_dir).where(F.col("attack_family") != "Benign")
    return S.global_row_ids(kept.select("source_file", "source_row", "attack_family"))


_SPLIT_CTES = {
    "cnt": "SELECT attack_family AS stratum, CAST(count(*) AS BIGINT) AS c FROM v_flow GROUP BY 1",
    "tot": "SELECT CAST(sum(c) AS BIGINT) AS n, CAST(sum(c) AS BIGINT) - CAST(ceil(CAST(0.2 AS DOUBLE) * sum(c)) AS BIGINT) AS n_train FROM cnt",
    "al": """SELECT stratum, c, (CAST(c AS HUGEINT) * n_train) // n AS fl, (CAST(c AS HUGEINT) * n_train) % n AS rem,
       n_train FROM cnt, tot""",
    "q": """SELECT stratum, c, c - (fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, stratum)
                    <= n_train - sum(fl) OVER () THEN 1 ELSE 0 END) AS test_q FROM al""",
    "sp": f"""SELECT v.row_id, v.attack_family AS stratum,
       CASE WHEN row_number() OVER (PARTITION BY v.attack_family ORDER BY {_MD5_ROW.replace('row_id', 'v.row_id')}) <= q.test_q
            THEN 'test' ELSE 'train' END AS split
FROM v_flow v JOIN q ON v.attack_family = q.stratum""",
}


def _split(spark, sf_dir):
    flow = V.v_flow(spark, sf_dir)
    stratum = S.choose_stratum(flow)
    return S.stratified_split(flow, stratum).select("row_id", F.col(stratum).alias("stratum"), "split")


@register("stratified_split", O.with_views("SELECT row_id, stratum, split FROM sp", "v_flow", ctes=_SPLIT_CTES))
def q_stratified_split(spark, sf_dir):
    return _split(spark, sf_dir)


@register(
    "split_sizes",
    O.with_views(
        'SELECT stratum, split, CAST(count(*) AS BIGINT) AS "count" FROM sp GROUP BY 1, 2', "v_flow", ctes=_SPLIT_CTES
    ),
)
def q_split_sizes(spark, sf_dir):
    return _split(spark, sf_dir).groupBy("stratum", "split").agg(F.count(F.lit(1)).alias("count"))


# ---------------------------------------------------------------- profile ----

_LINE_FEATS = V.LINE_FEATURES


@register(
    "scaler_params",
    O.with_views(
        "SELECT feature, round(round(mean, 9), 6) AS mean, round(round(std, 9), 6) AS std, "
        "round(round(variance, 5), 2) AS variance, "
        "round(round(CASE WHEN std = 0 THEN 1.0 ELSE std END, 9), 6) AS scale FROM ("
        + "\nUNION ALL ".join(
            f"SELECT '{c}' AS feature, avg({c}) AS mean, sqrt(var_pop({c})) AS std, var_pop({c}) AS variance FROM v_line"
            for c in _LINE_FEATS
        )
        + ") s",
        "v_line",
    ),
)
def q_scaler_params(spark, sf_dir):
    p = P.scaler_params(V.v_line(spark, sf_dir), _LINE_FEATS)
    # Two-step rounding: summation order noise (~1e-17) must not decide a
    # 6th-decimal tie differently in different engines.
    # The variance reaches 1e9 here, where that noise touches the 7th decimal.
    return p.select(
        "feature",
        *[F.round(F.round(c, 9), 6).alias(c) for c in ("mean", "std")],
        F.round(F.round("variance", 5), 2).alias("variance"),
        F.round(F.round("scale", 9), 6).alias("scale"),
    )


@register(
    "scaled_features",
    O.with_views(
        "SELECT row_key, "
        + ", ".join(
            f"round(({c} - (SELECT avg({c}) FROM v_line)) / (SELECT CASE WHEN stddev_pop({c}) = 0 THEN 1.0 "
            f"ELSE stddev_pop({c}) END FROM v_line), 6) AS {c}"
            for c in _LINE_FEATS
        )
        + ", label FROM v_line",
        "v_line",
    ),
)
def q_scaled_features(spark, sf_dir):
    line = V.v_line(spark, sf_dir).select("row_key", *_LINE_FEATS, "label")
    scaled = P.apply_scaler(line, P.fit_scaler(line, _LINE_FEATS))
    return scaled.select("row_key", *[F.round(c, 6).alias(c) for c in _LINE_FEATS], "label")


def _auc_sql(rel: str, feats, label: str) -> str:
    parts = []
    for c in feats:
        parts.append(f"""SELECT '{c}' AS feature, v, pos, neg FROM (
  SELECT CAST({c} AS DOUBLE) AS v, {O.count_if(f'{label} = 1')} AS pos, {O.count_if(f'{label} = 0')} AS neg
  FROM {rel} WHERE {c} IS NOT NULL GROUP BY 1) g""")
    return f"""SELECT feature, CASE WHEN P = 0 OR N = 0 THEN NULL ELSE greatest(a, 1.0 - a) END AS single_feature_auc
FROM (SELECT feature, CAST(sum(pos * (2 * below + neg)) AS DOUBLE) / (2.0 * CAST(sum(pos) AS DOUBLE) * CAST(sum(neg) AS DOUBLE)) AS a,
             sum(pos) AS P, sum(neg) AS N
      FROM (SELECT feature, v, pos, neg,
                   coalesce(sum(neg) OVER (PARTITION BY feature ORDER BY v ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
            FROM ({' UNION ALL '.join(parts)}) u) r
      GROUP BY feature) s"""


@register("single_feature_auc", O.with_views(_auc_sql("v_line", _LINE_FEATS, "label"), "v_line"))
def q_single_feature_auc(spark, sf_dir):
    return P.single_feature_auc(V.v_line(spark, sf_dir), _LINE_FEATS, "label")


@register("single_feature_auc_docs", O.with_views(_auc_sql("v_doc", V.DOC_FEATURES, "label"), "v_doc"))
def q_single_feature_auc_docs(spark, sf_dir):
    return P.single_feature_auc(V.v_doc(spark, sf_dir), V.DOC_FEATURES, "label")


_OVERLAP_FEATS = ("l_quantity", "l_discount", "l_tax")
_TEST_CUT = "'33333'"  # md5 order below this prefix → test (about 20 %)


def _line_split(spark, sf_dir):
    from flowlens.operators.ranking import seeded_order

    line = V.v_line(spark, sf_dir).withColumn("_h", seeded_order(42, "row_key"))
    test = F.col("_h") < F.lit(_TEST_CUT.strip("'"))
    return line.where(~test), line.where(test)


@register(
    "train_test_overlap",
    O.with_views(
        f"""SELECT (SELECT CAST(count(*) AS BIGINT) FROM tr) AS train_rows, (SELECT CAST(count(*) AS BIGINT) FROM te) AS test_rows,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT {', '.join(_OVERLAP_FEATS)}, label FROM tr INTERSECT
                                 SELECT {', '.join(_OVERLAP_FEATS)}, label FROM te) a) AS full_row_overlap,
       (SELECT CAST(count(*) AS BIGINT) FROM (SELECT {', '.join(_OVERLAP_FEATS)} FROM tr INTERSECT
                                 SELECT {', '.join(_OVERLAP_FEATS)} FROM te) b) AS feature_overlap""",
        "v_line",
        ctes={
            "tr": f"SELECT * FROM v_line WHERE NOT md5('42|' || row_key) < {_TEST_CUT}",
            "te": f"SELECT * FROM v_line WHERE md5('42|' || row_key) < {_TEST_CUT}",
        },
    ),
)
def q_train_test_overlap(spark, sf_dir):
    train, test = _line_split(spark, sf_dir)
    return P.train_test_overlap(train, test, _OVERLAP_FEATS, "label")


# ------------------------------------------------------------------- sets ----

from flowlens.operators import examples as X  # noqa: E402
from flowlens.operators import experiments as XP  # noqa: E402
from flowlens.operators import permutation as PM  # noqa: E402
from flowlens.operators import sets as ST  # noqa: E402
from flowlens.session import read_table  # noqa: E402

_LINE_CLASS = "CASE l_returnflag WHEN 'N' THEN ' BENIGN ' WHEN 'R' THEN 'DDoS' ELSE 'PortScan' END"


def _capture(spark, sf_dir, status: str, cols):
    li = read_table(spark, sf_dir, "lineitem").where(F.col("l_linestatus") == status)
    cls = F.when(F.col("l_returnflag") == "N", " BENIGN ").when(F.col("l_returnflag") == "R", "DDoS").otherwise("PortScan")
    return li.select(*cols, cls.alias("Label"))


_BASE_COLS = ("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
_CTRL_COLS = ("l_quantity", "l_discount", "l_tax")


@register(
    "baseline_union",
    f"""SELECT {', '.join(_BASE_COLS)}, 'Benign' AS "Label", 0 AS binary_label FROM lineitem
WHERE l_linestatus = 'O' AND lower(trim({_LINE_CLASS})) = 'benign'
UNION ALL
SELECT {', '.join(_BASE_COLS)}, 'DDoS' AS "Label", 1 AS binary_label FROM lineitem
WHERE l_linestatus = 'F' AND lower(trim({_LINE_CLASS})) = 'ddos'""",
)
def q_baseline_union(spark, sf_dir):
    monday = _capture(spark, sf_dir, "O", _BASE_COLS)
    friday = _capture(spark, sf_dir, "F", _BASE_COLS)
    return ST.class_union([(monday, "benign", "Benign"), (friday, "ddos", "DDoS")])


@register(
    "controlled_union",
    f"""SELECT DISTINCT * FROM (
  SELECT {', '.join(_CTRL_COLS)}, 'Benign' AS "Label" FROM lineitem
  WHERE l_linestatus = 'O' AND lower(trim({_LINE_CLASS})) = 'benign'
  UNION ALL SELECT {', '.join(_CTRL_COLS)}, 'Benign' FROM lineitem
  WHERE l_linestatus = 'F' AND lower(trim({_LINE_CLASS})) = 'benign'
  UNION ALL SELECT {', '.join(_CTRL_COLS)}, 'DDoS' FROM lineitem
  WHERE l_linestatus = 'F' AND lower(trim({_LINE_CLASS})) = 'ddos') u""".replace(
        "SELECT DISTINCT * FROM (", "SELECT *, CASE WHEN lower(\"Label\") = 'benign' THEN 0 ELSE 1 END AS binary_label FROM (SELECT DISTINCT * FROM ("
    )
    + ") d",
)
def q_controlled_union(spark, sf_dir):
    monday = _capture(spark, sf_dir, "O", _CTRL_COLS)
    friday = _capture(spark, sf_dir, "F", _CTRL_COLS)
    return ST.class_union(
        [(monday, "benign", "Benign"), (friday, "benign", "Benign"), (friday, "ddos", "DDoS")], dedup=True
    )


@register(
    "common_columns_union",
    """SELECT name, nationkey, acctbal, 'customer' AS source_file FROM (
  SELECT c_name AS name, c_nationkey AS nationkey, c_acctbal AS acctbal FROM customer) c
UNION ALL SELECT s_name, s_nationkey, s_acctbal, 'supplier' FROM supplier""",
)
def q_common_columns_union(spark, sf_dir):
    from flowlens.functions.names import canonical_name

    def canon(df, prefix):
        return df.toDF(*[canonical_name(c[len(prefix):]) for c in df.columns])

    return ST.union_common(
        {
            "customer": canon(read_table(spark, sf_dir, "customer"), "c_"),
            "supplier": canon(read_table(spark, sf_dir, "supplier"), "s_"),
        }
    )


@register(
    "variant_summary",
    O.with_views(
        f"""SELECT 'main_internal' AS variant, round(accuracy, 4) AS accuracy, round(precision, 4) AS precision,
       round(recall, 4) AS recall, round(f1_score, 4) AS f1_score, samples
FROM ({O.metrics_from('c', 'dataset', extended=False)}) m WHERE dataset = 'internal'
UNION ALL
SELECT 'main_external', round(accuracy, 4), round(precision, 4), round(recall, 4), round(f1_score, 4), NULL
FROM ({O.metrics_from('c', 'dataset', extended=False)}) m WHERE dataset = 'external'""",
        "v_pred",
        ctes={"c": _CONF},
    ),
)
def q_variant_summary(spark, sf_dir):
    m = M.binary_metrics(V.v_pred(spark, sf_dir), ["dataset"], extended=False)
    internal = m.where(F.col("dataset") == "internal").select("accuracy", "precision", "recall", "f1_score", "samples")
    # The external table has no sample count, as in the original summary.
    external = m.where(F.col("dataset") == "external").select("accuracy", "precision", "recall", "f1_score")
    return ST.union_missing(
        {"main_internal": internal, "main_external": external},
        ["accuracy", "precision", "recall", "f1_score", "samples"],
    )


_SEED_CASE = "CASE user_id % 5 " + " ".join(f"WHEN {i} THEN {s}" for i, s in enumerate(XP.SEEDS)) + " END"


def _seed_col():
    expr = F.when(F.lit(False), F.lit(None))
    for i, s in enumerate(XP.SEEDS):
        expr = expr.when(F.col("user_id") % 5 == i, F.lit(s))
    return expr


@register(
    "seed_summary",
    f"""WITH v_pred AS ({O.VIEWS['v_pred']}),
p AS (SELECT v.*, {_SEED_CASE.replace('user_id', 'e.user_id')} AS seed FROM v_pred v JOIN events e ON v.row_id = e.event_id),
c AS (SELECT dataset AS experiment_name, seed, {O.count_if('y_true = 0 AND y_pred = 0')} AS tn,
             {O.count_if('y_true = 0 AND y_pred = 1')} AS fp, {O.count_if('y_true = 1 AND y_pred = 0')} AS fn,
             {O.count_if('y_true = 1 AND y_pred = 1')} AS tp FROM p GROUP BY 1, 2),
m AS ({O.metrics_from('c', 'experiment_name, seed', extended=False)})
SELECT experiment_name,
       round(round(avg(accuracy), 12), 9) AS accuracy_mean, round(round(coalesce(stddev_samp(accuracy), 0.0), 12), 9) AS accuracy_std,
       round(round(avg(precision), 12), 9) AS precision_mean, round(round(coalesce(stddev_samp(precision), 0.0), 12), 9) AS precision_std,
       round(round(avg(recall), 12), 9) AS recall_mean, round(round(coalesce(stddev_samp(recall), 0.0), 12), 9) AS recall_std,
       round(round(avg(f1_score), 12), 9) AS f1_mean, round(round(coalesce(stddev_samp(f1_score), 0.0), 12), 9) AS f1_std
FROM m GROUP BY experiment_name""",
)
def q_seed_summary(spark, sf_dir):
    e = read_table(spark, sf_dir, "events")
    pred = V.v_pred(spark, sf_dir).join(e.select(F.col("event_id").alias("row_id"), _seed_col().alias("seed")), "row_id")
    per_seed = M.binary_metrics(pred, ["dataset", "seed"], extended=False).withColumnRenamed("dataset", "experiment_name")
    s = XP.seed_summary(per_seed)
    return s.select("experiment_name", *[F.round(F.round(c, 12), 9).alias(c) for c in s.columns[1:]])


@register(
    "subset_experiment_counts",
    """SELECT l_returnflag, "count", CAST("count" AS DOUBLE) / sum("count") OVER () AS share,
       CAST(sum("count") OVER () AS BIGINT) AS total_port_rows, CAST(count(*) OVER () AS BIGINT) AS n_classes
FROM (SELECT l_returnflag, CAST(count(*) AS BIGINT) AS "count" FROM lineitem WHERE l_quantity = 25 GROUP BY 1) g""",
)
def q_subset_experiment_counts(spark, sf_dir):
    from pyspark.sql import Window

    sub = read_table(spark, sf_dir, "lineitem").where(F.col("l_quantity") == 25)
    w = Window.partitionBy(F.lit(0))
    return D.value_share(sub, "l_returnflag").select(
        "l_returnflag", "count", "share",
        F.sum("count").over(w).cast("bigint").alias("total_port_rows"),
        F.count(F.lit(1)).over(w).cast("bigint").alias("n_classes"),
    )


_PERM_REPEATS = 5


def _perm_rows(spark, sf_dir):
    return V.v_line(spark, sf_dir).select("row_key", *V.LINE_FEATURES, "label")


_PERM_POS = "SELECT *, row_number() OVER (ORDER BY md5('42|' || row_key)) - 1 AS pos, count(*) OVER () AS n FROM v_line"


@register(
    "permuted_columns",
    O.with_views(
        f"""SELECT t.row_key, m.feature, m.repeat,
  CASE m.feature {' '.join(f"WHEN '{f}' THEN CAST(t.{f} AS DOUBLE)" for f in V.LINE_FEATURES)} END AS value, m.moved AS permuted_value
FROM x8 m JOIN pos t ON t.pos = m.x""",
        "v_line",
        ctes={
            "pos": _PERM_POS,
            "draws": f"""SELECT feature, CAST(repeat AS INTEGER) AS repeat, {O.draw_keys("'42|' || feature || '|' || CAST(repeat AS VARCHAR)")} AS keys
FROM (VALUES {', '.join(f"('{f}')" for f in V.LINE_FEATURES)}) f(feature), range({_PERM_REPEATS}) r(repeat)""",
            "lng": " UNION ALL ".join(
                f"SELECT pos AS x, n, feature, repeat, keys, CAST({f} AS DOUBLE) AS moved FROM pos, draws WHERE feature = '{f}'" for f in V.LINE_FEATURES
            ),
            **O.swap_or_not("lng"),
        },
        materialized=("pos", "draws"),
    ),
)
def q_permuted_columns(spark, sf_dir):
    return PM.permuted_long(_perm_rows(spark, sf_dir), V.LINE_FEATURES, "row_key", _PERM_REPEATS)


_LINE_GROUPS = {"price": ("l_extendedprice", "l_discount", "l_tax"), "size": ("l_quantity", "l_missing")}
_LINE_PRESENT = {g: [f for f in fs if f in V.LINE_FEATURES] for g, fs in _LINE_GROUPS.items()}


@register(
    "group_permuted_columns",
    O.with_views(
        " UNION ALL ".join(
            f"""SELECT t.row_key, m."group", '{f}' AS feature, CAST(t.{f} AS DOUBLE) AS value, CAST(d.{f} AS DOUBLE) AS permuted_value
FROM partner m JOIN pos t ON t.pos = m.x JOIN pos d ON d.pos = m.donor WHERE m."group" = '{g}'"""
            for g, fs in _LINE_PRESENT.items()
            for f in fs
        ),
        "v_line",
        ctes={
            "pos": _PERM_POS,
            "draws": f"""SELECT "group", {O.draw_keys("'42|' || \"group\"")} AS keys FROM (VALUES {', '.join(f"('{g}')" for g in _LINE_PRESENT)}) g("group")""",
            "lng": 'SELECT pos AS x, pos AS donor, n, "group", keys FROM pos, draws',
            **O.swap_or_not("lng"),
            "partner": 'SELECT x, donor, "group" FROM x8',
        },
        materialized=("pos", "draws", "partner"),
    ),
)
def q_group_permuted_columns(spark, sf_dir):
    return PM.group_permuted_long(_perm_rows(spark, sf_dir), _LINE_GROUPS, "row_key")


def _extreme_sql(prefer_correct: bool) -> str:
    c = "CASE WHEN y_true = y_pred THEN 1 ELSE 0 END" if prefer_correct else "0"
    return O.with_views(
        f"""SELECT dataset, example, row_id, attack_probability FROM (
  SELECT dataset, 'attack' AS example, row_id, attack_probability,
         row_number() OVER (PARTITION BY dataset ORDER BY {c} DESC, attack_probability DESC, row_id) AS rn
  FROM v_pred WHERE y_true = 1
  UNION ALL
  SELECT dataset, 'benign', row_id, attack_probability,
         row_number() OVER (PARTITION BY dataset ORDER BY {c} DESC, attack_probability, row_id) AS rn
  FROM v_pred WHERE y_true = 0) r WHERE rn = 1""",
        "v_pred",
    )


@register("extreme_examples", _extreme_sql(False))
def q_extreme_examples(spark, sf_dir):
    return X.extreme_examples(V.v_pred(spark, sf_dir))


@register("local_example_choice", _extreme_sql(True))
def q_local_example_choice(spark, sf_dir):
    return X.extreme_examples(V.v_pred(spark, sf_dir), prefer_correct=True)


_LINE_AGG = """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n_lines, sum(l_quantity) AS sum_qty
FROM lineitem GROUP BY l_orderkey"""


def _line_agg(spark, sf_dir):
    return read_table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.count(F.lit(1)).alias("n_lines"), F.sum("l_quantity").alias("sum_qty")
    )


@register(
    "paired_metadata",
    f"""SELECT o.o_orderkey AS l_orderkey, o.o_orderstatus, o.o_totalprice, a.n_lines, a.sum_qty
FROM orders o JOIN ({_LINE_AGG}) a ON o.o_orderkey = a.l_orderkey""",
)
def q_paired_metadata(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("l_orderkey"), "o_orderstatus", "o_totalprice"
    )
    return ST.pair_by_key(orders, _line_agg(spark, sf_dir), "l_orderkey")


@register(
    "pairing_check",
    f"""SELECT {O.count_if('o.o_orderkey IS NOT NULL AND a.l_orderkey IS NOT NULL')} AS matched,
       {O.count_if('a.l_orderkey IS NULL')} AS left_only, {O.count_if('o.o_orderkey IS NULL')} AS right_only
FROM orders o FULL OUTER JOIN ({_LINE_AGG}) a ON o.o_orderkey = a.l_orderkey""",
)
def q_pairing_check(spark, sf_dir):
    orders = read_table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    return ST.pairing_check(orders, _line_agg(spark, sf_dir).select(F.col("l_orderkey").alias("k")), "k")


def _ablated_pred(spark, sf_dir):
    """Second score for the same rows: the 'ablated model' surrogate."""
    e = read_table(spark, sf_dir, "events").select(
        F.col("event_id").alias("row_id"), (F.get_json_object("props", "$.k").cast("double") / F.lit(100.0)).alias("p2")
    )
    return V.v_pred(spark, sf_dir).join(e, "row_id").withColumn("attack_probability", F.col("p2")).drop("p2")


_CMP_COLS = ("precision", "recall", "f1_score", "specificity", "fp", "fn")


@register(
    "threshold_model_comparison",
    O.with_views(
        f"""SELECT a.dataset, a.threshold, {', '.join(f'a.{c} AS {c}_original' for c in _CMP_COLS)},
       {', '.join(f'b.{c} AS {c}_ablation' for c in _CMP_COLS)}
FROM ({O.metrics_from('c1', 'dataset, threshold')}) a
JOIN ({O.metrics_from('c2', 'dataset, threshold')}) b ON a.dataset = b.dataset AND a.threshold = b.threshold""",
        "v_pred",
        ctes={
            "p2": "SELECT v.*, CAST(json_extract_string(e.props, '$.k') AS DOUBLE) / CAST(100.0 AS DOUBLE) AS p2 "
            "FROM v_pred v JOIN events e ON v.row_id = e.event_id",
            "c1": f"""SELECT dataset, threshold, {O.count_if('y_true = 0')} - {O.count_if(f'y_true = 0 AND {_HIT}')} AS tn,
       {O.count_if(f'y_true = 0 AND {_HIT}')} AS fp, {O.count_if('y_true = 1')} - {O.count_if(f'y_true = 1 AND {_HIT}')} AS fn,
       {O.count_if(f'y_true = 1 AND {_HIT}')} AS tp FROM v_pred CROSS JOIN {O.thresholds_values()} GROUP BY 1, 2""",
            "c2": f"""SELECT dataset, threshold, {O.count_if('y_true = 0')} - {O.count_if('y_true = 0 AND p2 >= threshold')} AS tn,
       {O.count_if('y_true = 0 AND p2 >= threshold')} AS fp, {O.count_if('y_true = 1')} - {O.count_if('y_true = 1 AND p2 >= threshold')} AS fn,
       {O.count_if('y_true = 1 AND p2 >= threshold')} AS tp FROM p2 CROSS JOIN {O.thresholds_values()} GROUP BY 1, 2""",
        },
    ),
)
def q_threshold_model_comparison(spark, sf_dir):
    a = M.threshold_sweep(V.v_pred(spark, sf_dir)).select("dataset", "threshold", *_CMP_COLS)
    b = M.threshold_sweep(_ablated_pred(spark, sf_dir)).select("dataset", "threshold", *_CMP_COLS)
    return ST.compare_on(a, b, ["dataset", "threshold"])


# ------------------------------------------------------------------ models ----

from flowlens.operators import attribution as AT  # noqa: E402
from flowlens.operators import importance as IM  # noqa: E402
from flowlens.operators import model as ML  # noqa: E402
from flowlens.session import stored  # noqa: E402

# Small forests for the registered checks (the library default is 50 × 15).
_TREES, _DEPTH = 10, 5


def _flow_split(spark, sf_dir):
    """The stratified split, written once per query; train, test and every
    later reader scan the stored table."""
    flow = V.v_flow(spark, sf_dir)
    split = stored(S.stratified_split(flow, S.choose_stratum(flow)), "flow-split")
    return split.where(F.col("split") == "train"), split.where(F.col("split") == "test")


def _split_for_fits(rows, features):
    """The stratified split for several fits: the training rows in the layout of
    the fits, the test rows stored, each written once."""
    split = S.stratified_split(rows, S.choose_stratum(rows))
    train = ML.laid_out(split.where(F.col("split") == "train").select("row_id", *features, "Label"))
    return train, stored(split.where(F.col("split") == "test"), "test-split")


def _fit(train, features=V.FLOW_FEATURES, seed=42, balanced=True, laid_out=False):
    cfg = ML.ForestConfig(tuple(features), num_trees=_TREES, max_depth=_DEPTH, seed=seed, balanced=balanced, laid_out=laid_out)
    return ML.fit_forest(train, cfg)


@register("forest_score")
def q_forest_score(spark, sf_dir):
    train, test = _flow_split(spark, sf_dir)
    scored = ML.score(_fit(train), test)
    return scored.select("row_id", "dataset", "attack_family", "y_true", "y_pred", "attack_probability")


@register("forest_importance")
def q_forest_importance(spark, sf_dir):
    train, _ = _flow_split(spark, sf_dir)
    return ML.gini_importance(spark, _fit(train), V.FLOW_FEATURES)


@register("external_eval")
def q_external_eval(spark, sf_dir):
    """Trained on the internal half's training split; evaluated on the
    internal test split and on the whole external half, without refit."""
    train, test = _flow_split(spark, sf_dir)
    internal = F.col("dataset") == "internal"
    evalset = test.union(train.where(~internal))
    return M.binary_metrics(ML.score(_fit(train.where(internal)), evalset), ["dataset"])


@register("multi_seed")
def q_multi_seed(spark, sf_dir):
    train, test = _split_for_fits(V.v_flow(spark, sf_dir), V.FLOW_FEATURES)
    per_seed = None
    for seed in XP.SEEDS:
        m = M.binary_metrics(ML.score(_fit(train, seed=seed, balanced=False, laid_out=True), test), extended=False)
        m = m.select(F.lit("Baseline").alias("experiment_name"), F.lit(seed).alias("seed"), *m.columns)
        per_seed = m if per_seed is None else per_seed.unionByName(m)
    return XP.seed_summary(per_seed)


_FLOW_GROUPS = {"time": ("hour",), "volume": ("value", "k"), "identity": ("user_id",)}


@register("permutation_importance")
def q_permutation_importance(spark, sf_dir):
    """Over the whole test split."""
    train, test = _flow_split(spark, sf_dir)
    return IM.permutation_importance(_fit(train), test, V.FLOW_FEATURES, "row_id")


def _attribution(spark, sf_dir):
    """Attributions of every row of the test split."""
    train, test = _flow_split(spark, sf_dir)
    return AT.attribution_long(spark, _fit(train), test, V.FLOW_FEATURES, "row_id", keep=("dataset", "attack_family"))


@register("tree_attribution")
def q_tree_attribution(spark, sf_dir):
    return _attribution(spark, sf_dir)


@register("attribution_importance")
def q_attribution_importance(spark, sf_dir):
    return AT.mean_abs_by_feature(_attribution(spark, sf_dir))


@register("attribution_by_family")
def q_attribution_by_family(spark, sf_dir):
    return AT.mean_abs_by_group(_attribution(spark, sf_dir), ["dataset", "attack_family"], "row_id")


@register("local_examples")
def q_local_examples(spark, sf_dir):
    train, test = _flow_split(spark, sf_dir)
    model = _fit(train)
    trees = AT.pack_forest(spark, model)
    chosen = X.extreme_examples(ML.score(model, test), prefer_correct=True).select("row_id", "dataset", "example")
    rows = test.join(chosen.select("row_id", "example"), "row_id")
    long = AT.attribution_long(spark, trees, rows, V.FLOW_FEATURES, "row_id", keep=("example",))
    return AT.local_explanations(long.drop("example"), chosen, "row_id", AT.expected_value(trees))


@register("dependence_data")
def q_dependence_data(spark, sf_dir):
    # Read twice (the ranking of features, then their rows): computed once.
    return AT.dependence_data(stored(_attribution(spark, sf_dir), "attribution"), 2)


# --------------------------------------------------------------- streaming ----

import uuid  # noqa: E402

from flowlens.session import ensure_checkpoint_dir, table_path  # noqa: E402
from flowlens.streaming import flows as SF  # noqa: E402


def _event_stream(spark, sf_dir):
    schema = read_table(spark, sf_dir, "events").schema
    # A glob keeps the source a directory listing filtered to the events file.
    return SF.read_stream(spark, f"{sf_dir.rstrip('/')}/event[s].parquet", schema)


def _pred_from_events(e):
    family = V.event_family(F.col("event_type"))
    prob = F.col("value") / F.lit(500.0)
    from flowlens.functions.labels import binary_from_family

    return e.select(
        F.col("event_id").alias("row_id"),
        F.when(F.col("user_id") % 2 == 0, F.lit("internal")).otherwise(F.lit("external")).alias("dataset"),
        family.alias("attack_family"),
        binary_from_family(family).alias("y_true"),
        prob.alias("attack_probability"),
    )


def _drain(spark, df, mode):
    name = f"flowlens_{uuid.uuid4().hex[:12]}"
    ckpt = f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{name}"
    SF.drain_to_memory(df, name, ckpt, mode)
    return spark.table(name)


@register(
    "stream_confusion",
    O.with_views(
        "SELECT dataset, attack_family, threshold, tn, fp, fn, tp FROM cf",
        "v_pred",
        ctes={"cf": _COUNTS_BY_THRESHOLD},
    ),
)
def q_stream_confusion(spark, sf_dir):
    counts = SF.running_threshold_counts(_pred_from_events(_event_stream(spark, sf_dir)))
    return _drain(spark, counts, "complete").select("dataset", "attack_family", "threshold", "tn", "fp", "fn", "tp")


@register(
    "stream_label_counts",
    O.with_views('SELECT dataset, attack_family, CAST(count(*) AS BIGINT) AS "count" FROM v_pred GROUP BY 1, 2', "v_pred"),
)
def q_stream_label_counts(spark, sf_dir):
    return _drain(spark, SF.running_counts(_pred_from_events(_event_stream(spark, sf_dir)), ["dataset", "attack_family"]), "complete")


@register("stream_score")
def q_stream_score(spark, sf_dir):
    train, _ = _flow_split(spark, sf_dir)
    model = _fit(train)
    e = _event_stream(spark, sf_dir)
    family = V.event_family(F.col("event_type"))
    from flowlens.functions.labels import binary_from_family

    flow = e.select(
        F.col("event_id").alias("row_id"),
        F.col("value").cast("double").alias("value"),
        F.col("user_id").cast("double").alias("user_id"),
        F.hour("ts").cast("double").alias("hour"),
        F.get_json_object("props", "$.k").cast("double").alias("k"),
        binary_from_family(family).alias("Label"),
    )
    scored = SF.stream_scores(flow, model).select("row_id", "y_true", "y_pred", "attack_probability")
    base = f"{ensure_checkpoint_dir(spark).rstrip('/')}/scores-{uuid.uuid4().hex}"
    SF.drain_to_files(scored, f"{base}/rows", f"{base}/progress")
    return spark.read.schema(scored.schema).parquet(f"{base}/rows")


@register("subset_experiment")
def q_subset_experiment(spark, sf_dir):
    """ML-9 on the flows: one hour of day only, that column dropped."""
    flow = V.v_flow(spark, sf_dir)
    return XP.subset_experiment(
        flow, F.col("hour") == 8, ["hour"], V.FLOW_FEATURES, num_trees=_TREES, max_depth=_DEPTH
    )


@register(
    "distribution_tables",
    O.with_views(
        """SELECT CASE GROUPING("Label", attack_family, original_label) WHEN 3 THEN 'class' WHEN 5 THEN 'family'
            ELSE 'label' END AS "table", "Label", attack_family, original_label, CAST(count(*) AS BIGINT) AS "count"
FROM v_flow GROUP BY GROUPING SETS (("Label"), (attack_family), (attack_family, original_label))""",
        "v_flow",
    ),
)
def q_distribution_tables(spark, sf_dir):
    return D.distribution_tables(V.v_flow(spark, sf_dir))
