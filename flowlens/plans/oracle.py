"""DuckDB SQL for the registered queries (the correctness oracle).

Each statement is self-contained: it re-declares the surrogate views of
``flowlens.plans.views`` as CTEs over the pre-registered driver tables and
then states the query in plain SQL (brute-force windows where the Spark side
uses the skew-safe form). Integer counts are cast to BIGINT (DuckDB sums
are HUGEINT) and literals to DOUBLE (DuckDB literals are DECIMAL).
"""

from __future__ import annotations

from flowlens.functions.numeric import DEFAULT_THRESHOLDS
from flowlens.plans.views import EVENT_FAMILY, RAW_LABELS


def _q(text: str | None) -> str:
    if text is None:
        return "NULL"
    return "'" + text.replace("'", "''") + "'"


def _family_case(col: str) -> str:
    whens = " ".join(f"WHEN {col} = {_q(e)} THEN {_q(f)}" for e, f in EVENT_FAMILY)
    return f"CASE {whens} ELSE 'Other' END"


_FAMILY = _family_case("event_type")
_YTRUE = "CAST(CASE WHEN event_type = 'view' THEN 0 ELSE 1 END AS INTEGER)"
_DATASET = "CASE WHEN user_id % 2 = 0 THEN 'internal' ELSE 'external' END"
_SOURCE_FILE = "'part-' || CAST(user_id % 8 AS VARCHAR)"
_RAW_LABEL = f"list_value({', '.join(_q(x) for x in RAW_LABELS)})[event_id % {len(RAW_LABELS)} + 1]"

VIEWS = {
    "v_pred": f"""
  SELECT event_id AS row_id, {_DATASET} AS dataset, {_SOURCE_FILE} AS source_file,
         event_id AS source_row, event_type AS original_label, {_FAMILY} AS attack_family,
         {_YTRUE} AS y_true, value / CAST(500.0 AS DOUBLE) AS attack_probability,
         CAST(CASE WHEN value / CAST(500.0 AS DOUBLE) > CAST(0.5 AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS y_pred
  FROM events""",
    "v_flow": f"""
  SELECT event_id AS row_id, CAST(value AS DOUBLE) AS value, CAST(user_id AS DOUBLE) AS user_id,
         CAST(hour(ts) AS DOUBLE) AS hour, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k,
         {_YTRUE} AS "Label", {_DATASET} AS dataset, {_SOURCE_FILE} AS source_file,
         event_id AS source_row, event_type AS original_label, {_FAMILY} AS attack_family
  FROM events""",
    "v_raw": f"""
  SELECT {_SOURCE_FILE} AS source_file, event_id AS source_row, {_RAW_LABEL} AS label,
         CASE WHEN event_id % 97 = 0 THEN 'Infinity' WHEN event_id % 83 = 0 THEN 'NaN'
              ELSE CAST(value AS VARCHAR) END AS c_value,
         CASE WHEN event_id % 89 = 0 THEN '-Infinity' WHEN event_id % 79 = 0 THEN ''
              ELSE CAST(user_id AS VARCHAR) END AS c_user,
         CASE WHEN event_id % 73 = 0 THEN 'abc' WHEN event_id % 71 = 0 THEN ' 2.5' WHEN event_id % 67 = 0 THEN '1d'
              ELSE CAST(hour(ts) AS VARCHAR) END AS c_hour,
         CASE WHEN event_id % 61 = 0 THEN 'NA' WHEN event_id % 59 = 0 THEN 'inf' WHEN event_id % 53 = 0 THEN '+5'
              WHEN event_id % 47 = 0 THEN '1e3' ELSE json_extract_string(props, '$.k') END AS c_k,
         'x' || CAST(event_id % 3 AS VARCHAR) AS c_text,
         CASE WHEN user_id % 8 = 3 THEN NULL ELSE CAST(event_id % 5 AS VARCHAR) END AS c_sparse
  FROM events""",
    "v_label": f"""
  SELECT event_id AS row_id, {_RAW_LABEL} AS raw_label FROM events""",
    "v_line": """
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate,
         l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
         CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS INTEGER) AS label,
         concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(l_extendedprice AS VARCHAR), strftime(l_shipdate, '%Y-%m-%d')) AS row_key
  FROM lineitem""",
    "v_doc": """
  SELECT d.doc_id, CAST(d.n_chars AS DOUBLE) AS n_chars,
         CAST(length(d.text) - length(replace(d.text, chr(10), '')) + 1 AS DOUBLE) AS n_lines,
         CAST(length(regexp_replace(d.text, '[^0-9]', '', 'g')) AS DOUBLE) AS n_digits,
         CAST(length(regexp_replace(d.text, '[^A-Z]', '', 'g')) AS DOUBLE) AS n_upper,
         d.source, d.lang, CAST(l.quality AS INTEGER) AS label, l.toxic
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def with_views(body: str, *names: str, ctes: dict[str, str] | None = None, materialized: tuple[str, ...] = ()) -> str:
    """``WITH <views>, <ctes> <body>``; views first, extra CTEs in order."""
    parts = [f"{n} AS ({VIEWS[n]}\n)" for n in names]
    parts += [f"{n} AS MATERIALIZED (\n{text}\n)" if n in materialized else f"{n} AS (\n{text}\n)" for n, text in (ctes or {}).items()]
    return ("WITH " + ",\n".join(parts) + "\n" + body) if parts else body


def swap_or_not(rel: str, rounds: int = 8, prime: int = 2**31 - 1) -> dict[str, str]:
    """CTEs x0 .. x<rounds>: positions ``x`` of ``rel`` (x, n, keys, ...) carried
    through a swap-or-not shuffle, one round a CTE."""
    out = {"x0": f"SELECT * FROM {rel}"}
    for i in range(1, rounds + 1):
        out[f"x{i}"] = f"""SELECT * EXCLUDE (x, other, top),
  CASE WHEN (top * top + (keys[{i}] % {prime}) * top + (keys[{i}] // {prime}) % {prime}) % {prime} % 2 = 1 THEN other ELSE x END AS x
FROM (SELECT *, greatest(x, other) % {prime} AS top FROM (SELECT *, (keys[{i}] % n - x + n) % n AS other FROM x{i - 1}) y) z"""
    return out


def draw_keys(text: str, rounds: int = 8) -> str:
    """List of 60 bits of md5 per round, for the draw named by ``text``."""
    return f"list_transform(range({rounds}), lambda i: CAST('0x' || substr(md5({text} || '|' || CAST(i AS VARCHAR)), 1, 15) AS BIGINT))"


def ratio(num: str, den: str) -> str:
    return f"CASE WHEN ({den}) = 0 THEN CAST(0.0 AS DOUBLE) ELSE CAST({num} AS DOUBLE) / ({den}) END"


def count_if(cond: str) -> str:
    return f"CAST(SUM(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT)"


def metric_columns(extended: bool = True) -> str:
    """Metric projections over a relation with tn, fp, fn, tp (two levels)."""
    return "accuracy, precision, recall, f1_score" + (", specificity, balanced_accuracy" if extended else "")


def metrics_from(rel: str, keys: str, extended: bool = True, keep: str = "") -> str:
    """SELECT keys, tn.., samples, metrics FROM rel (rel has tn fp fn tp)."""
    ext = (
        f", {ratio('tn', 'tn + fp')} AS specificity" if extended else ""
    )
    inner = f"""SELECT {keys + ', ' if keys else ''}{keep + ', ' if keep else ''}tn, fp, fn, tp,
         CAST(tn + fp + fn + tp AS BIGINT) AS samples,
         {ratio('tp + tn', 'tn + fp + fn + tp')} AS accuracy,
         {ratio('tp', 'tp + fp')} AS precision,
         {ratio('tp', 'tp + fn')} AS recall{ext}
  FROM {rel}"""
    bal = ", (recall + specificity) / CAST(2 AS DOUBLE) AS balanced_accuracy" if extended else ""
    return f"""SELECT *, CASE WHEN precision + recall = 0 THEN CAST(0.0 AS DOUBLE)
              ELSE 2 * precision * recall / (precision + recall) END AS f1_score{bal}
  FROM ({inner}) m0"""


def thresholds_values(thresholds=DEFAULT_THRESHOLDS) -> str:
    rows = ", ".join(f"(CAST({t!r} AS DOUBLE))" for t in sorted(set(thresholds), reverse=True))
    return f"(VALUES {rows}) th(threshold)"


# ------------------------------------------------------------- cleaning ----

# Fixed values, stated here on their own so that the SQL does not share the
# library's lists: texts that mean a missing cell.
_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)


def missing_text(c: str) -> str:
    return f"coalesce({c} IN ({', '.join(_q(t) for t in _MISSING)}), TRUE)"


def num(c: str) -> str:
    """Text → DOUBLE as ``coerce_number``: NULL for missing / non-numbers."""
    t = f"regexp_replace({c}, '^\\s+|\\s+$', '', 'g')"
    return (
        f"(CASE WHEN {missing_text(c)} THEN NULL "
        f"WHEN lower({t}) IN ('inf', '+inf', 'infinity', '+infinity') THEN CAST('Infinity' AS DOUBLE) "
        f"WHEN lower({t}) IN ('-inf', '-infinity') THEN CAST('-Infinity' AS DOUBLE) "
        f"WHEN regexp_full_match({t}, '[-+]?([0-9]+[.]?|[0-9]*[.][0-9]+)([eE][-+]?[0-9]+)?') THEN TRY_CAST({t} AS DOUBLE) END)"
    )


def finite(x: str) -> str:
    return f"({x} IS NOT NULL AND NOT isnan({x}) AND NOT isinf({x}))"


def norm_label(c: str) -> str:
    return f"trim(regexp_replace(lower(trim(coalesce({c}, 'nan'))), '[^a-z0-9]+', ' ', 'g'))"
