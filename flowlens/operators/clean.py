"""Cell coercion, row cleaning and the cleaning reports (PRJ-8..11, SCL-11,
FLT-1..4, AGG-3..5, AGG-18).

Raw captures arrive as text. Coercion is a projection (``coerce_number``);
decisions that shape the output schema — which columns are non-numeric in a
file, which columns are numeric at all — come from one aggregate whose size
is (files × columns), collected to the driver as metadata. Row data never
leaves the executors.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions import labels as L
from flowlens.functions.numeric import coerce_number, is_finite, is_infinite, is_missing_text
from flowlens.session import stored

METADATA_COLUMNS = ("dataset", "source_file", "source_row", "original_label", "attack_family")


def _count_if(cond: Column) -> Column:
    return F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("bigint")


def coerce_columns(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = (), strict: bool = False) -> DataFrame:
    """Every listed text column → DOUBLE (NULL when not a number, ±Inf kept).

    ``strict`` (PRJ-11) ends the job at the first cell that is given but is no
    number, naming its column; the check is part of the same projection."""

    def cell(c: str) -> Column:
        x, number = F.col(c), coerce_number(F.col(c))
        if strict:
            told = F.concat(F.lit(f"non-numeric cell in column {c}: "), x)
            number = F.when(number.isNotNull() | is_missing_text(x), number).otherwise(F.raise_error(told).cast("double"))
        return number.alias(c)

    return df.select(*keep, *[cell(c) for c in columns])


@dataclass(frozen=True)
class PreparedFlows:
    data: DataFrame
    report: DataFrame
    features: list[str]


def prepare_flows(
    raw: DataFrame,
    dataset: str,
    candidates: Sequence[str],
    label: str = "label",
    file_col: str = "source_file",
    row_col: str = "source_row",
    families: Sequence[str] = L.INCLUDED_FAMILIES,
    duplicate_columns: dict[str, list[str]] | None = None,
    absent: dict[str, list[str]] | None = None,
    files: Sequence[str] = (),
) -> PreparedFlows:
    """Label filter, per-file numeric coercion and cleaning, common features.

    Per file (as in the original study): a candidate column whose non-missing
    cells all fail to parse is dropped for that file; a row is clean when
    every remaining column is finite; files left without rows do not vote
    on the common feature set, which keeps the order of ``candidates``.
    ``files`` names all inputs: one without data rows (a header only) gets a
    report row of zeros.
    """
    parsed = raw.select(
        F.col(file_col).alias("source_file"),
        F.col(row_col).alias("source_row"),
        L.label_text(F.col(label)).alias("original_label"),
        L.normalize_label(F.col(label)).alias("_label"),
        *[(~is_missing_text(F.col(c))).alias(f"_given{i}") for i, c in enumerate(candidates)],
        *[coerce_number(F.col(c)).alias(f"_num{i}") for i, c in enumerate(candidates)],
    ).withColumn("attack_family", L.family_of(F.col("_label"))).drop("_label")
    # Text is parsed once: statistics, row filter and output read this table.
    flagged = stored(parsed.withColumn("_keep", F.col("attack_family").isin(*families)), "parsed-flows")
    # Pass 1 (metadata): which columns are non-numeric in which file.
    col_stats = flagged.groupBy("source_file").agg(
        *[_count_if(F.col("_keep") & F.col(f"_given{i}")).alias(f"nn_{i}") for i in range(len(candidates))],
        *[_count_if(F.col("_keep") & F.col(f"_num{i}").isNotNull()).alias(f"num_{i}") for i, c in enumerate(candidates)],
    )
    # Columns a file does not have at all count as dropped for that file.
    dropped: dict[str, list[str]] = {c: list((absent or {}).get(c, [])) for c in candidates}
    for row in col_stats.collect():
        for i, c in enumerate(candidates):
            if row[f"num_{i}"] == 0 and row[f"nn_{i}"] > 0 and row["source_file"] not in dropped[c]:
                dropped[c].append(row["source_file"])

    def dropped_in_file(c: str) -> Column:
        files = dropped[c]
        return F.col("source_file").isin(*files) if files else F.lit(False)

    clean = F.col("_keep")
    for i, c in enumerate(candidates):
        clean = clean & (dropped_in_file(c) | is_finite(F.col(f"_num{i}")))
    flagged = flagged.withColumn("_clean", clean)

    dup = duplicate_columns or {}
    dup_text = F.lit("")
    if dup:
        dup_text = F.coalesce(
            F.element_at(F.create_map(*[x for f, cols in dup.items() for x in (F.lit(f), F.lit(";".join(cols)))]), F.col("source_file")),
            F.lit(""),
        )
    report = flagged.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("rows_before"),
        _count_if(F.col("_keep")).alias("rows_after_label_filter"),
        _count_if(F.col("_clean")).alias("rows_after_cleaning"),
    )
    if files:
        listed = raw.sparkSession.createDataFrame([(f,) for f in files], "source_file string")
        report = listed.join(report, "source_file", "full").fillna(0)
    report = report.select(
        F.col("source_file").alias("file"),
        F.lit(dataset).alias("dataset"),
        "rows_before",
        "rows_after_label_filter",
        "rows_after_cleaning",
        (F.col("rows_before") - F.col("rows_after_label_filter")).alias("removed_label_rows"),
        (F.col("rows_after_label_filter") - F.col("rows_after_cleaning")).alias("removed_cleaning_rows"),
        dup_text.alias("dropped_duplicate_columns"),
        F.concat_ws(";", *[F.when(dropped_in_file(c), F.lit(c)) for c in candidates]).alias(
            "dropped_non_numeric_columns"
        ),
    )
    # Pass 2 (metadata): files that keep rows decide the common features.
    non_empty = [r["file"] for r in report.where(F.col("rows_after_cleaning") > 0).select("file").collect()]
    if not non_empty:
        raise ValueError(f"No usable rows found in {dataset}")
    features = [c for c in candidates if not any(f in dropped[c] for f in non_empty)]
    if not features:
        raise ValueError(f"No common numeric feature columns found in {dataset}")
    data = flagged.where(F.col("_clean")).select(
        *[F.col(f"_num{candidates.index(c)}").alias(c) for c in features],
        L.binary_from_family(F.col("attack_family")).alias("Label"),
        F.lit(dataset).alias("dataset"),
        "source_file",
        "source_row",
        "original_label",
        "attack_family",
    )
    return PreparedFlows(data, report, features)


def numeric_columns(raw: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns a type-inferring reader would load as numbers: every
    non-missing cell parses (one aggregate, collected as metadata)."""
    bad = raw.agg(
        *[_count_if(~is_missing_text(F.col(c)) & coerce_number(F.col(c)).isNull()).alias(c) for c in columns]
    ).first()
    return [c for c in columns if bad[c] == 0]


def _missing(c: str, numeric: bool) -> Column:
    x = F.col(c)
    return coerce_number(x).isNull() if numeric else is_missing_text(x)


def cleaning_stats(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows and missing/infinite cells before and after the legacy cleaning
    (±Inf → missing, then drop rows with any missing cell) — one pass.

    Infinite cells are counted on numeric columns only, before replacement.
    """
    numeric = set(numeric_columns(raw, columns))
    missing_cells = [F.when(_missing(c, c in numeric), 1).otherwise(0) for c in columns]
    inf_cells = [F.when(is_infinite(coerce_number(F.col(c))), 1).otherwise(0) for c in columns if c in numeric]
    row_ok = F.lit(True)
    for c in columns:
        row_ok = row_ok & (is_finite(coerce_number(F.col(c))) if c in numeric else ~is_missing_text(F.col(c)))
    total = lambda cells: sum(cells[1:], cells[0]) if cells else F.lit(0)
    agg = raw.agg(
        F.count(F.lit(1)).alias("rows_before"),
        _count_if(row_ok).alias("rows_after"),
        F.sum(total(missing_cells)).cast("bigint").alias("missing_before"),
        F.sum(total(inf_cells)).cast("bigint").alias("infinite_before"),
        # counted again over the rows that stay
        F.sum(F.when(row_ok, total(missing_cells)).otherwise(0)).cast("bigint").alias("missing_after"),
        F.sum(F.when(row_ok, total(inf_cells)).otherwise(0)).cast("bigint").alias("infinite_after"),
    )
    return agg.select(
        "rows_before",
        "rows_after",
        (F.col("rows_before") - F.col("rows_after")).alias("removed_rows"),
        "missing_before",
        "infinite_before",
        "missing_after",
        "infinite_after",
    )


def clean_legacy(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """FLT-3: drop rows with any missing or infinite cell (label included)."""
    numeric = set(numeric_columns(raw, columns))
    row_ok = F.lit(True)
    out = []
    for c in columns:
        if c in numeric:
            row_ok = row_ok & is_finite(coerce_number(F.col(c)))
            out.append(coerce_number(F.col(c)).alias(c))
        else:
            row_ok = row_ok & ~is_missing_text(F.col(c))
            out.append(F.col(c))
    return raw.where(row_ok).select(*out)


def missing_inf_profile(raw: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column, before and after cleaning: missing and infinite cells,
    non-zero entries only. Only +Inf is replaced (the diagnostic variant),
    so -Inf cells survive into the 'after' counts."""
    numeric = set(numeric_columns(raw, columns))
    row_ok = F.lit(True)
    for c in columns:
        v = coerce_number(F.col(c))
        if c in numeric:
            row_ok = row_ok & v.isNotNull() & ~F.isnan(v) & (v != F.lit(float("inf")))
        else:
            row_ok = row_ok & ~is_missing_text(F.col(c))
    aggs = []
    for i, c in enumerate(columns):
        miss = _missing(c, c in numeric)
        aggs.append(_count_if(miss).alias(f"mb_{i}"))
        aggs.append(_count_if(row_ok & miss).alias(f"ma_{i}"))
        if c in numeric:
            inf = is_infinite(coerce_number(F.col(c)))
            aggs.append(_count_if(inf).alias(f"ib_{i}"))
            aggs.append(_count_if(row_ok & inf).alias(f"ia_{i}"))
    one = raw.agg(*aggs)
    entries = []
    for i, c in enumerate(columns):
        for stage, suffix in (("before", "b"), ("after", "a")):
            entries.append(F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("column"), F.lit("missing").alias("kind"), F.col(f"m{suffix}_{i}").alias("cells")))
            if c in numeric:
                entries.append(F.struct(F.lit(stage).alias("stage"), F.lit(c).alias("column"), F.lit("infinite").alias("kind"), F.col(f"i{suffix}_{i}").alias("cells")))
    return one.select(F.explode(F.array(*entries)).alias("e")).select("e.*").where(F.col("cells") > 0)


def drop_duplicate_rows(df: DataFrame) -> DataFrame:
    """Exact duplicates over all columns (NaN = NaN, -0.0 = 0.0)."""
    return df.dropDuplicates()


def dedup_report(df: DataFrame) -> DataFrame:
    """rows before/after de-duplication, removed and removed percent.

    One scan and one shuffle: copies are counted per distinct row, then summed;
    the percent is a guarded ratio × 100.
    """
    copies = df.groupBy(*[F.col(f"`{c}`") for c in df.columns]).agg(F.count(F.lit(1)).alias("_copies"))
    both = copies.agg(
        F.coalesce(F.sum("_copies"), F.lit(0)).cast("bigint").alias("rows_before"), F.count(F.lit(1)).alias("rows_after")
    )
    removed = F.col("rows_before") - F.col("rows_after")
    return both.select(
        "rows_before",
        "rows_after",
        removed.alias("removed_rows"),
        F.when(F.col("rows_before") == 0, F.lit(0.0)).otherwise(removed / F.col("rows_before") * F.lit(100)).alias("removed_percent"),
    )
