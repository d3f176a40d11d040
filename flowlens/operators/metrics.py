"""Binary-classification accounting over prediction tables (AGG-6..13).

Every operator is one aggregate with conditional integer sums (partial
aggregation map-side, a tiny final aggregate), followed by ratio projections
on the few result rows. Counts stay integers until the last division so the
doubles are the same in every engine.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.functions.numeric import DEFAULT_THRESHOLDS, parse_thresholds, safe_divide

LABEL_NAMES = {0: "Benign", 1: "Attack"}


def _count_if(cond: Column) -> Column:
    # 0, not NULL, when there is no row at all
    return F.coalesce(F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))), F.lit(0)).cast("bigint")


def confusion_counts(
    pred: DataFrame,
    group_by: Sequence[str] = (),
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """Always four cells (tn, fp, fn, tp) per group, even when a cell is 0."""
    t, p = F.col(y_true), F.col(y_pred)
    aggs = [
        _count_if((t == 0) & (p == 0)).alias("tn"),
        _count_if((t == 0) & (p == 1)).alias("fp"),
        _count_if((t == 1) & (p == 0)).alias("fn"),
        _count_if((t == 1) & (p == 1)).alias("tp"),
    ]
    return pred.groupBy(*group_by).agg(*aggs)


def confusion_matrix(pred: DataFrame, group_by: Sequence[str] = (), **cols) -> DataFrame:
    """Long 2×2 table: ``true_class``, ``pred_benign``, ``pred_attack``."""
    c = confusion_counts(pred, group_by, **cols)
    rows = F.explode(
        F.array(
            F.struct(F.lit("true_benign").alias("true_class"), F.col("tn").alias("pred_benign"), F.col("fp").alias("pred_attack")),
            F.struct(F.lit("true_attack").alias("true_class"), F.col("fn").alias("pred_benign"), F.col("tp").alias("pred_attack")),
        )
    )
    return c.select(*group_by, rows.alias("r")).select(*group_by, "r.*")


def with_metrics(counts: DataFrame, extended: bool = False) -> DataFrame:
    """Add accuracy/precision/recall/F1 (and specificity, balanced accuracy)."""
    tn, fp, fn, tp = (F.col(c) for c in ("tn", "fp", "fn", "tp"))
    samples = tn + fp + fn + tp
    precision = safe_divide(tp, tp + fp)
    recall = safe_divide(tp, tp + fn)
    out = (
        counts.withColumn("samples", samples.cast("bigint"))
        .withColumn("accuracy", safe_divide(tp + tn, samples))
        .withColumn("precision", precision)
        .withColumn("recall", recall)
    )
    p, r = F.col("precision"), F.col("recall")
    out = out.withColumn("f1_score", safe_divide(F.lit(2) * p * r, p + r))
    if extended:
        out = out.withColumn("specificity", safe_divide(tn, tn + fp)).withColumn(
            "balanced_accuracy", (F.col("recall") + F.col("specificity")) / F.lit(2)
        )
    return out


def binary_metrics(pred: DataFrame, group_by: Sequence[str] = (), extended: bool = True, **cols) -> DataFrame:
    return with_metrics(confusion_counts(pred, group_by, **cols), extended=extended)


def classification_report(pred: DataFrame, group_by: Sequence[str] = (), **cols) -> DataFrame:
    """Per-class precision/recall/F1/support plus accuracy, macro and weighted rows."""
    c = confusion_counts(pred, group_by, **cols)
    tn, fp, fn, tp = (F.col(x) for x in ("tn", "fp", "fn", "tp"))

    def prf(tp_, fp_, fn_):
        p = safe_divide(tp_, tp_ + fp_)
        r = safe_divide(tp_, tp_ + fn_)
        return p, r

    p0, r0 = prf(tn, fn, fp)
    p1, r1 = prf(tp, fp, fn)
    c = c.select(
        *group_by, "tn", "fp", "fn", "tp",
        p0.alias("p0"), r0.alias("r0"), p1.alias("p1"), r1.alias("r1"),
        (tn + fp).cast("bigint").alias("s0"), (tp + fn).cast("bigint").alias("s1"),
    )
    c = c.withColumn("f0", safe_divide(F.lit(2) * F.col("p0") * F.col("r0"), F.col("p0") + F.col("r0")))
    c = c.withColumn("f1", safe_divide(F.lit(2) * F.col("p1") * F.col("r1"), F.col("p1") + F.col("r1")))
    total = F.col("s0") + F.col("s1")
    acc = safe_divide(F.col("tn") + F.col("tp"), total)

    def row(label, precision, recall, f1, support):
        return F.struct(
            F.lit(label).alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1_score"),
            support.cast("bigint").alias("support"),
        )

    # The weighted average is deliberately not zero-guarded: an empty table
    # gives NaN there, as in the original study.
    weighted = lambda a, b: (a * F.col("s0") + b * F.col("s1")) / total
    rows = F.array(
        row(LABEL_NAMES[0], F.col("p0"), F.col("r0"), F.col("f0"), F.col("s0")),
        row(LABEL_NAMES[1], F.col("p1"), F.col("r1"), F.col("f1"), F.col("s1")),
        row("accuracy", acc, acc, acc, total),
        row("macro avg", (F.col("p0") + F.col("p1")) / 2, (F.col("r0") + F.col("r1")) / 2, (F.col("f0") + F.col("f1")) / 2, total),
        row("weighted avg", weighted(F.col("p0"), F.col("p1")), weighted(F.col("r0"), F.col("r1")), weighted(F.col("f0"), F.col("f1")), total),
    )
    return c.select(*group_by, F.explode(rows).alias("r")).select(*group_by, "r.*")


def _family_aggs(t: Column, p: Column) -> list[Column]:
    return [
        F.count(F.lit(1)).alias("samples"),
        _count_if(t == p).alias("correct"),
        _count_if(t == 0).alias("true_benign"),
        _count_if(t == 1).alias("true_attack"),
        _count_if((t == 1) & (p == 0)).alias("false_negatives"),
        _count_if((t == 0) & (p == 1)).alias("false_positives"),
    ]


def _family_columns(group_by: Sequence[str]) -> list[Column]:
    return [
        *[F.col(g) for g in group_by],
        F.col("attack_family"),
        F.col("samples"),
        F.when(F.col("true_benign") >= F.col("true_attack"), F.lit(0)).otherwise(F.lit(1)).alias("expected_label"),
        safe_divide(F.col("correct"), F.col("samples")).alias("recall_or_specificity"),
        F.col("false_negatives"),
        F.col("false_positives"),
    ]


def family_stats(
    pred: DataFrame,
    group_by: Sequence[str] = (),
    family: str = "attack_family",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """Per family: samples, majority label, share correct, FN, FP."""
    t, p = F.col(y_true), F.col(y_pred)
    agg = pred.groupBy(*group_by, F.col(family).alias("attack_family")).agg(*_family_aggs(t, p))
    return agg.select(*_family_columns(group_by))


def _threshold_counts(
    pred: DataFrame,
    keys: Sequence[Column],
    thresholds: Sequence[float],
    y_true: str,
    prob: str,
) -> DataFrame:
    """One pass: per key and threshold, conditional sums; unpivoted afterwards.

    The threshold list is a bounded parameter, so the aggregate holds a fixed
    number of integer sums per group; no row is replicated per threshold.
    """
    t, p = F.col(y_true), F.col(prob)
    aggs = [_count_if(t == 0).alias("neg"), _count_if(t == 1).alias("pos")]
    for i, th in enumerate(thresholds):
        hit = p >= F.lit(float(th))
        aggs.append(_count_if(hit & (t == 1)).alias(f"tp_{i}"))
        aggs.append(_count_if(hit & (t == 0)).alias(f"fp_{i}"))
    counts = pred.groupBy(*keys).agg(*aggs)
    key_names = counts.columns[: len(keys)]
    per_threshold = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(float(th)).alias("threshold"),
                    (F.col("neg") - F.col(f"fp_{i}")).alias("tn"),
                    F.col(f"fp_{i}").alias("fp"),
                    (F.col("pos") - F.col(f"tp_{i}")).alias("fn"),
                    F.col(f"tp_{i}").alias("tp"),
                )
                for i, th in enumerate(thresholds)
            ]
        )
    )
    return counts.select(*key_names, per_threshold.alias("c")).select(*key_names, "c.*")


def threshold_sweep(
    pred: DataFrame,
    thresholds: Iterable[float] | str = DEFAULT_THRESHOLDS,
    group_by: Sequence[str] = ("dataset",),
    y_true: str = "y_true",
    prob: str = "attack_probability",
) -> DataFrame:
    """Metrics at each decision threshold (``p >= t`` is an attack), thresholds
    descending (SRT-4)."""
    ths = parse_thresholds(thresholds)
    counts = _threshold_counts(pred, [F.col(g) for g in group_by], ths, y_true, prob)
    m = with_metrics(counts, extended=True)
    return m.select(
        *group_by, "threshold", "samples", "accuracy", "precision", "recall", "f1_score",
        "specificity", "balanced_accuracy", "tn", "fp", "fn", "tp",
    ).orderBy(*group_by, F.desc("threshold"))


def threshold_sweep_by_family(
    pred: DataFrame,
    thresholds: Iterable[float] | str = DEFAULT_THRESHOLDS,
    group_by: Sequence[str] = ("dataset",),
    family: str = "attack_family",
    y_true: str = "y_true",
    prob: str = "attack_probability",
) -> DataFrame:
    """Family statistics at each threshold, from the same single-pass counts,
    ordered by threshold descending and family (SRT-3)."""
    ths = parse_thresholds(thresholds)
    keys = [F.col(g) for g in group_by] + [F.col(family).alias("attack_family")]
    c = _threshold_counts(pred, keys, ths, y_true, prob)
    fam = c.select(
        *group_by, "threshold", "attack_family",
        (F.col("tn") + F.col("fp") + F.col("fn") + F.col("tp")).cast("bigint").alias("samples"),
        (F.col("tn") + F.col("tp")).alias("correct"),
        (F.col("tn") + F.col("fp")).alias("true_benign"),
        (F.col("fn") + F.col("tp")).alias("true_attack"),
        F.col("fn").alias("false_negatives"),
        F.col("fp").alias("false_positives"),
    )
    table = fam.select(*group_by, "threshold", *_family_columns(group_by)[len(group_by):])
    return table.orderBy(*group_by, F.desc("threshold"), F.asc("attack_family"))


def attack_crosstab(
    pred: DataFrame,
    label: str = "original_label",
    y_true: str = "y_true",
    y_pred: str = "y_pred",
) -> DataFrame:
    """Attack rows only: label × predicted class, missing class filled with 0."""
    attacks = pred.where(F.col(y_true) == 1)
    piv = attacks.groupBy(F.col(label).alias("attack_type")).pivot(y_pred, [0, 1]).count().na.fill(0)
    n0, n1 = F.col("0").cast("bigint"), F.col("1").cast("bigint")
    return piv.select(
        "attack_type",
        n0.alias("pred_0"),
        n1.alias("pred_1"),
        safe_divide(n1, n0 + n1).alias("recall"),
    )
