"""Unions, intersections and pairings of flow tables (SET-1..6, PRJ-12/13,
JN-1, JN-2, JN-8)."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions.labels import legacy_binary
from flowlens.functions.numeric import strip_blanks
from flowlens.operators.guards import guarded


def common_columns(frames: Sequence[DataFrame], sort: bool = False, required: Sequence[str] = ()) -> list[str]:
    """Columns present in every frame, in the first frame's order (or sorted).

    Schema-only work on the driver; raises when a required column is lost.
    """
    if not frames:
        raise ValueError("No frames given")
    common = set(frames[0].columns)
    for f in frames[1:]:
        common &= set(f.columns)
    cols = sorted(common) if sort else [c for c in frames[0].columns if c in common]
    missing = [r for r in required if r not in common]
    if missing:
        raise KeyError(f"Columns not common to all inputs: {missing}")
    if not cols:
        raise ValueError("No common columns")
    return cols


def union_common(frames: Mapping[str, DataFrame], sort: bool = False, source_col: str = "source_file") -> DataFrame:
    """SET-1 over the common columns, tagged with the name of each input."""
    names = list(frames)
    cols = common_columns([frames[n] for n in names], sort=sort)
    out = None
    for n in names:
        part = frames[n].select(*cols, F.lit(n).alias(source_col))
        out = part if out is None else out.unionByName(part)
    return out


def class_union(
    parts: Sequence[tuple[DataFrame, str, str]], label: str = "Label", dedup: bool = False
) -> DataFrame:
    """SET-2/SET-3: from each (frame, wanted class, new label text) keep the rows
    whose trimmed lower-cased label equals the class, relabel, union; optional
    exact de-duplication over all columns (AGG-18)."""
    out = None
    for df, wanted, relabel in parts:
        sel = df.where(F.lower(strip_blanks(F.col(label))) == wanted.lower()).withColumn(label, F.lit(relabel))
        out = sel if out is None else out.unionByName(sel)
    if dedup:
        out = out.dropDuplicates()
    return out.withColumn("binary_label", legacy_binary(F.col(label)))


def union_missing(frames: Mapping[str, DataFrame], keep: Sequence[str], digits: int = 4) -> DataFrame:
    """SET-4: union frames with different columns, tag the variant, keep the
    listed columns that exist anywhere, round doubles."""
    out = None
    for name, df in frames.items():
        part = df.withColumn("variant", F.lit(name))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    cols = [c for c in ["variant", *keep] if c in out.columns]
    types = dict(out.dtypes)
    return out.select(*[F.round(c, digits).alias(c) if types[c] == "double" else F.col(c) for c in cols])


def pair_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-1: one-to-one pairing on a row key."""
    return left.join(right, key, "inner")


def pairing_check(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-2: matched / left-only / right-only counts from one full outer join.

    The original raises on unequal chunk lengths; here the whole tables are
    compared and the caller decides; ``paired`` raises."""
    lk = left.select(F.col(key).alias("_lk"))
    rk = right.select(F.col(key).alias("_rk"))
    j = lk.join(rk, F.col("_lk") == F.col("_rk"), "full_outer")
    one = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("bigint")
    return j.agg(
        one(F.col("_lk").isNotNull() & F.col("_rk").isNotNull()).alias("matched"),
        one(F.col("_rk").isNull()).alias("left_only"),
        one(F.col("_lk").isNull()).alias("right_only"),
    )


def paired(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """JN-2, the raising form: ``left`` and ``right`` side by side on a key of
    non-null values; a row without its partner ends the job that reads the result."""
    l = left.select("*", F.lit(1).alias("_in_left"))
    r = right.select(F.col(key).alias("_rk"), *[c for c in right.columns if c != key])
    both = l.join(r, F.col(key) == F.col("_rk"), "full_outer")
    told = F.concat(F.lit(f"rows without a partner, {key} = "), F.coalesce(F.col(key), F.col("_rk")).cast("string"))
    whole = F.col("_in_left").isNotNull() & F.col("_rk").isNotNull()
    return guarded(both, whole, F.coalesce(told, F.lit(f"rows without a partner, {key} is null"))).drop("_in_left", "_rk")


def compare_on(a: DataFrame, b: DataFrame, keys: Sequence[str], suffixes=("_original", "_ablation")) -> DataFrame:
    """JN-8: two result tables side by side on shared keys."""
    ra = a.select(*keys, *[F.col(c).alias(c + suffixes[0]) for c in a.columns if c not in keys])
    rb = b.select(*keys, *[F.col(c).alias(c + suffixes[1]) for c in b.columns if c not in keys])
    return ra.join(rb, list(keys), "inner")
