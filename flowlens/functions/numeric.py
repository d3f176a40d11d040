"""Scalar helpers: guarded ratios, threshold lists, numeric text coercion.

All of these are plain ``Column`` expressions so they stay inside
whole-stage code generation.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The decision thresholds swept by default.
DEFAULT_THRESHOLDS = (0.5, 0.3, 0.2, 0.1, 0.05, 0.01)

# Cell texts the CSV reader of the original study treats as
# missing (its default NA token list).
NA_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
)

# The characters of the pattern \\s.
WHITE_SPACE = " \t\n\x0b\f\r"

# A cell counts as a number when it is a decimal/scientific literal or an
# infinity token; anything else (e.g. "1d", "abc") is not. Java's parser
# would accept "1d"/"1f", so the pattern guards the cast.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
INFINITY_PATTERN = r"^\s*[+-]?(?i:inf|infinity)\s*$"


def safe_divide(numerator: Column, denominator: Column) -> Column:
    """``numerator / denominator``, 0.0 when the denominator is 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def parse_thresholds(raw: str | Iterable[float]) -> list[float]:
    """Comma list or numbers -> distinct decision thresholds, largest first."""
    cells = raw.split(",") if isinstance(raw, str) else raw
    cuts = {float(cell) for cell in cells if str(cell).strip()}
    outside = sorted(cut for cut in cuts if not 0.0 <= cut <= 1.0)
    if outside or not cuts:
        raise ValueError(f"decision thresholds outside [0, 1]: {outside}" if outside else "no decision threshold given")
    return sorted(cuts, reverse=True)


def strip_blanks(text: Column) -> Column:
    """Without leading and trailing white space of any kind (``trim`` alone
    only knows the blank)."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def is_missing_text(cell: Column) -> Column:
    """True for NULL and every NA token (the raw cell is 'missing')."""
    return cell.isNull() | cell.isin(*NA_TOKENS)


def coerce_number(cell: Column) -> Column:
    """Text cell → DOUBLE; NULL when missing or not a number; ±Inf kept.

    Mirrors ``to_numeric(errors='coerce')``: surrounding blanks are allowed,
    NA tokens give NULL (NaN there), '1d' is not a number. The cast itself
    skips surrounding blanks, so a cell that passes the pattern is not trimmed.
    """
    return (
        F.when(is_missing_text(cell), F.lit(None).cast("double"))
        .when(cell.rlike(NUMBER_PATTERN), cell.try_cast("double"))
        .when(
            cell.rlike(INFINITY_PATTERN),
            F.when(strip_blanks(cell).startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))),
        )
        .otherwise(F.lit(None).cast("double"))
    )


def is_infinite(x: Column) -> Column:
    return x.isNotNull() & (F.abs(x) == F.lit(float("inf")))


def is_finite(x: Column) -> Column:
    """Not NULL, not NaN, not ±Inf (``dropna`` alone keeps ±Inf)."""
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))
