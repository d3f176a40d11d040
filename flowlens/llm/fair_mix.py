"""Mixing sources to target weights by weighted fair queueing (operator 9).

Each source is a queue of its shuffled documents, walked up to twice. Sources
are served side by side, source ``s`` at a rate proportional to its target, so
a document's virtual finish time is the source's words up to and including it
divided by the target. Every source is served ``target`` words per unit of
virtual time: at virtual time 1 exactly the total budget has been served, which
is where the globally sorted schedule is truncated. The document a source is
serving at that moment is cut there, all earlier ones are whole.

Targets: the budget is shared by weight; a source's target stops at
``max_passes`` times its size and the excess is shared again by weight among
the others until none is above (water filling, in closed form from the sources
sorted by size per weight).

Scale: running sums never sort a source in one task. Rows are put in order by
the md5 of (seed, pass, key); its first three hex digits are a bucket, a
histogram per (source, pass) gives the offsets and a window inside (source,
bucket) the rest. The per-source table is a catalogue (one row per source);
two windows without a partition run over that table alone.

Defined cases: null and empty texts have size 0 and are never taken (0 words
of them are); a null source is a source of its own, ordered last; equal
documents in one source (same id, same size) are interchangeable; an empty
table gives an empty result; a source whose documents have no words has
target 0; extra columns are ignored and a column named like a new one is
replaced.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import WHITESPACE_WORD, cut, numbered, unique_name, word_count

BUCKET_DIGITS = 3
MAX_PASSES = 2


def shuffle_key(seed: int, turn: int, doc_id: str, size: str) -> Column:
    return F.md5(
        F.concat_ws("|", F.lit(str(seed)), F.lit(str(turn)), F.coalesce(F.col(doc_id).cast("string"), F.lit("~")), F.col(size).cast("string"))
    )


def cyclic_weights(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1)) -> DataFrame:
    """(source, source_size) -> + ``weight``: sources in code-point order, null
    last, get the weights in turn."""
    # one row per source: a catalogue, not the corpus
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (rank % len(weights) + 1).cast("int"))
    return sizes.withColumn("weight", w)


def water_fill(sources: DataFrame, share: float, max_passes: int = MAX_PASSES) -> DataFrame:
    """(source, source_size, weight) -> + ``target``.

    With sources sorted by ``max_passes * size / weight``, those that stop at
    their bound are a prefix. ``level`` is the words per unit of weight left
    for the rest when the prefix up to here (exclusive) has stopped; a source
    stops if its bound per weight is at most that level.
    """
    bound = F.col("source_size") * F.lit(float(max_passes))
    s = sources.withColumn("_bound", bound).withColumn("_ratio", F.col("_bound") / F.col("weight"))
    everything = Window.partitionBy(F.lit(0))
    before = everything.orderBy("_ratio", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("_budget", F.sum("source_size").over(everything) * F.lit(float(share)))
    s = s.withColumn("_stopped", F.coalesce(F.sum("_bound").over(before), F.lit(0.0)))
    s = s.withColumn("_rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    s = s.withColumn("_level", (F.col("_budget") - F.col("_stopped")) / F.col("_rest"))
    # the level of the first source that does not stop holds for all after it
    s = s.withColumn("_open", F.min(F.when(F.col("_ratio") > F.col("_level"), F.struct("_ratio", "_level"))).over(everything))
    target = F.when(
        F.col("_open").isNotNull() & (F.col("_ratio") >= F.col("_open._ratio")), F.col("weight") * F.col("_open._level")
    ).otherwise(F.col("_bound"))
    return s.withColumn("target", F.least(target, F.col("_bound"))).select("source", "source_size", "weight", "target")


def _start(rows: DataFrame, turn: int) -> DataFrame:
    """Words of the source queued before each row in pass ``turn``."""
    bucket, key = f"_b{turn}", f"_k{turn}"
    hist = rows.groupBy("_src", bucket).agg(F.sum("size").alias("_c"))
    before = Window.partitionBy("_src").orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offs = hist.select("_src", bucket, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_off"))
    inside = Window.partitionBy("_src", bucket).orderBy(key, "_id", "_row").rowsBetween(Window.unboundedPreceding, -1)
    ranked = rows.withColumn("_in", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    return ranked.join(offs, ["_src", bucket]).withColumn(f"_start{turn}", F.col("_off") + F.col("_in")).drop("_off", "_in", bucket, key)


def fair_mix(
    docs: DataFrame,
    share: float = 1.5,
    weights: Sequence[float] = (5, 2, 1),
    seed: int = 9,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    max_passes: int = MAX_PASSES,
    number: str | None = None,
) -> DataFrame:
    """One row per document: doc_id, source, row (a number; that of the column
    ``number``, if given), size, source_size, weight, target, taken, and per
    pass its virtual finish time ``finish`` (array) and words ``parts``."""
    base = docs.select(
        F.col(doc_id).alias("_id"),
        F.col(source).alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source).cast("string")), F.lit("n")).alias("_src"),
        word_count(text).alias("size"),
        (F.col(number) if number else F.monotonically_increasing_id()).alias("_row"),
    )
    for t in range(max_passes):
        base = base.withColumn(f"_k{t}", shuffle_key(seed, t, "_id", "size")).withColumn(
            f"_b{t}", F.substring(f"_k{t}", 1, BUCKET_DIGITS)
        )
    # one slim row per document, written once: the texts are read a single time
    base = cut(base)
    sizes = base.groupBy("_src").agg(F.first("source").alias("source"), F.sum("size").alias("source_size"))
    plan = water_fill(cyclic_weights(sizes.drop("_src"), weights), share, max_passes)
    plan = plan.select(
        F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("_src"),
        "source_size",
        "weight",
        "target",
    )
    rows = base
    for t in range(max_passes):
        rows = _start(rows, t)
    rows = rows.join(plan, "_src")
    parts, finish = [], []
    for t in range(max_passes):
        start = F.col(f"_start{t}") + F.lit(t) * F.col("source_size")
        left = F.floor(F.col("target") - start)
        parts.append(F.greatest(F.lit(0), F.least(F.col("size"), left)).cast("bigint"))
        finish.append(F.when(F.col("target") > 0, (start + F.col("size")) / F.col("target")))
    rows = rows.withColumn("parts", F.array(*parts)).withColumn("finish", F.array(*finish))
    taken = F.aggregate("parts", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return rows.select(
        F.col("_id").alias("doc_id"), "source", F.col("_row").alias("row"), "size", "source_size", "weight", "target",
        taken.alias("taken"), "parts", "finish",
    )


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the columns of ``docs``, a document once for each pass
    that takes words of it, the last document of a source cut after its share.
    The documents are numbered once and stored with their numbers; only numbers
    and shares are scheduled, and each text moves once."""
    text = options.get("text", "text")
    row = unique_name(docs.columns, "mix_row")
    share = unique_name([*docs.columns, row], "mix_share")
    held = numbered(docs, row, "mix")
    plan = fair_mix(held, number=row, **options).where(F.col("taken") > 0)
    plan = plan.select(F.col("row").alias(row), F.explode(F.transform("parts", lambda p: F.struct(p.alias("words"), F.col("size").alias("size")))).alias(share))
    whole = held.join(plan.where(F.col(f"{share}.words") > 0), row)
    words = F.slice(F.regexp_extract_all(F.col(text), F.lit(f"({WHITESPACE_WORD})"), F.lit(1)), 1, F.col(f"{share}.words").cast("int"))
    kept = F.when(F.col(f"{share}.words") < F.col(f"{share}.size"), F.array_join(words, " ")).otherwise(F.col(text))
    return whole.withColumn(text, kept).select(*[F.col(f"`{c}`") for c in docs.columns])
