"""Text quality by a sparse rule ensemble (operator 6).

1. Each text gets a dozen statistics (words, word length, shares of symbols,
   capitals, digits, repeated words, repeated lines ...), computed once per
   text in numpy over Arrow buffers.
2. A random forest of shallow trees is fitted on labelled rows; every path
   from a root to a node is a conjunctive rule ``stat <= x AND stat > y ...``.
3. Lasso logistic regression over the 0/1 columns of all rules (and the plain
   statistics) keeps a few of them.
4. The kept rules are compiled into one Spark column expression over the
   statistics: the classifier *is* that expression, nothing Python runs when
   it is applied to statistics.

Fitting uses at most ``MAX_FIT_ROWS`` labelled rows, picked by a hash of their
id; statistics and scores cover every text.

Defined cases: a null text counts as empty; a text without words has all
statistics 0; labels null or neither 0 nor 1 are no labels, several label rows
of one id: the largest counts; without both classes among the labelled rows
every score is the smoothed share of label 1 (0.5 without rows); extra columns
pass through ``with_statistics`` untouched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import cut, held_out, text_slices, unique_name, whitespace_table, word_hashes, word_spans

MAX_FIT_ROWS = 20_000
#: Tasks of each pass over those rows; the fit makes about a hundred passes.
FIT_TASKS = 4
TREES = 20
DEPTH = 3
LASSO = 0.001

STATISTICS = (
    "words",  # log(1 + words)
    "word_length",  # bytes per word
    "lines",  # log(1 + lines)
    "words_per_line",  # log(1 + words / lines)
    "symbols",  # share of bytes that are ASCII marks other than . , ; : ' " - ( ) ! ?
    "bangs",  # share of ! and ?
    "stops",  # share of . , ; :
    "capitals",  # A-Z among A-Z and a-z
    "digits",  # share of 0-9
    "wide",  # share of bytes beyond ASCII
    "repeats",  # share of words equal to the word before
    "distinct",  # distinct words per word, over the root of their number
    "top_word",  # share of the most frequent word
    "line_copies",  # share of lines equal to another line of the text
    "marked_words",  # share of words without any letter or digit
)

_CLASS = np.zeros((256, 6), dtype=bool)
for _c in range(0x21, 0x7F):
    _ch = chr(_c)
    _CLASS[_c] = [
        not _ch.isalnum() and _ch not in ".,;:'\"-()!?",
        _ch in "!?",
        _ch in ".,;:",
        "A" <= _ch <= "Z",
        "a" <= _ch <= "z",
        "0" <= _ch <= "9",
    ]
_LETTERS = np.array([(chr(c).isascii() and chr(c).isalnum()) or c >= 0x80 for c in range(256)])
_LINE = np.ones(256, dtype=bool)
_LINE[0x0A] = False


def _segment_sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    run = np.zeros(len(values) + 1)
    np.cumsum(values, out=run[1:])
    return run[first[1:]] - run[first[:-1]]


def _groups(owner: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per owner: distinct values, largest count, members of groups of two or more."""
    if len(hashes) == 0:
        return np.zeros(n), np.zeros(n), np.zeros(n)
    order = np.lexsort((hashes, owner))
    o, h = owner[order], hashes[order]
    new = np.ones(len(o), dtype=bool)
    new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    count = np.diff(np.append(at, len(o)))
    who = o[at]
    top = np.zeros(n)
    np.maximum.at(top, who, count)
    return np.bincount(who, minlength=n).astype(float), top, np.bincount(who, weights=np.where(count > 1, count, 0), minlength=n)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, statistics) for texts laid end to end."""
    n = len(offsets) - 1
    size = np.maximum(np.diff(offsets), 1).astype(float)
    marks = [_segment_sum(_CLASS[:, k][data], offsets) for k in range(6)]
    wide = _segment_sum(data >= 0x80, offsets)
    starts, ends, first = word_spans(data, offsets, whitespace_table())
    words = np.diff(first).astype(float)
    some = np.maximum(words, 1)
    hashes = word_hashes(data, starts, ends)
    owner = np.repeat(np.arange(n), np.diff(first))
    same = np.zeros(len(hashes))
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    plain = np.zeros(len(starts))
    if len(starts):
        lettered = np.zeros(len(data) + 1, dtype=np.int64)
        np.cumsum(_LETTERS[data], out=lettered[1:])
        plain = (lettered[ends] == lettered[starts]).astype(float)
    distinct, top, _ = _groups(owner, hashes, n)
    ls, le, lf = word_spans(data, offsets, _LINE)
    lines = np.diff(lf).astype(float)
    _, _, copies = _groups(np.repeat(np.arange(n), np.diff(lf)), word_hashes(data, ls, le), n)
    letters = np.maximum(marks[3] + marks[4], 1)
    length = _segment_sum((ends - starts).astype(float), first)
    out = np.column_stack(
        [
            np.log1p(words),
            length / some,
            np.log1p(lines),
            np.log1p(words / np.maximum(lines, 1)),
            marks[0] / size,
            marks[1] / size,
            marks[2] / size,
            marks[3] / letters,
            marks[5] / size,
            wide / size,
            _segment_sum(same, first) / some,
            distinct / some,
            top / some,
            copies / np.maximum(lines, 1),
            _segment_sum(plain, first) / some,
        ]
    )
    out[:, STATISTICS.index("distinct")] = distinct / np.sqrt(some)
    out[words == 0] = 0.0
    return out


def with_statistics(docs: DataFrame, text: str, result: str) -> DataFrame:
    """``docs`` + one struct column of the statistics."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATISTICS])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((0, len(STATISTICS)))]
            for _, _, data, offsets in text_slices(batch.column(batch.schema.get_field_index(text))):
                parts.append(statistics(data, offsets))
            m = np.concatenate(parts)
            made = pa.StructArray.from_arrays([pa.array(m[:, j]) for j in range(m.shape[1])], list(STATISTICS))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, result])

    return docs.mapInArrow(add, T.StructType([*docs.schema.fields, T.StructField(result, kind)]))


# ------------------------------------------------------------------- rules ----

Rule = tuple[tuple[int, bool, float], ...]  # (statistic, greater?, threshold)

_CONDITION = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) ([-+.\dEe]+|Infinity)\)$")


def tree_rules(printed: str) -> list[Rule]:
    """Rules of all nodes but the roots, from a printed tree ensemble."""
    rules: list[Rule] = []
    path: list[tuple[int, tuple[int, bool, float]]] = []
    for line in printed.splitlines():
        m = _CONDITION.match(line)
        if not m:
            continue
        depth = len(m.group(1))
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (int(m.group(3)), m.group(4) == ">", float(m.group(5)))))
        rules.append(tuple(c for _, c in path))
    return rules


def simplify(rule: Rule) -> Rule:
    """One bound per statistic and direction, in a fixed order."""
    tight: dict[tuple[int, bool], float] = {}
    for stat, greater, x in rule:
        old = tight.get((stat, greater))
        tight[stat, greater] = x if old is None else (max(old, x) if greater else min(old, x))
    return tuple(sorted((s, g, x) for (s, g), x in tight.items()))


def rule_column(rule: Rule, stats: str) -> Column:
    """The rule as a boolean column over the statistics struct."""
    out = None
    for stat, greater, x in rule:
        c = F.col(f"{stats}.{STATISTICS[stat]}")
        c = c > F.lit(x) if greater else c <= F.lit(x)
        out = c if out is None else out & c
    return out


class RuleModel:
    """Kept rules with weights, linear terms and an intercept."""

    def __init__(self, rules: list[tuple[Rule, float]], linear: list[tuple[int, float]], intercept: float):
        self.rules, self.linear, self.intercept = rules, linear, intercept

    def score(self, stats: str) -> Column:
        z = F.lit(float(self.intercept))
        for rule, w in self.rules:
            z = z + F.when(rule_column(rule, stats), F.lit(float(w))).otherwise(F.lit(0.0))
        for stat, w in self.linear:
            z = z + F.col(f"{stats}.{STATISTICS[stat]}") * F.lit(float(w))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(rows: DataFrame, stats: str, label: str, trees: int = TREES, depth: int = DEPTH, lasso: float = LASSO, seed: int = 6) -> RuleModel:
    """Fits the ensemble on ``rows`` (struct ``stats`` and a 0/1 ``label``)."""
    counts = {int(r[label]): r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(counts) < 2:
        p = (counts.get(1, 0) + 1.0) / (sum(counts.values()) + 2.0)
        return RuleModel([], [], float(np.log(p / (1 - p))))
    plain = [F.col(f"{stats}.{s}") for s in STATISTICS]
    ready = rows.select(array_to_vector(F.array(*plain)).alias("features"), F.col(label).cast("double").alias("label"), stats)
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, minInstancesPerNode=10, maxBins=64, subsamplingRate=0.6, featureSubsetStrategy="onethird", seed=seed).fit(ready)
    rules = sorted({simplify(r) for r in tree_rules(forest.toDebugString)})
    cells = [F.when(rule_column(r, stats), 1.0).otherwise(0.0) for r in rules] + plain
    wide = ready.select(array_to_vector(F.array(*cells)).alias("features"), "label")
    model = LogisticRegression(elasticNetParam=1.0, regParam=lasso, maxIter=80, standardization=True).fit(wide)
    weights = model.coefficients.toArray()
    return RuleModel(
        [(r, w) for r, w in zip(rules, weights) if w != 0.0],
        [(j, w) for j, w in enumerate(weights[len(rules) :]) if w != 0.0],
        model.intercept,
    )


def learn_quality(stats_rows: DataFrame, labels: DataFrame, stats: str, doc_id: str = "doc_id", label: str = "quality", max_rows: int = MAX_FIT_ROWS) -> RuleModel:
    """Fits on at most about ``max_rows`` labelled rows that are not held out."""
    known = labels.where(F.col(label).isin(0, 1)).groupBy(F.col(doc_id).alias("__id")).agg(F.max(label).cast("int").alias("__label"))
    rows = stats_rows.select(F.col(doc_id).alias("__id"), F.col(stats).alias("__stats")).where(~held_out("__id")).join(known, "__id")
    n = rows.count()
    if n > max_rows:
        rows = rows.where(F.pmod(F.xxhash64("__id"), F.lit(n)) < max_rows)
    # however the rows are dealt, the fit reads them with FIT_TASKS tasks
    rows = cut(rows.repartition(FIT_TASKS, "__id").coalesce(FIT_TASKS).sortWithinPartitions("__id", "__label"))
    return fit_rules(rows, "__stats", "__label")


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """doc_id, held_out, score and the statistics per document."""
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    rows = cut(with_statistics(slim, "text", "stats").drop("text"))
    model = learn_quality(rows, labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("quality")), "stats")
    return rows.select("doc_id", held_out("doc_id").alias("held_out"), model.score("stats").alias("score"), "stats")


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """``docs`` whose score reaches the threshold; columns unchanged.

    Statistics are computed again for the filter (a narrow pass) rather than
    joined back, so texts are never shuffled.
    """
    slim = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where(F.col(doc_id).isNotNull())
    known = labels.select(F.col(doc_id).alias("doc_id"), F.col(label).alias("quality"))
    rows = cut(with_statistics(slim, "text", "stats").drop("text"))
    model = learn_quality(rows, known, "stats")
    stats = unique_name(docs.columns, "__stats")
    return with_statistics(docs, text, stats).where(model.score(stats) >= threshold).select(*[F.col(f"`{c}`") for c in docs.columns])
