"""Benchmark decontamination with one Aho-Corasick automaton (operator 4).

Benchmark items (questions and answers) are normalised to words: A-Z to lower
case, a word is a run of bytes other than 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F
(so digits, letters and everything beyond ASCII). Every run of 13 consecutive
item words is a phrase; an item of fewer words is one phrase.

The automaton reads words, not characters: each distinct benchmark word gets
one code point, a document becomes a string with one code point per word (0 if
the benchmark lacks the word), and the match position *is* the word number. A
document is scanned once, by one automaton, whatever the number of items. Word
numbers are mapped back to character offsets of the original text for the
documents that have hits.

Scale: documents are never shuffled; each task scans its own partition. What
is broadcast is the benchmark alone, and only after its words are counted: an
automaton takes at most ``max_words`` words; a larger benchmark is split into
several such groups of items, each broadcast on its own and scanned in a
further pass of the same stage, which adds to the hits of the pass before.

Defined cases: null or empty text has no words and is clean (hits empty);
null, empty or word-free items have no phrase; several rows of one item id
are one item; a null item id is the id ``null``; the phrases of repeated items
count for each of their ids; an empty benchmark leaves every document clean;
extra columns pass through, also those named like a result (the results live
in one struct column whose name is chosen free of clashes).
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm.common import unique_name

PHRASE_WORDS = 13
MAX_WORDS_PER_AUTOMATON = 2_000_000

# A-Z to lower case; separators of the contract to blanks; the rest unchanged
_SEPARATORS = [*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]
_NORMAL = bytearray(range(256))
for _b in _SEPARATORS:
    _NORMAL[_b] = 0x20
for _b in range(0x41, 0x5B):
    _NORMAL[_b] = _b + 0x20
_NORMAL = bytes(_NORMAL)
_FIRST_CODE = 0xE000  # above the surrogates: every code point from here on is free


def words_of(text: str | None) -> list[bytes]:
    """Normalised words of a text, as UTF-8 bytes."""
    return text.encode("utf-8").translate(_NORMAL).split() if text else []


def phrases_of(words: list[bytes], size: int = PHRASE_WORDS) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    if len(words) < size:
        return [tuple(words)]
    return [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]


class PhraseScanner:
    """Automaton over the phrases of (item id, text) pairs."""

    def __init__(self, items: list[tuple[str, str]], size: int = PHRASE_WORDS):
        self.code: dict[bytes, str] = {}
        owners: dict[str, set[str]] = {}
        for item_id, text in items:
            for phrase in phrases_of(words_of(text), size):
                key = "".join([self.code.setdefault(w, chr(_FIRST_CODE + len(self.code))) for w in phrase])
                owners.setdefault(key, set()).add(item_id)
        self.automaton = ahocorasick.Automaton()
        for key, ids in owners.items():
            self.automaton.add_word(key, (len(key), tuple(sorted(ids))))
        self.empty = not owners
        if not self.empty:
            self.automaton.make_automaton()

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """(merged word ranges [begin, end), ids of the items found)."""
        if self.empty or not words:
            return [], set()
        get = self.code.get
        line = "".join([get(w, "\0") for w in words])
        ranges: list[tuple[int, int]] = []
        found: set[str] = set()
        for last, (length, ids) in self.automaton.iter(line):
            begin, end = last + 1 - length, last + 1
            found.update(ids)
            while ranges and ranges[-1][1] >= begin:
                begin = min(begin, ranges.pop()[0])
            ranges.append((begin, end))
        return ranges, found


def char_spans(text: str, ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Character offsets [begin, end) of word ranges in the original text."""
    starts, ends, inside = [], [], False
    raw = text.encode("utf-8").translate(_NORMAL)
    for i, b in enumerate(raw):
        if (b != 0x20) != inside:
            inside = not inside
            (starts if inside else ends).append(i)
    if inside:
        ends.append(len(raw))
    original = text.encode("utf-8")
    out, at_byte, at_char = [], 0, 0
    for begin, end in sorted(ranges):
        lo, hi = starts[begin], ends[end - 1]
        at_char += len(original[at_byte:lo].decode("utf-8"))
        width = len(original[lo:hi].decode("utf-8"))
        out.append((at_char, at_char + width))
        at_char, at_byte = at_char + width, hi
    return out


FOUND = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("ranges", T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))),
        T.StructField("items", T.ArrayType(T.StringType())),
    ]
)
_RANGE = pa.struct([("begin", pa.int64()), ("end", pa.int64())])
_FOUND = pa.struct([("n_words", pa.int64()), ("ranges", pa.list_(_RANGE)), ("items", pa.list_(pa.string()))])


def _scan_pass(docs: DataFrame, items: list[tuple[str, str]], text: str, state: str, first: bool, size: int) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(items)
    schema = T.StructType([*docs.schema.fields, T.StructField(state, FOUND)]) if first else docs.schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = PhraseScanner(shared.value, size)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(text))
            before = None if first else batch.column(batch.schema.get_field_index(state))
            out = []
            for i in range(len(column)):
                words = words_of(column[i].as_py())
                ranges, found = scanner.scan(words)
                if before is not None:
                    old = before[i].as_py()
                    ranges = [*ranges, *[(r["begin"], r["end"]) for r in old["ranges"]]]
                    found = found | set(old["items"])
                out.append({"n_words": len(words), "ranges": [{"begin": b, "end": e} for b, e in ranges], "items": sorted(found)})
            made = pa.array(out, type=_FOUND)
            if first:
                yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, state])
            else:
                at = batch.schema.get_field_index(state)
                yield pa.RecordBatch.from_arrays([made if k == at else c for k, c in enumerate(batch.columns)], names=batch.schema.names)

    return docs.mapInArrow(scan, schema)


def item_groups(items: DataFrame, item_id: str, text: str, max_words: int) -> Iterator[list[tuple[str, str]]]:
    """Items in groups of about ``max_words`` words; one group in memory at a time.

    The number of groups comes from a count of all words; items are dealt to
    groups by a hash of their id.
    """
    slim = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("null")).alias("id"), F.col(text).cast("string").alias("t"))
    slim = slim.where(F.length("t") > 0)
    total = slim.agg(F.sum(F.length("t"))).first()[0] or 0
    groups = max(1, -(-total // (2 * max_words)))  # a word and its blank take two characters at least
    for g in range(groups):
        part = slim if groups == 1 else slim.where(F.pmod(F.xxhash64("id"), F.lit(groups)) == g)
        yield [(r["id"], r["t"]) for r in part.collect()]


def find_benchmark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = PHRASE_WORDS,
    max_words: int = MAX_WORDS_PER_AUTOMATON,
    state: str = "found",
) -> tuple[DataFrame, str]:
    """``docs`` + one struct column (n_words, ranges, items); returns the frame
    and the column's name. ``ranges`` are word ranges [begin, end), possibly
    overlapping when the benchmark took several automata."""
    state = unique_name(docs.columns, state)
    out, first = docs, True
    for group in item_groups(items, item_id, item_text, max_words):
        out, first = _scan_pass(out, group, text, state, first, size), False
    return out, state


def n_hit(state: str):
    """Words covered by any range: ranges sorted by begin, overlaps once."""
    ordered = F.array_sort(F.col(f"{state}.ranges"))
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).cast("bigint").alias("upto"))

    def add(acc, r):
        more = F.greatest(F.lit(0), r["end"] - F.greatest(r["begin"], acc["upto"]))
        return F.struct((acc["n"] + more).cast("bigint").alias("n"), F.greatest(acc["upto"], r["end"]).alias("upto"))

    return F.aggregate(ordered, start, add, lambda a: a["n"])


def is_contaminated(state: str):
    """Some word is hit and the hit words are a twentieth of all or more."""
    return (n_hit(state) > 0) & (F.lit(20) * n_hit(state) >= F.col(f"{state}.n_words"))


def with_spans(found: DataFrame, text: str, state: str, spans: str = "spans") -> DataFrame:
    """Adds the character spans of the ranges in the original text."""
    spans = unique_name(found.columns, spans)
    kind = T.ArrayType(T.StructType([T.StructField("begin", T.LongType()), T.StructField("end", T.LongType())]))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text))
            states = batch.column(batch.schema.get_field_index(state))
            out = []
            for i in range(len(texts)):
                ranges = [(r["begin"], r["end"]) for r in states[i].as_py()["ranges"]]
                made = char_spans(texts[i].as_py(), ranges) if ranges else []
                out.append([{"begin": b, "end": e} for b, e in made])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, type=pa.list_(_RANGE))], names=[*batch.schema.names, spans])

    return found.mapInArrow(add, T.StructType([*found.schema.fields, T.StructField(spans, kind)]))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the contaminated documents; columns unchanged."""
    found, state = find_benchmark(docs, items, **options)
    return found.where(~is_contaminated(state)).select(*[F.col(f"`{c}`") for c in docs.columns])
