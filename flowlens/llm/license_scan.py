"""License scan by ordered signature rules (operator 12).

A few hundred hand-written expressions (``license_rules``) look for license
notices, identifiers, addresses and hints in whole texts.

1. *Prefilter.* Every rule names a keyword that its matches contain. The
   keywords are searched in a slice of texts laid end to end; a rule is tried
   only on the texts that hold its keyword.
2. *Rules.* Expressions run over the UTF-8 bytes with A-Z lower-cased. A blank
   in a rule stands for any run of non-word bytes, and a match must begin and
   end at word ends, so a phrase is found wherever its words stand
   consecutively. Runs of separators and words are matched possessively: no
   expression backtracks inside one, so time is linear in the text.
3. *Overlaps.* Detections are taken in the order of their rules. One whose
   interval of words lies inside the interval of a detection of an earlier rule
   is suppressed; partial overlaps stay. (What a suppressed detection contains
   lies inside its container too, so the order of removal does not matter.)
   Base phrases come first and are never suppressed.

Scale: one pass over the texts in Arrow batches, no exchange, no state across
rows; a task holds one slice (``SLICE_BYTES`` or one text) and the rules.

Defined cases: null texts are empty; a text without words or without a
detection has empty lists, null word numbers and score 0; repeated rows give
repeated results; the input's columns are kept, and the result is one struct
column whose name is made unique.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import text_slices, unique_name, word_spans
from flowlens.llm.license_rules import BASE, IDENTIFIERS, NOTICES, STRENGTH

_WORD = b"0-9a-z\x80-\xff"
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_IS_WORD = np.array([c in b"0123456789abcdefghijklmnopqrstuvwxyz" or c >= 0x80 for c in range(256)])


class Rule(NamedTuple):
    label: str
    section: str
    keyword: bytes
    expression: re.Pattern


def compiled(pattern: str) -> re.Pattern:
    """The expression of a rule's pattern, over lower-case bytes."""
    text = pattern.strip().encode()
    text = text.replace(b"(", b"(?:").replace(b" ", b"(?:[^" + _WORD + b"]++)").replace(b"#", b"(?:[" + _WORD + b"]++)")
    return re.compile(text + b"(?![" + _WORD + b"])")


@lru_cache(maxsize=1)
def rules() -> tuple[Rule, ...]:
    """All rules in their order: base phrases, tags, notices, addresses, hints."""
    out = [Rule(label, "base", keyword.encode(), compiled(phrase)) for label, keyword, phrase in BASE]
    for name in sorted(IDENTIFIERS, key=lambda x: (-len(x), x)):  # gpl-3.0-only before gpl-3.0
        out.append(Rule(name, "tag", b"spdx", compiled("spdx license identifier " + re.sub("[^0-9a-z]+", " ", name))))
    sections = iter(("notice", "address", "hint"))
    for line in NOTICES.strip().splitlines():
        if line.startswith("# "):
            section = next(sections)
            continue
        label, keyword, pattern = (part.strip() for part in line.split(" | ", 2))
        out.append(Rule(label, section, keyword.encode(), compiled(pattern)))
    return tuple(out)


def matches(expression: re.Pattern, text: bytes) -> list[tuple[int, int]]:
    """Byte spans of an expression's matches that begin at a word's start."""
    out, at = [], 0
    while found := expression.search(text, at):
        lo, hi = found.span()
        if lo and _IS_WORD[text[lo - 1]]:
            at = lo + 1
            continue
        out.append((lo, hi))
        at = hi
    return out


def resolved(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(rule, first word, last word) without what lies inside a detection of an
    earlier rule; base phrases stay."""
    base = sum(r.section == "base" for r in rules())
    kept, starts, reach = [], [], []
    by_rule = defaultdict(list)
    for rule, lo, hi in found:
        by_rule[rule].append((lo, hi))
    for rule in sorted(by_rule):
        new = []
        for lo, hi in by_rule[rule]:
            at = bisect_right(starts, lo)
            # reach: the largest last word of kept detections that start here or before
            if rule < base or not at or reach[at - 1] < hi:
                new.append((rule, lo, hi))
        kept += new
        order = sorted(kept, key=lambda d: d[1])
        starts = [d[1] for d in order]
        reach = np.maximum.accumulate([d[2] for d in order]).tolist() if order else []
    return sorted(kept, key=lambda d: (d[1], d[2], d[0]))


def texts_with(keyword: bytes, blob: bytes, offsets: np.ndarray) -> Iterator[int]:
    """Numbers of the texts of a slice that contain the keyword."""
    at = blob.find(keyword)
    while at >= 0:
        text = int(np.searchsorted(offsets, at, side="right")) - 1
        if at + len(keyword) <= offsets[text + 1]:
            yield text
            at = blob.find(keyword, int(offsets[text + 1]))
        else:
            at = blob.find(keyword, at + 1)


def scan_slice(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, dict[int, list[tuple[int, int, int]]]]:
    """(words per text, detections by text as (rule, first word, last word))."""
    blob = data.tobytes().translate(_LOWER)
    lowered = np.frombuffer(blob, np.uint8)
    starts, _, first = word_spans(lowered, offsets, _IS_WORD)
    tried = defaultdict(list)
    by_keyword = defaultdict(list)
    for number, rule in enumerate(rules()):
        by_keyword[rule.keyword].append(number)
    for keyword, numbers in by_keyword.items():
        for text in texts_with(keyword, blob, offsets):
            tried[text] += numbers
    found = {}
    for text, numbers in tried.items():
        lo = int(offsets[text])
        own = blob[lo : int(offsets[text + 1])]
        at = starts[first[text] : first[text + 1]] - lo
        hits = []
        for number in numbers:
            for a, b in matches(rules()[number].expression, own):
                hits.append((number, int(np.searchsorted(at, a)), int(np.searchsorted(at, b)) - 1))
        if hits:
            found[text] = resolved(hits)
    return np.diff(first), found


def score_of(labels: set[tuple[str, str]]) -> float:
    """1 less the chance that every (label, section) is wrong."""
    wrong = 1.0
    for _, section in sorted(labels):
        wrong *= 1.0 - STRENGTH[section]
    return 1.0 - wrong


_DETECTION = pa.struct(
    [("rule", pa.int32()), ("label", pa.string()), ("section", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64())]
)
_STRUCT = "n_words:bigint,detections:array<struct<rule:int,label:string,section:string,first_word:bigint,last_word:bigint>>,score:double"


def find_licenses(docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
    """``docs`` with a struct column of what was found, and that column's name:
    n_words, detections (rule number, label, section, first and last word) in
    text order, and score."""
    name = unique_name(docs.columns, "licenses")
    quoted = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields]
    schema = ", ".join([*quoted, f"`{name}` struct<{_STRUCT}>"])
    columns = docs.columns
    at = columns.index(text)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = rules()
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(at)):
                words, found = scan_slice(data, offsets)
                lists, scores = [], []
                for d in range(hi - lo):
                    hits = found.get(d, [])
                    lists.append([{"rule": r, "label": table[r].label, "section": table[r].section, "first_word": a, "last_word": b} for r, a, b in hits])
                    scores.append(score_of({(table[r].label, table[r].section) for r, _, _ in hits}))
                told = pa.StructArray.from_arrays(
                    [pa.array(words.astype(np.int64)), pa.array(lists, type=pa.list_(_DETECTION)), pa.array(scores, type=pa.float64())],
                    names=["n_words", "detections", "score"],
                )
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*part.columns, told], names=[*columns, name])

    return docs.mapInArrow(scan, schema), name


def base_detections(state: str | Column) -> Column:
    """Detections of the base phrases."""
    c = F.col(state) if isinstance(state, str) else state
    return F.filter(c["detections"], lambda d: d["section"] == "base")


def label_list(detections: Column) -> Column:
    """Distinct labels, sorted and joined by commas."""
    return F.array_join(F.array_sort(F.array_distinct(F.transform(detections, lambda d: d["label"]))), ",")
