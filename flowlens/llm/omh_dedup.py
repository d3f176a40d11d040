"""Near-duplicate classes by Order MinHash (operator 1).

A document is its sequence of words, its items are runs of two words (``RUN``;
in texts of up to ``SHORT`` words single words), each labelled with its
occurrence number (the second time a run occurs it is another item). For each
of ``SKETCHES`` random orders, Order MinHash takes the
``PICKS`` smallest items and keeps them *in text order*; documents collide in a
sketch if they agree on the items and on their order, so the collision rate
falls with the edit distance, not only with the overlap of the two sets.

1. *Copies first.* Documents with the same words (128-bit hash) are one node.
2. *Buckets.* Nodes with a common sketch share a bucket. A bucket proposes
   each member together with its smallest and its largest member (two
   aggregates with a map-side part), so a bucket with a third of all nodes
   costs two rows per node.
3. *Verification.* A proposed pair is accepted if its edit similarity
   ``1 - distance / longer`` over words is ``SIMILARITY`` (0.8) or more: first
   a bound from the common words, then a banded alignment whose band grows to
   the distance allowed. Pairs are verified in two rounds: each node with the
   partner it shares most sketches with; then the pairs that still join
   different classes.
4. *Crowded buckets.* In a bucket of four or more nodes that are still in
   several classes, pairs without an end were not looked at. Up to ``GROUP``
   nodes, a bucket is looked through in one place: two nodes of different
   classes and fitting lengths are candidates if their histograms of words (and,
   in long texts, of runs) leave room for the similarity; histograms bound the
   edit distance from below, so no similar pair is lost. Larger buckets are dealt
   anew by the words of their nodes, each node once whatever its buckets: texts of
   edit similarity 0.8 have all but ``d = floor(0.2 n)`` words in common, so each
   has one of its first ``d + 1`` words in common with the other, in any order of
   all words; here frequent ones are last. What is still larger is cut into
   blocks, and every two blocks meet. Candidate pairs are never written: a bucket
   tells each node that has one, and the part of candidates it belongs to.
   Buckets overlap, so parts are joined over buckets, and each part of up to
   ``GROUP`` nodes is verified as one group, each node in it once (larger parts by
   bucket, a pair in the first of its buckets), in blocks of which every two meet.
   A task holds the words of two blocks, leaves out what common words rule out,
   aligns the closest pairs first and skips those that its links have joined; it
   writes fewer links than it has nodes. Together with 3, any two nodes of one
   bucket are verified, known to be unlike, or in one class.
5. *Classes.* Connected components of the accepted links, by label passing
   with pointer jumping; the class is named by its smallest document id.

Recall: an edit spoils at most two runs of two words, so of n - 1 runs of the
longer text at least n - 1 - 2 * floor(0.2 n) are common to a pair at the
threshold, wherever the edits lie: J is 0.43 or more for long texts and both
picks of a sketch are common with J**2 = 0.18. All 64 sketches miss with
(1 - J**2)**64 = 2e-6 at similarity 0.80, less above; the worst length from 11
words on is 15 (4e-5). Texts of up to ten words are compared by single words
(12 of 66 pairs of items at worst, 1e-5 or less), and texts of eight to ten
words by both, as their partner may be longer than ten. Repeated runs change
their labels with an edit before them; that costs items beside the bound.

Defined cases: null texts are never copies of anything (a class each); texts
without words are copies of each other; texts of fewer than five words are
similar to equal ones only; null ids: a class is named by its smallest non-null id,
null if it has none; repeated rows fall in one class; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.llm.common import cut, freed_shuffles, mix64, numbered, powers, removed, rolling, small, text_slices, unique_name, whitespace_table, word_hashes, word_spans, written

RUN = 2
SHORT = 10
SKETCHES = 64
PICKS = 2
SIMILARITY = 0.8
_WORD = whitespace_table()
_SEEDS = mix64(np.arange(1, SKETCHES + 1, dtype=np.uint64) * np.uint64(0x2545F4914F6CDD1D))
_ODDS = mix64(_SEEDS) | np.uint64(1)
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ----------------------------------------------------------------- sketches ----


def labelled_items(words: np.ndarray, run: int = RUN) -> np.ndarray:
    """Hash of each run of words with its occurrence number, in text order."""
    runs = rolling(words, min(run, len(words)), 3)
    order = np.argsort(runs, kind="stable")
    s = runs[order]
    new = np.append(True, s[1:] != s[:-1])
    at = np.flatnonzero(new)
    nth = np.empty(len(runs), dtype=np.uint64)
    nth[order] = (np.arange(len(s)) - np.repeat(at, np.diff(np.append(at, len(s))))).astype(np.uint64)
    return mix64(runs + nth * _ODD)


def order_minhash(items: np.ndarray, picks: int = PICKS) -> np.ndarray:
    """One value per random order: the smallest items, joined in text order."""
    out = np.empty(len(_SEEDS), dtype=np.uint64)
    step = max(1, (1 << 20) // max(1, len(items)))
    for lo in range(0, len(_SEEDS), step):
        rank = (items[None, :] ^ _SEEDS[lo : lo + step, None]) * _ODDS[lo : lo + step, None]
        rank ^= rank >> np.uint64(31)
        lines = np.arange(len(rank))
        spots = []
        for _ in range(min(picks, len(items))):
            at = rank.argmin(1)
            spots.append(at)
            rank[lines, at] = np.iinfo(np.uint64).max
        joined = _SEEDS[lo : lo + step].copy()
        for column in np.sort(np.stack(spots), axis=0):
            joined = mix64(joined * _ODD + items[column])
        out[lo : lo + step] = joined
    return out


def sketches_of(words: np.ndarray) -> np.ndarray:
    """Sketches of a text. Two texts of at most SHORT words meet by single
    words; else the shorter one has at least SIMILARITY * SHORT words, and they
    meet by runs of RUN words."""
    out = []
    if len(words) <= SHORT:
        out.append(mix64(order_minhash(labelled_items(words, 1)) + _ODD))
    if len(words) >= SIMILARITY * SHORT:
        out.append(order_minhash(labelled_items(words)))
    return np.concatenate(out)


def _content(words: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each document's whole word sequence."""
    out = []
    place = np.arange(len(words)) - np.repeat(first[:-1], np.diff(first))
    longest = int(np.diff(first).max()) if len(first) > 1 else 0
    for base in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        run = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * powers(base, longest + 1)[place] if len(words) else words, out=run[1:])
        out.append(mix64(run[first[1:]] - run[first[:-1]] + np.diff(first).astype(np.uint64) * _ODD))
    return out[0], out[1]


#: Bins of a text's word histogram, one byte each; texts of more than LONG
#: words also have one of their runs of two words, with a bin a run or more.
BINS = 256
LONG = 1024


def _counted(hashes: np.ndarray, bins: int) -> np.ndarray:
    return np.minimum(np.bincount((hashes >> np.uint64(32)).astype(np.int64) % bins, minlength=bins), 255).astype(np.uint8)


def histogram(words: np.ndarray) -> bytes:
    """How many words, and runs in long texts, fall in each bin, 255 at most.
    What one text has beyond another in its bins bounds their edits from below
    (two runs an edit); a saturated bin only lowers the bound."""
    runs = _counted(rolling(words, 2, 3), 1 << int(len(words) - 1).bit_length()) if len(words) > LONG else np.zeros(0, np.uint8)
    return _counted(words, BINS).tobytes() + runs.tobytes()


def folded(bins: np.ndarray, size: int) -> np.ndarray:
    """A histogram brought down to ``size`` bins, a smaller power of two."""
    if len(bins) == size:
        return bins
    return np.minimum(bins.reshape(-1, size).sum(0, dtype=np.int64), 255).astype(np.uint8)


def runs_leave_room(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Whether two run histograms allow ``most`` edits."""
    size = min(len(a), len(b))
    a, b = folded(a, size), folded(b, size)
    return max(int(a.sum(dtype=np.int64)), int(b.sum(dtype=np.int64))) - int(np.minimum(a, b).sum(dtype=np.int64)) <= 2 * most


_SIGNED = "row bigint, id bigint, c1 bigint, c2 bigint, n int, sketches array<bigint>, bins binary"


def signatures(docs: DataFrame) -> DataFrame:
    """(row, id, text) -> row, id, content hash, number of words, sketches, histogram."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                starts, ends, first = word_spans(data, offsets, _WORD)
                words = word_hashes(data, starts, ends)
                c1, c2 = _content(words, first)
                sketches = []
                for d in range(hi - lo):
                    own = words[first[d] : first[d + 1]]
                    sketches.append(sketches_of(own).view(np.int64) if len(own) else None)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(lo, hi - lo),
                        batch.column(1).slice(lo, hi - lo),
                        pa.array(c1.view(np.int64)),
                        pa.array(c2.view(np.int64)),
                        pa.array(np.diff(first).astype(np.int32)),
                        pa.array(sketches, type=pa.list_(pa.int64())),
                        pa.array([histogram(words[first[d] : first[d + 1]]) for d in range(hi - lo)], type=pa.binary()),
                    ],
                    names=[c.split()[0] for c in _SIGNED.split(", ")],
                )

    return docs.mapInArrow(make, _SIGNED)


def word_lists(docs: DataFrame) -> DataFrame:
    """(node, text) -> node and the words as 32-bit hashes."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in text_slices(batch.column(1)):
                starts, ends, first = word_spans(data, offsets, _WORD)
                low = word_hashes(data, starts, ends).astype(np.uint32)
                lists = pa.array([low[first[d] : first[d + 1]].tobytes() for d in range(hi - lo)], type=pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), lists], names=["node", "words"])

    return docs.mapInArrow(make, "node bigint, words binary")


# ---------------------------------------------------------- crowded buckets ----


#: Nodes of a group that one task solves.
GROUP = 4096
#: Bytes of histograms compared at once.
_COMPARED = 8 << 20
#: Most frequent words told to the prefix tasks. Any order of the words is
#: exact; this one only keeps common passages out of the prefixes.
FREQUENT = 200_000


def close_pairs(root: np.ndarray, n: np.ndarray, histograms: list[bytes], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j) of a group that may be similar (different classes, fitting
    lengths, histograms that leave room), a slice at a time."""
    order = np.argsort(n, kind="stable")
    root, n = root[order], n[order]
    whole = [np.frombuffer(histograms[i], np.uint8) for i in order]
    bins = np.stack([h[:BINS] for h in whole])
    filled = bins.sum(1, dtype=np.int64)
    # row i meets longer rows j > i up to the last whose length fits
    last = np.searchsorted(n - np.floor((1.0 - least) * n + 1e-9).astype(np.int64), n, side="right")
    lo = 0
    while lo < len(n):
        hi = lo + 1
        while hi < len(n) and (hi + 1 - lo) * (int(last[hi]) - lo) <= 1 << 20:
            hi += 1
        end = int(last[hi - 1])
        i, j = np.arange(lo, hi)[:, None], np.arange(lo, end)[None, :]
        met = (j > i) & (j < last[lo:hi, None]) & (root[lo:hi, None] != root[None, lo:end])
        a, b = np.nonzero(met)
        for at in range(0, len(a), _COMPARED // BINS):
            x, y = a[at : at + _COMPARED // BINS] + lo, b[at : at + _COMPARED // BINS] + lo
            common = np.minimum(bins[x], bins[y]).sum(1, dtype=np.int64)
            most = np.floor((1.0 - least) * n[y] + 1e-9)
            room = np.maximum(filled[x], filled[y]) - common <= most
            for k in np.flatnonzero(room & (n[x] > LONG)):  # so y is long too
                room[k] = runs_leave_room(whole[x[k]][BINS:], whole[y[k]][BINS:], int(most[k]))
            yield order[x[room]], order[y[room]]
        lo = hi


def joined(part: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """``part`` (each element's part, named by its first element) after i and j,
    pair by pair, have come into one part."""
    part = part.copy()
    while True:
        a, b = part[i], part[j]
        apart = a != b
        if not apart.any():
            return part
        i, j = i[apart], j[apart]
        np.minimum.at(part, np.maximum(a, b)[apart], np.minimum(a, b)[apart])
        while (part[part] != part).any():
            part = part[part]


def by_key(rows: DataFrame, solved, schema: str, tasks: int | None = None) -> DataFrame:
    """``solved`` over the rows of each key (a table in, a batch out). Groups
    are dealt by key, the first column, and stream through their task in key order."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            keys = np.array(batch.column(0).to_pylist(), dtype=object)
            edges = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
            for lo, hi in zip(edges, np.append(edges[1:], len(keys))):
                if held and keys[lo] != now:
                    yield solved(pa.Table.from_batches(held).combine_chunks())
                    held = []
                now = keys[lo]
                held.append(batch.slice(int(lo), int(hi - lo)))
        if held:
            yield solved(pa.Table.from_batches(held).combine_chunks())

    dealt = rows.repartition(tasks, "key") if tasks else rows.repartition("key")
    return dealt.sortWithinPartitions("key").mapInArrow(work, schema)


def candidates(grouped: DataFrame, about: DataFrame, least: float) -> DataFrame:
    """(key, node) groups of bounded size -> key, node, head: the nodes that have
    a candidate in a group, and the smallest node of the part of candidates that
    each belongs to. The pairs themselves do not leave the task."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        node = t["node"].to_numpy()
        part, met = np.arange(len(node)), np.zeros(len(node), dtype=bool)
        for i, j in close_pairs(t["root"].to_numpy(), t["n"].to_numpy().astype(np.int64), t["bins"].to_pylist(), least):
            met[i] = met[j] = True
            part = joined(part, i, j)
        head = node.copy()
        np.minimum.at(head, part, node)
        return pa.RecordBatch.from_arrays([t["key"].combine_chunks().filter(pa.array(met)), pa.array(node[met]), pa.array(head[part][met])], names=["key", "node", "head"])

    rows = grouped.join(about, "node").select("key", "node", "root", "n", "bins")
    return by_key(rows, solved, "key string, node bigint, head bigint")


#: Nodes of two blocks that one task verifies.
SPAN = 512
#: Counts of words compared at once.
_COUNTED = 1 << 20


def shared_words(texts: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each text, how many words it has in common with every text (sizes of
    multiset intersections), from lists of the texts that have a word."""
    counted = [np.unique(t, return_counts=True) for t in texts]
    first = np.cumsum([0, *(len(u) for u, _ in counted)])
    _, ids = np.unique(np.concatenate([u for u, _ in counted]), return_inverse=True)
    times = np.concatenate([c for _, c in counted])
    order = np.argsort(ids, kind="stable")
    owner, listed = np.repeat(np.arange(len(texts)), np.diff(first))[order], times[order]
    long = np.bincount(ids)
    begin = np.cumsum(long) - long
    for d in range(len(texts)):
        own, n = ids[first[d] : first[d + 1]], times[first[d] : first[d + 1]]
        upto, lo, out = np.cumsum(long[own]), 0, np.zeros(len(texts))
        while lo < len(own):
            done = int(upto[lo - 1]) if lo else 0
            hi = max(lo + 1, int(np.searchsorted(upto, done + _COUNTED, side="right")))
            many = long[own[lo:hi]]
            spots = np.arange(int(many.sum())) + np.repeat(begin[own[lo:hi]] - (np.cumsum(many) - many), many)
            out += np.bincount(owner[spots], np.minimum(np.repeat(n[lo:hi], many), listed[spots]), len(texts))
            lo = hi
        yield out.astype(np.int64)


def links_within(texts: list[np.ndarray], root: np.ndarray, meets, here, least: float) -> list[tuple[int, int]]:
    """Links (i, j) of similar texts of a group that join its classes ``root``,
    closest pairs first. ``meets(i)`` marks the texts whose pair with i belongs
    to this group, as ``here(i, j)`` says of a single pair."""
    n = np.array([len(t) for t in texts])
    most = np.floor((1.0 - least) * n + 1e-9).astype(np.int64)
    place = np.arange(len(n))
    left, right, gaps = [], [], []
    for i, common in enumerate(shared_words(texts)):
        longer = (n > n[i]) | (n == n[i]) & (place > i)
        j = np.flatnonzero(longer & (n - common <= most) & (root != root[i]) & meets(i))
        left.append(np.full(len(j), i))
        right.append(j)
        gaps.append((n[j] - common[j]) / n[j])
    left, right = np.concatenate(left), np.concatenate(right)
    of = np.unique(root, return_inverse=True)[1].tolist()  # classes by number
    parent = list(range(len(of)))

    def top(c: int) -> int:
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    links = []
    for k in np.argsort(np.concatenate(gaps), kind="stable"):
        i, j = int(left[k]), int(right[k])
        a, b = top(of[i]), top(of[j])
        if a != b and here(i, j) and aligned(texts[i], texts[j], int(most[j])):
            parent[a] = b
            links.append((i, j))
    return links


def links_in_groups(rows: DataFrame, least: float, tasks: int) -> DataFrame:
    """(a, b): accepted links that join classes, fewer than nodes in each group.
    ``rows`` are (key, base, own, home, node, root, keys, words)."""

    def solved(t: pa.Table) -> pa.RecordBatch:
        node, own, home = t["node"].to_numpy(), t["own"].to_numpy(), t["home"].to_numpy()
        base, keys = t["base"][0].as_py(), [set(k) for k in t["keys"].to_pylist()]
        texts = [np.frombuffer(w, np.uint32) for w in t["words"].to_pylist()]
        found = links_within(texts, t["root"].to_numpy(), lambda i: (own != own[i]) | home[i], lambda i, j: min(keys[i] & keys[j]) == base, least)
        i, j = (np.array([x[side] for x in found], dtype=np.int64) for side in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[i], node[j])), pa.array(np.maximum(node[i], node[j]))], names=["a", "b"])

    return by_key(rows.select("key", "base", "own", "home", "node", "root", "keys", "words"), solved, "a bigint, b bigint", tasks)


def in_blocks(groups: DataFrame, most: int) -> DataFrame:
    """(key, node, ...) -> key, base, own, home, node, ...: groups of up to ``most``
    nodes, about. Larger ones are cut into blocks and every two blocks meet; ``base`` is
    the key before, ``own`` a node's block, and ``home`` says that the pairs
    within that block belong to this group."""
    sizes = groups.groupBy("key").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.where(F.col("size") > 1).select("key", F.ceil(F.col("size") * 2 / most).cast("bigint").alias("blocks"))
    zero, together = F.lit(0).cast("bigint"), F.col("blocks") <= 2
    dealt = groups.join(sizes, "key").withColumn("own", F.when(together, zero).otherwise(F.pmod(F.xxhash64("node"), "blocks")))
    dealt = dealt.withColumn("other", F.explode(F.when(together, F.array(zero)).otherwise(F.sequence(zero, F.col("blocks") - 1))))
    dealt = dealt.where(together | (F.col("own") != F.col("other")))
    home = together | (F.col("other") == (F.col("own") + 1) % F.col("blocks"))
    key = F.concat_ws(":", "key", F.least("own", "other"), F.greatest("own", "other"))
    return dealt.select(key.alias("key"), F.col("key").alias("base"), "own", home.alias("home"), *[c for c in groups.columns if c != "key"])


def fitting(groups: DataFrame, least: float) -> DataFrame:
    """(key, node, n) -> key, node: those with a text of fitting length in their
    group. Of all others, the next shorter and the next longer one fit best."""
    in_order = Window.partitionBy("key").orderBy("n")
    fits = lambda short, long: F.coalesce(long - F.floor((1.0 - least) * long + 1e-9) <= short, F.lit(False))
    placed = groups.withColumns({"short": F.lag("n").over(in_order), "long": F.lead("n").over(in_order)})
    return placed.where(fits(F.col("short"), F.col("n")) | fits(F.col("n"), F.col("long"))).select("key", "node")


def _items(words: bytes) -> np.ndarray:
    """A text's words with their occurrence numbers, as item hashes."""
    own = np.frombuffer(words, np.uint32).astype(np.uint64)
    return labelled_items(mix64(own), 1).view(np.int64) if len(own) else np.zeros(0, np.int64)


def item_counts(words: DataFrame) -> DataFrame:
    """(item, times): how many texts have each word."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            item, times = np.unique(np.concatenate([*(_items(w) for w in f["words"]), np.zeros(0, np.int64)]), return_counts=True)
            yield pd.DataFrame({"item": item, "times": times})

    return words.mapInPandas(count, "item bigint, times bigint").groupBy("item").agg(F.sum("times").alias("times"))


def prefixes(words: DataFrame, frequent: np.ndarray, least: float) -> DataFrame:
    """(node, words) -> node, n, item: number of words, and the first words of each
    text, ``frequent`` ones (in falling frequency) after all others."""
    order = np.argsort(frequent)
    told = words.sparkSession.sparkContext.broadcast((frequent[order], order))

    def first(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, place = told.value
        for f in frames:
            nodes, lengths, lists = [], [], []
            for node, w in zip(f["node"], f["words"]):
                items = _items(w)
                found = np.zeros(len(items), np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, items), len(known) - 1)
                    found = np.where(known[at] == items, len(known) - place[at], 0)
                lists.append(items[np.lexsort((items, found))][: int(np.floor((1.0 - least) * len(items) + 1e-9)) + 1])
                nodes.append(np.full(len(lists[-1]), node))
                lengths.append(np.full(len(lists[-1]), len(items)))
            if nodes:
                yield pd.DataFrame({"node": np.concatenate(nodes), "n": np.concatenate(lengths), "item": np.concatenate(lists)})

    return words.mapInPandas(first, "node bigint, n int, item bigint")


def crowded_links(members: DataFrame, state: DataFrame, nodes: DataFrame, words, least: float, group: int = GROUP) -> DataFrame | None:
    """(a, b): links of similar nodes that share a bucket, as many as it takes to
    join their classes; None if there is no candidate. ``members`` has the
    buckets (sketch, node, n) of four nodes or more: up to three, the ends have met
    everyone. ``nodes`` is (node, n, bins), ``words`` gives the word lists of the
    nodes it is given."""
    state = state.select("node", "root")
    placed = members.join(state, "node", "left").select("sketch", "node", F.coalesce("root", "node").alias("root"))
    open_ = placed.groupBy("sketch").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count(F.lit(1)).alias("size"))
    open_ = cut(open_.where(F.col("lo") != F.col("hi")).select("sketch", "size"))
    placed = cut(members.join(open_, "sketch").select("sketch", "node", "n", "size"))
    about = nodes.join(state, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "n", "bins")
    groups = placed.where(F.col("size") <= group).select(F.col("sketch").cast("string").alias("key"), "node", "n")
    large = cut(placed.where(F.col("size") > group).select("node").distinct())
    if large.limit(1).count():
        own = cut(words(large))
        top = item_counts(own).where(F.col("times") > 1).orderBy(F.col("times").desc(), "item").limit(FREQUENT).select("item").toPandas()
        first = cut(prefixes(own, top["item"].to_numpy(np.int64), least))
        groups = groups.unionByName(in_blocks(first.select(F.concat_ws(":", F.lit("word"), "item").alias("key"), "node", "n"), group).select("key", "node", "n"))
    found = cut(candidates(fitting(groups, least), about, least))
    if not found.limit(1).count():
        return None
    # parts of candidates over all buckets
    part = components(found.where(F.col("node") != F.col("head")).select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
    sizes = part.groupBy("root").agg(F.count(F.lit(1)).alias("size"))
    part = cut(part.withColumnRenamed("root", "part").join(sizes.withColumnRenamed("root", "part"), "part"))
    whole = part.where(F.col("size") <= group).select(F.concat_ws(":", F.lit("part"), "part").alias("key"), "node")
    wide = part.where(F.col("size") > group).select("node")
    groups = cut(whole.unionByName(found.join(wide, "node").select("key", "node")))
    keys = groups.groupBy("node").agg(F.collect_set(F.xxhash64("key")).alias("keys"))
    dealt = cut(in_blocks(groups, min(SPAN, group)).withColumn("base", F.xxhash64("base")))
    own = words(part.select("node")).join(keys, "node").join(about.select("node", "root"), "node")
    return cut(links_in_groups(dealt.join(own, "node"), least, -(-dealt.count() // SPAN)))


# ------------------------------------------------------------- verification ----


def common_words(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the multiset intersection."""
    ka, na = np.unique(a, return_counts=True)
    kb, nb = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(kb, ka), len(kb) - 1)
    same = kb[at] == ka
    return int(np.minimum(na[same], nb[at[same]]).sum())


def edit_distance_within(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance over words if it is at most ``most``, else None.

    A banded alignment with bit vectors (Hyyro 2003): of every column only the
    ``2 most + 1`` cells around the diagonal are kept, as differences of one bit
    each, and a column costs a few operations on long integers.
    """
    if abs(len(a) - len(b)) > most:
        return None
    n = min(len(a), len(b))
    if n:
        differ = a[:n] != b[:n]
        front = int(differ.argmax()) if differ.any() else n
        a, b = a[front:], b[front:]
        n = min(len(a), len(b))
        if n:
            differ = a[len(a) - n :][::-1] != b[len(b) - n :][::-1]
            back = int(differ.argmax()) if differ.any() else n
            a, b = a[: len(a) - back], b[: len(b) - back]
    if len(a) < len(b):
        a, b = b, a
    if not len(b):
        return len(a) if len(a) <= most else None
    most = min(most, len(a))
    width = 2 * most + 1
    full = (1 << width) - 1
    places: dict[int, int] = {}
    for i, word in enumerate(a.tolist()):
        places[word] = places.get(word, 0) | 1 << i
    up, down = ((1 << (most + 1)) - 1) << most, 0  # vertical differences +1 and -1
    distance, first = most, most + 1 - width  # in the lowest cell of the band; word of a at its highest
    corner, edge = 1 << (width - 1), 1 << (width - 2) if width > 1 else 0
    limit = most + len(b) - (len(a) - most)
    for j, word in enumerate(b.tolist()):
        match = places.get(word, 0)
        match = (match << -first if first < 0 else match >> first) & full
        zero = (((match & up) + up) ^ up | match | down) & full  # no cost along the diagonal
        plus, minus = down | (zero | up) ^ full, zero & up  # horizontal differences
        if j < len(a) - most:
            if not zero & corner:
                distance += 1
                if distance > limit:
                    return None
        else:
            distance += bool(plus & edge) - bool(minus & edge)
            edge >>= 1
        zero >>= 1
        up, down = minus | (zero | plus) ^ full, zero & plus
        first += 1
    return distance if distance <= most else None


def similar(a: np.ndarray, b: np.ndarray, least: float = SIMILARITY) -> bool:
    """Edit similarity over words of at least ``least``."""
    longer = max(len(a), len(b))
    most = int(np.floor((1.0 - least) * longer + 1e-9))
    if abs(len(a) - len(b)) > most or not len(a) or not len(b):
        return longer == 0
    return longer - common_words(a, b) <= most and aligned(a, b, most)


def aligned(a: np.ndarray, b: np.ndarray, most: int) -> bool:
    """Edit distance over words of at most ``most``, for texts with words."""
    longer = max(len(a), len(b))
    # an edit spoils two runs of two words at most
    runs = lambda x: x[:-1].astype(np.uint64) << np.uint64(32) | x[1:]
    if min(len(a), len(b)) > 1 and longer - 1 - common_words(runs(a), runs(b)) > 2 * most:
        return False
    return edit_distance_within(a, b, most) is not None


def with_room(pairs: DataFrame, about: DataFrame, least: float) -> DataFrame:
    """(a, b) of proposed pairs whose word histograms leave room for the
    similarity, so that only their words need to move."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, _COMPARED // BINS):
                batch = whole.slice(lo, _COMPARED // BINS)
                x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, BINS) for i in (4, 5))
                longer = np.maximum(batch.column(2).to_numpy(), batch.column(3).to_numpy())
                filled = np.maximum(x.sum(1, dtype=np.int64), y.sum(1, dtype=np.int64))
                room = filled - np.minimum(x, y).sum(1, dtype=np.int64) <= np.floor((1.0 - least) * longer + 1e-9)
                yield batch.filter(pa.array(room)).select(["a", "b"])

    slim = about.select("node", "n", F.substring("bins", 1, BINS).alias("bins"))
    side = lambda c: slim.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bins").alias(f"h{c}"))
    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ha", "hb").mapInArrow(check, "a bigint, b bigint")


def verified(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """Accepted pairs (a, b) of proposed ones."""

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            fine = [similar(np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32), least) for x, y in zip(f["wa"], f["wb"])]
            yield f.loc[fine, ["a", "b"]]

    b = words.select(F.col("node").alias("b"), F.col("words").alias("wb"))
    a = words.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    sides = pairs.join(b, "b").join(a, "a").select("a", "b", "wa", "wb")
    return sides.mapInPandas(check, "a bigint, b bigint")


# --------------------------------------------------------------- components ----


def components(links: DataFrame) -> DataFrame:
    """(a, b) -> node, root: connected components, each named by its smallest
    node. Every round takes the smallest root around, then the root's root
    (pointer jumping), until nothing changes; a finished round's files go."""
    spark = links.sparkSession
    both, edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "omh-links")
    state, path = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "omh-state")
    while True:
        near = both.join(state.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("m"))
        step = state.join(near.withColumnRenamed("a", "node"), "node").select("node", "root", F.least("root", "m").alias("next"))
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("far"))
        new, after = written(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), (F.least("next", "far") != F.col("root")).alias("moved")), "omh-state")
        removed(spark, path)
        state, path = new.select("node", "root"), after
        if not new.where("moved").limit(1).count():
            removed(spark, edges)
            return state


# ----------------------------------------------------------------- operator ----


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: float = SIMILARITY, broadcast_rows: int = 1_000_000, group: int = GROUP
) -> DataFrame:
    """row, id, class_id and class_key per document; the key tells classes apart
    whose ids are null or repeated. The documents are numbered once and stored
    with their numbers."""
    base = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    return _near_duplicates(numbered(base, "row", "omh"), least, broadcast_rows, group)


def _near_duplicates(base: DataFrame, least: float = SIMILARITY, broadcast_rows: int = 1_000_000, group: int = GROUP) -> DataFrame:
    """(row, id, text), stored -> row, id, class_id, class_key. A node, the
    documents of the same words, goes by the number of its first row."""
    base = base.select("row", "id", "text")
    with freed_shuffles(base.sparkSession):
        signed, nodes, state = _solved(base, least, broadcast_rows, group)
    named = nodes.join(state, "node", "left").select("c1", "c2", "least_id", F.coalesce("root", "node").alias("root"))
    classes = named.groupBy("root").agg(F.min("least_id").alias("class_id"))
    by_node = named.join(classes, "root").select("c1", "c2", "class_id", F.col("root").cast("string").alias("class_key"))
    told = signed.select("row", "id", "c1", "c2").join(by_node, ["c1", "c2"]).select("row", "id", "class_id", "class_key")
    alone = base.where(F.col("text").isNull())
    return told.unionByName(alone.select("row", "id", F.col("id").alias("class_id"), F.col("row").cast("string").alias("class_key")))


def _solved(base: DataFrame, least: float, broadcast_rows: int, group: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Signatures of the rows, the nodes, and (node, root) of those with links, all written."""
    signed = cut(signatures(base.where(F.col("text").isNotNull())))
    nodes = cut(signed.groupBy("c1", "c2").agg(F.min("id").alias("least_id"), F.min("row").alias("node")))
    one = signed.join(nodes.select(F.col("node").alias("row")), "row", "left_semi").withColumnRenamed("row", "node")
    lengths = one.select(F.explode("sketches").alias("sketch"), "node", "n")
    members = lengths.select("sketch", "node")
    ends = members.groupBy("sketch").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count(F.lit(1)).alias("n"))
    ends = cut(ends.where(F.col("lo") != F.col("hi")))
    crowded = lengths.join(ends.where(F.col("n") > 3).select("sketch"), "sketch")
    proposed = members.join(ends, "sketch").select("node", F.explode(F.array("lo", "hi")).alias("end")).where(F.col("node") != F.col("end"))
    # how often each pair is proposed, at most once per sketch and end
    counted = cut(proposed.groupBy(F.least("node", "end").alias("a"), F.greatest("node", "end").alias("b")).agg(F.count(F.lit(1)).alias("times")))

    def words(wanted: DataFrame) -> DataFrame:
        """Word lists of some nodes."""
        listed = small(wanted.select(F.col("node").alias("row")), broadcast_rows)
        return word_lists(base.join(listed, "row", "left_semi").select(F.col("row").alias("node"), "text"))

    def judged(pairs: DataFrame) -> DataFrame:
        """Accepted ones of proposed pairs: only the words of their nodes move."""
        pairs = cut(with_room(pairs.select("a", "b"), one, least))
        own = words(cut(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()))
        return cut(verified(pairs, own, least))

    # round one: each node with the partner it meets most often
    sides = F.array(F.struct(F.col("a").alias("n"), F.col("b").alias("o")), F.struct(F.col("b").alias("n"), F.col("a").alias("o")))
    best = counted.select(F.explode(sides).alias("e"), "times").groupBy("e.n").agg(F.max_by("e.o", F.struct("times", "e.o")).alias("o"))
    first = cut(best.select(F.least("n", "o").alias("a"), F.greatest("n", "o").alias("b")).distinct())
    links = judged(first)
    state = components(links)
    # round two: what still joins different classes
    root = lambda side: state.select(F.col("node").alias(side), F.col("root").alias(f"r{side}"))  # noqa: E731  (of the state so far)
    rest = counted.select("a", "b").join(first, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
    more = judged(rest.where(~F.coalesce("ra", "a").eqNullSafe(F.coalesce("rb", "b"))))
    if more.limit(1).count():
        links = links.union(more)
        state = components(links)
    # crowded buckets: what the ends left open
    more = crowded_links(crowded, state, one.select("node", "n", "bins"), words, least, group)
    if more is not None and more.limit(1).count():
        state = components(links.union(more))
    return signed, nodes, state


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """``docs`` with one document of each class: its smallest id (the first of
    several rows of that id); columns unchanged."""
    row = unique_name(docs.columns, "row")
    held = numbered(docs, row, "omh")
    base = held.select(F.col(row).alias("row"), F.col(doc_id).cast("bigint").alias("id"), F.col(text).cast("string").alias("text"))
    with freed_shuffles(docs.sparkSession):
        found = cut(_near_duplicates(base, **options))
    stay = found.groupBy("class_key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("m")).select("m.row")
    drop = small(found.join(stay, "row", "left_anti").select(F.col("row").alias(row)))
    return held.join(drop, row, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
