"""Seeded column permutations for permutation importance (WIN-10, WIN-11).

Rows are numbered once, 0 .. n-1, in a seeded md5 order. A draw permutes the
positions by arithmetic: a swap-or-not shuffle (Hoang, Morris, Rogaway 2012)
takes ``ROUNDS`` rounds; in each, position x has the counterpart
``y = (K - x) mod n`` and both change places if a keyed bit of ``max(x, y)`` is
set. That is a permutation of 0 .. n-1 whatever n, and its expressions run in
generated code and in any SQL engine. The value of the row at position x moves
to position pi(x).

So the rows are numbered once, whatever the number of draws, and nothing is
stored per draw. Rows and moved values travel packed, compressed by column, to
blocks of positions: every row once and every moved value once (``moved_rows``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from flowlens.operators.ranking import ORDER_BITS, dense_rank_in_group, order_prefix, seeded_order

ROUNDS = 8
#: Prime modulus of the keyed bit; twice its square fits a long.
PRIME = 2**31 - 1


def numbered_rows(df: DataFrame, key: str, seed: int) -> tuple[DataFrame, int]:
    """``df`` stored with its position ``_pos`` in the seeded order, and n."""
    ranked = dense_rank_in_group(df.withColumn("_order", order_prefix(seeded_order(seed, key))), [], "_order", "_pos")
    return ranked.drop("_order"), ranked.count()


def round_keys(seed: int, names: Sequence[object], rounds: int = ROUNDS) -> list[int]:
    """60 bits of md5 per round of a draw with these names."""
    text = "|".join(str(x) for x in (seed, *names))
    return [int(hashlib.md5(f"{text}|{i}".encode()).hexdigest()[:15], 16) for i in range(rounds)]


def _longs(values: Sequence[int]) -> str:
    """A constant array of longs, entry ``_draw`` of it."""
    return f"element_at(array({', '.join(f'{v}L' for v in values)}), _draw + 1)"


def _permuted_position(df: DataFrame, keys: Sequence[Sequence[int]], n: int) -> DataFrame:
    """``df`` (_pos, _draw, ...) with ``_pos`` replaced by pi(_pos) of its draw.

    Every round leaves through a generator of one row: a plain projection would
    let predicates on the result (a join adds one) be rewritten in terms of the
    rounds before, and each uses its position several times."""
    rest = [c for c in df.columns if c != "_pos"]
    for i in range(len(keys[0])):
        own = [k[i] for k in keys]
        other = f"(({_longs([h % n for h in own])} - _pos + {n}L) % {n}L)"
        top = f"(greatest(_pos, {other}) % {PRIME}L)"
        bit = f"({top} * {top} + {_longs([h % PRIME for h in own])} * {top} + {_longs([h // PRIME % PRIME for h in own])}) % {PRIME}L % 2L"
        df = df.select(*rest, F.expr(f"explode(array(if({bit} = 1L, {other}, _pos))) AS _pos"))
    return df


def moved_values(
    rows: DataFrame, n: int, draws: Sequence[Mapping[str, object]], moves: Sequence[Sequence[str]], seed: int = 42
) -> DataFrame:
    """(_to, _draw, _m0, _m1, ...): for every row and draw the values of the
    draw's columns, as doubles, and the position they move to. ``rows`` and
    ``n`` are ``numbered_rows``."""
    width = max(len(cols) for cols in moves)
    none = F.lit(None).cast("double")
    entries = [
        F.struct(
            F.lit(d).alias("_draw"),
            *[(F.col(f"`{cols[i]}`").cast("double") if i < len(cols) else none).alias(f"_m{i}") for i in range(width)],
        )
        for d, cols in enumerate(moves)
    ]
    long = rows.select("_pos", F.inline(F.array(*entries)))
    keys = [round_keys(seed, list(d.values())) for d in draws]
    return _permuted_position(long, keys, max(n, 1)).withColumnRenamed("_pos", "_to")


#: Blocks wanted; fewest and most rows of a block, most too of what a task
#: holds; most values (own and moved) of both; bits of the order that are counted.
BLOCKS, SMALLEST_BLOCK, LARGEST_BLOCK, HELD_VALUES, BUCKET_BITS = 96, 1 << 10, 1 << 18, 1 << 22, 16
#: Parts that rows of equal order can be cut into.
TIES = 1 << 16
#: Most decimal places of numbers that travel as whole ones, and fewest values
#: that are compressed together.
PLACES, SQUEEZED = 4, 512


def permuted_positions(pos: np.ndarray, keys: Sequence[int], n: int) -> np.ndarray:
    """``_permuted_position`` of one draw on an array of positions. ``PRIME`` is
    2**31 - 1, so remainders are folds of 31 bits."""
    for h in keys:
        other = h % n - pos
        other += np.where(other < 0, n, 0)
        top = np.maximum(pos, other)
        if n > PRIME:
            top %= PRIME
        mixed = (top + h % PRIME) * top + h // PRIME % PRIME
        for _ in range(2):
            mixed = (mixed & PRIME) + (mixed >> 31)
        # PRIME is odd: taking it away changes the last bit
        pos = np.where((mixed & 1).astype(bool) ^ (mixed >= PRIME), other, pos)
    return pos


def number_words(column: pa.Array) -> tuple[int, int, np.ndarray]:
    """(scale, null, words) of a column of doubles, bit for bit. Short decimals
    become a whole number of 32 bits and, above it, the steps from number / scale
    to the double; columns with others (scale 0) keep their bits. ``null`` is
    the word of missing values, 0 if there are none."""
    missing = column.is_null().to_numpy(zero_copy_only=False) if column.null_count else None
    x = np.ascontiguousarray((column if missing is None else column.fill_null(0.0)).to_numpy())
    bits, scale, null = x.view(np.int64), 0, 0
    with np.errstate(all="ignore"):
        for places in range(PLACES + 1):
            for some in (slice(64), slice(None)):  # a few rows rule most scales out
                number = np.rint(x[some] * 10.0**places)
                if fits := bool((np.abs(number) < 2.0**31).all()):
                    number = number.astype(np.int32)
                    steps = bits[some] - (number / 10.0**places).view(np.int64)
                    fits = bool(((steps >= -128) & (steps < 128)).all())
                if not fits:
                    break
            if fits:
                scale = 10**places
                break
    words = number.view(np.uint32) | steps.astype(np.uint8).astype(np.uint64) << np.uint64(32) if scale else bits.view(np.uint64)
    if missing is not None:
        null = 1 << 40 if scale else 0x7FF0000000000001
        while not scale and (words == np.uint64(null)).any():
            null += 1
        words = np.where(missing, np.uint64(null), words)
    return scale, null, words


def word_numbers(words: np.ndarray, scale: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The doubles of words and which are missing; a scale and a null for each word."""
    number = words.astype(np.uint32).view(np.int32)
    steps = (words >> np.uint64(32)).astype(np.uint8).view(np.int8)
    bits = np.where(scale > 0, (number / np.maximum(scale, 1)).view(np.int64) + steps, words.view(np.int64))
    return bits.view(np.float64), (null > 0) & (words == null)


def squeezed(columns: Sequence[np.ndarray]) -> bytes:
    """Columns of words, compressed byte by byte; short columns go together."""
    codec, out, run, count = pa.Codec("zstd", 1), [], [], 0
    for i, words in enumerate(columns):
        run.append(words)
        count += len(words)
        if count >= SQUEEZED or i == len(columns) - 1:
            planes = np.ascontiguousarray(np.concatenate(run).view(np.uint8).reshape(-1, 8).T)
            parts = [codec.compress(x, asbytes=True) if x.any() else b"" for x in planes]
            out += [np.array([count, *map(len, parts)], np.int32).tobytes(), *parts]
            run, count = [], 0
    return b"".join(out)


def unsqueezed(data: bytes) -> np.ndarray:
    """The words of ``squeezed``, column after column."""
    codec, out, at = pa.Codec("zstd"), [np.empty(0, np.uint64)], 0
    while at < len(data):
        count, *sizes = np.frombuffer(data, np.int32, 9, at).tolist()
        at += 36
        planes = np.zeros((8, count), np.uint8)
        for plane, size in zip(planes, sizes):
            if size:
                plane[:] = np.frombuffer(codec.decompress(data[at : at + size], count), np.uint8)
            at += size
        out.append(np.ascontiguousarray(planes.T).view(np.uint64).ravel())
    return np.concatenate(out)


def sealed(rows: pa.Table) -> bytes:
    """A table of any columns, compressed."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as stream:
        stream.write_table(rows)
    data = sink.getvalue()
    return data.size.to_bytes(8, "little") + pa.Codec("zstd", 1).compress(data, asbytes=True)


def unsealed(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"))).read_all()


class Blocks:
    """The seeded order cut into blocks of following positions, from counts of
    its leading bits. A block has the rows from one bound of the order to the
    next; rows of equal order that are too many for a block are cut by their
    contents (``_tie``). ``firsts`` has every block's first position, and n."""

    def __init__(self, keyed: DataFrame, width: int):
        bucket_of = F.shiftright("_order", ORDER_BITS - BUCKET_BITS)
        hist = keyed.groupBy(bucket_of.alias("_bucket")).count().toArrow().sort_by("_bucket")
        bucket, count = (hist.column(i).to_numpy() for i in range(2))
        self.n = int(count.sum())
        most = max(SMALLEST_BLOCK, min(LARGEST_BLOCK, HELD_VALUES // width, -(-self.n // BLOCKS)))
        begins = np.flatnonzero(np.diff((np.cumsum(count) - count) // most, prepend=-1))
        self.bounds, sizes = bucket[begins].astype(np.int64) << ORDER_BITS - BUCKET_BITS, count[:0]
        self.bounds[:1] = 0
        if self.n:
            sizes = np.add.reduceat(count, begins)
        tied = {}
        if (count > most).any():
            crowded = keyed.where(bucket_of.isin(bucket[count > most].tolist()))
            tied = dict(map(tuple, crowded.groupBy("_order").count().where(F.col("count") > most).collect()))
        self.tied, self.parts = bool(tied), np.ones(len(begins), np.int64)
        if tied:
            self.bounds = np.unique([*self.bounds, *tied, *(v + 1 for v in tied)])
            self.parts = np.array([-(-tied.get(v, 1) // most) for v in self.bounds.tolist()])
        self.base = np.cumsum(self.parts) - self.parts
        if tied:

            def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                for b in batches:
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in np.unique(self.of(b), return_counts=True)], names=["_block", "_c"])

            sizes = np.zeros(self.parts.sum(), np.int64)
            for block, c in keyed.mapInArrow(counted, "_block bigint, _c bigint").groupBy("_block").agg(F.sum("_c")).collect():
                sizes[block] = c
        self.firsts = np.append(0, np.cumsum(sizes))

    def of(self, rows: pa.RecordBatch | pa.Table) -> np.ndarray:
        """The block of each row."""
        at = np.searchsorted(self.bounds, rows.column("_order").to_numpy(), "right") - 1
        return self.base[at] + rows.column("_tie").to_numpy() * self.parts[at] // TIES if self.tied else at


def moved_rows(
    sample: DataFrame, draws: Sequence[Mapping[str, object]], moves: Sequence[Sequence[str]], key: str, seed: int = 42
) -> DataFrame:
    """Every row once, with the columns of ``sample`` and in ``_m<d>_<i>`` the
    value that draw ``d`` moves here from its column ``i``, as a double.

    Positions are cut into blocks of bounded size (``Blocks``). Rows travel once,
    compressed by column, to their block, which numbers them and sends every block
    the values that move there, in the order of their positions. A block knows by
    arithmetic which positions these are, so the values travel alone, and has its
    own rows from the exchange that numbered them. Nothing is sorted by (position,
    draw), and nothing is written but these two exchanges."""
    used = list(dict.fromkeys(c for cols in moves for c in cols))
    told = {c: f"_c{j}" for j, c in enumerate(sample.columns)}  # names that need no quoting
    doubles = [told[f.name] for f in sample.schema if f.dataType == DoubleType()]
    rest = [x for x in told.values() if x not in doubles]
    cast = {c: f"_v{i}" for i, c in enumerate(used) if told[c] in rest}
    numbers = [*doubles, *cast.values()]
    place = {c: numbers.index(cast.get(c, told[c])) for c in used}
    moved = [f"_m{d}_{i}" for d, cols in enumerate(moves) for i in range(len(cols))]
    # the moved columns (draw, number in it) in the order in which a piece has
    # them, by column; neighbours of one draw are handled together
    slots = sorted(((d, i) for d, cols in enumerate(moves) for i in range(len(cols))), key=lambda x: used.index(moves[x[0]][x[1]]))
    draw_of, used_of = np.array([d for d, _ in slots]), np.array([used.index(moves[d][i]) for d, i in slots])
    ends = [s + 1 for s in range(len(slots)) if s + 1 == len(slots) or slots[s + 1][0] != slots[s][0]]
    runs = [(slots[a][0], a, b) for a, b in zip([0, *ends], ends)]

    order = order_prefix(seeded_order(seed, F.col(f"`{key}`")))
    tie = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in dict.fromkeys((key, *used))]), F.lit(TIES))
    blocks = Blocks(sample.select(order.alias("_order"), tie.alias("_tie")), len(told) + len(moved))
    n, firsts = blocks.n, blocks.firsts
    keys = [round_keys(seed, list(d.values())) for d in draws]
    most = max(1, min(LARGEST_BLOCK, HELD_VALUES // (len(told) + len(numbers))))

    def packed(held: list[pa.RecordBatch], task: int, nth: int) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        block = blocks.of(t)
        by_block = np.argsort(block, kind="stable")
        t = t.take(pa.array(by_block))
        found, begins = np.unique(block[by_block], return_index=True)
        coded = [number_words(t.column(c).combine_chunks()) for c in numbers]
        about = np.array([x[:2] for x in coded], np.uint64).ravel()
        words = [t.column("_order").to_numpy().view(np.uint64), *[x[2] for x in coded]]
        others, values, parts = t.select(rest).combine_chunks(), [], []
        for a, b in zip(begins.tolist(), [*begins[1:].tolist(), t.num_rows]):
            values.append(squeezed([about, *[w[a:b] for w in words]]))
            parts.append(sealed(others.slice(a, b - a)) if rest else b"")
        size = len(found)
        return pa.RecordBatch.from_arrays(
            [pa.array(found, pa.int64()), *[pa.array([x] * size, pa.int32()) for x in (task, nth)], *[pa.array(x, pa.binary()) for x in (values, parts)]],
            names=["_block", "_task", "_nth", "_values", "_rest"],
        )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, count, nth, task = [], 0, 0, TaskContext.get().partitionId()
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
            if count >= most:
                yield packed(held, task, nth)
                held, count, nth = [], 0, nth + 1
        if held:
            yield packed(held, task, nth)

    def numbered(t: pa.Table) -> tuple[int, pa.Table, np.ndarray, np.ndarray, np.ndarray]:
        """A block's number, its pieces, the order of their rows, and in this
        order its doubles and which are missing."""
        t = t.sort_by([("_task", "ascending"), ("_nth", "ascending")])
        block, k, orders, values = t.column("_block")[0].as_py(), len(numbers), [], []
        for data in t.column("_values").to_pylist():
            words = unsqueezed(data)
            about, words = words[: 2 * k].reshape(k, 2).view(np.int64), words[2 * k :].reshape(k + 1, -1)
            orders.append(words[0].view(np.int64))
            values.append(word_numbers(words[1:], about[:, :1], about[:, 1:].view(np.uint64)))
        by_order = np.argsort(np.concatenate(orders), kind="stable")
        if len(by_order) != firsts[block + 1] - firsts[block]:
            raise ValueError("the rows changed while they were read")
        x, missing = (np.concatenate([v[i] for v in values], axis=1)[:, by_order] for i in range(2))
        return block, t, by_order, x, missing

    def send(t: pa.Table) -> pa.Table:
        block, _, _, x, missing = numbered(t)
        pos = np.arange(firsts[block], firsts[block + 1])
        coded = [number_words(pa.array(x[place[c]], mask=missing[place[c]])) for c in used]
        about = np.array([c[:2] for c in coded], np.uint64).ravel()
        begins, by_block = [], []
        for k in keys:
            to = np.searchsorted(firsts, permuted_positions(pos, k, n), "right") - 1
            # numbers of 16 bits are sorted digit by digit
            by_block.append(np.argsort(to.astype(np.uint16) if len(firsts) <= 1 << 16 else to, kind="stable"))
            begins.append(np.searchsorted(to[by_block[-1]], np.arange(len(firsts))))
        found = np.flatnonzero((np.diff(begins, axis=1) > 0).any(axis=0)).tolist()
        words = [(begins[d].tolist(), np.stack([coded[u][2][by_block[d]] for u in used_of[a:b]])) for d, a, b in runs]
        pieces = [squeezed([about, *[w[:, e[j] : e[j + 1]].ravel() for e, w in words]]) for j in found]
        return pa.table({"_block": pa.array(found, pa.int64()), "_from": pa.array([block] * len(found), pa.int64()), "_piece": pa.array(pieces, pa.binary())})

    def meet(own: pa.Table, sent: pa.Table) -> pa.Table:
        block, own, by_order, x, missing = numbered(own)
        pos = np.arange(firsts[block], firsts[block + 1])
        came, begins = [], []
        for k in keys:
            source = permuted_positions(pos, k[::-1], n)
            came.append(np.argsort(source))
            begins.append(np.searchsorted(source[came[-1]], firsts))
        lengths, begins = np.diff(begins, axis=1)[draw_of], [b.tolist() for b in begins]
        values, lost = np.empty((len(slots), len(pos))), np.zeros((len(slots), len(pos)), bool)
        sent, k = sent.sort_by("_from"), 2 * len(used)
        for j, data in zip(sent.column("_from").to_pylist(), sent.column("_piece").to_pylist()):
            words = unsqueezed(data)
            about, words = words[:k].reshape(-1, 2)[np.repeat(used_of, lengths[:, j])], words[k:]
            number, gone = word_numbers(words, about[:, 0].view(np.int64), about[:, 1])
            at, some = 0, gone.any()
            for d, a, b in runs:
                to = came[d][begins[d][j] : begins[d][j + 1]]
                end = at + (b - a) * len(to)
                values[a:b, to] = number[at:end].reshape(b - a, -1)
                if some:
                    lost[a:b, to] = gone[at:end].reshape(b - a, -1)
                at = end
        arrays = {c: pa.array(x[i], mask=missing[i]) for i, c in enumerate(doubles)}
        if rest:
            others = pa.concat_tables([unsealed(y) for y in own.column("_rest").to_pylist()]).take(pa.array(by_order))
            arrays |= {c: others.column(c) for c in rest}
        arrays |= {f"_m{d}_{i}": pa.array(values[s], mask=lost[s]) for s, (d, i) in enumerate(slots)}
        return pa.table({c: arrays[c] for c in (*told.values(), *moved)})

    tied = [tie.alias("_tie")] if blocks.tied else []
    rows = sample.select(
        order.alias("_order"), *tied, *[F.col(f"`{c}`").alias(x) for c, x in told.items()], *[F.col(f"`{c}`").cast("double").alias(x) for c, x in cast.items()]
    ).mapInArrow(pack, "_block bigint, _task int, _nth int, _values binary, _rest binary")
    sent = rows.groupBy("_block").applyInArrow(send, "_block bigint, _from bigint, _piece binary")
    met = StructType([StructField(told[f.name], f.dataType) for f in sample.schema] + [StructField(c, DoubleType()) for c in moved])
    out = rows.groupBy("_block").cogroup(sent.groupBy("_block")).applyInArrow(meet, met)
    return out.select(*[F.col(x).alias(c) for c, x in told.items()], *moved)


def shuffled_rows(
    sample: DataFrame, draws: Sequence[Mapping[str, object]], moves: Sequence[Sequence[str]], key: str, seed: int = 42
) -> DataFrame:
    """Every row once per draw: its columns, the draw's names and values, the
    draw's number ``_draw`` and in ``_m0, _m1, ...`` the values its draw moves
    here, in the order of ``moves``."""
    width = max(len(cols) for cols in moves)
    none = F.lit(None).cast("double")
    entries = [
        F.struct(
            *[F.lit(v).alias(name) for name, v in draw.items()],
            F.lit(d).alias("_draw"),
            *[(F.col(f"_m{d}_{i}") if i < len(cols) else none).alias(f"_m{i}") for i in range(width)],
        )
        for d, (draw, cols) in enumerate(zip(draws, moves))
    ]
    rows = moved_rows(sample, draws, moves, key, seed)
    return rows.select(*[F.col(f"`{c}`") for c in sample.columns], F.inline(F.array(*entries)))


def permuted_long(sample: DataFrame, features: Sequence[str], key: str, repeats: int = 5, seed: int = 42) -> DataFrame:
    """(key, feature, repeat, value, permuted_value): each (feature, repeat) is
    an independent shuffle of that one column."""
    draws = [{"feature": f, "repeat": r} for f in features for r in range(repeats)]
    rows = moved_rows(sample.select(key, *features), draws, [[d["feature"]] for d in draws], key, seed)
    entries = [
        F.struct(
            F.lit(x["feature"]).alias("feature"), F.lit(x["repeat"]).alias("repeat"),
            F.col(f"`{x['feature']}`").cast("double").alias("value"), F.col(f"_m{d}_0").alias("permuted_value"),
        )
        for d, x in enumerate(draws)
    ]
    return rows.select(key, F.inline(F.array(*entries)))


def group_permuted_long(sample: DataFrame, groups: Mapping[str, Sequence[str]], key: str, seed: int = 42) -> DataFrame:
    """(key, group, feature, value, permuted_value): all columns of a group move
    together with one permutation of the rows (only existing columns used)."""
    present = {g: [c for c in cols if c in sample.columns] for g, cols in groups.items()}
    present = {g: cols for g, cols in present.items() if cols}
    used = list(dict.fromkeys(c for cols in present.values() for c in cols))
    rows = moved_rows(sample.select(key, *used), [{"group": g} for g in present], list(present.values()), key, seed)
    entries = [
        F.struct(F.lit(g).alias("group"), F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("value"), F.col(f"_m{d}_{i}").alias("permuted_value"))
        for d, (g, cols) in enumerate(present.items())
        for i, c in enumerate(cols)
    ]
    return rows.select(key, F.inline(F.array(*entries)))
