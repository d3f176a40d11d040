"""Conversation repair by prefix-doubling path ranking (operator 13).

A conversation's rows become a cheapest edit script after which their role
initials read ``(s?(ua)+)?``: an optional system turn, then user and assistant
in turn, or nothing. Edits are K(eep), R(erole to user or assistant, 2),
D(elete, 3; required for blank and duplicate rows) and I(nsert an empty user or
assistant turn, 2); a truncated row that stays costs 1 more. The audit is the
string of the edits' initials; of several cheapest ones it is the ASCII-least.

1. *Cost DP.* Nodes are (rows consumed, state) with the states start, after s,
   after u, after a. Costs to the end are found backwards, row by row.
2. *Optimal arcs.* An arc is optimal if its cost and its end's cost make up
   its node's cost. No optimal path has a cycle, as inserts cost something.
3. *Ranks.* Nodes are ranked by the least audit of length 1, 2, 4, ... that
   starts there: a node's pair (its rank, least rank at the ends of its least
   paths so far) gives its rank for twice the length, and its pointers move on
   to those ends. When all pointers have arrived, ranks order whole audits.
4. *Path.* From the start, the arc of least (letter, rank of its end) is taken.
   A node and a letter determine the next node, so the audit also determines
   the repaired rows.

Scale: rows are numbered once and stored; ordering works on slim rows (keys, a
hash and a code of one byte) in range partitions over (conversation, turn,
role, hash, number), so neither a long conversation nor a row repeated without
end lands in one task. Chunks of at most ``CHUNK`` rows gather codes; a
conversation then gathers one byte a row, as its audit does. Costs are kept at
every ``BLOCK`` rows and worked out again inside a block, so memory grows by
one byte a row. Copies are found by the smallest place of each (conversation,
role, text) in an aggregate with a map-side part, and joined back by place, a
key without repeats. Texts move in chunks; those of a conversation of several
chunks run through one digest in order, chunk by chunk (SHA-256 is sequential).

Defined cases: null conversation ids are one conversation; null turns come
first and do not count for gaps; null roles and texts are one space; rows of
equal turn are taken in the order of role and text hash, a repeated row next to
its copy; conversations all of whose rows are dropped have zeros, an empty
audit and the hash of the empty string; an empty table gives an empty result;
other columns, whatever their names, are ignored. An audit is one string, so a
conversation may have 2**31 edits at most.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens.llm.common import numbered
from flowlens.session import stored

CHUNK = 1 << 14
BLOCK = 1 << 14
#: Rows of a range partition, about.
RANGE_ROWS = 1_000_000
#: Rows that a task repairs, about.
REPAIR_ROWS = 8_192

#: Codes of a row: two bits for the initial, then flags.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
MUST_GO, TRUNCATED = 4, 8

START, AFTER_S, AFTER_U, AFTER_A = range(4)
#: State after the one turn that may be inserted or reroled in each state.
ONWARD = (AFTER_U, AFTER_U, AFTER_A, AFTER_U)
_KEEP_COST, _REROLE_COST, _DELETE_COST, _INSERT_COST, _TRUNCATED_COST = 0, 2, 3, 2, 1
DELETE, INSERT, KEEP, REROLE = range(4)  # in ASCII order of D, I, K, R
LETTERS = "DIKR"
_FAR = 1 << 60

VISIBLE = r"[^\x20\x09-\x0D]"


# ------------------------------------------------------------------- repair ----


def kept_state(state: int, code: int) -> int | None:
    """State after a row of this code is kept, None if it may not be."""
    initial = code & 3
    if initial == SYSTEM and state == START:
        return AFTER_S
    if initial == USER and state != AFTER_U:
        return AFTER_U
    if initial == ASSISTANT and state == AFTER_U:
        return AFTER_A
    return None


def row_arcs(state: int, code: int) -> list[tuple[int, int, int]]:
    """(letter, cost, next state) of the edits that consume a row."""
    out = [(DELETE, _DELETE_COST, state)]
    if not code & MUST_GO:
        more = _TRUNCATED_COST if code & TRUNCATED else 0
        after = kept_state(state, code)
        if after is not None:
            out.append((KEEP, _KEEP_COST + more, after))
        out.append((REROLE, _REROLE_COST + more, ONWARD[state]))
    return out


#: By code and state; the codes are fewer than 16.
ROW_ARCS = [[row_arcs(s, code) for s in range(4)] for code in range(16)]


def with_inserts(costs: list[int]) -> tuple[int, ...]:
    """Costs of four states when turns may be inserted first (two at most help)."""
    out = []
    for s in range(4):
        once = ONWARD[s]
        out.append(min(costs[s], _INSERT_COST + costs[once], 2 * _INSERT_COST + costs[ONWARD[once]]))
    return tuple(out)


END = with_inserts([0, _FAR, _FAR, 0])


def costs_before(code: int, after: tuple[int, ...]) -> tuple[int, ...]:
    """Costs to the end in front of a row, from those behind it."""
    return with_inserts([min(cost + after[to] for _, cost, to in ROW_ARCS[code][s]) for s in range(4)])


def checkpoints(codes: np.ndarray, block: int = BLOCK) -> list[tuple[int, ...]]:
    """Costs at rows 0, block, 2 block, ... and at the end."""
    at, out = END, [END] if len(codes) else [END, END]
    for i in range(len(codes) - 1, -1, -1):
        at = costs_before(int(codes[i]), at)
        if i % block == 0:
            out.append(at)
    return out[::-1]


def block_arcs(codes: np.ndarray, behind: tuple[int, ...], last: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, letter) of the optimal arcs of a block; node 4 i + s. Inserts
    behind its last row belong to the next block, if there is one."""
    arcs = []
    costs = [behind]
    for code in codes[::-1]:
        costs.append(costs_before(int(code), costs[-1]))
    costs.reverse()
    for i, here in enumerate(costs):
        at_end = i == len(codes)
        if at_end and not last:
            break
        for s in range(4):
            if here[s] >= _FAR:
                continue
            if here[s] == _INSERT_COST + here[ONWARD[s]]:
                arcs.append((4 * i + s, 4 * i + ONWARD[s], INSERT))
            if not at_end:
                for letter, cost, to in ROW_ARCS[int(codes[i])][s]:
                    if here[s] == cost + costs[i + 1][to]:
                        arcs.append((4 * i + s, 4 * i + 4 + to, letter))
    found = np.array(arcs, dtype=np.int64).reshape(-1, 3)
    return found[:, 0], found[:, 1], found[:, 2]


def audit_ranks(nodes: int, source: np.ndarray, target: np.ndarray, letter: np.ndarray) -> np.ndarray:
    """Rank of every node by the least audit that starts there.

    ``source -> target`` are the arcs. Nodes without an arc end an audit.
    Pointers of a node are the ends of its least paths of the length reached.
    """
    rank = np.zeros(nodes, dtype=np.int64)
    least = np.full(nodes, len(LETTERS), dtype=np.int64)
    np.minimum.at(least, source, letter)
    leaves = least < len(LETTERS)
    rank[leaves] = least[leaves] + 1
    first = letter == least[source]
    start, end = source[first], target[first]
    while leaves[end].any():
        # nodes at the end of an audit point to themselves
        nearest = np.zeros(nodes, dtype=np.int64)
        nearest[leaves] = nodes + len(LETTERS)
        np.minimum.at(nearest, start, rank[end])
        _, rank_of_pair = np.unique(rank * (nodes + len(LETTERS) + 1) + nearest, return_inverse=True)
        stay = rank[end] == nearest[start]
        start, end = start[stay], end[stay]
        # pointers move on: each to all the pointers of its end
        order = np.argsort(start, kind="stable")
        begin = np.searchsorted(start[order], end, side="left")
        many = np.searchsorted(start[order], end, side="right") - begin
        reach = np.maximum(many, 1)
        owner = np.repeat(np.arange(len(start)), reach)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(reach) - reach, reach)
        further = end[order][np.minimum(begin[owner] + nth, len(order) - 1)]
        moved = np.unique(start[owner] * nodes + np.where(many[owner] > 0, further, end[owner]))
        start, end = moved // nodes, moved % nodes
        rank = rank_of_pair.reshape(-1)
        # an ended audit ranks before all others
        rank = np.where(leaves, rank + 1, 0)
    return rank


def repair(codes: np.ndarray, block: int = BLOCK) -> tuple[int, str, np.ndarray, list[int]]:
    """(cost, audit, edit of each row, inserts behind the last row).

    An edit is letter + 4 * inserts + 36 * r, with ``inserts`` the turns inserted
    in front of the row as a number in base 3 (first turn first, 1 user, 2
    assistant, two at most) and r 1 if the row is reroled to assistant.
    """
    marks = checkpoints(codes, block)
    edits = np.zeros(len(codes), dtype=np.int8)
    audit: list[str] = []
    state, pending = START, []
    blocks = max(1, -(-len(codes) // block))
    for b in range(blocks):
        own = codes[b * block : (b + 1) * block]
        source, target, letter = block_arcs(own, marks[b + 1], b == blocks - 1)
        rank = audit_ranks(4 * len(own) + 4, source, target, letter)
        order = np.lexsort((rank[target], letter, source))
        source, target, letter = source[order], target[order], letter[order]
        best = {}
        for s, t, x in zip(source[::-1].tolist(), target[::-1].tolist(), letter[::-1].tolist()):
            best[s] = (t, x)
        node = state
        while node in best:
            to, x = best[node]
            audit.append(LETTERS[x])
            if x == INSERT:
                pending.append(1 if to % 4 == AFTER_U else 2)
            else:
                inserted = 0
                for turn in pending:
                    inserted = 3 * inserted + turn
                edits[b * block + node // 4] = x + 4 * inserted + 36 * (x == REROLE and to % 4 == AFTER_A)
                pending = []
            node = to
        state = node % 4
    return marks[0][START], "".join(audit), edits, pending


def illegal_pairs(codes: np.ndarray) -> int:
    """Adjacent rows whose initials are neither su, ua nor au."""
    a, b = codes[:-1] & 3, codes[1:] & 3
    fine = ((a == SYSTEM) & (b == USER)) | ((a == USER) & (b == ASSISTANT)) | ((a == ASSISTANT) & (b == USER))
    return int((~fine).sum())


# ------------------------------------------------------------------- damage ----


def damaged(rows: DataFrame) -> DataFrame:
    """(rid, conv_id, turn, role, text) with nulls as one space and the
    contract's damage: ``copies`` is 0 for a dropped row, 2 for a repeated one."""
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.encode(F.concat(said("conv_id"), F.lit(":"), said("turn")), "UTF-8")) % 20
    text = F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(said("text"), r"[.!?]", "")).otherwise(said("text"))
    return rows.select(
        "rid",
        "conv_id",
        "turn",
        F.when(kind == 4, F.lit("user")).otherwise(said("role")).alias("role"),
        text.alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int").alias("copies"),
    )


def row_code(role: str, text: str) -> Column:
    """Initial and truncation of a row as a code, blank rows as MUST_GO."""
    initial = F.substring(role, 1, 1)
    first = F.when(initial == "s", SYSTEM).when(initial == "u", USER).when(initial == "a", ASSISTANT).otherwise(OTHER)
    blank = ~F.col(text).rlike(VISIBLE)
    ended = F.col(text).rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return (first + F.when(blank, MUST_GO).when(~ended, TRUNCATED).otherwise(0)).cast("int")


def _placed(slim: DataFrame) -> tuple[DataFrame, int]:
    """Rows in order, with ``place``: consecutive inside a range partition, so
    the rows of a conversation are in order of place. Stored. And how many tasks
    the repair of so many rows should have: codes are few bytes but much work."""
    rows = slim.count()
    order = ["conv_id", "turn", "role", "hash", "rid", "nth"]
    parts = max(1, -(-rows // RANGE_ROWS))
    parts = max(parts, min(int(slim.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // 4096)))
    inside = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return stored(inside.withColumn("place", F.monotonically_increasing_id()), "repair-placed"), max(1, -(-rows // REPAIR_ROWS))


_CUTS = pa.list_(pa.struct([("chunk", pa.int64()), ("edits", pa.list_(pa.int8()))]))


def _scripts(convs: DataFrame) -> DataFrame:
    """One row a conversation: its script, cut into the chunks of its rows."""
    kind = dict(convs.dtypes)["conv_id"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            illegal, costs, audits, all_cuts, tails = [], [], [], [], []
            for chunks, sizes, codes in zip(*(batch.column(i) for i in (1, 2, 3))):
                codes = codes.values.to_numpy(zero_copy_only=False)
                cost, audit, edits, tail = repair(codes)
                lo, cuts = 0, []
                for chunk, size in zip(chunks.as_py(), sizes.as_py()):
                    cuts.append({"chunk": chunk, "edits": edits[lo : lo + size]})
                    lo += size
                illegal.append(illegal_pairs(codes))
                costs.append(cost)
                audits.append(audit)
                all_cuts.append(cuts)
                tails.append("\n".join(("user:", "assistant:")[t - 1] for t in tail) if tail else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(illegal, pa.int64()), pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(all_cuts, _CUTS), pa.array(tails, pa.string())],
                names=["conv_id", "illegal", "cost", "audit", "cuts", "tail"],
            )

    schema = f"conv_id {kind}, illegal bigint, cost bigint, audit string, cuts array<struct<chunk:bigint,edits:array<tinyint>>>, tail string"
    return convs.mapInArrow(work, schema)


def _inserted(number: Column) -> Column:
    """Lines of the turns inserted, from their number in base 3."""
    name = lambda d: F.when(d == 1, "user:").when(d == 2, "assistant:")
    return F.concat_ws("\n", name(F.floor(number / 3)), name(number % 3))


def _lines(rows: DataFrame) -> DataFrame:
    """(.., edit, role, text) -> conv_id, chunk, at, lines: what is inserted in
    front of a row, then the row itself if it stays, joined by newlines."""
    letter, inserted = F.col("edit") % 4, F.floor(F.col("edit") % 36 / 4)
    role = F.when(letter == KEEP, F.col("role")).otherwise(F.when(F.col("edit") >= 36, "assistant").otherwise("user"))
    own = F.when(letter >= KEEP, F.concat(role, F.lit(":"), F.col("text")))
    lines = F.when(inserted == 0, own).when(own.isNull(), _inserted(inserted)).otherwise(F.concat(_inserted(inserted), F.lit("\n"), own))
    return rows.select("conv_id", "chunk", "at", lines.alias("lines"))


def _digests(lines: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: every conversation's lines in order, as one
    stream. A task holds one batch of lines and one digest."""
    kind = dict(lines.dtypes)["conv_id"]
    streamed = lines.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "at").select("conv_id", "lines")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([now, pa.array([digest.hexdigest()], pa.string())], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            ids = batch.column(0)
            for i, line in enumerate(batch.column(1)):
                own = ids.slice(i, 1)
                if now is None or own != now:
                    if digest is not None:
                        yield told()
                    now, digest = own, hashlib.sha256(line.as_buffer())
                else:
                    digest.update(b"\n")
                    digest.update(line.as_buffer())
        if digest is not None:
            yield told()

    return streamed.mapInArrow(work, f"conv_id {kind}, repaired_sha256 string")


def _on_conversation(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join by conv_id, null being one conversation."""
    other = right.withColumnRenamed("conv_id", "their_conv")
    return left.join(other, F.col("conv_id").eqNullSafe(F.col("their_conv")), how).drop("their_conv")


def repair_conversations(conversations: DataFrame, chunk_rows: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """(report, lines).

    report: one row per conversation with gaps, blank, duplicate, truncated,
    illegal, cost, audit and repaired_sha256. lines: conv_id and the repaired
    lines in the order of (chunk, at).
    """
    raw = numbered(conversations.select("conv_id", "turn", "role", "text"), "rid", "repair-rows")
    rows = damaged(raw)
    slim = rows.where(F.col("copies") > 0).select(
        "rid", "conv_id", "turn", "role", F.md5("text").alias("hash"), row_code("role", "text").alias("code"), F.explode(F.sequence(F.lit(1), "copies")).alias("nth")
    )
    placed, tasks = _placed(slim)
    # the first of equal rows of a conversation
    first = placed.groupBy("conv_id", "role", "hash").agg(F.min("place").alias("place")).select("place", F.lit(True).alias("first"))
    blank = F.col("code").bitwiseAND(F.lit(MUST_GO)) != 0
    copy = ~blank & F.col("first").isNull()
    cut_off = ~blank & ~copy & (F.col("code").bitwiseAND(F.lit(TRUNCATED)) != 0)
    code = F.when(copy, F.col("code").bitwiseAND(F.lit(3)) + MUST_GO).otherwise(F.col("code")).cast("tinyint")
    judged = placed.join(first, "place", "left").select(
        "rid", "conv_id", "turn", "place", F.floor(F.col("place") / chunk_rows).alias("chunk"), code.alias("code"),
        *[c.cast("bigint").alias(n) for c, n in ((blank, "blank"), (copy, "duplicate"), (cut_off, "truncated"))],
    )
    faults = ("blank", "duplicate", "truncated")
    by_turn = judged.groupBy("conv_id", "turn").agg(*[F.sum(c).alias(c) for c in faults])
    gaps = F.max("turn") - F.min("turn") + 1 - F.count("turn")
    counts = by_turn.groupBy("conv_id").agg(gaps.alias("gaps"), *[F.sum(c).alias(c) for c in faults])
    # chunks of at most chunk_rows rows, in order of place
    gathered = judged.groupBy("conv_id", "chunk").agg(F.sort_array(F.collect_list(F.struct("place", "code", "rid"))).alias("rows"))
    pieces = stored(gathered.select("conv_id", "chunk", F.col("rows.code").alias("codes"), F.col("rows.rid").alias("rids")), "repair-chunks")
    convs = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "codes"))).alias("parts")).select(
        "conv_id", F.col("parts.chunk").alias("chunks"), F.transform("parts.codes", F.size).alias("sizes"), F.flatten("parts.codes").alias("codes")
    )
    scripts = stored(_scripts(convs.repartition(tasks, "conv_id")), "repair-scripts")
    cuts = scripts.select(F.col("conv_id").alias("c"), F.explode("cuts").alias("cut")).select("c", F.col("cut.chunk").alias("k"), F.col("cut.edits").alias("edits"))
    zipped = pieces.join(cuts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("chunk") == F.col("k")))
    each = zipped.select("conv_id", "chunk", F.posexplode(F.arrays_zip("rids", "edits")).alias("at", "e"))
    each = each.select("conv_id", "chunk", "at", F.col("e.rids").alias("rid"), F.col("e.edits").cast("int").alias("edit")).where(F.col("edit") != DELETE)
    lines = _lines(each.join(rows.select("rid", "role", "text"), "rid"))
    tails = scripts.where(F.col("tail").isNotNull())
    lines = lines.unionByName(tails.select("conv_id", F.lit((1 << 63) - 1).alias("chunk"), F.lit(0).alias("at"), F.col("tail").alias("lines")))
    report = raw.select("conv_id").distinct()
    for part in (counts, scripts.select("conv_id", "illegal", "cost", "audit"), _digests(lines)):
        report = _on_conversation(report, part)
    report = report.select(
        "conv_id",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", *faults, "illegal", "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"),
    )
    return report, lines
