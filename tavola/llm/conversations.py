"""Conversation structure repair (operator 12): prefix-doubling path ranking.

A conversation is well formed when the initials of its roles read
``(s?(ua)+)?``.  Rows are kept (0), given the role user or assistant (1) or
deleted (2), which blank rows and rows that repeat a role and a text must be; empty
rows may be inserted (5); a truncated row that stays costs 5 more.

1. DataFrame functions find each row's first fault.  Equal rows of a turn are one
   row with a count, combined before the shuffle.
2. Narrow rows (role class, fault, count), sorted by conversation and turn within
   partitions, reach a streaming iterator that holds one byte per row.  Nodes are
   (row, state), the state being what the kept prefix ends with: nothing, s, u
   or a.  A backward DP gives every node its cost to the end; an arc is optimal
   when its cost and its target's add up to the node's.
3. Audits are the letters D, I, K, R of the arcs of a path.  A letter leads from
   a node to one node only, so the least letter of a node's optimal arcs ranks
   it for audits of length 1 and gives its pointer.  Pairs (own rank, rank of the
   node at the pointer) rank audits of length 2, 4, 8, ..., while pointers double.
   Nodes of equal final rank share their least audit: one path for each rank
   of a start is read off the doubled pointers, all positions at once.
   All conversations of about ``RUN`` rows are solved together; a longer one in
   pieces, whose costs at the piece ends come first.
4. Rows with their texts are sorted likewise, behind their conversation's audit,
   and a second iterator applies the edits row by row as they come.

Both iterators read a conversation in order in one task, as its digest and its
audit, one cell, ask for; memory is the audit and a batch of rows.

Cases: null roles and texts count as one space; null turns come first; a null
conversation id is a conversation of its own.  Rows of one turn come by role, then
by the SHA-256 of their text (equal rows next to each other).  Roles count by their
first character; an empty or unknown role fits nowhere and must change or go.  Rows
where ``present`` is false only name their conversation: without others it has
zeros, an empty audit and the hash of the empty string.  Texts are equal when
their SHA-256 are.  An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tavola.llm.shared import written

BLANK_CHARS = " \t\n\x0b\x0c\r"
S, U, A, OTHER = range(4)  # role classes
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
START, AFTER_S, AFTER_U, AFTER_A = range(4)  # states
ADD = np.array([AFTER_U, AFTER_U, AFTER_A, AFTER_U])  # where a user or assistant row leads
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4  # in the order of their letters; 0 ends an audit
LETTERS = np.frombuffer(b"\0DIKR", np.uint8)
COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
UNFIT, NEVER = 5, 1 << 40
END_COST = np.array([0, 2 * COST[INSERT], COST[INSERT], 0])
RUN = 1 << 16
FACTS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
PLAN = ", ".join(f"{c} long" for c in FACTS) + ", audit string"


def _rules() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By code (class + 4 fault) and state: cost and target of keeping; by code: cost of a new role."""
    keep, to, rerole = np.full((16, 4), NEVER), np.zeros((16, 4), np.int64), np.full(16, NEVER)
    for fault in (FINE, TRUNCATED):
        more = UNFIT if fault == TRUNCATED else 0
        for role, state, target in ((S, START, AFTER_S), (U, START, AFTER_U), (U, AFTER_S, AFTER_U), (U, AFTER_A, AFTER_U), (A, AFTER_U, AFTER_A)):
            keep[role + 4 * fault, state], to[role + 4 * fault, state] = COST[KEEP] + more, target
        rerole[4 * fault: 4 * fault + 4] = COST[REROLE] + more
    return keep, to, rerole


KEEP_COST, KEEP_TO, REROLE_COST = _rules()


def back(code: np.ndarray, after: np.ndarray) -> np.ndarray:
    """Costs to the end before rows of these codes, from those after them; (rows, 4)."""
    g = np.minimum(COST[DELETE] + after, KEEP_COST[code] + np.take_along_axis(after, KEEP_TO[code], 1))
    g = np.minimum(g, REROLE_COST[code][:, None] + after[:, ADD])
    g[:, [AFTER_U, AFTER_A]] = np.minimum(g[:, [AFTER_U, AFTER_A]], COST[INSERT] + g[:, [AFTER_A, AFTER_U]])
    return np.minimum(g, COST[INSERT] + g[:, [AFTER_U, AFTER_U, AFTER_U, AFTER_A]])  # the latter two stay


def least_audits(codes: list[np.ndarray], entry: np.ndarray, end: np.ndarray, last: bool) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Cost, least audit and state at the end of every sequence of rows, from
    state ``entry`` and with costs ``end`` behind it; rows are inserted behind the
    final row only if the sequence is the ``last`` of its conversation."""
    size = np.array([len(c) for c in codes])
    base = np.cumsum(size + 1) - size - 1  # node of (sequence, row, state): 4 (base + row) + state
    flat = np.zeros(int((size + 1).sum()), np.int64)
    rest = np.ones(len(flat), bool)
    rest[base + size] = False
    flat[rest] = np.concatenate(codes) if len(codes) else 0
    cost = np.empty((len(flat), 4), np.int64)
    cost[base + size] = end
    order = np.argsort(-size, kind="stable")
    for j in range(int(size.max(initial=0))):  # j-th row from the end, of all that have one
        now = order[: np.searchsorted(-size[order], -j)]
        at = base[now] + size[now] - 1 - j
        cost[at] = back(flat[at], cost[at + 1])

    node = np.arange(len(flat))[:, None]
    nxt = np.minimum(node + 1, len(flat) - 1)
    letter, target = np.zeros((len(flat), 4), np.int64), 4 * node + np.arange(4)
    inside = np.repeat(rest[:, None], 4, 1)
    for arc, price, to in ((REROLE, REROLE_COST[flat][:, None], 4 * nxt + ADD), (KEEP, KEEP_COST[flat], 4 * nxt + KEEP_TO[flat]),
                           (INSERT, COST[INSERT], 4 * node + ADD), (DELETE, COST[DELETE], 4 * nxt + np.arange(4))):  # the least letter last
        fits = (price + cost.reshape(-1)[to] == cost) & (inside | last if arc == INSERT else inside)
        letter, target = np.where(fits, arc, letter), np.where(fits, to, target)

    label, rank, length, pointers = letter.reshape(-1), letter.reshape(-1), (letter.reshape(-1) > 0).astype(np.int64), [target.reshape(-1)]
    while (label[pointers[-1]] > 0).any():
        p = pointers[-1]
        rank = np.unique(rank * (rank.max() + 1) + rank[p], return_inverse=True)[1].reshape(-1)
        length = length + length[p]
        pointers.append(p[p])
    start = 4 * base + entry
    _, first, which = np.unique(rank[start], return_index=True, return_inverse=True)
    n = length[start[first]]
    path, step = np.repeat(start[first], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    for k, p in enumerate(pointers):
        path = np.where(step >> k & 1, p[path], path)
    texts, ends = LETTERS[label[path]].tobytes(), np.cumsum(n)
    found = [texts[e - m: e] for e, m in zip(ends.tolist(), n.tolist())]
    return cost.reshape(-1)[start], [found[w] for w in which.reshape(-1).tolist()], pointers[-1][start] % 4


def solve(codes: list[np.ndarray], run: int = RUN) -> list[tuple[int, str]]:
    """(cost, audit) of whole conversations, together no longer than ``run`` or a single one."""
    if len(codes) > 1 or len(codes[0]) <= run:
        cost, audit, _ = least_audits(codes, np.full(len(codes), START), np.tile(END_COST, (len(codes), 1)), True)
        return [(int(c), a.decode()) for c, a in zip(cost, audit)]
    whole, h, ends = codes[0], END_COST[None, :], []
    for lo in range((len(whole) - 1) // run * run, -1, -run):
        ends.append((lo, h))
        for c in whole[lo: lo + run][::-1]:
            h = back(np.array([c]), h)
    state, parts = np.array([START]), []
    for lo, end in reversed(ends):
        _, audit, state = least_audits([whole[lo: lo + run]], state, end, lo + run >= len(whole))
        parts.append(audit[0])
    return [(int(h[0, START]), b"".join(parts).decode())]


class _Facts:
    """What is counted of a conversation while its rows come by."""

    def __init__(self, conv) -> None:
        self.conv, self.codes = conv, []
        self.low = self.high = self.turn = self.role = None
        self.turns = self.illegal = 0
        self.faults = np.zeros(4, np.int64)

    def take(self, turn: pa.Array, role: np.ndarray, fault: np.ndarray, copies: np.ndarray) -> None:
        there = copies > 0
        role, fault, copies, turn = role[there], fault[there], copies[there], turn.filter(pa.array(there)).drop_null().to_numpy()
        if len(turn):
            self.turns += int((np.diff(turn) != 0).sum()) + int(self.turn is None or turn[0] != self.turn)
            self.low, self.high, self.turn = int(turn[0]) if self.low is None else self.low, int(turn[-1]), turn[-1]
        if len(role):
            before = np.append(OTHER if self.role is None else self.role, role[:-1])
            good = ((before == S) & (role == U)) | ((before == U) & (role == A)) | ((before == A) & (role == U))
            self.illegal += int((~good).sum() + (copies - 1).sum()) - int(self.role is None)
            self.role = int(role[-1])
            again = np.where(fault == BLANK, BLANK, DUPLICATE)  # copies of a row after its first
            self.faults += np.bincount(fault, minlength=4) + np.bincount(again, copies - 1, 4).astype(np.int64)
            codes = np.repeat(role + 4 * again, copies)
            codes[np.cumsum(copies) - copies] = role + 4 * fault
            self.codes.append(codes.astype(np.uint8))


def plan(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """One row per conversation of rows(conv_id, turn, role, text): counts of its
    gaps in turns, blank, duplicate and truncated rows and pairs of roles out
    of order, and the cost and the letters of its cheapest edits."""
    rows = _rows(rows, present)
    stripped = F.rtrim("text", F.lit(BLANK_CHARS))
    fault = F.when(stripped == "", BLANK).when(F.right(stripped, F.lit(1)).isin(".", "!", "?"), FINE).otherwise(TRUNCATED)
    initial = F.left("role", F.lit(1))
    narrow = (rows.select("conv_id", "turn", "role", "digest", F.when(F.col("role").isNotNull(), fault).alias("fault"))
              .groupBy("conv_id", "turn", "role", "digest", "fault").agg(F.count("role").alias("copies")))
    first = Window.partitionBy("conv_id", "role", "digest").orderBy(F.col("turn").asc_nulls_first())
    narrow = narrow.select("conv_id", "turn", "role", "digest", "copies",
                           F.when((F.col("fault") != BLANK) & (F.row_number().over(first) > 1), DUPLICATE).otherwise(F.coalesce("fault", F.lit(FINE))).alias("fault"),
                           F.when(initial == "s", S).when(initial == "u", U).when(initial == "a", A).otherwise(OTHER).alias("class"))
    ordered = narrow.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "digest").select("conv_id", "turn", "class", "fault", "copies")

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_one, ready, held = None, [], 0

        def flush(ready: list[_Facts]) -> pa.RecordBatch:
            codes = [np.concatenate(f.codes) if f.codes else np.zeros(0, np.uint8) for f in ready]
            long = [k for k, c in enumerate(codes) if len(c) > RUN]
            short = [k for k, c in enumerate(codes) if len(c) <= RUN]
            found = dict(zip(short, solve([codes[k] for k in short]))) if short else {}
            found |= {k: solve([codes[k]])[0] for k in long}
            cols = [[f.conv for f in ready], [0 if f.low is None else f.high - f.low + 1 - f.turns for f in ready],
                    *[[int(f.faults[x]) for f in ready] for x in (BLANK, DUPLICATE, TRUNCATED)], [f.illegal for f in ready], *[[found[k][x] for k in range(len(ready))] for x in (0, 1)]]
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *[pa.array(c, pa.int64()) for c in cols[1:7]], pa.array(cols[7], pa.string())],
                                              ["conv_id", *FACTS, "audit"])

        kind = None
        for b in batches:
            kind, lo = b.column(0).type, 0
            runs = pc.run_end_encode(b.column(0))
            turn, (role, fault, copies) = b.column(1), (b.column(c).to_numpy().astype(np.int64) for c in (2, 3, 4))
            for conv, hi in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if open_one is None or conv != open_one.conv:
                    if open_one is not None:
                        ready.append(open_one)
                    open_one = _Facts(conv)
                open_one.take(turn.slice(lo, hi - lo), role[lo:hi], fault[lo:hi], copies[lo:hi])
                held, lo = held + int(copies[lo:hi].sum()), hi
            if held > RUN and ready:
                yield flush(ready)
                ready, held = [], 0
        if open_one is not None:
            yield flush([*ready, open_one])

    return written(ordered.mapInArrow(solved, f"conv_id {dict(rows.dtypes)['conv_id']}, {PLAN}"), "conversation-plans")


def _rows(rows: DataFrame, present: Column | None) -> DataFrame:
    """Rows with their texts' digests; of absent rows only the conversation."""
    there = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    text = F.coalesce(F.col("text").cast("string"), F.lit(" "))
    shown = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), text.alias("text"), there.alias("there"))
    return shown.select("conv_id", *[F.when(F.col("there"), F.col(c)).alias(c) for c in ("turn", "role", "text")],
                        F.when(F.col("there"), F.unhex(F.sha2("text", 256))).alias("digest"))


def _edited(rows: DataFrame, plans: DataFrame, present: Column | None) -> DataFrame:
    """Audits and rows, each audit before its conversation's rows."""
    texts = _rows(rows, present).where("role is not null").select("conv_id", F.lit(1).alias("kind"), "turn", "role", "digest", "text",
                                                                F.lit(None).cast("array<long>").alias("facts"))
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit(None).cast("string").alias("role"),
                         F.lit(None).cast("binary").alias("digest"), F.col("audit").alias("text"),
                         F.array(*FACTS).alias("facts"))
    return (heads.unionByName(texts).repartition("conv_id").sortWithinPartitions("conv_id", "kind", F.col("turn").asc_nulls_first(), "role", "digest")
            .select("conv_id", "kind", "role", "text", "facts"))


def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(conversation, None, (audit, facts)) for each audit, then (conversation,
    role, text) for each row that the edited conversation has."""
    conv, audit, at, state = None, "", 0, START

    def inserts() -> Iterator[tuple]:
        nonlocal at, state
        while audit[at: at + 1] == "I":
            state, at = ADD[state], at + 1
            yield conv, "user" if state == AFTER_U else "assistant", ""

    for b in batches:
        for key, kind, role, text, facts in zip(*(c.to_pylist() for c in b.columns)):
            if kind == 0:
                yield from inserts()
                conv, audit, at, state = key, text, 0, START
                yield key, None, (text, facts)
                continue
            yield from inserts()
            edit, at = audit[at], at + 1
            if edit == "K":
                state = {"s": AFTER_S, "u": AFTER_U, "a": AFTER_A}[role[0]]
                yield conv, role, text
            elif edit == "R":
                state = ADD[state]
                yield conv, "user" if state == AFTER_U else "assistant", text
    yield from inserts()


def _typed(batches: Iterator[pa.RecordBatch], typed: list) -> Iterator[pa.RecordBatch]:
    """The batches; the type of their first column goes to ``typed``."""
    for b in batches:
        typed[:] = [b.column(0).type]
        yield b


def repaired(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """The repaired conversations: conv_id, position (from 0), role and text."""
    kind = dict(rows.dtypes)["conv_id"]

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, n, typed = [], 0, []

        def pack() -> pa.RecordBatch:
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (typed[0], pa.int64(), pa.string(), pa.string()))], ["conv_id", "position", "role", "text"])

        for conv, role, text in follow(_typed(batches, typed)):
            if role is None:
                n = 0
                continue
            out.append((conv, n, role, text))
            n += 1
            if len(out) >= 1000:
                yield pack()
                out = []
        if out:
            yield pack()

    return _edited(rows, plan(rows, present), present).mapInArrow(lines, f"conv_id {kind}, position long, role string, text string")


def report(rows: DataFrame, present: Column | None = None) -> DataFrame:
    """``plan`` with repaired_sha256, the digest of the repaired conversation's
    ``role:text`` lines joined by newlines."""
    kind = dict(rows.dtypes)["conv_id"]

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        heads, found, now, began, typed = [], [], None, False, []

        def pack() -> pa.RecordBatch:
            facts = list(zip(*[f for _, (_, f) in heads])) or [[]] * len(FACTS)
            cols = [pa.array([k for k, _ in heads], typed[0]), *[pa.array(f, pa.int64()) for f in facts], *[pa.array(x, pa.string()) for x in ([a for _, (a, _) in heads], found)]]
            return pa.RecordBatch.from_arrays(cols, ["conv_id", *FACTS, "audit", "repaired_sha256"])

        for conv, role, text in follow(_typed(batches, typed)):
            if role is None:
                if now is not None:
                    found.append(now.hexdigest())
                if len(found) >= 2000:
                    yield pack()
                    heads, found = [], []
                heads.append((conv, text))
                now, began = hashlib.sha256(), False
                continue
            now.update(f"\n{role}:{text}".encode() if began else f"{role}:{text}".encode())
            began = True
        if now is not None:
            found.append(now.hexdigest())
            yield pack()

    return _edited(rows, plan(rows, present), present).mapInArrow(digests, f"conv_id {kind}, {PLAN}, repaired_sha256 string")
