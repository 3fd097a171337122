"""Cheapest repairs of conversations, by one grammar for all of them.

Every row becomes a symbol of its role's initial and its first fault.  Re-Pair finds the pairs
of symbols that recur over all conversations and makes rules of them, in rounds: each round
counts the pairs in Spark and takes frequent ones that share no symbol.  What a rule costs is
one matrix over the states of the wanted form ``(s?(ua)+)?``: from each state to each, the
least cost and the least audit.  A rule's matrix is the (min, +) product of its two parts, with
audits as ropes that share theirs, so a conversation costs as many products as its compressed
form has symbols.

A conversation's order, audit and digest are sequences, so its rows meet in one task, where they
are read as a sorted stream.  Only one byte per row is ever gathered, in chunks of ``CHUNK`` rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..storage import materialize
from .columns import ragged, trim, utf8

BLANKS = " \t\n\x0b\x0c\r"
INITIALS = "sua"  # then everything else
SOUND, BLANK, DUPLICATE, TRUNCATED = range(4)
TERMINALS = 4 * (len(INITIALS) + 1)
#: Costs of edits.
REROLE, DELETE, INSERT, TRUNCATION = 3, 4, 3, 3
#: States of the form: nothing yet, after s, after u, after a.
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
STATES, FINAL = range(4), (0, 3)
CHUNK = 4_096
#: Bounds of the grammar; what it leaves uncompressed is evaluated as it is.
ROUNDS, RULES, RULES_A_ROUND = 16, 512, 48
#: Results of a task that are remembered.
CACHED = 20_000
_LEAF = 64


# -- ropes and matrices ---------------------------------------------------------------------


class Rope:
    """A text as a short leaf or as two ropes, which may belong to many others."""

    __slots__ = ("size", "text", "left", "right")

    def __init__(self, text: str | None, left: Rope | None = None, right: Rope | None = None):
        self.text, self.left, self.right = text, left, right
        self.size = len(text) if text is not None else left.size + right.size

    def __add__(self, other: Rope) -> Rope:
        if not other.size:
            return self
        if not self.size:
            return other
        if self.size + other.size <= _LEAF and self.text is not None and other.text is not None:
            return Rope(self.text + other.text)
        return Rope(None, self, other)

    def __str__(self) -> str:
        out, open_ = [], [self]
        while open_:
            rope = open_.pop()
            if rope.text is None:
                open_ += [rope.right, rope.left]
            else:
                out.append(rope.text)
        return "".join(out)

    def __lt__(self, other: Rope) -> bool:
        """Letter order; parts that both share are passed over unread."""
        mine, theirs = [self], [other]
        while mine and theirs:
            p, q = mine.pop(), theirs.pop()
            if p is q:
                continue
            if p.text is not None and q.text is not None:
                n = min(p.size, q.size)
                if p.text[:n] != q.text[:n]:
                    return p.text[:n] < q.text[:n]
                if p.size > n:
                    mine.append(Rope(p.text[n:]))
                if q.size > n:
                    theirs.append(Rope(q.text[n:]))
            elif q.text is not None or (p.text is None and p.size >= q.size):
                mine += [p.right, p.left]
                theirs.append(q)
            else:
                theirs += [q.right, q.left]
                mine.append(p)
        return any(r.size for r in theirs) and not any(r.size for r in mine)


Cell = tuple[int, Rope] | None
Matrix = list[list[Cell]]


def _less(a: Cell, b: Cell) -> bool:
    return b is None or a[0] < b[0] or (a[0] == b[0] and a[1] < b[1])


def row_times(row: list[Cell], matrix: Matrix) -> list[Cell]:
    out: list[Cell] = [None] * len(STATES)
    for cell, onward in zip(row, matrix):
        if cell is None:
            continue
        for q, step in enumerate(onward):
            if step is None:
                continue
            cost, best = cell[0] + step[0], out[q]
            if best is None or cost <= best[0]:
                found = (cost, cell[1] + step[1])
                if _less(found, best):
                    out[q] = found
    return out


def times(a: Matrix, b: Matrix) -> Matrix:
    return [row_times(row, b) for row in a]


def _inserts() -> Matrix:
    """What insertions alone can do: none, then one more until nothing gets cheaper."""
    one: Matrix = [[None] * 4 for _ in STATES]
    for p in STATES:
        one[p][p] = (0, Rope(""))
        for initial in "ua":
            if (p, initial) in NEXT:
                one[p][NEXT[p, initial]] = (INSERT, Rope("I"))
    many = one
    for _ in STATES:
        many = times(many, one)
    return many


INSERTS = _inserts()


def terminal(symbol: int) -> Matrix:
    """Insertions before one row and then the row kept, given another role, or deleted."""
    initial, fault = (INITIALS + "?")[symbol // 4], symbol % 4
    step: Matrix = [[None] * 4 for _ in STATES]

    def offer(p: int, q: int | None, cost: int, edit: str) -> None:
        if q is not None and _less((cost, Rope(edit)), step[p][q]):
            step[p][q] = (cost, Rope(edit))

    for p in STATES:
        offer(p, p, DELETE, "D")
        if fault in (SOUND, TRUNCATED):
            more = TRUNCATION if fault == TRUNCATED else 0
            offer(p, NEXT.get((p, initial)), more, "K")
            for wanted in "ua":
                offer(p, NEXT.get((p, wanted)), REROLE + more, "R")
    return times(INSERTS, step)


def best(row: list[Cell]) -> tuple[int, str]:
    """Cost and audit of a whole conversation from its first state's row of the product."""
    row = row_times(row, INSERTS)
    found = row[FINAL[0]]
    if row[FINAL[1]] is not None and _less(row[FINAL[1]], found):
        found = row[FINAL[1]]
    return found[0], str(found[1])


# -- the grammar ----------------------------------------------------------------------------


@dataclass
class Grammar:
    """Rounds of pairs; the pairs of one round share no symbol.  Rule i is symbol TERMINALS + i."""

    rounds: list[list[tuple[int, int]]]

    @property
    def size(self) -> int:
        return TERMINALS + sum(len(r) for r in self.rounds)

    def matrices(self) -> list[Matrix]:
        """One matrix per symbol, rules after the symbols they are made of."""
        known = [terminal(s) for s in range(TERMINALS)]
        for pairs in self.rounds:
            known += [times(known[a], known[b]) for a, b in pairs]
        return known

    def compress(self, x: np.ndarray) -> np.ndarray:
        first = TERMINALS
        for pairs in self.rounds:
            x = replace(x, pairs, first)
            first += len(pairs)
        return x


def _every_second(at: np.ndarray) -> np.ndarray:
    """Of neighbouring places every second one: occurrences that overlap count once."""
    if not len(at):
        return at
    starts = np.flatnonzero(np.diff(at, prepend=-2) > 1)
    since = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
    return at[since % 2 == 0]


def replace(x: np.ndarray, pairs: list[tuple[int, int]], first: int) -> np.ndarray:
    """Sequences, each ended by -1, with the occurrences of the pairs from left to right as rules."""
    partner, rule = np.full(first, -2), np.zeros(first, x.dtype)
    for i, (a, b) in enumerate(pairs):
        partner[a], rule[a] = b, first + i
    at = _every_second(np.flatnonzero((x[:-1] >= 0) & (partner[x[:-1]] == x[1:])))
    x = x.copy()
    x[at] = rule[x[at]]
    return np.delete(x, at + 1)


def count_pairs(x: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs as a * size + b, and how often each occurs without overlapping itself."""
    inside = (x[:-1] >= 0) & (x[1:] >= 0)
    equal = inside & (x[:-1] == x[1:])
    at = np.concatenate([np.flatnonzero(inside & ~equal), _every_second(np.flatnonzero(equal))])
    return np.unique(x[at].astype(np.int64) * size + x[at + 1], return_counts=True)


def flat(symbols: pa.Array) -> np.ndarray:
    """Texts of letters as one array of symbols with a -1 after each."""
    data, offsets = utf8(symbols)
    x = np.full(len(data) + len(symbols), -1, np.int32)
    x[np.arange(len(data)) + np.repeat(np.arange(len(symbols)), np.diff(offsets))] = data.astype(np.int32) - 65
    return x


def split(x: np.ndarray) -> list[np.ndarray]:
    return np.split(x, np.flatnonzero(x < 0) + 1)[:-1]


def choose(counted: list[tuple[int, int, int]], room: int) -> list[tuple[int, int]]:
    """The most frequent pairs that share no symbol; a pair must occur twice to be a rule."""
    used: set[int] = set()
    pairs = []
    for a, b, n in counted:
        if n > 1 and len(pairs) < room and not used & {a, b}:
            used |= {a, b}
            pairs.append((a, b))
    return pairs


def grammar_of(sequences: DataFrame) -> Grammar:
    """Re-Pair over the distinct texts of the one column ``symbols``."""
    grammar = Grammar([])
    slim = sequences.select("symbols").distinct()

    def start(batches):
        for batch in batches:
            parts = split(flat(batch.column(0)))
            joined = np.concatenate(parts) if parts else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([ragged(joined, [len(p) for p in parts], pa.int32())], names=["x"])

    def values(batch):
        return np.asarray(batch.column(0).flatten(), np.int32)

    state = materialize(slim.mapInArrow(start, "x array<int>"), "repair-sequences")
    for _ in range(ROUNDS):
        size = grammar.size
        room = min(RULES_A_ROUND, RULES - (size - TERMINALS))

        def count(batches):
            seen: dict[int, int] = {}
            for batch in batches:
                for pair, n in zip(*(v.tolist() for v in count_pairs(values(batch), size))):
                    seen[pair] = seen.get(pair, 0) + n
            columns = [pa.array([p // size for p in seen], pa.int32()), pa.array([p % size for p in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "n"])

        counted = state.mapInArrow(count, "a int, b int, n bigint").groupBy("a", "b").agg(F.sum("n").alias("n"))
        pairs = choose([tuple(r) for r in counted.orderBy(F.desc("n"), "a", "b").limit(8 * RULES_A_ROUND).collect()], room)
        if not pairs:
            break
        grammar.rounds.append(pairs)

        def rewrite(batches, pairs=pairs, size=size):
            for batch in batches:
                parts = split(replace(values(batch), pairs, size))
                joined = np.concatenate(parts) if parts else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([ragged(joined, [len(p) for p in parts], pa.int32())], names=["x"])

        state = materialize(state.mapInArrow(rewrite, "x array<int>"), "repair-sequences")
    return grammar


# -- rows -----------------------------------------------------------------------------------


def damage(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) with faults set by a checksum of their key.

    Nulls become one space, in the key as in role and text; conv_id and turn themselves stay
    null.  Of 20 rests of crc32 five do harm: 0 drops the row, 1 empties its text, 2 takes its
    full stops, exclamation and question marks, 3 repeats the row, 4 makes its role user.
    Repeated rows suffer alike; an empty table stays empty; other columns are dropped.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    hit = F.crc32(F.concat(parts[0], F.lit(":"), parts[1]).cast("binary")) % 20
    slim = turns.select("conv_id", "turn", parts[2].alias("role"), parts[3].alias("text"), hit.alias("hit")).where("hit <> 0")
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.array_repeat(F.lit(0), F.when(F.col("hit") == 3, 2).otherwise(1))
    return slim.select(
        "conv_id", "turn", F.when(F.col("hit") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def label(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, position, symbol, illegal, new_turn) of every row, in order.

    Rows stand by turn, nulls first, and ties by role and text.
    """
    body = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.coalesce(F.col("role"), F.lit(" ")).substr(1, 1)
    slim = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), initial.alias("initial")
    )
    rows = slim.select(
        "*", F.unhex(F.sha2("text", 256)).alias("digest"), (body == "").alias("blank"),
        F.right(body, F.lit(1)).isin(".", "!", "?").alias("ended"),
    )
    # Only texts that recur in a conversation travel, with the place of the first.
    first = rows.groupBy("conv_id", "role", "digest").agg(
        F.count("*").alias("n"), F.min("turn").alias("least"), F.max(F.col("turn").isNull()).alias("unplaced")
    ).where("n > 1")
    first = first.select(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("said"), "least", "unplaced")
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("said"))
    later = F.col("turn").isNotNull() & (F.col("unplaced") | (F.col("turn") > F.col("least")))
    marked = rows.join(first, same, "left").select(*rows.columns, F.coalesce(later, F.lit(False)).alias("later"))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")

    def before(column: str) -> Column:
        return F.lag(column).over(order)

    placed = marked.select(
        "conv_id", "turn", "role", "text", "initial", "blank", "ended",
        (F.row_number().over(order) - 1).cast("bigint").alias("position"),
        # The same text again on the same turn stands right behind.
        (F.col("later") | (before("turn").eqNullSafe(F.col("turn")) & (before("role") == F.col("role")) & (before("digest") == F.col("digest")))).alias("again"),
        F.concat(before("initial"), F.col("initial")).alias("step"),
        (~before("turn").eqNullSafe(F.col("turn"))).alias("moved"),
    )
    placed = placed.withColumn("again", F.coalesce(F.col("again") & (F.col("position") > 0), F.lit(False)))
    fault = F.when(F.col("blank"), BLANK).when(F.col("again"), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(SOUND)
    kind = F.when(F.col("initial") == "", 4).otherwise(F.coalesce(F.nullif(F.instr(F.lit(INITIALS), F.col("initial")), F.lit(0)), F.lit(4)))
    return placed.select(
        "conv_id", "turn", "role", "text", "position", ((kind - 1) * 4 + fault).cast("int").alias("symbol"),
        ((F.col("position") > 0) & ~F.col("step").isin("su", "ua", "au")).alias("illegal"),
        (F.col("turn").isNotNull() & ((F.col("position") == 0) | F.coalesce(F.col("moved"), F.lit(True)))).alias("new_turn"),
    )


def _chunks(rows: DataFrame) -> DataFrame:
    """(conv_id, chunk, symbols) with one letter per row, of at most CHUNK rows each."""
    chunk = F.floor(F.col("position") / CHUNK).cast("bigint").alias("chunk")
    grouped = rows.groupBy("conv_id", chunk).agg(F.sort_array(F.collect_list(F.struct("position", "symbol"))).alias("rows"))
    letters = F.transform("rows", lambda r: F.char(r["symbol"] + 65))
    return grouped.select("conv_id", "chunk", F.array_join(letters, "").alias("symbols"))


def _solved(chunks: DataFrame, grammar: Grammar) -> DataFrame:
    """(conv_id, cost, audit) of every conversation."""
    schema = StructType([
        chunks.schema["conv_id"], *StructType.fromDDL("chunk bigint, cells array<struct<p: int, q: int, cost: bigint, audit: string>>"),
    ])
    cell = pa.list_(pa.struct([("p", pa.int32()), ("q", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())]))

    def products(batches):
        matrices = grammar.matrices()
        known: dict[tuple[bool, bytes], list[dict]] = {}
        for batch in batches:
            out = []
            for chunk, x in zip(batch.column(1).to_pylist(), split(grammar.compress(flat(batch.column(2))))):
                wanted = (chunk == 0, x.tobytes())
                cells = known.get(wanted)
                if cells is None:
                    # A first chunk starts in the first state only.
                    rows = matrices[x[0]][: 1 if chunk == 0 else len(STATES)]
                    for symbol in x[1:-1].tolist():
                        rows = [row_times(row, matrices[symbol]) for row in rows]
                    cells = [
                        {"p": p, "q": q, "cost": c[0], "audit": str(c[1])}
                        for p, row in enumerate(rows) for q, c in enumerate(row) if c is not None
                    ]
                    if len(known) < CACHED:
                        known[wanted] = cells
                out.append(cells)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, cell)], names=schema.names)
        trim()

    parts = chunks.mapInArrow(products, schema).repartition("conv_id").sortWithinPartitions("conv_id", "chunk")
    final = StructType([chunks.schema["conv_id"], *StructType.fromDDL("cost bigint, audit string")])

    def combine(batches):
        conv, row = None, None
        for batch in batches:
            ids, costs, audits = [], [], []
            for who, chunk, cells in zip(*(c.to_pylist() for c in batch.columns)):
                matrix: Matrix = [[None] * 4 for _ in STATES]
                for c in cells:
                    matrix[c["p"]][c["q"]] = (c["cost"], Rope(c["audit"]))
                if chunk == 0:
                    if row is not None:
                        cost, audit = best(row)
                        ids.append(conv), costs.append(cost), audits.append(audit)
                    conv, row = who, matrix[0]
                else:
                    row = row_times(row, matrix)
            yield pa.RecordBatch.from_arrays(_column(final, ids, costs, audits), names=final.names)
        if row is not None:
            cost, audit = best(row)
            yield pa.RecordBatch.from_arrays(_column(final, [conv], [cost], [audit]), names=final.names)
        trim()

    return parts.mapInArrow(combine, final)


def _column(schema: StructType, *values: list) -> list[pa.Array]:
    return [pa.array(v, to_arrow_type(f.dataType)) for f, v in zip(schema, values)]


def _rebuilt(rows: DataFrame, solved: DataFrame) -> DataFrame:
    """Repaired rows; a conversation's audit travels with its rows and comes before them."""
    audits = solved.select("conv_id", F.lit(-1).cast("bigint").alias("position"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"))
    both = rows.select("conv_id", "position", "role", "text").unionByName(audits)
    ordered = both.repartition("conv_id").sortWithinPartitions("conv_id", "position")
    schema = both.schema

    def run(batches):
        follow = None
        for batch in batches:
            owners, sources, places, roles = [], [], [], []
            for i, (position, role) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
                if position < 0:
                    follow = _Follower(batch.column(3)[i].as_py())
                    continue
                for place, wanted, kept in follow.edits():
                    owners.append(i)
                    sources.append(i if kept else None)
                    places.append(place)
                    roles.append(role if wanted is None else wanted)
            texts = pc.fill_null(batch.column(3).take(pa.array(sources, pa.int64())), "")
            columns = [batch.column(0).take(pa.array(owners, pa.int64())), pa.array(places, pa.int64()), pa.array(roles, pa.string()), texts]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)
        trim()

    return ordered.mapInArrow(run, schema)


class _Follower:
    """Goes along an audit, row by row, and says what comes out for each."""

    def __init__(self, audit: str):
        self.audit, self.cursor, self.written = audit, 0, 0
        self.last = len(audit.rstrip("I"))
        # The form is fixed by its length: an odd one starts with s.
        self.lead = (len(audit) - audit.count("D")) % 2

    def _role(self) -> str:
        return "user" if (self.written - self.lead) % 2 == 0 else "assistant"

    def edits(self) -> Iterator[tuple[int, str | None, bool]]:
        """(position, new role or None, is it the row) until the row and what goes with it is done."""
        done = False
        while self.cursor < len(self.audit) and not (done and self.cursor < self.last):
            edit = self.audit[self.cursor]
            self.cursor += 1
            if edit == "D":
                done = True
                continue
            yield self.written, None if edit == "K" else self._role(), edit != "I"
            self.written += 1
            done = done or edit != "I"


def repair(turns: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(summary, repaired) of conversations in ``turns`` (conv_id, turn, role, text).

    ``summary`` has one row per conversation: gaps, blank, duplicate, truncated, illegal, cost
    and audit.  ``repaired`` has their rows after the edits: conv_id, position, role, text.
    ``ids`` (conv_id) may name conversations without rows, which get zeros and an empty audit.

    Rows stand by turn, nulls first; ties stand by role and text.  A null role or text is one
    space, so the text is blank.  Rows without a conv_id are one conversation.  Repeated rows
    are duplicates of the first.  Empty tables give none.  Other columns are not looked at.
    """
    rows = materialize(label(turns.select("conv_id", "turn", "role", "text")), "repair-rows")
    chunks = materialize(_chunks(rows), "repair-chunks")
    solved = materialize(_solved(chunks, grammar_of(chunks)), "repair-audits")
    fault = F.col("symbol") % 4
    counts = rows.groupBy("conv_id").agg(
        (F.max("turn") - F.min("turn") + 1 - F.count_if("new_turn")).alias("gaps"),
        *(F.count_if(fault == f).alias(n) for n, f in (("blank", BLANK), ("duplicate", DUPLICATE), ("truncated", TRUNCATED))),
        F.count_if("illegal").alias("illegal"),
    )
    parts = counts.unionByName(solved, allowMissingColumns=True)
    if ids is not None:
        parts = parts.unionByName(ids.select("conv_id").distinct(), allowMissingColumns=True)
    numbers = [F.coalesce(F.max(c), F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    summary = parts.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("audit"), F.lit("")).alias("audit"))
    return summary, _rebuilt(rows, solved)


def digests(repaired: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``repaired`` as :func:`repair` gives it, read as a stream.

    Conversations without rows have none.
    """
    schema = StructType([repaired.schema["conv_id"], *StructType.fromDDL("repaired_sha256 string")])

    def run(batches):
        conv, state = None, None
        for batch in batches:
            ids, out = [], []
            for who, position, role, text in zip(*(c.to_pylist() for c in batch.columns)):
                if position == 0:
                    if state is not None:
                        ids.append(conv), out.append(state.hexdigest())
                    conv, state = who, hashlib.sha256()
                state.update(f"{chr(10) if position else ''}{role}:{text}".encode())
            yield pa.RecordBatch.from_arrays(_column(schema, ids, out), names=schema.names)
        if state is not None:
            yield pa.RecordBatch.from_arrays(_column(schema, [conv], [state.hexdigest()]), names=schema.names)

    return repaired.select("conv_id", "position", "role", "text").mapInArrow(run, schema)


def damaged_and_repaired(conversations: DataFrame) -> DataFrame:
    """The summary of every conversation after :func:`damage`, and the digest of its repaired rows."""
    summary, repaired = repair(damage(conversations), conversations)
    whole = summary.unionByName(digests(repaired), allowMissingColumns=True)
    numbers = [F.max(c).alias(c) for c in summary.columns if c != "conv_id"]
    empty = F.lit(hashlib.sha256().hexdigest())
    return whole.groupBy("conv_id").agg(*numbers, F.coalesce(F.max("repaired_sha256"), empty).alias("repaired_sha256"))
