"""Repair of conversations whose turns are out of order of roles, blank, repeated or cut off.

A turn is a symbol: its role's first letter and whether it must go or is cut
off.  One turn's edits are a matrix of least costs between the four states of
what has been kept so far (nothing, system, user, assistant), and matrices
multiply with minimum and sum.  Equal turns in a row are a run, whose matrix is
made of the cached powers of two of its symbol's.  The products are associative,
so a conversation that many tasks hold is repaired by all of them: each gives
the matrix of its part, and gets back the costs behind it and the state before.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from hammerline.llm._spark import cut, small_batches

KEEP, REROLE, DELETE, INSERT = "KRDI"
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 2, 3, 2, 1
_NEVER = 1 << 60

#: States: nothing kept, a system turn, a user turn, an assistant turn.  The state that a turn of a role leads to, and the one other role that may follow.
_LEADS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
_NEXT = (2, 2, 3, 2)
_ROLE = {2: "user", 3: "assistant"}
#: What it costs to end in each state.
_ENDED = (0, 2 * INSERT_COST, INSERT_COST, 0)

#: The bytes 0x20 and 0x09-0x0D are blank.
_BLANK = r"[\x20\x09-\x0D]"

#: Longest piece of a repaired text in one row, where a conversation's parts are put together.
PIECE_CHARS = 1 << 20

Matrix = tuple[tuple[int, ...], ...]
Runs = tuple[tuple[str, int], ...]


def _times(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(_NEVER, *(x + y for x, y in zip(row, col, strict=True))) for col in zip(*b, strict=True)) for row in a)


def _ahead(m: Matrix, after: tuple[int, ...]) -> tuple[int, ...]:
    return tuple(min(_NEVER, *(x + y for x, y in zip(row, after, strict=True))) for row in m)


_SAME: Matrix = tuple(tuple(0 if p == q else _NEVER for q in range(4)) for p in range(4))
_INSERT_ONE: Matrix = tuple(tuple(0 if p == q else INSERT_COST if _NEXT[p] == q else _NEVER for q in range(4)) for p in range(4))
#: Three turns put in reach every state that turns can be put in for.
_INSERTS = _times(_INSERT_ONE, _times(_INSERT_ONE, _INSERT_ONE))


def _kept(symbol: str, state: int) -> int | None:
    return _LEADS.get(symbol.lower(), {}).get(state)


def _of_turn(symbol: str) -> Matrix:
    """Costs of one turn, turns put in before it included.  Symbols: s, u, a, o (another role), in upper case where cut off; x has to go."""
    rows = []
    for p in range(4):
        row = [_NEVER] * 4
        row[p] = DELETE_COST
        if symbol != "x":
            cut_off = TRUNCATED_COST * symbol.isupper()
            row[_NEXT[p]] = min(row[_NEXT[p]], REROLE_COST + cut_off)
            if (q := _kept(symbol, p)) is not None:
                row[q] = min(row[q], cut_off)
        rows.append(tuple(row))
    return _times(_INSERTS, tuple(rows))


@functools.cache
def _power(symbol: str, k: int) -> Matrix:
    """The matrix of 2 ** k equal turns."""
    return _times(_power(symbol, k - 1), _power(symbol, k - 1)) if k else _of_turn(symbol)


@functools.lru_cache(4096)
def _run(symbol: str, n: int) -> Matrix:
    out = _SAME
    for k in range(n.bit_length()):
        if n >> k & 1:
            out = _times(out, _power(symbol, k))
    return out


def matrix(runs: Runs) -> Matrix:
    """Least costs from each state to each, over all runs."""
    return functools.reduce(_times, (_run(*r) for r in runs), _SAME)


def _choose(symbol: str, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least of the cheapest edits of one turn, with the state after it; `after` are the costs behind it."""
    costs, out = _ahead(_power(symbol, 0), after), ""
    while True:
        if DELETE_COST + after[state] == costs[state]:
            return out + DELETE, state
        if INSERT_COST + costs[_NEXT[state]] == costs[state]:
            out, state = out + INSERT, _NEXT[state]
            continue
        q = _kept(symbol, state)
        if q is not None and TRUNCATED_COST * symbol.isupper() + after[q] == costs[state]:
            return out + KEEP, q
        return out + REROLE, _NEXT[state]


@functools.lru_cache(1 << 16)
def _unrolled(symbol: str, k: int, state: int, after: tuple[int, ...]) -> tuple[str, int]:
    """Edits of 2 ** k equal turns, half by half."""
    if symbol == "x":  # no edit is less than Delete, and turns may as well be put in behind them
        return DELETE * (1 << k), state
    if not k:
        return _choose(symbol, state, after)
    first, state = _unrolled(symbol, k - 1, state, _relative(_ahead(_power(symbol, k - 1), after)))
    second, state = _unrolled(symbol, k - 1, state, after)
    return first + second, state


def _relative(costs: tuple[int, ...]) -> tuple[int, ...]:
    """Costs less the smallest: what is chosen depends on differences alone."""
    low = min(costs)
    return tuple(x - low if x < _NEVER else x for x in costs)


def unroll(runs: Runs, state: int = 0, after: tuple[int, ...] | None = None) -> tuple[str, int]:
    """The cheapest edits of a part, ASCII-least among equals, and the state behind it.

    `after` holds the costs of what follows by state; None: the conversation ends
    here, and the turns that its end needs are put in.
    """
    behind = [_relative(after or _ENDED)]
    for r in reversed(runs):
        behind.append(_relative(_ahead(_run(*r), behind[-1])))
    out = []
    for (symbol, n), costs in zip(runs, behind[-2::-1], strict=True):
        for k in reversed(range(n.bit_length())):
            if n >> k & 1:
                n -= 1 << k
                edits, state = _unrolled(symbol, k, state, _relative(_ahead(_run(symbol, n), costs)))
                out.append(edits)
    if after is None:
        while state in (1, 2):
            out.append(INSERT)
            state = _NEXT[state]
    return "".join(out), state


@functools.lru_cache(1 << 16)
def _whole(runs: Runs) -> tuple[str, int]:
    return unroll(runs)


def damaged(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, role, text, n): the turns after damage by crc32 of `conv_id:turn` modulo 20, n times each.

    Nulls are one space, in the sum and as a role or text; conv_id and turn stay
    null.  0 drops a turn, 1 empties its text, 2 takes `.`, `!` and `?` out of it,
    3 repeats it, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = (F.crc32(F.concat(said(conv), F.lit(":"), said(turn)).cast("binary")) % 20).alias("code")
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), said(role).alias("role"), said(text).alias("text"), code).where("code <> 0")
    worn = F.when(F.col("code") == 1, "").when(F.col("code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return rows.select("conv_id", "turn", F.when(F.col("code") == 4, "user").otherwise(F.col("role")).alias("role"), worn.alias("text"), F.when(F.col("code") == 3, 2).otherwise(1).cast("long").alias("n"))


def with_faults(turns: DataFrame) -> DataFrame:
    """Distinct turns with how often each stands in its place (n), the first one's fault (null: none) and its symbol.

    Further ones of the n are duplicates (blank, if the first is).  A turn is a
    duplicate if an earlier one of its conversation has its role and text.
    Equal rows are counted before they are shuffled, and only texts that stand at
    several places of a conversation are met with the rows again.
    """
    text = F.col("text")
    blank, cut_off = ~text.rlike(rf"(?s)[^\x20\x09-\x0D]"), ~text.rlike(rf"(?s)[.!?]{_BLANK}*\z")
    rows = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("n").alias("n"))
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = rows.where(~blank).groupBy("conv_id", "role", "text").agg(F.count(F.lit(1)).alias("places"), F.min(place).alias("place")).where("places > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t"), F.col("place").alias("first"))
    met = rows.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (text == F.col("t")), "left")
    fault = F.when(blank, "blank").when(F.col("first") < place, "duplicate").when(cut_off, "truncated")
    initial = F.substring("role", 1, 1)
    letter = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    return met.withColumn("fault", fault).select("conv_id", "turn", "role", "text", "n", "fault", symbol.alias("symbol"))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, list[tuple]]]:
    """Consecutive rows of one conversation, with the conversation; its id is the first column."""
    conv, rows = None, []
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        for row in zip(*columns, strict=True):
            if rows and row[0] != conv:
                yield conv, rows
                rows = []
            conv = row[0]
            rows.append(row)
    if rows:
        yield conv, rows


def _runs(rows: list[tuple[str, int]]) -> Runs:
    """Runs of equal symbols; of n equal turns all but the first have to go."""
    out: list[list] = []
    for symbol, n in rows:
        for s, k in ((symbol, 1), ("x", n - 1)):
            if k and out and out[-1][0] == s:
                out[-1][1] += k
            elif k:
                out.append([s, k])
    return tuple(map(tuple, out))


def _joints(ordered: DataFrame) -> dict[tuple[int, object], tuple[int, tuple[int, ...] | None]]:
    """Of each part of a conversation that several partitions hold: the state before it and the costs behind it (None: it is the last).

    A partition has two such parts at most, its first and its last conversation,
    so at most two small rows for each partition come to the driver.
    """
    kind = ordered.schema["conv_id"].dataType.simpleString()
    light = ordered.select("conv_id", "symbol", "n", "at")

    def edges(batches):
        first = last = None
        for conv, rows in _parts(batches):
            last = (rows[0][3] >> 33, conv, _runs([r[1:3] for r in rows]))
            first = first or last
        if last:
            found = [first] if first is last else [first, last]
            columns = [[p for p, _, _ in found], [c for _, c, _ in found], [[x for row in matrix(r) for x in row] for _, _, r in found]]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], ordered_type), pa.array(columns[2], pa.list_(pa.int64()))], ["part", "conv_id", "costs"])

    ordered_type = ordered.limit(0).toArrow().schema.field("conv_id").type
    found = sorted(light.mapInArrow(edges, f"part int, conv_id {kind}, costs array<long>").collect(), key=lambda r: r["part"])
    chains: list[list] = []
    for r in found:  # a partition's first part stands before its last
        if chains and chains[-1][-1]["conv_id"] == r["conv_id"] and chains[-1][-1]["part"] < r["part"]:
            chains[-1].append(r)
        else:
            chains.append([r])
    chains = [c for c in chains if len(c) > 1]
    behind: dict[tuple[int, object], tuple[int, ...] | None] = {}
    for chain in chains:
        costs: tuple[int, ...] | None = None
        for r in reversed(chain):
            behind[r["part"], r["conv_id"]] = costs
            m = tuple(tuple(r["costs"][4 * p : 4 * p + 4]) for p in range(4))
            costs = _relative(_ahead(m, costs or _ENDED))
    if not chains:
        return {}

    def exits(batches):
        for conv, rows in _parts(batches):
            key = rows[0][3] >> 33, conv
            if behind.get(key) is not None:
                runs = _runs([r[1:3] for r in rows])
                ends = [unroll(runs, q, behind[key])[1] for q in range(4)]
                yield pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([conv], ordered_type), pa.array([ends], pa.list_(pa.int32()))], ["part", "conv_id", "ends"])

    ends = {(r["part"], r["conv_id"]): r["ends"] for r in light.mapInArrow(exits, f"part int, conv_id {kind}, ends array<int>").collect()}
    out = {}
    for chain in chains:
        state = 0
        for r in chain:
            key = r["part"], r["conv_id"]
            out[key] = state, behind[key]
            state = ends[key][state] if key in ends else state
    return out


def repaired_turns(turns: DataFrame) -> DataFrame:
    """One row per edit, in order of `at`: (conv_id, at, edit, times, turn, was, role, text, fault, split).

    `turns` has conv_id, turn, role, text and n, as `damaged` gives them.  edit is
    K, R, D or I; `was` is the turn's role (null where one was put in), role and
    text are those of the repaired turn (null where it goes); times counts equal
    turns that go.  A conversation is taken by turn, nulls first, then by role and
    text.  Turns of any number: conversations are cut where the range partitions
    are, `split` tells those.  A null conv_id is one conversation; an empty table
    gives an empty result.
    """
    keys = ["conv_id", "turn", "role", "text"]
    ordered = with_faults(turns).repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("at", F.monotonically_increasing_id())
    ordered = cut(ordered.select("conv_id", "symbol", "n", "at", "turn", "role", "text", "fault"))
    joints = _joints(ordered)
    schema = ordered.limit(0).toArrow().schema
    names = ["conv_id", "at", "edit", "times", "turn", "was", "role", "text", "fault", "split"]
    kinds = [schema.field("conv_id").type, pa.int64(), pa.string(), pa.int64(), schema.field("turn").type, *[pa.string()] * 4, pa.bool_()]

    def edits(batches):
        out: list[tuple] = []
        number = None
        for conv, rows in _parts(batches):
            part = rows[0][3] >> 33
            number = part << 33 if number is None else number
            split = (part, conv) in joints
            runs = _runs([r[1:3] for r in rows])
            audit, _ = unroll(runs, *joints[part, conv]) if split else (_whole if len(runs) <= 64 else unroll)(runs)
            state, at = (joints[part, conv][0] if split else 0), 0
            for _, symbol, n, _, turn, was, text, fault in rows:
                while audit[at] == INSERT:
                    state, at = _NEXT[state], at + 1
                    out.append((conv, number, INSERT, 1, None, None, _ROLE[state], "", None, split))
                    number += 1
                edit = audit[at]
                if edit == DELETE:
                    out.append((conv, number, edit, 1, turn, was, None, None, fault, split))
                else:
                    state = _kept(symbol, state) if edit == KEEP else _NEXT[state]
                    out.append((conv, number, edit, 1, turn, was, was if edit == KEEP else _ROLE[state], text, fault, split))
                at, number = at + 1, number + 1
                if n > 1:
                    out.append((conv, number, DELETE, n - 1, turn, was, None, None, fault if fault == "blank" else "duplicate", split))
                    at, number = at + n - 1, number + 1
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                    out = []
            for _ in audit[at:]:
                state = _NEXT[state]
                out.append((conv, number, INSERT, 1, None, None, _ROLE[state], "", None, split))
                number += 1
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    types = {f.name: f.dataType.simpleString() for f in ordered.schema}
    return small_batches(ordered).mapInArrow(edits, f"conv_id {types['conv_id']}, at long, edit string, times long, turn {types['turn']}, was string, role string, text string, fault string, split boolean")


class _Report:
    """Counts, audit and digest of a conversation whose edits come one after another, or part by part."""

    LEGAL = ("su", "ua", "au")

    def __init__(self):
        self.low = self.high = self.turn = self.first = self.last = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.lines: list[str] = []

    def edit(self, edit, times, turn, was, role, text, fault) -> None:
        self.audit.append(edit * times)
        self.cost += times * {KEEP: 0, REROLE: REROLE_COST, DELETE: DELETE_COST, INSERT: INSERT_COST}[edit]
        if edit != DELETE:
            self.lines.append(f"{role}:{text}")
            self.cost += TRUNCATED_COST * (fault == "truncated")
        if was is None:
            return
        if turn is not None:
            self.turns += turn != self.turn
            self.low, self.high, self.turn = (turn if self.low is None else self.low), turn, turn
        if fault:
            setattr(self, fault, getattr(self, fault) + times)
        self.illegal += (self.last is not None and self.last + was[:1] not in self.LEGAL) + times - 1
        self.first = was[:1] if self.first is None else self.first
        self.last = was[:1]

    COUNTS = ("low", "high", "turns", "first", "last", "blank", "duplicate", "truncated", "illegal", "cost")

    def add(self, low, high, turns, first, last, blank, duplicate, truncated, illegal, cost) -> None:
        """A part's counts, behind those so far."""
        if turns:
            self.turns += turns - (low == self.high)
            self.low, self.high = (low if self.low is None else self.low), high
        self.illegal += illegal
        if first is not None:
            self.illegal += self.last is not None and self.last + first not in self.LEGAL
            self.last = last
        self.blank, self.duplicate, self.truncated, self.cost = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated, self.cost + cost

    @property
    def row(self) -> list:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return [gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost]


_NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]


def repair_report(edits: DataFrame) -> DataFrame:
    """One row per conversation of `repaired_turns`: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    A conversation in one partition is told there.  Of one that several hold, each
    gives its counts and its repaired text in pieces; one digest can only be made
    from its beginning to its end, so those pieces, and nothing else, pass through
    one task in order, one at a time.
    """
    schema = edits.limit(0).toArrow().schema.field("conv_id").type
    kind = edits.schema["conv_id"].dataType.simpleString()
    counts = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 5]
    names = ["conv_id", *_NUMBERS, "audit", "repaired_sha256", "at", "part", "lines"]
    part = pa.struct(list(zip(_Report.COUNTS, counts, strict=True)))
    kinds = [schema, *[pa.int64()] * 6, pa.string(), pa.string(), pa.int64(), part, pa.string()]

    def tell(batches):
        out: list[tuple] = []
        for conv, rows in _parts(batches):
            split, report = rows[0][9], _Report()
            for r in rows:
                report.edit(*r[2:9])
            if not split:
                digest = hashlib.sha256("\n".join(report.lines).encode()).hexdigest()
                out.append((conv, *report.row, "".join(report.audit), digest, None, None, None))
            else:
                # Each line with a newline before it; the digest leaves the first one out.
                text, at = "".join(f"\n{x}" for x in report.lines), rows[0][1]
                own = {c: getattr(report, c) for c in _Report.COUNTS}
                out.append((conv, *[None] * 6, "".join(report.audit), None, at, own, text[:PIECE_CHARS]))
                out += [(conv, *[None] * 6, "", None, at + 1, None, text[k : k + PIECE_CHARS]) for k in range(PIECE_CHARS, len(text), PIECE_CHARS)]
            if len(out) >= 500:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    def join(batches):
        now: list = []

        def row(conv, report, digest):
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip([conv, *report.row, "".join(report.audit), digest.hexdigest()], kinds[:9], strict=True)], names[:9])

        for batch in batches:
            for r in batch.to_pylist():
                if not now or now[0] != r["conv_id"]:
                    if now:
                        yield row(*now[:3])
                    now = [r["conv_id"], _Report(), hashlib.sha256(), True]
                if r["part"]:
                    now[1].add(**r["part"])
                    now[1].audit.append(r["audit"])
                if r["lines"]:
                    now[2].update(r["lines"][now[3] :].encode())
                    now[3] = False
        if now:
            yield row(*now[:3])

    numbers = ", ".join(f"{c} long" for c in _NUMBERS)
    struct = ",".join(f"{c}:{'string' if c in ('first', 'last') else 'long'}" for c in _Report.COUNTS)
    told = cut(edits.mapInArrow(tell, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string, at long, part struct<{struct}>, lines string"))
    whole, pieces = told.where("at is null").select(*names[:9]), told.where("at is not null")
    if pieces.isEmpty():
        return whole
    order = pieces.withColumn("piece", F.monotonically_increasing_id())
    return whole.unionByName(order.repartition("conv_id").sortWithinPartitions("conv_id", "piece").drop("piece").mapInArrow(join, f"conv_id {kind}, {numbers}, audit string, repaired_sha256 string"))


def repair_conversations(turns: DataFrame) -> DataFrame:
    """The report on every conv_id of the undamaged table, after damage and repair; one without turns has zeros and nothing.

    A null conv_id is one conversation.  Further columns are not read, whatever
    their names.  An empty table gives an empty result.
    """
    report = repair_report(repaired_turns(damaged(turns))).withColumnRenamed("conv_id", "c")
    every = turns.select("conv_id").distinct()
    nothing: Column = F.lit(hashlib.sha256(b"").hexdigest())
    out = every.join(report, F.col("conv_id").eqNullSafe(F.col("c")), "left")
    return out.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in _NUMBERS], F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))
