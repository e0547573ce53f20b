"""Repair of conversations whose turns are blank, repeated, cut off or out of order.

The cheapest edits that leave role initials ``(s?(ua)+)?``: keep a row (0), give it role user or assistant (3), delete
it (4; the only edit for blank and duplicate rows), insert an empty row anywhere (3); a truncated row that stays adds 3.
Four states say what may come next (start, after system, after user, after assistant), so a row is a min-plus matrix
of 4 x 4 costs that depends on its symbol alone: role initial and fault. Equal consecutive symbols make a run; a run of
any length moves the vector of costs by the binary powers of its matrix, kept for each symbol. The edits are unrolled
forward from these vectors, of equally cheap ones the least letter first (D, I, K, R), a run by halves that are kept
too, so a long run costs the logarithm of its length.

In Spark equal rows of a turn are counted first; a join with the first turn of each (role, text) tells duplicates. Then
one shuffle by conversation brings each its symbols, in order, and behind them its texts in the same order: a task
holds the runs and the edits of one conversation, which are one cell of the result, and reads its texts as a stream for
the digest. A digest over a whole conversation needs its texts in order in one task; nothing else does.

Cases: rows are taken by turn, nulls first, then by role and the digest of the text; nulls in role and text stand for one
space; a null conv_id is one conversation; repeated rows are duplicates; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import cache, lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACES = " \t\n\x0b\f\r"
RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string, edit string"

RECAST, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_FAR = 1 << 60
#: What follows a state: the state after each role initial, and the role that an edit would set there.
_AFTER = {START: {"s": SYSTEM, "u": USER}, SYSTEM: {"u": USER}, USER: {"a": ASSISTANT}, ASSISTANT: {"u": USER}}
_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
_MUST_GO = "x"


def _set(state: int) -> int:
    """The state after a row whose role an edit sets."""
    return _AFTER[state][_ROLE[state][0]]


#: A symbol is a role initial and "t" if truncated, or _MUST_GO.
def _stays(symbol: str, state: int) -> tuple[int, int] | None:
    """(cost, next state) of keeping a row, if it fits."""
    after = None if symbol == _MUST_GO else _AFTER[state].get(symbol[:1])
    return None if after is None else (CUT_OFF * (len(symbol) > 1), after)


@cache
def _inserts(state: int, target: int) -> int:
    """Cost of the inserted rows that lead from one state to another."""
    steps = 0
    while state != target:
        if steps > len(_STATES):
            return _FAR
        state, steps = _set(state), steps + 1
    return INSERT * steps


@cache
def _row_costs(symbol: str) -> tuple[tuple[int, ...], ...]:
    """Least cost from each state before a row, rows inserted before it included, to each state after it."""

    def one(state: int, target: int) -> int:
        found = DELETE if state == target else _FAR
        if symbol != _MUST_GO and _set(state) == target:
            found = min(found, RECAST + CUT_OFF * (len(symbol) > 1))
        kept = _stays(symbol, state)
        return min(found, kept[0]) if kept and kept[1] == target else found

    return tuple(tuple(min(_inserts(s, m) + one(m, t) for m in _STATES) for t in _STATES) for s in _STATES)


@cache
def _power(symbol: str, k: int) -> tuple[tuple[int, ...], ...]:
    """Costs of 2 ** k rows of one symbol."""
    if not k:
        return _row_costs(symbol)
    half = _power(symbol, k - 1)
    return tuple(tuple(min(half[s][m] + half[m][t] for m in _STATES) for t in _STATES) for s in _STATES)


_Vector = tuple[int, ...]
#: Cost from each state at the end of a conversation.
_END: _Vector = tuple(min(_inserts(s, START), _inserts(s, ASSISTANT)) for s in _STATES)


def _before(symbol: str, length: int, then: _Vector) -> _Vector:
    """Costs before a run, from those behind it."""
    k = 0
    while length >> k:
        if length >> k & 1:
            m = _power(symbol, k)
            then = tuple(min(m[s][t] + then[t] for t in _STATES) for s in _STATES)
        k += 1
    return then


def _flat(v: _Vector) -> tuple[int, _Vector]:
    """The least entry, and the vector above it."""
    least = min(v)
    return least, tuple(x - least for x in v)


@lru_cache(maxsize=4096)
def _unrolled(symbol: str, length: int, then: _Vector, state: int) -> tuple[str, int]:
    """The least of the cheapest edits of a run, and the state behind it; ``then`` are costs behind the run."""
    if length > 1:
        first = 1 << (length - 1).bit_length() - 1
        edits, state = _unrolled(symbol, first, _flat(_before(symbol, length - first, then))[1], state)
        more, state = _unrolled(symbol, length - first, then, state)
        return edits + more, state
    costs, edits = _before(symbol, 1, then), ""
    while True:
        left = costs[state]
        if DELETE + then[state] == left:
            return edits + "D", state
        if INSERT + costs[_set(state)] == left:
            edits, state = edits + "I", _set(state)
            continue
        kept = _stays(symbol, state)
        if kept and kept[0] + then[kept[1]] == left:
            return edits + "K", kept[1]
        return edits + "R", _set(state)


def cheapest_edits(runs: list[tuple[str, int]]) -> tuple[int, str]:
    """(cost, edits) of a conversation given as runs of equal symbols."""
    behind, cost = [], 0
    for symbol, length in reversed([("", 0), *runs]):
        least, vector = _flat(_END if not behind else _before(last[0], last[1], behind[-1]))
        cost += least
        behind.append(vector)
        last = symbol, length
    behind.reverse()
    state, edits = START, []
    for (symbol, length), then in zip(runs, behind[1:]):
        part, state = _unrolled(symbol, length, then, state)
        edits.append(part)
    return cost + behind[0][START], "".join(edits) + "I" * (_END[state] // INSERT)


class _Conversation:
    """What a task knows of the conversation it reads: symbols first, then texts."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.runs: list[tuple[str, int]] = []
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal"), 0)
        self.least = self.most = None
        self.turns = 0
        self.initial = None
        self.edits = None
        self.cost = self.at = self.position = 0
        self.state, self.digest = START, hashlib.sha256()

    def _run(self, symbol: str, length: int) -> None:
        if length and self.runs and self.runs[-1][0] == symbol:
            self.runs[-1] = symbol, self.runs[-1][1] + length
        elif length:
            self.runs.append((symbol, length))

    def symbol(self, turn: int | None, role: str, n: int, blank: bool, again: bool, cut: bool) -> None:
        """``n`` equal rows of one turn."""
        initial = role[:1]
        if self.initial is not None:
            self.counts["illegal"] += self.initial + initial not in ("su", "ua", "au")
        self.counts["illegal"] += n - 1
        self.initial = initial
        if turn is not None:
            self.turns += turn != self.most
            self.least, self.most = turn if self.least is None else self.least, turn
        first = 0 if blank or again else 1
        self.counts["blank" if blank else "duplicate"] += n - first
        self.counts["truncated"] += first * cut
        self._run((initial if initial in ("s", "u", "a") else "o") + "t" * cut, first)
        self._run(_MUST_GO, n - first)

    def settle(self) -> None:
        if self.edits is None:
            self.cost, self.edits = cheapest_edits(self.runs)

    def _put(self, role: str, text: str, edit: str) -> tuple:
        self.digest.update(f"{'\n' if self.position else ''}{role}:".encode() + text.encode())
        self.position += 1
        self.state = _AFTER[self.state][role[:1]]
        return (self.conv_id, self.position - 1, role, text, edit)

    def inserted(self) -> list[tuple]:
        out = []
        while self.edits[self.at : self.at + 1] == "I":
            self.at += 1
            out.append(self._put(_ROLE[self.state], "", "insert"))
        return out

    def text(self, role: str, text: str) -> list[tuple]:
        """The repaired rows that a row of the conversation makes."""
        out, edit = self.inserted(), self.edits[self.at]
        self.at += 1
        if edit == "K":
            out.append(self._put(role, text, "keep"))
        elif edit == "R":
            out.append(self._put(_ROLE[self.state], text, "rerole"))
        return out

    def row(self) -> tuple:
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.cost, self.edits, self.digest.hexdigest())


def _arrow(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], names=[name for name, _ in fields])


def _repaired(turns: bool, most: int = 4096, most_bytes: int = 1 << 24):
    """From rows in order of (conv_id, part) one row for each conversation, or its repaired turns."""
    schema = TURNS if turns else RESULT

    def run(batches):
        now, out, held = None, [], 0
        for batch in batches:
            columns = {c: batch.column(c) for c in batch.schema.names}
            small = [columns[c].to_pylist() for c in ("conv_id", "part", "turn", "role", "n", "blank", "again", "cut")]
            for k, (conv_id, part, turn, role, n, blank, again, cut) in enumerate(zip(*small)):
                made: list[tuple] = []
                if part == 0:
                    made, now = closed(now), _Conversation(conv_id)
                elif part == 1:
                    now.symbol(turn, role, n, blank, again, cut)
                else:
                    now.settle()
                    made = now.text(role, columns["text"][k].as_py())
                    made = made if turns else []
                out += made
                held += sum(len(x) for r in made for x in r if isinstance(x, str))
                if len(out) >= most or held >= most_bytes:
                    yield _arrow(out, schema)
                    out, held = [], 0
        out += closed(now)
        if out:
            yield _arrow(out, schema)

    def closed(now: _Conversation | None) -> list[tuple]:
        if now is None:
            return []
        now.settle()
        rest = now.inserted()
        return rest if turns else [now.row()]

    return run


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults that crc32(``conv_id:turn``) % 20 chooses; nulls stand for one space.

    0 drops a row, 1 empties its text, 2 takes its full stops, exclamation and question marks, 3 repeats it, 4 makes it the user's.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(word("conv_id"), F.lit(":"), word("turn")).cast("binary")) % 20
    out = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"), fault.alias("_fault")).where("_fault <> 0")
    out = out.withColumn("_copies", F.explode(F.when(F.col("_fault") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    text = F.when(F.col("_fault") == 1, "").when(F.col("_fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    return out.select("conv_id", "turn", F.when(F.col("_fault") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"))


def _in_parts(rows: DataFrame, conversations: DataFrame | None) -> DataFrame:
    """Conversations, their symbols and their texts, each conversation in one task and in this order."""
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text"))
    rows = rows.withColumn("digest", F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"")))
    end = F.rtrim("text", F.lit(SPACES))
    symbols = rows.select("conv_id", "turn", "role", "digest", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    symbols = symbols.groupBy("conv_id", "turn", "role", "digest").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    firsts = symbols.groupBy(F.col("conv_id").alias("_c"), F.col("role").alias("_r"), F.col("digest").alias("_d")).agg(F.bool_or(F.col("turn").isNull()).alias("_unknown"), F.min("turn").alias("_least"))
    symbols = symbols.join(firsts, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("role") == F.col("_r")) & (F.col("digest") == F.col("_d")))
    again = F.when(F.col("_unknown"), F.col("turn").isNotNull()).otherwise(F.col("turn") > F.col("_least"))
    symbols = symbols.withColumn("again", again).drop("_c", "_r", "_d", "_unknown", "_least")
    every = rows.select("conv_id")
    if conversations is not None:
        every = every.unionByName(conversations.select(F.col("conv_id").cast("long").alias("conv_id")))
    parts = every.distinct().withColumn("part", F.lit(0)).unionByName(symbols.withColumn("part", F.lit(1)), allowMissingColumns=True).unionByName(rows.withColumn("part", F.lit(2)), allowMissingColumns=True)
    return parts.repartition("conv_id").sortWithinPartitions("conv_id", "part", F.asc_nulls_first("turn"), "role", "digest").drop("digest")


def conversation_repairs(rows: DataFrame, conversations: DataFrame | None = None) -> DataFrame:
    """Faults, cost, edits and digest of each conversation that is in ``rows`` or, without rows, only in ``conversations``."""
    return _in_parts(rows, conversations).mapInArrow(_repaired(False), RESULT)


def repaired_turns(rows: DataFrame) -> DataFrame:
    """conv_id, position, role, text of the repaired conversations, and the edit that made each row."""
    return _in_parts(rows, None).mapInArrow(_repaired(True), TURNS)
