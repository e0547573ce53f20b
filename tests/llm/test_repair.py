"""Repair of conversations against a search over all edits, and odd rows against the SQL."""

import hashlib
import heapq
import itertools
import random

import duckdb
import pyarrow as pa

from cofferlake.llm.oracle import REPAIR_SQL
from cofferlake.llm.repair import cheapest_edits, conversation_repairs, damaged, repaired_turns

SCHEMA = "conv_id long, turn long, role string, text string, n string, digest string, part string"
ODD = [
    (None, None, None, None), (None, 1, "user", "hi."), (7, 3, "user", "a."), (7, 3, "user", "a."), (7, None, "assistant", "b"), (7, 5, "tool", "x?"), (7, 6, "", "  \t"), (8, 1, "user", ""),
    (9, 2, "user", "only."), (7, 9, "system", "s."), (7, 10, "assistant", "b"), (7, 11, "user", "the end. \n"), (7, 12, "user", "the end. \n"), (7, 12, "user", "the end. \n"), (10, 5, "system", "Ünd? "),
    (10, 6, "user", "hot."), *[(11, 4, "user", "again and again.") for _ in range(40)], *[(12, i, "uae"[i % 3], "the same words.") for i in range(60)], (13, 0, "user", "long " * 300_000), (13, 1, "assistant", "word. " * 100_000),
]


def _search(rows):
    """(cost, edits) of the cheapest edits, least letters first, by a search over (row, state)."""
    after = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best, heap = {(0, 0): (0, "")}, [(0, "", 0, 0)]
    while heap:
        cost, edits, i, s = heapq.heappop(heap)
        if i == len(rows) and s in (0, 3):
            return cost, edits
        steps = [(3, "I", i, after[s][r]) for r in "ua" if r in after[s]]
        if i < len(rows):
            steps.append((4, "D", i + 1, s))
            if rows[i] != "x":
                cut = 3 * (len(rows[i]) > 1)
                steps += [(cut, "K", i + 1, after[s][r]) for r in rows[i][0] if r in after[s]]
                steps += [(3 + cut, "R", i + 1, after[s][r]) for r in "ua" if r in after[s]]
        for more, letter, k, t in steps:
            found = (cost + more, edits + letter)
            if (k, t) not in best or found < best[k, t]:
                best[k, t] = found
                heapq.heappush(heap, (*found, k, t))


def test_cheapest_edits_equal_a_search():
    chance = random.Random(3)
    for _ in range(1500):
        rows = [s for _ in range(chance.randint(0, 4)) for s in [chance.choice(["s", "u", "a", "o", "st", "ut", "at", "ot", "x"])] * chance.randint(1, 4)]
        assert cheapest_edits([(s, len(list(g))) for s, g in itertools.groupby(rows)]) == _search(rows), rows


def test_long_runs():
    cost, edits = cheapest_edits([("u", 10**6), ("a", 1), ("x", 10**5)])
    assert len(edits) - edits.count("I") == 10**6 + 1 + 10**5 and edits.endswith("D" * 10**5)
    assert cost == sum({"K": 0, "R": 3, "I": 3, "D": 4}[e] for e in edits)


def test_odd_rows_equal_the_sql(spark):
    rows = spark.createDataFrame([(*r, "n", "d", "p") for r in ODD], SCHEMA).repartition(5)
    found = {r.conv_id: tuple(r) for r in conversation_repairs(damaged(rows), rows).collect()}
    con = duckdb.connect()
    con.register("conversations", pa.table({k: pa.array([r[i] for r in ODD], pa.int64() if i < 2 else pa.string()) for i, k in enumerate(("conv_id", "turn", "role", "text"))}))
    wanted = {r[0]: r for r in con.execute(REPAIR_SQL).fetchall()}
    assert found == wanted
    assert conversation_repairs(damaged(rows.limit(0)), rows.limit(0)).count() == 0


def test_repaired_turns_are_what_the_digest_covers(spark):
    rows = spark.createDataFrame([(*r, "n", "d", "p") for r in ODD], SCHEMA).repartition(5)
    digests = {r.conv_id: r.repaired_sha256 for r in conversation_repairs(rows).collect()}
    turns = {}
    for r in repaired_turns(rows).collect():
        turns.setdefault(r.conv_id, {})[r.position] = f"{r.role}:{r.text}"
    for conv, digest in digests.items():
        said = turns.get(conv, {})
        assert sorted(said) == list(range(len(said)))
        assert hashlib.sha256("\n".join(said[k] for k in sorted(said)).encode()).hexdigest() == digest
