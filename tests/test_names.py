"""Near names against all pairs, marks of all scripts, other spellings of symbols, catalogue rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from cofferlake.functions.instruments import alternative_symbols
from cofferlake.functions.text import normalize_name
from cofferlake.operators import cellar as C


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(before + (x != y), row[j] + 1, row[j - 1] + 1)
    return row[-1]


@pytest.mark.parametrize("many", [0, 2_000])
def test_near_names_equal_all_pairs(spark, many):
    """Random names of 1 to 12 characters over few letters, and long ones with up to six edits."""
    chance = random.Random(8)
    word = lambda n, letters="abc": "".join(chance.choice(letters) for _ in range(n))

    def edited(s):
        for _ in range(chance.randint(0, 6)):
            at = chance.randint(0, len(s))
            s = s[:at] + chance.choice(["", "x", "yz"]) + s[at + chance.randint(0, 1) :]
        return s

    long = ["".join(chance.choice("abcdefghij ") for _ in range(chance.randint(18, 45))).strip() for _ in range(25)]
    lots = [(u, word(chance.randint(1, 12))) for u in (1, 2) for _ in range(150)] + [(1, edited(s)) for s in long for _ in range(4)] + [(1, None), (1, "  "), (None, "a")]
    scans = [(u, f"s{i}", n) for i, (u, n) in enumerate([(u, word(chance.randint(1, 12))) for u in (1, 2, 3) for _ in range(60)] + [(1, s) for s in long] + [(1, None), (1, ""), (1, "a"), (1, "ab")])]
    found = C.fuzzy_match_scans(spark.createDataFrame(scans, "user_id long, scan_id string, name string"), spark.createDataFrame(lots, "user_id long, name string"), many=many).collect()
    clean = lambda s: " ".join(s.split()).lower()
    wanted = set()
    for u, i, x in scans:
        for v, y in {(v, clean(y)) for v, y in lots if v == u and y is not None}:
            if x and u is not None and 0 < (d := _distance(clean(x), y)) <= max(2, int(min(len(clean(x)), len(y)) * 0.15)):
                wanted.add((u, i, y, d))
    assert {(r.user_id, r.scan_id, r.name, r.distance) for r in found} == wanted and len(found) == len(wanted) > 1_000


def test_marks_of_all_scripts_go(spark):
    words = {"Ξινόμαυρο": "ξινομαυρο", "Цимлянский Чёрный": "цимлянскии черныи", "Château  Margaux": "chateau margaux", "Vĩnh Ước": "vinh uoc", "e\u0301te\u0301": "ete", "ㄱ한": "ㄱ한"}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", normalize_name(F.col("w")).alias("n")).collect()
    assert {r.w: r.n for r in rows} == words


def test_other_spellings_in_order(spark):
    undotted = ["PA", "L", "DE", "MC", "SW", "AS", "MI", "BR", "HE", "ST", "OL", "CO"]
    european = ["DE", "PA", "AS", "MI", "MC", "SW", "L", "BR", "LS", "CO", "ST", "HE", "OL"]
    cases = {
        ("T8", "Nestle SA"): [f"T8.{x}" for x in undotted] + ["NESN.SW", "NSRGY", "NESTLE"], ("BRK.B.L", ""): [f"BRK.{x}" for x in european] + ["BRK"], ("abc.frk", None): ["ABC.DE", *[f"ABC.{x}" for x in european if x != "DE"], "ABC"],
        ("X", "X"): [f"X.{x}" for x in undotted], ("X", "Roche and Nestle"): [f"X.{x}" for x in undotted] + ["NESN.SW", "NSRGY", "ROCHE"], ("X", "AT&T Inc"): [f"X.{x}" for x in undotted] + ["AT&T"], ("X", "Ab Verylongname"): [f"X.{x}" for x in undotted],
    }
    rows = spark.createDataFrame(list(cases), "symbol string, name string").select("symbol", "name", alternative_symbols(F.col("symbol"), F.col("name")).alias("t")).collect()
    assert {(r.symbol, r.name): r.t for r in rows} == cases


def test_catalogue_rows_take_windows_and_types(spark):
    wines = spark.createDataFrame([(1, "Old", "W", 2000, None, "Red"), (2, "Same", "W", 2001, "2030", "White")], "wine_id long, name string, winery string, vintage int, drink_window string, type string")
    day = lambda n: dt.datetime(2024, 1, n)
    lots = spark.createDataFrame(
        [("a", "OLD ", "w", 2000, "2040", None, day(1)), ("b", "old", "W", 2000, "2050", "Rosé", day(2)), ("c", "Old", "W", 2000, None, None, day(3)), ("d", "Same", "W", 2001, "2030", "White", day(1)), ("e", "new one", None, None, "2031", "Red", day(1)), ("f", "New One", None, None, None, None, day(2))],
        "id string, name string, winery string, vintage int, drink_window string, type string, created_at timestamp",
    )
    resolved, fresh = C.resolve_catalogue(lots, wines)
    assert [(r.name, r.type, r.drink_window) for r in fresh.collect()] == [("New One", None, None)]
    assert [tuple(r) for r in C.catalogue_updates(resolved, wines).collect()] == [(1, "Old", "W", 2000, "2050", "Rosé")]
