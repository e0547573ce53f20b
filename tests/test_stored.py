"""Writes, deletes and statements in odd cases."""

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cofferlake.operators import statements as S
from cofferlake.operators import tables as A
from cofferlake.operators.ledger import positions_from_ledger
from cofferlake.sources.shared import exists, scratch_path
from cofferlake.sources.statements import statement_lines


def test_a_replacement_that_breaks_off_is_finished(spark, monkeypatch):
    """Stops before the marker leave the old table; stops behind it are made good by the next call, whatever it replaces."""
    rows = spark.createDataFrame([(i, "old") for i in range(200)], "user_id long, symbol string")
    users, new = rows.where("user_id % 3 = 0").select("user_id"), rows.where("user_id % 6 = 0").withColumn("symbol", F.lit("new"))
    wanted = sorted([(i, "old") for i in range(200) if i % 3] + [(i, "new") for i in range(200) if i % 6 == 0])
    now = lambda path: sorted((r.user_id, r.symbol) for r in spark.read.parquet(path).collect())
    for stop in ("write_text", "delete_path", "move_path"):
        path = scratch_path(spark, "stops")
        A.write_table(rows, path)
        real, calls = getattr(A, stop), []

        def broken(*args, real=real, calls=calls, **more):
            calls.append(args)
            if len(calls) == 3 or stop == "write_text":
                raise RuntimeError("stopped")
            return real(*args, **more)

        with monkeypatch.context() as m:
            m.setattr(A, stop, broken)
            with pytest.raises(RuntimeError):
                A.replace_user_rows(spark, path, new, users)
        if stop == "write_text":
            assert now(path) == [(i, "old") for i in range(200)]
        else:
            A.finish_replacement(spark, path)
            assert now(path) == wanted
        A.replace_user_rows(spark, path, new, users)
        assert now(path) == wanted and not exists(spark, f"{path}-replacing")


def test_replacing_empties_buckets(spark):
    path = scratch_path(spark, "rows")
    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "user_id long, symbol string")
    A.write_table(rows, path)
    A.replace_user_rows(spark, path, rows.where("user_id < 0"), spark.createDataFrame([(1,)], "user_id long"))
    assert sorted(r.user_id for r in spark.read.parquet(path).collect()) == [2, 3]
    A.replace_user_rows(spark, path, spark.createDataFrame([(2, "x"), (4, "y")], rows.schema), spark.createDataFrame([(2,), (4,)], "user_id long"))
    assert sorted((r.user_id, r.symbol) for r in spark.read.parquet(path).collect()) == [(2, "x"), (3, "c"), (4, "y")]


def test_upsert_takes_the_last_row_and_keeps_what_is_known(spark):
    schema = "ticker string, name string, isin string, source string"
    stored = spark.createDataFrame([("A", "old", "I1", "user"), ("B", "kept", None, None)], schema)
    new = spark.createDataFrame([("a", "first", "I2", None, 1), ("A", "last", None, None, 2), (None, "nobody", "I3", None, 1), ("", "blank", None, None, 1), ("c", None, "", "feed", 1)], schema + ", n int")
    rows = sorted(map(tuple, A.upsert_assets(stored, new, ["n"]).collect()))
    assert rows == [("A", "last", "I2", "user"), ("B", "kept", None, None), ("C", None, None, "feed")]
    assert A.upsert_assets(stored, new.where("n < 0")).count() == 2 and A.upsert_assets(stored.where("name = ''"), new, ["n"]).count() == 2


def _ledger(spark, rows):
    return spark.createDataFrame(rows, "user_id long, symbol string, timestamp string, date string, type string, seq long")


def test_deleting_by_timestamp_then_by_day_and_type(spark):
    ledger = _ledger(spark, [(1, "A", "t1", "d1", "buy", 1), (1, "A", "t1", "d1", "buy", 2), (1, "A", None, "d1", "buy", 3), (1, "A", "t2", "d1", "sell", 4), (2, "A", "t1", "d1", "buy", 1)])
    left = lambda stones: sorted((r.user_id, r.seq) for r in A.delete_ledger_rows(ledger, _ledger(spark, [(*s, 0) for s in stones])).collect())
    everything = [(1, 1), (1, 2), (1, 3), (1, 4), (2, 1)]
    assert left([(1, "A", "t1", "d1", "buy")]) == [(1, 2), (1, 3), (1, 4), (2, 1)]
    assert left([(1, "A", "t1", "d1", "buy")] * 3) == [(1, 4), (2, 1)]
    assert left([(1, "A", "t9", "d1", "sell")]) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert left([(1, "A", None, "d1", "buy"), (1, "A", "", "d1", "buy")]) == [(1, 3), (1, 4), (2, 1)]
    assert left([(1, "A", "t2", "d9", "buy")]) == [(1, 1), (1, 2), (1, 3), (2, 1)]
    assert left([(3, "A", "t1", "d1", "buy"), (1, "B", None, "d1", "buy")]) == everything


def test_positions_follow_deletes(spark):
    move = "user_id long, symbol string, timestamp string, date string, type string, seq long, shares double, price double, total_amount double, fee double, tax double, ratio double, broker string"
    ledger = spark.createDataFrame([(1, "A", "t1", "2024-01-01", "buy", 1, 2.0, 10.0, 20.0, 0.0, None, None, "x"), (1, "A", "t2", "2024-01-02", "buy", 2, 2.0, 30.0, 60.0, 0.0, None, None, "y")], move)
    stored = spark.createDataFrame([(1, "A", "name", "desk", "ETF", 4.0, 20.0)], "user_id long, symbol string, name string, platform string, asset_type string, shares double, avg_price double")
    assets = spark.createDataFrame([], "ticker string, name string, asset_type string")
    left, positions = A.delete_and_rebuild(ledger, ledger.where("seq = 2"), stored, assets)
    assert left.count() == 1 and [(r.shares, r.avg_price, r.name) for r in positions.collect()] == [(2.0, 10.0, "name")]
    assert positions_from_ledger(ledger.where("seq < 0")).count() == 0


def _files(spark, texts):
    return spark.createDataFrame([(f"f{i}", t) for i, t in enumerate(texts)], "file string, value string")


def test_statements_of_odd_files(spark):
    head = "Date,Time,Product,ISIN,Quantity,Price,,Transaction costs"
    line = '02-01-2024,10:00,"Name, Inc",US0378331005,{q},{p},USD,-0.50'
    texts = [
        "", None, "\r\n \r\n", head, head + "\n\n" + line.format(q=10, p="150.00") + "\n", head + "\n" + line.format(q="", p="1") + "\n" + line.format(q=5, p="0") + "\n" + "short", "Date,ISIN,Quantity\n1,US0378331005,1\n2,US0378331005,2",
        "Date,Ticker,Type,Quantity,Price per share,Total Amount,Currency\n2024-01-02T10:00:00Z,AAPL,BUY - MARKET,10,$150.00,$1500.00,USD\n2024-01-02T10:00:00Z,,CASH TOP-UP,,,$5,USD\n,,,,,,",
        head + "".join(f"\n{line.format(q=q, p=p)}" for q, p in ((10, 10), (-5, 40), (-1, 11), (2, 100), (-3, 500))),
    ]
    rows = S.parse_statements(_files(spark, texts)).collect()
    of = lambda i: sorted((r.line_no or 0, r.kind, r.reason or "") for r in rows if r.file == f"f{i}")
    assert of(3) == [] and [k for _, k, _ in of(4)] == ["trade"]
    assert [k for _, k, _ in of(5)] == ["skipped", "review", "skipped"]
    assert of(6) == [(0, "error", "ISIN, quantity or price column is missing")]
    assert [k for _, k, _ in of(7)] == ["trade", "skipped", "skipped"]
    # Each buy takes the first free sell of at least three times its price, or a third of it; the last sell stays.
    assert of(8) == [(2, "review", "possible_split"), (5, "review", "possible_split"), (6, "trade", "")]
    ratios = {r.line_no: r.ratio for r in rows if r.file == "f8"}
    assert ratios[2] == ratios[5] == 2.0


def test_large_files_are_read_by_several_tasks(spark):
    """Lines of split files have the numbers and give the events that whole files do."""
    head = "Date,Time,Product,ISIN,Quantity,Price,,Transaction costs"
    path = scratch_path(spark, "large")
    texts = [f"\n \n{head}" + "".join(f"\r\n02-01-2024,10:00,\"Name {'x' * (i % 40)}, Inc\",US{i % 500:010d},{i % 7 - 3},{1 + i % 90}.50,USD,-0.50" for i in range(12_000)), f"{head}\n03-01-2024,10:00,N,US0378331005,1,2,EUR,0\n", "no\nheader\n\nat all", " \n"]
    for k, text in enumerate(texts):
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.option("lineSep", "\n").text(f"{path}/file={k}")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
        lines = statement_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        events = S.parse_statements(lines)
        found = sorted(map(str, events.withColumn("file", F.regexp_extract("file", "file=([^/]+)/", 1)).collect()))
        numbers = [r.line_no for r in lines.where("file like '%file=0/%'").orderBy("line_no").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    whole = spark.createDataFrame([(str(k), t) for k, t in enumerate(texts)], "file string, value string")
    assert found == sorted(map(str, S.parse_statements(whole).collect())) and len(found) > 5_000
    assert numbers == list(range(1, 12_004))


def test_split_pairs_of_one_busy_day(spark):
    """The first free sell that fits, by the plain rule for every group, and ten thousand trades of a day in seconds."""
    chance = random.Random(2)
    schema = "file string, line_no long, kind string, type string, identifier string, date string, price double, shares double, reason string"
    rows = [("f", i, "trade" if chance.random() < 0.9 else "skipped", chance.choice(["buy", "sell"]), chance.choice("ABC"), chance.choice(["1", None]), chance.choice([0.0, 1.0, 2.0, 3.0, 9.0, 20.0, 61.0]), float(chance.randint(1, 9)), None) for i in range(600)]
    wanted, sold = {}, set()
    for r in rows:
        if r[2] == "trade" and r[3] == "buy":
            for x in rows:
                if x[2] == "trade" and x[3] == "sell" and x[1] not in sold and (x[4], x[5]) == (r[4], r[5]) and min(r[6], x[6]) > 0 and max(r[6], x[6]) / min(r[6], x[6]) >= 3:
                    sold.add(x[1])
                    wanted[r[1]] = r[7] / x[7]
                    break
    found = {r.line_no: r for r in S.detect_split_pairs(spark.createDataFrame(rows, schema).repartition(4)).collect()}
    assert found.keys() == {r[1] for r in rows} - sold and {k: r.ratio for k, r in found.items() if r.ratio is not None} == wanted
    assert all((r.kind, r.reason) == ("review", "possible_split") for k, r in found.items() if k in wanted)
    prices = np.random.default_rng(1).uniform(1, 50, (2, 5_000))
    begun = time.monotonic()
    fits = S.first_fits(prices[0], prices[1], 3.0)
    assert time.monotonic() - begun < 20 and len({k for k in fits if k >= 0}) == sum(k >= 0 for k in fits) > 1_000


def test_report_shows_the_first_lines(spark):
    events = spark.range(30).select(F.lit("f").alias("file"), (F.col("id") % 2).cast("string").alias("kind"), (30 - F.col("id")).alias("line_no"), F.lit("x").alias("identifier"))
    rows = {r.kind: r for r in S.import_report(events).collect()}
    assert rows["0"].n == 15 and [x.line_no for x in rows["0"]["first"]] == list(range(2, 25, 2))
    assert S.import_report(events.where("line_no < 0")).count() == 0
