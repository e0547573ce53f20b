"""Streams with late and repeated events."""

import datetime as dt

from pyspark.sql import functions as F

from cofferlake.operators.ledger import positions_from_ledger
from cofferlake.plans.streams import as_stream
from cofferlake.sources.shared import file_system, scratch_path
from cofferlake.streaming import jobs as J

MOVE = "user_id long, symbol string, date date, seq long, type string, shares double, price double, total_amount double, fee double, tax double, ratio double, part int"


def _day(n):
    return dt.date(2024, 1, n)


def _end(part):
    return (-1, "END", dt.date(2100, 1, 1), 1, "fee", None, None, None, None, None, None, part)


def test_late_moves_that_fit_are_folded_in_order(spark):
    """Moves out of order within the delay equal the batch form; one behind a folded move is rejected, with a reason."""
    J.with_rocksdb(spark)
    rows = [
        (1, "A", _day(1), 1, "buy", 10.0, 5.0, 50.0, 1.0, None, None, 0), (1, "A", _day(5), 3, "sell", 4.0, 9.0, 36.0, None, None, None, 0), (1, "A", _day(3), 2, "buy", 7.0, 1.0, 7.0, 0.0, None, None, 1), (1, "A", _day(6), 4, "split", 0.0, 0.0, 0.0, None, None, 2.0, 1),
        (2, "A", _day(2), 1, "dividend", None, None, 3.0, None, 0.5, None, 1), (1, "A", _day(20), 6, "sell", 50.0, 2.0, 100.0, 0.0, None, None, 1), (1, "A", _day(2), 9, "buy", 1.0, 1.0, 1.0, 0.0, None, None, 3), (1, "A", _day(7), 5, "buy", 2.0, 3.0, 6.0, 0.0, None, None, 2),
        (2, "A", _day(1), 0, "fee", None, None, 3.0, None, None, None, 3), (3, "B", _day(1), 1, "buy", 3.0, 3.0, 9.0, 0.0, None, None, 3), (-2, "Z", _day(21), 1, "fee", None, None, 1.0, None, None, None, 2), _end(4),
    ]
    moves = spark.createDataFrame(rows, MOVE)
    out = spark.read.schema(J.RUNNING).parquet(J.finished(J.running_positions(as_stream(moves, "late", [f"part = {k}" for k in range(5)]).drop("part")), "late-out"))
    found = {(r.user_id, r.seq): r for r in out.collect()}
    rejected = {k: r.reason for k, r in found.items() if r.rejected}
    # The third micro-batch folds what is before day 13 (day 20 less 7), its own move of day 7 included; the fourth is behind that.
    assert rejected == {(1, 9): J.TOO_LATE, (2, 0): J.TOO_LATE}
    batch = {r.user_id: r for r in positions_from_ledger(moves.where("not (user_id = 1 and seq = 9) and not (user_id = 2 and seq = 0)")).collect()}
    for user, last in ((1, 6), (2, 1), (3, 1)):
        assert all(found[user, last][c] == batch[user][c] for c in ("shares", "avg_price", "realized_pnl", "dividends", "tax_withheld", "fees_paid", "needs_review"))


def test_positions_go_on_from_their_checkpoint(spark):
    """A second run with the checkpoint of the first folds what waited there."""
    J.with_rocksdb(spark)
    rows = [(1, "A", _day(1), 1, "buy", 10.0, 5.0, 50.0, 1.0, None, None, 0), (1, "A", _day(3), 3, "sell", 4.0, 9.0, 36.0, None, None, None, 0), (1, "A", _day(2), 2, "buy", 7.0, 1.0, 7.0, 0.0, None, None, 1), _end(1)]
    moves, path, checkpoint, out = spark.createDataFrame(rows, MOVE), scratch_path(spark, "again"), scratch_path(spark, "again-checkpoint"), scratch_path(spark, "again-out")
    for part in (0, 1):
        moves.where(f"part = {part}").coalesce(1).write.mode("append").parquet(path)
        J.finished(J.running_positions(spark.readStream.schema(moves.schema).parquet(path).drop("part")), "again", checkpoint=checkpoint, path=out)
        seen = spark.read.schema(J.RUNNING).parquet(out).where("user_id = 1").orderBy("seq").collect()
        assert len(seen) == 3 * part
    batch = positions_from_ledger(moves.where("user_id = 1")).first()
    assert seen[-1].seq == 3 and all(seen[-1][c] == batch[c] for c in ("shares", "avg_price", "realized_pnl"))


def _ticks(spark, rows):
    return spark.createDataFrame([(t, i, dt.datetime(2024, 1, 1) + dt.timedelta(hours=h), p, part) for i, (t, h, p, part) in enumerate(rows)], "ticker string, id long, fetched_at timestamp, price double, part int")


def test_late_ticks_move_nothing(spark):
    J.with_rocksdb(spark)
    ticks = _ticks(spark, [("A", 1, 10.0, 0), ("A", 3, 20.0, 0), ("A", 2, 99.0, 1), ("A", 4, 10.0, 1), ("A", 5, 0.0, 1), ("B", 1, 7.0, 1)])
    out = spark.read.schema(J.MOVED).parquet(J.finished(J.live_movers(as_stream(ticks, "late-ticks", ["part = 0", "part = 1"]).drop("part")), "late-movers"))
    assert sorted((r.id, r.previous, r.change_pct) for r in out.collect()) == [(1, 10.0, 100.0), (3, 20.0, -50.0)]


def test_windows_close_and_late_ticks_drop(spark):
    """The watermark of one micro-batch makes ticks late from the next but one on."""
    ticks = _ticks(spark, [("A", 1, 1.0, 0), ("A", 20, 2.0, 0), ("A", 60, 3.0, 0), ("A", 61, 4.0, 1), ("B", 100, 5.0, 1), ("A", 2, 9.0, 2)])
    out = spark.read.schema("start timestamp, ticker string, price double, n long").parquet(J.finished(J.periodic_snapshots(as_stream(ticks, "win-ticks", ["part = 0", "part = 1", "part = 2"]).drop("part")), "windows"))
    assert sorted((r.start.day, r.price, r.n) for r in out.withColumn("start", F.col("start").cast("timestamp_ntz")).collect()) == [(1, 2.0, 2), (3, 4.0, 2)]


def _data_bytes(spark, path, number):
    store, jpath = file_system(spark, f"{path}/data/{number:09d}")
    return store.getContentSummary(jpath).getLength() if store.exists(jpath) else 0


def test_latest_prices_survive_a_repeated_batch(spark):
    path = scratch_path(spark, "latest-twice")
    upsert = J.latest_prices_into(path)
    first, second = _ticks(spark, [("A", 1, 1.0, 0), ("B", 1, 2.0, 0)]), _ticks(spark, [("A", 0, 5.0, 0), ("B", 2, 3.0, 0)])
    upsert(first, 0)
    for _ in range(2):
        upsert(second, 1)
    assert sorted((r.symbol, r.price) for r in J.latest_prices_table(spark, path, 1).collect()) == [("A", 1.0), ("B", 3.0)]


def test_a_batch_writes_its_buckets_only(spark):
    """Bytes written follow the batch and not the table; older versions stay whole until two later ones are there."""
    path = scratch_path(spark, "latest-buckets")
    upsert = J.latest_prices_into(path, buckets=32)
    tick = lambda i, p, n: (f"S{i}", n, float(p), 0)
    upsert(_ticks(spark, [tick(i, i, 1) for i in range(6_000)]), 0)
    upsert(_ticks(spark, [tick(7, 70, 2), tick(-1, 5, 2)]), 1)
    assert _data_bytes(spark, path, 1) < _data_bytes(spark, path, 0) / 8
    old, new = ({r.symbol: r.price for r in J.latest_prices_table(spark, path, n).collect()} for n in (0, 1))
    assert old == {f"S{i}": float(i) for i in range(6_000)} and new == old | {"S7": 70.0, "S-1": 5.0}
    upsert(_ticks(spark, [tick(7, 71, 3)]), 2)
    upsert(_ticks(spark, [tick(8, 80, 3)]), 3)
    assert {r.symbol: r.price for r in J.latest_prices_table(spark, path, 3).collect()} == new | {"S7": 71.0, "S8": 80.0}
