"""Groups of very many moves, folded over several tasks."""

import math

import pytest
from pyspark.sql import functions as F

from cofferlake.operators.ledger import apply_orders, positions_from_ledger
from cofferlake.sources.shared import stored

TOTALS = ("shares", "avg_price", "realized_pnl", "dividends", "tax_withheld", "fees_paid")


def _moves(spark, rows, sells):
    """One long group that sells out, is oversold and split, one with null keys, and short ones."""
    n = F.col("id")
    kind = F.when(n % 97 == 0, "split").when(n % 89 == 0, "dividend").when(n % 83 == 0, "fee").when(F.rand(3) < sells, "sell").otherwise("buy")
    group = F.when(n % 10 < 6, 1).when(n % 10 < 8, F.lit(None)).otherwise(n % 300)
    return spark.range(rows).select(
        group.cast("long").alias("user_id"), F.when(n % 10 < 8, "HOT").otherwise("COLD").alias("symbol"), kind.alias("type"), F.date_add(F.lit("2020-01-01").cast("date"), (n / 3000).cast("int")).alias("date"), (n % 7919).alias("seq_"),
        (F.rand(5) * 40 + 1).alias("shares"), (F.rand(6) * 100 + 1).alias("price"), (F.rand(7) * 50).alias("total_amount"), F.when(n % 3 > 0, F.rand(8)).alias("fee"), F.rand(9).alias("tax"),
        F.when(n % 194 == 0, F.when(n % 388 == 0, 2.0).otherwise(0.5)).alias("ratio"), F.concat(F.lit("b"), n % 4).alias("broker"), n.alias("seq"),
    ).drop("seq_")


@pytest.mark.parametrize("sells", [0.3, 0.5, 0.7])
def test_blocks_equal_the_plain_fold(spark, sells):
    moves = stored(_moves(spark, 120_000, sells), "moves")
    also = (F.max("broker").alias("broker"), F.count("*").alias("n"))
    plain = {(r.user_id, r.symbol): r for r in positions_from_ledger(moves, also, hot=10**9).collect()}
    split = {(r.user_id, r.symbol): r for r in positions_from_ledger(moves, also, hot=5_000, block=1_500).collect()}
    assert plain.keys() == split.keys() and sum(r.n > 5_000 for r in plain.values()) == 2
    for key, a in plain.items():
        b = split[key]
        assert (a.needs_review, a.broker, a.n) == (b.needs_review, b.broker, b.n)
        assert all(math.isclose(a[c], b[c], rel_tol=1e-9, abs_tol=1e-6) for c in TOTALS), (a, b)


def test_streamed_orders_equal_the_plain_fold(spark):
    n = F.col("seq")
    action = F.when(n % 47 < 2, "add").when(n % 101 == 0, F.lit(None)).when(F.rand(3) < 0.5, "sell").otherwise("buy")
    moves = _moves(spark, 60_000, 0.5).withColumn("action", action)
    moves = moves.withColumn("shares", F.when(n % 103 == 0, F.lit(None)).when(n % 107 == 0, 0.0).when(n % 109 == 0, -1.0).otherwise(F.col("shares")))
    orders = stored(moves.withColumn("total_amount", F.when(n % 113 > 0, F.col("total_amount"))), "orders")
    plain, split = apply_orders(orders, hot=10**9), apply_orders(orders, hot=5_000)
    assert "MapInArrow" in split._jdf.queryExecution().toString() and "MapInArrow" not in plain._jdf.queryExecution().toString()
    found = {(r.user_id, r.symbol): tuple(r) for r in split.collect()}
    assert found == {(r.user_id, r.symbol): tuple(r) for r in plain.collect()}
    assert found[1, "HOT"][2] > 0 and found[1, "HOT"][6] > 600 and found[None, "HOT"][5]


def test_orders_by_hand(spark):
    """Bought above, sold in part, sold too much, without an amount or shares, sold out, added again."""
    rows = [("add", 10.0, 100.0), ("add", 1.0, 1.0), ("buy", 10.0, 300.0), ("sell", 5.0, 200.0), ("sell", 16.0, 1.0), ("buy", 0.0, 5.0), ("buy", 1.0, None), ("swap", 1.0, 1.0), ("sell", 15.0, 150.0), ("add", 2.0, 8.0)]
    orders = spark.createDataFrame([(7, "X", "2024-01-01", i, *r) for i, r in enumerate(rows)], "user_id long, symbol string, date string, seq long, action string, shares double, total_amount double")
    for hot in (0, 100):
        (r,) = apply_orders(orders, hot=hot).collect()
        assert tuple(r) == (7, "X", 2.0, 4.0, 5 * (40 - 20) + 15 * (10 - 20), True, 5)
    assert apply_orders(orders.limit(0)).collect() == []
