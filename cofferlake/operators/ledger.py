"""Transaction ledger: fingerprints, multiset dedupe, average-cost positions, orders, income.

A ledger row has user_id, symbol, type (buy, sell, dividend, fee, split, isin_change), date, seq (order of same-day
rows), shares, price, total_amount, fee, tax, ratio, currency and exchange_rate.
"""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.functions.money import exact_sum
from cofferlake.sources.shared import stored

#: Held quantities closer to zero than this count as none; split ratios above the largest are taken as corrupt.
NOTHING, LARGEST_RATIO = 1e-9, 1000
CASH = "CASH"


def fingerprint() -> Column:
    """Identity of a move: trades by shares and price, other rows by their amount, splits by ratio or share change.

    Shares count in millionths, prices and amounts in ten-thousandths.
    """
    units = lambda x, scale: F.floor(F.coalesce(x, F.lit(0.0)) * scale + 0.5).cast("string")
    day, kind = F.col("date").cast("string").substr(1, 10), F.lower("type")
    trade = F.concat_ws("|", day, F.upper("symbol"), kind, units(F.col("shares"), 1_000_000.0), units(F.col("price"), 10_000.0))
    amount = F.when(kind.isin("split", "isin_change"), F.coalesce("ratio", "shares", F.lit(0.0))).otherwise(F.coalesce("total_amount", "ratio", "shares", F.lit(0.0)))
    other = F.concat_ws("|", day, F.upper("symbol"), kind, units(amount, 10_000.0))
    return F.when(kind.isin("buy", "sell", ""), trade).otherwise(other)


def existing_fingerprints(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id", fingerprint().alias("fp")).agg(F.count("*").alias("n"))


def dedupe_trades(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` with ``duplicate``: of equal moves as many count as already known as the ledger holds."""
    known = existing_fingerprints(existing).withColumnRenamed("n", "known")
    marked = new.withColumn("fp", fingerprint())
    order = Window.partitionBy("user_id", "fp").orderBy("date", "symbol", "seq", "order_key")
    marked = marked.withColumn("rn", F.row_number().over(order)).join(known, ["user_id", "fp"], "left")
    return marked.withColumn("duplicate", F.col("rn") <= F.coalesce("known", F.lit(0))).drop("rn", "known")


def ledger_rows(events: DataFrame, fx: DataFrame) -> DataFrame:
    """Normalised events as ledger rows with currency and the current rate (1 for unknown currencies)."""
    kind, trade = F.col("type"), F.col("type").isin("buy", "sell")
    rows = events.join(F.broadcast(fx.select("currency", F.col("rate").alias("_rate"))), "currency", "left")
    return rows.select(
        "user_id", "symbol", "type", "date", "seq", "currency",
        F.when(kind.isin("dividend", "fee"), 0.0).otherwise(F.col("shares")).alias("shares"),
        F.when(trade, F.col("price")).otherwise(0.0).alias("price"),
        F.when(trade, F.col("shares") * F.col("price")).when(kind.isin("dividend", "fee"), F.col("total_amount")).otherwise(0.0).alias("total_amount"),
        F.when(trade, F.col("fee")).alias("fee"), F.when(kind == "dividend", F.col("tax")).alias("tax"),
        F.when(kind.isin("split", "isin_change"), F.col("ratio")).alias("ratio"), F.coalesce("_rate", F.lit(1.0)).alias("exchange_rate"),
    )


#: Groups of more moves are folded in blocks of about so many, over several tasks.
HOT_MOVES, BLOCK_MOVES = 100_000, 20_000
#: Groups are counted in so many buckets first.
BUCKETS = 1 << 14
_GROUP = ("user_id", "symbol")
_BUY, _SELL, _TIMES, _PLUS, _DIVIDEND, _FEE, _NONE = range(7)
_TOTALS = ("sh", "cost", "realized", "dividends", "tax", "fees")


def _ordered_moves(ledger: DataFrame, *columns: str) -> Column:
    return F.sort_array(F.collect_list(F.struct(*columns)))


def _as_moves(ledger: DataFrame) -> DataFrame:
    """``ledger`` with what each row does: _k, its kind; _x, shares or a factor; _y, cost, proceeds or income; _z, fee or tax."""
    num = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    kind, q, p, fee, amount, ratio = F.col("type"), num("shares"), num("price"), num("fee"), num("total_amount"), F.col("ratio")
    times = (ratio > 0) & (ratio <= LARGEST_RATIO)
    split = kind.isin("split", "isin_change")
    code = F.when(kind == "buy", _BUY).when(kind == "sell", _SELL).when(split, F.when(times, _TIMES).otherwise(_PLUS)).when(kind == "dividend", _DIVIDEND).when(kind == "fee", _FEE).otherwise(_NONE)
    return ledger.withColumns({
        "_k": code, "_x": F.when(split & times, ratio).otherwise(q), "_y": F.when(kind == "buy", q * p + fee).when(kind == "sell", p * q - fee).otherwise(amount),
        "_z": F.when(kind == "dividend", num("tax")).when(kind == "fee", amount).otherwise(fee),
    })


def _shares_after(sh: Column, m: Column) -> Column:
    left = sh - m["_x"]
    return F.when(m["_k"].isin(_BUY, _PLUS), sh + m["_x"]).when(m["_k"] == _SELL, F.when(left < NOTHING, 0.0).otherwise(left)).when(m["_k"] == _TIMES, sh * m["_x"]).otherwise(sh)


def _income_after(a: Column, m: Column) -> list[Column]:
    return [
        F.when(m["_k"] == _DIVIDEND, a["dividends"] + m["_y"]).otherwise(a["dividends"]).alias("dividends"),
        F.when(m["_k"] == _DIVIDEND, a["tax"] + m["_z"]).otherwise(a["tax"]).alias("tax"),
        F.when(m["_k"].isin(_BUY, _SELL, _FEE), a["fees"] + m["_z"]).otherwise(a["fees"]).alias("fees"),
        (a["review"] | ((m["_k"] == _SELL) & (a["sh"] - m["_x"] < -NOTHING))).alias("review"),
    ]


def _folded(moves: Column) -> Column:
    """Shares, cost, realised gain and income after a group's moves."""
    zero = F.struct(*[F.lit(0.0).alias(n) for n in _TOTALS], F.lit(False).alias("review"))

    def step(a: Column, m: Column) -> Column:
        sold = F.when(a["sh"] > 0, a["cost"] / a["sh"]).otherwise(0.0) * m["_x"]
        return F.struct(
            _shares_after(a["sh"], m).alias("sh"),
            F.when(m["_k"] == _BUY, a["cost"] + m["_y"]).when(m["_k"] == _SELL, F.when(a["sh"] - m["_x"] < NOTHING, 0.0).otherwise(a["cost"] - sold)).otherwise(a["cost"]).alias("cost"),
            F.when(m["_k"] == _SELL, a["realized"] + (m["_y"] - sold)).otherwise(a["realized"]).alias("realized"),
            *_income_after(a, m),
        )

    return F.aggregate(moves, zero, step)


def _shares_shape(moves: Column) -> Column:
    """Shares after a block as a function of those before it: the greater of ``c`` and ``a * sh + b``.

    ``c`` is what the moves behind the last possible clamp leave; a block that cannot clamp has none.
    """
    start = F.struct(F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(float("-inf")).alias("c"))

    def step(s: Column, m: Column) -> Column:
        times, change = F.when(m["_k"] == _TIMES, m["_x"]).otherwise(1.0), F.when(m["_k"].isin(_BUY, _PLUS), m["_x"]).when(m["_k"] == _SELL, -m["_x"]).otherwise(0.0)
        return F.struct((s["a"] * times).alias("a"), (s["b"] * times + change).alias("b"), _shares_after(s["c"], m).alias("c"))

    return F.aggregate(moves, start, step)


def _block_effect(moves: Column, sh: Column) -> Column:
    """What a block does, given the shares before it: cost becomes ``keep * cost + cost_more``, the realised gain grows by ``take * cost + gain``."""
    start = F.struct(sh.alias("sh"), F.lit(1.0).alias("keep"), *[F.lit(0.0).alias(n) for n in ("cost_more", "take", "gain", "dividends", "tax", "fees")], F.lit(False).alias("review"))

    def step(a: Column, m: Column) -> Column:
        sell, sold_out = m["_k"] == _SELL, a["sh"] - m["_x"] < NOTHING
        sold = lambda c: F.when(a["sh"] > 0, a[c] / a["sh"]).otherwise(0.0) * m["_x"]
        left = lambda c: F.when(sold_out, 0.0).otherwise(a[c] - sold(c))
        return F.struct(
            _shares_after(a["sh"], m).alias("sh"),
            F.when(sell, left("keep")).otherwise(a["keep"]).alias("keep"),
            F.when(m["_k"] == _BUY, a["cost_more"] + m["_y"]).when(sell, left("cost_more")).otherwise(a["cost_more"]).alias("cost_more"),
            F.when(sell, a["take"] - sold("keep")).otherwise(a["take"]).alias("take"),
            F.when(sell, a["gain"] + (m["_y"] - sold("cost_more"))).otherwise(a["gain"]).alias("gain"),
            *_income_after(a, m),
        )

    return F.aggregate(moves, start, step)


def _shares_before(blocks: pd.DataFrame) -> pd.DataFrame:
    """Shares before each block of a group."""
    blocks, sh, before = blocks.sort_values("_block"), 0.0, []
    for a, b, c in zip(blocks["a"], blocks["b"], blocks["c"]):
        before.append(sh)
        sh = max(c, a * sh + b)
    return blocks[[*_GROUP, "_block"]].assign(before=before)


def _over_blocks(blocks: pd.DataFrame) -> pd.DataFrame:
    """A group's totals from the effects of its blocks."""
    blocks, cost, realized = blocks.sort_values("_block"), 0.0, 0.0
    for keep, more, take, gain in zip(blocks["keep"], blocks["cost_more"], blocks["take"], blocks["gain"]):
        realized, cost = realized + (take * cost + gain), keep * cost + more
    last = blocks.iloc[-1:]
    return last[[*_GROUP, "sh"]].assign(cost=cost, realized=realized, dividends=blocks["dividends"].sum(), tax=blocks["tax"].sum(), fees=blocks["fees"].sum(), review=bool(blocks["review"].any()))


def _same_group(a: DataFrame, b: DataFrame) -> Column:
    return a["user_id"].eqNullSafe(b["user_id"]) & a["symbol"].eqNullSafe(b["symbol"])


def _hot_positions(moves: DataFrame, rows: int, block: int) -> DataFrame:
    """``_folded`` for groups of many moves (``rows`` in all): ranges of a group's order are blocks of several tasks.

    Blocks are written down once, as ranges need not fall alike when they are drawn again. What a group's blocks are
    joined by is a few numbers for each.
    """
    ranged = moves.repartitionByRange(max(1, -(-rows // block)), *_GROUP, "date", "seq").withColumn("_block", F.spark_partition_id())
    blocks = stored(ranged.groupBy(*_GROUP, "_block").agg(_ordered_moves(ranged, "date", "seq", "_k", "_x", "_y", "_z").alias("moves")), "ledger-blocks")
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    key = ", ".join(f"{c} {kinds[c]}" for c in _GROUP)
    before = blocks.select(*_GROUP, "_block", _shares_shape(F.col("moves")).alias("s")).select(*_GROUP, "_block", "s.*")
    before = before.groupBy(*_GROUP).applyInPandas(_shares_before, f"{key}, _block int, before double").withColumnRenamed("_block", "_of")
    effects = blocks.join(before, _same_group(blocks, before) & (blocks["_block"] == before["_of"])).select(*[blocks[c] for c in _GROUP], "_block", _block_effect(F.col("moves"), F.col("before")).alias("e"))
    totals = effects.select(*_GROUP, "_block", "e.*").groupBy(*_GROUP).applyInPandas(_over_blocks, f"{key}, {', '.join(f'{n} double' for n in _TOTALS)}, review boolean")
    return totals.select(*_GROUP, F.struct(*_TOTALS, "review").alias("p"))


def _long_groups(rows: DataFrame, hot: int) -> DataFrame | None:
    """Groups of more than ``hot`` rows and how many each has, as ``_n``; none where no bucket of groups has so many.

    Buckets are few, so that each task sends a few numbers and not all its groups.
    """
    buckets = rows.groupBy(F.pmod(F.xxhash64(*_GROUP), F.lit(BUCKETS)).alias("_bucket")).agg(F.count("*").alias("_n"))
    if buckets.where(F.col("_n") > hot).isEmpty():
        return None
    return rows.groupBy(*_GROUP).agg(F.count("*").alias("_n")).where(F.col("_n") > hot)


def positions_from_ledger(ledger: DataFrame, also: tuple[Column, ...] = (), hot: int = HOT_MOVES, block: int = BLOCK_MOVES, counted: DataFrame | None = None) -> DataFrame:
    """Average-cost positions by user and symbol, folded over each group's moves in order of date and seq.

    Buys add cost and fee; sells realise proceeds less fee less average cost; oversold positions go to zero and are
    flagged; splits multiply by a plausible ratio, else add shares; dividends and fees only add up. ``also`` names further
    aggregates of the same groups, so that the ledger is shuffled once for all. A group of more than ``hot`` moves is folded
    in blocks of about ``block`` moves: what a block does to shares is a function of two straight lines, so the shares
    before every block follow from a few numbers of each; given these, what it does to cost and gain is linear. Groups are
    counted in ``counted``, the same rows without what need not be worked out for that, or else in the ledger.
    """
    moves = _as_moves(ledger)
    counts = _long_groups(ledger if counted is None else counted, hot)
    many = None if counts is None else counts.agg(F.sum("_n")).first()[0]
    plain = moves if many is None else moves.join(counts, _same_group(moves, counts), "left_anti")
    grouped = plain.groupBy(*_GROUP).agg(_ordered_moves(plain, "date", "seq", "_k", "_x", "_y", "_z").alias("moves"), *also)
    more = [c for c in grouped.columns if c not in (*_GROUP, "moves")]
    folded = grouped.select(*_GROUP, _folded(F.col("moves")).alias("p"), *more)
    if many is not None:
        long = moves.join(counts, _same_group(moves, counts), "left_semi")
        totals = _hot_positions(long, many, block)
        if also:
            beside = long.groupBy(*[F.col(c).alias(f"_{c}") for c in _GROUP]).agg(*also)
            totals = totals.join(beside, totals["user_id"].eqNullSafe(beside["_user_id"]) & totals["symbol"].eqNullSafe(beside["_symbol"]))
        folded = folded.unionByName(totals.select(*_GROUP, "p", *more))
    sh = F.col("p.sh")
    return folded.select(
        *_GROUP, F.when(sh < NOTHING, 0.0).otherwise(sh).alias("shares"), F.when(sh > NOTHING, F.col("p.cost") / sh).otherwise(0.0).alias("avg_price"),
        F.col("p.realized").alias("realized_pnl"), F.col("p.dividends").alias("dividends"), F.col("p.tax").alias("tax_withheld"), F.col("p.fees").alias("fees_paid"), F.col("p.review").alias("needs_review"), *more,
    )


def rebuild_positions(ledger: DataFrame, positions: DataFrame, assets: DataFrame) -> DataFrame:
    """Stored positions after the ledger: closed ones keep their last average, new ones appear if anything happened.

    positions: user_id, symbol, name, platform, asset_type, shares, avg_price. assets: ticker, name, asset_type.
    """
    computed = positions_from_ledger(ledger, (F.max_by("broker", F.struct("date", "seq", "broker")).alias("broker"),)).where(F.col("symbol") != CASH)
    worth = (F.col("shares") > 0) | (F.col("dividends") != 0) | (F.col("realized_pnl") != 0) | (F.col("fees_paid") != 0)
    old = positions.select("user_id", "symbol", *[F.col(c).alias(f"old_{c}") for c in ("name", "platform", "asset_type", "shares", "avg_price")], F.lit(True).alias("stored"))
    one = F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", "asset_type"))  # of several rows of a ticker the first by name and type
    meta = assets.groupBy(F.col("ticker").alias("symbol")).agg(one.alias("m")).select("symbol", F.col("m.name").alias("meta_name"), F.col("m.asset_type").alias("meta_type"))
    out = computed.withColumn("worth", worth).join(old, ["user_id", "symbol"], "full_outer").join(meta, "symbol", "left").where(F.col("stored") | F.col("worth"))
    return out.select(
        "user_id", "symbol", F.coalesce("old_name", "meta_name", "symbol").alias("name"), F.coalesce("old_platform", "broker", F.lit("Imported")).alias("platform"),
        F.coalesce("old_asset_type", "meta_type", F.lit("Stock")).alias("asset_type"), F.coalesce("shares", "old_shares").alias("shares"),
        F.when(F.col("stored") & ~F.coalesce(F.col("shares") > 0, F.lit(False)), F.col("old_avg_price")).otherwise(F.col("avg_price")).alias("avg_price"),
        *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("realized_pnl", "dividends", "tax_withheld", "fees_paid")],
    )


_ORDER = ("date", "seq", "action", "shares", "total_amount")
_HELD = ("shares", "avg_price", "realized_pnl", "known", "rejected")


def _folded_orders(orders: Column) -> Column:
    """Shares, average price, realised gain, whether ever added, and rejected orders after a group's orders."""
    zero = F.struct(F.lit(0.0).alias("shares"), F.lit(0.0).alias("avg_price"), F.lit(0.0).alias("realized_pnl"), F.lit(False).alias("known"), F.lit(0).cast("long").alias("rejected"))

    def step(a: Column, m: Column) -> Column:
        price = F.try_divide(m["total_amount"], m["shares"])
        add, buy, sell = m["action"] == "add", m["action"] == "buy", m["action"] == "sell"
        fits = (add & (a["shares"] <= 0)) | (buy & a["known"]) | (sell & a["known"] & (m["shares"] <= a["shares"]))
        ok = F.coalesce(fits & (m["shares"] > 0) & m["total_amount"].isNotNull(), F.lit(False))
        bought = a["shares"] + m["shares"]
        return F.struct(
            F.when(~ok, a["shares"]).when(add, m["shares"]).when(buy, bought).otherwise(a["shares"] - m["shares"]).alias("shares"),
            F.when(~ok | sell, a["avg_price"]).when(add, price).otherwise(F.try_divide(a["shares"] * a["avg_price"] + m["shares"] * price, bought)).alias("avg_price"),
            F.when(ok & sell, a["realized_pnl"] + (price - a["avg_price"]) * m["shares"]).otherwise(a["realized_pnl"]).alias("realized_pnl"),
            (a["known"] | (ok & add)).alias("known"),
            (a["rejected"] + F.when(ok, 0).otherwise(1)).alias("rejected"),
        )

    return F.aggregate(orders, zero, step)


def _streamed_orders(batches):
    """``_folded_orders`` of rows that come group by group, in order: no more than a batch is held."""
    group, state = None, None
    for batch in batches:
        out = []
        for *key, action, q, amount in zip(*(batch.column(c).to_pylist() for c in (*_GROUP, "action", "shares", "total_amount"))):
            if state is None or key != group:
                if state is not None:
                    out.append((*group, *state))
                group, state = key, (0.0, 0.0, 0.0, False, 0)
            sh, avg, realized, known, rejected = state
            whole = q is not None and q > 0 and amount is not None
            if whole and action == "add" and sh <= 0:
                state = q, amount / q, realized, True, rejected
            elif whole and action == "buy" and known:
                state = sh + q, (sh * avg + q * (amount / q)) / (sh + q), realized, known, rejected
            elif whole and action == "sell" and known and q <= sh:
                state = sh - q, avg, realized + (amount / q - avg) * q, known, rejected
            else:
                state = sh, avg, realized, known, rejected + 1
        if out:
            yield _positions_batch(out, batch.schema)
    if state is not None:
        yield _positions_batch([(*group, *state)], batch.schema)


def _positions_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    kinds = [*(schema.field(c).type for c in _GROUP), pa.float64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows), kinds)], names=[*_GROUP, *_HELD])


def apply_orders(orders: DataFrame, hot: int = HOT_MOVES) -> DataFrame:
    """Positions after a sequence of orders (user_id, symbol, date, seq, action add/buy/sell, shares, total_amount).

    Orders that do not fit (adding to an active position, buying or selling what was never added, selling more than
    held) and orders without an amount or positive shares are rejected and counted; selling leaves the average price; no
    fees. Whether an order fits depends on all before it, so a group's orders are taken one by one; a group of more than
    ``hot`` orders is sorted over disk and read as a stream, so that no task holds it.
    """
    moves = orders.select(*_GROUP, "date", "seq", "action", F.col("shares").cast("double").alias("shares"), F.col("total_amount").cast("double").alias("total_amount"))
    counts = _long_groups(orders, hot)
    any_hot = counts is not None and not counts.isEmpty()
    plain = moves.join(counts, _same_group(moves, counts), "left_anti") if any_hot else moves
    out = plain.groupBy(*_GROUP).agg(_ordered_moves(plain, *_ORDER).alias("m")).select(*_GROUP, _folded_orders(F.col("m")).alias("p")).select(*_GROUP, "p.*")
    if any_hot:
        long = moves.join(counts, _same_group(moves, counts), "left_semi").repartition(*_GROUP).sortWithinPartitions(*_GROUP, *_ORDER)
        kinds = {f.name: f.dataType.simpleString() for f in moves.schema}
        key = ", ".join(f"{c} {kinds[c]}" for c in _GROUP)
        out = out.unionByName(long.mapInArrow(_streamed_orders, f"{key}, shares double, avg_price double, realized_pnl double, known boolean, rejected long"))
    return out.select(*_GROUP, *_HELD)


def remove_positions(positions: DataFrame, removed: DataFrame) -> DataFrame:
    """Positions without those named in ``removed`` (user_id, symbol)."""
    return positions.join(removed.select("user_id", "symbol").distinct(), ["user_id", "symbol"], "left_anti")


def record_transaction(ledger: DataFrame, rows: DataFrame, fx: DataFrame) -> DataFrame:
    """``ledger`` with ``rows`` appended, each with the rate of its currency (1 where unknown)."""
    rated = rows.drop("exchange_rate").join(F.broadcast(fx.select("currency", F.col("rate").alias("exchange_rate"))), "currency", "left")
    return ledger.unionByName(rated.withColumn("exchange_rate", F.coalesce("exchange_rate", F.lit(1.0))), allowMissingColumns=True)


def partition_positions(positions: DataFrame) -> DataFrame:
    return positions.withColumn("active", F.col("shares") > 0)


def sales_history(ledger: DataFrame) -> DataFrame:
    return ledger.where("type = 'sell'").orderBy(F.desc("date"), F.desc("seq"))


def total_realized(sales: DataFrame, column: str = "realized_pnl") -> DataFrame:
    return sales.groupBy("user_id").agg(exact_sum(F.coalesce(F.col(column), F.lit(0.0))).alias("realized"))


def income_totals(ledger: DataFrame, fx: DataFrame) -> DataFrame:
    """Dividends, tax, net and fees by user in the base currency, at stored rates, else current ones, else 1."""
    rated = ledger.join(F.broadcast(fx), "currency", "left").withColumn("r", F.coalesce("exchange_rate", "rate", F.lit(1.0)))
    dividend, kind = F.col("type") == "dividend", F.col("type")
    fee = F.when(kind == "fee", F.col("total_amount")).when(kind.isin("buy", "sell"), F.coalesce("fee", F.lit(0.0))).otherwise(0.0)
    sums = rated.groupBy("user_id").agg(
        exact_sum(F.when(dividend, F.col("total_amount") * F.col("r")).otherwise(0.0)).alias("dividends"),
        exact_sum(F.when(dividend, F.coalesce("tax", F.lit(0.0)) * F.col("r")).otherwise(0.0)).alias("tax"),
        exact_sum(fee * F.col("r")).alias("fees"),
    )
    return sums.withColumn("net", (F.col("dividends").cast("decimal(28,6)") - F.col("tax").cast("decimal(28,6)")).cast("double"))


def income_history(ledger: DataFrame) -> DataFrame:
    """Dividend and fee rows, newest first; net of tax, fees negative."""
    net = F.when(F.col("type") == "dividend", F.col("total_amount") - F.coalesce("tax", F.lit(0.0))).otherwise(-F.col("total_amount"))
    return ledger.where("type in ('dividend', 'fee')").withColumn("net", net).orderBy(F.desc("date"), F.desc("seq"))


def missing_income(positions: DataFrame, ledger: DataFrame, platform: str = "degiro") -> DataFrame:
    """Users with a position on ``platform`` whose ledger holds no dividend."""
    users = positions.where(F.lower("platform").contains(platform)).select("user_id").distinct()
    return users.join(ledger.where("type = 'dividend'").select("user_id").distinct(), "user_id", "left_anti")


def ledger_view(ledger: DataFrame, kind: str | None = None, query: str = "") -> DataFrame:
    """Rows of one type whose symbol contains the query, newest first, with their count by user."""
    rows = ledger if kind in (None, "all") else ledger.where(F.col("type") == kind)
    rows = rows.where(F.upper("symbol").contains(query.upper().strip())) if query.strip() else rows
    return rows.withColumn("n_rows", F.count("*").over(Window.partitionBy("user_id"))).orderBy(F.desc("date"), F.desc("seq"))


def needs_review(positions: DataFrame) -> DataFrame:
    return positions.groupBy("user_id").agg(F.bool_or("needs_review").alias("needs_review"))


def yield_on_cost(positions: DataFrame) -> DataFrame:
    cost = F.col("avg_price") * F.col("shares")
    return positions.withColumn("yield_on_cost", F.when(cost > 0, (F.col("dividends") - F.col("tax_withheld")) / cost * 100))


def apply_review_decisions(review: DataFrame, decisions: DataFrame) -> DataFrame:
    """Split rows for the reviewed items that were decided to be splits with a positive ratio."""
    yes = decisions.where("action = 'split' and ratio > 0").select("review_id", F.col("ratio").alias("_ratio"))
    return review.drop("ratio").join(yes, "review_id").withColumn("type", F.lit("split")).withColumnRenamed("_ratio", "ratio")


def seed_buy_movements(positions: DataFrame, movements: DataFrame) -> DataFrame:
    """One buy movement for each held position that has none."""
    have = movements.where("movement_type = 'buy'").select("user_id", F.col("stock_ticker").alias("symbol")).distinct()
    new = positions.where("shares > 0").join(have, ["user_id", "symbol"], "left_anti")
    return new.select("user_id", F.lit("stock").alias("asset_type"), F.col("symbol").alias("stock_ticker"), F.lit("buy").alias("movement_type"), F.col("shares").alias("qty"), F.col("avg_price").alias("price"), (F.col("shares") * F.col("avg_price")).alias("total_value"))
