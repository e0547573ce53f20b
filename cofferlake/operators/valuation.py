"""Valuation, allocation, movers, snapshots and net worth. Clocks are arguments, never read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.functions.money import exact_sum, percent

CACHED = "(cached)"
FRESH_MINUTES = 15


def latest_prices(history: DataFrame, assets: DataFrame | None = None, held: DataFrame | None = None) -> DataFrame:
    """Newest price by ticker (ties by id), of known and held tickers, marked as cached."""
    rows = history
    for other, name in ((assets, "ticker"), (held, "symbol")):
        if other is not None:
            rows = rows.join(other.select(F.col(name).alias("ticker")).distinct(), "ticker", "left_semi")
    best = rows.groupBy("ticker").agg(F.max_by(F.struct("price", "fetched_at", "source"), F.struct("fetched_at", "id")).alias("b"))
    source = F.when(F.col("b.source").contains(CACHED), F.col("b.source")).otherwise(F.concat_ws(" ", "b.source", F.lit(CACHED)))
    return best.select("ticker", F.col("b.price").alias("price"), F.col("b.fetched_at").alias("fetched_at"), source.alias("source"))


def is_fresh(now: Column, minutes: int = FRESH_MINUTES) -> Column:
    """Successful, not from the cache, and at most ``minutes`` old."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("fetched_at").cast("timestamp"))
    return F.col("success") & ~F.contains(F.col("source"), F.lit(CACHED)) & (age <= minutes * 60_000_000)


def fx_to_base(quotes: DataFrame, base: str) -> DataFrame:
    """currency, rate to base, from foreign units per base unit; the base itself is 1."""
    spark = quotes.sparkSession
    own = spark.range(1).select(F.lit(base).alias("currency"), F.lit(1.0).alias("rate"))
    return quotes.where((F.col("rate") > 0) & (F.col("currency") != base)).select("currency", (1 / F.col("rate")).alias("rate")).unionByName(own)


def with_rate(df: DataFrame, fx: DataFrame, currency: str = "currency", name: str = "fx_rate") -> DataFrame:
    """Rate of each row's currency to base; unknown currencies count 1 to 1."""
    rates = F.broadcast(fx.select(F.col("currency").alias("_c"), F.col("rate").alias(name)))
    return df.join(rates, df[currency] == F.col("_c"), "left").drop("_c").withColumn(name, F.coalesce(name, F.lit(1.0)))


def position_gain(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """invested, market_value (cost where no price is known), gain and gain_pct of each position."""
    out = positions.join(prices.select("symbol", "price"), "symbol", "left").withColumn("invested", F.col("shares") * F.col("avg_price"))
    out = out.withColumn("market_value", F.coalesce(F.col("shares") * F.col("price"), F.col("invested"))).withColumn("gain", F.col("market_value") - F.col("invested"))
    return out.withColumn("gain_pct", percent(F.col("gain"), F.col("invested")))


def _totals(df: DataFrame, invested: Column, market: Column, priced: Column) -> DataFrame:
    sums = df.groupBy("user_id").agg(exact_sum(invested).alias("invested"), exact_sum(market).alias("market_value"), F.count_if(priced).alias("priced"), F.count("*").alias("positions"))
    sums = sums.withColumn("gain", (F.col("market_value").cast("decimal(28,6)") - F.col("invested").cast("decimal(28,6)")).cast("double"))
    return sums.withColumn("gain_pct", percent(F.col("gain"), F.col("invested")))


def portfolio_totals(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Per user totals in native currency; a price of 0 counts as missing."""
    rows = positions.join(prices.select("symbol", "price"), "symbol", "left")
    cost, priced = F.col("shares") * F.col("avg_price"), F.coalesce(F.col("price") != 0, F.lit(False))
    return _totals(rows, cost, F.when(priced, F.col("shares") * F.col("price")).otherwise(cost), priced)


def rated(ledger: DataFrame, fx: DataFrame) -> DataFrame:
    """Ledger rows with ``r``, their own rate to base or else the current one."""
    return with_rate(ledger, fx).withColumn("r", F.coalesce("exchange_rate", "fx_rate"))


def buy_flows() -> tuple[Column, ...]:
    """Aggregates of rated ledger rows by user and symbol: paid in base currency, shares bought, currency."""
    buy = F.col("type") == "buy"
    return (
        exact_sum(F.when(buy, F.col("total_amount") * F.col("r")).otherwise(0.0)).alias("paid"),
        exact_sum(F.when(buy, F.col("shares")).otherwise(0.0)).alias("bought"),
        F.max("currency").alias("currency"),
    )


def portfolio_totals_base(positions: DataFrame, ledger: DataFrame | None, prices: DataFrame, fx: DataFrame, split_adjusted: bool = False) -> DataFrame:
    """Per user totals in base currency of active positions.

    Invested is the sum of buys at their historic rates times held / bought shares; positions without a ledger use the
    current rate. ``split_adjusted`` bounds that ratio by 1, which splits otherwise exceed. Without a ledger the positions
    carry ``buy_flows`` themselves.
    """
    held = positions.where("shares > 0")
    if ledger is not None:
        held = held.join(rated(ledger, fx).groupBy("user_id", "symbol").agg(*buy_flows()), ["user_id", "symbol"], "left")
    rows = with_rate(held.join(prices.select("symbol", "price"), "symbol", "left"), fx)
    ratio = F.when(F.col("bought") > 0, F.col("shares") / F.col("bought")).otherwise(1.0)
    ratio = F.least(ratio, F.lit(1.0)) if split_adjusted else ratio
    cost, priced = F.col("shares") * F.col("avg_price"), F.coalesce(F.col("price") != 0, F.lit(False))
    invested = F.when(F.col("paid").isNotNull(), F.col("paid") * ratio).otherwise(cost * F.col("fx_rate"))
    return _totals(rows, invested, F.when(priced, F.col("shares") * F.col("price")).otherwise(cost) * F.col("fx_rate"), priced)


def weights(valued: DataFrame) -> DataFrame:
    """Share of each position in its user's market value, in percent."""
    total = F.sum(F.col("market_value").cast("decimal(28,6)")).over(Window.partitionBy("user_id")).cast("double")
    return valued.withColumn("weight", percent(F.col("market_value"), total))


def allocation(valued: DataFrame, by: str, missing: str = "Other") -> DataFrame:
    """Market value and weight by user and ``by``; null counts as ``missing``."""
    sums = valued.groupBy("user_id", F.coalesce(by, F.lit(missing)).alias(by)).agg(exact_sum(F.col("market_value")).alias("market_value"))
    total = F.sum(F.col("market_value").cast("decimal(28,6)")).over(Window.partitionBy("user_id")).cast("double")
    return sums.withColumn("weight", percent(F.col("market_value"), total))


def filter_by_sector(valued: DataFrame, sector: str | None) -> DataFrame:
    return valued if not sector else valued.where(F.col("sector") == sector)


def filtered_label(valued: DataFrame, sector: str | None) -> DataFrame:
    """Per user how many positions the sector filter leaves, as a label 'n of m positions'."""
    hit = F.lit(True) if not sector else F.col("sector") == sector
    counts = valued.groupBy("user_id").agg(F.count_if(hit).alias("shown"), F.count("*").alias("total"))
    return counts.withColumn("label", F.format_string("%d of %d positions", "shown", "total"))


def portfolio_snapshot(positions: DataFrame, ledger: DataFrame | None, prices: DataFrame, fx: DataFrame, as_of: Column) -> DataFrame:
    """One row per user: base totals, active positions, and how many prices are known at all."""
    totals = portfolio_totals_base(positions, ledger, prices, fx)
    known = prices.agg(F.count("*").alias("prices_available"))
    return totals.crossJoin(F.broadcast(known)).select("user_id", as_of.alias("timestamp"), F.col("invested").alias("total_invested"), F.col("market_value").alias("total_market_value"), F.col("positions").alias("position_count"), "prices_available")


def portfolio_snapshot_native(positions: DataFrame, prices: DataFrame, as_of: Column) -> DataFrame:
    """The same in native currency over all positions, closed ones included."""
    known = prices.agg(F.count("*").alias("prices_available"))
    return portfolio_totals(positions, prices).crossJoin(F.broadcast(known)).select("user_id", as_of.alias("timestamp"), F.col("invested").alias("total_invested"), F.col("market_value").alias("total_market_value"), F.col("positions").alias("position_count"), "prices_available")


def merge_snapshots(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Union by user and timestamp, existing rows first."""
    both = existing.withColumn("_rank", F.lit(0)).unionByName(incoming.withColumn("_rank", F.lit(1)))
    order = Window.partitionBy("user_id", "timestamp").orderBy("_rank", *[c for c in existing.columns if c not in ("user_id", "timestamp")])
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_rank")


def snapshot_history(snapshots: DataFrame) -> DataFrame:
    """Gain of each snapshot and the value range of its user's chart."""
    gain = F.col("total_market_value") - F.col("total_invested")
    w = Window.partitionBy("user_id")
    return snapshots.withColumn("gain", gain).withColumn("gain_pct", percent(gain, F.col("total_invested"))).withColumn("low", F.min("total_market_value").over(w) * 0.95).withColumn("high", F.max("total_market_value").over(w) * 1.05)


def movers(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Change in percent of symbols with positive prices in both (symbol, price)."""
    both = previous.select("symbol", F.col("price").alias("previous")).join(current.select("symbol", F.col("price").alias("current")), "symbol").where("previous > 0 and current > 0")
    return both.withColumn("change_pct", (F.col("current") - F.col("previous")) / F.col("previous") * 100)


def top_movers(moved: DataFrame, k: int = 3) -> DataFrame:
    """The k largest gainers and losers; ``moved`` may carry user_id."""
    keys = [c for c in ("user_id",) if c in moved.columns]
    rows = moved.where("change_pct <> 0").withColumn("direction", F.when(F.col("change_pct") > 0, "gainer").otherwise("loser"))
    order = Window.partitionBy(*keys, "direction").orderBy(F.abs("change_pct").desc(), "symbol")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def significant_movers(moved: DataFrame, least: float = 0.1, k: int = 6) -> DataFrame:
    return moved.where(F.abs("change_pct") >= least).orderBy(F.abs("change_pct").desc(), "symbol").limit(k)


def price_run_summary(run: DataFrame, sample: int = 12, errors: int = 50) -> DataFrame:
    """By run_id: priced and failed symbols, the first distinct errors and how many there are, and the first unpriced symbols."""
    ok = F.coalesce(F.col("price") > 0, F.lit(False))

    def firsts(rows: DataFrame, column: str, most: int) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("run_id").orderBy(column))
        return rows.withColumn("_n", place).where(F.col("_n") <= most).groupBy(F.col("run_id").alias("_run")).agg(F.array_sort(F.collect_list(column)).alias(f"first_{column}"))

    failed = run.where(~ok)
    wrong = failed.where("error is not null").select("run_id", "error").distinct()
    sums = run.groupBy("run_id").agg(F.count_if(ok).alias("priced"), F.count_if(~ok).alias("failed"))
    for more in (firsts(failed.where("symbol is not null").select("run_id", "symbol"), "symbol", sample), firsts(wrong, "error", errors), wrong.groupBy(F.col("run_id").alias("_run")).agg(F.count("*").alias("_errors"))):
        sums = sums.join(more, sums["run_id"].eqNullSafe(more["_run"]), "left").drop("_run")
    none = F.array().cast("array<string>")
    return sums.select("run_id", "priced", "failed", F.coalesce("first_error", none).alias("errors"), F.coalesce("_errors", F.lit(0)).alias("n_errors"), F.coalesce("first_symbol", none).alias("unpriced"))


def price_records(run: DataFrame, assets: DataFrame) -> DataFrame:
    """Live prices of known assets with the asset's currency, USD where it has none."""
    live = run.where((F.col("price") > 0) & ~F.contains(F.col("source"), F.lit(CACHED)))
    return live.join(assets.select(F.col("ticker").alias("symbol"), "currency"), "symbol").select(F.upper("symbol").alias("ticker"), "price", F.coalesce("currency", F.lit("USD")).alias("currency"), "source", "fetched_at")


def hub_stock_value(positions: DataFrame) -> DataFrame:
    return positions.groupBy("user_id").agg(exact_sum(F.col("shares") * F.col("avg_price")).alias("stock_value"))


def lot_values() -> tuple[Column, ...]:
    """Aggregates of lots: value, cost and when last valued; a missing or zero quantity counts as one bottle here."""
    qty = F.coalesce(F.nullif(F.col("qty"), F.lit(0)), F.lit(1))
    worth = lambda c: F.sum((F.coalesce(c, F.lit(0.0)) * qty).cast("decimal(28,6)"))
    return worth("estimated_value").alias("wine_value"), worth("purchase_price").alias("wine_cost"), F.max("last_valued_at").alias("last_valued_at")


def _as_double(total: Column) -> Column:
    return F.coalesce(total.cast("double"), F.lit(0.0))


def hub_wine_value(lots: DataFrame) -> DataFrame:
    """Value and cost by user."""
    return lots.groupBy("user_id").agg(*lot_values()).withColumns({c: _as_double(F.col(c)) for c in ("wine_value", "wine_cost")})


def net_worth(positions: DataFrame, lots: DataFrame | None) -> DataFrame:
    """Stocks and wine by user. Without lots the positions carry ``lot_values`` themselves; a null user's stay apart, as in a join."""
    if lots is not None:
        both = hub_stock_value(positions).join(hub_wine_value(lots), "user_id", "full_outer")
    else:
        sums = positions.groupBy("user_id").agg(exact_sum(F.col("shares") * F.col("avg_price")).alias("stock_value"), *[_as_double(F.sum(c)).alias(c) for c in ("wine_value", "wine_cost")], F.max("last_valued_at").alias("last_valued_at"))
        wine = ("wine_value", "wine_cost", "last_valued_at")
        side = F.explode(F.when(F.col("user_id").isNull(), F.array(F.lit("stock"), F.lit("wine"))).otherwise(F.array(F.lit("both"))))
        both = sums.withColumn("_side", side)
        kept = lambda c, other: F.when(F.col("_side") != other, F.col(c)).alias(c)
        both = both.select("user_id", kept("stock_value", "wine"), *[kept(c, "stock") for c in wine])
    both = both.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("stock_value", "wine_value", "wine_cost")})
    return both.withColumn("net_worth", (F.col("stock_value").cast("decimal(28,6)") + F.col("wine_value").cast("decimal(28,6)")).cast("double"))


def hub_delta(worth: DataFrame, now: Column) -> DataFrame:
    """Percent over cost where there is a cost, else how many days ago the cellar was valued, else blank."""
    pct = F.when((F.col("wine_cost") > 0) & (F.col("wine_value") > 0), (F.col("wine_value") - F.col("wine_cost")) / F.col("wine_cost") * 100)
    days = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_valued_at").cast("timestamp"))) / 86_400_000_000).cast("long")
    return worth.withColumn("delta_pct", pct).withColumn("direction", F.when(pct >= 0, "up").when(pct < 0, "down").otherwise("")).withColumn("valued_days_ago", F.when(pct.isNull(), days))
