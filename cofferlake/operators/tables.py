"""Scans, sinks and integrity of the stored tables."""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cofferlake.operators.ledger import rebuild_positions
from cofferlake.sources.shared import delete_path, exists, move_path, read_text, stored, write_text

#: Allowed types.
TRANSACTION_TYPES = ("buy", "sell", "dividend", "fee", "split", "isin_change")
MOVEMENT_TYPES = ("buy", "sell", "dividend", "split", "transfer", "adjustment", "valuation_update")
ASSET_KINDS = ("wine", "stock")
BUCKETS = 64


def for_user(df: DataFrame, user) -> DataFrame:
    """Rows of one user, or of all users of a principals table (user_id)."""
    return df.join(user.select("user_id").distinct(), "user_id", "left_semi") if isinstance(user, DataFrame) else df.where(F.col("user_id") == user)


def scan_positions(positions: DataFrame, user) -> DataFrame:
    return for_user(positions, user).select("user_id", "symbol", "name", "platform", F.col("shares").cast("double"), F.col("avg_price").cast("double"), F.coalesce("asset_type", F.lit("Stock")).alias("asset_type")).orderBy("symbol")


def scan_transactions(ledger: DataFrame, user) -> DataFrame:
    """One row by user and symbol with its moves in order; cost basis and realised gain only for sells."""
    rows = for_user(ledger, user)
    sell = F.col("type") == "sell"
    move = F.struct("date", "seq", "type", "shares", "price", "total_amount", F.when(sell, F.col("cost_basis")).alias("cost_basis"), F.when(sell, F.col("realized_gain_loss")).alias("realized_gain_loss"))
    return rows.groupBy("user_id", "symbol").agg(F.array_sort(F.collect_list(move)).alias("moves"))


def scan_assets(assets: DataFrame, order: str = "updated_at") -> DataFrame:
    """Assets by upper-case ticker; of several rows the last one."""
    w = Window.partitionBy("ticker").orderBy(F.desc(order))
    return assets.where("ticker is not null").withColumn("ticker", F.upper("ticker")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def price_history(history: DataFrame, assets: DataFrame, limit: int = 30) -> DataFrame:
    """The newest ``limit`` prices of known tickers, oldest first."""
    known = history.join(assets.select("ticker").distinct(), "ticker", "left_semi")
    w = Window.partitionBy("ticker").orderBy(F.desc("fetched_at"), F.desc("id"))
    return known.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n").orderBy("ticker", "fetched_at", "id")


def scan_snapshots(snapshots: DataFrame, user) -> DataFrame:
    return for_user(snapshots, user).orderBy("timestamp")


def scan_cellar(lots: DataFrame, wines: DataFrame, user) -> DataFrame:
    """A user's lots with their catalogue row, also where that is missing; oldest first."""
    rows = for_user(lots, user).join(wines, "wine_id", "left")
    size = F.coalesce("bottle_size", F.lit("0.75L")) if "bottle_size" in rows.columns else F.lit("0.75L")
    return rows.withColumn("bottle_size", size).orderBy("created_at", "id")


def with_bucket(df: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    return df.withColumn("user_bucket", F.pmod(F.xxhash64(F.col("user_id").cast("string")), F.lit(buckets)).cast("int"))


def write_table(df: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """A per-user table, one folder for each bucket of users."""
    with_bucket(df, buckets).repartition("user_bucket").write.mode("overwrite").partitionBy("user_bucket").parquet(path)


def replace_user_rows(spark: SparkSession, path: str, rows: DataFrame, users: DataFrame, buckets: int = BUCKETS) -> None:
    """All rows of ``users`` become ``rows``; only the buckets of those users are written anew. Twice gives the same.

    The new buckets are written to a folder of their own. Then a marker beside the table names that folder and its buckets;
    from there on the replacement is decided, and whoever finds the marker first moves what is not moved yet. A run that
    breaks off before that leaves the table as it was. One writer at a time; readers in between may see some buckets new.
    """
    finish_replacement(spark, path)
    table = spark.read.parquet(path)
    touched = stored(with_bucket(users.select("user_id").distinct(), buckets), "touched-users")
    numbers = sorted(r.user_bucket for r in touched.select("user_bucket").distinct().collect())  # at most as many as there are buckets
    kept = table.where(F.col("user_bucket").isin(numbers)).join(touched.select("user_id"), "user_id", "left_anti")
    # Users whose rows are new may live in buckets that ``users`` does not name.
    added = with_bucket(rows, buckets)
    others = [r.user_bucket for r in added.where(~F.col("user_bucket").isin(numbers)).select("user_bucket").distinct().collect()]
    # What is kept lies by buckets already, so only the new rows are shuffled.
    new = kept.unionByName(table.where(F.col("user_bucket").isin(others))).unionByName(added.repartition("user_bucket"), allowMissingColumns=True)
    staged = f"{path.rstrip('/')}-staged-{uuid.uuid4().hex}"
    new.write.partitionBy("user_bucket").parquet(staged)
    filled = [b for b in sorted({*numbers, *others}) if exists(spark, f"{staged}/user_bucket={b}")]
    write_text(spark, _marker(path), json.dumps({"staged": staged, "filled": filled, "emptied": [b for b in numbers if b not in filled]}))
    finish_replacement(spark, path)


def _marker(path: str) -> str:
    return f"{path.rstrip('/')}-replacing"


def finish_replacement(spark: SparkSession, path: str) -> None:
    """Finish a replacement of rows that was decided; without one nothing happens."""
    if not exists(spark, _marker(path)):
        return
    decided = json.loads(read_text(spark, _marker(path)))
    for b in decided["filled"]:
        new = f"{decided['staged']}/user_bucket={b}"
        if exists(spark, new):  # else it has been moved
            delete_path(spark, f"{path.rstrip('/')}/user_bucket={b}")
            move_path(spark, new, f"{path.rstrip('/')}/user_bucket={b}")
    for b in decided["emptied"]:
        delete_path(spark, f"{path.rstrip('/')}/user_bucket={b}")
    delete_path(spark, _marker(path))
    delete_path(spark, decided["staged"])
    spark.catalog.refreshByPath(path)


def append_rows(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def upsert_assets(assets: DataFrame, rows: DataFrame, order: list[str] | None = None) -> DataFrame:
    """On equal tickers (upper case) the new row wins; rows without a ticker drop out.

    isin, source and pricing_ticker change only where a new row has them. Of several new rows of a ticker the last by
    the columns ``order`` counts, or the greatest where no order is given.
    """
    sticky = [c for c in ("isin", "source", "pricing_ticker") if c in rows.columns]
    plain = [c for c in rows.columns if c not in ("ticker", *sticky)]
    last = F.struct(*(order or [*plain, *sticky, "ticker"]))
    new = rows.where(F.coalesce("ticker", F.lit("")) != "").groupBy(F.upper("ticker").alias("_ticker")).agg(
        F.max_by(F.struct(F.lit(True).alias("new"), *plain), last).alias("_row"), *[F.max_by(c, F.when(F.coalesce(c, F.lit("")) != "", last)).alias(f"_{c}") for c in sticky]
    )
    out = assets.withColumn("ticker", F.upper("ticker")).join(new, F.col("ticker") == F.col("_ticker"), "full_outer")

    def column(c: str) -> Column:
        if c == "ticker":
            return F.coalesce("_ticker", c).alias(c)
        if c in sticky:
            return F.coalesce(f"_{c}", c).alias(c)
        return F.when(F.col("_row.new"), F.col(f"_row.{c}")).otherwise(F.col(c)).alias(c) if c in plain else F.col(c)

    return out.select(*[column(c) for c in assets.columns])


def price_history_rows(run: DataFrame, assets: DataFrame, now: Column) -> DataFrame:
    """Rows to append to the price history: known tickers only, upper case, USD by default."""
    known = run.withColumn("ticker", F.upper("ticker")).join(assets.select(F.upper("ticker").alias("ticker")).distinct(), "ticker", "left_semi")
    return known.where(~F.contains(F.col("source"), F.lit("(cached)"))).select("ticker", "price", F.coalesce("currency", F.lit("USD")).alias("currency"), "source", now.alias("fetched_at"))


def wine_history(wines: DataFrame, valuations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(history rows, wines with the latest known drink window)."""
    history = valuations.select("wine_id", "user_id", "price", "drink_window", "fetched_at")
    latest = valuations.where("drink_window is not null").groupBy("wine_id").agg(F.max_by("drink_window", F.struct("fetched_at", "drink_window")).alias("_w"))
    return history, wines.join(latest, "wine_id", "left").withColumn("drink_window", F.coalesce("_w", "drink_window")).drop("_w")


def movements(events: DataFrame) -> DataFrame:
    """Movement rows of cellar changes (user_id, wine_id, movement_type, qty, price, moved_at)."""
    return events.select("user_id", F.lit("wine").alias("asset_type"), "wine_id", "movement_type", "qty", "price", (F.col("qty") * F.col("price")).alias("total_value"), "moved_at")


def delete_rows(df: DataFrame, tombstones: DataFrame, on: list[str]) -> DataFrame:
    return df.join(tombstones.select(*on).distinct(), on, "left_anti")


def delete_position(symbols: DataFrame, positions: DataFrame, ledger: DataFrame, prices: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Positions, transactions and prices without the named (user_id, symbol); prices go if no one holds the symbol."""
    held = delete_rows(positions, symbols, ["user_id", "symbol"])
    gone = symbols.select("symbol").distinct().join(held.select("symbol").distinct(), "symbol", "left_anti")
    return held, delete_rows(ledger, symbols, ["user_id", "symbol"]), prices.join(gone, "symbol", "left_anti")


def delete_ledger_rows(ledger: DataFrame, tombstones: DataFrame) -> DataFrame:
    """The ledger without one row for each tombstone (user_id, symbol, timestamp, date, type).

    A tombstone takes the first row of its timestamp; those without a timestamp, or beyond the rows that have it, take
    the first of the rows then left with their date and type; those that fit nothing do nothing.

    Rows and tombstones lie in one table, dealt by user and symbol once and counted there; nulls meet nothing.
    """
    who, exact, loose = ["user_id", "symbol"], ["user_id", "symbol", "timestamp"], ["user_id", "symbol", "date", "type"]
    kinds = {c: ledger.schema[c].dataType for c in (*exact, "date", "type")}
    wanted = tombstones.withColumn("timestamp", F.nullif("timestamp", F.lit(""))).select(*[F.col(c).cast(kind).alias(c) for c, kind in kinds.items()])
    rows = ledger.withColumn("_row", F.lit(True)).unionByName(wanted.withColumn("_row", F.lit(False)), allowMissingColumns=True)
    known = lambda key: reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key])
    wants = lambda key: F.count_if(~F.col("_row") & known(key)).over(Window.partitionBy(*key))
    # Tombstones come before the rows of their timestamp; one order serves the place and the counts.
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy(*who).orderBy("timestamp", "_row", "seq", "date", "type")))
    among = Window.partitionBy(*exact)
    rows = rows.withColumns({"_n": F.col("_place") - F.min("_place").over(among) + 1, "_want": wants(exact), "_all": F.count("*").over(among)})
    row, n, want = F.col("_row"), F.col("_n"), F.col("_want")
    rows = rows.where(F.when(row, n > 2 * want).otherwise((want == 0) | (n > F.col("_all") - want)))
    rows = rows.withColumns({"_n": F.row_number().over(Window.partitionBy(*loose).orderBy("_row", "seq")), "_want": wants(loose)})
    return rows.where(row & (n > 2 * want)).select(*ledger.columns)


def delete_and_rebuild(ledger: DataFrame, tombstones: DataFrame, positions: DataFrame, assets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger without the deleted rows, positions derived anew from it)."""
    left = delete_ledger_rows(ledger, tombstones)
    return left, rebuild_positions(left, positions, assets)


EXPORT = ("name", "winery", "vintage", "region", "appellation", "varietal", "country", "type", "bottle_size", "qty", "purchase_price", "purchase_date", "estimated_value", "drink_window", "storage", "notes", "last_valued_at")


def export_cellar_csv(cellar: DataFrame, path: str) -> None:
    """Quoted CSV with a header and CRLF line ends; null is empty."""
    columns = [(F.col(c) if c in cellar.columns else F.lit(None)).cast("string").alias(c) for c in EXPORT]
    cellar.select(*columns).write.mode("overwrite").options(header=True, lineSep="\r\n", escape='"', nullValue="", emptyValue="").csv(path)


def check_rows(df: DataFrame, table: str) -> DataFrame:
    """``df`` with ``reasons``: the rules of ``table`` that a row breaks; empty is good."""
    missing = lambda *cs: {f"{c} is missing": F.col(c).isNull() for c in cs}
    kind = lambda c, allowed: {f"{c} is not allowed": ~F.coalesce(F.col(c).isin(*allowed), F.lit(False))}
    rules = {
        "transactions": missing("user_id", "symbol", "date", "shares", "price", "total_amount") | kind("type", TRANSACTION_TYPES),
        "movements": missing("user_id", "qty") | kind("movement_type", MOVEMENT_TYPES) | kind("asset_type", ASSET_KINDS),
        "positions": missing("user_id", "symbol", "shares", "avg_price"),
    }[table]
    return df.withColumn("reasons", F.array_compact(F.array(*[F.when(bad, why) for why, bad in rules.items()])))


def check_wine_updates(old: DataFrame, new: DataFrame, identity: tuple[str, ...] = ("name", "winery", "vintage", "region")) -> DataFrame:
    """Updates of catalogue rows with ``reasons`` where they change what identifies a wine."""
    o = old.select("wine_id", *[F.col(c).alias(f"_{c}") for c in identity])
    rows = new.join(o, "wine_id")
    changed = F.array_compact(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"_{c}")), f"{c} must not change") for c in identity]))
    return rows.withColumn("reasons", changed).drop(*[f"_{c}" for c in identity])


def safe_date(date: Column, timestamp: Column, as_of: Column) -> Column:
    """The date if it begins like one, else the timestamp's, else ``as_of``."""
    day = lambda c: F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}"), c.substr(1, 10).try_cast("date"))
    return F.coalesce(day(date), day(timestamp), as_of)


def ledger_row_defaults(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: F.coalesce(c, F.lit(0.0)) for c in ("shares", "price", "total_amount")})


def good_rows(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") == 0).drop("reasons")


def rejects(checked: DataFrame) -> DataFrame:
    return checked.where(F.size("reasons") > 0)
