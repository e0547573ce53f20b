"""Streaming forms of the ledger, price, snapshot and statement jobs.

Each gives what its batch form gives once every event is in; what comes too late is dropped or reported, as stated.
State lives in Spark's state store (``with_rocksdb`` sets the one that the keyed jobs need) or in tables that a micro-batch
writes under its own number, so a micro-batch that runs twice leaves the same.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cofferlake.operators.ledger import LARGEST_RATIO, NOTHING
from cofferlake.operators.statements import parse_statements
from cofferlake.sources.shared import delete_path, exists, read_text, scratch_path, stored, write_text
from cofferlake.sources.statements import numbered

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
RUNNING = "user_id long, symbol string, seq long, rejected boolean, reason string, shares double, avg_price double, realized_pnl double, dividends double, tax_withheld double, fees_paid double, needs_review boolean"
_RUNNING_COLUMNS = [c.split()[0] for c in RUNNING.split(", ")]
_AMOUNTS = ["shares", "cash", "charge", "ratio"]
_ORDER = ["user", "symbol", "at", "seq"]
_WAITING = [*_ORDER, "type", *_AMOUNTS]
_POSITION = [*_ORDER, "sh", "cost", "realized", "dividends", "tax", "fees", "review"]
TOO_LATE, _NEVER = "came after a later move was folded", -(1 << 62)
_NOTHING_HELD = (_NEVER, _NEVER, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, False)
MOVED = "ticker string, id long, price double, previous double, change_pct double"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _whole(users: pd.Series) -> pd.Series:
    """User ids, which travel as text so that a null among them makes no other one a fraction, as numbers."""
    return pd.Series([None if u is None else int(u) for u in users], index=users.index, dtype=object)


def _packed(rows: pd.DataFrame) -> bytes:
    """Rows as one compressed Arrow stream, the value of a state variable; strings are written once each."""
    table, sink = pa.Table.from_pandas(rows, preserve_index=False), pa.BufferOutputStream()
    for i, field in enumerate(table.schema):
        if pa.types.is_string(field.type):
            table = table.set_column(i, field.name, table[i].dictionary_encode())
    with pa.CompressedOutputStream(sink, "zstd") as out, pa.ipc.new_stream(out, table.schema) as stream:
        stream.write_table(table, max_chunksize=16_000)  # equal columns of a chunk lie near enough to be found equal
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    table = pa.ipc.open_stream(pa.CompressedInputStream(pa.BufferReader(data), "zstd")).read_all()
    for i, field in enumerate(table.schema):
        if pa.types.is_dictionary(field.type):
            table = table.set_column(i, field.name, table[i].cast(field.type.value_type))
    return table.to_pandas()


class _Positions(StatefulProcessor):
    """Average-cost positions of a bucket of users and symbols; the rules are those of ``positions_from_ledger``.

    Moves wait in state until the watermark has passed them and are folded then, user by user and symbol by symbol (which
    keeps the files of the output small), in order of date and seq. What a bucket holds is read and written at once, as a
    call to the state store for each user and symbol costs far more than its fold.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("positions", "rows binary")
        self.waiting = handle.getListState("waiting", "rows binary")

    def _positions(self) -> dict[tuple, tuple]:
        if not self.state.exists():
            return {}
        rows = _unpacked(self.state.get()[0])
        return {r[:2]: r[2:] for r in zip(*(rows[c].tolist() for c in _POSITION))}

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        moves, held = pd.concat(list(rows), ignore_index=True), self._positions()
        if held:
            late = [(at, seq) <= held.get((user, symbol), (_NEVER, _NEVER))[:2] for user, symbol, at, seq in zip(*(moves[c].tolist() for c in _ORDER))]
            late = pd.Series(late, dtype=bool)
            if late.any():
                lost = moves[late]
                yield pd.DataFrame({"user_id": _whole(lost["user"]), "symbol": lost["symbol"], "seq": lost["seq"], "rejected": True, "reason": TOO_LATE}).reindex(columns=_RUNNING_COLUMNS)
            moves = moves[~late]
        if len(moves):
            self.waiting.appendValue((_packed(moves[_WAITING]),))
            self.handle.registerTimer(int(moves["at"].min(skipna=False)) + 1)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if not self.waiting.exists():
            return
        until, waiting = timerValues.getCurrentWatermarkInMs(), pd.concat([_unpacked(r[0]) for r in self.waiting.get()], ignore_index=True)
        due = waiting["at"] < until
        if not due.any():
            return
        rest = waiting[~due]
        if len(rest):
            self.waiting.put([(_packed(rest),)])
            self.handle.registerTimer(int(rest["at"].min()) + 1)
        else:
            self.waiting.clear()
        held, out = self._positions(), []
        for user, symbol, at, last, kind, q, cash, charge, ratio in zip(*(c.tolist() for _, c in waiting[due].sort_values(_ORDER, kind="stable")[_WAITING].items())):
            _, _, sh, cost, realized, dividends, tax, fees, review = held.get((user, symbol), _NOTHING_HELD)
            if kind == "buy":
                sh, cost, fees = sh + q, cost + cash, fees + charge
            elif kind == "sell":
                avg = cost / sh if sh > 0 else 0.0
                realized, fees, left = realized + (cash - avg * q), fees + charge, sh - q
                review = review or left < -NOTHING
                sh, cost = (0.0, 0.0) if left < NOTHING else (left, cost - avg * q)
            elif kind in ("split", "isin_change"):
                sh = sh * ratio if 0 < ratio <= LARGEST_RATIO else sh + q
            elif kind == "dividend":
                dividends, tax = dividends + cash, tax + charge
            elif kind == "fee":
                fees = fees + cash
            held[user, symbol] = (at, last, sh, cost, realized, dividends, tax, fees, review)
            out.append((user, symbol, last, False, None, 0.0 if sh < NOTHING else sh, cost / sh if sh > NOTHING else 0.0, realized, dividends, tax, fees, review))
        self.state.update((_packed(pd.DataFrame([k + p for k, p in held.items()], columns=_POSITION)),))
        found = pd.DataFrame(out, columns=_RUNNING_COLUMNS)
        yield found.assign(user_id=_whole(found["user_id"]))

    def close(self) -> None:
        pass


def running_positions(moves: DataFrame, delay: str = "7 days", buckets: int = 1024) -> DataFrame:
    """After each move (a stream of ledger rows) its position, once no move before it can come any more.

    Moves wait until the latest date seen is ``delay`` past theirs, so those that come out of order by less are folded in
    order. One that comes still later is folded too if it follows all that its position holds; else it is ``rejected``,
    with a reason, and changes nothing. The row with the greatest date and seq of a user and symbol is the position of the
    batch form without the rejected moves. A bucket of users and symbols is in one task's memory; ``buckets`` of them share
    the state, and a checkpoint goes on with as many as it began with.
    """
    day = F.col("date").cast("date")
    moves = moves.withColumn("_time", day.cast("timestamp")).withWatermark("_time", delay)
    q, p, amount, fee, tax, ratio = (F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in ("shares", "price", "total_amount", "fee", "tax", "ratio"))
    # What a move of its type does, and nothing else, as each number is shuffled and waits in state.
    trade, none = F.col("type").isin("buy", "sell"), F.lit(0.0)
    split = F.col("type").isin("split", "isin_change")
    cash = F.when(F.col("type") == "buy", q * p + fee).when(F.col("type") == "sell", p * q - fee).when(F.col("type").isin("dividend", "fee"), amount).otherwise(none)
    charge = F.when(trade, fee).when(F.col("type") == "dividend", tax).otherwise(none)
    # A copy without the watermark's mark: Spark would drop late rows unseen where the marked column goes on.
    moves = moves.select(
        F.pmod(F.xxhash64(F.col("user_id").cast("long"), "symbol"), F.lit(buckets)).cast("int").alias("bucket"), F.col("user_id").cast("long").cast("string").alias("user"), "symbol",
        (F.unix_date(day).cast("long") * 86_400_000).alias("at"), F.col("seq").cast("long"), "type",
        F.when(trade | split, q).otherwise(none).alias("shares"), cash.alias("cash"), charge.alias("charge"), F.when(split, ratio).otherwise(none).alias("ratio"),
    )
    return moves.groupBy("bucket").transformWithStateInPandas(_Positions(), RUNNING, "append", "EventTime")


class _Movers(StatefulProcessor):
    """The last price of a ticker."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("last", "at timestamp, id long, price double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        ticks = pd.concat(list(rows), ignore_index=True).sort_values(["fetched_at", "id"], ignore_index=True)
        if self.state.exists():
            at, id_, price = self.state.get()
            ticks = ticks[(ticks["fetched_at"] > at) | ((ticks["fetched_at"] == at) & (ticks["id"] > id_))]
            ticks = pd.concat([pd.DataFrame({"ticker": [key[0]], "id": [id_], "fetched_at": [at], "price": [price]}), ticks], ignore_index=True)
        if not len(ticks):
            return
        previous = ticks["price"].shift(1)
        self.state.update((ticks["fetched_at"].iloc[-1], int(ticks["id"].iloc[-1]), float(ticks["price"].iloc[-1])))
        good = (previous > 0) & (ticks["price"] > 0)
        out = pd.DataFrame({"ticker": ticks["ticker"], "id": ticks["id"], "price": ticks["price"], "previous": previous, "change_pct": (ticks["price"] - previous) / previous * 100})
        yield out[good]

    def close(self) -> None:
        pass


def live_movers(ticks: DataFrame) -> DataFrame:
    """Change of each tick (ticker, id, fetched_at, price) over the ticker's tick before, where both are positive.

    Ticks older than the last one known are dropped.
    """
    ticks = ticks.select("ticker", "id", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "price")
    return ticks.groupBy("ticker").transformWithStateInPandas(_Movers(), MOVED, "append", "None")


#: Rows of a table of latest prices.
PRICES = "symbol string, price double, fetched_at timestamp, id long"
BUCKETS = 64


def _version(path: str, number: int) -> str:
    return f"{path}/versions/{number:09d}"


def _bucket_paths(spark: SparkSession, path: str, number: int) -> dict[int, str]:
    """The folder of each bucket in version ``number``; none, where there is no such version."""
    if number < 0 or not exists(spark, _version(path, number)):
        return {}
    return {int(k): v for k, v in json.loads(read_text(spark, _version(path, number))).items()}


def latest_prices_table(spark: SparkSession, path: str, number: int) -> DataFrame:
    """The prices as micro-batch ``number`` left them; a reader sees all of it or none."""
    found = _bucket_paths(spark, path, number)
    return spark.read.schema(PRICES).parquet(*found.values()) if found else spark.createDataFrame([], PRICES)


def latest_prices_into(path: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the latest price by symbol, in buckets of symbols below ``path``.

    A micro-batch writes only the buckets that its symbols are in, and then, in one small file, which folder holds each
    bucket from now on. One that runs twice writes the same; folders that the last two versions do not name are deleted.
    """

    def upsert(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        before = _bucket_paths(spark, path, number - 1)
        rows = batch.select(F.col("ticker").alias("symbol"), "price", F.col("fetched_at").cast("timestamp").alias("fetched_at"), "id")
        latest = lambda df: df.groupBy("symbol").agg(F.max_by(F.struct("price", "fetched_at", "id"), F.struct("fetched_at", "id")).alias("r")).select("symbol", "r.*")
        bucket = F.pmod(F.xxhash64("symbol"), F.lit(buckets)).cast("int")
        rows = stored(latest(rows), "latest-batch")
        touched = sorted(r.b for r in rows.select(bucket.alias("b")).distinct().collect())  # at most as many as there are buckets
        old = [before[b] for b in touched if b in before]
        if old:
            rows = latest(rows.unionByName(spark.read.schema(PRICES).parquet(*old)))
        data = f"{path}/data/{number:09d}"
        rows.withColumn("bucket", bucket).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(data)
        now = before | {b: f"{data}/bucket={b}" for b in touched}
        write_text(spark, _version(path, number), json.dumps(now), overwrite=True)
        for b, folder in _bucket_paths(spark, path, number - 2).items():
            if folder not in (before.get(b), now.get(b)):
                delete_path(spark, folder)

    return upsert


def without_redelivery(rows: DataFrame, time: str, keys: list[str], delay: str) -> DataFrame:
    """Each source row once, though it may be delivered again within ``delay``; equal fills with other keys all stay."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def periodic_snapshots(ticks: DataFrame, width: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """The last price by ticker in each closed window (ticker, id, fetched_at, price)."""
    w = F.window("fetched_at", width)
    return ticks.withWatermark("fetched_at", delay).groupBy(w, "ticker").agg(F.max_by("price", F.struct("fetched_at", "id")).alias("price"), F.count("*").alias("n")).select(F.col("window.start").alias("start"), "ticker", "price", "n")


def statements_into(path: str) -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: the parsed rows of statement files (``statement_stream``), a folder for each micro-batch."""

    def parse(batch: DataFrame, number: int) -> None:
        parse_statements(stored(numbered(batch), "lines")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return parse


def finished(stream: DataFrame, name: str, each: Callable[[DataFrame, int], None] | None = None, checkpoint: str | None = None, path: str | None = None) -> str | None:
    """Run a stream until its source is used up; rows go to ``each`` micro-batch's function, else to the folder returned.

    With a ``checkpoint`` and ``path`` of an earlier run it goes on where that one ended.
    """
    spark = stream.sparkSession
    writer = stream.writeStream.option("compression", "zstd").option("checkpointLocation", checkpoint or scratch_path(spark, f"{name}-checkpoint")).trigger(availableNow=True)
    if each is not None:
        query = writer.foreachBatch(each).start()
    else:
        path = path or scratch_path(spark, name)
        query = writer.format("parquet").outputMode("append").start(path)
    query.awaitTermination()
    return path
