"""Identifiers to tickers, quotes to symbols, and what is known about instruments.

Look-ups in outside services are input tables here: candidates (isin, tier, ordinal, ticker, name, exchange), quotes
(symbol, price, tier, source) and profiles (ticker, tier, sector, currency, exchange).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.functions.instruments import alternative_symbols, detect_exchange, exchange_currency, pricing_symbol
from cofferlake.functions.text import is_isin


def lookup_isin(ids: DataFrame, assets: DataFrame) -> DataFrame:
    """``ids`` (identifier) with the ticker of the first asset of that ISIN, null where none is known."""
    known = assets.where("isin is not null").groupBy(F.upper("isin").alias("_isin")).agg(F.min("ticker").alias("ticker"))
    return ids.join(known, F.upper("identifier") == F.col("_isin"), "left").drop("_isin")


def pick_best_ticker(candidates: DataFrame, positions: DataFrame, assets: DataFrame) -> DataFrame:
    """Per user_id and isin the best candidate: already held, then known, then first; ``alternatives`` has the others."""
    held = positions.select("user_id", F.col("symbol").alias("ticker"), F.lit(1).alias("held")).distinct()
    known = assets.select("ticker", F.lit(1).alias("known")).distinct()
    rows = candidates.join(held, ["user_id", "ticker"], "left").join(known, "ticker", "left")
    order = F.struct(-F.coalesce("held", F.lit(0)), -F.coalesce("known", F.lit(0)), F.col("ordinal"), F.col("ticker"))
    best = rows.groupBy("user_id", "isin").agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.col("ticker").alias("ticker")))).alias("c"))
    return best.select("user_id", "isin", F.element_at("c", 1)["ticker"].alias("ticker"), F.transform(F.slice("c", F.lit(2), F.size("c")), lambda x: x["ticker"]).alias("alternatives"))


def resolve_identifiers(ids: DataFrame, assets: DataFrame, candidates: DataFrame, positions: DataFrame) -> DataFrame:
    """user_id, identifier, ticker, tier, confident, alternatives.

    Tier 0 is what assets know; else the first tier with candidates counts. Only ISINs use tiers 1 and 2; tier 3
    answers that are ISINs themselves are refused, others carry their exchange as a suffix.
    """
    first = lookup_isin(ids, assets)
    known = first.where("ticker is not null").select("user_id", "identifier", "ticker", F.lit(0).alias("tier"), F.lit(True).alias("confident"), F.array().cast("array<string>").alias("alternatives"))
    open_ = first.where("ticker is null").select("user_id", "identifier")
    rows = open_.join(candidates, F.upper("identifier") == candidates["isin"]).where(is_isin(F.col("identifier")) | (F.col("tier") == 3)).where((F.col("tier") < 3) | ~is_isin(F.col("ticker")))
    rows = rows.withColumn("ticker", F.when((F.col("tier") == 3) & F.col("exchange").isNotNull() & ~F.col("ticker").contains("."), F.concat_ws(".", "ticker", "exchange")).otherwise(F.col("ticker")))
    least = rows.groupBy("user_id", "identifier").agg(F.min("tier").alias("tier"))
    rows = rows.join(least, ["user_id", "identifier", "tier"]).select("user_id", F.col("identifier").alias("isin"), "tier", "ordinal", "ticker")
    best = pick_best_ticker(rows, positions, assets).join(least.withColumnRenamed("identifier", "isin"), ["user_id", "isin"])
    return known.unionByName(best.select("user_id", F.col("isin").alias("identifier"), "ticker", "tier", (F.size("alternatives") == 0).alias("confident"), "alternatives"))


def learn_isin_mapping(assets: DataFrame, resolved: DataFrame, source: str) -> DataFrame:
    """Assets after noting the ISIN of resolved tickers (identifier, ticker)."""
    from cofferlake.operators.tables import upsert_assets

    new = resolved.where(F.col("ticker").isNotNull() & is_isin(F.col("identifier"))).groupBy(F.upper("ticker").alias("ticker")).agg(F.min(F.upper("identifier")).alias("isin")).withColumn("source", F.lit(source))
    return upsert_assets(assets, new)


def apply_resolution(items: DataFrame, resolved: DataFrame) -> DataFrame:
    """Items with ``symbol``: the resolved ticker, or the identifier itself if it is no ISIN; null is unresolved."""
    r = resolved.select("user_id", "identifier", F.col("ticker").alias("_t"))
    out = items.join(r, ["user_id", "identifier"], "left")
    return out.withColumn("symbol", F.coalesce(F.upper("_t"), F.when(~is_isin(F.col("identifier")), F.upper("identifier")))).drop("_t")


def collect_unresolved(items: DataFrame) -> DataFrame:
    """Distinct ISINs without a symbol, with the first name and broker."""
    rows = items.where(F.col("symbol").isNull() & is_isin(F.col("identifier")))
    return rows.groupBy("user_id", "identifier").agg(F.min_by("name", "line_no").alias("name"), F.min_by("broker", "line_no").alias("broker"), F.count("*").alias("n"))


def apply_unresolved_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions (user_id, identifier, action map/untracked/skip, ticker) on unresolved items; undecided ones drop out."""
    out = items.join(decisions.select("user_id", "identifier", "action", F.col("ticker").alias("_t")), ["user_id", "identifier"], "left")
    symbol = F.coalesce("symbol", F.when(F.col("action") == "map", F.upper("_t")).when(F.col("action") == "untracked", F.upper("identifier")))
    return out.withColumn("untracked", F.coalesce(F.col("symbol").isNull() & (F.col("action") == "untracked"), F.lit(False))).withColumn("symbol", symbol).where("symbol is not null").drop("_t", "action")


def first_priced_alternative(symbols: DataFrame, quotes: DataFrame) -> DataFrame:
    """(symbol, tried, price): the first other spelling of a symbol (symbol, name) that has a price."""
    tried = symbols.select("symbol", F.posexplode(alternative_symbols(F.col("symbol"), F.col("name"))).alias("ordinal", "tried"))
    priced = tried.join(quotes.where("price > 0").select(F.upper("symbol").alias("tried"), "price"), "tried")
    return priced.groupBy("symbol").agg(F.min_by(F.struct("tried", "price"), "ordinal").alias("b")).select("symbol", "b.tried", "b.price")


def match_quotes(symbols: DataFrame, quotes: DataFrame) -> DataFrame:
    """Prices of symbols by feed spelling, else by the part before the dot; one quote serves all spellings."""
    asked = symbols.select("symbol").distinct().withColumn("key", pricing_symbol(F.col("symbol")))
    q = quotes.where("price > 0").select(F.upper("symbol").alias("key"), "price").groupBy("key").agg(F.min("price").alias("price"))
    exact = asked.join(q, "key").select("symbol", "price", F.lit("exact").alias("how"))
    base = lambda c: F.regexp_replace(c, r"\.[^.]*$", "")
    q_base = q.groupBy(base(F.col("key")).alias("base")).agg(F.min_by("price", "key").alias("price"))
    rest = asked.join(exact.select("symbol"), "symbol", "left_anti").withColumn("base", base(F.col("key"))).join(q_base, "base")
    return exact.unionByName(rest.select("symbol", "price", F.lit("base").alias("how")))


def tiered_price(symbols: DataFrame, quotes: DataFrame) -> DataFrame:
    """symbol, price, source, tier of the first tier with a price; symbols without one carry an error."""
    best = quotes.where("price > 0").groupBy("symbol").agg(F.min_by(F.struct("price", "source", "tier"), F.struct("tier", "source", "price")).alias("b"))
    out = symbols.select("symbol").distinct().join(best, "symbol", "left")
    return out.select("symbol", "b.price", "b.source", "b.tier", F.when(F.col("b").isNull(), "no tier has a price").alias("error"))


def accept_suggestions(suggestions: DataFrame, quotes: DataFrame) -> DataFrame:
    """symbol, pricing_ticker, price: a suggested ticker only if it has a quote, else the price given with it."""
    q = quotes.where("price > 0").select(F.upper("symbol").alias("_s"), F.col("price").alias("_p"))
    out = suggestions.join(q, F.upper("suggested") == F.col("_s"), "left")
    return out.select("symbol", F.when(F.col("_p").isNotNull(), F.upper("suggested")).alias("pricing_ticker"), F.coalesce("_p", F.when(F.col("grounded_price") > 0, F.col("grounded_price"))).alias("price")).where("price is not null")


def query_symbol(symbols: DataFrame, assets: DataFrame) -> DataFrame:
    a = assets.select(F.col("ticker").alias("symbol"), "pricing_ticker")
    return symbols.join(a, "symbol", "left").withColumn("query", F.coalesce("pricing_ticker", "symbol")).drop("pricing_ticker")


def with_sector(df: DataFrame, assets: DataFrame, static: DataFrame, symbol: str = "symbol") -> DataFrame:
    """``sector`` of each symbol: what the asset says, else the static table (symbol, sector), else 'Other'."""
    a = assets.select(F.upper("ticker").alias("_k"), F.nullif(F.col("sector"), F.lit("")).alias("_a"))
    b = static.select(F.upper("symbol").alias("_k"), F.nullif(F.col("sector"), F.lit("")).alias("_b"))
    out = df.withColumn("_k", F.upper(symbol)).join(a, "_k", "left").join(b, "_k", "left")
    return out.withColumn("sector", F.coalesce("_a", "_b", F.lit("Other"))).drop("_k", "_a", "_b")


def asset_record(positions: DataFrame, assets: DataFrame, static: DataFrame) -> DataFrame:
    """Reference rows of held symbols: upper-case ticker, exchange, currency, sector, type; of several positions the first by name and type."""
    first = F.min(F.struct(F.col("name").isNull().alias("unnamed"), "name", F.coalesce("asset_type", F.lit("Stock")).alias("asset_type"))).alias("p")
    rows = positions.groupBy(F.upper("symbol").alias("ticker")).agg(first).select("ticker", "p.name", "p.asset_type")
    exchange = detect_exchange(F.col("ticker"))
    return with_sector(rows, assets, static, "ticker").withColumn("stock_exchange", exchange).withColumn("currency", exchange_currency(exchange))


def asset_currency(symbols: DataFrame, assets: DataFrame) -> DataFrame:
    known = assets.select(F.col("ticker").alias("symbol"), F.nullif(F.col("currency"), F.lit("")).alias("_c"))
    return symbols.join(known, "symbol", "left").withColumn("currency", F.coalesce("_c", exchange_currency(detect_exchange(F.col("symbol"))))).drop("_c")


def enrich_unknown_assets(assets: DataFrame, positions: DataFrame, profiles: DataFrame) -> DataFrame:
    """Held assets whose sector is empty or 'Other' take sector, currency and exchange from the first profile tier."""
    best = profiles.groupBy("ticker").agg(F.min_by(F.struct("sector", "currency", "exchange"), "tier").alias("p"))
    held = positions.select(F.upper("symbol").alias("ticker"), F.lit(True).alias("held")).distinct()
    out = assets.join(held, "ticker", "left").join(best, "ticker", "left")
    wants = F.coalesce("held", F.lit(False)) & (F.coalesce("sector", F.lit("")).isin("", "Other")) & F.col("p").isNotNull()
    take = lambda c, new: F.when(wants, F.coalesce(F.nullif(F.col(f"p.{new}"), F.lit("")), F.col(c))).otherwise(F.col(c))
    return out.withColumns({"sector": take("sector", "sector"), "currency": take("currency", "currency"), "stock_exchange": take("stock_exchange", "exchange")}).drop("held", "p")


def enrich_position_type(positions: DataFrame, assets: DataFrame) -> DataFrame:
    """Positions of no type or 'Stock' take their asset's type if that is another one."""
    a = assets.where("asset_type <> 'Stock'").groupBy(F.col("ticker").alias("symbol")).agg(F.min("asset_type").alias("_t"))
    out = positions.join(a, "symbol", "left")
    return out.withColumn("asset_type", F.when(F.coalesce("asset_type", F.lit("Stock")) == "Stock", F.coalesce("_t", "asset_type")).otherwise(F.col("asset_type"))).drop("_t")


def search_assets(assets: DataFrame, query: str, most: int = 8) -> DataFrame:
    """The first assets whose name or ticker holds the query; exact tickers, then ticker beginnings, come first."""
    q = query.strip().lower()
    ticker, name = F.lower("ticker"), F.lower("name")
    hits = assets.where(ticker.contains(q) | name.contains(q))
    order: Column = F.when(ticker == q, 0).when(ticker.startswith(q), 1).otherwise(2)
    return hits.withColumn("place", order).orderBy("place", "ticker").limit(most)


def name_postings(assets: DataFrame, most: int = 3) -> DataFrame:
    """(gram, ticker): the distinct strings of 1 to ``most`` characters in each asset's ticker and name, in lower case."""
    grams = lambda c, n: F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substr(c, i, F.lit(n)))
    # Names are brought together by ticker, not their strings, of which a name has a hundred.
    named = assets.where("ticker is not null").groupBy("ticker").agg(F.collect_set(F.lower("name")).alias("names"))
    texts = F.filter(F.concat(F.array(F.lower("ticker")), F.col("names")), lambda t: t != "")
    found = F.transform(texts, lambda t: F.flatten(F.array(*[grams(t, n) for n in range(1, most + 1)])))
    return named.select("ticker", F.explode(F.array_distinct(F.flatten(found))).alias("gram"))


def search_many(assets: DataFrame, postings: DataFrame, queries: DataFrame, most: int = 8, longest: int = 3) -> DataFrame:
    """(query, rank, ticker): for each query the first assets whose name or ticker holds it, as ``search_assets`` orders them.

    A query is looked up by the rarest of its strings of ``longest`` characters (itself, if it is shorter), and what that
    finds is compared whole, so that no query meets all assets. Blank queries find nothing.
    """
    asked = queries.select("query", F.lower(F.trim("query")).alias("_q")).where("_q <> ''").distinct()
    size = F.least(F.length("_q"), F.lit(longest))
    parts = asked.withColumn("gram", F.explode(F.transform(F.sequence(F.lit(1), F.length("_q") - size + 1), lambda i: F.substr("_q", i, size))))
    counts = postings.groupBy("gram").agg(F.count("*").alias("_n"))
    # A part that no asset holds settles a query: its count is missing and comes first.
    rarest = parts.join(counts, "gram", "left").groupBy("query", "_q").agg(F.min(F.struct(F.coalesce("_n", F.lit(0)).alias("_n"), "gram")).alias("r")).where("r._n > 0").select("query", "_q", F.col("r.gram").alias("gram"))
    found = rarest.join(postings, "gram").select("query", "_q", "ticker")
    ticker = F.lower("ticker")
    place = F.when(ticker == F.col("_q"), 0).when(F.startswith(ticker, F.col("_q")), 1).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("query").orderBy(place, "ticker"))
    # What a short query finds holds it, so only the first of these are compared.
    short = F.length("_q") <= longest
    found = found.where(short).withColumn("rank", rank).where(F.col("rank") <= most).drop("rank").unionByName(found.where(~short))
    hits = found.join(assets.select("ticker", "name"), "ticker").where(F.contains(ticker, F.col("_q")) | F.coalesce(F.contains(F.lower("name"), F.col("_q")), F.lit(False)))
    ranked = hits.select("query", "ticker", rank.alias("rank"))
    return ranked.where(F.col("rank") <= most).select("query", "rank", "ticker")


def priceable(positions: DataFrame) -> DataFrame:
    """Distinct symbols worth asking a price for: tracked ones that are no bare ISIN."""
    return positions.where(~F.coalesce("untracked", F.lit(False)) & ~is_isin(F.col("symbol"))).select("symbol").distinct()


