"""Cellar of purchase lots over a shared catalogue: totals, facets, matching, merging, valuation, snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.functions.money import exact_sum, percent
from cofferlake.functions.text import critic_score, no_accents, normalize_name  # noqa: F401

#: Fixed values.
BOTTLE_SIZES = ("0.187L", "0.375L", "0.5L", "0.75L", "1L", "1.5L", "3L", "6L", "9L")
DEFAULT_SIZE = "0.75L"
WINE_TYPES = ("Red", "White", "Rosé", "Sparkling", "Dessert", "Fortified", "Orange", "Other")
FACETS = ("type", "country", "region", "winery", "varietal", "vintage", "status")
STALE_DAYS = 60


def bottle_gain() -> dict[str, Column]:
    """invested, estimated (cost where not valued), gain and gain_pct of a lot."""
    qty, price = F.coalesce("qty", F.lit(0)), F.coalesce("purchase_price", F.lit(0.0))
    cost, value = qty * price, qty * F.coalesce("estimated_value", price)
    return {"invested": cost, "estimated": value, "gain": value - cost, "gain_pct": percent(value - cost, cost)}


def lot_gains(lots: DataFrame) -> DataFrame:
    return lots.withColumns(bottle_gain())


def cellar_totals(lots: DataFrame, by: tuple[str, ...] = ("user_id",)) -> DataFrame:
    g = bottle_gain()
    return lots.groupBy(*by).agg(exact_sum(g["invested"]).alias("invested"), exact_sum(g["estimated"]).alias("estimated"), F.sum(F.coalesce("qty", F.lit(0))).cast("long").alias("bottles"), F.count("estimated_value").alias("valued"))


def group_by_dimension(lots: DataFrame, dimensions: tuple[str, ...]) -> DataFrame:
    """Bottles, value and share by every dimension at once: dimension, value, bottles, estimated, share.

    Rows are dealt by user and dimension and sorted there, which can go over disk; sums are read off the sorted rows, so that
    no task keeps a table of its groups, of which there are nearly as many as rows.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(d).alias("dimension"), F.coalesce(F.col(d).cast("string"), F.lit("Unknown")).alias("value")) for d in dimensions]))
    rows = lot_gains(lots).select("user_id", F.coalesce("qty", F.lit(0)).alias("qty"), "estimated", pairs.alias("d")).select("user_id", "qty", "estimated", "d.*").repartition("user_id", "dimension")
    group = Window.partitionBy("user_id", "dimension", "value").orderBy("value")
    whole = group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    estimated = F.coalesce(F.sum(F.col("estimated").cast("decimal(28,6)")).over(whole).cast("double"), F.lit(0.0))
    sums = rows.select("user_id", "dimension", "value", F.sum("qty").over(whole).cast("long").alias("bottles"), estimated.alias("estimated"), F.row_number().over(group).alias("_n"))
    total = F.sum(F.col("estimated").cast("decimal(28,6)")).over(Window.partitionBy("user_id", "dimension")).cast("double")
    return sums.where("_n = 1").drop("_n").withColumn("share", percent(F.col("estimated"), total))


def validate_lots(lots: DataFrame, year: int) -> DataFrame:
    """``errors``: what is wrong with each lot; empty if nothing."""
    checks = {
        "name is missing": ~F.coalesce(F.length(F.trim("name")) > 0, F.lit(False)),
        "quantity is not a positive whole number": ~F.coalesce((F.col("qty") > 0) & (F.col("qty") == F.floor("qty")), F.lit(False)),
        "price is negative": F.coalesce(F.col("purchase_price") < 0, F.lit(False)),
        "vintage is out of range": F.coalesce(~F.col("vintage").between(1800, year + 1), F.lit(False)),
        "unknown bottle size": F.coalesce(~F.col("bottle_size").isin(*BOTTLE_SIZES), F.lit(False)),
    }
    return lots.withColumn("errors", F.array_compact(F.array(*[F.when(bad, text) for text, bad in checks.items()])))


_SCAN = ("name", "winery", "region", "appellation", "varietal", "country", "alcohol", "type", "bottle_size", "drink_window")


def lot_from_scan(scans: DataFrame, column: str = "json") -> DataFrame:
    """Label scans (JSON text) as lots; empty fields are null, the vintage is a whole number."""
    parsed = F.from_json(column, ", ".join(f"{c} string" for c in (*_SCAN, "vintage")))
    fields = [F.nullif(F.trim(parsed[c]), F.lit("")).alias(c) for c in _SCAN]
    return scans.select("*", *fields, F.nullif(F.regexp_extract(parsed["vintage"], r"\d{4}", 0), F.lit("")).cast("int").alias("vintage")).drop(column)


def drink_status(window: Column, year: int) -> Column:
    """not-ready, ready (to the fifth year after the start), at-peak, past-peak, or unknown."""
    part = lambda k: F.nullif(F.regexp_extract(window, r"(\d{4})(?:\s*[-–]\s*(\d{4}))?", k), F.lit("")).cast("int")
    start, end = part(1), F.coalesce(part(2), part(1))
    return F.when(start.isNull(), "unknown").when(F.lit(year) < start, "not-ready").when(F.lit(year) > end, "past-peak").when(F.lit(year) <= start + 5, "ready").otherwise("at-peak")


def search_lots(lots: DataFrame, term: str, columns: tuple[str, ...] = ("name", "winery", "region", "appellation", "varietal", "country", "type", "vintage")) -> DataFrame:
    """Lots that hold the term in any text field or the vintage; a blank term keeps all."""
    needle = term.strip().lower()
    if not needle:
        return lots
    return lots.where(reduce(lambda a, b: a | b, [F.coalesce(F.lower(F.col(c).cast("string")).contains(needle), F.lit(False)) for c in columns if c in lots.columns]))


def _fits(selections: dict[str, list], d: str) -> Column:
    chosen = selections.get(d)
    return F.coalesce(F.col(d).cast("string"), F.lit("Unknown")).isin([str(x) for x in chosen]) if chosen else F.lit(True)


def facet_filter(lots: DataFrame, selections: dict[str, list]) -> DataFrame:
    """All dimensions must fit; within one any chosen value does; null is 'Unknown'."""
    return lots.where(reduce(lambda a, b: a & b, [_fits(selections, d) for d in selections], F.lit(True)))


def facet_counts(lots: DataFrame, selections: dict[str, list], dimensions: tuple[str, ...]) -> DataFrame:
    """Lots by dimension and value under the filters of all other dimensions, in one pass.

    A lot that fits everywhere counts in each dimension, one that fails one filter in that dimension alone; all others are
    dropped before anything is spread.
    """
    chosen = [d for d in dimensions if selections.get(d)]
    fails = {d: F.when(_fits(selections, d), 0).otherwise(1) for d in chosen}
    failed = reduce(lambda a, b: a + b, fails.values(), F.lit(0))
    near = lots.where(failed <= 1).withColumn("_failed", failed)
    rows = [F.when((F.col("_failed") == fails.get(d, F.lit(0))) & F.col(d).isNotNull(), F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("value"))) for d in dimensions]
    stacked = near.select("user_id", F.explode(F.array_compact(F.array(*rows))).alias("r"))
    return stacked.groupBy("user_id", "r.dimension", "r.value").agg(F.count("*").alias("n"))


def sort_lots(lots: DataFrame, mode: str = "newest") -> DataFrame:
    g = bottle_gain()
    order = {"name": [F.lower("name")], "vintage": [F.desc_nulls_last("vintage")], "value": [F.desc_nulls_last(F.coalesce("estimated_value", "purchase_price"))], "gain": [g["gain_pct"].desc()], "newest": [F.desc("created_at")]}
    return lots.orderBy(*order[mode], "id")


def match_scans(scans: DataFrame, cellar: DataFrame) -> DataFrame:
    """Scans and lots of one user with equal normalised names; vintage and winery count only where both are known."""
    known = lambda c: F.nullif(normalize_name(F.col(c)), F.lit(""))
    keyed = lambda df: df.withColumns({"key": known("name"), "maker": known("winery")})
    a, b = keyed(scans).alias("a"), keyed(cellar).alias("b")
    agree = lambda c: F.col(f"a.{c}").isNull() | F.col(f"b.{c}").isNull() | (F.col(f"a.{c}").cast("string") == F.col(f"b.{c}").cast("string"))
    on = (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.key") == F.col("b.key")) & agree("vintage") & agree("maker")
    return a.join(b, on).select(F.col("a.user_id").alias("user_id"), F.col("a.scan_id").alias("scan_id"), F.col("b.id").alias("id"))


#: Users with more names than this are searched by pieces of names instead of name by name.
MANY_NAMES = 2_000


def _allowed(n: Column) -> Column:
    """The edit distance that names of ``n`` characters may have."""
    return F.greatest(F.lit(2), F.floor(n * 0.15).cast("int"))


#: Characters that a name has or has not; the others do not count when names are told apart at a glance.
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 '-.&,"


def _letters(x: Column) -> Column:
    """A set of bits that says which of ``LETTERS`` a text holds."""
    return reduce(lambda bits, b: bits.bitwiseOR(b), [F.when(F.contains(x, F.lit(c)), F.lit(1 << i)).otherwise(F.lit(0)).cast("long") for i, c in enumerate(LETTERS)])


def _shortened(x: Column, most: int = 2) -> Column:
    """What is left of a name of up to four characters without up to ``most`` of them."""
    left = lambda mask: F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: F.when(F.getbit(mask, i - 1) == 0, F.substr(x, i, F.lit(1))).otherwise("")), "")
    masks = F.filter(F.sequence(F.lit(0), F.pow(F.lit(2), F.length(x)).cast("int") - 1), lambda mask: F.bit_count(mask) <= most)
    return F.array_distinct(F.transform(masks, left))


def pairs_by_pieces(a: DataFrame, b: DataFrame) -> DataFrame:
    """Distinct (user_id, x, y) of names x of ``a`` and y of ``b`` that can be near, found by parts that they share.

    Of k + 1 pieces of x (k the distance allowed) at least one stands unchanged in a near y, shifted by at most k. Names of
    fewer than k + 1 characters have no such pieces: what is left of them and of a near y without up to k characters meets.
    """
    a = a.select("user_id", "x").distinct().withColumns({"n": F.length("x"), "k": _allowed(F.length("x"))})
    long = a.where("n > k").withColumn("size", F.floor(F.col("n") / (F.col("k") + 1)).cast("int"))
    pieces = long.select("*", F.explode(F.sequence(F.lit(0), F.col("k"))).alias("i")).select("user_id", "x", "n", "k", "size", (F.col("i") * F.col("size")).alias("at"))
    pieces = pieces.withColumn("piece", F.substr("x", F.col("at") + 1, F.col("size"))).withColumn("spot", F.explode(F.sequence(F.greatest(F.col("at") - F.col("k"), F.lit(0)), F.col("at") + F.col("k"))))
    grams = b.join(long.select("user_id", "size").distinct(), "user_id").where("length(y) >= size")
    grams = grams.withColumn("spot", F.explode(F.sequence(F.lit(0), F.length("y") - F.col("size")))).withColumn("piece", F.substr("y", F.col("spot") + 1, F.col("size")))
    met = pieces.join(grams, ["user_id", "size", "spot", "piece"]).where(F.abs(F.length("y") - F.col("n")) <= F.col("k")).select("user_id", "x", "y")
    short_a = a.where("n <= k").select("user_id", "x", F.explode(_shortened(F.col("x"))).alias("left"))
    short_b = b.where("length(y) <= 4").select("user_id", "y", F.explode(_shortened(F.col("y"))).alias("left"))
    return met.unionByName(short_a.join(short_b, ["user_id", "left"]).select("user_id", "x", "y")).distinct()


def fuzzy_match_scans(scans: DataFrame, cellar: DataFrame, many: int = MANY_NAMES) -> DataFrame:
    """Near names: edit distance over 0 and at most max(2, 15 % of the shorter name), nearest first.

    Names of a user are compared one by one where the user's lots have at most ``many``, so a scan costs no more than that;
    the others are found by ``pairs_by_pieces``.
    """
    a = scans.select("user_id", "scan_id", F.inline(F.array(F.struct(normalize_name(F.col("name")).alias("x"))))).where("x <> ''").withColumn("_x", _letters(F.col("x")))
    named = cellar.where("name <> ''").select("user_id", "name").distinct()
    b = named.select("user_id", F.inline(F.array(F.struct(normalize_name(F.col("name")).alias("y"))))).withColumn("_y", _letters(F.col("y")))
    busy = named.groupBy("user_id").agg(F.count("*").alias("_n")).where(F.col("_n") > many).select("user_id")
    # Names are told apart for this only if some user has as many lots.
    any_busy = not cellar.groupBy("user_id").agg(F.count("*").alias("_n")).where(F.col("_n") > many).isEmpty() and not busy.isEmpty()
    short = F.least(F.length("x"), F.length("y"))
    # An edit takes one letter away and brings one in at most. Each pair is looked at, so lengths come with the names.
    allowed = _allowed(F.least("_xn", "_yn"))
    similar = [F.bit_count(F.col(p).bitwiseAND(F.bitwise_not(F.col(q)))) <= allowed for p, q in (("_x", "_y"), ("_y", "_x"))]
    a, b = a.withColumn("_xn", F.length("x")), b.withColumn("_yn", F.length("y"))
    met = a.join(b.join(busy, "user_id", "left_anti") if any_busy else b, "user_id").where((F.abs(F.col("_xn") - F.col("_yn")) <= allowed) & similar[0] & similar[1] & (F.col("x") != F.col("y")))
    pairs = met.select("user_id", "scan_id", "x", "y")
    if any_busy:
        searched = a.join(busy, "user_id", "left_semi")
        found = pairs_by_pieces(searched, b.join(busy, "user_id", "left_semi").select("user_id", "y").distinct()).where((F.abs(F.length("x") - F.length("y")) <= _allowed(short)) & (F.col("x") != F.col("y")))
        pairs = pairs.unionByName(searched.join(found, ["user_id", "x"]).select("user_id", "scan_id", "x", "y"))
    near = pairs.withColumn("distance", F.levenshtein("x", "y")).where(F.col("distance") <= _allowed(short)).distinct()
    order = Window.partitionBy("user_id", "scan_id").orderBy("distance", "y")
    return near.withColumn("rank", F.row_number().over(order)).select("user_id", "scan_id", F.col("y").alias("name"), "distance", "rank")


def drink(lots: DataFrame, events: DataFrame) -> DataFrame:
    """Lots after drinking ``events`` (id, n): new qty, and ``removed`` where nothing is left."""
    drunk = events.groupBy("id").agg(F.sum("n").alias("n"))
    out = lots.join(drunk, "id", "left").withColumn("qty", F.col("qty") - F.coalesce("n", F.lit(0))).drop("n")
    return out.withColumn("removed", F.col("qty") <= 0)


def cellar_snapshot(lots: DataFrame, as_of: Column) -> DataFrame:
    return cellar_totals(lots).select("user_id", as_of.alias("timestamp"), F.col("invested").alias("total_invested"), F.col("estimated").alias("total_estimated_value"), F.col("bottles").alias("bottle_count"))


def cellar_history(snapshots: DataFrame, chart: int = 20, log: int = 10) -> DataFrame:
    """The last snapshots by user with the bar height (percent of the largest, 5 at least) and gain."""
    w = Window.partitionBy("user_id").orderBy(F.desc("timestamp"))
    rows = snapshots.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= chart)
    top = F.max("total_estimated_value").over(Window.partitionBy("user_id"))
    gain = F.col("total_estimated_value") - F.col("total_invested")
    return rows.withColumn("height", F.greatest(F.lit(5.0), percent(F.col("total_estimated_value"), top))).withColumn("in_log", F.col("recency") <= log).withColumn("gain_pct", percent(gain, F.col("total_invested")))


def existing_holdings(wanted: DataFrame, cellar: DataFrame) -> DataFrame:
    """Lots of the same wine, case aside and null equal to null; names that miss are tried normalised.

    Names that are equal but for case are equal when normalised too, so one join finds both. It carries a name's own
    spelling only where normalising changed it.
    """

    def keyed(df: DataFrame, label: str, ident: str) -> DataFrame:
        rows = df.select("user_id", F.col(ident).alias(label), F.lower(F.trim("name")).alias("n"), F.lower(F.trim("winery")).alias("w"), F.col("vintage").alias("v"))
        rows = rows.withColumn("m", normalize_name(F.col("n")))
        return rows.withColumn("n", F.nullif("n", "m"))

    a, b = keyed(wanted, "want_id", "want_id").alias("a"), keyed(cellar, "id", "id").alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("user_id", "m")] + [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("w", "v")]
    # Made by inline, ``same`` stays behind the join: both readings below have one plan up to here, whose shuffles are reused.
    same = F.coalesce("a.n", "a.m") == F.coalesce("b.n", "b.m")
    met = a.join(b, reduce(lambda x, y: x & y, on)).select(F.inline(F.array(F.struct("want_id", "id", same.alias("same")))))
    exact, near = met.where("same").drop("same"), met.where("not same").drop("same")
    missed = near.join(exact.select("want_id").distinct(), "want_id", "left_anti")
    return exact.withColumn("how", F.lit("exact")).unionByName(missed.withColumn("how", F.lit("normalised")))


_CATALOGUE = ("name", "winery", "vintage", "region", "appellation", "varietal", "country", "alcohol", "type", "drink_window")


def resolve_catalogue(lots: DataFrame, wines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lots with wine_id, new catalogue rows): found by name, winery and vintage, else made with an id of that key.

    A new row takes what the first of its lots, by spelling, says of the wine.
    """
    key = lambda: [F.lower(F.trim("name")), F.lower(F.trim("winery")), F.col("vintage")]
    new_id = F.sha2(F.concat_ws("\u0001", *[F.coalesce(k.cast("string"), F.lit("\u0002")) for k in key()]), 256)
    known = wines.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(key())]).agg(F.min("wine_id").cast("string").alias("found"))
    rows = lots.withColumns({f"c{i}": k for i, k in enumerate(key())})
    rows = rows.join(known, reduce(lambda a, b: a & b, [F.col(f"c{i}").eqNullSafe(F.col(f"k{i}")) for i in range(3)]), "left")
    rows = rows.withColumn("wine_id", F.coalesce("found", new_id))
    said = F.struct(*[c for c in _CATALOGUE if c in lots.columns])
    fresh = rows.where("found is null").groupBy("wine_id").agg(F.min(said).alias("w")).select("wine_id", "w.*")
    return rows.drop("c0", "c1", "c2", "k0", "k1", "k2", "found"), fresh


def catalogue_updates(lots: DataFrame, wines: DataFrame) -> DataFrame:
    """Rows of ``wines`` that the latest of their lots (wine_id, created_at, id) change: drink_window and type, nothing else.

    A lot without a value erases none.
    """
    latest = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("created_at", "id"))).alias(f"new_{c}")
    said = lots.groupBy(F.col("wine_id").cast("string").alias("_id")).agg(latest("drink_window"), latest("type"))
    rows = wines.join(said, wines["wine_id"].cast("string") == F.col("_id"))
    changed = reduce(lambda a, b: a | b, [F.col(f"new_{c}").isNotNull() & ~F.col(f"new_{c}").eqNullSafe(F.col(c)) for c in ("drink_window", "type")])
    values = {c: F.coalesce(f"new_{c}", c) for c in ("drink_window", "type")}
    return rows.where(changed).withColumns(values).select(*wines.columns)


def merge_duplicate_lots(lots: DataFrame) -> DataFrame:
    """One lot by user and wine: the oldest, all bottles, the price weighted by priced bottles, the latest valuation."""
    price = F.col("purchase_price").isNotNull()
    weighed = exact_sum(F.when(price, F.col("purchase_price") * F.col("qty")).otherwise(0.0))
    priced = F.sum(F.when(price, F.col("qty")).otherwise(0))
    valued = F.col("last_valued_at").isNotNull()
    merged = lots.groupBy("user_id", "wine_id").agg(
        F.min(F.struct("created_at", "id", "estimated_value")).alias("oldest"), F.max(F.when(valued, F.struct("last_valued_at", "id", "estimated_value"))).alias("latest"),
        F.sum("qty").cast("long").alias("qty"), F.when(priced > 0, weighed / priced).alias("purchase_price"), F.min("created_at").alias("created_at"), F.count("*").alias("merged"),
    )
    value = F.coalesce("latest.estimated_value", "oldest.estimated_value").alias("estimated_value")
    return merged.select("user_id", "wine_id", "oldest.id", "qty", "purchase_price", "latest.last_valued_at", "created_at", "merged", value)


def apply_valuations(lots: DataFrame, results: DataFrame) -> DataFrame:
    """Lots with the results (id, value, drink_window, error, valued_at) of their own id; windows stick once known."""
    good = results.where("error is null and value is not null").groupBy("id").agg(F.max_by(F.struct("value", "drink_window", "valued_at"), "valued_at").alias("r"))
    out = lots.join(good, "id", "left")
    return out.withColumn("estimated_value", F.coalesce("r.value", "estimated_value")).withColumn("drink_window", F.coalesce("r.drink_window", "drink_window")).withColumn("last_valued_at", F.coalesce("r.valued_at", "last_valued_at")).drop("r")


def valuation_report(lots: DataFrame, results: DataFrame) -> DataFrame:
    """Results that were not applied: errors and unknown ids."""
    known = lots.select("id", F.lit(True).alias("known")).distinct()
    return results.join(known, "id", "left").where("error is not null or known is null").select("id", F.when(F.col("known").isNull(), "unknown lot").otherwise(F.col("error")).alias("reason"))


def unvalued_lots(lots: DataFrame, force: bool = False) -> DataFrame:
    return lots if force else lots.where("estimated_value is null")


def overlay_cached_valuations(lots: DataFrame, cache: DataFrame) -> DataFrame:
    """Details from the cache (id, value_low, value_high, note) replace the lot's own where the cache has the lot."""
    c = cache.select("id", F.struct("value_low", "value_high", "note").alias("c"))
    out = lots.join(c, "id", "left")
    return out.withColumns({k: F.when(F.col("c").isNotNull(), F.col(f"c.{k}")).otherwise(F.col(k)) for k in ("value_low", "value_high", "note")}).drop("c")


def stale_valuation(now: Column, days: int = STALE_DAYS) -> Column:
    age = F.floor((F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("last_valued_at").cast("timestamp"))) / 86_400_000_000)
    return F.coalesce(age > days, F.lit(False))


def wine_value_history(history: DataFrame, limit: int = 30) -> DataFrame:
    """The newest ``limit`` values by wine; ``latest`` marks the last one."""
    w = Window.partitionBy("wine_id").orderBy(F.desc("fetched_at"), F.desc("id"))
    return history.withColumn("recency", F.row_number().over(w)).where(F.col("recency") <= limit).withColumn("latest", F.col("recency") == 1)


def classification_batches(lots: DataFrame, size: int = 15) -> DataFrame:
    """Unclassified lots with the batch and the index in it that results refer to, by user."""
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("id")) - 1
    return lots.withColumn("_n", n).withColumn("batch", F.floor(F.col("_n") / size).cast("long")).withColumn("idx", (F.col("_n") % size).cast("long")).drop("_n")


def apply_classification(batches: DataFrame, results: DataFrame) -> DataFrame:
    """New types by (user_id, batch, idx): known types only, and only where they change something."""
    ok = results.where(F.col("type").isin(*WINE_TYPES)).select("user_id", "batch", "idx", F.col("type").alias("new_type"))
    return batches.join(ok, ["user_id", "batch", "idx"]).where(~F.col("new_type").eqNullSafe(F.col("type")))


def migrate_lots(bottles: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(catalogue, lots, price history, movements) from single-table bottles; later rows fill what the first left null."""
    key = F.sha2(F.concat_ws("\u0001", F.lower("name"), F.coalesce("winery", F.lit("\u0002")), F.coalesce(F.col("vintage").cast("string"), F.lit("\u0002"))), 256)
    rows = bottles.withColumn("wine_id", key)
    age = F.struct("created_at", "id")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), age)).alias(c)
    catalogue = rows.groupBy("wine_id").agg(*[first(c) for c in ("name", "winery", "vintage", "region", "type", "drink_window")])
    lots = rows.select("id", "user_id", "wine_id", "qty", "purchase_price", "estimated_value", "last_valued_at", "created_at")
    history = rows.where("estimated_value is not null").select("wine_id", "user_id", F.col("estimated_value").alias("price"), F.coalesce("last_valued_at", "created_at").alias("fetched_at"))
    moves = rows.select("user_id", F.lit("wine").alias("asset_type"), "wine_id", F.lit("buy").alias("movement_type"), "qty", F.col("purchase_price").alias("price"), (F.col("qty") * F.col("purchase_price")).alias("total_value"), F.concat(F.lit("(backup_id:"), F.col("id").cast("string"), F.lit(")")).alias("notes"), F.col("created_at").alias("moved_at"))
    return catalogue, lots, history, moves


def recover_lots(bottles: DataFrame, movements: DataFrame) -> DataFrame:
    """Bottles that no movement's notes name yet, so that a second run adds nothing."""
    done = movements.select(F.regexp_extract("notes", r"backup_id:(\S+?)\)", 1).alias("_id")).where("_id <> ''").distinct()
    return bottles.join(done, F.col("id").cast("string") == F.col("_id"), "left_anti")


def cellar_summary(lots: DataFrame, line: Column, budget: int = 10_000) -> DataFrame:
    """Lines in order of purchase until the running length is over the budget, one text by user."""
    w = Window.partitionBy("user_id").orderBy("created_at", "id").rowsBetween(Window.unboundedPreceding, 0)
    kept = lots.withColumn("line", line).withColumn("upto", F.sum(F.length("line") + 1).over(w)).where(F.col("upto") <= budget)
    return kept.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "id", "line"))).alias("l")).select("user_id", F.concat_ws("\n", F.col("l.line")).alias("summary"))
