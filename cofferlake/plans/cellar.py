"""Queries of the cellar operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from cofferlake.functions.text import critic_score, normalize_name
from cofferlake.operators import cellar as C
from cofferlake.plans.portfolio import AS_OF, s
from cofferlake.plans.registry import query
from cofferlake.plans.views import Views, oracle

YEAR = 2024
_JOINED = "cellar AS (SELECT l.*, w.name, w.winery, w.vintage, w.region, w.type, w.drink_window FROM v_lots l LEFT JOIN v_wines w USING (wine_id))"
_GAIN = """gains AS (SELECT *, coalesce(qty, 0) * coalesce(purchase_price, 0) AS invested, coalesce(qty, 0) * coalesce(estimated_value, purchase_price, 0) AS estimated FROM cellar)"""
_PCT = "CASE WHEN invested > 0 THEN (estimated - invested) / invested * 100 ELSE 0 END"
_TOTALS = f"SELECT user_id, {s('invested')} AS invested, {s('estimated')} AS estimated, CAST(sum(qty) AS BIGINT) AS bottles, count(estimated_value) AS valued FROM gains GROUP BY user_id"


def cellar(v: Views):
    return v.lots.join(v.wines, "wine_id", "left")


@query("f1_cellar_totals", oracle(_TOTALS, _JOINED, _GAIN))
def f1(v):
    return C.cellar_totals(cellar(v))


@query("f2_bottle_gain", oracle(f"SELECT id, invested, estimated, estimated - invested AS gain, {_PCT} AS gain_pct FROM gains", _JOINED, _GAIN))
def f2(v):
    return C.lot_gains(cellar(v)).select("id", "invested", "estimated", "gain", "gain_pct")


@query(
    "f3_group_by_dimension",
    oracle(
        f"""SELECT *, CASE WHEN t > 0 THEN estimated / t * 100 ELSE 0 END AS share FROM (SELECT *, CAST(sum(CAST(estimated AS DECIMAL(28,6))) OVER (PARTITION BY user_id, dimension) AS DOUBLE) AS t FROM (
SELECT user_id, dimension, value, CAST(sum(qty) AS BIGINT) AS bottles, {s('estimated')} AS estimated FROM (SELECT user_id, qty, estimated, 'region' AS dimension, coalesce(region, 'Unknown') AS value FROM gains UNION ALL SELECT user_id, qty, estimated, 'type', coalesce(type, 'Unknown') FROM gains) GROUP BY ALL))""".replace("SELECT *, CASE", "SELECT user_id, dimension, value, bottles, estimated, CASE", 1),
        _JOINED, _GAIN,
    ),
)
def f3(v):
    return C.group_by_dimension(cellar(v), ("region", "type"))


def _entered(v: Views):
    n = F.col("l_partkey")
    rows = v.table("lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate", "l_extendedprice")
    return rows.select(
        F.when(n % 13 != 0, F.concat(F.lit("Wine "), n.cast("string"))).alias("name"), (F.col("l_quantity") - 3).alias("qty"), (F.col("l_extendedprice") - 5000).alias("purchase_price"),
        (1790 + n % 260).cast("int").alias("vintage"), F.when(n % 5 == 0, "0.7L").otherwise("0.75L").alias("bottle_size"),
    )


@query("f4_validate_lots", oracle("""SELECT CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN l_quantity - 3 > 0 THEN 0 ELSE 1 END + CASE WHEN l_extendedprice - 5000 < 0 THEN 1 ELSE 0 END
  + CASE WHEN 1790 + l_partkey % 260 BETWEEN 1800 AND 2025 THEN 0 ELSE 1 END + CASE WHEN l_partkey % 5 = 0 THEN 1 ELSE 0 END AS n_errors, count(*) AS n FROM lineitem GROUP BY ALL"""))
def f4(v):
    return C.validate_lots(_entered(v), YEAR).groupBy(F.size("errors").cast("long").alias("n_errors")).agg(F.count("*").alias("n"))


@query("f5_lot_from_scan", oracle("SELECT wine_id, name, winery, region, CAST(vintage AS INTEGER) AS vintage FROM v_wines"))
def f5(v):
    scan = F.to_json(F.struct("name", F.concat(F.lit(" "), "winery").alias("winery"), F.coalesce("region", F.lit("")).alias("region"), F.concat(F.lit("c. "), F.col("vintage").cast("string")).alias("vintage")))
    return C.lot_from_scan(v.wines.select("wine_id", scan.alias("json"))).select("wine_id", "name", "winery", "region", "vintage")


@query(
    "f6_drink_status",
    oracle(f"""SELECT wine_id, CASE WHEN a IS NULL THEN 'unknown' WHEN {YEAR} < a THEN 'not-ready' WHEN {YEAR} > coalesce(b, a) THEN 'past-peak' WHEN {YEAR} <= a + 5 THEN 'ready' ELSE 'at-peak' END AS status
FROM (SELECT wine_id, TRY_CAST(substr(drink_window, 1, 4) AS INT) AS a, TRY_CAST(substr(drink_window, 6, 4) AS INT) AS b FROM v_wines)"""),
)
def f6(v):
    return v.wines.select("wine_id", C.drink_status(F.col("drink_window"), YEAR).alias("status"))


@query("f7_search_lots", oracle("SELECT id FROM cellar WHERE contains(lower(name), 'gion 3') OR contains(lower(winery), 'gion 3') OR contains(lower(region), 'gion 3') OR contains(lower(type), 'gion 3') OR contains(CAST(vintage AS VARCHAR), 'gion 3')", _JOINED))
def f7(v):
    return C.search_lots(cellar(v), " GION 3 ").select("id")


_PICK = {"region": ["Region 1", "Unknown"], "vintage": [1990, 2000, 2010, 2020]}


@query("f8_facet_filter", oracle("SELECT id FROM cellar WHERE coalesce(region, 'Unknown') IN ('Region 1', 'Unknown') AND vintage IN (1990, 2000, 2010, 2020)", _JOINED))
def f8(v):
    return C.facet_filter(cellar(v), _PICK).select("id")


@query(
    "f9_facet_counts",
    oracle(
        """SELECT user_id, 'region' AS dimension, region AS value, count(*) AS n FROM cellar WHERE vintage IN (1990, 2000, 2010, 2020) AND region IS NOT NULL GROUP BY ALL
UNION ALL SELECT user_id, 'vintage', CAST(vintage AS VARCHAR), count(*) FROM cellar WHERE coalesce(region, 'Unknown') IN ('Region 1', 'Unknown') AND vintage IS NOT NULL GROUP BY ALL
UNION ALL SELECT user_id, 'type', type, count(*) FROM cellar WHERE vintage IN (1990, 2000, 2010, 2020) AND coalesce(region, 'Unknown') IN ('Region 1', 'Unknown') AND type IS NOT NULL GROUP BY ALL""",
        _JOINED,
    ),
)
def f9(v):
    return C.facet_counts(cellar(v), _PICK, ("region", "vintage", "type"))


@query("f10_sort_lots", oracle("SELECT id, row_number() OVER (PARTITION BY user_id ORDER BY coalesce(estimated_value, purchase_price) DESC NULLS LAST, id) AS place FROM cellar", _JOINED))
def f10(v):
    from pyspark.sql import Window

    value = F.coalesce("estimated_value", "purchase_price")
    return C.sort_lots(cellar(v), "value").select("id", F.row_number().over(Window.partitionBy("user_id").orderBy(value.desc_nulls_last(), "id")).alias("place"))


@query("f11_normalize_name", oracle("SELECT doc_id, lower(trim(regexp_replace(regexp_replace(strip_accents(text), '[’‘`´]', '\'\'', 'g'), '\\s+', ' ', 'g'))) AS name FROM documents"))
def f11(v):
    return v.table("documents").select("doc_id", normalize_name(F.col("text")).alias("name"))


def _scans(v: Views, edit: bool):
    name = F.concat(F.substring("name", 1, 2), F.lit("q"), F.expr("substring(name, 4)")) if edit else F.upper("name")
    picked = cellar(v).select("user_id", "name", "winery", "vintage", "wine_id").distinct()
    return picked.select("user_id", F.concat_ws("-", "user_id", "wine_id").alias("scan_id"), name.alias("name"), F.when(F.col("wine_id") % 2 == 0, F.col("vintage")).alias("vintage"), F.when(F.col("wine_id") % 3 == 0, F.col("winery")).alias("winery"))


_SCANS = "scans AS (SELECT DISTINCT user_id, user_id || '-' || wine_id AS scan_id, {n} AS name, CASE WHEN wine_id % 2 = 0 THEN vintage END AS vintage, CASE WHEN wine_id % 3 = 0 THEN winery END AS winery FROM cellar)"


@query("f12_match_scans", oracle("SELECT a.user_id, a.scan_id, b.id FROM scans a JOIN cellar b ON a.user_id = b.user_id AND lower(a.name) = lower(b.name) AND (a.vintage IS NULL OR b.vintage IS NULL OR a.vintage = b.vintage) AND (a.winery IS NULL OR b.winery IS NULL OR a.winery = b.winery)", _JOINED, _SCANS.format(n="upper(name)")))
def f12(v):
    return C.match_scans(_scans(v, False), cellar(v))


@query(
    "f13_fuzzy_match_scans",
    oracle(
        """SELECT user_id, scan_id, name, distance, row_number() OVER (PARTITION BY user_id, scan_id ORDER BY distance, name) AS rank FROM (
SELECT DISTINCT a.user_id, scan_id, lower(b.name) AS name, levenshtein(lower(a.name), lower(b.name)) AS distance, least(length(a.name), length(b.name)) AS n FROM scans a JOIN cellar b ON a.user_id = b.user_id)
WHERE distance > 0 AND distance <= greatest(2, floor(n * 0.15))""",
        _JOINED, _SCANS.format(n="substr(name, 1, 2) || 'q' || substr(name, 4)"),
    ),
)
def f13(v):
    return C.fuzzy_match_scans(_scans(v, True), cellar(v))


@query("f14_drink", oracle("SELECT id, qty - CASE WHEN wine_id % 4 = 0 THEN 20 ELSE 0 END AS qty, qty - CASE WHEN wine_id % 4 = 0 THEN 20 ELSE 0 END <= 0 AS removed FROM v_lots"))
def f14(v):
    events = v.lots.where("wine_id % 4 = 0").select("id", F.explode(F.array(F.lit(15), F.lit(5))).alias("n"))
    return C.drink(v.lots, events).select("id", F.col("qty").cast("long").alias("qty"), "removed")


@query("f15_cellar_snapshot", oracle(f"SELECT user_id, TIMESTAMP '{AS_OF}' AS timestamp, invested AS total_invested, estimated AS total_estimated_value, bottles AS bottle_count FROM ({_TOTALS})", _JOINED, _GAIN))
def f15(v):
    return C.cellar_snapshot(cellar(v), F.lit(AS_OF).cast("timestamp_ntz"))


_HISTORY = f"monthly AS (SELECT user_id, date_trunc('month', created_at) AS timestamp, {s('invested')} AS total_invested, {s('estimated')} AS total_estimated_value FROM gains GROUP BY ALL)"


@query(
    "f16_cellar_history",
    oracle(
        """SELECT user_id, CAST(recency AS INTEGER) AS recency, total_estimated_value, greatest(5, CASE WHEN t > 0 THEN total_estimated_value / t * 100 ELSE 0 END) AS height, recency <= 10 AS in_log, CASE WHEN total_invested > 0 THEN (total_estimated_value - total_invested) / total_invested * 100 ELSE 0 END AS gain_pct
FROM (SELECT *, max(total_estimated_value) OVER (PARTITION BY user_id) AS t FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC) AS recency FROM monthly) WHERE recency <= 20)""",
        _JOINED, _GAIN, _HISTORY,
    ),
)
def f16(v):
    month = F.date_trunc("month", F.col("created_at").cast("timestamp")).alias("timestamp")
    snaps = C.lot_gains(cellar(v)).groupBy("user_id", month).agg(C.exact_sum(F.col("invested")).alias("total_invested"), C.exact_sum(F.col("estimated")).alias("total_estimated_value"))
    return C.cellar_history(snaps).drop("timestamp", "total_invested")


@query("f17_existing_holdings", oracle("SELECT DISTINCT a.scan_id AS want_id, b.id, 'exact' AS how FROM scans a JOIN cellar b ON a.user_id = b.user_id AND lower(a.name) = lower(b.name) AND a.winery IS NOT DISTINCT FROM b.winery AND a.vintage IS NOT DISTINCT FROM b.vintage", _JOINED, _SCANS.format(n="upper(name)")))
def f17(v):
    return C.existing_holdings(_scans(v, False).withColumnRenamed("scan_id", "want_id"), cellar(v))


@query("f18_resolve_catalogue", oracle("""SELECT id, coalesce(CAST((SELECT min(w.wine_id) FROM v_wines w WHERE w.wine_id % 2 = 0 AND w.name = c.name AND w.winery = c.winery AND w.vintage = c.vintage) AS VARCHAR), 'new') AS wine_id FROM cellar c""", _JOINED))
def f18(v):
    lots, _ = C.resolve_catalogue(cellar(v).drop("wine_id"), v.wines.where("wine_id % 2 = 0"))
    return lots.select("id", F.when(F.length("wine_id") == 64, "new").otherwise(F.col("wine_id")).alias("wine_id"))


@query(
    "f18_catalogue_updates",
    oracle("""SELECT w.wine_id, w.name, coalesce(d, w.drink_window) AS drink_window, coalesce(t, w.type) AS type FROM v_wines w JOIN (SELECT wine_id, arg_max(d, (created_at, id)) FILTER (d IS NOT NULL) AS d, arg_max(t, (created_at, id)) FILTER (t IS NOT NULL) AS t
FROM (SELECT *, CASE WHEN qty % 3 = 0 THEN 'until ' || qty END AS d, CASE WHEN qty % 2 = 0 THEN 'Red' END AS t FROM v_lots) GROUP BY wine_id) l USING (wine_id) WHERE d <> coalesce(w.drink_window, '') OR t <> w.type"""),
)
def f18_updates(v):
    said = {"drink_window": F.when(F.col("qty") % 3 == 0, F.concat(F.lit("until "), "qty")), "type": F.when(F.col("qty") % 2 == 0, "Red")}
    return C.catalogue_updates(v.lots.withColumns(said), v.wines).select("wine_id", "name", "drink_window", "type")


@query(
    "f19_merge_duplicate_lots",
    oracle(f"""SELECT user_id, wine_id, arg_min(id, (created_at, id)) AS id, CAST(sum(qty) AS BIGINT) AS qty, CASE WHEN sum(CASE WHEN purchase_price IS NOT NULL THEN qty ELSE 0 END) > 0 THEN {s('CASE WHEN purchase_price IS NOT NULL THEN purchase_price * qty ELSE 0 END')} / sum(CASE WHEN purchase_price IS NOT NULL THEN qty ELSE 0 END) END AS purchase_price,
  coalesce(max(estimated_value) FILTER (last_valued_at IS NOT NULL), NULL) AS estimated_value, count(*) AS merged FROM v_lots GROUP BY user_id, wine_id"""),
)
def f19(v):
    return C.merge_duplicate_lots(v.lots).select("user_id", "wine_id", "id", "qty", "purchase_price", "estimated_value", "merged")


def _results(v: Views):
    row = v.lots.where("wine_id % 3 = 0")
    ok = F.col("wine_id") % 2 == 0
    return row.select("id", F.when(ok, F.col("qty") * 2.0).alias("value"), F.when(F.col("wine_id") % 4 == 0, "2030-2040").alias("drink_window"), F.when(~ok, "no answer").alias("error"), F.lit(AS_OF).cast("timestamp_ntz").alias("valued_at")).unionByName(
        row.where("wine_id % 5 = 0").select(F.concat(F.lit("x"), "id").alias("id"), F.lit(1.0).alias("value"), F.lit(None).cast("string").alias("drink_window"), F.lit(None).cast("string").alias("error"), F.lit(AS_OF).cast("timestamp_ntz").alias("valued_at"))
    )


@query("f20_apply_valuations", oracle("SELECT id, CASE WHEN wine_id % 6 = 0 THEN qty * 2.0::DOUBLE ELSE estimated_value END AS estimated_value, CASE WHEN wine_id % 12 = 0 THEN '2030-2040' ELSE drink_window END AS drink_window FROM cellar", _JOINED))
def f20(v):
    return C.apply_valuations(cellar(v), _results(v)).select("id", "estimated_value", "drink_window")


@query("f20_valuation_report", oracle("SELECT id, 'no answer' AS reason FROM v_lots WHERE wine_id % 3 = 0 AND wine_id % 2 = 1 UNION ALL SELECT 'x' || id, 'unknown lot' FROM v_lots WHERE wine_id % 15 = 0"))
def f20b(v):
    return C.valuation_report(v.lots, _results(v))


@query("f21_unvalued_lots", oracle("SELECT id FROM v_lots WHERE estimated_value IS NULL"))
def f21(v):
    return C.unvalued_lots(v.lots).select("id")


@query("f22_overlay_cached_valuations", oracle("SELECT id, CASE WHEN wine_id % 4 = 0 THEN qty * 1.5::DOUBLE ELSE 1.0 END AS value_low, CASE WHEN wine_id % 4 = 0 THEN 'cached' ELSE 'own' END AS note FROM v_lots"))
def f22(v):
    own = v.lots.withColumns({"value_low": F.lit(1.0), "value_high": F.lit(2.0), "note": F.lit("own")})
    cache = v.lots.where("wine_id % 4 = 0").select("id", (F.col("qty") * 1.5).alias("value_low"), F.lit(None).cast("double").alias("value_high"), F.lit("cached").alias("note"))
    return C.overlay_cached_valuations(own, cache).select("id", "value_low", "note")


@query("f23_stale_valuation", oracle("SELECT id, coalesce(floor((epoch_us(TIMESTAMP '1998-08-01 00:00:00') - epoch_us(last_valued_at)) / 86400000000) > 60, false) AS stale FROM v_lots"))
def f23(v):
    return v.lots.select("id", C.stale_valuation(F.lit("1998-08-01 00:00:00")).alias("stale"))


@query("f24_wine_value_history", oracle("SELECT wine_id, id, CAST(recency AS INTEGER) AS recency, recency = 1 AS latest FROM (SELECT *, row_number() OVER (PARTITION BY wine_id ORDER BY last_valued_at DESC, id DESC) AS recency FROM v_lots WHERE estimated_value IS NOT NULL) WHERE recency <= 30"))
def f24(v):
    history = v.lots.where("estimated_value is not null").select("wine_id", "id", F.col("last_valued_at").alias("fetched_at"))
    return C.wine_value_history(history).select("wine_id", "id", "recency", "latest")


@query("f25_apply_classification", oracle("SELECT id, CASE idx % 3 WHEN 0 THEN 'Red' ELSE 'White' END AS new_type FROM (SELECT *, (row_number() OVER (PARTITION BY user_id ORDER BY id) - 1) % 15 AS idx FROM cellar) WHERE idx % 3 < 2", _JOINED))
def f25(v):
    batches = C.classification_batches(cellar(v))
    results = batches.select("user_id", "batch", "idx", F.when(F.col("idx") % 3 == 0, "Red").when(F.col("idx") % 3 == 1, "White").otherwise("Purple").alias("type"))
    return C.apply_classification(batches, results).select("id", "new_type")


@query("f26_migrate_lots", oracle("SELECT name, winery, vintage, arg_min(region, (created_at, id)) FILTER (region IS NOT NULL) AS region, count(*) AS lots FROM cellar GROUP BY ALL", _JOINED))
def f26(v):
    catalogue, lots, _, _ = C.migrate_lots(cellar(v).drop("wine_id"))
    return catalogue.join(lots.groupBy("wine_id").agg(F.count("*").alias("lots")), "wine_id").select("name", "winery", "vintage", "region", "lots")


@query("f27_recover_lots", oracle("SELECT id FROM v_lots WHERE wine_id % 2 = 1"))
def f27(v):
    _, _, _, moves = C.migrate_lots(cellar(v).where("wine_id % 2 = 0").drop("wine_id"))
    return C.recover_lots(v.lots, moves).select("id")


@query("f28_cellar_summary", oracle("SELECT user_id, string_agg(line, chr(10) ORDER BY created_at, id) AS summary FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY user_id ORDER BY created_at, id ROWS UNBOUNDED PRECEDING) AS upto FROM (SELECT *, name || ' ' || vintage || ' x' || qty AS line FROM cellar)) WHERE upto <= 500 GROUP BY user_id", _JOINED))
def f28(v):
    line = F.concat("name", F.lit(" "), F.col("vintage").cast("string"), F.lit(" x"), F.col("qty").cast("string"))
    return C.cellar_summary(cellar(v), line, 500)


@query("f29_critic_score", oracle("SELECT id, CASE WHEN wine_id % 3 < 2 THEN CAST(80 + wine_id % 20 AS INTEGER) END AS score FROM v_lots"))
def f29(v):
    n = (80 + F.col("wine_id") % 20).cast("string")
    notes = F.when(F.col("wine_id") % 3 == 0, F.concat(F.lit("Rated "), n, F.lit("/100, keep"))).when(F.col("wine_id") % 3 == 1, F.concat(n, F.lit(" points"))).otherwise(F.lit("no score"))
    return v.lots.select("id", critic_score(notes).alias("score"))
