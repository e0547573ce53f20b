"""What queries write, shuffle and keep follows their rows and not the number of files, users or passes."""

import math
import random
import time
from decimal import ROUND_HALF_UP, Decimal

from pyspark.sql import functions as F

from cofferlake.functions.text import no_accents, normalize_name
from cofferlake.operators import cellar as C
from cofferlake.operators import ledger as L
from cofferlake.operators import resolution as R
from cofferlake.operators import statements as S
from cofferlake.operators import tables as A
from cofferlake.operators import valuation as E
from cofferlake.plans import imports, portfolio
from cofferlake.plans import stored as stored_plans
from cofferlake.plans.streams import as_stream
from cofferlake.plans.views import Views
from cofferlake.sources.shared import file_system, scratch_path, stored
from cofferlake.sources.statements import bundled_lines
from cofferlake.streaming import jobs as J

SF_DIR = "/root/testdata/sf0.001"


def test_statements_land_in_bundles(spark):
    """Few files hold all statements, and every line comes back with its number."""
    v, path = Views(spark, SF_DIR), scratch_path(spark, "bundles")
    imports.write_statements(v, path)
    store, jpath = file_system(spark, path)
    wanted = imports.statements(v)
    assert store.getContentSummary(jpath).getFileCount() <= 20 < wanted.select("file").distinct().count()
    assert sorted(bundled_lines(spark, path).collect()) == sorted(wanted.collect())


def test_bundles_are_read_by_several_tasks(spark):
    """Statements that go on in the next block of a bundle keep their numbers; tabs of a line stay."""
    path = scratch_path(spark, "split-bundle")
    rows = spark.range(20_000).select(F.concat(F.lit("s"), F.floor(F.col("id") / 3_000).cast("string"), F.lit("\tline\t"), F.col("id").cast("string"), F.lit("\r")).alias("value"))
    rows.coalesce(1).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "50000")
        lines = bundled_lines(spark, path)
        assert lines.rdd.getNumPartitions() > 4
        found = sorted(tuple(r) for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert found == sorted((f"s{i // 3_000}", i % 3_000 + 1, f"line\t{i}") for i in range(20_000))


def test_statements_read_the_ledger_once(spark):
    """Headers come with the first line of a file: one scan of the trades for all kinds of statement."""
    plan = imports.statements(Views(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 1


def test_numbers_are_worked_out_once(spark):
    """Each parsed column is in the plan for itself, and a report needs its events once."""
    rows = spark.createDataFrame([("1", "2")], "a string, b string")
    out = S.evaluated(rows, **S._numbers("a", "b"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^0-9.,()") == 2 and out.first().n_b == 2.0
    events = spark.range(40).select(F.lit("f").alias("file"), F.lit("trade").alias("kind"), F.col("id").alias("line_no"), F.lit("x").alias("identifier"))
    small = S.import_report(events, sample=5, rows=7)
    assert small._jdf.queryExecution().optimizedPlan().toString().count("Range (") == 1
    row = small.first()
    assert row.n == 40 and [x.line_no for x in row["first"]] == [0, 1, 2, 3, 4]


def test_users_share_buckets_of_state(spark):
    """Positions of all users are the same with few buckets of state as one by one, null users and large ids included."""
    J.with_rocksdb(spark)
    user = F.when(F.col("id") % 41 > 0, (F.lit(1 << 60) + F.col("id") % 41).cast("long"))
    moves = spark.range(400).select(user.alias("user_id"), (F.col("id") % 3).cast("string").alias("symbol"), F.expr("date_add(DATE '2024-01-01', cast(id % 90 as int))").alias("date"), F.col("id").alias("seq"),
        F.when(F.col("id") % 4 == 0, "sell").otherwise("buy").alias("type"), F.col("id").cast("double").alias("shares"), F.lit(2.0).alias("price"), F.lit(1.0).alias("total_amount"), F.lit(0.5).alias("fee"), F.lit(None).cast("double").alias("tax"), F.lit(None).cast("double").alias("ratio"))
    end = moves.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("date", F.lit("2100-01-01").cast("date"))
    rows = moves.withColumn("part", F.lit(0)).unionByName(end.withColumn("part", F.lit(1)))
    out = spark.read.schema(J.RUNNING).parquet(J.finished(J.running_positions(as_stream(rows, "shared", ["part = 0", "part = 1"]).drop("part"), buckets=2), "shared-out")).where("user_id is null or user_id >= 0")
    found = {(r.user_id, r.symbol): r for r in sorted(out.collect(), key=lambda r: r.shares is None) if not r.rejected}
    assert out.count() == 400 and found.keys() == {(r.user_id, r.symbol) for r in moves.select("user_id", "symbol").distinct().collect()}
    last = out.groupBy("user_id", "symbol").agg(F.sum("fees_paid").alias("x"), F.max("fees_paid").alias("fees")).collect()
    wanted = {(r.user_id, r.symbol): r.n * 0.5 for r in moves.groupBy("user_id", "symbol").agg(F.count("*").alias("n")).collect()}
    assert {(r.user_id, r.symbol): r.fees for r in last} == wanted


def _shuffled(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = [files.apply(i) for i in range(files.size())]
    return {f.getName() for f in names if f.getName().startswith("shuffle_")}


def test_a_stream_lands_in_one_pass(spark):
    """Parts come from one pass and leave nothing that was shuffled; no part loses or gains rows."""
    seen, before = spark.sparkContext.accumulator(0), _shuffled(spark)
    counted = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    rows = spark.range(3_000).repartition(4, "id").withColumn("x", counted("id"))
    parts = ["id < 2000", "id < 0", F.when(F.col("id") % 2 == 0, F.col("id") >= 1900)]
    out = scratch_path(spark, "landed")
    J.finished(as_stream(rows, "pass", parts), "landed", lambda batch, number: batch.withColumn("number", F.lit(number)).write.mode("append").parquet(out))
    assert seen.value == 3_000
    found = {n: sorted(r.x for r in spark.read.parquet(out).where(f"number = {n}").collect()) for n in range(3)}
    assert found == {0: list(range(2_000)), 1: [], 2: list(range(1_900, 3_000, 2))}
    until = time.monotonic() + 30
    while _shuffled(spark) - before and time.monotonic() < until:
        time.sleep(0.2)
    assert not _shuffled(spark) - before
    assert spark.conf.get("spark.sql.maxConcurrentOutputFileWriters") == "0"


def test_moves_wait_in_little_room(spark):
    """The state's files take some twenty bytes for each move that waits, and what is not a number counts as none."""
    J.with_rocksdb(spark)
    number = lambda seed: F.round(F.rand(seed) * 90_000 + 900, 2)
    moves = spark.range(20_000).select((F.col("id") % 997).alias("user_id"), F.concat(F.lit("STANDARD POLISHED "), F.col("id") % 9).alias("symbol"), F.expr("date_add(DATE '2024-01-01', cast(id % 5 as int))").alias("date"), F.col("id").alias("seq"),
        F.when(F.col("id") % 4 == 0, "dividend").otherwise("buy").alias("type"), (F.col("id") % 50 + 1.0).alias("shares"), (number(1) / (F.col("id") % 50 + 1)).alias("price"), number(1).alias("total_amount"),
        F.when(F.col("id") % 7 == 0, F.lit(float("nan"))).otherwise(number(2) * 0.07).alias("fee"), (number(2) * 0.07).alias("tax"), F.lit(None).cast("double").alias("ratio"))
    moves, path, checkpoint, out = stored(moves, "waiting-moves"), scratch_path(spark, "waiting"), scratch_path(spark, "waiting-checkpoint"), scratch_path(spark, "waiting-out")
    moves.write.parquet(path)
    run = lambda: J.finished(J.running_positions(spark.readStream.schema(moves.schema).parquet(path), buckets=4), "waiting", checkpoint=checkpoint, path=out)
    run()
    store, jpath = file_system(spark, checkpoint)
    files = store.listFiles(jpath, True)
    sizes = []
    while files.hasNext():
        f = files.next()
        sizes += [f.getLen()] if f.getPath().getName().endswith(".sst") else []
    assert 0 < sum(sizes) < 36 * 20_000
    moves.limit(1).withColumn("user_id", F.lit(-1).cast("long")).withColumn("date", F.lit("2100-01-01").cast("date")).write.mode("append").parquet(path)
    run()
    sums = ("fees_paid", "dividends", "tax_withheld", "shares")  # none falls, as nothing is sold
    found = spark.read.schema(J.RUNNING).parquet(out).where("user_id >= 0").groupBy("user_id", "symbol").agg(*[F.max(c).alias(c) for c in sums])
    of = lambda kind, c: F.sum(F.when(F.col("type") == kind, F.nanvl(c, F.lit(0.0))).otherwise(0.0))
    wanted = moves.groupBy("user_id", "symbol").agg(*[of(k, F.col(c)).alias(f"w_{s}") for s, k, c in zip(sums, ("buy", "dividend", "dividend", "buy"), ("fee", "total_amount", "tax", "shares"))])
    joined = found.join(wanted, ["user_id", "symbol"], "full").collect()
    assert len(joined) == 997 * 9 and all(math.isclose(r[c], r[f"w_{c}"], abs_tol=1e-6) for r in joined for c in sums)


def test_statements_meet_their_headers_once(spark):
    """The parsers of all brokers read what one join left, not the files once each."""
    files = spark.range(60).select(F.lit("app").alias("file"), (F.col("id") + 1).alias("line_no"), F.when(F.col("id") == 0, "Date,Ticker,Type,Quantity,Price per share,Total Amount,Currency").otherwise('2024-01-02,A,BUY - MARKET,2,"$1,000.50","$2,001.00",USD').alias("line"))
    out = S.parse_statements(files)
    assert "Range (" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.broker, r.kind, r.date, r.price) for r in out.collect()} == {("revolut", "trade", "2024-01-02", 1000.5)} and out.count() == 59


def test_number_patterns_stay_in_latin(spark):
    """A class with a character beyond Latin-1 takes Java ten times as long for every number; the sign still counts."""
    rows = spark.createDataFrame([(x,) for x in ("−1.234,5", "(12)", "1,234", "1,23", "", None, "$1,234.50", "1.234.567", "-")], "x string")
    out = rows.select(S.parse_number_broker(F.col("x")).alias("n"))
    assert "−]" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.n for r in out.collect()] == [-1234.5, -12.0, 1234.0, 1.23, None, None, 1234.5, 1234567.0, None]


def test_cells_without_odd_quotes_need_no_pattern(spark):
    """Quoted separators, blanks inside and around quotes, doubled and open quotes."""
    lines = {'a," b, c ",d': ["a", "b, c", "d"], 'x""y,"p""q",': ["xy", 'p"q', ""], '"open,1': ["open,1"], " a ,b c,": ["a", "b c", ""], 'p"q,r"s,t': ["pq,rs", "t"], "": [""], " a,b": ["a", "b"]}
    rows = spark.createDataFrame([(x,) for x in lines], "x string")
    assert [r.c for r in rows.select(S.split_csv(F.col("x"), F.lit(",")).alias("c")).collect()] == list(lines.values())


def test_lines_are_worked_out_once(spark):
    """Lines of one kind of statement do not go back to the ledger for their headers and again for what is below."""
    v = Views(spark, SF_DIR)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    for lines in (imports.transaction_lines(v), imports.app_lines(v), imports.account_lines(v)):
        assert "l_extendedprice" not in plan(lines) and lines.count() > 0


def test_deleted_rows_are_counted_where_they_lie(spark):
    """rows and tombstones are dealt by user and symbol once; every count equals a plain one, nulls included."""
    rng = random.Random(10)
    pick = lambda *values: rng.choice(values)
    key = lambda stamps: (pick(1, 1, 2, None), pick("A", "A", None), pick(*stamps), pick("2024-01-01", "2024-01-01", "2024-01-02", None), pick("buy", "buy", "sell", None))
    names = "user_id long, symbol string, timestamp string, date string, type string"
    rows, stones = [(*key(("t1", "t2", "t3", "", None)), i) for i in range(300)], [key(("t1", "t1", "t2", "gone", "", None)) for _ in range(150)]
    left = sorted(rows, key=lambda r: r[5])

    def take(fits):
        found = next((r for r in left if fits(r)), None)
        if found is not None:
            left.remove(found)
        return found is not None

    order = lambda s: tuple((x is not None, x) for x in s[3:5])
    loose = [s for s in sorted(stones, key=order) if not (s[2] and None not in s[:2] and take(lambda r: r[:3] == s[:3]))]
    for s in loose:
        if None not in (*s[:2], *s[3:5]):
            take(lambda r: r[:2] + r[3:5] == s[:2] + s[3:5])
    out = A.delete_ledger_rows(spark.createDataFrame(rows, names + ", seq int"), spark.createDataFrame(stones, names))
    assert sorted(r.seq for r in out.collect()) == sorted(r[5] for r in left) and 0 < len(left) < 250
    plan = stored_plans.a16(Views(spark, SF_DIR))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("lineitem.parquet") == 2 and plan.count("Exchange hashpartitioning(user_id") == 2


def test_holdings_are_looked_for_once(spark):
    """one join finds equal names and, where these miss, normalised ones; null and repeated ids as they were."""
    letters = spark.createDataFrame([(chr(c),) for c in range(0x20, 0x30000) if not 0xD800 <= c <= 0xDFFF], "c string")
    assert letters.where(normalize_name(F.col("c")) != normalize_name(F.lower(F.trim("c")))).isEmpty()
    wanted = [(1, "a", " Château ", "W", 1990), (1, "b", "chateau", None, None), (1, "b", "CHATEAU", "w", 1990), (1, None, "x’y", "W", 1990), (1, "c", "x’Y", "v", 1990), (2, "a", "château", "W", 1990), (1, "d", None, "W", 1990), (1, "e", "chateau", "W", 1990)]
    lots = [(1, 10, "CHÂTEAU", "w", 1990), (1, 11, "Chateau", None, None), (1, 12, "x'y", "W", 1990), (1, 12, "x'y", "W", 1990), (1, 13, "x'y", "V", 1990), (1, 14, None, "W", 1990)]
    names = "name string, winery string, vintage int"
    rows = [stored(spark.createDataFrame(rows, f"user_id int, {key}, {names}"), "wines") for rows, key in ((wanted, "want_id string"), (lots, "id int"))]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        out = C.existing_holdings(*rows)
        found = sorted((str(r.want_id), r.id, r.how) for r in out.collect())
        plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert found == [("None", 12, "normalised"), ("None", 12, "normalised"), ("a", 10, "exact"), ("b", 11, "exact"), ("c", 13, "normalised"), ("e", 10, "normalised")]
    assert plan.count("- Exchange hashpartitioning(user_id") == 2  # the others are reused


def test_model_texts_are_parsed_once(spark):
    """a text is cleaned once for the rows and once for what is no JSON, however many patterns and filters follow."""
    texts = [("a", 3, "```json\n[{'value': 1,},]```"), ("b", 3, 'Sure: {"value": 2.5, "note": None,}'), ("c", 2, '[{"value": 1}, {"value": True}, {"value": 3}]'), ("d", 1, "no"), ("e", 1, None), ("f", 1, "[]")]
    rows = spark.createDataFrame(texts, "batch string, n int, text string").replace("'", '"')
    out = S.parse_result_batch(rows, "n")
    assert out._jdf.queryExecution().optimizedPlan().toString().count("```(?:json)?") == 2
    assert sorted((r.batch, r.idx, r.value, r.error) for r in out.collect() if r.batch in "bdef") == [("b", 0, 2.5, None), ("d", None, None, "no JSON in the answer"), ("e", None, None, "no JSON in the answer"), ("f", None, None, "no JSON in the answer")]


def test_short_searches_compare_their_first_finds_only(spark):
    """strings of names are not shuffled to be told apart, and the ranks are those of all pairs, repeated tickers included."""
    rng = random.Random(13)
    word = lambda n: "".join(rng.choice("abA ") for _ in range(n))
    assets = [(word(rng.randint(1, 4)) if i % 9 else None, word(rng.randint(0, 9)) if i % 7 else None) for i in range(120)] + [("", "ab"), ("ab", "ab"), ("ab", "ab")]
    asked = [(word(rng.randint(0, 6)),) for _ in range(150)] + [(None,)]
    table = spark.createDataFrame(assets, "ticker string, name string")
    postings = R.name_postings(table)
    assert "gram" not in "".join(x for x in postings._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x)
    found = sorted((r.query, r["rank"], r.ticker) for r in R.search_many(table, postings, spark.createDataFrame(asked, "query string")).collect())
    wanted = []
    for query in sorted({a for (a,) in asked if a and a.strip(" ")}):
        q = query.strip(" ").lower()
        hits = [t for t, name in assets if t is not None and (q in t.lower() or q in (name or "").lower())]
        order = sorted(hits, key=lambda t: (0 if t.lower() == q else 1 if t.lower().startswith(q) else 2, t))[:8]
        wanted += [(query, i + 1, t) for i, t in enumerate(order)]
    assert found == sorted(wanted) and len(wanted) > 300


def test_names_are_told_apart_once_and_plainly(spark):
    """F16: letters are looked for without a loop in a query, plain names without tables of accents; near names stay the same."""
    names = ["a`b", "É`a", "  A \t b ", "plain", "Ünï", "", None, "´x", "naïve ’n‘ k`"]
    table = spark.createDataFrame([(n,) for n in names], "name string")
    slow = F.lower(F.trim(F.regexp_replace(F.regexp_replace(no_accents(F.col("name")), "[’‘`´]", "'"), r"\s+", " ")))
    assert table.where(~normalize_name(F.col("name")).eqNullSafe(slow)).isEmpty()
    rng = random.Random(16)
    word = lambda: "".join(rng.choice("abcßéж 1#") for _ in range(rng.randint(1, 7)))
    lots, scans = [(rng.randint(1, 3), word()) for _ in range(90)], [(rng.randint(1, 3), f"s{i}", word()) for i in range(90)]
    lots, scans = spark.createDataFrame(lots, "user_id int, name string"), spark.createDataFrame(scans, "user_id int, scan_id string, name string")
    out = C.fuzzy_match_scans(scans, lots)
    assert "aggregate(" not in out._jdf.queryExecution().optimizedPlan().toString()
    x, y = normalize_name(F.col("a.name")), normalize_name(F.col("b.name"))
    pairs = scans.alias("a").join(lots.alias("b"), "user_id").select("scan_id", x.alias("x"), y.alias("y"), F.levenshtein(x, y).alias("d")).where("x <> '' and d > 0 and d <= greatest(2, floor(least(length(x), length(y)) * 0.15))")
    found = {(r.scan_id, r.name, r.distance) for r in out.collect()}
    assert found == {(r.scan_id, r.y, r.d) for r in pairs.collect()} and len(found) > 100


def test_dimensions_are_summed_as_they_lie(spark):
    """rows are dealt and sorted once and no task keeps a table of groups; nulls, equal lots and losses included."""
    rng = random.Random(17)
    pick = lambda *values: rng.choice(values)
    lots = [(pick(1, 2, 2, None), pick(1, 3, -2, None), pick(2.5, 0.1, None), pick(7.25, -0.3, None), pick("North", "South", "Unknown", None), pick("Red", "region", None)) for _ in range(400)]
    out = C.group_by_dimension(spark.createDataFrame(lots, "user_id long, qty int, purchase_price double, estimated_value double, region string, type string"), ("region", "type"))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Aggregate" not in plan and plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    sums = {}
    for user, qty, price, value, *dims in lots:
        estimated = (qty or 0) * (value if value is not None else price or 0.0)
        for dimension, x in zip(("region", "type"), dims):
            bottles, total = sums.get((user, dimension, x or "Unknown"), (0, Decimal(0)))
            sums[user, dimension, x or "Unknown"] = bottles + (qty or 0), total + Decimal(estimated).quantize(Decimal("0.000001"), ROUND_HALF_UP)
    found = {(r.user_id, r.dimension, r.value): r for r in out.collect()}
    assert out.count() == len(found) == len(sums) and found.keys() == sums.keys()
    for (user, dimension, value), (bottles, estimated) in sums.items():
        r, whole = found[user, dimension, value], float(sum(x for k, (_, x) in sums.items() if k[:2] == (user, dimension)))
        assert (r.bottles, r.estimated) == (bottles, float(estimated)) and math.isclose(r.share, float(estimated) / whole * 100 if whole > 0 else 0.0)


def test_worth_comes_from_one_pass(spark):
    """lots are summed with the ledger's groups; a null user's stocks and wine stay apart, as the join leaves them."""
    v = Views(spark, SF_DIR)
    for f in (portfolio.e20, portfolio.e23):
        plan = f(v)._jdf.queryExecution().executedPlan().toString()
        assert plan.count("lineitem.parquet") == 1 and plan.count("Exchange hashpartitioning(user_id") + plan.count("Exchange hashpartitioning(o_custkey") <= 1
    lots = ["user_id", "qty", "purchase_price", "estimated_value", "last_valued_at"]
    for columns, table in ((lots, v.lots), (v.ledger.columns, v.ledger)):
        assert v.with_lots.select(columns).exceptAll(table.select(columns)).isEmpty() and table.select(columns).exceptAll(v.with_lots.select(columns)).isEmpty()
    rng = random.Random(18)
    pick = lambda *values: rng.choice(values)
    lines = [(pick(1, 2, None), pick("A", "B", None), pick("buy", "buy", "sell", "fee"), "2024-01-01", i, pick(1.0, 2.5), pick(0.3, 7.0), pick(0.1, None), 1.0, None, None, pick(0, 2, None), pick(1.1, None), pick(9.7, None), pick("2024-02-01", "2024-02-02", None)) for i in range(120)]
    lines += [(3, "A", "fee", "2024-01-01", 999, 1.0, 1.0, 1.0, 1.0, None, None, None, None, None, None)]
    rows = spark.createDataFrame(lines, "user_id long, symbol string, type string, date string, seq long, shares double, price double, fee double, total_amount double, tax double, ratio double, qty int, purchase_price double, estimated_value double, last_valued_at string")
    found = E.net_worth(L.positions_from_ledger(rows, E.lot_values()), None).collect()
    wanted = E.net_worth(L.positions_from_ledger(rows), rows).collect()
    assert sorted(map(str, found)) == sorted(map(str, wanted)) and len(found) == 5
    split = E.net_worth(L.positions_from_ledger(rows, E.lot_values(), hot=20, block=10), None).collect()
    assert {(r.user_id, r.wine_value, r.wine_cost, r.last_valued_at) for r in split} == {(r.user_id, r.wine_value, r.wine_cost, r.last_valued_at) for r in found}


def test_long_groups_are_looked_for_in_buckets(spark):
    """groups are counted one by one only where a bucket of them is long."""
    rows = spark.range(3_000).select(F.when(F.col("id") % 3 > 0, F.col("id") % 7).alias("user_id"), F.when(F.col("id") % 2 > 0, "A").alias("symbol"))
    assert L._long_groups(rows, 500) is None and L._long_groups(rows.limit(0), 0) is None
    found = {(r.user_id, r.symbol): r["_n"] for r in L._long_groups(rows, 499).collect()}
    assert found == {(None, None): 500, (None, "A"): 500}
