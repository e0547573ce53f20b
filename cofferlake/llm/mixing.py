"""Mixing sources to target weights by systematic sampling.

Each source's target comes from its weight; every document of a source then expects target / source_size copies. The
expected copies are prefix-summed within the source, one random offset is added, and a document is emitted once for
each integer boundary that its interval crosses. Documents of one source are ordered by size, so the words taken
follow the target closely.

The prefix sum is a rank times a constant, and ranks are made without putting a source in one task: rows are dealt over
tasks by ranges of (source, size, id, place in the input), sorted there and written down with their place, and a running
sum over the counts of each source in each range gives its first rank. The last column cuts ranges within equal rows too, so
no source, size or id has to fit in a task. Everything is built from SQL expressions.

Cases: null text has size 0 and is never taken; a null source is a source of its own, last in order; repeated rows are
sampled one by one; an empty table gives an empty result; a source of size 0 has target 0; further columns pass through
``sampled_copies``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.llm.common import materialise

#: Weights by position of the source in order, repeating; share of all words taken; largest multiple of a source.
WEIGHTS, SHARE, MOST = (5, 2, 1), 1.5, 2.0
_WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: str = "text") -> F.Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(_WORD)), F.lit(0)).cast("long")


def source_targets(sized: DataFrame) -> DataFrame:
    """source, source_size, target: weights share SHARE of all words; nothing exceeds MOST times its source.

    Resharing the excess by weight ends where target = min(MOST * size, level * weight). With sources by rising
    MOST * size / weight the capped ones come first, so one running sum gives the level.
    """
    sources = sized.groupBy("source").agg(F.sum("size").cast("double").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    sources = sources.withColumn("place", place).withColumn("weight", weight).withColumn("cap", MOST * F.col("source_size")).withColumn("ratio", F.col("cap") / F.col("weight"))
    everything = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = Window.orderBy("ratio", "place").rowsBetween(Window.unboundedPreceding, -1)
    goal = SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    sources = sources.withColumn("level", goal / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    sources = sources.withColumn("final", F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "place"))).over(everything))
    target = F.least("cap", F.coalesce(F.col("final") * F.col("weight"), F.col("cap")))
    return sources.select("source", F.col("source_size").cast("long").alias("source_size"), target.alias("target"))


def sampled_copies(sized: DataFrame, seed: str = "mix", cell_rows: int | None = None, tie: tuple[str, ...] = ()) -> DataFrame:
    """``sized`` (doc_id, source, size and any other columns) with source_size, target and copies.

    Rows of equal size and doc_id are ordered by ``tie``. Ranges hold about ``cell_rows`` rows, or as many as the session's
    shuffle partitions make of them. Column names that begin with an underscore are taken.
    """
    order = ["source", "size", F.col("doc_id").asc_nulls_last(), *tie, "_place"]
    ranges = [] if cell_rows is None else [max(1, -(-sized.count() // cell_rows))]
    ranged = sized.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*ranges, *order).sortWithinPartitions(*order).drop("_place")
    ranged = materialise(ranged.withColumn("_at", F.monotonically_increasing_id()), "ranges")
    ranged = ranged.withColumn("_range", F.shiftright("_at", 33))  # the places of a task's rows follow each other
    counts = ranged.groupBy("source", "_range").agg(F.count("*").alias("_n"), F.min("_at").alias("_least"))
    before = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("source").alias("_source"), F.col("_range").alias("_r"), (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_least")).alias("_first"))
    targets = source_targets(ranged.select("source", "size")).withColumnRenamed("source", "_of")
    firsts = firsts.join(targets, firsts["_source"].eqNullSafe(targets["_of"])).drop("_of")
    out = ranged.join(firsts, ranged["source"].eqNullSafe(firsts["_source"]) & (ranged["_range"] == firsts["_r"]))
    rate = F.coalesce(F.try_divide("target", F.col("source_size").cast("double")), F.lit(0.0))
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(seed + ":"), F.coalesce("source", F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    at = F.col("_first") + F.col("_at")
    copies = F.floor((at + 1) * rate + offset) - F.floor(at * rate + offset)
    return out.withColumn("copies", copies.cast("long")).drop("_at", "_range", "_source", "_r", "_first")


def sized(docs: DataFrame) -> DataFrame:
    return materialise(docs.select(F.col("doc_id").cast("long"), "source", word_count().alias("size")), "sizes")


def mixture(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """doc_id, size, source_size, target, copies, taken."""
    out = sampled_copies(sized(docs), seed)
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, seed: str = "mix") -> DataFrame:
    """The documents themselves, each as often as the mixture takes it; columns may have any names."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    rows = docs.select(F.col("doc_id").cast("long"), "source", word_count().alias("size"), F.xxhash64("text").alias("tie"), row.alias("row"))
    out = sampled_copies(rows, seed, tie=("tie",)).where("copies > 0 and size > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("row.*")


#: The same result in DuckDB's SQL.
MIXTURE_SQL = f"""
WITH sized AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '{_WORD}')), 0) AS BIGINT) AS size FROM documents),
sums AS (SELECT source, CAST(sum(size) AS DOUBLE) AS source_size FROM sized GROUP BY source),
placed AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS place FROM sums),
weighed AS (SELECT *, CASE place % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight, 2.0::DOUBLE * source_size AS cap FROM placed),
ratios AS (SELECT *, cap / weight AS ratio FROM weighed),
levels AS (SELECT *, (1.5::DOUBLE * (SELECT sum(source_size) FROM sums)
   - coalesce(sum(cap) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / ((SELECT sum(weight) FROM weighed) - coalesce(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM ratios),
final AS (SELECT level AS final FROM levels WHERE level <= ratio ORDER BY ratio, place LIMIT 1),
targets AS (SELECT source, CAST(source_size AS BIGINT) AS source_size, least(cap, coalesce((SELECT final FROM final) * weight, cap)) AS target FROM levels),
kinds AS (SELECT *, CASE WHEN size > 0 THEN length(bin(size)) * 16 + (size >> greatest(length(bin(size)) - 4, 0)) ELSE 0 END AS kind FROM sized),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY kind, size, doc_id) - 1 AS pos FROM kinds),
rated AS (SELECT r.*, t.source_size, t.target, CASE WHEN t.source_size = 0 THEN 0 ELSE t.target / CAST(t.source_size AS DOUBLE) END AS rate,
  CAST(('0x' || substr(md5('mix:' || coalesce(r.source, '')), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS shift
  FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
counted AS (SELECT *, CAST(floor((pos + 1) * rate + shift) - floor(pos * rate + shift) AS BIGINT) AS copies FROM rated)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM counted
"""
