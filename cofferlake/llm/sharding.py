"""Shards by a hierarchical weighted hash tree.

A layout is a tree of regions, racks and shards with weights; a region or rack weighs what is below it. A row descends
it level by level: at a node every child draws an exponential variate from the hash of the row's key and the child's
name, divided by the child's weight, and the least draw wins. So a child receives its share of the weight, and the draw
between two children changes only if one of their weights does: after a change of weights, rows move into or out of the
regions, and within them the racks, whose weights changed, and nowhere else.

A row that enters a region descends it anew, so a shard added to an existing rack would also send rows to its
neighbours. ``grown`` therefore adds a shard in a region of its own: the other weights stay, and rows move into the new
shard only. The law of the query is ``key``: the key and the layout decide, no count of rows or bytes does.

A shard's rows are numbered in order of the hash of (doc_id, text_crc32, size): rows that agree in all three are counted
first, in rounds of ``ROUND`` copies, and cells of hash ranges of a shard get their offsets from their counts. A cell has
some ``PER_CELL`` different rows and no more than ROUND copies of each, however many copies or rows of one id there are.

Everything is DataFrame expressions; the text is read once and not shuffled.

Cases: a null text has 0 bytes (size 1); null ids share one draw; repeated rows are rows of their own; an empty table
gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.llm.common import materialise

#: Weights of shards by region and rack.
Layout = dict[str, dict[str, dict[int, float]]]
ROUND, PER_CELL = 65_536, 1_000


def uniform_layout(shards: int = 16, per_rack: int = 4, racks: int = 2) -> Layout:
    """Shards of weight 1, ``per_rack`` in each rack and ``racks`` in each region."""
    out: Layout = {}
    for s in range(shards):
        rack = s // per_rack
        out.setdefault(f"r{rack // racks}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return out


def shard_numbers(layout: Layout) -> list[int]:
    return sorted(s for racks in layout.values() for shards in racks.values() for s in shards)


def grown(layout: Layout, weight: float = 1.0) -> Layout:
    """``layout`` with one more shard, in a region of its own."""
    new = max(shard_numbers(layout), default=-1) + 1
    return layout | {f"g{new}": {f"g{new}k": {new: weight}}}


def _children(layout: Layout) -> dict[str, list[tuple[str, float]]]:
    """(name, weight) of the children of each inner node; the root is ''. What weighs nothing is left out."""
    out: dict[str, list[tuple[str, float]]] = {"": []}
    for region, racks in layout.items():
        for rack, shards in racks.items():
            if any(not (w >= 0 and math.isfinite(w)) for w in shards.values()):
                raise ValueError("weights are finite and not negative")
            leaves = [(str(s), float(w)) for s, w in shards.items() if w > 0]
            if leaves:
                out[f"{region}/{rack}"] = leaves
                out.setdefault(region, []).append((f"{region}/{rack}", sum(w for _, w in leaves)))
        if region in out:
            out[""].append((region, sum(w for _, w in out[region])))
    if not out[""]:
        raise ValueError("no shard has a weight")
    return out


def shard_of(key: Column, layout: Layout) -> Column:
    """The shard of each key (a string, null as the empty one), drawn region, rack, shard."""
    children = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*[F.struct(F.lit(n).alias("name"), F.lit(w).alias("weight")) for n, w in x]) for pair in _children(layout).items() for x in pair])
    key = F.coalesce(key, F.lit(""))

    def draw(child: Column) -> Column:
        bits = F.conv(F.substring(F.md5(F.concat(key, F.lit("|"), child["name"]).cast("binary")), 1, 13), 16, 10).cast("double")
        return F.struct((-F.ln((bits + 0.5) / float(1 << 52)) / child["weight"]).alias("draw"), child["name"].alias("name"))

    node = F.lit("")
    for _ in ("region", "rack", "shard"):
        node = F.array_min(F.transform(F.element_at(children, node), draw))["name"]
    return node.cast("int")


def sharded(docs: DataFrame, layout: Layout | None = None, round_size: int = ROUND, per_cell: int = PER_CELL) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (the shard in ``grown(layout)``)."""
    layout = layout or uniform_layout()
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count("*").alias("copies"))
    key = F.col("doc_id").cast("string")
    order = F.md5(F.concat_ws("/", F.coalesce(key, F.lit("")), F.col("text_crc32").cast("string"), F.col("size").cast("string")).cast("binary"))
    rows = rows.select("*", shard_of(key, layout).alias("shard"), shard_of(key, grown(layout)).alias("grown_shard"), order.alias("order"))
    rows = materialise(rows, "shards")
    cells_of_shard = max(1, math.ceil(rows.count() / len(shard_numbers(layout)) / per_cell))
    rows = rows.withColumn("round", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {round_size}"))))
    rows = rows.withColumn("copies", F.least(F.lit(round_size).cast("long"), F.col("copies") - F.col("round") * round_size))
    rows = rows.withColumn("cell", F.floor(F.conv(F.substring("order", 1, 8), 16, 10).cast("double") * cells_of_shard / float(1 << 32)))
    cells = rows.groupBy("shard", "round", "cell").agg(F.sum("copies").alias("n"))
    cells = cells.select("shard", "round", "cell", (F.sum("n").over(Window.partitionBy("shard").orderBy("round", "cell")) - F.col("n")).alias("before"))
    before = F.sum("copies").over(Window.partitionBy("shard", "round", "cell").orderBy("order", "doc_id", "text_crc32", "size")) - F.col("copies")
    rows = rows.join(cells, ["shard", "round", "cell"]).withColumn("first", F.col("before") + before)
    slot = F.explode(F.sequence(F.col("first"), F.col("first") + F.col("copies") - 1))
    return rows.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")
