"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

Sketch (Dahlgaard, Knudsen, Thorup 2017): in each of the first t rounds every element of a set is hashed to one of t
bins and a value, and a bin that is still empty keeps the least value it gets; the next t rounds serve one bin each, so
that every coordinate fills. Two sketches agree in a coordinate with probability equal to the Jaccard similarity, with
concentration as for independent coordinates.

Plan: one pass over the texts makes a key of each document's shingle set, and ``bands`` hashes of ``rows_per_band``
coordinates. Documents with equal sets collapse into one node before anything else. Within a band's bucket every node
is compared with the bucket's first node only (a star, not all pairs). Buckets that still hold several components are
blocked anew by prefix filtering, and members outside the largest component of a block take turns until all were
compared with the members of other components. A pair in one component needs no comparison, so no connection is lost. Candidates are confirmed on full sets: 100 * intersection
>= percent * union. With 32 bands of 6 rows, a pair at similarity 0.85 is missed with probability 3e-7.

Cases: null or empty text has an empty set (n_shingles 0) and is linked with nothing; fewer words than a shingle give
one shingle of the whole sequence; repeated rows share a node; rows with a null ``doc_id`` are never linked, have a
null component and are kept; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.llm import textvec as tv
from cofferlake.llm.common import discard_since, materialise, stages_so_far

_EMPTY = np.uint64((1 << 64) - 1)


def shingle_sets(data: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle fingerprints of all documents one after another, and where each one's begin."""
    starts, ends = tv.runs(tv.WORD[data], offs[:-1])
    words, owners = tv.fingerprints(data, starts, ends, tv.LOWERED), tv.owner(offs, starts)
    n = len(offs) - 1
    count = np.bincount(owners, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    mult = tv.mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    with np.errstate(over="ignore"):
        size = max(len(words) - width + 1, 0)
        h = np.full(size, width, dtype=np.uint64)
        for k in range(width):
            h += words[k : k + size] * mult[k]
        h = tv.mix(h)
    sets = []
    for i in range(n):
        if count[i] >= width:
            sets.append(np.unique(h[first[i] : first[i + 1] - width + 1]))
        elif count[i]:
            whole = np.uint64(count[i])
            with np.errstate(over="ignore"):
                for k in range(count[i]):
                    whole += words[first[i] + k] * mult[k]
            sets.append(tv.mix(np.array([whole], np.uint64)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return (np.concatenate(sets) if sets else np.zeros(0, np.uint64)), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def sketches(elements: np.ndarray, bounds: np.ndarray, t: int) -> np.ndarray:
    """One row of t coordinates for each set; rows of empty sets hold the largest value."""
    n = len(bounds) - 1
    out = np.full(n * t, _EMPTY, dtype=np.uint64)
    sizes = np.diff(bounds)
    owner, live = np.repeat(np.arange(n), sizes), elements
    open_sets = sizes > 0
    for i in range(2 * t):
        if not len(live):
            break
        with np.errstate(over="ignore"):
            value = tv.mix(live + np.uint64(i + 1) * np.uint64(0x9E3779B97F4A7C15))
        if i < t:
            place = (((value >> np.uint64(32)) * np.uint64(t)) >> np.uint64(32)).astype(np.int64)
        else:
            place = i - t
        fresh = np.full(n * t, _EMPTY, dtype=np.uint64)
        np.minimum.at(fresh, owner * t + place, tv.mix(value))
        out = np.where(out == _EMPTY, fresh, out)
        open_sets &= (out.reshape(n, t) == _EMPTY).any(axis=1)
        stay = open_sets[owner]
        owner, live = owner[stay], live[stay]
    return out.reshape(n, t)


def set_keys(elements: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """128-bit keys that do not depend on order."""
    out = np.zeros((len(bounds) - 1, 2), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds) > 0)
    if len(full):
        with np.errstate(over="ignore"):
            for k in (0, 1):
                out[full, k] = np.add.reduceat(tv.mix(elements + np.uint64(0xD1B54A32D192ED03 * (k + 1) & tv._MASK)), bounds[full])
    return [row.tobytes() for row in out]


def _sketched(width: int, bands: int, rows: int):
    def run(batches):
        for batch in batches:
            sizes, keys, bucket = [], [], []
            for _, _, data, offs in tv.text_slices(batch.column("text")):
                elements, bounds = shingle_sets(data, offs, width)
                sizes.append(np.diff(bounds))
                keys += set_keys(elements, bounds)
                coords = sketches(elements, bounds, bands * rows).reshape(-1, bands, rows)
                with np.errstate(over="ignore"):
                    h = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), coords.shape[:2]).copy()
                    for k in range(rows):
                        h = tv.mix(h + coords[:, :, k])
                bucket.append(h.view(np.int64))
            size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
            flat = np.concatenate(bucket).ravel() if bucket else np.zeros(0, np.int64)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, bands, dtype=np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(keys, pa.binary()), lists], names=["doc_id", "n_shingles", "set_key", "buckets"])

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            keys, elements, sizes = [], [], []
            for _, _, data, offs in tv.text_slices(batch.column("text")):
                e, bounds = shingle_sets(data, offs, width)
                keys += set_keys(e, bounds)
                elements.append(e)
                sizes.append(np.diff(bounds))
            ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((np.concatenate(elements) if elements else np.zeros(0, np.uint64)).view(np.int64)))
            same = pa.array([a == b for a, b in zip(keys, batch.column("set_key").to_pylist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("node"), lists], names=["node", "shingles"]).filter(same)

    return run


def connected_components(links: DataFrame, name: str = "components") -> DataFrame:
    """(node, label) of every node with a link ``a``-``b``; the label is the least node of its component.

    Each round a node takes the least label around it, then the label of its label; both are joins on shuffled keys,
    and each round is written to the shared folder.
    """
    both = materialise(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).where("u <> v").distinct(), name)
    labels = materialise(both.groupBy("u").agg(F.min("v").alias("least")).select(F.col("u").alias("node"), F.least("u", "least").alias("label"), F.lit(True).alias("moved")), name)
    while labels.where("moved").limit(1).count():
        near = both.join(labels.select(F.col("node").alias("v"), "label"), "v").groupBy("u").agg(F.min("label").alias("near"))
        step = labels.join(near, labels["node"] == near["u"]).select("node", F.least("label", "near").alias("next"), F.col("label").alias("old"))
        step = materialise(step, name)
        jump = step.select(F.col("node").alias("next"), F.col("next").alias("jump"))
        labels = materialise(step.join(jump, "next").select("node", F.least("next", "jump").alias("label"), (F.least("next", "jump") < F.col("old")).alias("moved")), name)
    return labels.select("node", "label")


def _sets_of(nodes: DataFrame, docs: DataFrame, width: int) -> DataFrame:
    """(node, shingles) of the named nodes, made anew from one document of each."""
    wanted = nodes.select("node", F.col("rep").alias("doc_id"), "set_key")
    sets = docs.select("doc_id", "text").join(wanted, "doc_id").select("node", "set_key", "text").mapInArrow(_full_sets(width), "node long, shingles array<long>")
    return materialise(sets, "sets").groupBy("node").agg(F.first("shingles").alias("shingles"))


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The candidate pairs (a, b) whose full sets are similar enough."""
    one, two = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    both = F.size(F.array_intersect("x", "y")).cast("long")
    return materialise(pairs.join(one, "a").join(two, "b").where(100 * both >= percent * (F.size("x") + F.size("y") - both)).select("a", "b"), "links")


def _merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after the components named in ``links`` (a, b) have become one each."""
    of = lambda k: labels.select(F.col("node").alias(k), F.col("label").alias(f"label_{k}"))
    joined = links.join(of("a"), "a").join(of("b"), "b").select(F.col("label_a").alias("a"), F.col("label_b").alias("b"))
    moved = connected_components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return materialise(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def _prefix_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """(bucket, node, size, pos): the elements that any two similar sets must share one of.

    With elements by rising number of holders, a set of n only needs its first n - ceil(percent * n / 100) + 1. Passages
    that many documents share come last in that order, so they bring nothing together. Elements with one holder are
    counted, not joined.
    """
    every = sets.select("node", F.explode("shingles").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("holders")).where("holders > 1")
    held = every.join(shared, "bucket").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("holders", "bucket"))).alias("held"))
    out = held.join(sets.select("node", F.size("shingles").cast("long").alias("size")), "node").withColumn("alone", F.col("size") - F.size("held"))
    need = F.col("size") - F.ceil(F.col("size") * percent / 100) + 1 - F.col("alone")
    out = out.where(need > 0).select("node", "size", "alone", F.posexplode(F.slice("held", F.lit(1), need.cast("int"))).alias("at", "element"))
    return materialise(out.select(F.col("element.bucket").alias("bucket"), "node", "size", (F.col("alone") + F.col("at")).alias("pos")), "blocks")


def components_in_buckets(members: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, pivots: int = 16) -> DataFrame:
    """(node, label) of all nodes that share a bucket; ``members``: bucket, first (its least node), node, size.

    First every member is compared with its bucket's first node. Nodes of buckets that still hold several components
    are then blocked anew by prefix filtering, which loses no similar pair. In rounds, a few members outside the
    largest component of each unsettled block (four times as many each round) are compared with the members of other
    components. It ends when each such member had its turn, so that every pair of a block is in one component or was
    compared; groups that do merge need few comparisons.
    """
    labels = materialise(members.select("node", F.col("node").alias("label")).distinct(), "labels")
    sets = _sets_of(labels.join(nodes, "node"), docs, width)
    sizes = nodes.select(F.col("node").alias("a"), F.col("size").alias("size_a"))
    fits = 100 * F.least("size", "size_a") >= percent * F.greatest("size", "size_a")
    ordered = [F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")]
    pairs = members.select(F.col("first").alias("a"), "node", "size").where("a <> node").distinct().join(sizes, "a").where(fits).select(*ordered)
    checked = materialise(pairs, "pairs")
    links = _confirmed(checked, sets, percent)
    if links.limit(1).count():
        labels = _merged(labels, links)
    mixed = members.select("bucket", "node").join(labels, "node").groupBy("bucket").agg((F.min("label") < F.max("label")).alias("open")).where("open").select("bucket")
    left = members.join(mixed, "bucket", "left_semi").select("node").distinct()
    sets = materialise(sets.join(left, "node", "left_semi"), "sets")
    blocks, used = _prefix_blocks(sets, percent), None
    reach = (100 + percent) * F.least(F.col("size") - F.col("pos"), F.col("size_a") - F.col("pos_a")) >= percent * (F.col("size") + F.col("size_a"))
    while True:
        state = blocks.join(labels, "node")
        groups = state.groupBy("bucket", "label").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.count("*").alias("groups"), F.max_by("label", F.struct("n", "label")).alias("largest")).where("groups > 1")
        open_ = materialise(state.join(groups, "bucket").select("bucket", "node", "size", "pos", "label", (F.col("label") == F.col("largest")).alias("main")), "open")
        turn = open_.where("not main")
        if used is not None:
            turn = turn.join(used, ["bucket", "node"], "left_anti")
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.xxhash64("node"), "node"))
        turn = materialise(turn.withColumn("rank", rank).where(F.col("rank") <= pivots).select("bucket", F.col("node").alias("a"), F.col("label").alias("label_a"), F.col("size").alias("size_a"), F.col("pos").alias("pos_a")), "turn")
        if not turn.limit(1).count():
            return labels
        done = turn.select("bucket", F.col("a").alias("node"))
        used = done if used is None else used.unionByName(done)
        pairs = turn.join(open_, "bucket").where((F.col("label") != F.col("label_a")) & fits & reach).select(*ordered).distinct()
        pairs = materialise(pairs.join(checked, ["a", "b"], "left_anti"), "pairs")
        checked = checked.unionByName(pairs)
        links = _confirmed(pairs, sets, percent)
        if links.limit(1).count():
            labels = _merged(labels, links)
        pivots *= 4


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 32, rows_per_band: int = 6) -> DataFrame:
    """Per document n_shingles, component_id (least doc_id reachable over links) and kept.

    The default banding fits thresholds of 85 and more; at 80, a pair just at the threshold is missed with 6e-5.
    """
    start = stages_so_far()
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    sketched = materialise(docs.mapInArrow(_sketched(width, bands, rows_per_band), "doc_id long, n_shingles long, set_key binary, buckets array<long>"), "sketches")
    linkable = sketched.where("doc_id is not null and n_shingles > 0")
    nodes = linkable.groupBy("set_key").agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("size"), F.first("buckets").alias("buckets"))
    nodes = materialise(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    bucketed = nodes.select("node", "size", F.explode("buckets").alias("bucket"))
    shared = bucketed.groupBy("bucket").agg(F.min("node").alias("first"), F.count("*").alias("n")).where("n > 1").select("bucket", "first")
    shared = materialise(shared, "shared")  # a plain side of the join, so that Spark can split a bucket with very many nodes
    members = materialise(bucketed.join(shared, "bucket").select("bucket", "first", "node", "size"), "buckets")
    keys = nodes.select("node", "rep", "size", "set_key")
    labels = components_in_buckets(members, docs, keys, width, percent)
    least = labels.join(keys, "node").groupBy("label").agg(F.min("rep").alias("component"))
    linked = labels.join(least, "label").join(keys, "node").select("set_key", "component")
    found = materialise(keys.select("set_key", "rep").join(linked, "set_key", "left").select("set_key", F.coalesce("component", "rep").alias("component")), "found")
    discard_since(docs.sparkSession, start, sketched, found)
    single = sketched.where("doc_id is null or n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    grouped = linkable.select("doc_id", "n_shingles", "set_key").join(found, "set_key").select("doc_id", "n_shingles", F.col("component").alias("component_id"))
    return grouped.unionByName(single).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
