"""Shards by a weighted hash tree: the law, confined moves, gapless slots, hot ids and copies."""

import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cofferlake.llm.sharding import grown, shard_of, sharded, uniform_layout

ODD = [(None, "same"), (None, "same"), (None, None), (1, "x"), (1, "x"), (1, "y"), (2, ""), (3, None), (4, "Ünïcode"), *[(5, "hot") for _ in range(50)], *[(None, f"null id {i}") for i in range(40)]]


@pytest.fixture(scope="module")
def keys(spark):
    return spark.range(20_000).select(F.col("id").cast("string").alias("key")).cache()


def _places(keys, layout):
    return {r.key: r.s for r in keys.select("key", shard_of(F.col("key"), layout).alias("s")).collect()}


def test_weights_are_met_and_growth_fills_only_the_new_shard(keys):
    layout = {"a": {"a0": {0: 1.0, 1: 3.0}, "a1": {2: 2.0}}, "b": {"b0": {3: 4.0, 4: 0.0}}}
    old, new = _places(keys, layout), _places(keys, grown(layout, 2.0))
    counts = Counter(old.values())
    assert all(abs(counts[s] / 20_000 - w / 10) < 0.015 for s, w in ((0, 1), (1, 3), (2, 2), (3, 4), (4, 0)))
    moved = [k for k in old if old[k] != new[k]]
    assert {new[k] for k in moved} == {5} and abs(len(moved) / 20_000 - 2 / 12) < 0.015


def test_moves_are_confined_to_subtrees_whose_weights_change(keys):
    layout = uniform_layout(16)
    heavier = {r: {k: {s: 2.5 if s == 5 else w for s, w in shards.items()} for k, shards in racks.items()} for r, racks in layout.items()}
    old, new = _places(keys, layout), _places(keys, heavier)
    region, rack = (lambda s: s // 8), (lambda s: s // 4)
    for k in old:
        if old[k] == new[k]:
            continue
        assert region(new[k]) == region(5)  # rows only enter the region that became heavier
        if region(old[k]) == region(5):
            assert rack(new[k]) == rack(5)  # within it only the rack
            assert rack(old[k]) != rack(5) or new[k] == 5  # within that only the shard


def test_every_row_has_its_own_slot_and_hot_rows_are_split(spark):
    docs = spark.createDataFrame([(*r, "c", "r") for r in ODD], "doc_id long, text string, cell string, round string").repartition(3)
    for sizes in ({}, {"round_size": 7, "per_cell": 1}):
        rows = sharded(docs, **sizes).collect()
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in ODD)
        by_shard = {}
        for r in rows:
            by_shard.setdefault(r.shard, []).append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in by_shard.values())
        assert len({(r.doc_id, r.shard, r.grown_shard) for r in rows}) == len({i for i, _ in ODD})  # the key decides
        assert all(r.grown_shard in (r.shard, 16) and r.law == "key" for r in rows)
    assert sharded(docs.limit(0)).count() == 0


def test_a_layout_needs_a_weight(keys):
    with pytest.raises(ValueError):
        shard_of(F.col("key"), {"a": {"b": {0: 0.0}}})
    with pytest.raises(ValueError):
        shard_of(F.col("key"), {"a": {"b": {0: -1.0}}})
