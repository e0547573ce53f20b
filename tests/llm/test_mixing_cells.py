import pytest

from cofferlake.llm.mixing import sampled_copies


@pytest.mark.parametrize("cell_rows", [3, 30, 50_000])
def test_ranks_follow_size_and_id_in_cells_of_any_size(spark, cell_rows):
    sizes = [(None if i == 7 else i * 7919 % 1009, ["a", None][i % 5 == 0], 40 if i % 2 else i % 90) for i in range(1000)]
    out = sampled_copies(spark.createDataFrame(sizes, "doc_id long, source string, size long").repartition(3), cell_rows=cell_rows)
    rows = [(r.source, r.size, r.doc_id is None, r.doc_id or 0, r.copies, r.target / r.source_size) for r in out.collect()]
    assert len(rows) == 1000
    for source in ("a", None):
        mine = sorted(r[1:] for r in rows if r[0] == source)
        copies, rate = [r[3] for r in mine], mine[0][4]
        total = 0
        for n, c in enumerate(copies, 1):
            total += c
            assert abs(total - n * rate) < 1 + 1e-6
        # In order of size and id, a document gets one more copy exactly where the running sum crosses a whole number.
        offset = next(o for o in (k / 4000 for k in range(4000)) if all(int((n + 1) * rate + o) - int(n * rate + o) == c for n, c in enumerate(copies)))
        assert 0 <= offset < 1


def test_a_third_of_the_rows_may_be_equal(spark):
    """Equal rows are cut like others: with null ids, one id or one row, whatever the ranges."""
    rows = [(None, "hot", 10)] * 400 + [(7, "hot", 10)] * 300 + [(i, "cold", i % 50) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, size long").repartition(5)
    totals = []
    for cell_rows in (20, 1_000):
        out = sampled_copies(docs, cell_rows=cell_rows).collect()
        assert len(out) == 1_000
        taken = {s: sum(r.copies * r.size for r in out if r.source == s) for s in ("hot", "cold")}
        assert all(abs(taken[r.source] - r.target) <= 50 for r in out) and max(r.copies for r in out) <= 2
        totals.append(sorted((r.source, r.doc_id is None, r.size, r.copies) for r in out))
    assert totals[0] == totals[1]
