import hashlib

import numpy as np
import pytest

from cofferlake.llm.suffix_dedup import _grouped, remove_repeats

HOT = "this passage of more than fifty bytes stands in very many of the documents"
TEXTS = [*(f"{i} start {HOT[i % 9:]} and an end {i * i}" for i in range(30)), "long " * 20000, "a short one", "long " * 300 + HOT]


@pytest.mark.parametrize("split", [1, 2, 2000])
def test_repeats_above_and_below_split(spark, split):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    rows = {r.doc_id: r for r in remove_repeats(docs, split=split).collect()}
    seen = set()
    for i, text in enumerate(TEXTS):
        data = text.encode()
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = np.zeros(len(data) + 1, bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(windows)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        starts = int((gone[1:] & ~gone[:-1]).sum() + gone[0])
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(data), int(gone.sum()), starts, hashlib.sha256(kept).hexdigest())


def _plain(texts):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, ids being their places."""
    seen, out = set(), []
    for text in texts:
        data = text.encode()
        windows = [data[k : k + 50] for k in range(len(data) - 49)]
        gone = np.zeros(len(data) + 1, bool)
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = True
        seen.update(windows)
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out.append((len(data), int(gone.sum()), int((gone[1:] & ~gone[:-1]).sum() + gone[0]), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [1, 2000])
def test_passages_that_end_in_zero_characters(spark, split):
    """Zero characters, which also fill up stretches, in both orders of ids and in random texts over few characters."""
    chance = np.random.default_rng(4)
    word = lambda n, letters="abcdefghijklmnopqrstuvwxyz": "".join(chance.choice(list(letters), n))
    texts = []
    for _ in range(6):
        x, y = word(50), word(80)
        texts += [x + "\0", x, y, word(50)]
        texts += [texts[-1] + "\0", texts[-1] + "\0" + word(40, "0123456789"), texts[-1] + "\0\0\0", word(90), "\0" * int(chance.integers(40, 120))]
    base = [word(70, "\0a") for _ in range(8)]
    for _ in range(60):
        a, b = base[int(chance.integers(8))], base[int(chance.integers(8))]
        texts.append(a[int(chance.integers(10)) :] + "\0" * int(chance.integers(4)) + b[: int(chance.integers(71))] + word(int(chance.integers(3)), "\0b"))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    rows = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs, split=split).collect()}
    assert [rows[i] for i in range(len(texts))] == _plain(texts)


def test_two_stretches_with_one_hash():
    """Bytes decide where hashes agree."""
    rows = np.zeros((5, 80), np.uint8)
    rows[[0, 2, 4], 3] = 7
    same = np.zeros(5, np.uint64)
    order, at = _grouped(rows, np.ones(5, np.int64), same, same, np.array([9, 1, 5, 0, 3]))
    groups = [sorted(order[a:b].tolist()) for a, b in zip(at, np.append(at[1:], 5))]
    assert sorted(groups) == [[0, 2, 4], [1, 3]]
    assert {order[a] for a in at} == {3, 4}  # each with its least id first
