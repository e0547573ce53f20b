"""What the learned operators work out, against models solved by hand and against scores worked out plainly."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from cofferlake.llm import quality, toxicity
from cofferlake.llm import textvec as tv

SF_DIR = "/root/testdata/sf0.001"
ODD_TEXTS = ["", None, " \n ", "..!?", "a", "no\x00w. ab", "Für Öl! naïve 東京 words\x0b\n\nwords", "x" * 50_000, "so many words. " * 4_000]


@pytest.fixture(scope="module")
def docs(spark):
    odd = spark.createDataFrame([(-i, t) for i, t in enumerate(ODD_TEXTS, 1)], "doc_id long, text string")
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").unionByName(odd).dropDuplicates(["doc_id"]).cache()


def _hash(word: bytes, values) -> int:
    return int(tv.fingerprints(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]), values)[0])


def _chance(z: float) -> float:
    return 1 / (1 + math.exp(-z))


def test_noisy_or_of_one_sentence_is_a_logistic_regression():
    """Of four documents with the word three are toxic, of four without it one."""
    label, weight = np.array([1, 1, 1, 0, 1, 0, 0, 0]), np.ones(8)
    w, b = toxicity.fit_noisy_or(np.zeros(4, np.int64), np.arange(4), np.arange(4), np.array([0, 0, 0, 0, 1, 1, 1, 1]), label, weight, 1, rounds=1500)
    assert math.isclose(w[0], 2 * math.log(3), abs_tol=0.02) and math.isclose(b, -math.log(3), abs_tol=0.02)


def test_noisy_or_of_two_sentences():
    """36 % of documents of two plain sentences are toxic: a sentence is with 20 %, as 1 - 0.8 ** 2 = 0.36."""
    label, none = np.repeat([1, 0], [9, 16]), np.zeros(0, np.int64)
    _, b = toxicity.fit_noisy_or(none, none, none, np.full(25, 2), label, np.ones(25), 0, rounds=1500)
    assert math.isclose(_chance(b), 0.2, abs_tol=0.005)


def test_logistic_regression_by_hand():
    x, y = np.repeat([[1.0], [0.0]], 4, axis=0).astype(np.float32), np.array([1, 1, 1, 0, 1, 0, 0, 0], np.float32)
    w, b = quality.fit_logistic(x, y, np.ones(8), 1e-6, 2000)
    assert math.isclose(w[0], 2 * math.log(3), abs_tol=0.01) and math.isclose(b, -math.log(3), abs_tol=0.01)
    w, b = quality.fit_logistic(x, y, np.array([1, 1, 1, 3, 1, 1, 1, 1.0]), 1e-6, 2000)
    assert math.isclose(_chance(w[0] + b), 0.5, abs_tol=0.005) and math.isclose(_chance(b), 0.25, abs_tol=0.005)


def test_toxicity_of_every_document(docs, monkeypatch):
    weights = np.random.default_rng(1).normal(0, 0.4, 1 << toxicity.BITS)
    monkeypatch.setattr(toxicity, "train_toxicity", lambda *_: (weights, -3.0))
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs, docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    n_offending = 0
    for r in rows:
        text, clean, offending, at = (r.text or "").encode(), 1.0, [], 0
        for sentence in re.split(rb"(?<=[.!?\n])", text):
            tokens = list(re.finditer(rb"[0-9A-Za-z\x80-\xff]+", sentence))
            words = [m.group() for m in tokens]
            keys = {_hash(w, tv.LOWERED) for w in words}
            with np.errstate(over="ignore"):
                keys |= {int(tv.mix(np.uint64(_hash(w[:k], tv.LOWERED)) + np.uint64(k))) for w in words for k in toxicity.PREFIXES if len(w) > k}
            if tokens:
                p = _chance(-3.0 + sum(weights[f] for f in {k >> 64 - toxicity.BITS for k in keys}))
                clean *= 1 - p
                if p >= toxicity.THRESHOLD:
                    offending.append((at + tokens[0].start(), at + tokens[-1].end(), p))
            at += len(sentence)
        got = found[r.doc_id]
        assert math.isclose(got.score, 1 - clean, abs_tol=1e-9) and got.predicted == (got.score >= 0.5), r.doc_id
        assert [(s.start, s.end) for s in got.offending] == [s[:2] for s in offending]
        assert all(math.isclose(s.score, p, abs_tol=1e-9) for s, (_, _, p) in zip(got.offending, offending))
        n_offending += len(offending)
    assert n_offending > 20


def test_quality_of_every_document(docs, monkeypatch):
    rng = np.random.default_rng(2)
    model = {"weights": rng.normal(0, 3, quality.N_FEATURES), "intercept": 0.2, "slope": 0.7, "shift": -0.1}
    monkeypatch.setattr(quality, "train_quality", lambda *_: model)
    found = {r.doc_id: r for r in quality.quality_scores(docs, docs).collect()}
    rows = docs.collect()
    assert len(found) == len(rows)
    odd = [int(x) for x in quality._ODD]
    for r in rows:
        text = r.text or ""
        words = Counter(_hash(w.encode(), tv.AS_WRITTEN) >> 64 - quality.WORD_BITS for w in re.findall(r"[^\x20\x09-\x0D]+", text))
        numbers = [32 if c in " \t\n\x0b\f\r" else int.from_bytes(c.encode(), "little") for c in text]
        grams = Counter()
        for three in zip(numbers, numbers[1:], numbers[2:]):
            h = sum(c * o for c, o in zip(three, odd)) & 0xFFFFFFFF
            grams[((h ^ h >> 15) * odd[0] & 0xFFFFFFFF) >> 32 - quality.GRAM_BITS] += 1
        z = 0.2
        for first, counts in ((0, words), (1 << quality.WORD_BITS, grams)):
            z += sum(model["weights"][first + f] * math.sqrt(n / counts.total()) for f, n in counts.items())
        got = found[r.doc_id]
        assert math.isclose(got.probability, _chance(0.7 * z - 0.1), abs_tol=1e-9), r.doc_id
        assert got.kept == (not got.base_failed and got.probability >= quality.KEEP_PROBABILITY)
    assert 0 < sum(r.kept for r in found.values()) < len(rows)
