"""Quality rules: repetition counts and a calibrated n-gram classifier.

``quality_scores(docs, labels)`` learns logistic regression over hashed words and character trigrams from labelled
rows, calibrates it on rows that training left out, and scores every whole text in Arrow batches against fixed
thresholds. Training reads a bounded sample: ``max_train`` labelled documents, those whose id hashes lowest; each sends
the driver its distinct features, some 6000 at most.

Cases: null or empty text has no words, so it fails the base rule and is not kept; repeated rows are scored one by
one; rows without a label or with a null label only take part in scoring; without usable labels of both classes the
model is neutral (probability 1), so the base rules alone decide; other columns of ``docs`` are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofferlake.llm import textvec as tv
from cofferlake.llm.common import bounded_sample

#: Fixed thresholds of the base rule and of the model.
MIN_WORDS, MAX_REPEAT_PERCENT, KEEP_PROBABILITY = 50, 50, 0.5
WORD_BITS, GRAM_BITS = 11, 12
N_FEATURES = (1 << WORD_BITS) + (1 << GRAM_BITS)

_SYMBOL = tv.byte_class(b"#*$%&|<>")
_SPACE_SHAPE = np.where(tv.SPACE, 32, np.arange(256)).astype(np.uint32)
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)

COUNTS = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def characters(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each character, its UTF-8 bytes (all white space is a blank), and how many each document has."""
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    chars, size = _SPACE_SHAPE[data[lead]], np.diff(np.append(lead, len(data)))
    for k in (1, 2, 3):
        longer = np.flatnonzero(size > k)
        chars[longer] |= data[lead[longer] + k].astype(np.uint32) << np.uint32(8 * k)
    return chars, np.diff(np.searchsorted(lead, offs))


def hashed_features(data: np.ndarray, offs: np.ndarray, words: np.ndarray, owners: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """(feature, document) of every word and of every trigram of characters within a document."""
    word = (words >> np.uint64(64 - WORD_BITS)).astype(np.int64)
    out = [(word, owners)]
    chars, per_doc = characters(data, offs)
    if len(chars) >= 3:
        gram = chars[:-2] * _ODD[0] + chars[1:-1] * _ODD[1] + chars[2:] * _ODD[2]
        gram = (gram ^ gram >> np.uint32(15)) * _ODD[0] >> np.uint32(32 - GRAM_BITS)
        doc = np.repeat(np.arange(len(offs) - 1), per_doc)
        same = doc[2:] == doc[:-2]
        out.append((gram[same].astype(np.int64) + (1 << WORD_BITS), doc[2:][same]))
    return out


def base_counts(data: np.ndarray, offs: np.ndarray, starts: np.ndarray, ends: np.ndarray, words: np.ndarray, owners: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    first = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    symbols = np.concatenate([[0], np.cumsum(_SYMBOL[data])])
    out = {
        "n_words": np.bincount(owners, minlength=n),
        "word_chars": tv.sums(first[ends] - first[starts], owners, n).astype(np.int64),
        "n_symbols": symbols[offs[1:]] - symbols[offs[:-1]],
    }
    line_starts, line_ends = tv.runs(data != 10, offs[:-1])
    inside = np.concatenate([[0], np.cumsum(~tv.SPACE[data])])
    full = inside[line_ends] > inside[line_starts]
    line_starts, line_ends = line_starts[full], line_ends[full]
    lines, line_owner = tv.fingerprints(data, line_starts, line_ends), tv.owner(offs, line_starts)
    _, at = np.unique(tv.mix(lines + line_owner.astype(np.uint64)), return_index=True)
    out["n_dup_lines"] = np.bincount(line_owner, minlength=n) - np.bincount(line_owner[at], minlength=n)
    grams, at = tv.shingles3(words, owners)
    _, where, count = np.unique(tv.mix(grams + owners[at].astype(np.uint64)), return_inverse=True, return_counts=True)
    covered = np.zeros(len(words), dtype=bool)
    twice = at[count[where] > 1]
    for k in range(3):
        covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(owners[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def _words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    starts, ends = tv.runs(tv.WORD[data], offs[:-1])
    return starts, ends, tv.fingerprints(data, starts, ends), tv.owner(offs, starts)


def _training_rows(batches):
    """Per labelled document its distinct features and their shares."""
    for batch in batches:
        ids, label = batch.column("doc_id"), batch.column("quality")
        feats, shares = [], []
        for _, _, data, offs in tv.text_slices(batch.column("text")):
            n = len(offs) - 1
            _, _, words, owners = _words(data, offs)
            per = [[np.zeros(0, np.int64), np.zeros(0)] for _ in range(n)]
            for feature, doc in hashed_features(data, offs, words, owners):
                key, count = np.unique(doc * N_FEATURES + feature, return_counts=True)
                cut = np.searchsorted(key, np.arange(n + 1) * N_FEATURES)
                for i in range(n):
                    part = slice(cut[i], cut[i + 1])
                    total = count[part].sum()
                    per[i][0] = np.concatenate([per[i][0], key[part] % N_FEATURES])
                    per[i][1] = np.concatenate([per[i][1], count[part] / max(total, 1)])
            feats += [p[0].astype(np.int32) for p in per]
            shares += [p[1].astype(np.float32) for p in per]
        yield pa.RecordBatch.from_arrays([ids, label, pa.array(feats, pa.list_(pa.int32())), pa.array(shares, pa.list_(pa.float32()))], names=["doc_id", "quality", "feature", "share"])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float]:
    """Weighted logistic regression by Nesterov steps under the curvature bound of the logistic loss."""
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, vb, t = w.copy(), b, 1.0
    weight = (weight / weight.sum()).astype(np.float32)
    probe = np.random.default_rng(0).normal(size=x.shape[1]).astype(np.float32)
    for _ in range(15):
        probe /= np.linalg.norm(probe)
        probe = x.T @ (weight * (x @ probe))
    step = 1 / (0.25 * (np.linalg.norm(probe) + 1) + l2)
    for _ in range(rounds):
        g = weight * (_sigmoid(x @ v + vb) - y).astype(np.float32)
        nw, nb = v - step * (x.T @ g + l2 * v), vb - step * g.sum()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb, t = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b), nt
        w, b = nw.astype(np.float32), float(nb)
    return w, b


def train_quality(docs: DataFrame, labels: DataFrame, max_train: int = 2000) -> dict | None:
    """Weights, intercept and Platt calibration; None if the labels do not hold both classes."""
    use = bounded_sample(labels.where("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("int").alias("quality")), "doc_id", max_train)
    # Of rows that repeat a labelled doc_id the least text counts.
    sample = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    rows = sample.mapInArrow(_training_rows, "doc_id long, quality int, feature array<int>, share array<float>").toPandas()
    rows = rows.sort_values("doc_id", kind="stable")
    if rows["quality"].nunique() < 2:
        return None
    x = np.zeros((len(rows), N_FEATURES), np.float32)
    for i, (f, s) in enumerate(zip(rows["feature"], rows["share"], strict=True)):
        x[i, f] = np.sqrt(s)
    y = rows["quality"].to_numpy(np.float32)
    held = np.arange(len(rows)) % 4 == 0
    if len(set(y[held])) < 2 or len(set(y[~held])) < 2:
        held[:] = False
    check = held if held.any() else ~held
    w, b = fit_logistic(x, y, (~held).astype(np.float64), 1e-4, 150)
    score = (x @ w + b)[:, None].astype(np.float32)
    a, c = fit_logistic(score, y, check.astype(np.float64), 1e-4, 400)
    return {"weights": w.astype(np.float64), "intercept": b, "slope": float(a[0]), "shift": c}


def quality_scores(docs: DataFrame, labels: DataFrame, max_train: int = 2000) -> DataFrame:
    """Per document the base counts, the calibrated probability of good quality, and the verdict."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train_quality(docs, labels, max_train))

    def score(batches):
        m = model.value
        for batch in batches:
            parts = []
            for _, _, data, offs in tv.text_slices(batch.column("text")):
                n = len(offs) - 1
                starts, ends, words, owners = _words(data, offs)
                part = base_counts(data, offs, starts, ends, words, owners)
                p = np.ones(n)
                if m is not None:
                    z = np.full(n, m["intercept"])
                    for feature, doc in hashed_features(data, offs, words, owners):
                        key, count = np.unique(doc * N_FEATURES + feature, return_counts=True)
                        owner, feature = key // N_FEATURES, key % N_FEATURES
                        total = np.bincount(owner, weights=count, minlength=n)
                        z += np.bincount(owner, weights=m["weights"][feature] * np.sqrt(count / total[owner]), minlength=n)
                    p = _sigmoid(m["slope"] * z + m["shift"])
                parts.append(pd.DataFrame(part | {"probability": p}))
            frame = pd.concat(parts) if parts else pd.DataFrame(columns=[*COUNTS.replace(" long", "").split(", ")[1:], "probability"])
            columns = [pa.array(frame[c].to_numpy(np.int64)) for c in frame.columns[:-1]] + [pa.array(frame["probability"].to_numpy(np.float64))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names=["doc_id", *frame.columns])

    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, f"doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return scored.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("probability") >= KEEP_PROBABILITY))
