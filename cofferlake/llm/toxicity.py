"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a logistic score over its hashed words; a document is toxic with
the probability that any sentence is, the noisy-or 1 - prod(1 - p). Only document labels are needed for training, and
the sentence scores then tell where the offence is.

Training reads a bounded sample of labelled documents (``max_train``: those whose id hashes lowest, each class up to
its share), so the model's cost does not grow with the corpus; words are counted by class in Spark, and the driver gets
only the few that tell the classes apart, with the sentences that hold them. Scoring covers every whole text.

Cases: null and empty texts have no sentence and score 0; repeated rows are scored one by one, and of rows that repeat
a labelled doc_id the least text trains; a null label is no label; with labels of one class only, every score is 0. A
null ``doc_id`` is scored and never trained on. Columns of ``docs`` named in ``keep`` pass through whatever their names
(``renamed`` gives score, predicted and offending other names where they would clash); the others are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofferlake.llm import textvec as tv
from cofferlake.llm.common import bounded_sample, discard, materialise

BITS = 18
#: Bytes of the beginnings that count as features, so that unseen inflections of an insult are known by its stem.
PREFIXES = (4, 5)
THRESHOLD = 0.5
_STOP = tv.byte_class(b".!?\n")


def sentence_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, ...]:
    """Hashed lower-case words and their beginnings, the sentence of each, and per sentence its document, start and end byte."""
    starts, ends = tv.runs(tv.TOKEN[data], offs[:-1])
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    doc = tv.owner(offs, starts)
    key = stops[starts] + doc  # grows at each stop and at each document
    first = np.ones(len(key), dtype=bool)
    first[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
    sentence = np.cumsum(first) - 1
    at = np.flatnonzero(first)
    last = np.append(at[1:], len(starts)) - 1 if len(at) else at
    words, owners = [tv.fingerprints(data, starts, ends, tv.LOWERED)], [sentence]
    for k in PREFIXES:
        longer = np.flatnonzero(ends - starts > k)
        words.append(tv.mix(tv.fingerprints(data, starts[longer], starts[longer] + k, tv.LOWERED) + np.uint64(k)))
        owners.append(sentence[longer])
    words, owners = (np.concatenate(words) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return words[order], owners[order], doc[at], starts[at], ends[last] if len(at) else at


def _bags(batches):
    for batch in batches:
        words, bags = [], []
        for _, _, data, offs in tv.text_slices(batch.column("text")):
            w, s, doc, _, _ = sentence_words(data, offs)
            cut = np.searchsorted(doc[s] if len(s) else s, np.arange(len(offs)))
            for i in range(len(offs) - 1):
                part = s[cut[i] : cut[i + 1]]
                words.append(w[cut[i] : cut[i + 1]].astype(np.int32))
                bags.append((part - part[0] if len(part) else part).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("toxic"), pa.array(words, pa.list_(pa.int32())), pa.array(bags, pa.list_(pa.int32()))], names=["doc_id", "toxic", "words", "sentences"])


def _softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def known_words(bags: DataFrame, least: int = 4, least_z: float = 4.5) -> np.ndarray:
    """Hashed words that tell the classes apart, counted in Spark over the bags (toxic, words).

    A word counts if ``least`` documents hold it and its shares in the two classes differ by ``least_z`` standard
    errors; rarer or evenly spread words would only let the model learn training documents by heart.
    """
    n1, n = bags.agg(F.sum("toxic"), F.count("*")).first()
    n1 = max(n1 or 0, 1)
    n0 = max(n - n1, 1)
    words = bags.select("toxic", F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("n"), F.sum("toxic").alias("n1"))
    share = F.col("n") / n
    error = F.sqrt(F.greatest(share * (1 - share), F.lit(1e-9)) * (1 / n1 + 1 / n0))
    z = (F.col("n1") / n1 - (F.col("n") - F.col("n1")) / n0) / error
    return np.array(sorted(r.word for r in words.where((F.col("n") >= least) & (F.abs(z) >= least_z)).select("word").collect()), dtype=np.int64)


def _known_pairs(known: np.ndarray):
    """Per bag the number of sentences, and the distinct pairs of a sentence and a known word that it holds."""

    def run(batches):
        for batch in batches:
            sizes, sentences, features = [], [], []
            for words, bag in zip(batch.column("words"), batch.column("sentences"), strict=True):
                words, bag = words.values.to_numpy().astype(np.int64), bag.values.to_numpy().astype(np.int64)
                at = np.minimum(np.searchsorted(known, words), max(len(known) - 1, 0))
                hit = known[at] == words if len(known) else np.zeros(len(words), bool)
                sentence, feature = np.divmod(np.unique(bag[hit] * max(len(known), 1) + at[hit]), max(len(known), 1))
                sizes.append(int(bag[-1]) + 1 if len(bag) else 0)
                sentences.append(sentence)
                features.append(feature)
            columns = [batch.column("doc_id"), batch.column("toxic"), pa.array(sizes, pa.int64()), pa.array(sentences, pa.list_(pa.int64())), pa.array(features, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "toxic", "n_sentences", "sentences", "features"])

    return run


def fit_noisy_or(feature: np.ndarray, where: np.ndarray, bag: np.ndarray, plain: np.ndarray, label: np.ndarray, weight: np.ndarray, k: int, l2: float = 2e-5, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Weights of the ``k`` known words and the intercept of a sentence.

    ``feature`` and ``where`` are the pairs of a word and a sentence, ``bag`` the document of each sentence with known
    words, ``plain`` the number of a document's other sentences. ``weight`` tells for how many documents each stands.
    """
    n, m = len(label), len(bag)
    sizes = np.maximum(np.bincount(bag, minlength=n) + plain, 1)
    weight = weight / weight.sum()
    b = float(np.log(max(weight @ label, 1e-3) / (weight @ sizes)))
    w = np.zeros(k)
    mom, var, mb, vb = np.zeros(k), np.zeros(k), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = b + np.bincount(where, weights=w[feature], minlength=m)
        none = -np.bincount(bag, weights=_softplus(z), minlength=n) - plain * _softplus(b)  # log of no toxic sentence
        none = np.minimum(none, -1e-9)
        p = 1 / (1 + np.exp(-z))
        slope = np.where(label == 1, -np.exp(none) / -np.expm1(none), 1.0) * weight
        gz = slope[bag] * p
        gw = np.bincount(feature, weights=gz[where], minlength=k) + l2 * w
        gb = gz.sum() + (slope * plain).sum() / (1 + np.exp(-b))
        mom, var = 0.9 * mom + 0.1 * gw, 0.999 * var + 0.001 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        step = 0.15 if t < rounds * 0.7 else 0.03
        w -= step * (mom / (1 - 0.9**t)) / (np.sqrt(var / (1 - 0.999**t)) + 1e-6)
        b -= step * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.999**t)) + 1e-6)
    return w, b


def in_training(doc_id) -> F.Column:
    return F.crc32(F.col(doc_id).cast("string")) % 5 != 0


def train_toxicity(docs: DataFrame, labels: DataFrame, max_train: int = 3000) -> tuple[np.ndarray, float] | None:
    labels = labels.where("toxic in (0, 1) and doc_id is not null").where(in_training("doc_id")).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    most = {1: max_train // 2, 0: max_train - max_train // 2}
    use = bounded_sample(labels.where("toxic = 1"), "doc_id", most[1]).unionByName(bounded_sample(labels.where("toxic = 0"), "doc_id", most[0]))
    # Each sampled document stands for its share of all training labels of its class.
    stands_for = {c: max(1.0, n / most[c]) for c, n in labels.groupBy("toxic").count().collect()}
    # Of rows that repeat a labelled doc_id the least text counts.
    sample = docs.select("doc_id", "text").join(F.broadcast(use), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    bags = materialise(sample.mapInArrow(_bags, "doc_id long, toxic int, words array<int>, sentences array<int>"), "bags")
    known = known_words(bags)
    rows = bags.mapInArrow(_known_pairs(known), "doc_id long, toxic int, n_sentences long, sentences array<long>, features array<long>").toPandas().sort_values("doc_id")
    discard(bags)
    if rows["toxic"].nunique() < 2:
        return None
    bag, where, begin = [], [], 0
    for i, sentences in enumerate(rows["sentences"]):
        distinct, place = np.unique(sentences, return_inverse=True)
        bag.append(np.full(len(distinct), i))
        where.append(begin + place)
        begin += len(distinct)
    bag, where = np.concatenate(bag).astype(np.int64), np.concatenate(where).astype(np.int64)
    plain = rows["n_sentences"].to_numpy() - np.bincount(bag, minlength=len(rows))
    w, b = fit_noisy_or(np.concatenate(list(rows["features"])).astype(np.int64), where, bag, plain, rows["toxic"].to_numpy(), rows["toxic"].map(stands_for).to_numpy(), len(known))
    full = np.zeros(1 << BITS)
    full[known] = w
    return full, b


def toxicity_scores(docs: DataFrame, labels: DataFrame, max_train: int = 3000, keep: list[str] | None = None, renamed: dict[str, str] | None = None) -> DataFrame:
    """doc_id, score, predicted, and ``offending``: start and end byte and score of each sentence at or above one half.

    ``keep`` names columns of ``docs`` to carry along (doc_id alone by default), ``renamed`` other names of the results.
    """
    named = {c: c for c in ("score", "offending", "predicted")} | (renamed or {})
    model = docs.sparkSession.sparkContext.broadcast(train_toxicity(docs, labels, max_train))
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def score(batches):
        m = model.value
        for batch in batches:
            total, found = [], []
            for _, _, data, offs in tv.text_slices(batch.column("text")):
                n = len(offs) - 1
                here = [[] for _ in range(n)]
                if m is None or not len(data):
                    total.append(np.zeros(n))
                    found += here
                    continue
                w, s, doc, start, end = sentence_words(data, offs)
                pairs = np.unique(s * (1 << BITS) + w)
                z = m[1] + np.bincount(pairs >> BITS, weights=m[0][pairs & ((1 << BITS) - 1)], minlength=len(doc))
                total.append(-np.expm1(np.bincount(doc, weights=-_softplus(z), minlength=n)))
                p = 1 / (1 + np.exp(-z))
                for i in np.flatnonzero(p >= THRESHOLD):
                    d = doc[i]
                    here[d].append({"start": int(start[i] - offs[d]), "end": int(end[i] - offs[d]), "score": float(p[i])})
                found += here
            value = np.clip(np.concatenate(total) if total else np.zeros(0), 0, 1)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(value), pa.array(found, spans)], names=[*keep, named["score"], named["offending"]])

    keep = keep or ["doc_id"]
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long")).select(*dict.fromkeys([*keep, "text"]))
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.schema if f.name in keep)
    keep = [f.name for f in docs.schema if f.name in keep]
    out = docs.mapInArrow(score, kinds + f"`{named['score']}` double, `{named['offending']}` array<struct<start:long,end:long,score:double>>")
    return out.withColumn(named["predicted"], (F.col(named["score"]) >= THRESHOLD).cast("int"))
