"""Approximate nearest neighbours by shifted space-filling curves.

Every curve has a random rotation to a few dimensions and a random shift; a vector's place on the curve is its Hilbert
key. Largest inner product becomes nearness by one more coordinate that gives all rows the same norm. Rows and queries
travel once for each curve, as a key and one byte for each component, range-partitioned and sorted by curve and key. A
task streams its range: every query meets the rows within ``window`` places on either side and keeps the best by the
rounded components. The windows of all curves merge, and the best of them are ranked anew by the original vectors in
double precision.

The window follows a power of the number of rows, ``window * rows ** growth``, at least k + 1: the more rows, the nearer
the neighbours and the smaller the share of rows that has to be seen. Recall depends on that, on the number of curves
and on the data; vectors without any structure are the worst case. A range never holds fewer than 16 windows or 65,536
rows of one or more curves, so what a query misses at the ends of ranges is small, and other curves have other ends.

Equal vectors are one place: it carries their k + 1 smallest ids, which is all that an answer can need of them, and the
ranking expands it. Equal queries are searched together, by some 1000 at most, for k + 1 ids; each drops its own.

Cases: null vectors, zero vectors and those with null or non-finite components take no part, nor do rows with a null
id or a length other than the most common one; a row never finds its own id; rows that repeat an id count once, with
the best score; ties go to the smaller id; fewer candidates than ``k`` give fewer rows; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofferlake.llm.common import materialise

DIMENSIONS, BITS = 16, 3
#: Rows in a range at least; inner products made at a time.
RANGE, PRODUCTS = 65_536, 1 << 23


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place of each integer point (n, d) on the Hilbert curve, by Skilling's transform."""
    x = cells.astype(np.int64).T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(d):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] ^= np.where(high, p, swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, d):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t ^= np.where((x[d - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= t
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = key << 1 | (x[i] >> b & 1)
    return key


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, size)


_STREAM = "curve int, key long, place long, lead long, code binary, scale float"


def _keyed(size: int, longest: float, curves: int, as_query: bool, seed: int):
    """Each vector once for each curve: key, place (-1 less the place for a query), least id, rounded components."""
    rng = np.random.default_rng(seed)
    turns = [np.linalg.qr(rng.normal(size=(size + 1, size + 1)))[0][:, : min(DIMENSIONS, size + 1)] for _ in range(curves)]
    shifts = [rng.random(t.shape[1]) for t in turns]
    bits = min(16, max(BITS, 48 // min(DIMENSIONS, size + 1)))
    reach = 3.5 / math.sqrt(size + 1)

    def run(batches):
        for batch in batches:
            for lo in range(0, batch.num_rows, 2000):
                part = batch.slice(lo, 2000)
                x = _matrix(part.column("vector"), size)
                if as_query:
                    unit = np.column_stack([x / np.linalg.norm(x, axis=1, keepdims=True), np.zeros(len(x))])
                else:
                    unit = x / longest
                    unit = np.column_stack([unit, np.sqrt(np.maximum(0, 1 - (unit * unit).sum(axis=1)))])
                place = part.column("place").to_numpy()
                place = -1 - place if as_query else place
                scale = np.abs(x).max(axis=1) / 127
                code = np.rint(x / scale[:, None]).astype(np.int8)
                codes = pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(0, size * len(x) + 1, size, dtype=np.int32)), pa.py_buffer(code.tobytes())])
                for c, (turn, shift) in enumerate(zip(turns, shifts, strict=True)):
                    cell = (np.clip(unit @ turn / (2 * reach) + 0.5, 0, 1) + shift) / 2
                    key = hilbert_keys(np.minimum(cell * (1 << bits), (1 << bits) - 1), bits)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), c, np.int32)), pa.array(key), pa.array(place), part.column("lead"), codes, pa.array(scale.astype(np.float32))], names=["curve", "key", "place", "lead", "code", "scale"])

    return run


def _first_distinct(leads: np.ndarray, n: int) -> np.ndarray:
    """Positions of the first ``n`` different values, in order."""
    return np.sort(np.unique(leads, return_index=True)[1])[:n]


def _windows(size: int, k: int, window: int):
    """For each query of a range the ``k`` best different ids among the rows within ``window`` places, packed."""

    def answers(place, lead, code, scale, done: int, last: bool):
        """Of the queries from ``done`` on those whose window is complete, and how far that was."""
        is_row = place >= 0
        rows = np.flatnonzero(is_row)
        before = np.cumsum(is_row) - is_row  # rows before each entry
        asked = done + np.flatnonzero(~is_row[done:])
        ready = asked if last else asked[before[asked] + window <= len(rows)]
        x = code[rows].astype(np.float32) * scale[rows, None]
        out = []
        spots, lo = before[ready], 0
        while lo < len(ready):
            # Queries close together share their rows: half a window more than each one's own.
            hi = int(np.searchsorted(spots, spots[lo] + window // 2, "right"))
            q, lo = ready[lo:hi], hi
            a, b = max(before[q[0]] - window, 0), min(before[q[-1]] + window, len(rows))
            step = max(1, PRODUCTS // max(b - a, 1))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                scores = (code[some].astype(np.float32) * scale[some, None]) @ x[a:b].T
                for i, line in zip(some, scores):
                    take = 2 * k
                    while True:
                        best = np.argpartition(line, len(line) - take)[len(line) - take :] if len(line) > take else np.arange(len(line))
                        best = best[np.lexsort((lead[rows[a + best]], -line[best]))]
                        first = best[_first_distinct(lead[rows[a + best]], k)]
                        if len(first) == k or len(best) == len(line):
                            break
                        take *= 4  # ids that stand at several vectors
                    found = rows[a + first]
                    out.append((-1 - place[i], place[found].tobytes() + lead[found].tobytes() + line[first].astype("<f4").tobytes()))
        reached = len(place) if last or len(ready) == len(asked) else asked[len(ready)]
        return out, int(reached)

    def run(batches):
        curve, held, done, fresh = None, None, 0, 0

        def flush(last: bool):
            nonlocal held, done, fresh
            out, done = answers(*held, done, last)
            if not last and done < len(held[0]):
                rows = np.flatnonzero(held[0][:done] >= 0)
                keep = rows[-window - 1] if len(rows) > window else 0
                held, done = [h[keep:] for h in held], done - keep
            elif not last:
                rows = np.flatnonzero(held[0] >= 0)
                keep = rows[-window - 1] if len(rows) > window else 0
                held, done = [h[keep:] for h in held], len(held[0]) - keep
            fresh = 0
            return pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.int64()), pa.array([o[1] for o in out], pa.binary())], names=["place", "hits"])

        for batch in batches:
            number = batch.column("curve").to_numpy()
            code = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.int8).reshape(-1, size)
            columns = [batch.column("place").to_numpy(), batch.column("lead").to_numpy(), code, batch.column("scale").to_numpy()]
            cut = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]])) if len(number) else np.zeros(0, np.int64)
            for a, b in zip(cut, np.append(cut[1:], len(number))):
                if held is not None and number[a] != curve:
                    yield flush(True)
                    held, done = None, 0
                curve = number[a]
                part = [c[a:b] for c in columns]
                held = part if held is None else [np.concatenate(x) for x in zip(held, part)]
                fresh += b - a
                if fresh > max(20_000, 2 * window):
                    yield flush(False)
        if held is not None:
            yield flush(True)

    return run


_HITS = "array<struct<away:double,vec_id:long>>"


def _merged(k: int):
    """For each query the ``k`` best different ids by rounded components of all its windows, as places to rank anew."""

    def run(batches):
        for batch in batches:
            asked, found = [], []
            for place, hits in zip(batch.column("place").to_pylist(), batch.column("hits").to_pylist()):
                sizes = [len(h) // 20 for h in hits]
                places = np.concatenate([np.frombuffer(h, "<i8", n) for h, n in zip(hits, sizes)])
                leads = np.concatenate([np.frombuffer(h, "<i8", n, 8 * n) for h, n in zip(hits, sizes)])
                score = np.concatenate([np.frombuffer(h, "<f4", n, 16 * n) for h, n in zip(hits, sizes)])
                order = np.lexsort((leads, -score))
                best = order[_first_distinct(leads[order], k)]
                asked.append(np.full(len(best), place, np.int64))
                found.append(places[best])
            if asked:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(asked)), pa.array(np.concatenate(found))], names=["query", "place"])

    return run


def _distinct(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` distinct ids by score and id, each with its best score."""
    order = np.lexsort((ids, -scores))
    first = np.sort(np.unique(ids[order], return_index=True)[1])[:k]
    return ids[order][first], scores[order][first]


def _ranked(k: int):
    """Own hits left out, the first ``k`` distinct ids of all blocks for each id that asks."""

    def run(batches):
        for batch in batches:
            out = [[np.zeros(0, t)] for t in (np.int64, np.int32, np.int64, np.float64)]
            for members, found in zip(batch.column("ids"), batch.column("found"), strict=True):
                hits = found.values
                ids, scores = _distinct(hits.field("vec_id").to_numpy(), -hits.field("away").to_numpy(), k + 1)
                for own in members.values.to_numpy():
                    other = np.flatnonzero(ids != own)[:k]
                    for column, values in zip(out, (np.full(len(other), own), np.arange(1, len(other) + 1, dtype=np.int32), ids[other], scores[other]), strict=True):
                        column.append(values)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=["query_id", "rank", "vec_id", "score"])

    return run


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, curves: int = 32, window: float = 0.05, growth: float = 0.85, seed: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score for ``queries`` and ``vectors``, both (vec_id, embedding)."""

    def usable(df: DataFrame) -> DataFrame:
        vector = F.transform("embedding", lambda x: x.cast("double"))
        df = df.select(F.col("vec_id").cast("long"), vector.alias("vector")).where("vec_id is not null and vector is not null")
        good = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vector", lambda x: x != 0)
        return df.where(good)

    rows, asked = usable(vectors), usable(queries)
    sizes = rows.groupBy(F.size("vector").alias("size")).count().orderBy(F.desc("count"), "size").collect()
    out_type = "query_id long, rank int, vec_id long, score double"
    if not sizes:
        return vectors.sparkSession.createDataFrame([], out_type)
    size, total = sizes[0]["size"], sizes[0]["count"]
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    # A query id with several vectors asks with the least of them.
    rows, asked = rows.where(F.size("vector") == size), asked.where(F.size("vector") == size).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    longest = rows.agg(F.max(norm)).first()[0]
    # By parts first, so that a vector with very many copies is no task's whole work.
    part = lambda n: F.pmod(F.xxhash64("vec_id"), F.lit(n)).alias("part")
    least = lambda ids: F.slice(F.array_sort(ids), 1, k + 1).alias("ids")
    rows = rows.groupBy("vector", part(math.ceil(math.sqrt(total)))).agg(least(F.collect_set("vec_id")))
    rows = rows.groupBy("vector").agg(least(F.array_distinct(F.flatten(F.collect_list("ids"))))).select(F.monotonically_increasing_id().alias("place"), F.col("ids")[0].alias("lead"), "ids", "vector")
    asked = asked.groupBy("vector", part(max(1, math.ceil(asked.count() / 1000)))).agg(F.collect_list("vec_id").alias("ids")).select(F.monotonically_increasing_id().alias("place"), F.array_min("ids").alias("lead"), "ids", "vector")
    rows, asked = materialise(rows, "places"), materialise(asked, "asked")
    n, n_asked = rows.count(), asked.count()
    reach = max(k + 1, math.ceil(window * n**growth))
    keyed = lambda df, as_query: df.select("place", "lead", "vector").mapInArrow(_keyed(size, longest, curves, as_query, seed), _STREAM)
    stream = keyed(rows, False).unionByName(keyed(asked, True))
    ranges = math.ceil((n + n_asked) * curves / max(RANGE, 16 * reach))
    stream = stream.repartitionByRange(ranges, "curve", "key", "place").sortWithinPartitions("curve", "key", "place")
    hits = stream.mapInArrow(_windows(size, k + 1, reach), "place long, hits binary")
    # More than the answer needs, as rounded components may change the order.
    best = hits.groupBy("place").agg(F.collect_list("hits").alias("hits")).mapInArrow(_merged(3 * (k + 1)), "query long, place long")
    best = best.join(rows.select("place", "ids", "vector"), "place").select("query", "ids", "vector")
    score = F.aggregate(F.zip_with("vector", "asked", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    best = best.join(asked.select(F.col("place").alias("query"), F.col("vector").alias("asked"), F.col("ids").alias("members")), "query").select("query", "members", "ids", (-score).alias("away"))
    found = best.groupBy("query").agg(F.first("members").alias("members"), F.flatten(F.collect_list(F.transform("ids", lambda i: F.struct(F.col("away"), i.alias("vec_id"))))).alias("found"))
    return found.select(F.col("members").alias("ids"), F.col("found").cast(_HITS).alias("found")).mapInArrow(_ranked(k), out_type)
