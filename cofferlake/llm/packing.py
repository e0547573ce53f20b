"""Best-fit packing of tokenised documents with certified bin counts.

Documents become token ids (byte-level BPE) plus one closing id; longer ones are cut into full pieces after a shorter
first one. Pieces are dealt evenly over partitions and each partition packs its own by best-fit decreasing. A lower
bound from dual-feasible functions then certifies the partition: equal to its bin count, nothing can be better. Where
a gap or an underfull bin remains, the documents of all bins that are not tight go back, are dealt anew over fewer
partitions together with those of the other partitions, and are packed again, as long as that saves sequences.

Token ids come from the vocabulary file of the `tokenizers` format; the merge work is done by `tiktoken` over the same
ranks, because `tokenizers` itself takes about five times the CPU time. Texts that hold an added token of the file go
to `tokenizers` as it is. The first text of every Arrow batch is encoded with both, and a difference raises an error.

Cases: null text is empty, and an empty document is one piece that holds only the closing id; repeated rows (and equal
or null doc_ids) are packed one by one; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from functools import cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofferlake.llm.common import materialise

CAPACITY = 2048
CLOSING_ID = 0
VOCABULARY = "byte_bpe_50k.json"
PIECES = "uid long, doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long, free int, certified boolean"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[str, int]:
    """Letters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


@cache
def encoders(path: str):
    """The fast encoder, the file's own and a pattern of the file's added tokens, once per Python worker."""
    import public_tokenizers
    import tiktoken
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters, special = _byte_letters(), {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(letters[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in special}
    added = re.compile("|".join(map(re.escape, sorted(special))) or r"(?!)", re.IGNORECASE)
    return tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), Tokenizer.from_file(path), added


def token_ids(text: str, path: str) -> np.ndarray:
    """The ids that `tokenizers` gives."""
    fast, own, added = encoders(path)
    return np.array(own.encode(text).ids, np.uint32) if added.search(text) else fast.encode_to_numpy(text, disallowed_special=())


def _tokenised(path: str | None):
    def run(batches):
        file = path or vocabulary_path()
        own = encoders(file)[1]
        task, done = TaskContext.get().partitionId(), 0
        for batch in batches:
            out = {k: [] for k in ("doc_id", "piece", "start", "length", "ids_crc32")}
            texts = batch.column("text")
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                text = texts[i].as_py() or ""
                ids = token_ids(text, file)
                if i == 0 and own.encode(text).ids != ids.tolist():
                    raise ValueError(f"encoders differ on doc_id {doc_id}")
                ids = np.append(ids.astype("<u4"), np.array([CLOSING_ID], "<u4"))
                n = len(ids)
                cuts = [0, *range(n - (n - 1) // CAPACITY * CAPACITY, n, CAPACITY), n] if n > CAPACITY else [0, n]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    for name, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())), strict=True):
                        out[name].append(value)
            n = len(out["doc_id"])
            uid = np.arange(done, done + n, dtype=np.int64) + (task << 40)
            done += n
            kinds = {"doc_id": pa.int64(), "piece": pa.int32(), "start": pa.int64(), "length": pa.int64(), "ids_crc32": pa.int64()}
            yield pa.RecordBatch.from_arrays([pa.array(uid), *(pa.array(out[k], kind) for k, kind in kinds.items())], names=["uid", *kinds])

    return run


def tokenised_pieces(docs: DataFrame, path: str | None = None) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_tokenised(path), PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY) -> int:
    """Bins that any packing needs, by dual-feasible functions in whole numbers.

    Thresholds: lengths over capacity - e count as a full bin, lengths under e as nothing, the rest as they are.
    Rounding: (k + 1) * length / capacity is rounded down and divided by k, except where it is whole.
    """
    distinct, number = np.unique(lengths, return_counts=True)
    return lower_bound_of(dict(zip(distinct.tolist(), number.tolist())), capacity)


def lower_bound_of(lengths: dict[int, int], capacity: int = CAPACITY) -> int:
    """The same from how often each length occurs."""
    times = np.zeros(capacity + 1, np.int64)
    times[list(lengths)] = list(lengths.values())
    if not times.any():
        return 0
    size = np.arange(capacity + 1, dtype=np.int64)
    mass, number = np.concatenate([[0], np.cumsum(times * size)]), np.concatenate([[0], np.cumsum(times)])
    e = np.arange(0, capacity // 2 + 1)
    top = capacity - e + 1  # first length that counts as a full bin
    threshold = (number[-1] - number[top]) * capacity + mass[top] - mass[np.minimum(e, top)]
    best = -(-int(threshold.max()) // capacity)
    for k in range(1, 32):
        scaled = (k + 1) * size
        value = np.where(scaled % capacity == 0, k * size, scaled // capacity * capacity)
        best = max(best, -(-int((value * times).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bin and offset of each length, and the free space of each bin. A bit set of free spaces finds the tightest fit."""
    bins, offsets, free = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    waiting: list[list[int]] = [[] for _ in range(capacity + 1)]
    present = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = present >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = waiting[room].pop()
            if not waiting[room]:
                present &= ~(1 << room)
        else:
            room, b = capacity, len(free)
            free.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        free[b] = room - n
        if room > n:
            waiting[room - n].append(b)
            present |= 1 << (room - n)
    return bins, offsets, np.array(free, dtype=np.int64)


def _packed(turn: int, capacity: int):
    def run(frames):
        parts = list(frames)
        if not parts or not sum(map(len, parts)):
            return
        rows = pd.concat(parts, ignore_index=True).sort_values(["length", "uid"], ignore_index=True)
        lengths = rows["length"].to_numpy()
        bins, offsets, free = best_fit_decreasing(lengths, capacity)
        rows["sequence_id"] = bins + (turn << 56) + (TaskContext.get().partitionId() << 28)
        rows["offset"] = offsets
        rows["free"] = free[bins].astype(np.int32)
        rows["certified"] = len(free) == lower_bound(lengths, capacity)
        yield rows

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY, per_task: int = 40_000, loose: int = 16) -> DataFrame:
    """Pieces with sequence_id, offset, free space of the sequence, and whether its partition's count is proven least.

    ``per_task`` pieces go to a task. A bin is tight if at most ``loose`` of its tokens are free; the bins of certified
    partitions stay as they are, except those so empty that others can take them up. The exchange ends when it leaves no
    fewer loose bins than before, or when one task has packed all that was left.
    """
    done, waiting, before = [], pieces, None
    for turn in count():
        n = waiting.count()
        if not n:
            break
        tasks = max(1, math.ceil(n / per_task))
        dealt = waiting.repartition(tasks, F.xxhash64(F.lit(turn), "uid"))
        packed = materialise(dealt.select(*PIECES.replace(" long", "").replace(" int", "").split(", ")).mapInPandas(_packed(turn, capacity), PACKED), "packed")
        stays = (F.col("free") <= loose) | (F.col("certified") & (F.col("free") < capacity // 4))
        left = packed.where(~stays)
        loose_bins = left.agg(F.count_distinct("sequence_id")).first()[0]
        if (before is not None and loose_bins >= before) or not loose_bins or tasks == 1:
            done.append(packed)
            break
        done.append(packed.where(stays))
        waiting, before = left, loose_bins
    if not done:
        return materialise(pieces.limit(0).withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long"), "free": F.lit(0), "certified": F.lit(True)}), "packed")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def packing_gap(packed: DataFrame, capacity: int = CAPACITY) -> tuple[int, int]:
    """(sequences used, sequences that any packing of the same pieces needs at least)."""
    lengths = packed.groupBy("length").count().collect()  # one row for each length up to the capacity
    used = packed.where("offset = 0").count()
    return used, lower_bound_of({r["length"]: r["count"] for r in lengths}, capacity)


def packed_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    pieces = materialise(tokenised_pieces(docs, path), "pieces")
    return pack(pieces).drop("uid")
