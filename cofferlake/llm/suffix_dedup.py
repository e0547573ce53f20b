"""Exact removal of repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts in a document with a smaller id. Strings are
judged on the input; matches never cross documents.

Suffix arrays are built by linear grouping (Baier 2016): suffixes start grouped by first symbol; groups are processed
from the highest down, each suffix gets a pointer to the previous one in a lower group, and the suffixes pointed at
move into new groups just above their own, those pointed at more often higher; then every group holds the suffixes
with one Lyndon prefix. A second pass over the growing array emits each group's order along the same pointers. No
renaming and no recursion.

Spark finds what has to be sorted at all. Documents lie in chunks of about ``CHUNK`` bytes, and all that travels is
gathered by chunk first, so a passage that a third of all documents hold counts once in a chunk. Of each string of
LENGTH bytes one anchor of ``GRAM`` bytes is chosen by least hash; equal strings have equal anchors. (1) Chunks deal
the hashes of their anchors over buckets; a bucket answers each chunk with those that several documents hold. (2) For
these anchors a chunk sends its different stretches, the text whose strings chose the anchor, each with its least
doc_id. A bucket leaves out stretches none of whose strings occurs twice by hash; suffix arrays over the others, anchor
by anchor, find equal strings as neighbours with LENGTH common bytes, and give each string's least doc_id. (3) Chunks
remove what starts with a smaller doc_id. An anchor that more than ``SPLIT`` documents hold is hot: its strings are dealt
one by one instead of in stretches, so no bucket grows with it.

Exact copies of a document with a smaller doc_id are settled by their digest. They send nothing.

Cases: null text is empty; a null doc_id is neither source nor target and nothing of it is removed; rows that repeat a
doc_id never remove each other; texts under LENGTH bytes stay; an empty table gives an empty result; further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cofferlake.llm import textvec as tv
from cofferlake.llm.common import discard, materialise, release

LENGTH, GRAM = 50, 24
#: Bytes of text in a chunk; anchors in a bucket; documents of an anchor whose stretches are sorted together.
CHUNK, PER_BUCKET, SPLIT = 4 << 20, 200_000, 4_000
#: Strings that can choose one anchor, and the longest stretch, rounded up to whole words of 8 bytes.
_SPAN = LENGTH - GRAM + 1
_WIDE = -(-(LENGTH + _SPAN - 1) // 8) * 8
_PIECE = 1 << 17
_PLACE = np.uint64(2 * _PIECE - 1)
_LOW48 = np.uint64((1 << 48) - 1)
_ODD = tv.mix(np.arange(1, _WIDE // 8 + 1, dtype=np.uint64)) | np.uint64(1)


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of a sequence of integers; the end is smaller than any of them."""
    n = len(text)
    if not n:
        return []
    members: list[list[int]] = []
    index: dict[int, int] = {}
    for symbol in sorted(set(text)):
        index[symbol] = len(members)
        members.append([])
    group = [index[s] for s in text]
    for i, g in enumerate(group):
        members[g].append(i)
    above = [*range(1, len(members)), -1]
    below = [-1, *range(len(members) - 1)]
    closed = [False] * len(members)
    previous = [-1] * n
    current = len(members) - 1
    while current >= 0:
        count, order = {}, []
        for i in members[current]:
            if group[i] != current:
                continue  # it moved to another group
            p = i - 1
            while p >= 0 and (closed[group[p]] or group[p] == current):
                p = previous[p]
            previous[i] = p
            if p >= 0:
                if p in count:
                    count[p] += 1
                else:
                    count[p] = 1
                    order.append(p)
        closed[current] = True
        by_count: dict[int, list[int]] = {}
        for p in order:
            by_count.setdefault(count[p], []).append(p)
        for c in sorted(by_count, reverse=True):
            fresh: dict[int, int] = {}
            for p in by_count[c]:
                old = group[p]
                new = fresh.get(old)
                if new is None:
                    new = fresh[old] = len(members)
                    members.append([])
                    closed.append(False)
                    up = above[old]
                    above.append(up)
                    below.append(old)
                    above[old] = new
                    if up >= 0:
                        below[up] = new
                members[new].append(p)
                group[p] = new
        current = below[current]
    first, at, g = [0] * len(members), 0, 0
    while below[g] >= 0:
        g = below[g]
    sizes = [0] * len(members)
    for g_ in group:
        sizes[g_] += 1
    while g >= 0:
        first[g] = at
        at += sizes[g]
        g = above[g]
    out, placed = [-1] * n, [False] * n

    def place(i: int) -> None:
        while i >= 0 and not placed[i]:
            placed[i] = True
            g = group[i]
            out[first[g]] = i
            first[g] += 1
            i = previous[i]

    place(n - 1)  # the end itself comes first
    for k in range(n):
        place(out[k] - 1)
    return out


def least_ids(stretches: list[bytes], ids: list[int], length: int = LENGTH) -> list[list[int]]:
    """For each start in each stretch the least id among the stretches that hold the same ``length`` bytes."""
    text: list[int] = []
    begins = []
    for k, s in enumerate(stretches):
        begins.append(len(text))
        text.extend(b + len(stretches) for b in s)
        text.append(k)  # a separator of its own
    owner = np.repeat(np.arange(len(stretches)), [len(s) + 1 for s in stretches])
    out = [[i] * (len(s) - length + 1) for s, i in zip(stretches, ids, strict=True)]
    run, least, before = [], None, None

    def close() -> None:
        for k, at in run:
            out[k][at] = least

    for i in suffix_array(text):
        k = int(owner[i])
        at = i - begins[k]
        if at + length > len(stretches[k]):
            continue
        head = stretches[k][at : at + length]
        if head != before:
            close()
            run, least, before = [], ids[k], head
        run.append((k, at))
        least = min(least, ids[k])
    close()
    return out


def _folded(words: list[np.ndarray]) -> np.ndarray:
    """64-bit hash of rows given word by word."""
    with np.errstate(over="ignore"):
        h = words[0] * _ODD[0]
        for word, odd in zip(words[1:], _ODD[1:]):
            h ^= h >> np.uint64(29)
            h += word * odd
        return tv.mix(h)


def anchors(data: np.ndarray, offs: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first start, number of starts): consecutive strings of LENGTH bytes in live documents with one anchor."""
    total = max(len(data) - LENGTH + 1, 0)
    usable = np.zeros(total, bool)
    for k in np.flatnonzero(live).tolist():
        usable[offs[k] : max(offs[k + 1] - LENGTH + 1, offs[k])] = True
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", data.tobytes(), 0, (1,)) if total else None
    parts: list[list[np.ndarray]] = [[np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for lo in range(0, total, _PIECE):
        hi = min(lo + _PIECE, total)
        ok, grams = usable[lo:hi], hi - lo + _SPAN - 1
        if not ok.any():
            continue
        h = _folded([words[lo + at : lo + at + grams] for at in range(0, GRAM, 8)])
        least = h & ~_PLACE | np.arange(grams, dtype=np.uint64)
        width = 1
        while width * 2 <= _SPAN:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < _SPAN:
            least = np.minimum(least[: len(least) - (_SPAN - width)], least[_SPAN - width :])
        at = (least & _PLACE).astype(np.int32)
        other = at[1:] != at[:-1]
        first = np.flatnonzero(ok & np.concatenate([[True], other | ~ok[:-1]]))
        last = np.flatnonzero(ok & np.concatenate([other | ~ok[1:], [True]]))
        parts[0].append(tv.mix(h[at[first]]))  # least hashes lie near 0, buckets want even ones
        parts[1].append(lo + first)
        parts[2].append(last - first + 1)
    return tuple(np.concatenate(p) for p in parts)


def _rows(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """data[start : start + size] as rows of _WIDE bytes, filled up with zeros."""
    padded = np.concatenate([data, np.zeros(_WIDE, np.uint8)])
    out = np.lib.stride_tricks.sliding_window_view(padded, _WIDE)[start] if len(start) else np.zeros((0, _WIDE), np.uint8)
    return np.where(np.arange(_WIDE) < size[:, None], out, 0).astype(np.uint8)


def _row_hash(rows: np.ndarray) -> np.ndarray:
    words = np.ascontiguousarray(rows).view("<u8")
    return _folded([words[:, k] for k in range(words.shape[1])])


def _stretch_hash(rows: np.ndarray, n: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return tv.mix(_row_hash(rows) + n.astype(np.uint64) * _ODD[0])


def _grouped(rows: np.ndarray, n: np.ndarray, key: np.ndarray, h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by anchor, stretch and id; where another stretch begins in it), ``key`` being the hash of each stretch.

    Stretches are told apart by their bytes and their length, as those that end in zero bytes fill up to equal rows.
    """
    order = np.lexsort((ids, key, h))
    for _ in range(2):
        same = (h[order[1:]] == h[order[:-1]]) & (key[order[1:]] == key[order[:-1]])
        other = (n[order[1:]] != n[order[:-1]]) | (rows[order[1:]] != rows[order[:-1]]).any(axis=1)
        if not (same & other).any():
            break
        words = np.ascontiguousarray(rows).view("<u8")  # two stretches with one hash
        order = np.lexsort((ids, n, *words.T, key, h))
    at = np.flatnonzero(np.concatenate([[True], ~same | other])) if len(h) else np.zeros(0, np.int64)
    return order, at


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a new combination begins in sorted columns."""
    n = len(columns[0])
    if not n:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], np.any([c[1:] != c[:-1] for c in columns], axis=0)]))


def _bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _cuts(bucket: np.ndarray) -> list[tuple[int, int]]:
    at = _starts(bucket)
    return list(zip(at.tolist(), np.append(at[1:], len(bucket)).tolist()))


def _chunked(batches):
    """One row for each chunk: ids, ends, the compressed text, and the distinct digests with their least id."""
    task, count = TaskContext.get().partitionId(), 0
    for batch in batches:
        for lo, hi, data, offs in tv.text_slices(batch.column("text"), CHUNK):
            ids = batch.column("doc_id").slice(lo, hi - lo)
            digests = [hashlib.sha256(data[a:b].data).digest() for a, b in zip(offs, offs[1:])]
            least: dict[bytes, int] = {}
            for d, i in zip(digests, ids.to_pylist()):
                if i is not None:
                    least[d] = min(i, least.get(d, i))
            columns = [[(task << 32) + count], [ids.to_pylist()], [offs[1:].tolist()], [b"".join(digests)], [list(least)], [list(least.values())], [zstandard.ZstdCompressor(level=3).compress(data.tobytes())]]
            kinds = [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.int64()), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=["chunk", "ids", "ends", "digests", "distinct", "least", "blob"])
            count += 1


_CHUNKED = "chunk long, ids array<long>, ends array<long>, digests binary, distinct array<binary>, least array<long>, blob binary"


class _Chunk:
    """The documents of a chunk row; ``first`` tells the least id of digests that other chunks also hold."""

    def __init__(self, table: pa.Table, first: dict[bytes, int]):
        row = {c: table.column(c)[0] for c in table.column_names}
        self.number = row["chunk"].as_py()
        ids = row["ids"].values
        self.named = np.asarray(ids.is_valid())
        self.ids = np.asarray(pc.fill_null(ids, 0))
        self.offs = np.concatenate([[0], np.asarray(row["ends"].values)]).astype(np.int64)
        self.data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"].as_py(), max_output_size=max(int(self.offs[-1]), 1)), np.uint8)
        known = dict(zip(row["distinct"].as_py(), row["least"].as_py()))
        known |= {d: min(i, known[d]) for d, i in first.items()}
        digests = row["digests"].as_py()
        least = np.array([known.get(digests[32 * k : 32 * k + 32], 0) for k in range(len(self.ids))], np.int64)
        self.copy = self.named & (self.ids > least)


def _column(table: pa.Table, name: str) -> list:
    return table.column(name).to_pylist()


def _dealt(buckets: int):
    """Hashes of a chunk's anchors by bucket, six bytes each, and how many of its documents hold them."""

    def run(chunks: pa.Table, copies: pa.Table) -> pa.Table:
        chunk = _Chunk(chunks, dict(zip(_column(copies, "digest"), _column(copies, "first"))))
        h, start, _ = anchors(chunk.data, chunk.offs, chunk.named & ~chunk.copy)
        doc = tv.owner(chunk.offs, start)
        order = np.lexsort((doc, h))
        h, doc = h[order], doc[order]
        h = h[_starts(h, doc)]
        at = _starts(h)
        docs = np.minimum(np.diff(np.append(at, len(h))), 65535).astype("<u2")
        h = h[at]
        bucket, packed = _bucket(h, buckets), []
        for a, b in _cuts(bucket):
            packed.append(np.ascontiguousarray(h[a:b]).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes() + docs[a:b].tobytes())
        cut = _starts(bucket)
        return pa.Table.from_arrays([pa.array(bucket[cut]), pa.array(np.full(len(cut), chunk.number, np.int64)), pa.array(packed, pa.binary())], names=["bucket", "chunk", "packed"])

    return run


def _six(packed: bytes, n: int) -> np.ndarray:
    wide = np.zeros((n, 8), np.uint8)
    wide[:, :6] = np.frombuffer(packed, np.uint8, 6 * n).reshape(6, n).T
    return wide.view("<u8").ravel()


def _shared(split: int):
    """For each chunk the anchors of a bucket that several documents hold, and which are hot."""

    def run(table: pa.Table) -> pa.Table:
        packed = _column(table, "packed")
        sizes = np.array([len(p) // 8 for p in packed])
        h = np.concatenate([_six(p, n) for p, n in zip(packed, sizes)])
        docs = np.concatenate([np.frombuffer(p, "<u2", n, 6 * n) for p, n in zip(packed, sizes)]).astype(np.int64)
        distinct, where = np.unique(h, return_inverse=True)
        total = np.bincount(where, weights=docs, minlength=len(distinct))[where]
        ends = np.cumsum(sizes)
        chunks, answers = [], []
        for chunk, a, b in zip(_column(table, "chunk"), ends - sizes, ends):
            mine = a + np.flatnonzero(total[a:b] > 1)
            if len(mine):
                chunks.append(chunk)
                answers.append(np.ascontiguousarray(h[mine]).view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes() + (total[mine] > split).astype(np.uint8).tobytes())
        return pa.Table.from_arrays([pa.array(chunks, pa.int64()), pa.array(answers, pa.binary())], names=["chunk", "shared"])

    return run


_REQUEST = {"bucket": pa.int64(), "chunk": pa.int64(), "h": pa.binary(), "n": pa.binary(), "first": pa.binary(), "text": pa.binary()}
_OCCURRENCES = "copies binary, kinds binary, at binary, kind binary"


def _requests(buckets: int):
    """The stretches that a chunk asks about, by bucket, and in a row of its own where they occur."""

    def run(chunks: pa.Table, answers: pa.Table) -> pa.Table:
        first = {d: i for d, i in zip(_column(answers, "digest"), _column(answers, "first")) if d is not None}
        chunk = _Chunk(chunks, first)
        packed = [p for p in _column(answers, "shared") if p is not None]
        known = np.concatenate([np.zeros(0, np.uint64), *[_six(p, len(p) // 7) for p in packed]])
        hot = np.concatenate([np.zeros(0, bool), *[np.frombuffer(p, np.uint8, len(p) // 7, len(p) // 7 * 6) > 0 for p in packed]])
        order = np.argsort(known, kind="stable")
        known, hot = known[order], hot[order]
        h = start = n = np.zeros(0, np.int64)
        if len(known):
            h, start, n = anchors(chunk.data, chunk.offs, chunk.named & ~chunk.copy)
            low = h & _LOW48
            place = np.minimum(np.searchsorted(known, low), len(known) - 1)
            asked = known[place] == low
            h, start, n, hot = h[asked], start[asked], n[asked], hot[place[asked]]
            # Strings of hot anchors one by one.
            strings = np.repeat(start[hot], n[hot]) + np.arange(n[hot].sum()) - np.repeat(np.cumsum(n[hot]) - n[hot], n[hot])
            h, start, n = np.concatenate([h[~hot], np.zeros(len(strings), np.uint64)]), np.concatenate([start[~hot], strings]), np.concatenate([n[~hot], np.ones(len(strings), np.int64)])
        rows = _rows(chunk.data, start, n + LENGTH - 1)
        ids = chunk.ids[tv.owner(chunk.offs, start)]
        key = _stretch_hash(rows, n)
        h = np.where(h == 0, key, h).astype(np.uint64)  # strings of hot anchors are anchors of their own
        order, at = _grouped(rows, n, key, h, ids)
        h, start, n, ids, rows = h[order], start[order], n[order], ids[order], rows[order]
        kind = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
        out = {k: [] for k in [*_REQUEST, "copies", "kinds", "at", "kind"]}

        def add(*values) -> None:
            for column, value in zip(out.values(), values):
                column.append(value)

        sizes = n[at].astype(np.uint8)
        add(-1, chunk.number, None, None, None, None, chunk.copy.tobytes(), sizes.tobytes(), start.astype("<i4").tobytes(), kind.astype("<i4").tobytes())
        text, packer = rows[at], zstandard.ZstdCompressor(level=3)
        inside = np.arange(_WIDE) < (n[at] + LENGTH - 1)[:, None]
        for a, b in _cuts(_bucket(h[at], buckets)):
            part = slice(a, b)
            bucket = int(_bucket(h[at[a] : at[a] + 1], buckets)[0])
            add(bucket, chunk.number, h[at[part]].tobytes(), sizes[part].tobytes(), ids[at[part]].tobytes(), packer.compress(text[part][inside[part]].tobytes()), None, None, None, None)
        return pa.Table.from_arrays([pa.array(v, _REQUEST.get(k, pa.binary())) for k, v in out.items()], names=list(out))

    return run


def _repeated(rows: np.ndarray, n: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which stretches hold a string that occurs twice among those of its anchor, going by hashes."""
    keys, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for at in range(_SPAN):
        have = np.flatnonzero(n > at)
        if not len(have):
            break
        string = np.zeros((len(have), -(-LENGTH // 8) * 8), np.uint8)
        string[:, :LENGTH] = rows[have, at : at + LENGTH]
        keys.append(tv.mix(_row_hash(string) ^ h[have]))
        owner.append(have)
    _, where, count = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
    out = np.zeros(len(n), bool)
    out[np.concatenate(owner)[count[where] > 1]] = True
    return out


def _judged(table: pa.Table) -> pa.Table:
    """For each chunk's request the least doc_id of every string of its stretches, in the order asked."""
    join = lambda c, kind: np.concatenate([np.frombuffer(x, kind) for x in _column(table, c)])
    h, n, first = join("h", "<u8"), join("n", np.uint8).astype(np.int64), join("first", "<i8")
    opener = zstandard.ZstdDecompressor()
    text = np.frombuffer(b"".join(map(opener.decompress, _column(table, "text"))), np.uint8)
    size = n + LENGTH - 1
    rows = _rows(text, np.cumsum(size) - size, size)
    order, at = _grouped(rows, n, _stretch_hash(rows, n), h, first)
    kind = np.empty(len(h), np.int64)
    kind[order] = np.repeat(np.arange(len(at)), np.diff(np.append(at, len(h))))
    one = order[at]  # a row of each different stretch, with its least doc_id
    rows, sizes, kinds_n, least_id, anchor = rows[one], size[one], n[one], first[one], h[one]
    begin = np.cumsum(kinds_n) - kinds_n
    least = np.repeat(least_id, kinds_n)
    group = _starts(anchor)
    several = np.repeat(np.diff(np.append(group, len(anchor))) > 1, np.diff(np.append(group, len(anchor))))
    open_ = np.flatnonzero(several)
    open_ = open_[_repeated(rows[open_], kinds_n[open_], anchor[open_])]
    for a, b in _cuts(anchor[open_]):
        these = open_[a:b]
        found = least_ids([rows[i, : sizes[i]].tobytes() for i in these], least_id[these].tolist())
        for i, values in zip(these, found):
            least[begin[i] : begin[i] + kinds_n[i]] = values
    answer = least[np.repeat(begin[kind], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
    ends = np.cumsum([sum(x) for x in _column(table, "n")])
    parts = [answer[a:b].tobytes() for a, b in zip(np.append(0, ends[:-1]), ends)]
    return pa.Table.from_arrays([table.column("chunk"), table.column("bucket"), pa.array(parts, pa.binary())], names=["chunk", "bucket", "least"])


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def _removed(chunks: pa.Table, answers: pa.Table) -> pa.Table:
    chunk = _Chunk(chunks, {})
    own = answers.filter(pc.equal(answers.column("bucket"), -1))
    copy, n, at, kind = (np.frombuffer(own.column(c)[0].as_py(), k) for c, k in (("copies", bool), ("kinds", np.uint8), ("at", "<i4"), ("kind", "<i4")))
    judged = answers.filter(pc.not_equal(answers.column("bucket"), -1)).sort_by("bucket")
    least = np.concatenate([np.zeros(0, np.int64), *[np.frombuffer(x, "<i8") for x in _column(judged, "least")]])
    begin = np.cumsum(n.astype(np.int64)) - n
    many = n[kind].astype(np.int64)
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    start = np.repeat(at.astype(np.int64), many) + step
    doc = np.repeat(tv.owner(chunk.offs, at.astype(np.int64)), many)
    earlier = least[np.repeat(begin[kind], many) + step] < chunk.ids[doc]
    start, doc = start[earlier], doc[earlier]
    stop = np.minimum(start + LENGTH, chunk.offs[doc + 1])
    change = np.bincount(start, minlength=len(chunk.data) + 1) - np.bincount(stop, minlength=len(chunk.data) + 1)
    gone = np.cumsum(change[:-1]) > 0
    for k in np.flatnonzero(copy & (np.diff(chunk.offs) >= LENGTH)).tolist():
        gone[chunk.offs[k] : chunk.offs[k + 1]] = True
    count = np.concatenate([[0], np.cumsum(gone)])
    opens = gone & ~np.concatenate([[False], gone[:-1]])
    inner = chunk.offs[:-1][chunk.offs[:-1] < len(gone)]
    opens[inner] = gone[inner]
    spans = np.concatenate([[0], np.cumsum(opens)])
    digests = []
    for a, b in zip(chunk.offs, chunk.offs[1:]):
        part = chunk.data[a:b]
        digests.append(hashlib.sha256((part[~gone[a:b]] if count[b] > count[a] else part).tobytes()).hexdigest())
    return pa.Table.from_arrays(
        [chunks.column("ids")[0].values, pa.array(np.diff(chunk.offs)), pa.array(count[chunk.offs[1:]] - count[chunk.offs[:-1]]), pa.array(spans[chunk.offs[1:]] - spans[chunk.offs[:-1]]), pa.array(digests, pa.string())],
        names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def remove_repeats(docs: DataFrame, per_bucket: int = PER_BUCKET, split: int = SPLIT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text"))
    chunks = materialise(docs.mapInArrow(_chunked, _CHUNKED), "chunks")
    size = chunks.agg(F.sum(F.element_at("ends", -1))).first()[0] or 0
    buckets = max(1, math.ceil(2 * size / (_SPAN + 1) / per_bucket))
    entries = chunks.select("chunk", F.explode(F.arrays_zip("distinct", "least")).alias("e")).select("chunk", F.col("e.distinct").alias("digest"), "e.least")
    firsts = entries.groupBy("digest").agg(F.min("least").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = materialise(entries.join(firsts, "digest").where("least > first").select("chunk", "digest", "first"), "copies")
    by_chunk = chunks.groupBy("chunk")
    dealt = by_chunk.cogroup(copies.groupBy("chunk")).applyInArrow(_dealt(buckets), "bucket long, chunk long, packed binary")
    shared = materialise(dealt.groupBy("bucket").applyInArrow(_shared(split), "chunk long, shared binary"), "shared")
    release(spark)
    answers = shared.unionByName(copies, allowMissingColumns=True)
    asked = by_chunk.cogroup(answers.groupBy("chunk")).applyInArrow(_requests(buckets), f"bucket long, chunk long, h binary, n binary, first binary, text binary, {_OCCURRENCES}")
    asked = materialise(asked, "requests")
    discard(shared, copies)
    release(spark)
    requests = asked.where("bucket >= 0").select("bucket", "chunk", "h", "n", "first", "text")
    judged = materialise(requests.groupBy("bucket").applyInArrow(_judged, "chunk long, bucket long, least binary"), "judged")
    own = materialise(asked.where("bucket < 0").select("chunk", "bucket", "copies", "kinds", "at", "kind"), "own")
    discard(asked)
    release(spark)
    return by_chunk.cogroup(own.unionByName(judged, allowMissingColumns=True).groupBy("chunk")).applyInArrow(_removed, _RESULT)
