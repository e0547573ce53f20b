"""Secrets: exact patterns, and random strings found by character Markov models.

A token is read twice: as classes (lower case, upper case, digit, joint, boundary), and where two letters meet as
letters without case, so that camelCase, UPPER_CASE and path/names look like the words they are made of. Both readings
are first-order Markov chains, trained once on random strings and once on ordinary identifiers:

- random: the values of the exact patterns that mix letters and digits, of all documents, and as much of a uniform model;
- ordinary: all other tokens of all documents but long ones that mix letters and digits, which may be secrets
  themselves, and as much of the names that Python's own library defines.

Transitions are counted in Spark; the driver gets two times 26 * 26 + 5 * 5 sums. A token of 16 characters or more is a
secret if its log-likelihood ratio reaches ``TOTAL`` nats in all and, per character, a threshold that all but one in 200
of the library's long names stay below; those names (a fifth, by hash) are held out of the training.

Cases: null and empty texts have no spans (``spans`` is empty, ``base_sha256`` that of the empty string); repeated rows
are scanned one by one; a null ``doc_id`` keeps its row; an empty table gives an empty result; further columns are
ignored; whole texts are scanned, whatever their length.
"""

from __future__ import annotations

import hashlib
import importlib
import re
import zlib
from bisect import bisect_left
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds in the order in which spans of one start are listed, and their patterns.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"(?ai:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_LEAST = 6
TOKEN = re.compile(r"(?<![\w+/=-])[A-Za-z0-9+/_=-]{16,}(?![\w+/=-])")
#: Nats in total that a token's log-likelihood ratio needs, and least nats per character.
TOTAL, PER_CHARACTER = 12.0, 0.2
#: Different characters that a random string has at least; rules and fillers have fewer.
LEAST_DISTINCT = 6
#: Modules whose names are the sample of ordinary identifiers.
LIBRARY = ("argparse", "ast", "asyncio", "builtins", "calendar", "codecs", "collections", "configparser", "csv", "datetime", "decimal", "difflib", "email.message", "errno", "ftplib", "http.client", "http.server", "importlib.util", "inspect", "ipaddress", "json", "locale", "logging.handlers", "mimetypes", "multiprocessing", "os", "pathlib", "pickle", "platform", "sched", "select", "shutil", "signal", "smtplib", "socket", "sqlite3", "ssl", "stat", "statistics", "string", "subprocess", "tarfile", "threading", "tokenize", "traceback", "types", "typing", "unicodedata", "unittest", "urllib.parse", "urllib.request", "uuid", "warnings", "xml.dom", "xml.sax.handler", "zipfile")

LETTERS, CLASSES = 26, 5
SIZE = LETTERS * LETTERS + CLASSES * CLASSES
_CLASS, _LETTER = np.zeros(256, dtype=np.int64), np.full(256, -1, dtype=np.int64)
for _kind, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"+/_=-."), 1):
    _CLASS[list(_chars)] = _kind
    if _kind < 3:
        _LETTER[list(_chars)] = np.arange(LETTERS)

SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the value) of the exact patterns, in order of listing."""
    out = [(m.start(), 0, m.end(), m.start(1)) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _pairs(data: bytes) -> np.ndarray:
    """Transitions of all tokens: two letters without case, then classes; other bytes are class 0, the boundary."""
    raw = np.concatenate([[0], np.frombuffer(data, np.uint8), [0]])
    letter, kind = _LETTER[raw], _CLASS[raw]
    both = np.flatnonzero((letter[:-1] >= 0) & (letter[1:] >= 0))
    return np.concatenate([letter[both] * LETTERS + letter[both + 1], LETTERS * LETTERS + kind[:-1] * CLASSES + kind[1:]])


def _is_mixed(value: str) -> bool:
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def _counts(batches):
    """Transition counts of random (1) and ordinary (0) tokens of a batch."""
    total = np.zeros((2, SIZE), dtype=np.int64)
    for batch in batches:
        for text in batch.column("text"):
            text, at, rest, values = text.as_py() or "", 0, [], []
            for start, _, end, value in base_spans(text):
                if _is_mixed(text[value:end]):
                    values.append(text[value:end])
                rest.append(text[at:start])
                at = max(at, end)
            rest.append(text[at:])
            rest = [TOKEN.sub(lambda m: " " if _is_mixed(m[0]) else m[0], part) for part in rest]
            for label, part in enumerate((" ".join(rest), " ".join(values))):
                total[label] += np.bincount(_pairs(part.encode("utf-8", "replace")), minlength=SIZE)
    label, pair = np.nonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(label), pa.array(pair), pa.array(total[label, pair])], names=["label", "pair", "n"])


def transition_counts(docs: DataFrame) -> np.ndarray:
    """Counts over all documents: ordinary, random."""
    table = docs.select("text").mapInArrow(_counts, "label long, pair long, n long").groupBy("label", "pair").agg(F.sum("n").alias("n")).collect()
    out = np.zeros((2, SIZE))
    for label, pair, n in table:
        out[label, pair] = n
    return out


def library_names() -> tuple[list[str], list[str]]:
    """Names that the library defines, and those of them that are held out of the training."""
    names = sorted({n.strip("_") for m in LIBRARY for n in [m.replace(".", "/"), *dir(importlib.import_module(m))]})
    held = [n for n in names if zlib.crc32(n.encode()) % 5 == 0]
    return sorted(set(names) - set(held)), held


#: Uniform transitions, and those of random letters and digits where a sixteenth of the characters end a token or join.
_UNIFORM = np.concatenate([np.full(LETTERS * LETTERS, 1 / LETTERS), np.full(CLASSES * CLASSES, 1 / CLASSES)])
_EVEN = np.concatenate([np.full(LETTERS * LETTERS, 1 / LETTERS), np.tile(np.array([1 / 16, 26 / 70.9, 26 / 70.9, 10 / 70.9, 1 / 16]), CLASSES)])


def _chains(count: np.ndarray, prior: np.ndarray, weight: float = 25.0) -> np.ndarray:
    """Transition probabilities from counts and ``weight`` observations of each row of ``prior``."""
    out = []
    for part, n in ((slice(0, LETTERS * LETTERS), LETTERS), (slice(LETTERS * LETTERS, SIZE), CLASSES)):
        rows = count[part].reshape(n, n).copy()
        if n == CLASSES:
            rows[0, 0] = 0  # between tokens
        rows += weight * prior[part].reshape(n, n)
        out.append((rows / rows.sum(axis=1, keepdims=True)).ravel())
    return np.concatenate(out)


def scores(token: str, ratio: np.ndarray) -> float:
    """Log-likelihood ratio of a token, random over ordinary."""
    return float(ratio[_pairs(token.encode())].sum())


def train_markov(docs: DataFrame) -> tuple[np.ndarray, float]:
    """Log-likelihood ratio of each transition, and the threshold per character."""
    ordinary, random = transition_counts(docs)
    names, held = library_names()
    library = _chains(np.bincount(_pairs(" ".join(names).encode()), minlength=SIZE).astype(float), _UNIFORM)
    ratio = np.log((_chains(random, _EVEN) + _EVEN) / 2) - np.log((_chains(ordinary, library) + library) / 2)
    high = np.quantile([scores(n, ratio) / len(n) for n in held if len(n) >= 12], 0.995)
    return ratio, max(PER_CHARACTER, float(high))


def is_filler(token: str) -> bool:
    """Rules, repeats and alphabets: few different characters, or half of the steps go to the same or the next one."""
    steps = np.abs(np.diff(np.frombuffer(token.encode(), np.uint8).astype(np.int64)))
    return len(set(token)) < LEAST_DISTINCT or 2 * np.count_nonzero(steps <= 1) >= len(steps)


def random_spans(text: str, model: tuple[np.ndarray, float], taken: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Tokens over the thresholds that overlap none of the spans ``taken``, which are sorted by start."""
    ratio, least = model
    reach = list(accumulate((e for _, e in taken), max))  # the furthest end up to each span
    starts, out = [s for s, _ in taken], []
    for m in TOKEN.finditer(text):
        before = bisect_left(starts, m.end())
        if before and reach[before - 1] > m.start():
            continue
        if is_filler(m[0]):
            continue
        score = scores(m[0], ratio)
        if score >= TOTAL and score >= least * len(m[0]):
            out.append((m.start(), m.end()))
    return out


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans (as text) and found (kind, start, end)."""
    model = docs.sparkSession.sparkContext.broadcast(train_markov(docs))

    def scan(batches):
        trained = model.value
        for batch in batches:
            counts, digests, listed, found = [[] for _ in KINDS], [], [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = [(s, k, e) for s, k, e, _ in base_spans(text)]
                more = [(s, 3, e) for s, e in random_spans(text, trained, [(s, e) for s, _, e in base])]
                spans = sorted(base + more)
                write = lambda x: ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in x)
                for k, c in enumerate(counts):
                    c.append(sum(x[1] == k for x in spans))
                digests.append(hashlib.sha256(write(base).encode()).hexdigest())
                listed.append(write(spans))
                found.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(listed, pa.string()), pa.array(found, SPANS)],
                names=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "found"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, found array<struct<kind:string,start:long,end:long>>")
