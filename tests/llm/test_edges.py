"""Odd rows for every corpus operator and stage: repeated and null ids, ties, clashing columns, empty tables, long texts."""

import hashlib
import re

import numpy as np
import pytest
import zstandard

import corpus_pipeline
from cofferlake.llm.common import materialise
from cofferlake.llm.hilbert_ann import nearest
from cofferlake.llm.minhash import near_duplicates
from cofferlake.llm.mixing import mixed_documents, mixture
from cofferlake.llm.packing import pack, packed_documents, packing_gap
from cofferlake.llm.pii import personal_data, redacted
from cofferlake.llm.quality import quality_scores
from cofferlake.llm.secrets import secret_spans
from cofferlake.llm.suffix_dedup import remove_repeats
from cofferlake.llm.toxicity import toxicity_scores
from cofferlake.llm.warc import SKIPPABLE, read_archives, round_trip, write_archives
from cofferlake.sources.shared import scratch_path

SF_DIR = "/root/testdata/sf0.001"
CLASHING = "target string, source_size string, score string, offending string, predicted string, Size string, copies string, bucket string, node string, chunk string, kept string, rank string, row string, label string, toxic string, _kept string, h string"
LONG = " ".join(f"{i % 9973} mail{i}@example.org" for i in range(400_000))
TEXTS = [
    (1, "the same words stand here twice over and over again " * 3, "b"), (1, "the same words stand here twice over and over again " * 3, "b"), (1, "another text under an id that is taken", "a"),
    (None, "a text without an id, of some length, to be sure of it", "a"), (None, None, None), (2, "", "b"), (3, None, "a"), (4, LONG, "b"),
    (5, "a text without an id, of some length, to be sure of it", None), (6, "a text without an id, of some length, to be sure of it", "a"),
]


@pytest.fixture(scope="module")
def docs(spark):
    n = CLASHING.count(",") + 1
    return spark.createDataFrame([(*row, *["x"] * n) for row in TEXTS], f"doc_id long, text string, source string, {CLASHING}").repartition(3)


@pytest.fixture(scope="module")
def short(docs):
    return docs.where("doc_id <> 4 or doc_id is null")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{SF_DIR}/labels.parquet")


def test_one_row_for_each_document(docs, labels):
    for f in (secret_spans, personal_data, mixture, near_duplicates, remove_repeats):
        rows = f(docs).collect()
        assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _, _ in TEXTS), f.__name__
    for f in (toxicity_scores, quality_scores):
        assert f(docs, labels).count() == len(TEXTS), f.__name__
    whole = packed_documents(docs).where("piece = 0 and start = 0")
    assert whole.count() == len(TEXTS)


def test_repeated_and_null_ids_of_near_duplicates(short):
    rows = [(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_duplicates(short).collect()]
    assert all(kept and component is None for i, _, component, kept in rows if i is None)
    assert {(i, c, k) for i, _, c, k in rows if i in (1, 5, 6)} == {(1, 1, True), (5, 5, True), (6, 5, False)}


def test_repeats_under_one_id_stay(short):
    rows = {}
    for r in remove_repeats(short).collect():
        rows.setdefault(r.doc_id, []).append((r.n_bytes, r.n_removed))
    assert [x[1] for x in rows[1]] == [0, 0, 0] and all(x[1] == 0 for x in rows[None])
    assert rows[5] == [(54, 0)] and rows[6] == [(54, 54)]


def test_long_text_is_read_to_its_end(docs):
    row = personal_data(docs.where("doc_id = 4")).first()
    assert row.n_email == 400_000 and row.spans.endswith(f":{len(LONG)}")


def test_stages_return_the_columns_of_their_documents(spark, short):
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, short, SF_DIR)
        assert out.columns == short.columns, name
        assert out.count() > 0 and stage(spark, short.where("doc_id < 0"), SF_DIR).count() == 0, name


def _base_personal(text):
    luhn = lambda d: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0
    digits = lambda m: re.sub("[^0-9]", "", m[0])
    rules = {
        "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True), "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m[0].split("."))),
        "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))), "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15),
    }
    return [(k, *m.span()) for k, (p, ok) in rules.items() for m in re.finditer(p, text) if ok(m)]


def test_personal_data_brute_force(spark):
    """Base spans of every text equal the plain patterns; the others overlap none of them."""
    odd = ["1.2.3.4.5 999.1.1.1 01.002.3.4", "a@b.c, x.y+z@q-r.st@u.v", "4111-1111 1111 1111 and 4111 1111 1111 1112", "+1 (555) 000-1234. +12", "+49 30 1234567 10.0.0.1é mail é@é.fr a@b", "12 34 56 78 90 12 34 56 78 90 12 34 56 78"]
    texts = odd + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in personal_data(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        base = _base_personal(text or "")
        assert rows[i].base_sha256 == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest(), text
        assert [rows[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b[0] == k for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= {(s.kind, s.start, s.end) for s in rows[i].found}
        added = [s for s in rows[i].found if s.kind not in ("email", "ip", "card", "phone")]
        assert all(s.end <= a or b <= s.start for s in added for _, a, b in base)


def test_bank_numbers_names_and_addresses(spark):
    """Where they are found, their spans are exact; wrong check digits are told apart."""
    parts = {"bank": ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR1420041010050500013M02606"], "name": ["Mrs. Mary Smith", "Herr Klaus Müller", "Dr. J. Watson"], "address": ["221 Baker Street", "12 rue de la Paix", "Hauptstraße 5a", "Calle de Alcalá 42"]}
    rows = [(f"é {lead} {x}, and more", k, x) for k, xs in parts.items() for x in xs for lead in ("IBAN:", "contact: phone or address")]
    bad = [f"bank DE89 3704 0044 0532 0130 0{d} here" for d in range(1, 9)]
    docs = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows * 20)] + [(-i, b) for i, b in enumerate(bad, 1)], "doc_id long, text string")
    found = {r.doc_id: r.found for r in personal_data(docs).collect()}
    for i, (text, kind, x) in enumerate(rows):
        at = text.index(x)
        assert (kind, at, at + len(x)) in {(s.kind, s.start, s.end) for s in found[i]}, text


def test_redaction_replaces_spans(spark):
    docs = spark.createDataFrame([(1, "write to a@b.org or call +49 30 1234567", "x"), (2, None, "y"), (1, "nothing here", "x")], "doc_id long, text string, found string")
    assert sorted(map(tuple, redacted(docs).collect()), key=str) == sorted([(1, "write to <EMAIL> or call <PHONE>", "x"), (2, None, "y"), (1, "nothing here", "x")], key=str)


def test_quality_counts_brute_force(spark, labels):
    odd = ["# a $ b\n\nline\nline\nline \n \n", "one two three one two three one", "é ß # naïve x\ty", "a\rb\x0bc\x0cd", "w " * 60]
    texts = odd + [r.text for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    rows = {r.doc_id: r for r in quality_scores(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), labels).collect()}
    for i, text in enumerate(texts):
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
        repeated = {k + d for k, w in enumerate(windows) if windows.count(w) > 1 for d in range(3)} if len(words) < 3000 else None
        r = rows[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == (len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(lines) - len(set(lines)))
        if repeated is not None:
            assert r.n_repeat_words == len(repeated)
            assert r.base_failed == (len(words) < 50 or 100 * len(repeated) > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_quality_is_held_out_accurate(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = "crc32(cast(doc_id as string)) % 5 = 0"
    scored = quality_scores(docs, labels.where(f"not ({held})")).join(labels.where(held).where("quality in (0, 1)"), "doc_id")
    good, bad = ([r.p for r in scored.where(f"quality = {q}").selectExpr("probability >= 0.5 AS p").collect()] for q in (1, 0))
    assert sum(good) >= 0.95 * len(good) and sum(bad) <= 0.2 * len(bad)


def test_packing_gap_and_small_tasks(spark):
    """Exchange between tasks comes near to what one task finds, and never below the bound."""
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 1500, 3000)]
    pieces = spark.createDataFrame([(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)], "uid long, doc_id long, piece int, start long, length long, ids_crc32 long")
    used = {}
    for per_task in (100, 10_000):
        packed = pack(pieces, per_task=per_task)
        assert sorted(r.length for r in packed.collect()) == sorted(lengths)
        used[per_task], bound = packing_gap(packed)
        assert bound <= used[per_task]
    assert used[100] <= 1.02 * used[10_000] and used[10_000] <= 1.01 * bound


def test_mixture_of_clashing_columns(docs):
    rows = mixture(docs)
    taken = {}
    for r in rows.collect():
        taken[(r.doc_id, r.size)] = taken.get((r.doc_id, r.size), 0) + r["copies"]
    out = mixed_documents(docs)
    found = {}
    for r in out.collect():
        key = (r.doc_id, len((r.text or "").split()))
        found[key] = found.get(key, 0) + 1
    assert found == {k: n for k, n in taken.items() if n and k[1]}


def test_nearest_ties_nulls_and_empty_tables(spark):
    schema = "vec_id long, embedding array<double>, rank int, score string"
    rows = [(i, [1.0, 0.0], 0, "") for i in (9, 3, 5, 3)] + [(20, [0.0, 1.0], 0, ""), (None, [1.0, 0.0], 0, ""), (7, None, 0, ""), (8, [0.0, 0.0], 0, ""), (10, [float("nan"), 1.0], 0, ""), (11, [None, 1.0], 0, ""), (12, [], 0, ""), (13, [1.0, 2.0, 3.0], 0, "")]
    vectors = spark.createDataFrame(rows, schema)
    found = {}
    for r in nearest(vectors, vectors).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert found[3] == [(1, 5, 1.0), (2, 9, 1.0), (3, 20, 0.0)] and found[20] == [(1, 3, 0.0), (2, 5, 0.0), (3, 9, 0.0)]
    assert set(found) == {3, 5, 9, 20}
    assert nearest(vectors.where("vec_id < 0"), vectors).count() == nearest(vectors, vectors.where("vec_id < 0")).count() == 0


def test_archives_of_odd_pages(spark):
    pages = [(None, None, "x" * 50), (4, "a b", "x" * 50), (4, None, "x" * 50), (6, None, "x" * 50), (None, None, "only without ids"), (None, None, "only without ids"), (7, "u", None)]
    rows = sorted(((r.page_id, r.record_type, r.refers_to) for r in round_trip(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()), key=str)
    assert rows == sorted([(None, "revisit", 4), (4, "response", None), (4, "response", None), (6, "revisit", 4), (None, "response", None), (None, "response", None), (7, "response", None)], key=str)
    assert round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_damaged_archives_have_errors(spark):
    folder = scratch_path(spark, "damaged").removeprefix("file://")
    pages = spark.createDataFrame([(i, None, f"page {i} " * 40) for i in range(20)], "page_id long, url string, html string").coalesce(1)
    path = write_archives(pages, f"file://{folder}").first().path.removeprefix("file://")
    with open(path, "rb") as f:
        good = f.read()
    end = 8 + int.from_bytes(good[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(good[8:end]))
    packer = zstandard.ZstdCompressor(dict_data=dictionary)
    bad = {"cut": good[:-5], "nodict": good[end:], "length": good[:end] + packer.compress(b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: x\r\nWARC-Date: y\r\nContent-Length: 9\r\n\r\nabc\r\n\r\n"), "header": good[:end] + packer.compress(b"HTTP/1.1 200 OK\r\n\r\n"), "short": SKIPPABLE + b"\xff\xff\0\0"}
    for name, data in bad.items():
        with open(f"{folder}/{name}.warc.zst", "wb") as f:
            f.write(data)
    rows = read_archives(spark, f"file://{folder}").collect()
    assert sum(r.error is not None for r in rows) == len(bad) and len({r.page_id for r in rows if r.error is None}) == 20


def _shingles(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return ({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}) if words else set()


def test_pipeline_stage_by_stage(spark, labels):
    """Each stage against a plain form of itself, on what its predecessor kept."""
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.predicted for r in toxicity_scores(docs, labels).collect()}
    kept = materialise(stages["toxicity"](spark, docs, SF_DIR), "t1")
    assert {r.doc_id for r in kept.collect()} == {i for i in before if scores[i] == 0}

    rows = {r.doc_id: r for r in kept.collect()}
    sets, label = {i: _shingles(r.text, 5) for i, r in rows.items()}, {i: i for i in rows}
    ids = sorted(rows)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {i: new if x == old else x for i, x in label.items()}
    unique = materialise(stages["near_duplicates"](spark, kept, SF_DIR), "t2")
    assert {r.doc_id for r in unique.collect()} == {i for i in ids if label[i] == i}

    clean = materialise(stages["personal_data"](spark, unique, SF_DIR), "t3")
    found = {r.doc_id: r.found for r in personal_data(unique).collect()}
    for r in clean.collect():
        text, out, at = rows[r.doc_id].text, "", 0
        for s in sorted(found[r.doc_id], key=lambda s: (s.start, s.end)):
            if s.start >= at:
                out += text[at : s.start] + f"<{s.kind.upper()}>"
            at = max(at, s.end)
        if not any(a.start < b.end and b.start < a.end for a in found[r.doc_id] for b in found[r.doc_id] if a is not b):
            assert r.text == ((out + text[at:]) if found[r.doc_id] else text)
        assert not any(m in (r.text or "") for m in re.findall(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+\.[a-z]+", text or ""))

    mixed = materialise(stages["mixture"](spark, clean, SF_DIR), "t4")
    copies = {r.doc_id: r["copies"] for r in mixture(clean).collect()}
    assert {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()} == {i: n for i, n in copies.items() if n}
    packed = stages["packing"](spark, mixed, SF_DIR)
    assert packed.where("piece = 0").count() == mixed.count() and packed.groupBy("sequence_id").sum("length").where("`sum(length)` > 2048").count() == 0
    run = corpus_pipeline.run(spark, SF_DIR)
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in run.collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed.collect())


def test_a_query_id_with_two_vectors_asks_with_the_least(spark):
    data = np.random.default_rng(3).standard_normal((60, 4))
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "vec_id long, embedding array<double>")
    both = [(100, data[5].tolist()), (100, (-data[5]).tolist())]
    least = min(both, key=lambda r: r[1])[1]
    wanted = [int(i) for i in np.argsort(-(data @ np.array(least)), kind="stable")[:3]]
    for order in (both, both[::-1]):
        rows = nearest(vectors, spark.createDataFrame(order, vectors.schema).repartition(2), k=3).orderBy("rank").collect()
        assert [r.vec_id for r in rows] == wanted
