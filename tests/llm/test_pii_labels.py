"""Weakly supervised spans: planted ones are found and decoys left alone, whatever fills the table."""

import pytest
from pyspark.sql import functions as F

from cofferlake.llm.pii import personal_data, redacted

PLANTED = {
    1: ("write to foo [at] bar [dot] com today", "masked_email", "foo [at] bar [dot] com"),
    2: ("we met Frau Anna Schmidt, who left", "name", "Frau Anna Schmidt"),
    3: ("she lives at Hauptstraße 12, Berlin", "address", "Hauptstraße 12"),
    4: ("IBAN: DE89 3704 0044 0532 0130 00 please", "bank", "DE89 3704 0044 0532 0130 00"),
    5: ("call 212-555-0147 after six", "number", "212-555-0147"),
    6: ("my ssn is 078-05-1120, keep it", "number", "078-05-1120"),
    7: ("Mr. John Smith said so", "name", "Mr. John Smith"),
    8: ("reach me: jane.doe(at)example.org", "masked_email", "jane.doe(at)example.org"),
    9: ("come to 221 Baker Street, London", "address", "221 Baker Street"),
}
DECOYS = [
    "Version 1234 5678 9012 of the page", "see page 123-456-789 for more", "chapter 12.34.56 begins", "ISBN 978 316 148 410 in print", "order 12-3456-78 shipped", "on 2024-01-15 it rained", "between 15.01.2024 and later", "licence 1234-5678-90",
    "doi 10.1234.5678.90 cited", "section 11-22-33-44", "copyright 1999-2004-2010", "bank DE89 3704 0044 0532 0130 01 here", "the price $ 1234 5678 90", "part 4444 333 22 is red", "serial 98-7654-32-10 on it", "GB82 WEST 1234 5698 7654 33 is wrong",
    "release 20.04.13 is out", "item 12 3456 7890 in stock", "row 1111 222 33 4444", "AB12 CDEF 3456 GHIJ 7890",
]


def _check(spark, docs):
    rows = {r.doc_id: r for r in personal_data(docs).where(F.col("doc_id") < 0).collect()}
    for i, (text, kind, span) in PLANTED.items():
        at = text.index(span)
        found = [(s.kind, s.start, s.end) for s in rows[-i].found]
        assert found == [(kind, at, at + len(span))], (text, found)
    wrong = [(d, rows[-100 - k].spans) for k, d in enumerate(DECOYS) if rows[-100 - k].spans]
    assert not wrong, wrong


@pytest.fixture(scope="module")
def planted(spark):
    rows = [(-i, t) for i, (t, _, _) in PLANTED.items()] + [(-100 - k, d) for k, d in enumerate(DECOYS)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_among_documents(spark, planted):
    _check(spark, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").unionByName(planted))


def test_by_themselves(spark, planted):
    _check(spark, planted)


@pytest.mark.parametrize("filler", ["she lives at Hauptstraße {}, 10115 Berlin", "part {0} of 12 34 {0} in stock", "call 212-555-{0}, it is Mr. John Smith", "version 12.{0}.34.5 is out"])
def test_in_a_table_full_of_one_kind(spark, planted, filler):
    parts = filler.replace("{0}", "{}").split("{}")
    number = (F.col("id") % 9000 + 1000).cast("string")
    text = F.concat(*[x for p in parts for x in (F.lit(p), number)][:-1])
    _check(spark, spark.range(20_000).select(F.col("id").alias("doc_id"), text.alias("text")).unionByName(planted))


def test_one_masked_address_alone(spark):
    rows = spark.createDataFrame([(1, "mail joe [at] site [dot] net now")], "doc_id long, text string")
    assert personal_data(rows).first().spans == "masked_email:5:28"


def test_overlapping_spans(spark):
    """A number within an IBAN is listed once; base spans stay, though they overlap each other, and redaction covers all."""
    text = "IBAN DE89 3704 0044 0532 0130 00, card 4111 1111 1111 1111, +49 4111 1111 1111 1111 and 10.0.0.1"
    rows = spark.createDataFrame([(i, text) for i in range(3)], "doc_id long, text string")
    spans = personal_data(rows).first().spans.split(",")
    loose = [tuple(map(int, s.split(":")[1:])) for s in spans if s.startswith(("bank", "number"))]
    base = [tuple(map(int, s.split(":")[1:])) for s in spans if not s.startswith(("bank", "number"))]
    assert "bank:5:32" in spans and all(b <= x or a >= y for a, b in loose for x, y in loose if (a, b) != (x, y))
    assert all(b <= x or a >= y for a, b in loose for x, y in base)
    cleaned = redacted(rows).first().text
    assert sum(c.isdigit() for c in cleaned) <= 2, cleaned
