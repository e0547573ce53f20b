"""Queries reach every row; that their rows are right is in test_queries."""

import pytest
from pyspark.sql import functions as F

from cofferlake.plans import imports, load
from cofferlake.plans.registry import QUERIES
from cofferlake.plans.views import Views

SF_DIR = "/root/testdata/sf0.001"
load()


@pytest.fixture(scope="module")
def views(spark):
    return Views(spark, SF_DIR)


def test_every_text_is_normalised(spark, views):
    rows = QUERIES["f11_normalize_name"](spark, SF_DIR)
    docs = views.table("documents")
    assert rows.count() == docs.count()
    assert rows.agg(F.max(F.length("name"))).first()[0] > 80


@pytest.mark.parametrize("name", ["f12_match_scans", "f13_fuzzy_match_scans"])
def test_every_user_is_scanned(spark, views, name):
    seen = QUERIES[name](spark, SF_DIR).select("user_id").distinct().count()
    users = views.lots.select("user_id").distinct().count()
    assert seen == users if name.startswith("f12") else seen > users / 2


def test_every_lot_has_a_result(spark, views):
    assert QUERIES["b26_b28_model_results"](spark, SF_DIR).count() == views.lots.count()


def test_every_ledger_row_is_in_one_statement(views):
    lines = sum(files.where("line_no > 1").count() for files in (imports.transaction_lines(views), imports.account_lines(views), imports.app_lines(views)))
    assert lines == views.ledger.count()
