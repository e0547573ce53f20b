"""Numbers, names and CSV lines in odd spellings."""

import pytest
from pyspark.sql import functions as F

from cofferlake.functions.text import normalize_name, parse_number_broker, parse_number_holdings
from cofferlake.operators.statements import parse_holdings, split_csv


def _each(spark, f, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, x string").select("i", f(F.col("x")).alias("y"))
    return [r.y for r in rows.orderBy("i").collect()]


def test_numbers_of_holdings(spark):
    cases = {
        "1,234": 1.234, "1.234": 1234, "3M": 3, "1.234,56 €": 1234.56, "$1,234.56": 1234.56, "n/a": None, "CHF 12.5": None, "": None, None: None,
        "12,345,678": 12345678, "1234,567": 1234567, "12,50": 12.5, "(12.5)": -12.5, "1.234.567,8": 1234567.8, "kr 100": 100, "-5": -5, "1e3": 1000, "1\u00a0234": 1234,
        "5.": 5, ".5": 0.5, "HK$ 7": 7, "12.5 pcs": 12.5,
    }
    assert _each(spark, parse_number_holdings, list(cases)) == list(cases.values())


def test_numbers_of_brokers(spark):
    cases = {"1,234": 1234, "1.234": 1.234, "(12.5)": -12.5, "1.234,56": 1234.56, "12,5": 12.5, "1.234.567": 1234567, "−3": -3, "": None, None: None}
    assert _each(spark, parse_number_broker, list(cases)) == list(cases.values())


def test_names_without_marks(spark):
    cases = {"Château  MARGAUX": "chateau margaux", "Tře\u0301boň": "trebon", "Kőszeg": "koszeg", "ş": "s", "a\u0301": "a", "l’Évangile ": "l'evangile", "ØÆß": "øæß", "Ǭ": "o", None: None}
    assert _each(spark, normalize_name, list(cases)) == list(cases.values())


@pytest.mark.parametrize("sep", [",", ";", "\t"])
def test_csv_lines(spark, sep):
    cases = {
        "a,b,,": ["a", "b", "", ""], '"a,b",c': ["a,b", "c"], '"say ""hi""", x ': ['say "hi"', "x"], 'a"b,c"d,e': ["ab,cd", "e"], '"open,rest': ["open,rest"], "": [""], '"",""': ["", ""],
        ",".join(map(str, range(100))): [str(i) for i in range(100)], '"' + "long, " * 20000 + '"': ["long, " * 19999 + "long,"],
    }
    swap = lambda t: t.replace(",", sep)
    found = _each(spark, lambda c: split_csv(c, F.lit(sep)), [swap(t) for t in cases])
    assert found == [[swap(c).strip() for c in cells] for cells in cases.values()]


def test_holdings_keep_every_digit(spark):
    """Cells in any place of a line are trimmed of blanks only."""
    text = "Ticker|Name|Qty|Invested|Type\nA|0 name 0|22| 31429.60 |44\nB|x|44|1,5|3\n\n|no symbol|1|1|\n"
    rows = {r.line_no: r for r in parse_holdings(spark.createDataFrame([("f", text)], "file string, value string")).collect()}
    assert (rows[2].shares, round(rows[2].price * 22, 2), rows[2].name) == (22.0, 31429.6, "0 name 0")
    assert (rows[3].shares, round(rows[3].price * 44, 2)) == (44.0, 1.5)
    assert rows[5].kind == "error"
