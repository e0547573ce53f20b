"""Text, number and date expressions of statements, names and notes."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

def _marked() -> dict[str, str]:
    """Each character whose decomposition holds combining marks (U+0300 to U+036F), and what is left without them."""
    split = {chr(c): unicodedata.normalize("NFD", chr(c)) for c in range(0xC0, sys.maxunicode + 1) if unicodedata.decomposition(chr(c))}
    bare = {c: "".join(m for m in d if not "\u0300" <= m <= "\u036f") for c, d in split.items()}
    return {c: b for c, b in bare.items() if b != split[c]}


_MARKED = _marked()
_ACCENTED, _PLAIN = "".join(c for c, b in _MARKED.items() if len(b) == 1), "".join(b for b in _MARKED.values() if len(b) == 1)


#: Characters that count as blank around a cell.
BLANKS = " \t\n\r\v\f\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """``f(x)`` with ``x`` worked out once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def stripped(x: Column) -> Column:
    return F.btrim(x, F.lit(BLANKS))


def no_accents(x: Column) -> Column:
    """Letters of any script without their combining marks, whether one character or several."""
    return F.regexp_replace(F.translate(x, _ACCENTED, _PLAIN), "[\u0300-\u036f]", "")


def normalize_name(x: Column) -> Column:
    """Lower case without accents, one kind of apostrophe, single spaces."""
    # A text of as many bytes as characters has no accents to look for.
    same = F.when(F.octet_length(x) == F.length(x), F.replace(x, F.lit("`"), F.lit("'"))).otherwise(F.regexp_replace(no_accents(x), "[’‘`´]", "'"))
    return F.lower(F.trim(F.regexp_replace(same, r"\s+", " ")))


def norm_header(x: Column) -> Column:
    """Header cell as lower-case letters, digits and spaces."""
    return F.trim(F.regexp_replace(F.lower(no_accents(x)), "[^a-z0-9 ]", ""))


def is_isin(x: Column) -> Column:
    return F.coalesce(F.upper(F.trim(x)).rlike("^[A-Z]{2}[A-Z0-9]{10}$"), F.lit(False))


def valid_text(x: Column) -> Column:
    return F.coalesce(F.length(F.trim(x)) > 0, F.lit(False))


def parse_number_broker(x: Column) -> Column:
    """Number in a broker's notation; the last separator is the decimal one, a lone comma unless three digits follow."""

    def parsed(kept: Column, plain: Column) -> Column:
        behind = F.substring_index(plain, ",", -1)
        lone = F.length(F.substring_index(plain, ",", 1)) + 1 + F.length(behind) == F.length(plain)
        european = F.replace(F.replace(plain, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
        english = F.replace(plain, F.lit(","), F.lit(""))
        # A text that is no number costs the cast an exception, so the usual one, an empty cell, is kept from it.
        number = (
            F.when(plain == "", None)
            .when(~plain.contains(","), F.when(F.length(F.replace(plain, F.lit("."), F.lit(""))) + 1 < F.length(plain), F.replace(plain, F.lit("."), F.lit(""))).otherwise(plain))
            .when(plain.contains("."), F.when(behind.contains("."), english).otherwise(european))
            .when(lone & (F.length(behind) != 3), european)
            .otherwise(english)
        )
        return number.try_cast("double") * F.when(_minus(kept), -1.0).otherwise(1.0)

    # A class that holds a character beyond Latin-1 takes Java ten times as long, so one sign of minus stands for both.
    kept = F.regexp_replace(F.replace(x, F.lit("−"), F.lit("-")), r"[^0-9.,()\-]", "")
    return let(kept, lambda k: let(reduce(lambda c, sign: F.replace(c, F.lit(sign), F.lit("")), "()-", k), lambda p: parsed(k, p)))


def _minus(x: Column) -> Column:
    """Whether a text starts with a minus or is in parentheses."""
    return x.startswith("-") | x.startswith("−") | (x.startswith("(") & x.rlike(r"^\(.*\)$"))


def parse_signed_number(x: Column) -> Column:
    """The magnitude that ``parse_number_broker`` finds, negative after a leading minus or in parentheses."""
    return signed(parse_number_broker(x), x)


def signed(value: Column, text: Column) -> Column:
    """The magnitude of ``value`` with the sign that its text shows."""
    return F.when(_minus(F.trim(text)), -F.abs(value)).otherwise(F.abs(value))


def parse_number_holdings(x: Column) -> Column:
    """Number in a holdings file, without currency signs, blanks and the letters c, h, k, r.

    Dots before groups of three digits mark thousands and the comma after them decimals; a lone comma before one or two
    digits is decimal as well; all other commas go. Parentheses are a minus. Of what remains the leading number counts
    ('3M' is 3), so letters in front ('CHF 12.5' leaves 'F12.5') give null.
    """
    kept = F.regexp_replace(F.coalesce(x, F.lit("")), r"(?i)[€$£¥chkr\s\p{Z}\uFEFF]", "")
    kept = F.regexp_replace(kept, r"^\((.+)\)$", "-$1")
    grouped, decimal = kept.rlike(r"^[0-9]{1,3}(?:\.[0-9]{3})*(?:,[0-9]+)?$"), kept.rlike(r"^[0-9]+,[0-9]{1,2}$")
    plain = F.when(grouped, F.translate(kept, ",.", ".")).when(decimal, F.translate(kept, ",", ".")).otherwise(F.translate(kept, ",", ""))
    return F.nullif(F.regexp_extract(plain, r"^[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", 0), F.lit("")).try_cast("double")


#: Signs and codes of currencies in the order in which they are looked for.
CURRENCY_SIGNS = (("$", "USD"), ("€", "EUR"), ("£", "GBP"), ("CHF", "CHF"), ("SEK", "SEK"), ("¥", "JPY"), ("JPY", "JPY"))


def currency_of_text(x: Column, fallback: Column) -> Column:
    text = F.upper(F.coalesce(x, F.lit("")))
    signs = reduce(lambda c, sign: c.when(text.contains(sign[0]), sign[1]), CURRENCY_SIGNS[1:], F.when(text.contains("$"), "USD"))
    found = F.coalesce(signs, F.nullif(F.regexp_extract(text, r"\b([A-Z]{3})\b", 1), F.lit("")), fallback)
    return F.when(x.isin(*sorted({code for _, code in CURRENCY_SIGNS})), x).otherwise(found)


def normalize_date(x: Column) -> Column:
    """Day-month-year, then year-month-day, then whatever Spark reads as a date, else the text itself."""
    text = F.trim(x)
    pad = lambda c: F.lpad(c, 2, "0")
    dmy = lambda k: F.regexp_extract(text, r"^(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)", k)
    ymd = lambda k: F.regexp_extract(text, r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})", k)
    year = F.when(F.length(dmy(3)) == 2, F.concat(F.lit("20"), dmy(3))).otherwise(dmy(3))
    # Most dates have all their digits, so one look tells where they are.
    part = lambda at, n: F.substring(text, at, n)
    free = F.coalesce(F.try_to_timestamp(text, F.lit("MMM d, yyyy")), F.try_to_timestamp(text, F.lit("d MMM yyyy")), F.try_to_timestamp(text))
    found = F.when(dmy(1) != "", F.concat_ws("-", year, pad(dmy(2)), pad(dmy(1)))).when(ymd(1) != "", F.concat_ws("-", ymd(1), pad(ymd(2)), pad(ymd(3)))).otherwise(F.coalesce(F.date_format(free, "yyyy-MM-dd"), text))
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), part(1, 10)).when(text.rlike(r"^\d{2}[-/.]\d{2}[-/.]\d{4}(?!\d)"), F.concat_ws("-", part(7, 4), part(4, 2), part(1, 2))).otherwise(found)


def csv_separator(header: Column) -> Column:
    tab, semi, comma = (F.regexp_count(header, F.lit(c)) for c in ("\t", ";", ","))
    return F.when((tab > 0) & (tab >= semi) & (tab >= comma), "\t").when(semi > comma, ";").otherwise(",")


def clean_model_json(x: Column) -> Column:
    """Model output as JSON: no code fences, Python literals and trailing commas replaced."""
    out = F.trim(F.regexp_replace(x, r"```(?:json)?", ""))
    for word, json in (("None", "null"), ("True", "true"), ("False", "false")):
        out = F.regexp_replace(out, rf"(?<=[:\[,\s]){word}(?=\s*[,\]}}])", json)
    return F.regexp_replace(out, r",\s*(?=[\]}])", "")


def critic_score(notes: Column) -> Column:
    return F.nullif(F.regexp_extract(notes, r"(?i)(\d{2,3})\s*(?:/\s*100|points?)", 1), F.lit("")).cast("int")
