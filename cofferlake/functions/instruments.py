"""Exchange suffixes, currencies and ticker spellings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of tickers in the order in which they are looked for, and the exchange each names.
EXCHANGES = (
    (".PA", "Euronext Paris"), (".L", "London (LSE)"), (".DE", "Frankfurt (XETRA)"), (".AS", "Euronext Amsterdam"), (".MI", "Milan (Borsa)"), (".SW", "Swiss (SIX)"), (".MC", "Madrid"),
    (".BR", "Brussels"), (".HE", "Helsinki"), (".ST", "Stockholm"), (".OL", "Oslo"), (".CO", "Copenhagen"), (".TO", "Toronto (TSX)"), (".HK", "Hong Kong"), (".T", "Tokyo"),
)
#: Currency by exchange; all others are USD.
CURRENCIES = {
    "Euronext Paris": "EUR", "Frankfurt (XETRA)": "EUR", "Euronext Amsterdam": "EUR", "Milan (Borsa)": "EUR", "Madrid": "EUR", "Brussels": "EUR",
    "Helsinki": "EUR", "London (LSE)": "GBP", "Swiss (SIX)": "CHF", "Stockholm": "SEK", "Oslo": "NOK", "Copenhagen": "DKK", "Toronto (TSX)": "CAD",
    "Hong Kong": "HKD", "Tokyo": "JPY",
}
#: Suffixes in files and the ones that price feeds use.
SUFFIXES = {
    "FRK": "DE", "FRA": "DE", "ETR": "DE", "GER": "DE", "GF": "DE", "GY": "DE", "AMS": "AS", "AEX": "AS", "PAR": "PA", "EPA": "PA", "FP": "PA",
    "MCE": "MC", "MAD": "MC", "BME": "MC", "MIL": "MI", "BIT": "MI", "MTA": "MI", "LIS": "LS", "ELI": "LS", "EL": "LS", "BRU": "BR", "EBR": "BR",
    "SWX": "SW", "EBS": "SW", "VTX": "SW", "SIX": "SW", "LON": "L", "LSE": "L", "CPH": "CO", "STO": "ST", "HEL": "HE", "OSL": "OL", "VIE": "VI",
    "ICE": "IC",
}
#: Suffixes to try behind a base, and behind a symbol without a dot, in this order.
EUROPEAN = ("DE", "PA", "AS", "MI", "MC", "SW", "L", "BR", "LS", "CO", "ST", "HE", "OL")
UNDOTTED = ("PA", "L", "DE", "MC", "SW", "AS", "MI", "BR", "HE", "ST", "OL", "CO")
#: Words in names, of which the first in this order counts, and the tickers to try for them.
KEYWORDS = {
    "cellnex": ("CLNX", "CLNX.MC"), "covestro": ("1COV.DE", "COV.DE"), "prosus": ("PRX.AS", "PROSUS"), "adyen": ("ADYEN.AS", "ADYEY"), "just eat": ("JET.L", "TKWY.AS"), "moncler": ("MONC.MI", "MONRF"),
    "sartorius": ("SRT.DE", "SRT3.DE"), "nestle": ("NESN.SW", "NSRGY"), "roche": ("ROG.SW", "RHHBY"), "novartis": ("NOVN.SW", "NVS"), "asml": ("ASML.AS", "ASML"), "lvmh": ("MC.PA", "LVMUY"),
    "hermes": ("RMS.PA", "HESAY"), "schneider": ("SU.PA", "SBGSF"), "totalenergies": ("TTE.PA", "TTE"), "airbus": ("AIR.PA", "EADSY"),
}
#: Legal forms that end a company's name.
LEGAL_FORMS = ("SA", "NV", "AG", "SE", "PLC", "INC", "CORP", "LTD", "SPA", "ASA", "OYJ")


def _looked_up(key: Column, table: dict[str, str]) -> Column:
    return F.get(F.array(*[F.lit(v) for v in table.values()]), F.array_position(F.array(*[F.lit(k) for k in table]), key).cast("int") - 1)


def detect_exchange(ticker: Column) -> Column:
    first, *rest = EXCHANGES
    found = reduce(lambda c, x: c.when(ticker.contains(x[0]), x[1]), rest, F.when(ticker.contains(first[0]), first[1]))
    return F.when(F.coalesce(ticker, F.lit("")) == "", "Unknown").otherwise(F.coalesce(found, F.lit("US")))


def exchange_currency(exchange: Column) -> Column:
    return F.coalesce(_looked_up(exchange, CURRENCIES), F.lit("USD"))


def pricing_symbol(symbol: Column) -> Column:
    """Upper-case ticker with the suffix that price feeds use."""
    s = F.upper(symbol)
    suffix, base = F.substring_index(s, ".", -1), F.regexp_replace(s, r"\.[^.]*$", "")
    mapped = _looked_up(suffix, SUFFIXES)
    return F.when(s.contains(".") & mapped.isNotNull(), F.concat_ws(".", base, mapped)).otherwise(s)


def first_keyword(name: Column, keywords: tuple[str, ...]) -> Column:
    """Zero-based place in ``keywords`` (lower case) of the first of them that is in ``name``, in one pass over it."""
    hits = F.regexp_extract_all(F.lower(name), F.lit(f"(?=({'|'.join(keywords)}))"), F.lit(1))
    return F.array_min(F.transform(hits, lambda w: F.array_position(F.array(*[F.lit(k) for k in keywords]), w))).cast("int") - 1


def alternative_symbols(symbol: Column, name: Column) -> Column:
    """Other spellings to try, in order.

    With a dot: the mapped suffix, if it is another one, European suffixes behind what stands before the first dot, and
    that alone; else twelve suffixes. Then the tickers of the first keyword in the name, and the name's first word of 3 to
    6 characters.
    """
    s, base = F.upper(symbol), F.upper(F.substring_index(symbol, ".", 1))
    behind = lambda x, suffixes: F.array(*[F.concat_ws(".", x, F.lit(k)) for k in suffixes])
    mapped = pricing_symbol(symbol)
    spelled = F.when(symbol.contains("."), F.concat(F.array(F.when(mapped != s, mapped)), behind(base, EUROPEAN), F.array(base))).otherwise(behind(symbol, UNDOTTED))
    known = F.get(F.array(*[F.array(*[F.lit(t) for t in tickers]) for tickers in KEYWORDS.values()]), first_keyword(name, tuple(KEYWORDS)))
    word = F.substring_index(F.trim(F.get(F.split(name, rf"(?i)\s+(?:{'|'.join(LEGAL_FORMS)})"), F.lit(0))), " ", 1)
    named = F.concat(F.coalesce(known, F.array().cast("array<string>")), F.array(F.when(F.length(word).between(3, 6), F.upper(word))))
    tried = F.concat(spelled, F.when((name != "") & (name != symbol), named).otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.filter(tried, lambda x: x.isNotNull()))
