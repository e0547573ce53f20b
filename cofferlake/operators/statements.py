"""Statement files, holdings files and model responses as rows, for many files at once.

Statements come as lines (file, line_no, line), as ``sources.statements`` reads them, so that one large file is the work
of several tasks: what its header says is found once a file and joined to its lines. A text that is a cell of a table
(file, value) is taken apart in its row. Fields are picked by the header's column positions, and a ``kind`` column says
what a line became: trade, income, review, skipped or error.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.functions.text import clean_model_json, csv_separator, currency_of_text, is_isin, norm_header, normalize_date, parse_number_broker, parse_number_holdings, parse_signed_number, signed, stripped
from cofferlake.sources.shared import stored

#: Names of columns in statements, as ``norm_header`` writes them.
TRANSACTION_COLUMNS = {
    "date": ("date", "data", "datum"),
    "product": ("product", "produto", "produkt"),
    "isin": ("isin",),
    "qty": ("quantity", "quantidade", "aantal", "menge", "qty", "number"),
    "price": ("price", "preco", "koers", "kurs", "prix"),
    "fees": ("transaction and or third party fees", "transaction costs", "costs", "custos", "comissoes", "kosten", "fee", "fees", "gebuhren"),
}
APP_COLUMNS = {
    "date": ("date", "completed date", "date acquired", "started date"),
    "ticker": ("ticker", "symbol"),
    "type": ("type", "transaction type"),
    "qty": ("quantity", "qty", "shares", "number of shares"),
    "price": ("price per share", "price"),
    "total": ("total amount", "total", "amount"),
    "currency": ("currency", "ccy"),
    "tax": ("withholding tax", "tax"),
}
ACCOUNT_COLUMNS = {
    "date": ("data",),
    "value_date": ("data valor", "value date", "valuedate"),
    "isin": ("isin",),
    "desc": ("descricao", "description", "omschrijving"),
    "change": ("mudanca", "change", "mutatie"),
}
#: Columns without which a statement cannot be read.
TRANSACTION_NEED, APP_NEED, ACCOUNT_NEED = ("isin", "qty", "price"), ("ticker", "type", "qty"), ("isin", "desc", "change")
#: Names of columns in holdings files.
HOLDINGS_COLUMNS = {
    "symbol": ("ticker", "symbol", "isin", "code", "instrument", "stock", "asset code", "security", "id", "wkn", "sedol", "cusip", "valor"),
    "shares": ("shares", "quantity", "qty", "units", "amount of shares", "no. of shares", "no of shares", "number of shares", "holding", "holdings", "position", "volume", "lots", "antal"),
    "price": ("avg price", "avg unit price", "average price", "avg cost", "average cost", "unit cost", "cost price", "purchase price", "buy price", "price per share", "price/share", "entry price", "cost basis per share", "cost/share", "avg unit cost", "prix moyen", "snitt"),
    "name": ("asset", "asset name", "name", "company", "company name", "description", "security name", "instrument name", "stock name", "product"),
    "platform": ("platform", "broker", "account", "exchange", "market", "provider", "source", "brokerage"),
    "type": ("type", "asset type", "security type", "instrument type", "asset class", "category", "class"),
    "amount": ("invested", "invested amount", "total invested", "total cost", "cost basis", "total amount", "amount invested", "book value", "book cost", "market value", "value", "total value"),
}
#: Spellings of the asset types.
ASSET_TYPES = {
    "Stock": ("stock", "stocks", "equity", "equities", "common stock", "ordinary share", "ordinary shares", "share", "shares", "adr", "gdr", "preferred stock", "preference share"),
    "ETF": ("etf", "etp", "fund", "index fund", "exchange traded fund", "mutual fund", "tracker", "ucits", "sicav", "oeic", "unit trust"),
    "Crypto": ("crypto", "cryptocurrency", "digital asset", "token", "coin"),
    "REIT": ("reit", "real estate", "real estate investment trust"),
    "Bond": ("bond", "bonds", "fixed income", "debt", "note", "treasury", "government bond", "corporate bond", "bond etf"),
    "Commodity": ("commodity", "commodities"),
    "Cash": ("cash", "money market"),
    "Other": ("other",),
}


def evaluated(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with more columns, each worked out once per row.

    They leave a generator, which no projection or filter is merged into; plain columns would be copied into every
    expression above them, and parsed cells are used many times. A projection below it works out what they share once.
    """
    made = df.select("*", F.struct(*[c.alias(k) for k, c in columns.items()]).alias("_made"))
    return made.select("*", F.inline(F.array("_made"))).drop("_made")


def _numbers(*columns: str) -> dict[str, Column]:
    """``n_<column>``: the broker's numbers of some text columns, each worked out once."""
    return {f"n_{c}": parse_number_broker(F.col(c)) for c in columns}


def normalize_asset_type(x: Column) -> Column:
    low = F.lower(F.trim(x))
    known = reduce(lambda c, kind: c.when(low.isin(*ASSET_TYPES[kind]), kind), list(ASSET_TYPES)[1:], F.when(low.isin(*ASSET_TYPES["Stock"]), "Stock"))
    return F.when(F.coalesce(x, F.lit("")) == "", "Stock").otherwise(F.coalesce(known, F.lit("Other")))


def detect_broker(text: Column) -> Column:
    head = F.lower(F.array_join(F.slice(F.split(text, "\r?\n"), 1, 3), "\n"))
    return (
        F.when(head.contains("price per share") & head.contains("total amount"), "revolut")
        .when(head.rlike(r"\bisin\b") & head.rlike(r"\bsaldo\b"), "degiro_account")
        .when(head.rlike(r"\bisin\b") & head.rlike("quantity|quantidade|aantal|menge|qty"), "degiro")
    )


def split_csv(line: Column, separator: Column) -> Column:
    """Cells of one line between tabs, semicolons or commas, trimmed, however many; quotes open and close anywhere, and doubled ones stand for one.

    A quote that never closes runs to the end of the line. No part of the pattern backtracks.
    """
    quotes = F.length(line) - F.length(F.replace(line, F.lit('"'), F.lit("")))
    closed = F.concat(line, F.when(quotes % 2 == 1, '"').otherwise(""), separator)
    cells = F.regexp_extract_all(closed, F.concat(F.lit('((?:"(?:[^"]++|"")*+"|[^"'), separator, F.lit(']++)*+)'), separator), F.lit(1))
    plain = lambda c: F.replace(F.regexp_replace(c, '"((?:[^"]++|"")*+)"', "$1"), F.lit('""'), F.lit('"'))
    odd = F.transform(cells, lambda c: F.when(c.contains('"'), plain(c)).otherwise(c))
    # Where quotes are neither doubled nor left open, every second part between them is quoted.
    mark = F.lit("\0")
    parts = F.transform(F.split(line, '"'), lambda x, i: F.when(i % 2 == 0, F.replace(x, separator, mark)).otherwise(x))
    easy = ~line.contains('""') & (quotes % 2 == 0) & ~line.contains("\0")
    cells = F.when(~line.contains('"'), F.split(line, separator)).when(easy, F.split(F.array_join(parts, ""), "\0")).otherwise(odd)
    # One look at the line saves its cells theirs: blanks beside a quote, separator or end, or characters beyond ASCII.
    blank = line.rlike(r'(?:^|[,;\t"])[\t ]|[\t ](?:[,;\t"]|$)|[^\t -~]')
    return F.when(blank, F.transform(cells, stripped)).otherwise(cells)


def find_col(header: Column, names: tuple[str, ...]) -> Column:
    """Zero-based position of the first header cell (as ``norm_header`` writes it) that is or contains one of the names; null if there is none."""
    hit = F.transform(header, lambda h: reduce(lambda a, b: a | b, [h.contains(n) for n in names]))
    return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)).cast("int") - 1


def _complete(need: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(f"at_{n}").isNotNull() for n in need], F.lit(True))


def file_heads(files: DataFrame) -> DataFrame:
    """For each file: ``opening``, its first three lines, and its first line that is not blank with that line's number."""
    if "value" in files.columns:
        lines = F.transform(F.split(F.coalesce("value", F.lit("")), "\r?\n"), lambda x, i: F.struct((i + 1).cast("long").alias("header_no"), x.alias("header_line")))
        heads = files.select("file", lines.alias("l")).withColumn("h", F.get(F.filter("l", lambda x: F.trim(x["header_line"]) != ""), F.lit(0)))
        return heads.select("file", F.array_join(F.transform(F.slice("l", 1, 3), lambda x: x["header_line"]), "\n").alias("opening"), "h.header_no", "h.header_line")
    opening = F.array_sort(F.collect_list(F.when(F.col("line_no") <= 3, F.struct("line_no", "line"))))
    heads = files.groupBy("file").agg(opening.alias("l"), F.min(F.when(F.trim("line") != "", F.struct("line_no", "line"))).alias("h"))
    return heads.select("file", F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("opening"), F.col("h.line_no").alias("header_no"), F.col("h.line").alias("header_line"))


def file_lines(files: DataFrame) -> DataFrame:
    """(file, line_no, line) of whole texts (file, value)."""
    return files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("_n", "line")).select("file", (F.col("_n") + 1).cast("long").alias("line_no"), "line")


def _placed(heads: DataFrame, columns: dict[str, tuple[str, ...]], need: tuple[str, ...]) -> DataFrame:
    """Files with the number of their header, separator, whether they have the columns ``need``, and where each column is."""
    heads = heads.where("header_line is not null").select("file", "header_no", "header_line")
    # Headers repeat from file to file: each spelling is taken apart once, and each of its cells written plainly once.
    kinds = evaluated(heads.select("header_line").distinct(), separator=csv_separator(F.col("header_line")))
    kinds = evaluated(kinds, header=F.transform(split_csv(F.col("header_line"), F.col("separator")), lambda h: F.coalesce(norm_header(h), F.lit(""))))
    kinds = evaluated(kinds, **{f"at_{k}": find_col(F.col("header"), v) for k, v in columns.items()})
    return heads.join(kinds, "header_line").select("file", "header_no", "separator", _complete(need).alias("complete"), *[f"at_{k}" for k in columns])


def _below(lines: DataFrame, placed: DataFrame) -> DataFrame:
    """Lines below the headers of their files, with what the headers say; a file without the columns is its header line."""
    return lines.join(placed, "file").where((F.col("complete") & (F.col("line_no") > F.col("header_no")) & (F.trim("line") != "")) | (~F.col("complete") & (F.col("line_no") == F.col("header_no"))))


def statement_rows(files: DataFrame, columns: dict[str, tuple[str, ...]], need: tuple[str, ...] = ()) -> DataFrame:
    """file, line_no, cells and the position of each named column (``at_<name>``); blank lines are dropped.

    A file that lacks one of the columns ``need`` is one row without line_no and cells. Lines that hold what their
    header says already (``parse_statements``) are not joined with it again.
    """
    rows = files
    if "header_no" not in files.columns:
        lines = file_lines(files) if "value" in files.columns else files.select("file", "line_no", "line")
        rows = _below(lines, _placed(file_heads(files), columns, need))
    rows = evaluated(rows, cells=F.when(F.col("complete"), split_csv(F.col("line"), F.col("separator"))))
    return rows.select("file", *[f"at_{k}" for k in columns], F.when(F.col("complete"), F.col("line_no")).alias("line_no"), "cells")


def _cell(name: str, shift: int = 0) -> Column:
    return F.get("cells", F.col(f"at_{name}") + shift)


EVENT = ("file", "line_no", "kind", "broker", "type", "date", "identifier", "is_isin", "shares", "price", "amount", "tax", "fees", "currency", "name", "reason")


def _event(rows: DataFrame, broker: str, **values: Column) -> DataFrame:
    null = {"type": "string", "date": "string", "identifier": "string", "is_isin": "boolean", "shares": "double", "price": "double", "amount": "double", "tax": "double", "fees": "double", "currency": "string", "name": "string", "reason": "string", "kind": "string"}
    cols = {k: values.get(k, F.lit(None)).cast(t) for k, t in null.items()}
    return rows.select("file", F.col("line_no").cast("long").alias("line_no"), F.lit(broker).alias("broker"), *[c.alias(k) for k, c in cols.items()]).select(*EVENT)


def _picked(files: DataFrame, columns: dict[str, tuple[str, ...]], need: tuple[str, ...], beside: str | None = None) -> DataFrame:
    """The named cells as columns, ``beside`` right of one of them, and whether the needed columns exist."""
    rows = statement_rows(files, columns, need)
    cells = {c: _cell(c) for c in columns} | ({"beside": _cell(beside, 1)} if beside else {})
    return evaluated(rows, complete=_complete(need), **cells).select("file", "line_no", "complete", *cells)


def parse_transactions(files: DataFrame) -> DataFrame:
    """Transactions export: the quantity's sign is the side, the price's currency stands right of the price."""
    r = _picked(files, TRANSACTION_COLUMNS, TRANSACTION_NEED, "price")
    r = evaluated(r, ident=F.upper(F.trim(F.coalesce("isin", F.lit("")))), day=normalize_date(F.col("date")), **_numbers("qty", "price", "fees"))
    ident, qty, price = F.col("ident"), signed(F.col("n_qty"), F.col("qty")), F.col("n_price")
    kind = F.when(~F.col("complete"), "error").when((ident == "") | qty.isNull() | (qty == 0), "skipped").when(price.isNull() | (price <= 0), "review").otherwise("trade")
    r = evaluated(r, kind=kind)
    out = _event(
        r, "degiro", kind=F.col("kind"), type=F.when(qty < 0, "sell").otherwise("buy"), date=F.col("day"), identifier=ident, is_isin=is_isin(ident), price=price,
        shares=F.when(F.col("kind") == "review", qty).otherwise(F.abs(qty)), fees=F.abs(F.coalesce("n_fees", F.lit(0.0))), currency=currency_of_text(F.coalesce(F.nullif("beside", F.lit("")), "price"), F.lit("EUR")), name=F.coalesce("product", F.lit("")),
        reason=F.when(F.col("kind") == "review", "corporate_action").when(F.col("kind") == "error", "ISIN, quantity or price column is missing"),
    )
    return detect_split_pairs(out)


def first_fits(buys: np.ndarray, sells: np.ndarray, least: float) -> list[int]:
    """For each price in ``buys``, in order, the place of the first free price in ``sells`` that differs ``least`` times, else -1.

    Trees over the places of free sells hold the greatest and the least price of each range, so a search walks down once.
    """
    size = 1 << max(len(sells) - 1, 0).bit_length()
    usable = sells > 0
    high, low = np.full(2 * size, -np.inf), np.full(2 * size, np.inf)
    high[size : size + len(sells)], low[size : size + len(sells)] = np.where(usable, sells, -np.inf), np.where(usable, sells, np.inf)
    for k in range(size - 1, 0, -1):
        high[k], low[k] = max(high[2 * k], high[2 * k + 1]), min(low[2 * k], low[2 * k + 1])
    out = []
    for price in buys.tolist():
        fits = lambda k: high[k] / price >= least or price / low[k] >= least  # noqa: E731, B023
        if not price > 0 or not fits(1):
            out.append(-1)
            continue
        k = 1
        while k < size:
            k = 2 * k if fits(2 * k) else 2 * k + 1
        out.append(k - size)
        high[k], low[k] = -np.inf, np.inf
        while k > 1:
            k //= 2
            high[k], low[k] = max(high[2 * k], high[2 * k + 1]), min(low[2 * k], low[2 * k + 1])
    return out


def _pairs_in_order(least: float, names: list[str]):
    """Over rows in order of group and line: pairs of a group become the buy's row, reviewed; other rows pass."""
    group = ("file", "identifier", "date", "_alone")

    def starts(table: pa.Table) -> np.ndarray:
        new = np.zeros(max(len(table) - 1, 0), bool)
        for c in group:
            codes = table.column(c).combine_chunks().dictionary_encode().indices.fill_null(-1)
            codes = np.asarray(codes)
            new |= codes[1:] != codes[:-1]
        return np.flatnonzero(np.concatenate([[True], new])) if len(table) else np.zeros(0, np.int64)

    def settled(table: pa.Table) -> pa.RecordBatch | None:
        at = starts(table)
        kind, side = table.column("kind").to_pylist(), np.asarray(table.column("type").to_pylist(), object)
        trade = np.array([k == "trade" for k in kind], bool)
        buys, sells = trade & (side == "buy"), trade & (side == "sell")
        ratio, sold = [None] * len(table), np.zeros(len(table), bool)
        many = (np.add.reduceat(buys, at, dtype=np.int64) > 0) & (np.add.reduceat(sells, at, dtype=np.int64) > 0) if len(at) else []
        if np.any(many):
            price, shares = (np.asarray(table.column(c).combine_chunks().fill_null(0.0)) for c in ("price", "shares"))
            ends = np.append(at[1:], len(table))
            for g in np.flatnonzero(many):
                b, s = (at[g] + np.flatnonzero(x[at[g] : ends[g]]) for x in (buys, sells))
                for i, k in zip(b.tolist(), first_fits(price[b], price[s], least)):
                    if k >= 0:
                        ratio[i], sold[s[k]] = float(shares[i]) / float(shares[s[k]]) if shares[s[k]] else None, True
                        kind[i] = "review"
        reason = table.column("reason").to_pylist()
        reason = ["possible_split" if t and k == "review" else r for t, k, r in zip(trade, kind, reason)]
        changed = {"kind": pa.array(kind, pa.string()), "reason": pa.array(reason, pa.string())}
        out = pa.Table.from_arrays([changed.get(c, table.column(c)) for c in names] + [pa.array(ratio, pa.float64())], names=[*names, "ratio"])
        return out.filter(pa.array(~sold)).combine_chunks()

    def run(batches):
        held: list[pa.Table] = []
        key = lambda t, k: tuple(t.column(c)[k].as_py() for c in group)
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not len(table):
                continue
            at = starts(table)
            if held and key(held[-1], len(held[-1]) - 1) == key(table, 0):
                cut = int(at[1]) if len(at) > 1 else len(table)
                held.append(table.slice(0, cut))
                table = table.slice(cut)
                if not len(table):
                    continue
                at = at[1:] - cut
            if held:
                yield from settled(pa.concat_tables(held)).to_batches()
            # The last group may go on in the next batch.
            yield from settled(table.slice(0, int(at[-1]))).to_batches()
            held = [table.slice(int(at[-1]))]
        if held:
            yield from settled(pa.concat_tables(held)).to_batches()

    return run


def detect_split_pairs(events: DataFrame, least: float = 3.0) -> DataFrame:
    """Buys and sells of one instrument and day whose prices differ ``least`` times become one reviewed split.

    Greedy in order of lines: each buy takes the first sell that fits and is free. The trades of one file, instrument and
    day are sorted together in a task; every other row is a group of its own.
    """
    rows = events.withColumn("_alone", F.when(F.col("kind") != "trade", F.col("line_no")))
    rows = rows.repartition("file", "identifier", "date", "_alone").sortWithinPartitions("file", "identifier", "date", "_alone", "line_no")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in events.schema)
    return rows.mapInArrow(_pairs_in_order(least, events.columns), f"{schema}, ratio double")


def parse_app_statement(files: DataFrame) -> DataFrame:
    """App broker's statement: trades, splits as share changes, dividends, fees; other movements are skipped."""
    r = _picked(files, APP_COLUMNS, APP_NEED)
    r = evaluated(r, kind_text=F.upper(F.coalesce("type", F.lit(""))), ident=F.upper(F.trim(F.coalesce("ticker", F.lit("")))), day=normalize_date(F.col("date")), money=currency_of_text(F.coalesce("currency", "price", "total"), F.lit("USD")), **_numbers("qty", "total", "price", "tax"))
    kind_text, ident, complete = F.col("kind_text"), F.col("ident"), F.col("complete")
    trade, split = kind_text.startswith("BUY") | kind_text.startswith("SELL"), kind_text.contains("STOCK SPLIT")
    dividend, fee = kind_text.startswith("DIVIDEND") & ~kind_text.contains("TAX"), kind_text.contains("FEE") | kind_text.contains("CUSTODY")
    qty, total, delta = F.col("n_qty"), F.col("n_total"), signed(F.col("n_qty"), F.col("qty"))
    price = F.when(F.col("n_price") > 0, F.col("n_price")).when((total > 0) & (qty > 0), total / qty)
    r = evaluated(r, n_amount=F.abs(F.coalesce("n_total", F.lit(0.0))), paid=price)
    amount, price = F.col("n_amount"), F.col("paid")
    named = ident != ""
    kind = (
        F.when(~complete, "error")
        .when(trade, F.when(named & (qty > 0) & price.isNotNull(), "trade").otherwise("error"))
        .when(split, F.when(named & (delta != 0), "income").otherwise("skipped"))
        .when(dividend, F.when(named & (amount > 0), "income").otherwise("skipped"))
        .when(fee, F.when(amount > 0, "income").otherwise("skipped"))
        .otherwise("skipped")
    )
    reason = F.when(~complete, "ticker, type or quantity column is missing").when(trade & ~F.coalesce(named & (qty > 0), F.lit(False)), "ticker or quantity is not valid").when(trade & price.isNull(), "no price")
    kind_name = F.when(kind_text.startswith("BUY"), "buy").when(kind_text.startswith("SELL"), "sell").when(split, "split").when(dividend, "dividend").when(fee, "fee")
    out = _event(
        r, "revolut", kind=kind, type=kind_name, date=F.col("day"), identifier=F.when(fee & ~named, "CASH").otherwise(ident), is_isin=F.when(fee, False).otherwise(is_isin(ident)),
        shares=F.when(trade, qty).when(split, delta), price=F.when(trade, price), amount=F.when(dividend, amount).when(fee, F.when(kind_text.rlike("REVERSAL|REFUND"), -amount).otherwise(amount)),
        tax=F.when(dividend, F.abs(F.coalesce("n_tax", F.lit(0.0)))), fees=F.when(trade, 0.0), currency=F.col("money"), name=F.lit(""), reason=reason,
    )
    return out.withColumn("ratio", F.lit(None).cast("double"))


def parse_account_statement(files: DataFrame) -> DataFrame:
    """Account statement: dividends and withheld tax, netted by instrument and value date; reversals cancel."""
    r = _picked(files, ACCOUNT_COLUMNS, ACCOUNT_NEED, "change").where("complete and line_no is not null")
    desc, ident = F.lower(F.trim(F.coalesce("desc", F.lit("")))), F.upper(F.trim(F.coalesce("isin", F.lit(""))))
    r = evaluated(r, text=desc, identifier=ident, amount=parse_signed_number(F.col("beside")), day=normalize_date(F.coalesce("value_date", "date")), money=currency_of_text(F.col("change"), F.lit("EUR")))
    gross, tax, amount = F.col("text").isin("dividendo", "dividend"), F.col("text").rlike("^imposto sobre dividendo") | F.col("text").contains("dividend tax"), F.col("amount")
    rows = r.select("file", "line_no", "identifier", F.col("day").alias("date"), F.col("money").alias("currency"), F.when(gross, amount).otherwise(0.0).alias("gross"), F.when(tax, -amount).otherwise(0.0).alias("withheld"), (gross | tax).alias("wanted"), amount.alias("change"))
    rows = rows.where((F.col("identifier") != "") & F.col("wanted") & F.col("change").isNotNull())
    total = lambda c: F.sum(F.col(c).cast("decimal(28,6)")).cast("double")
    sums = rows.groupBy("file", "identifier", "date").agg(F.min("line_no").alias("line_no"), F.min_by("currency", "line_no").alias("currency"), total("gross").alias("gross"), total("withheld").alias("withheld"))
    sums = sums.where((F.abs("gross") >= 1e-9) | (F.abs("withheld") >= 1e-9))
    out = _event(sums, "degiro", kind=F.lit("income"), type=F.lit("dividend"), date=F.col("date"), identifier=F.col("identifier"), is_isin=is_isin(F.col("identifier")), amount=F.col("gross"), tax=F.col("withheld"), currency=F.col("currency"), name=F.lit(""))
    return out.withColumn("ratio", F.lit(None).cast("double"))


def normalize_trades(rows: DataFrame, broker: str = "generic") -> DataFrame:
    """Loose rows (file, line_no and text columns identifier, side, shares, price, total, fees, currency, date, name)."""
    side = F.lower(F.coalesce("side", F.lit("")))
    side = F.when(side.contains("sell"), "sell").when(side.contains("buy"), "buy")
    rows = evaluated(rows, **_numbers("shares", "price", "total", "fees"), ident=F.upper(F.trim(F.coalesce("identifier", F.lit("")))), way=side)
    ident, side, shares = F.col("ident"), F.col("way"), F.col("n_shares")
    price = F.when(F.col("n_price") > 0, F.col("n_price")).when((F.col("n_total") > 0) & (shares > 0), F.col("n_total") / shares)
    ok = (ident != "") & side.isNotNull() & F.coalesce(shares > 0, F.lit(False)) & price.isNotNull()
    return _event(rows, broker, kind=F.when(ok, "trade").otherwise("skipped"), type=side, date=normalize_date(F.col("date")), identifier=ident, is_isin=is_isin(ident), shares=shares, price=price, fees=F.abs(F.coalesce("n_fees", F.lit(0.0))), currency=currency_of_text(F.col("currency"), F.lit("EUR")), name=F.coalesce("name", F.lit("")), reason=F.when(~ok, "incomplete trade"))


def parse_statements(files: DataFrame) -> DataFrame:
    """All files by their detected broker; files of no known broker become one error row each.

    Lines meet their headers in one join for all brokers. What comes of it lies apart by broker, so that each broker's
    parser reads its own lines alone.
    """
    heads = file_heads(files).withColumn("broker", detect_broker(F.col("opening")))
    heads = heads if "value" in files.columns else stored(heads, "heads")
    parsers = {
        "degiro": (parse_transactions, TRANSACTION_COLUMNS, TRANSACTION_NEED), "revolut": (parse_app_statement, APP_COLUMNS, APP_NEED),
        "degiro_account": (parse_account_statement, ACCOUNT_COLUMNS, ACCOUNT_NEED),
    }
    placed = [_placed(heads.where(F.col("broker") == b), columns, need).withColumn("broker", F.lit(b)) for b, (_, columns, need) in parsers.items()]
    placed = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    lines = file_lines(files) if "value" in files.columns else files.select("file", "line_no", "line")
    rows = stored(_below(lines, placed), "statements", "broker")
    known = reduce(DataFrame.unionByName, [parse(rows.where(F.col("broker") == b).drop("broker")) for b, (parse, _, _) in parsers.items()])
    unknown = _event(heads.where("broker is null").withColumn("line_no", F.lit(0)), "", kind=F.lit("error"), reason=F.lit("unknown format")).withColumn("broker", F.lit(None).cast("string")).withColumn("ratio", F.lit(None).cast("double"))
    return known.unionByName(unknown)


def import_report(events: DataFrame, sample: int = 12, rows: int = 1_000_000) -> DataFrame:
    """Rows by file and kind, with the first lines of each.

    Events are read once. Those of a file and kind go by ranges of ``rows`` lines, so that a very large file is the work of
    several tasks, and what the ranges give is put together.
    """
    key, first = ["file", "kind", "_range"], Window.partitionBy("file", "kind", "_range").orderBy("line_no", "identifier")
    events = events.select("file", "kind", "line_no", "identifier", F.floor(F.col("line_no") / rows).alias("_range")).withColumn("_n", F.row_number().over(first))
    parts = events.groupBy(*key).agg(F.count("*").alias("n"), F.collect_list(F.when(F.col("_n") <= sample, F.struct("line_no", "identifier"))).alias("first"))
    return parts.groupBy("file", "kind").agg(F.sum("n").alias("n"), F.slice(F.array_sort(F.flatten(F.collect_list("first"))), 1, sample).alias("first"))


# Holdings files -------------------------------------------------------------------------------------------------


def holdings_separator(text: Column) -> Column:
    head = F.array_join(F.slice(F.split(text, "\r?\n"), 1, 5), "\n")
    return F.when(head.contains("\t"), "\t").when(head.contains(";"), ";").when(head.contains("|"), "|").when(head.contains(","), ",").otherwise("\t")


def _cells_of(line: Column, separator: Column) -> Column:
    return F.transform(F.split(line, F.concat(F.lit("\\Q"), separator, F.lit("\\E")), F.lit(-1)), stripped)


def holdings_columns(header: Column) -> Column:
    """Position of each role's first column, by exact name; the struct's fields are null where there is none."""

    def role(names: tuple[str, ...]) -> Column:
        hit = F.transform(header, lambda h: F.lower(h).isin(*names) | F.trim(F.regexp_replace(F.lower(h), "[^a-z0-9 ]", "")).isin(*names))
        return F.nullif(F.array_position(hit, F.lit(True)), F.lit(0)).cast("int") - 1

    return F.struct(*[role(names).alias(r) for r, names in HOLDINGS_COLUMNS.items()])


def holdings_layout_guess(cells: Column) -> Column:
    """Layout without a header: eight or more columns are the fixed layout, else by what the cells look like."""
    kinds = F.transform(
        cells, lambda c: F.when(c == "", "empty").when(parse_number_holdings(c).isNotNull(), "number").when(is_isin(c), "symbol").when(c.rlike("(?i)^[A-Z0-9.]{1,12}$"), "symbol").otherwise("text")
    )
    at = lambda k: F.nullif(F.array_position(kinds, F.lit(k)), F.lit(0)).cast("int") - 1
    numbers = F.filter(F.transform(kinds, lambda k, i: F.when(k == "number", i)), lambda i: i.isNotNull())
    null = F.lit(None).cast("int")
    fixed = {"symbol": 1, "shares": 4, "price": 7, "name": 0, "platform": 2, "type": 3}
    wide = F.struct(*[(F.lit(fixed[r]).cast("int") if r in fixed else null).alias(r) for r in HOLDINGS_COLUMNS])
    guess = {"symbol": at("symbol"), "shares": F.get(numbers, F.lit(0)), "price": F.get(numbers, F.lit(1)), "name": at("text")}
    return F.when(F.size(cells) >= 8, wide).otherwise(F.struct(*[guess.get(r, null).alias(r) for r in HOLDINGS_COLUMNS]))


def parse_holdings(files: DataFrame) -> DataFrame:
    """file, line_no, kind (holding or error), symbol, name, platform, asset_type, shares, price, needs_price."""
    lines = F.filter(F.transform(F.split("value", "\r?\n"), lambda x, i: F.struct((i + 1).alias("line_no"), x.alias("line"))), lambda x: F.trim(x["line"]) != "")
    rows = files.select("file", holdings_separator(F.col("value")).alias("sep"), lines.alias("lines")).where(F.size("lines") > 0)
    head = lambda k: F.coalesce(_cells_of(F.get("lines", F.lit(k))["line"], F.col("sep")), F.array().cast("array<string>"))
    rows = evaluated(rows, **{f"h{k}": head(k) for k in range(3)})
    rows = evaluated(rows, **{f"m{k}": holdings_columns(F.col(f"h{k}")) for k in range(3)}, guess=holdings_layout_guess(F.col("h0")))
    found = lambda k: F.col(f"m{k}.symbol").isNotNull() & F.col(f"m{k}.shares").isNotNull()
    rows = rows.withColumn("first", F.when(found(0), 1).when(found(1), 2).when(found(2), 3).otherwise(0))
    rows = rows.withColumn("at", F.when(found(0), F.col("m0")).when(found(1), F.col("m1")).when(found(2), F.col("m2")).otherwise(F.col("guess")))
    rows = rows.select("file", "sep", *[F.col(f"at.{r}").alias(f"at_{r}") for r in HOLDINGS_COLUMNS], F.explode(F.slice("lines", F.col("first") + 1, F.size("lines"))).alias("l"))
    rows = evaluated(rows, cells=_cells_of(F.col("l.line"), F.col("sep")))
    cells = F.col("cells")
    cell = lambda r: F.nullif(F.get(cells, F.col(f"at_{r}")), F.lit(""))
    rows = rows.select("file", F.col("l.line_no").cast("long").alias("line_no"), F.upper(cell("symbol")).alias("symbol"), cell("name").alias("name"), cell("platform").alias("platform"), cell("type").alias("type"), cell("shares").alias("shares"), cell("price").alias("p"), cell("amount").alias("amount"))
    rows = evaluated(rows.withColumnsRenamed({c: f"{c}_text" for c in ("shares", "p", "amount")}), **{c: parse_number_holdings(F.col(f"{c}_text")) for c in ("shares", "p", "amount")})
    ok = F.col("symbol").isNotNull() & F.coalesce(F.col("shares") > 0, F.lit(False))
    price = F.when(F.col("p") > 0, F.col("p")).when((F.col("amount") > 0) & (F.col("shares") > 0), F.col("amount") / F.col("shares")).otherwise(0.0)
    return rows.select("file", "line_no", F.when(ok, "holding").otherwise("error").alias("kind"), "symbol", F.coalesce("name", "symbol").alias("name"), F.coalesce("platform", F.lit("Unknown")).alias("platform"), normalize_asset_type(F.col("type")).alias("asset_type"), "shares", price.alias("price"), (ok & (price == 0)).alias("needs_price"))


def merge_holdings(existing: DataFrame, new: DataFrame, mode: str = "add") -> DataFrame:
    """Positions (user_id, symbol, ...) after an import: added to, or replacing, what each user had; last line wins."""
    last = new.groupBy("user_id", "symbol").agg(F.max_by(F.struct(*[c for c in existing.columns if c not in ("user_id", "symbol")]), "line_no").alias("r")).select("user_id", "symbol", "r.*").select(*existing.columns)
    if mode == "replace":
        return existing.join(last.select("user_id").distinct(), "user_id", "left_anti").unionByName(last)
    return existing.join(last.select("user_id", "symbol"), ["user_id", "symbol"], "left_anti").unionByName(last)


def fill_missing_cost(positions: DataFrame, prices: DataFrame) -> DataFrame:
    """Positions without a cost take the price; ``unfilled`` marks those that still have none."""
    out = positions.join(prices.select("symbol", F.col("price").alias("_p")), "symbol", "left")
    cost = F.when((F.coalesce("avg_price", F.lit(0.0)) <= 0) & (F.col("_p") > 0), F.col("_p")).otherwise(F.coalesce("avg_price", F.lit(0.0)))
    return out.withColumn("avg_price", cost).withColumn("unfilled", F.col("avg_price") <= 0).drop("_p")


# Texts for and from models --------------------------------------------------------------------------------------


def chunk_lines(texts: DataFrame, key: str, column: str, most: int) -> DataFrame:
    """(key, chunk_no, chunk): lines packed greedily, in order, into chunks of at most ``most`` characters.

    A line longer than that is a chunk of its own.
    """
    start = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"), F.lit(False).alias("any"))

    def step(a: Column, line: Column) -> Column:
        full = a["any"] & (F.length(a["open"]) + 1 + F.length(line) > most)
        return F.struct(F.when(full, F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]).alias("done"), F.when(full | ~a["any"], line).otherwise(F.concat(a["open"], F.lit("\n"), line)).alias("open"), F.lit(True).alias("any"))

    chunks = F.aggregate(F.split(column, "\n"), start, step, lambda a: F.concat(a["done"], F.array(a["open"])))
    return texts.where(F.col(column).isNotNull()).select(key, F.posexplode(chunks).alias("chunk_no", "chunk"))


_RESULT = "array<struct<value:double, drink_window:string, note:string, error:string>>"


def parse_result_batch(responses: DataFrame, size: str = "size") -> DataFrame:
    """(batch, idx, value, drink_window, note, error) from model texts: the first array, else one object.

    Rows beyond the batch's size are cut; a text that is no JSON gives one row with idx null and an error.
    """
    # Cleaned and parsed once: what is left of a text goes into several patterns, and what is read into a filter and rows.
    good = evaluated(responses.select("batch", F.col(size).alias("_size"), "text"), _clean=clean_model_json(F.col("text")))
    good = evaluated(good, _array=F.regexp_extract("_clean", r"(?s)\[.*\]", 0))
    single = F.regexp_extract("_clean", r"(?s)\{.*\}", 0)
    parsed = F.coalesce(F.from_json(F.nullif("_array", F.lit("")), _RESULT), F.array(F.from_json(F.nullif(single, F.lit("")), _RESULT[6:-1])))
    good = evaluated(good.select("batch", "_size", F.filter(parsed, lambda x: x.isNotNull()).alias("_r")), r=F.col("_r")).drop("_r")
    rows = good.where(F.size("r") > 0).select("batch", "_size", F.posexplode("r").alias("idx", "x")).where("idx < _size").select("batch", "idx", "x.*")
    bad = good.where(F.coalesce(F.size("r"), F.lit(-1)) <= 0).select("batch", F.lit(None).cast("int").alias("idx"), F.lit(None).cast("double").alias("value"), F.lit(None).cast("string").alias("drink_window"), F.lit(None).cast("string").alias("note"), F.lit("no JSON in the answer").alias("error"))
    return rows.unionByName(bad)


def pad_results(chunks: DataFrame, results: DataFrame) -> DataFrame:
    """Each asked row (batch, idx, id) with its result; those without one get an error."""
    out = chunks.join(results.where("idx is not null"), ["batch", "idx"], "left")
    return out.withColumn("error", F.when(F.col("value").isNull() & F.col("error").isNull(), "no result").otherwise(F.col("error")))


def quotes_from_response(responses: DataFrame, column: str = "text") -> DataFrame:
    """symbol, price of JSON arrays of quotes with a positive price; other shapes give nothing."""
    rows = F.from_json(column, "array<struct<symbol:string, price:string>>")
    out = responses.select(F.explode(rows).alias("q")).select(F.upper(F.trim("q.symbol")).alias("symbol"), F.expr("try_cast(q.price AS double)").alias("price"))
    return out.where(F.col("symbol").isNotNull() & (F.col("symbol") != "") & (F.col("price") > 0) & (F.col("price") < float("inf")))
