"""Personal data: exact patterns, and further spans found by weak supervision.

Everything on this path is a DataFrame or SQL expression. Pieces between matches (``split``) and the matches
themselves (``regexp_extract_all``) give positions: a running sum of their lengths per document and pattern, over match
rows only. No pattern matches across a line end, and each is written so that Java's matcher stays linear.

Labelers vote on every loose candidate: shape (regex), gazetteer, context, validity, and isolation; each says 1, 0 or
abstains (-1), and abstains wherever it could say but one thing of a kind. Expectation-maximisation over the counts of
vote patterns (at most 3**5 of a kind) estimates, kind by kind, how often each labeler is right. What a labeler is
expected to be worth (``EXPECTED``) counts like ``PRIOR`` rows and a share of the kind's candidates, there and in the
classifier's counts, and no labeler may become worse than chance, so a table full of one kind, or with one candidate, can turn none around. The posteriors are
the soft labels of a final span classifier, naive Bayes by kind over votes, length and surroundings, whose tables are
plain sums over all candidates. Loose candidates that it accepts are added to the base spans, which stay as they are: a
loose span that overlaps a base span goes, and of loose spans that overlap each other the likelier stays, or the longer
where they are about equally likely.

Cases: null and empty texts have no spans (``spans`` is empty, ``base_sha256`` that of the empty string); repeated rows
are treated one by one; a null ``doc_id`` keeps its row; an empty table gives an empty result; further columns are
ignored. Long runs of digits or letters are one match that fails validation. Of equally
likely loose spans the longer stays, then the first, then the kind listed first.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cofferlake.llm.common import materialise

#: Kinds in the order in which spans are listed; the first four are the base patterns.
KINDS = ("email", "ip", "card", "phone", "masked_email", "number", "bank", "name", "address")
N_BASE = 4
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?=[0-9])(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "masked_email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++\x20?[\[({{](?i:at)[\])}}]\x20?[A-Za-z0-9-]++(?:\x20?(?:\.|[\[({{](?i:dot)[\])}}])\x20?[A-Za-z0-9-]++)++",
    "bank": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "name": r"(?<![\p{L}])(?:Mrs?|Ms|Dr|Prof|Herrn?|Frau|Mme|Mlle|Monsieur|Madame|Señora?|Sra?)\.?\x20(?:\p{Lu}\.\x20)?\p{Lu}[\p{L}'-]++(?:\x20\p{Lu}[\p{L}'-]++)?",
    "address": r"(?<![\p{L}0-9])(?:[0-9]{1,5}\x20(?:\p{Lu}\p{L}++\x20){1,3}(?:Street|St|Road|Rd|Avenue|Ave|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square)(?![\p{L}])|[0-9]{1,4},?\x20(?:rue|avenue|boulevard|place|chemin|quai)(?:\x20[\p{L}'-]++){1,4}|\p{Lu}\p{Ll}{2,30}?(?:straße|strasse|weg|platz|allee|gasse)\x20[0-9]{1,4}[a-z]?(?![\p{L}0-9])|(?:Calle|Avenida|Plaza|Paseo)(?:\x20[\p{L}]++){1,4},?\x20[0-9]{1,4})",
    "number": r"(?<![0-9A-Za-z.+-])\(?[0-9]{2,4}\)?(?:[\x20.-][0-9]{2,4}){2,4}(?![0-9A-Za-z])",
}
_CUES = r"(?i)(?:\biban|\bbank|konto|cuenta|compte|address|adresse|anschrift|direcci|lives? at|\bname\b|\bdear\b|\btel|phone|mobil|\bcall|\bfax|e-?mail|contact|\bcard|\bvisa|account|\bip\b|\bhost|\bssn|whatsapp|reach me)"
_NOT_CUES = r"(?i)(?:version|licen[sc]e|\bpage|isbn|chapter|section|\bdoi|copyright|[$€£]\s*$)"
#: Generic domains; any two letters are taken as a country's.
_DOMAINS = r"(?i)(?:\.|dot[\])}]\s?)(?:com|org|net|edu|gov|mil|int|info|biz|name|pro|museum|mobi|jobs|travel|tel|cat|post|app|dev|blog|cloud|shop|store|online|site|tech|xyz|live|news|email|[a-z]{2})$"
_AREAS = r"^[+(]*(?:1[ ().-]*)?(?:20[1-9]|21[2-9]|30[1-9]|31[02-9]|40[1-9]|41[02-9]|50[1-9]|51[02-9]|60[1-9]|61[02-9]|70[1-8]|71[2-9]|80[1-8]|81[02-9]|90[1-9]|91[02-9])"
_BYTES = r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$"
_DATES = r"^(?:(?:1[5-9]|20)[0-9]{2}[ .-][01]?[0-9][ .-][0-3]?[0-9]|[0-3]?[0-9][ .-][0-3]?[0-9][ .-](?:1[5-9]|20)[0-9]{2})(?![0-9])"
_SHAPES = r"^(?:\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}|[0-9]{3}-[0-9]{2}-[0-9]{4}|(?:[0-9]{4}[ -]){3}[0-9]{4})$"
#: What a text must hold for names and addresses to be looked for; every match of their patterns holds one of these.
_TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "Mlle", "Monsieur", "Madame", "Señor", "Sr")
_STREETS = ("Street", "St", "Road", "Rd", "Avenue", "Ave", "Lane", "Ln", "Drive", "Dr", "Boulevard", "Blvd", "Court", "Square", "rue ", "avenue ", "boulevard ", "place ", "chemin ", "quai ", "straße", "strasse", "weg ", "platz ", "allee ", "gasse ", "Calle ", "Avenida ", "Plaza ", "Paseo ")
#: Countries of bank numbers with the length of theirs; given names; capitals and postcodes' looks beside an address.
_BANKS = {"AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SE": 24, "SI": 19, "SK": 24, "TR": 26}
_NAMES = (
    r"\b(?:James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Christopher|Matthew|Anthony|Mark|Steven|Andrew|Kenneth|George|Edward|Brian|Kevin|Ronald|Jason|Jeffrey|Ryan|Jacob|Gary|Nicholas|Eric|Jonathan|Stephen|Larry|Justin|Scott|Brandon|Benjamin|Samuel|Frank|Gregory|Alexander|Patrick|Jack|Dennis|Henry"
    r"|Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Betty|Sandra|Ashley|Dorothy|Kimberly|Emily|Donna|Michelle|Carol|Amanda|Melissa|Deborah|Stephanie|Rebecca|Sharon|Cynthia|Kathleen|Amy|Angela|Shirley|Helen|Brenda|Pamela|Nicole|Ruth|Katherine|Samantha|Christine|Emma|Olivia|Liam|Noah"
    r"|Anna|Maria|Peter|Paul|Hans|Klaus|Jürgen|Wolfgang|Dieter|Uwe|Stefan|Andreas|Ursula|Monika|Petra|Sabine|Renate|Helga|Birgit|Heike|Lukas|Felix|Jonas|Pierre|Jean|Jacques|Philippe|Alain|Bernard|Marie|Claire|Sophie|Nathalie|Isabelle|Sylvie|Camille|Julie|José|Juan|Carlos|Luis|Javier|Antonio|Manuel|Francisco|Carmen|Lucía|Ana|Miguel|Laura|Daniel|Martin|Pilar|Teresa|Rosa)\b"
)
_PLACES = r"(?:\b[0-9]{5}\b|\b[A-Z]{1,2}[0-9]{1,2}\b|London|Paris|Berlin|Madrid|Wien|Zürich|Apt|Suite|Floor)"
LABELERS = ("shape", "gazetteer", "context", "valid", "alone")
EM_ROUNDS = 25
#: Expected by kind: the share of true candidates, then for each labeler how often it says 1, if it speaks, of true and of false ones.
EXPECTED = {
    "masked_email": (0.7, ((0.5, 0.5), (0.9, 0.3), (0.8, 0.3), (0.5, 0.5), (0.8, 0.5))),
    "number": (0.3, ((0.8, 0.15), (0.7, 0.4), (0.85, 0.15), (0.95, 0.6), (0.8, 0.5))),
    "bank": (0.4, ((0.95, 0.3), (0.9, 0.3), (0.8, 0.3), (0.999, 0.02), (0.8, 0.5))),
    "name": (0.6, ((0.7, 0.4), (0.8, 0.3), (0.8, 0.3), (0.5, 0.5), (0.8, 0.5))),
    "address": (0.6, ((0.5, 0.5), (0.8, 0.3), (0.8, 0.3), (0.5, 0.5), (0.8, 0.5))),
}
#: Rows that an expectation counts for, and what share of the kind's candidates besides.
PRIOR, PRIOR_SHARE = 10.0, 0.25
#: A labeler that says 1 of true candidates this often is not estimated anew.
KNOWN = 0.99


def _hits(kind: str) -> Column:
    """Matches of one pattern with the length of the text since the match before, and their surroundings."""
    text, pattern = F.col("text"), F.lit(PATTERNS[kind])
    matches, pieces = F.regexp_extract_all(text, pattern, F.lit(0)), F.split(text, PATTERNS[kind], -1)
    following = F.slice(pieces, F.lit(2), F.size(pieces))
    found = F.arrays_zip(matches.alias("m"), F.slice(pieces, F.lit(1), F.size(pieces) - 1).alias("before"), following.alias("after"))
    rows = F.transform(
        found,
        lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), x["m"].alias("match"), F.length(x["m"]).cast("long").alias("size"), F.length(x["before"]).cast("long").alias("gap"), F.right(x["before"], F.lit(24)).alias("pre"), F.left(x["after"], F.lit(12)).alias("post")),
    )
    none = F.array().cast("array<struct<kind:string,i:int,match:string,size:bigint,gap:bigint,pre:string,post:string>>")
    holds = lambda *words: reduce(lambda a, b: a | b, [text.contains(w) for w in words])
    needs = {"bank": text.rlike("[A-Z]{2}[0-9]{2}"), "name": holds(*_TITLES), "address": text.rlike("[0-9]") & holds(*_STREETS), "email": text.contains("@"), "phone": text.contains("+") & text.rlike("[0-9]"), "masked_email": text.rlike(r"(?i)[\[({]at[\])}]")}.get(kind, text.rlike("[0-9]"))
    return F.when(needs, rows).otherwise(none)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Luhn's check on a string of at most 20 digits; every second digit from the right is doubled, less 9 if over 9."""
    plain = F.lpad(digits, 20, "0")
    doubled = F.translate(plain, "0123456789", "0246813579")
    parts = [F.substring(plain if i % 2 else doubled, i + 1, 1).cast("int") for i in range(20)]
    return reduce(lambda x, y: x + y, parts) % 10 == 0


def bank_checks(number: Column) -> Column:
    """Remainder 1 by 97, with the first four characters last and letters as 10 to 35."""
    digits = F.concat(F.substr(number, F.lit(5)), F.left(number, F.lit(4)))
    value = lambda c: F.when(c.rlike("[0-9]"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda a, c: (a * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.coalesce(F.aggregate(F.filter(F.split(digits, ""), lambda c: c != ""), F.lit(0), step) == 1, F.lit(False))


def candidates(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, hits): one row per document with a row number; all matches with start, end and ``valid``."""
    text = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = text.select("doc_id", F.xxhash64("text").alias("text_key"), F.monotonically_increasing_id().alias("row"), F.concat(*[_hits(k) for k in KINDS]).alias("hits"))
    rows = materialise(rows, "pii-rows")
    hits = rows.select("row", F.explode("hits").alias("h")).select("row", "h.*")
    w = Window.partitionBy("row", "kind").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    hits = hits.withColumn("end", end).withColumn("start", F.col("end") - F.col("size"))
    digits, n = F.col("digits"), F.length("digits")
    hits = hits.withColumn("digits", _digits(F.col("match")))
    valid = (
        F.when(F.col("kind") == "ip", F.col("match").rlike(_BYTES))
        .when(F.col("kind") == "card", F.when(n.between(13, 19), luhn(digits)).otherwise(F.lit(False)))
        .when(F.col("kind") == "phone", n.between(9, 15))
        .when(F.col("kind") == "number", n.between(7, 15) & ~F.col("match").rlike(_DATES))
        .when(F.col("kind") == "bank", bank_checks(F.replace(F.col("match"), F.lit(" "), F.lit(""))))
        .otherwise(F.lit(True))
    )
    kind_no = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int")
    return rows.select("row", "doc_id", "text_key"), hits.withColumn("valid", valid).withColumn("kind_no", kind_no)


def votes(hits: DataFrame) -> DataFrame:
    """The labelers' votes on loose candidates, as an array in the order of LABELERS."""
    vote = lambda yes, no=None: F.when(yes, 1).when(no, 0).otherwise(-1) if no is not None else F.when(yes, 1).otherwise(-1)
    says = lambda yes: F.when(yes, 1).otherwise(0)
    match, kind = F.col("match"), F.col("kind")
    letters = F.replace(match, F.lit(" "), F.lit(""))
    length = F.get(F.array(*[F.lit(n) for n in _BANKS.values()]), F.array_position(F.array(*[F.lit(c) for c in _BANKS]), F.left(letters, F.lit(2))).cast("int") - 1)
    shape = F.when(kind == "number", says(match.rlike(_SHAPES))).when(kind == "bank", says(F.length(letters) == length)).when(kind == "name", says(match.rlike(r"\x20\p{Lu}[\p{L}.'-]*\x20\p{Lu}"))).otherwise(-1)
    named = (
        F.when(kind == "masked_email", says(match.rlike(_DOMAINS))).when(kind == "bank", says(length.isNotNull()))
        .when(kind == "name", vote(match.rlike(_NAMES))).when(kind == "address", vote(F.col("post").rlike(_PLACES))).otherwise(vote(match.rlike(_AREAS)))
    )
    valid = F.when(kind.isin("number", "bank"), says(F.col("valid"))).otherwise(-1)
    alone = says(F.col("pre").rlike(r"(?:^|[\s:;,(\[<'\"=])$") & F.col("post").rlike(r"^(?:$|[\s:;,.)\]>'\"!?])"))
    return hits.withColumn("votes", F.array(shape, named, vote(F.col("pre").rlike(_CUES), F.col("pre").rlike(_NOT_CUES)), valid, alone))


def _expected(kind: Column) -> Column:
    """EXPECTED of a kind: the share, the rates of true candidates, those of false ones."""
    values = [F.array(F.lit(share), *[F.lit(a) for a, _ in rates], *[F.lit(b) for _, b in rates]) for share, rates in EXPECTED.values()]
    return F.get(F.array(*values), F.array_position(F.array(*[F.lit(k) for k in EXPECTED]), kind).cast("int") - 1)


def reliabilities(voted: DataFrame) -> DataFrame:
    """For each kind ``params``: share of true spans, then per labeler the rates of vote 1 on true and on false spans."""
    n = len(LABELERS)
    seen = voted.groupBy("kind", "votes").agg(F.sum("n").alias("n")).groupBy("kind").agg(F.array_sort(F.collect_list(F.struct("votes", "n"))).alias("patterns"), F.sum("n").alias("all"))
    seen = seen.withColumns({"expected": _expected(F.col("kind")), "weight": PRIOR + PRIOR_SHARE * F.col("all")})

    def round_of(p: Column) -> Column:
        def weighed(x: Column) -> Column:
            yes, no = F.element_at(p, 1), 1 - F.element_at(p, 1)
            for j in range(n):
                v, a, b = F.element_at(x["votes"], j + 1), F.element_at(p, 2 + j), F.element_at(p, 2 + n + j)
                yes = yes * F.when(v == 1, a).when(v == 0, 1 - a).otherwise(1.0)
                no = no * F.when(v == 1, b).when(v == 0, 1 - b).otherwise(1.0)
            return F.struct(x["votes"].alias("votes"), x["n"].alias("n"), (x["n"] * yes / (yes + no)).alias("true"))

        return F.array(F.transform(F.col("patterns"), weighed))

    def total(rows: Column, f) -> Column:
        return F.aggregate(rows, F.lit(0.0), lambda a, x: a + f(x))

    def updated(rows: Column) -> Column:
        weight, expected = F.col("weight"), lambda k: F.element_at("expected", k)
        share = (total(rows, lambda x: x["true"]) + weight * expected(1)) / (F.col("all") + weight)
        rates: list[Column] = []
        for side, of in enumerate((lambda x: x["true"], lambda x: x["n"] - x["true"])):
            for j in range(n):
                said = lambda x, j=j: F.element_at(x["votes"], j + 1)
                ones = total(rows, lambda x, s=of, v=said: F.when(v(x) == 1, s(x)).otherwise(0.0))
                any_ = total(rows, lambda x, s=of, v=said: F.when(v(x) >= 0, s(x)).otherwise(0.0))
                # What a check sum is worth is known.
                known, hoped = expected(2 + j) >= KNOWN, expected(2 + side * n + j)
                rates.append(F.when(known, hoped).otherwise((ones + weight * hoped) / (any_ + weight)))
        # Better than chance: a 1 is never likelier on a false span.
        return F.array(share, *rates[:n], *[F.least(b, a) for a, b in zip(rates[:n], rates[n:])])

    step = lambda p, i: F.element_at(F.transform(round_of(p), updated), 1)
    return seen.select("kind", F.aggregate(F.sequence(F.lit(1), F.lit(EM_ROUNDS)), F.col("expected"), step).alias("params"))


def posterior(params: Column, said: Column) -> Column:
    n = len(LABELERS)
    odds = F.log(F.element_at(params, 1)) - F.log(1 - F.element_at(params, 1))
    for j in range(n):
        v, a, b = F.element_at(said, j + 1), F.element_at(params, 2 + j), F.element_at(params, 2 + n + j)
        odds = odds + F.when(v == 1, F.log(a / b)).when(v == 0, F.log((1 - a) / (1 - b))).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def classified(voted: DataFrame) -> DataFrame:
    """Loose candidates with ``probability`` of the final classifier."""
    size = F.when(F.col("size") < 8, "short").when(F.col("size") < 16, "middle").otherwise("long")
    last = F.when(F.col("pre") == "", "none").when(F.col("pre").rlike(r"\s$"), "space").otherwise("mark")
    features = F.array(F.concat(F.lit("size:"), size), F.concat(F.lit("before:"), last), *[F.concat(F.lit(f"{name}:"), F.element_at("votes", j + 1).cast("string")) for j, name in enumerate(LABELERS)])
    # As few rows as there are distinct candidates by features: the sums below and the look-up run on those.
    voted = materialise(voted.select("row", "kind", "kind_no", "start", "end", "votes", features.alias("features")), "pii-votes")
    combos = materialise(voted.groupBy("kind", "features", "votes").agg(F.count("*").cast("double").alias("n")), "pii-combos")
    params = reliabilities(combos)
    combos = materialise(combos.join(F.broadcast(params), "kind").withColumn("true", F.col("n") * posterior(F.col("params"), F.col("votes"))), "pii-soft")
    expected, n = _expected(F.col("kind")), len(LABELERS)
    # Counts begin with as many rows of either class as ``reliabilities`` expects, half of the time without a vote.
    share, weight = F.element_at(expected, 1), PRIOR + PRIOR_SHARE * F.col("all")
    totals = combos.groupBy("kind").agg(F.sum("n").alias("all"), F.sum("true").alias("yes"), F.sum(F.col("n") - F.col("true")).alias("no")).withColumn("begun", weight)
    totals = totals.select("kind", "begun", (F.col("yes") + F.col("begun")).alias("yes"), (F.col("no") + F.col("begun")).alias("no"), F.log((F.col("yes") + F.col("begun") * share) / (F.col("no") + F.col("begun") * (1 - share))).alias("prior"))
    weights = combos.select("kind", F.posexplode("features").alias("at", "feature"), "n", "true").groupBy("kind", "at", "feature").agg(F.sum("true").alias("f_yes"), F.sum(F.col("n") - F.col("true")).alias("f_no"))

    def begun(first: int) -> Column:
        one = F.element_at(expected, F.col("at") - 2 + first)
        vote = F.when(F.endswith("feature", F.lit(":1")), one / 2).when(F.endswith("feature", F.lit(":0")), (1 - one) / 2).otherwise(0.5)
        return F.col("begun") * F.when(F.col("at") < 2, F.lit(1 / 3)).otherwise(vote)

    weights = weights.join(F.broadcast(totals), "kind").withColumns({"f_yes": F.col("f_yes") + begun(2), "f_no": F.col("f_no") + begun(2 + n)})
    weights = weights.select("kind", "feature", F.log(F.col("f_yes") / F.col("yes") * F.col("no") / F.col("f_no")).alias("weight"), "prior")
    scored = combos.select("kind", "features", F.explode("features").alias("feature")).join(F.broadcast(weights), ["kind", "feature"]).groupBy("kind", "features").agg((F.sum("weight") + F.first("prior")).alias("odds"))
    return voted.join(F.broadcast(scored), ["kind", "features"]).withColumn("probability", 1 / (1 + F.exp(-F.col("odds")))).drop("features", "odds", "votes")


def without_overlaps(spans: DataFrame) -> DataFrame:
    """Spans (row, kind, kind_no, start, end, probability) without loose ones that overlap a base span or a likelier loose one.

    Spans that touch through others make a cluster; within one the likelier, to a tenth, is taken first, then the longer, and
    base spans before all.
    """
    along = Window.partitionBy("row").orderBy("start", "end", "kind_no")
    reached = F.max("end").over(along.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.when(F.col("start") >= F.coalesce(reached, F.lit(-1)), 1).otherwise(0))
    spans = spans.withColumn("_cluster", F.sum("_new").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    rank = F.struct(F.when(F.col("kind_no") <= N_BASE, -100.0).otherwise(-F.floor(F.col("probability") * 10).cast("double")).alias("p"), (F.col("start") - F.col("end")).alias("size"), "start", "kind_no", "end", "kind")
    clusters = spans.groupBy("row", "_cluster").agg(F.array_sort(F.collect_list(rank)).alias("c"))
    free = lambda kept, x: (x["kind_no"] <= N_BASE) | ~F.exists(kept, lambda k: (k["start"] < x["end"]) & (k["end"] > x["start"]))
    kept = F.aggregate("c", F.slice("c", 1, 0), lambda kept, x: F.when(free(kept, x), F.concat(kept, F.array(x))).otherwise(kept))
    return clusters.select("row", F.explode(F.when(F.size("c") == 1, F.col("c")).otherwise(kept)).alias("s")).select("row", "s.kind", "s.kind_no", "s.start", "s.end")


def personal_data(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, text_key, counts of base kinds, base_sha256, spans, and ``found`` (kind, start, end) of all spans."""
    rows, hits = candidates(docs)
    hits = materialise(hits.where((F.col("kind_no") > N_BASE) | F.col("valid")), "pii-hits")
    base = hits.where(F.col("kind_no") <= N_BASE).select("row", "kind", "kind_no", "start", "end", F.lit(1.0).alias("probability"))
    loose = classified(votes(hits.where(F.col("kind_no") > N_BASE))).where(F.col("probability") >= threshold)
    spans = without_overlaps(base.unionByName(loose.select(*base.columns)))
    counts = [F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in KINDS[:N_BASE]]
    found = spans.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("kind_no", "start", "end", "kind"))).alias("found"), *counts)
    out = rows.join(found, "row", "left")
    listed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])))
    none = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint,kind:string>>")
    out = out.withColumn("found", F.coalesce("found", none))
    return out.select(
        "doc_id", "text_key", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS[:N_BASE]],
        F.sha2(listed(F.filter("found", lambda s: s["kind_no"] <= N_BASE)), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"), "found",
    )


def redacted(docs: DataFrame) -> DataFrame:
    """The documents with each span replaced by its kind in angle brackets; columns stay as they are."""
    found = personal_data(docs).where(F.size("found") > 0).select(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key"), F.transform("found", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))).alias("_found"))
    found = found.dropDuplicates(["_doc", "_key"])
    joined = docs.join(found, docs["doc_id"].cast("long").eqNullSafe(found["_doc"]) & (F.xxhash64(F.coalesce(docs["text"], F.lit(""))) == found["_key"]), "left")
    text = F.col("text")
    part = lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int"))

    def step(acc: Column, s: Column) -> Column:
        mark = F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))
        grown = F.when(s["start"] >= acc["at"], F.concat(acc["out"], part(acc["at"], s["start"]), mark)).otherwise(acc["out"])
        return F.struct(grown.alias("out"), F.greatest(acc["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    length = F.length(text).cast("long")
    done = F.aggregate(F.array_sort("_found"), start, step, lambda acc: F.concat(acc["out"], part(acc["at"], length)))
    return joined.withColumn("text", F.when(F.col("_found").isNotNull(), done).otherwise(text)).select(*docs.columns)
