"""Secret scans: known patterns, and a battery of randomness tests over other long tokens.

Only DataFrame functions. Positions are code points: the pieces that split() leaves between a pattern's
matches, and the matches of regexp_extract_all(), add up to them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framelake.llm.storage import written

# The patterns that the base scan is defined by.
KEYWORD = "(?i:password|passwd|secret|token|api_?key)"
ASSIGN = "(" + KEYWORD + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{14,}"
HEX = "[0-9a-f]{16,}"
#: Tokens that the randomness tests look at.
TOKEN = "[A-Za-z0-9+/_-]{20,}={0,2}"
KINDS = ("assign", "access", "hex", "random")
SPAN = "array<struct<start:bigint,rank:int,end:bigint,token:string>>"

#: Ordinary long tokens, which the step-up control takes as its null: chances that neighbours differ in case (a capital
#: before a small letter counts as small, separators as nothing) and that a letter stands beside a digit, chance that two
#: letters are the same one, and correlation of neighbouring signs' places in the alphabet.
ORDINARY_CASES = 0.08
ORDINARY_DIGITS = 0.02
ORDINARY_COINCIDENCE = 0.064
ORDINARY_CORRELATION = 0.25
#: How much more chi-squared of ordinary tokens spreads than a noncentral chi-squared does (identifiers mix many letters).
SPREAD = 1.35
#: Weights of the three tests (chi-squared, runs, serial correlation) in Stouffer's sum.
WEIGHTS = (1.0, 1.4, 0.6)
#: Least excess of chi-squared a sign that ordinary tokens are taken to have in a small alphabet.
LEAST_EXCESS = 0.4
#: False discoveries allowed among the tokens called random, within each class of lengths.
DISCOVERY_RATE = 0.01
#: Upper 0.1 % point of chi-squared with 3 degrees: beyond it the battery denies uniform randomness.
BATTERY_LIMIT = 16.27
LENGTHS = (32, 64, 128)
_BIN = 10
#: Matches that are placed together; running positions of such groups are added up first.
_GROUP = 256


def _let(value: Column, body) -> Column:
    """body(value) with value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def found_spans(text: Column, pattern: str, rank: int, token: bool = False) -> Column:
    """Spans of a pattern's leftmost non-overlapping matches; token: with the match."""
    none = F.array().cast(SPAN)
    kept = lambda m: m.isNotNull() & (F.lit(True) if rank else F.char_length(F.regexp_extract(m, pattern, 2)) >= 12)
    size = lambda x: F.char_length(x["0"]) + F.coalesce(F.char_length(x["1"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        first = acc["at"] + F.char_length(x["0"])
        span = F.struct(first.alias("start"), F.lit(rank).alias("rank"), (acc["at"] + size(x)).alias("end"), (x["1"] if token else F.lit("")).alias("token"))
        return F.struct((acc["at"] + size(x)).alias("at"), F.when(kept(x["1"]), F.concat(acc["out"], F.array(span).cast(SPAN))).otherwise(acc["out"]).alias("out"))

    def placed(zipped: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.floor((F.size(zipped) - 1) / _GROUP).cast("int")), lambda i: F.slice(zipped, i * _GROUP + 1, F.lit(_GROUP)))
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<bigint>").alias("out"))
        sized = lambda g: F.aggregate(g, F.lit(0).cast("long"), lambda n, x: n + size(x))

        def of_groups(g: Column) -> Column:
            begins = F.aggregate(g, start, lambda acc, own: F.struct((acc["at"] + sized(own)).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
            return F.flatten(F.zip_with(g, begins, lambda own, at: F.aggregate(own, F.struct(at.alias("at"), none.alias("out")), step, lambda acc: acc["out"])))

        return _let(groups, of_groups)

    return _let(F.arrays_zip(F.split(text, pattern), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))), placed)


def base_spans(text: Column) -> Column:
    """All spans of the known patterns, in order of start, then kind."""
    none = F.array().cast(SPAN)
    parts = [F.when(text.rlike(gate), found_spans(text, pattern, rank)).otherwise(none) for rank, (gate, pattern) in enumerate(((KEYWORD, ASSIGN), (ACCESS, ACCESS), (HEX, HEX)))]
    return F.array_sort(F.concat(*parts))


# The alphabets of the encodings that are told apart.
_DIGITS, _HEX_LOWER, _HEX_UPPER = "0123456789", "0123456789abcdef", "0123456789ABCDEF"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Patterns of the narrower encodings, narrowest first, and their alphabets (base64url counts as base64, which takes the rest).
ENCODINGS = (
    ("[0-9]+", _DIGITS), ("[0-9a-f]+", _HEX_LOWER), ("[0-9A-F]+", _HEX_UPPER), ("[a-z]+", _LOWER), ("[A-Z]+", _UPPER), ("[A-Z2-7]+", _UPPER + "234567"), ("[a-z2-7]+", _LOWER + "234567"),
    ("[A-Z0-9]+", _UPPER + _DIGITS), ("[a-z0-9]+", _LOWER + _DIGITS), ("[A-Za-z]+", _UPPER + _LOWER), ("[A-Za-z0-9]+", _UPPER + _LOWER + _DIGITS),
)
BASE64 = _UPPER + _LOWER + _DIGITS + "+/"


def inferred_alphabet(token: Column) -> Column:
    """Signs of the narrowest encoding that can write the token."""
    out = F.lit(BASE64)
    for pattern, alphabet in reversed(ENCODINGS):
        out = F.when(token.rlike(f"^{pattern}$"), alphabet).otherwise(out)
    return out


def battery(token: Column) -> Column:
    """Struct (deviance, surprise) of a token from three tests of randomness over its inferred alphabet.

    The tests: chi-squared of the signs' counts, runs, serial correlation at lag one. deviance: the sum of
    their squared deviates where signs are random (Wilson-Hilferty for chi-squared, upper side; runs above and below the middle of the alphabet).
    surprise: -log10 of a bound on the chance that an ordinary token looks as random as this one. Each test's
    deviate from ordinary tokens (too even counts; too many runs of lower, upper and digits; too little
    correlation) is taken, the three are combined by Stouffer's weighted sum. Tokens of one class have none.
    """

    def of_values(v: Column, size: Column, classes: Column) -> Column:
        n = F.size(v).cast("double")
        squares = F.aggregate(F.sequence(F.lit(0), size - 1), F.lit(0.0), lambda acc, k: acc + F.pow(F.size(F.filter(v, lambda y: y == k)).cast("double"), F.lit(2.0)))
        degrees = (size - 1).cast("double")
        third = F.lit(2.0) / (F.lit(9.0) * degrees)
        high = F.size(F.filter(v, lambda y: y * 2 >= size)).cast("double")
        pairs = F.zip_with(F.slice(v, F.lit(1), F.size(v) - 1), F.slice(v, F.lit(2), F.size(v) - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
        turns = F.size(F.filter(pairs, lambda p: (p["a"] * 2 >= size) != (p["b"] * 2 >= size)))
        middle = (size - 1) / F.lit(2.0)
        product = F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + (p["a"] - middle) * (p["b"] - middle))
        z_serial = product / (n - 1) / ((size * size - 1) / F.lit(12.0)) * F.sqrt(n - 1)
        # a change between letter and digit counts twice: it is rarer in ordinary tokens
        changes = (F.regexp_count(classes, F.lit("a(?=A)|A(?=a)")) + 2 * F.regexp_count(classes, F.lit("[aA](?=0)|0(?=[aA])"))).cast("double")
        digits = F.contains(classes, F.lit("0")).cast("double")

        def judged(x: Column) -> Column:
            z_chi = F.greatest(F.lit(0.0), (F.pow(x["chi"] / degrees, F.lit(1 / 3)) - (1 - third)) / F.sqrt(third))
            both = 2 * x["high"] * (n - x["high"])
            spread = both * (both - n) / (n * n * (n - 1))
            z_runs = F.when(spread > 0, (turns - both / n) / F.sqrt(spread)).otherwise(F.lit(10.0))
            excess = F.greatest(size * F.lit(ORDINARY_COINCIDENCE) - 1, F.lit(LEAST_EXCESS)) * n
            even = (degrees + excess - x["chi"]) / F.sqrt(2 * (degrees + 2 * excess)) / SPREAD
            m, p, q = (F.char_length(classes) - 1).cast("double"), ORDINARY_CASES, ORDINARY_DIGITS
            many = (x["changes"] - 0.5 - m * (p + 2 * q * digits)) / F.sqrt(m * (p * (1 - p) + 4 * q * (1 - q) * digits))
            loose = F.lit(ORDINARY_CORRELATION) * F.sqrt(n - 1) - x["serial"]
            z = (even * WEIGHTS[0] + many * WEIGHTS[1] + loose * WEIGHTS[2]) / sum(w * w for w in WEIGHTS) ** 0.5
            surprise = F.when((x["changes"] > 0) & (z > 0), (z * z / 2 + F.ln(F.lit(2.0))) / F.ln(F.lit(10.0))).otherwise(F.lit(0.0))
            return F.struct((z_chi * z_chi + z_runs * z_runs + x["serial"] * x["serial"]).alias("deviance"), surprise.alias("surprise"))

        return _let(F.struct((squares * size / n - n).alias("chi"), high.alias("high"), z_serial.alias("serial"), changes.alias("changes")), judged)

    signs = F.translate(F.rtrim(token, F.lit("=")), "-_", "+/")
    classes = F.regexp_replace(F.regexp_replace(signs, "[+/]", ""), "[A-Z][a-z]", "aa")
    for pattern, sign in (("[a-z]", "a"), ("[A-Z]", "A"), ("[0-9]", "0")):
        classes = F.regexp_replace(classes, pattern, sign)
    coded = lambda a: _let(F.transform(F.split(signs, ""), lambda c: F.instr(a, c) - 1), lambda v: of_values(v, F.char_length(a), classes))
    return _let(inferred_alphabet(signs), coded)


_CANDIDATE = "array<struct<start:bigint,rank:int,end:bigint,class:int,surprise:double,deviance:double>>"


def _candidates(text: Column, base: Column) -> Column:
    """Long tokens clear of the known spans, each with its length class and test values."""
    tokens = F.filter(found_spans(text, TOKEN, 3, token=True), lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))

    def judged(t: Column) -> Column:
        length = t["end"] - t["start"]
        group = sum(((length >= n).cast("int") for n in LENGTHS), F.lit(0))
        return _let(battery(t["token"]), lambda x: F.struct(t["start"].alias("start"), t["rank"].alias("rank"), t["end"].alias("end"), group.alias("class"), x["surprise"].alias("surprise"), x["deviance"].alias("deviance")))

    return F.when(text.rlike(TOKEN), F.transform(tokens, judged).cast(_CANDIDATE)).otherwise(F.array().cast(_CANDIDATE))


def _thresholds(rows: DataFrame, rate: float) -> dict[int, float]:
    """Least surprise that Benjamini and Hochberg's step-up lets pass in each class of lengths.

    Surprises are counted in bins of a tenth (up to 40), so a bounded table holds all that is needed.
    """
    c = rows.select(F.explode("candidates").alias("c")).select("c.class", F.least(F.floor(F.col("c.surprise") * _BIN), F.lit(40 * _BIN)).alias("bin"))
    counts = c.groupBy("class", "bin").agg(F.count("*").alias("n"))
    w = Window.partitionBy("class")
    ranked = counts.withColumn("all", F.sum("n").over(w)).withColumn("passed", F.sum("n").over(w.orderBy(F.desc("bin"))))
    ok = ranked.where(F.pow(F.lit(10.0), -F.col("bin") / _BIN) <= rate * F.col("passed") / F.col("all"))
    return {r["class"]: r["least"] / _BIN for r in ok.groupBy("class").agg(F.min("bin").alias("least")).collect()}


def secret_spans(docs: DataFrame, keep: list[str], text_col: str = "text", rate: float = DISCOVERY_RATE) -> DataFrame:
    """(row, base, spans) for every row of docs: row holds the kept columns, the others arrays of spans.

    base has the spans of the known patterns; spans also those of random tokens: clear of base spans, not
    denied by the battery, and with a surprise that passes step-up control within their class of lengths.
    Null and empty texts have none. Repeated rows stay; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct(*keep).alias("row"), text.alias("text")).withColumn("base", base_spans(F.col("text")))
    rows = rows.select("row", "base", _candidates(F.col("text"), F.col("base")).alias("candidates"))
    if text_col not in keep:
        rows = written(rows, "secret-candidates")  # else texts are scanned again rather than stored once more
    limits = _thresholds(rows, rate)

    def random(c: Column) -> Column:
        limit = F.element_at(F.array(*[F.lit(float(limits.get(k, 1e9))) for k in range(len(LENGTHS) + 1)]), c["class"] + 1)
        return (c["surprise"] >= limit) & (c["deviance"] <= BATTERY_LIMIT)

    more = F.transform(F.filter("candidates", random), lambda c: F.struct(c["start"], c["rank"], c["end"], F.lit("").alias("token"))).cast(SPAN)
    return rows.select("row", "base", F.array_sort(F.concat("base", more)).alias("spans"))


def _listed(spans: Column) -> Column:
    kind = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kind, s["rank"] + 1), s["start"], s["end"])), ",")


def scanned_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_random) for every row of documents."""
    found = secret_spans(docs, ["doc_id"])
    count = lambda spans, rank: F.size(F.filter(spans, lambda s: s["rank"] == rank)).cast("long")
    return found.select(
        "row.doc_id", *[count("base", i).alias(f"n_{k}") for i, k in enumerate(KINDS[:3])],
        F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"), count("spans", 3).alias("n_random"),
    )


def redacted(docs: DataFrame, text_col: str = "text", mask: str = "[secret]") -> DataFrame:
    """docs with every secret span of the text replaced by the mask (overlapping spans: one mask)."""
    found = secret_spans(docs, docs.columns, text_col)
    text = F.col(f"row.{text_col}")
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        gap = F.array(text.substr((acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], gap)).otherwise(acc["out"]).alias("out"))

    rest = F.aggregate("spans", start, step, lambda acc: F.array_join(F.concat(acc["out"], F.array(text.substr((acc["at"] + 1).cast("int"), F.char_length(text)))), mask))
    changed = F.when(F.size("spans") > 0, rest).otherwise(text)
    return found.select(*[(changed if c == text_col else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])
