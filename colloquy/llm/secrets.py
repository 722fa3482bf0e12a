"""Secret scans, on DataFrame functions alone.

Base rules find assignments, access keys and long hex runs. Beyond these, every
other run of 20 or more token characters (or what is left of it beside these) is put to a randomness test battery in
the encoding inferred from its alphabet (hex, base32, base36, base62, base64):

* a chi-squared test of the alphabet's uniformity,
* a runs test: how often neighbours are in different halves of the alphabet,
* a lag-one serial correlation test of the places in the alphabet.

Alphabets are in an order in which written language shows: letters by how common
they are, digits and the other case last. Each statistic is held against two
laws at the token's length. Against that of random text, the squared normal
scores are summed (three degrees of freedom), and a token passes if this isn't
rejected. Against that of what people write, where letters repeat, neighbours
stay in one half and are alike, the three normal scores are added with weights
by how far random text lies from written text at that length; the sum's tail is
the token's p-value as a discovery: a longer token needs to look less random
than a shorter one. Benjamini-Hochberg over all tokens of the corpus sets the
cut-off, from a histogram of p-values in steps of a twentieth of a decade.

Spans are in code points, end exclusive.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table

# The base rules.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ["assign", "access", "hex", "random"]

LEAST_RUN = 20
CANDIDATE = f"[A-Za-z0-9+/_-]{{{LEAST_RUN},}}"
#: A run with characters of both base64 alphabets is cut at those of one and at those of the other; parts of both are tested.
PARTS = [f"[A-Za-z0-9_-]{{{LEAST_RUN},}}", f"[A-Za-z0-9+/]{{{LEAST_RUN},}}"]
DIGITS = "0123456789"
#: Letters from the commonest to the rarest in European languages.
LOWER = "etaoinshrdlucmfwypvbgkjqxz"
UPPER = LOWER.upper()
#: Rare capitals fill the half of the small letters where an alphabet has both cases.
RARE, OTHER = "KJQXZ", "".join(x for x in LOWER.upper() if x not in "KJQXZ")
#: Encodings, smallest alphabet first: a token is in the first that holds all its characters. Plain numbers are in none.
ENCODINGS = [
    ("hex", "eadcfb" + DIGITS), ("HEX", "EADCFB" + DIGITS), ("base32", UPPER + "234567"), ("base36", LOWER + DIGITS), ("BASE36", UPPER + DIGITS),
    ("base62", LOWER + RARE + OTHER + DIGITS), ("base64", LOWER + "+/" + RARE[1:] + "K" + OTHER + DIGITS), ("base64url", LOWER + "-_" + RARE[1:] + "K" + OTHER + DIGITS),
]
#: Of written language: chance that two characters agree, that three do less its square; that neighbours are in different halves, in alphabets of one
#: case (up to 36 characters) and of two; correlation of neighbours, and its spread between texts besides that of chance.
REPEAT = 0.07
CLUSTER = 0.0015
TURN_ONE_CASE, TURN_TWO_CASES = 0.15, 0.2
LAG, LAG_SPREAD = 0.15, 0.14
RANDOM_LEVEL = 0.01
FALSE_DISCOVERY = 0.01
STEPS = 20
MOST_STEPS = 2000
#: Matches of a text that are folded at once.
PIECES = 64

SPAN = "array<struct<start:bigint,kind:int,end:bigint>>"


def _empty() -> Column:
    return F.array().cast(SPAN)


def located(text: Column, pattern: str, kind: int, keep=None, group: int = 0) -> Column:
    """Spans of all matches of ``pattern`` that ``keep`` accepts (it gets the match's ``group``), leftmost first, not overlapping.

    The texts between matches and the matches themselves give the places.
    """
    whole, part = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    pieces = F.arrays_zip(F.transform(F.split(text, pattern, -1), F.length).alias("gap"), F.transform(whole, F.length).alias("width"), part.alias("part"))

    def step(acc, x):
        begin = acc["at"] + x["gap"]
        end = begin + F.coalesce(x["width"], F.lit(0))
        ok = x["width"].isNotNull() if keep is None else x["width"].isNotNull() & keep(x["part"])
        span = F.array(F.struct(begin.alias("start"), F.lit(kind).alias("kind"), end.alias("end"))).cast(SPAN)
        return F.struct(end.alias("at"), F.when(ok, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"))

    fold = lambda x, at: F.aggregate(x, F.struct(at.cast("bigint").alias("at"), _empty().alias("spans")), step, lambda acc: acc["spans"])
    width = lambda x: F.aggregate(x, F.lit(0).cast("bigint"), lambda n, y: n + y["gap"] + F.coalesce(y["width"], F.lit(0)))

    def by_blocks(x):
        # a fold copies its array at each step: many matches are folded block by block, each from where the blocks before it end
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / PIECES).cast("int")), lambda i: F.slice(x, i * PIECES + 1, PIECES))
        starts = lambda b: F.aggregate(b, F.array(F.lit(0).cast("bigint")), lambda acc, y: F.concat(acc, F.array(F.element_at(acc, -1) + width(y))))
        return _let(blocks, lambda b: _let(starts(b), lambda at: F.flatten(F.zip_with(b, F.slice(at, 1, F.size(b)), fold))))

    return _let(pieces, lambda x: F.when(F.size(x) <= PIECES, fold(x, F.lit(0))).otherwise(by_blocks(x)))


def base_spans(text: Column) -> Column:
    """Spans of the base rules, by start and then kind. A rule's fold runs only where a cheaper test finds it possible."""
    assign = F.when(text.rlike(ASSIGN), located(text, ASSIGN, 0, lambda x: F.length(x) >= LEAST["assign"], group=2)).otherwise(_empty())
    access = F.when(F.contains(text, F.lit("AKIA")), located(text, ACCESS, 1, lambda x: F.length(x) >= LEAST["access"])).otherwise(_empty())
    # a run of [0-9a-f]+ is as long as it can be, so asking for the length in the pattern finds the same runs
    long_hex = f"[0-9a-f]{{{LEAST['hex']},}}"
    hexes = F.when(text.rlike(long_hex), located(text, long_hex, 2)).otherwise(_empty())
    return F.array_sort(F.concat(assign, access, hexes))


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def normal_tail(z: Column) -> Column:
    """P(Z > z), by a logistic curve that is within 0.0002."""
    return 1 / (1 + F.exp(F.least(F.lit(700.0), 1.5976 * z + 0.070566 * z * z * z)))


def chi3_tail(x: Column) -> Column:
    """P(chi-squared with three degrees of freedom > x), by the cube root's normal score."""
    return _let((F.cbrt(F.greatest(x, F.lit(0.0)) / 3) - (1 - 2 / 27)) / math.sqrt(2 / 27), normal_tail)


def _alphabet(token: Column) -> Column:
    """The smallest alphabet that holds the token; null for plain numbers."""
    out = F.lit(ENCODINGS[-1][1])
    for _, alphabet in reversed(ENCODINGS[:-1]):
        out = F.when(F.translate(token, alphabet, "") == "", alphabet).otherwise(out)
    mixed = token.rlike("[+/]") & token.rlike("[-_]")
    return F.when(token.rlike("^[0-9]+$") | mixed, F.lit(None).cast("string")).otherwise(out)


def _scores(token: Column, alphabet: Column) -> Column:
    """struct(p_random, p_written) of a token over ``alphabet``."""
    codes = F.filter(F.transform(F.split(token, ""), lambda c: F.instr(alphabet, c).cast("double")), lambda x: x > 0)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, v: s + v)
    pairs = lambda a, f: total(F.zip_with(F.slice(a, 1, F.size(a) - 1), F.slice(a, 2, F.size(a) - 1), f))

    def sums(x):
        counts = F.transform(F.array_distinct(x), lambda v: F.size(F.filter(x, lambda w: w == v)).cast("double"))
        high = F.transform(x, lambda v: (v > F.length(alphabet) / 2).cast("double"))
        return F.struct(
            F.length(alphabet).cast("double").alias("size"), F.length(token).cast("double").alias("n"), total(F.transform(counts, lambda c: c * c)).alias("squares"),
            total(high).alias("n1"), pairs(high, lambda a, b: (a != b).cast("double")).alias("turns"), total(x).alias("sum"), total(F.transform(x, lambda v: v * v)).alias("power"), pairs(x, lambda a, b: a * b).alias("products"),
            (F.element_at(x, 1) + F.element_at(x, -1)).alias("ends"))

    def statistics(m):
        size, n, mean = m["size"], m["n"], m["sum"] / m["n"]
        turns = 2 * m["n1"] * (n - m["n1"]) / n
        return F.struct(
            size.alias("size"), n.alias("n"), (size / n * m["squares"] - n).alias("chi"), m["turns"].alias("turns"), turns.alias("expected"), (turns * (turns - 1) / (n - 1)).alias("var"),
            (m["power"] - n * mean * mean).alias("power"), (m["products"] - mean * (2 * m["sum"] - m["ends"]) + (n - 1) * mean * mean).alias("lag"))

    def verdict(m):
        size, n, df = m["size"], m["n"], m["size"] - 1
        z_chi = (F.cbrt(F.greatest(m["chi"], F.lit(0.0)) / df) - (1 - 2 / (9 * df))) / F.sqrt(2 / (9 * df))
        z_runs = F.when(m["var"] > 0, (m["turns"] - m["expected"]) / F.sqrt(m["var"])).otherwise(F.lit(9.0))
        correlation = F.when(m["power"] > 1e-9, m["lag"] / m["power"]).otherwise(F.lit(1.0))
        z_lag = (correlation + 1 / n) * F.sqrt(n)
        random = F.pow(F.greatest(z_chi, F.lit(0.0)), 2) + F.pow(z_runs, 2) + F.pow(z_lag, 2)
        expected = size * (n - 1) * REPEAT + size - n
        spread = 2 * size / n * F.sqrt(n * (n - 1) / 2 * REPEAT + CLUSTER * n * n * n)
        turn = F.when(size <= 36, TURN_ONE_CASE).otherwise(TURN_TWO_CASES)
        turns, lags = F.sqrt(turn * (1 - turn) * (n - 1)), F.sqrt(1 / n + LAG_SPREAD**2)
        # how far each statistic, and that of random text, is from written text
        scores = [((expected - m["chi"]) / spread, (expected - df) / spread), ((m["turns"] - turn * (n - 1)) / turns, (0.5 - turn) * (n - 1) / turns), ((LAG - correlation) / lags, (LAG + 1 / n) / lags)]
        scores = [(z, F.greatest(w, F.lit(0.0))) for z, w in scores]
        z_written = sum((z * w for z, w in scores[1:]), scores[0][0] * scores[0][1]) / F.sqrt(sum((w * w for _, w in scores[1:]), scores[0][1] * scores[0][1]))
        return F.struct(_let(random, chi3_tail).alias("p_random"), _let(z_written, normal_tail).alias("p_written"))

    return _let(_let(_let(codes, sums), statistics), verdict)


def candidates(text: Column, base: Column) -> Column:
    """Spans to test: runs of token characters less the base spans, in parts where no single alphabet holds them."""
    span = lambda a, b: F.array(F.struct(a.alias("start"), F.lit(3).alias("kind"), b.alias("end"))).cast(SPAN)
    added = lambda spans, a, b: F.when(b - a >= LEAST_RUN, F.concat(spans, span(a, b))).otherwise(spans)

    def free(s):
        hit = F.filter(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))
        start = F.struct(s["start"].alias("at"), _empty().alias("spans"))
        step = lambda acc, b: F.struct(F.greatest(acc["at"], b["end"]).alias("at"), added(acc["spans"], acc["at"], b["start"]).alias("spans"))
        return _let(hit, lambda h: F.when(F.size(h) == 0, F.array(s)).otherwise(F.aggregate(h, start, step, lambda acc: added(acc["spans"], acc["at"], s["end"]))))

    def parts(s):
        token = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        shifted = lambda x: F.struct((x["start"] + s["start"]).alias("start"), x["kind"].alias("kind"), (x["end"] + s["start"]).alias("end"))
        cut = lambda t: F.transform(F.concat(*(located(t, p, 3) for p in PARTS)), shifted)
        return _let(token, lambda t: F.when(t.rlike("[+/]") & t.rlike("[-_]"), F.array_distinct(cut(t)).cast(SPAN)).otherwise(F.array(s)))

    return F.flatten(F.transform(F.flatten(F.transform(located(text, CANDIDATE, 3), free)), parts))


def tested(text: Column, base: Column) -> Column:
    """Tokens outside the base spans with their encoding's test results: array of struct(start, end, p_random, p_written)."""
    def judge(s):
        token = F.substring(text, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))
        scores = lambda t: _let(_alphabet(t), lambda a: _scores(t, a))
        return _let(_let(token, scores), lambda p: F.struct(s["start"].alias("start"), s["end"].alias("end"), p["p_random"].alias("p_random"), p["p_written"].alias("p_written")))

    found = F.filter(F.transform(candidates(text, base), judge), lambda s: s["p_written"].isNotNull())
    return F.when(text.rlike(CANDIDATE), found).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,p_random:double,p_written:double>>"))


def step_of(p: Column) -> Column:
    """Twentieths of a decade below 1, rounded down: a p-value's cell."""
    return F.least(F.floor(-F.log10(F.greatest(p, F.lit(1e-99))) * STEPS), F.lit(MOST_STEPS)).cast("int")


def cut_off(tokens: DataFrame) -> int:
    """The smallest cell at which Benjamini-Hochberg at FALSE_DISCOVERY accepts; ``tokens`` has p_written. One row a cell comes back."""
    cells = sorted(tokens.groupBy(step_of(F.col("p_written")).alias("cell")).count().collect(), reverse=True)
    total, seen, best = sum(n for _, n in cells), 0, MOST_STEPS + 1
    for cell, n in cells:
        seen += n
        if 10 ** (-cell / STEPS) <= FALSE_DISCOVERY * seen / total:
            best = cell
    return best


def scanned(docs: DataFrame, base: str = "base", tokens: str = "tokens") -> DataFrame:
    """``docs`` with ``base`` (spans of the base rules) and ``tokens`` (what the battery says of the others).

    Null texts are empty; columns of these names are replaced; repeated rows are
    each scanned; an empty table gives an empty one. A very long text takes time
    in proportion to its length times the number of its matches, as its tokens
    are cut out and held against its base spans one by one.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(tokens, tested(text, F.col(base)))


def added_spans(tokens: Column, cut: int) -> Column:
    """Spans of the tokens that pass as random and as discoveries."""
    good = F.filter(tokens, lambda t: (t["p_random"] >= RANDOM_LEVEL) & (step_of(t["p_written"]) >= cut))
    return F.transform(good, lambda t: F.struct(t["start"].alias("start"), F.lit(3).alias("kind"), t["end"].alias("end"))).cast(SPAN)


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def redacted(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every secret in ``text`` replaced by ``mark``, and n_chars (where there is one) as the new length.

    Nulls stay null; overlapping spans become one mark; no row is dropped. Texts
    are scanned once: what was found is kept with them until the cut-off is known.
    """
    found = kept(scanned(docs, "_base", "_tokens"), "secrets-found")
    cut = cut_off(found.select(F.explode("_tokens").alias("t")).select("t.p_written"))
    found = found.withColumn("_spans", F.array_sort(F.concat("_base", added_spans(F.col("_tokens"), cut))))
    text = F.col("text")
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc, s):
        gap = F.substring(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], gap, F.lit(mark)).alias("out"))
        longer = F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out"))
        return F.when((s["start"] >= acc["at"]), fresh).otherwise(longer)

    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.length(text)))
    clean = F.when(F.size("_spans") > 0, F.aggregate("_spans", start, step, rest)).otherwise(text)
    out = found.withColumn("text", clean)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.size("_spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op10_secret_battery(spark, sf_dir: str) -> DataFrame:
    """Every document's secrets: counts and a digest of the base spans, and all spans."""
    docs = kept(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "secrets-scanned")
    cut = cut_off(docs.select(F.explode("tokens").alias("t")).select("t.p_written"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    spans = F.array_sort(F.concat("base", added_spans(F.col("tokens"), cut)))
    return docs.select("doc_id", *(count(i).alias(f"n_{KINDS[i]}") for i in range(3)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(spans).alias("spans"))
