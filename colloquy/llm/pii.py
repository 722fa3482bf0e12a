"""Personal data by weak supervision, on DataFrame functions alone.

Base rules find mail addresses, IP addresses, card and phone numbers. Beyond
these, candidates of four more kinds are looked for: numbers that may be a phone
or an identity number (contact), bank accounts (account), names of people
(person) and written-out mail addresses (handle). Six labelers vote on each of
them, for (+), against (-) or not at all (0):

* shape and check, by regular expressions and check digits;
* gazetteer, by lists of prefixes, countries, given names, hosts;
* near, by words before the candidate that announce such data;
* far, by words before it that announce something else;
* edge, by the characters beside it.

How often each pattern of votes occurs is counted over the corpus, and
expectation-maximisation over these counts estimates how reliable each labeler
is for each kind, as P(vote | personal) and P(vote | not), and how likely a
pattern is personal. A logistic classifier of spans is then fitted to these
likelihoods: it knows a span's make-up (digits, groups, separators, what stands
beside it) besides the votes, and decides. Numbers that base rules have found
take part in the estimates, but no span is added that overlaps a base span.

A candidate is reduced to two short words, its votes and its make-up, so that
what is counted has a bound that no corpus exceeds: 4 kinds x 3**6 votes, and
4 x 7776 make-ups. Spans are in code points, end exclusive.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table
from .secrets import SPAN, _empty, _let, located

# The base rules. Runs are taken whole, so that no rule goes back into a long one.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}"
IP_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
#: Shorter runs fail in any case.
CARD = r"[0-9](?:[\x20-]?[0-9]){12,}+"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
CARD_DIGITS, PHONE_DIGITS = (13, 19), (9, 15)
KINDS = ["email", "ip", "card", "phone", "contact", "account", "person", "handle"]
BASE, ADDED = KINDS[:4], KINDS[4:]

CONTACT = r"[0-9](?:[\x20()./-]{0,2}+[0-9]){6,}+"
CONTACT_DIGITS = (7, 15)
ACCOUNT = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[0-9]{1,3})?(?![A-Za-z0-9])"
PERSON = r"(?<![\p{L}\p{M}])\p{Lu}\p{Ll}+(?:\x20\p{Lu}\p{Ll}+){1,2}(?![\p{L}\p{M}])"
HANDLE = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++(?:\x20?[(\[]at[)\]]\x20?|\x20at\x20)[A-Za-z0-9-]++(?:(?:\x20?[(\[]dot[)\]]\x20?|\x20dot\x20|\.)[A-Za-z0-9-]++)++"
PATTERNS = dict(zip(ADDED, [CONTACT, ACCOUNT, PERSON, HANDLE], strict=True))
#: What a text must have for a pattern to be tried.
HINTS = {"contact": CONTACT, "account": r"[A-Z]{2}[0-9]{2}\x20?[A-Z0-9]{4}", "person": r"\p{Lu}\p{Ll}+\x20\p{Lu}\p{Ll}", "handle": r"[(\[]at[)\]]|\x20at\x20\S+(?:\x20dot\x20|[(\[]dot)"}

# Lists of the labelers.
PREFIXES = "0044 0033 0049 0034 0039 0031 0041 0043 001 044 033 049 034 07 06 01 02 03 04 05 08 09"
ACCOUNT_COUNTRIES = "AD AE AT BE BG CH CY CZ DE DK EE ES FI FR GB GR HR HU IE IS IT LI LT LU LV MC MT NL NO PL PT RO SA SE SI SK SM TR"
GIVEN = (
    "Adam Alice Alexander Ana Andrea Andreas Andrew Anna Anne Antonio Barbara Carlos Carmen Charles Charlotte Christian Christine Claire Clara Daniel David Elena Elisabeth "
    "Elizabeth Emily Emma Eric Eva Felix Francisco Frank George Hans Helen Henry Isabel Jack Jacques James Jan Jane Jean Jennifer Jessica Johann John Jonas Jorge Jose José "
    "Joseph Juan Julia Julie Karl Katharina Laura Lena Linda Louis Lucas Lucia Luis Luisa Manuel Marc Marco Margaret Maria Marie Mark Markus Martin Mary Matthew Max Michael "
    "Miguel Monika Nicolas Nicole Olivia Oscar Patricia Patrick Paul Paula Pedro Peter Petra Philip Philippe Pierre Rachel Richard Robert Rosa Sara Sarah Sebastian Simon "
    "Sofia Sophie Stefan Stephen Susan Susanne Teresa Thomas Tom Ursula Victor Victoria Walter William Wolfgang")
NOT_NAMES = (
    "Academic Affero Apache April August Avenue Bank Boost Business Change City Club College Commons Company Conditions Copyright Corporation Court Creative Day December "
    "Department February Foundation Free Friday General Government Institute International January July June Law Lesser Library License Limited March May Monday Mozilla "
    "National New North November October Office Open Party Permission Policy Press Privacy Public Rights Road Saturday School Section September Service Services Software "
    "South Source State States Street Sunday System Terms The Thursday Tuesday Union United University Use Version Wednesday West World")
HOSTS = "gmail googlemail yahoo hotmail outlook icloud gmx web proton protonmail aol mail live orange free wanadoo example"
ENDINGS = "com org net edu gov info io eu de fr es it uk co us ch at nl be"
NEAR = {
    "contact": r"phone|\btel\b|tel[.:]|call|mobile|cell|\bfax\b|reach|whatsapp|\bsms\b|t[eé]l[eé]?|portable|appele[rz]|m[oó]vil|llam|telefon|handy|ruf|\bssn\b|social security|\bdni\b|\bnie\b|passport|passeport|pasaporte|ausweis|identity",
    "account": r"iban|account|konto|compte|cuenta|bank|\bbic\b|transfer|[uü]berweis|virement|transferencia",
    "person": r"\bmrs?\b|\bms\b|\bdr\b|\bprof\b|\bsir\b|name|\bdear\b|signed|\bherrn?\b|\bfrau\b|hei[sß]+e|monsieur|madame|\bmme\b|m'appelle|señora?|\bllamo\b|nombre|regards|contact|ask for|patient|born",
    "handle": r"mail|contact|write|reach|schreib|[eé]cri|escrib|correo|address|adresse",
}
FAR = r"version|page|seite|página|isbn|issn|\bdoi\b|order|invoice|item|section|chapter|figure|table|licen[sc]e|copyright|token|secret|passw|key|hash|\bsha|md5|build|commit|price|total|population|\$|€|§|№|https?:|www\."
#: Code points before a candidate in which words are looked for.
BEFORE = 32

LABELERS = ["shape", "check", "gazetteer", "near", "far", "edge"]
VOTES = "+0-"
#: What is believed before any count, as P(vote | personal) and P(vote | not) in the order of VOTES; how many candidates that is worth, at least and as a share.
BELIEF = np.array([[0.5, 0.46, 0.04], [0.04, 0.46, 0.5]])
BELIEF_LEAST, BELIEF_SHARE = 50.0, 0.1
SHARE = 0.1
ROUNDS = 100
RIDGE = 1.0
#: Least score of a span that is added.
ACCEPT = 0.5
#: Values of a candidate's make-up: digits, groups, separators, what is before and after it, then the votes of near, far and gazetteer.
MAKE_UP = ["01234", "0123", "nsho", "abc", "abc", "+0", "0-", VOTES]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _within(x: Column, bounds: tuple[int, int]) -> Column:
    return F.length(_digits(x)).between(*bounds)


def luhn(x: Column) -> Column:
    """Whether the digits of a string pass: from the right, every second is doubled, and the digits of all add up to a multiple of ten."""
    each = F.transform(F.split(F.reverse(_digits(x)), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    """Spans of the base rules, by kind and then start."""
    found = [
        (F.contains(text, F.lit("@")), EMAIL, None),
        (text.rlike(r"[0-9]\.[0-9]++\.[0-9]"), IP, lambda x: x.rlike(rf"^{IP_PART}(?:\.{IP_PART}){{3}}$")),
        (text.rlike(CARD), CARD, lambda x: _within(x, CARD_DIGITS) & luhn(x)),
        (F.contains(text, F.lit("+")), PHONE, lambda x: _within(x, PHONE_DIGITS)),
    ]
    return F.concat(*(F.when(possible, located(text, pattern, kind, keep)).otherwise(_empty()) for kind, (possible, pattern, keep) in enumerate(found)))


def _vote(plus: Column, minus: Column) -> Column:
    """A vote; null conditions don't hold, and where both do, they cancel."""
    plus, minus = F.coalesce(plus, F.lit(False)), F.coalesce(minus, F.lit(False))
    return F.when(plus & ~minus, "+").when(minus & ~plus, "-").otherwise("0")


def _words(text: str) -> str:
    return "|".join(text.split())


def mod_97(x: Column) -> Column:
    """Whether an account number's check digits are right: the first four characters last, letters as 10 to 35, the remainder of 97 is 1."""
    plain = F.regexp_replace(x, " ", "")
    turned = F.split(F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4)), "")
    value = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    step = lambda r, c: F.when(value(c) < 0, r).when(value(c) < 10, (r * 10 + value(c)) % 97).otherwise((r * 100 + value(c)) % 97)
    return F.aggregate(turned, F.lit(0), lambda r, c: step(r, c).cast("int")) == 1


def _ballot(kind: str, x: Column, before: Column, left: Column, right: Column) -> Column:
    """The votes of LABELERS on a candidate, as a word."""
    no = F.lit(False)
    if kind == "contact":
        date = r"^(?:[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4})"
        shape = _vote(x.rlike(r"^0?[0-9]{2,4}\)?[ /-]{1,2}[0-9]{2,4}(?:[ -][0-9]{2,4}){1,3}$") | x.rlike(r"^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), x.rlike(date) | x.rlike(r"^[0-9]+(?:\.[0-9]+)+$") | x.rlike(r"^[0-9]{4} ?[-/] ?[0-9]{4}$"))
        check = _vote(F.length(_digits(x)).between(9, 12) & x.rlike("[^0-9]"), x.rlike(r"([0-9])\1{5,}") | x.rlike(r"^[0-9]+$"))
        gazetteer = _vote(x.rlike(f"^(?:{_words(PREFIXES)})"), no)
    elif kind == "account":
        shape = _vote(x.rlike(r"^[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4})+(?: [0-9]{1,3})?$") | x.rlike(r"^[A-Z]{2}[0-9]{12,}$"), F.length(_digits(x)) < 10)
        check = _vote(mod_97(x), ~mod_97(x))
        gazetteer = _vote(F.substring(x, 1, 2).isin(*ACCOUNT_COUNTRIES.split()), ~F.substring(x, 1, 2).isin(*ACCOUNT_COUNTRIES.split()))
    elif kind == "person":
        shape = _vote(before.rlike(r"(?i)(?:\b(?:mrs?|ms|dr|prof|mme)\.?|\b(?:herrn?|frau|monsieur|madame|señora?|dear)) $"), before.rlike(r"(?:^|[.!?:;\n] ?)$") & (F.size(F.split(x, " ")) > 2))
        check = _vote(no, x.rlike(r"\b\p{Lu}\p{Ll}?\b"))
        gazetteer = _vote(x.rlike(rf"^(?:{_words(GIVEN)})(?: |$)"), x.rlike(rf"(?:^| )(?:{_words(NOT_NAMES)})(?: |$)"))
    else:
        shape = _vote(x.rlike(r"[(\[]at[)\]]"), ~x.rlike(r"[(\[]at[)\]]| dot |[(\[]dot"))
        check = _vote(x.rlike(rf"(?i)(?:\.|dot[)\]]? ?)(?:{_words(ENDINGS)})$"), ~x.rlike(rf"(?i)(?:\.|dot[)\]]? ?)(?:{_words(ENDINGS)})$"))
        gazetteer = _vote(x.rlike(rf"(?i)(?: |[)\]])(?:{_words(HOSTS)})[0-9]*(?:[ .(\[]|$)"), no)
    near, far = _vote(before.rlike(f"(?i)(?:{NEAR[kind]})"), no), _vote(no, before.rlike(f"(?i)(?:{FAR})"))
    edge = _vote(no, left.rlike(r"[\p{L}\p{N}_=#/\\@&+%-]") | right.rlike(r"[\p{L}\p{N}_=#/\\@&%-]"))
    return F.concat(shape, check, gazetteer, near, far, edge)


def _make_up(x: Column, votes: Column, left: Column, right: Column) -> Column:
    """A value of each of MAKE_UP, as a word."""
    digits, groups = F.length(_digits(x)), F.size(F.split(x, "[^\\p{L}\\p{N}]+"))
    cell = lambda c, cuts: F.expr("'0'") if not cuts else F.when(c < cuts[0], "0").otherwise(F.when(c < cuts[1], "1").otherwise(F.when(c < cuts[2], "2").otherwise("3")))
    many = F.when(digits < 1, "0").when(digits < 9, "1").when(digits < 11, "2").when(digits < 13, "3").otherwise("4")
    between = F.when(~x.rlike("[^\\p{L}\\p{N}]"), "n").when(x.rlike("^[\\p{L}\\p{N} ]+$"), "s").when(x.rlike("^[\\p{L}\\p{N}-]+$"), "h").otherwise("o")
    beside = lambda c: F.when((c == "") | c.rlike("\\s"), "a").when(c.rlike("[\\p{L}\\p{N}]"), "c").otherwise("b")
    vote = lambda name: F.substring(votes, LABELERS.index(name) + 1, 1)
    return F.concat(many, cell(groups, (2, 3, 4)), between, beside(left), beside(right), vote("near"), vote("far"), vote("gazetteer"))


FOUND = "array<struct<start:bigint,kind:int,end:bigint,votes:string,made:string>>"


def candidates(text: Column) -> Column:
    """Candidates of the added kinds with their votes and make-up, by kind and then start."""
    def judged(kind, spans):
        def judge(s):
            at = lambda a, n: F.substring(text, (a + 1).cast("int"), n.cast("int"))
            parts = F.struct(at(s["start"], s["end"] - s["start"]).alias("x"), at(F.greatest(s["start"] - BEFORE, F.lit(0)), F.least(s["start"], F.lit(BEFORE))).alias("before"), at(s["end"], F.lit(1)).alias("right"))

            def marked(p):
                left = F.substring(p["before"], -1, 1)
                return _let(_ballot(kind, p["x"], p["before"], left, p["right"]), lambda v: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"), v.alias("votes"), _make_up(p["x"], v, left, p["right"]).alias("made")))

            return _let(parts, marked)

        return F.transform(spans, judge)

    def found(kind):
        keep = (lambda x: _within(x, CONTACT_DIGITS)) if kind == "contact" else None
        spans = judged(kind, located(text, PATTERNS[kind], KINDS.index(kind), keep))
        return F.when(text.rlike(HINTS[kind]), spans).otherwise(F.array()).cast(FOUND)

    return F.concat(*map(found, ADDED))


def scanned(docs: DataFrame, base: str = "base", found: str = "found") -> DataFrame:
    """``docs`` with ``base`` (spans of the base rules) and ``found`` (candidates of other kinds with votes and make-up).

    Null texts are empty; columns of these names are replaced; repeated rows are
    each scanned; an empty table gives an empty one. Of a very long text each
    candidate is cut out by itself, which takes time in proportion to its length
    times their number.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.withColumn(base, base_spans(text)).withColumn(found, candidates(text))


def reliabilities(patterns: dict[str, float]) -> tuple[float, np.ndarray]:
    """(share of personal ones, P(vote | class) by class, labeler and vote) of how often each pattern of votes occurs, by expectation-maximisation.

    Counts of what was believed before are added, so that the classes keep their
    meaning when labelers hardly vote.
    """
    words = sorted(patterns)
    n = np.array([patterns[w] for w in words], float)
    votes = np.array([[VOTES.index(v) for v in w] for w in words], int).reshape(len(words), len(LABELERS))
    belief = max(BELIEF_LEAST, BELIEF_SHARE * n.sum())
    share, chance = SHARE, np.repeat(BELIEF[:, None, :], len(LABELERS), 1)
    for _ in range(ROUNDS):
        odds = math.log(share / (1 - share)) + (np.log(chance[0])[np.arange(len(LABELERS)), votes] - np.log(chance[1])[np.arange(len(LABELERS)), votes]).sum(1)
        personal = n / (1 + np.exp(-odds))
        share = (personal.sum() + belief * SHARE) / (n.sum() + belief)
        for c, weight in enumerate((personal, n - personal)):
            for k in range(len(LABELERS)):
                chance[c, k] = (np.bincount(votes[:, k], weight, len(VOTES)) + belief * BELIEF[c]) / (weight.sum() + belief)
    return share, chance


def _odds(votes: Column, share: float, chance: np.ndarray) -> Column:
    """Log odds that a candidate with these votes is personal."""
    out = F.lit(math.log(share / (1 - share)))
    for k in range(len(LABELERS)):
        llr = np.log(chance[0, k]) - np.log(chance[1, k])
        vote = F.substring(votes, k + 1, 1)
        out = out + F.when(vote == VOTES[0], float(llr[0])).when(vote == VOTES[1], float(llr[1])).otherwise(float(llr[2]))
    return out


def fitted(cells: dict[str, tuple[float, float]]) -> np.ndarray:
    """Weights of a logistic classifier of make-ups, from (number, likely personal) of each, by Newton's method with a ridge. The last is the constant."""
    words = sorted(cells)
    columns = list(itertools.chain.from_iterable(((i, v) for v in values) for i, values in enumerate(MAKE_UP)))
    x = np.array([[float(w[i] == v) for i, v in columns] + [1.0] for w in words]).reshape(len(words), len(columns) + 1)
    n, y = np.array([cells[w] for w in words], float).reshape(len(words), 2).T
    w = np.zeros(x.shape[1])
    w[-1] = math.log(SHARE / (1 - SHARE))
    centre = w.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - n * p) - RIDGE * (w - centre)
        bend = (x * (n * p * (1 - p))[:, None]).T @ x + RIDGE * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return w


def _score(made: Column, weights: np.ndarray) -> Column:
    out, at = F.lit(float(weights[-1])), 0
    for i, values in enumerate(MAKE_UP):
        term = F.lit(0.0)
        for v in values:
            term = F.when(F.substring(made, i + 1, 1) == v, float(weights[at])).otherwise(term)
            at += 1
        out = out + term
    return 1 / (1 + F.exp(-out))


class Model:
    """Reliabilities and classifier of each added kind; rows() shows the former."""

    def __init__(self, found: DataFrame):
        """``found`` has kind, votes and made, a row a candidate. At most 4 x 3**6 and 4 x 7776 rows come to the driver."""
        patterns: dict[str, dict[str, float]] = {k: {} for k in ADDED}
        for kind, votes, n in found.groupBy("kind", "votes").count().collect():
            patterns[KINDS[kind]][votes] = n
        self.labelers = {k: reliabilities(patterns[k]) for k in ADDED}
        likely = 1 / (1 + F.exp(-self._by_kind(F.col("kind"), lambda k: _odds(F.col("votes"), *self.labelers[k]))))
        cells: dict[str, dict[str, tuple[float, float]]] = {k: {} for k in ADDED}
        for kind, made, n, y in found.withColumn("y", likely).groupBy("kind", "made").agg(F.count("*"), F.sum("y")).collect():
            cells[KINDS[kind]][made] = (n, y)
        self.weights = {k: fitted(cells[k]) for k in ADDED}

    @staticmethod
    def _by_kind(kind: Column, value) -> Column:
        out = F.lit(None).cast("double")
        for k in ADDED:
            out = F.when(kind == KINDS.index(k), value(k)).otherwise(out)
        return out

    def score(self, candidate: Column) -> Column:
        return self._by_kind(candidate["kind"], lambda k: _score(candidate["made"], self.weights[k]))

    def rows(self) -> list[tuple[str, str, str, float, float]]:
        """(kind, labeler, vote, P(vote | personal), P(vote | not))."""
        return [(k, name, v, float(c[0, i, j]), float(c[1, i, j])) for k, (_, c) in self.labelers.items() for i, name in enumerate(LABELERS) for j, v in enumerate(VOTES)]


def added_spans(base: Column, found: Column, model: Model) -> Column:
    """Spans that the classifier accepts and no base span overlaps; of two that overlap, the one of the earlier kind."""
    clear = lambda spans, c: ~F.exists(spans, lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"]))
    good = F.filter(found, lambda c: clear(base, c) & (model.score(c) >= ACCEPT))
    spans = F.transform(good, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))).cast(SPAN)
    return _let(spans, lambda s: F.filter(s, lambda c: clear(F.filter(s, lambda e: e["kind"] < c["kind"]), c)))


def written(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"] + 1), s["start"], s["end"])), ",")


def learned(rows: DataFrame, base: str = "base", found: str = "found") -> Model:
    return Model(rows.select(F.explode(found).alias("c")).select("c.kind", "c.votes", "c.made"))


def op12_weak_pii(spark, sf_dir: str) -> DataFrame:
    """Every document's personal data: counts and a digest of the base spans, and all spans."""
    docs = kept(scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text"), "pii-scanned")
    model = learned(docs)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    spans = F.concat("base", added_spans(F.col("base"), F.col("found"), model))
    return docs.select("doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(BASE)), F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(spans).alias("spans"))
