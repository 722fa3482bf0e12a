"""Personal data: base rules against plain Python, labelers' reliabilities against plain expectation-maximisation, planted cases."""

import hashlib
import math
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import pii

SF = "/root/testdata/sf0.001"
NAMES = ["email", "ip", "card", "phone"]


def passes(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base(text):
    text, out = text or "", []
    only = lambda s: re.sub("[^0-9]", "", s)
    keep = [
        (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        (r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(only(s)) <= 19 and passes(only(s))),
        (r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(only(s)) <= 15),
    ]
    for kind, (pattern, ok) in enumerate(keep):
        out += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if ok(m.group())]
    return out


def written(spans):
    return ",".join(f"{NAMES[k]}:{a}:{b}" for k, a, b in spans)


def made():
    rng = random.Random(4)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for letters in ("a@.b_-é ", "0123456789", "12.5 3", "123 -4", "+12()3 .-", "@.+1 ab%", "4 5-0😀") for _ in range(150)]
    for _ in range(200):
        n = rng.randint(12, 20)
        digits = "".join(rng.choice("0123456789") for _ in range(n - 1))
        digits += next(c for c in "0123456789" if passes(digits + c))
        texts.append("pay " + rng.choice(["", " ", "-"]).join(re.findall(".{1,4}", digits)) + rng.choice(["", "7", " now", "-"]))
    return texts


ODD = [None, "", " ", "a@b.c_d@e.f", "a@b..c", "@b.c", "x@y", "1.2.3.4.5.6.7.8", "256.1.1.1 0255.1.1.001", "+1", "+1 (319) 555-5132", "++49 30 1234567x", "é a.b+c%d@mail-1.example.co.uk.", "4425414259157784-", "0" * 16, "1" * 30000, "a" * 30000 + "@", "a." * 9000 + "@b.c", "1 " * 9000, "+" * 9000]


def test_base_spans_equal_plain_python(spark):
    texts = [*ODD, *made()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(4).withColumn("base", F.lit("x")).withColumn("start", F.lit(1)).withColumn("kind", F.lit("y"))
    rows = pii.scanned(docs).collect()
    assert {"start", "kind"} <= set(rows[0].__fields__)
    for r in rows:
        assert [(s.kind, s.start, s.end) for s in r.base] == base(r.text), r.text


def test_check_digits(spark):
    rows = [("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765432", True), ("DE88 3704 0044 0532 0130 00", False), ("FR1420041010050500013M02606", True)]
    for text, want in rows:
        assert spark.range(1).select(pii.mod_97(F.lit(text))).first()[0] is want


def plain_em(patterns):
    """Votes one by one, as in the definition."""
    belief = max(pii.BELIEF_LEAST, pii.BELIEF_SHARE * sum(patterns.values()))
    share = pii.SHARE
    chance = [[dict(zip(pii.VOTES, pii.BELIEF[c], strict=True)) for _ in pii.LABELERS] for c in range(2)]
    for _ in range(pii.ROUNDS):
        post = {}
        for w in patterns:
            yes, no = share, 1 - share
            for k, v in enumerate(w):
                yes, no = yes * chance[0][k][v], no * chance[1][k][v]
            post[w] = yes / (yes + no)
        mass = [sum(n * post[w] for w, n in patterns.items()), sum(n * (1 - post[w]) for w, n in patterns.items())]
        share = (mass[0] + belief * pii.SHARE) / (sum(mass) + belief)
        chance = [[{v: (sum(n * (post[w] if c == 0 else 1 - post[w]) for w, n in patterns.items() if w[k] == v) + belief * pii.BELIEF[c][i]) / (mass[c] + belief) for i, v in enumerate(pii.VOTES)} for k in range(len(pii.LABELERS))] for c in range(2)]
    return share, [[[chance[c][k][v] for v in pii.VOTES] for k in range(len(pii.LABELERS))] for c in range(2)]


def test_reliabilities_equal_plain_em_and_show_who_is_right():
    rng = random.Random(5)
    right = [0.95, 0.9, 0.8, 0.9, 0.85, 0.6]
    seen = Counter()
    for _ in range(5000):
        y = rng.random() < 0.2
        seen["".join(rng.choice("0") if rng.random() < 0.4 else ("+" if (rng.random() < p) == y else "-") for p in right)] += 1
    share, chance = pii.reliabilities(seen)
    want_share, want = plain_em(seen)
    assert math.isclose(share, want_share, rel_tol=1e-9) and np.allclose(chance, want, rtol=1e-9)
    assert abs(share - 0.2) < 0.05
    plus = chance[0, :, 0] / (chance[0, :, 0] + chance[0, :, 2])
    assert plus[0] > 0.9 and plus[0] > plus[5] and abs(plus[5] - 0.6) < 0.15
    assert pii.reliabilities({})[0] == pii.SHARE


PLANTED = [
    ("please call me on 030 1234 5678 tonight", "contact", "030 1234 5678"), ("Telefon: 0171 555 0123.", "contact", "0171 555 0123"), ("his ssn is 123-45-6789 and", "contact", "123-45-6789"),
    ("transfer to IBAN DE89 3704 0044 0532 0130 00 today", "account", "DE89 3704 0044 0532 0130 00"), ("my account GB82WEST12345698765432, thanks", "account", "GB82WEST12345698765432"),
    ("dear Mr. Thomas Miller, we", "person", "Thomas Miller"), ("mein Name ist Julia Schneider und", "person", "Julia Schneider"),
    ("write to jane.roe (at) gmail (dot) com soon", "handle", "jane.roe (at) gmail (dot) com"), ("contact: bob at yahoo dot fr", "handle", "bob at yahoo dot fr"),
]
CLEAN = ["see version 1.2.3.4567 of the General Public License", "on 2024-01-15 and 15/01/2024 we met", "token = 8824c3a463b8b0d6", "isbn 978-3-16-148410-0", "order 20240115", "The Creative Commons License is Open Source",
         "id=12345678901", "it costs 1 234 567 890 €", "abc12345678def", "look at this dot there", "Release AB12 CDEF is out", "the United States", "x 1234567 y"]


def test_planted_data_are_found_and_clean_texts_are_left(spark):
    rng = random.Random(6)
    rows = [(i, rng.choice(PLANTED)[0] if i % 3 == 0 else rng.choice(CLEAN)) for i in range(900)]
    rows += [(1000 + i, p[0]) for i, p in enumerate(PLANTED)] + [(2000 + i, c) for i, c in enumerate(CLEAN)]
    docs = pii.scanned(spark.createDataFrame(rows, "doc_id int, text string"))
    model = pii.learned(docs)
    got = {r.doc_id: (r.text, r.spans) for r in docs.select("doc_id", "text", pii.written(F.concat("base", pii.added_spans(F.col("base"), F.col("found"), model))).alias("spans")).where("doc_id >= 1000").collect()}
    for i, (text, kind, what) in enumerate(PLANTED):
        at = text.index(what)
        assert f"{kind}:{at}:{at + len(what)}" in got[1000 + i][1].split(","), (text, got[1000 + i][1])
    for i, text in enumerate(CLEAN):
        assert got[2000 + i][1] == "", (text, got[2000 + i][1])
    assert len(model.rows()) == len(pii.ADDED) * len(pii.LABELERS) * 3


def test_added_spans_keep_off_base_spans_and_each_other(spark):
    docs = pii.scanned(spark.createDataFrame([(1, "call +49 30 123456789 or write me@example.com at once dot org, tel 030 1234 5678")] * 50, "doc_id int, text string"))
    model = pii.learned(docs)
    r = docs.select("base", pii.added_spans(F.col("base"), F.col("found"), model).alias("added")).first()
    spans = sorted((s.start, s.end) for s in [*r.base, *r.added])
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:], strict=False)) and r.base


def test_an_empty_table(spark):
    docs = pii.scanned(spark.createDataFrame([], "doc_id int, text string"))
    assert docs.select(pii.added_spans(F.col("base"), F.col("found"), pii.learned(docs))).collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_has_the_base_spans(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    for r in pii.op12_weak_pii(spark, SF).collect():
        want = base(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(written(want).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in NAMES] == [sum(s[0] == i for s in want) for i in range(4)]
        assert [x for x in r.spans.split(",") if x.split(":")[0] in NAMES] == [x for x in written(want).split(",")] or not want
