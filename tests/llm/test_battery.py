"""The randomness battery against a plain loop, and how many planted tokens it finds among prose."""

import math
import os
import random
import re
import string

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import secrets

SF = "/root/testdata/sf0.001"
D, LO, UP = string.digits, string.ascii_lowercase, string.ascii_uppercase
ALPHABETS = {"HEX": D + "ABCDEF", "base32": UP + "234567", "base36": D + LO, "BASE36": D + UP, "base62": D + LO + UP, "base64": D + LO + UP + "+/", "base64url": D + LO + UP + "-_"}


def tail(z):
    return 1 / (1 + math.exp(min(700.0, 1.5976 * z + 0.070566 * z**3)))


def battery(token):
    """(p_random, p_written), or None where no alphabet holds the token."""
    if token.isdigit():
        return None
    alphabet = next((a for _, a in secrets.ENCODINGS if set(token) <= set(a)), None)
    if alphabet is None:
        return None
    x, n, size = np.array([alphabet.index(c) + 1 for c in token], float), len(token), len(alphabet)
    df = size - 1
    chi = size / n * sum(token.count(c) ** 2 for c in set(token)) - n
    high = x > size / 2
    turns, n1 = int((high[1:] != high[:-1]).sum()), int(high.sum())
    mean = 2 * n1 * (n - n1) / n
    var = mean * (mean - 1) / (n - 1)
    spread = ((x - x.mean()) ** 2).sum()
    lag = ((x[1:] - x.mean()) * (x[:-1] - x.mean())).sum() / spread if spread > 1e-9 else 1.0
    z_chi = (np.cbrt(max(chi, 0) / df) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    z_runs = (turns - mean) / math.sqrt(var) if var > 0 else 9.0
    random_ = max(z_chi, 0) ** 2 + z_runs**2 + ((lag + 1 / n) * math.sqrt(n)) ** 2
    p_random = tail((np.cbrt(random_ / 3) - (1 - 2 / 27)) / math.sqrt(2 / 27))
    written = size * (n - 1) * secrets.REPEAT + size - n
    sd_chi = 2 * size / n * math.sqrt(n * (n - 1) / 2 * secrets.REPEAT + secrets.CLUSTER * n**3)
    turn = secrets.TURN_ONE_CASE if size <= 36 else secrets.TURN_TWO_CASES
    sd_turns, sd_lag = math.sqrt(turn * (1 - turn) * (n - 1)), math.sqrt(1 / n + secrets.LAG_SPREAD**2)
    z = [(written - chi) / sd_chi, (turns - turn * (n - 1)) / sd_turns, (secrets.LAG - lag) / sd_lag]
    w = [max(0.0, (written - df) / sd_chi), (0.5 - turn) * (n - 1) / sd_turns, (secrets.LAG + 1 / n) / sd_lag]
    return p_random, tail(sum(a * b for a, b in zip(z, w, strict=True)) / math.sqrt(sum(b * b for b in w)))


def made(alphabet, n, rng):
    while True:
        token = "".join(rng.choices(alphabet, k=n))
        if not token.isdigit() and token[0] not in "-_+/":
            return token


def test_battery_equals_a_loop(spark):
    rng = random.Random(3)
    tokens = [made(a, n, rng) for a in ALPHABETS.values() for n in (20, 25, 64, 500) for _ in range(3)]
    tokens += ["a" * 20, "ab" * 15, "thisisaverylongnaturalwordthatkeepsgoingon", "THE_QUICK_BROWN_FOX_JUMPS", "1" * 30, "path/to/some/file/of/mine", "ABABABABABABABABABABABAB", "zzzzzzzzzzzzzzzzzzzzzzzzA"]
    docs = spark.createDataFrame(list(enumerate(tokens)), "doc_id long, text string")
    got = {r["doc_id"]: r["tokens"] for r in secrets.scanned(docs).collect()}
    for i, token in enumerate(tokens):
        want = battery(token)
        if want is None or any(re.fullmatch(secrets.HEX, token) for _ in [0] if len(token) >= 24):
            assert got[i] == []
            continue
        (one,) = got[i]
        assert (one["start"], one["end"]) == (0, len(token))
        assert one["p_random"] == pytest.approx(want[0], rel=1e-6, abs=1e-12) and one["p_written"] == pytest.approx(want[1], rel=1e-6, abs=1e-12)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("n", [24, 32, 40, 64])
def test_planted_tokens_are_found_among_prose(spark, n):
    """Nine in ten of each encoding, with long written words as company; next to none of those is taken."""
    rng = random.Random(n)
    words = sorted({w.lower() for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for w in re.findall(r"[A-Za-z]{2,}", r[0] or "")})
    joins = [lambda w: "".join(w), lambda w: "_".join(w), lambda w: "/".join(w), lambda w: "-".join(w), lambda w: w[0] + "".join(x.capitalize() for x in w[1:]), lambda w: "_".join(w).upper()]
    written = []
    for i in range(300):
        pick = rng.sample([w for w in words if len(w) > 4], 6)
        written.append(joins[i % len(joins)](pick))
    planted = [(e, made(a, n, rng)) for e, a in ALPHABETS.items() for _ in range(60)]
    prose = lambda: " ".join(rng.choices(words, k=20))
    rows = [(i, f"{prose()} {t} é {prose()}") for i, t in enumerate([*(t for _, t in planted), *written])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redacted(docs).collect()}
    for e in ALPHABETS:
        found = [planted[i][1] not in out[i] for i in range(len(planted)) if planted[i][0] == e]
        assert np.mean(found) >= 0.9, (e, np.mean(found))
    assert np.mean([w not in out[len(planted) + i] for i, w in enumerate(written)]) <= 0.03


def test_many_matches_in_one_text(spark):
    """Folded block by block; places count code points."""
    text = "é😀 " + " token=abcdef12 x" * 1000
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    (row,) = secrets.scanned(docs).select("base").collect()
    assert [tuple(x) for x in row[0]] == [(m.start(), 0, m.end()) for m in re.finditer(secrets.ASSIGN, text)]


def test_odd_tables(spark):
    schema = "doc_id long, text string, base int, tokens string"
    docs = spark.createDataFrame([(None, None, 1, "x"), (1, "", 1, "x"), (1, "password=hunter22", 1, "x"), (1, "password=hunter22", 1, "x")], schema)
    out = secrets.redacted(docs)
    assert out.columns == docs.columns and sorted(str(r["text"]) for r in out.collect()) == ["", "None", "[secret]", "[secret]"]
    assert secrets.scanned(docs.limit(0)).count() == 0 and secrets.cut_off(secrets.scanned(docs.limit(0)).select(F.explode("tokens").alias("t")).select("t.p_written")) == secrets.MOST_STEPS + 1
