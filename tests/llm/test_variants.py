"""Spelling variants against all pairs that differ by one letter."""

import os
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import variants

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[i:] == b[i + 1 :] if len(a) < len(b) else a[i + 1 :] == b[i + 1 :]


def brute(count):
    """{word: (form, root, n, n_near, form_n)} of {word: n}, by wildcards and deletions."""
    held, near = {}, {w: set() for w in count}
    for w in count:
        for k in range(len(w)):
            held.setdefault((k, w[:k], w[k + 1 :]), []).append(w)
            if w[:k] + w[k + 1 :] in count:
                near[w].add(w[:k] + w[k + 1 :])
                near[w[:k] + w[k + 1 :]].add(w)
    for group in held.values():
        for w in group:
            near[w].update(x for x in group if x != w)
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-count[x], x), default=None)
        form[w] = best if best is not None and count[best] >= 5 * count[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (form[w], root(w), n, len(near[w]), count[form[w]] if form[w] is not None else None) for w, n in count.items()}


def runs_of(rows):
    out = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            out[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 199 == 0 else run] += 1
    return {w: n for w, n in out.items() if len(w) >= 6 and n >= 5}


def answers(df):
    return {r.word: (r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect()}


@pytest.mark.parametrize(("block", "batch", "leaf"), [(4096, 4096, 32), (3, 5, 1)])
def test_variants_equal_all_pairs(spark, monkeypatch, block, batch, leaf):
    for name, value in (("BLOCK", block), ("BATCH", batch), ("LEAF", leaf)):
        monkeypatch.setattr(variants, name, value)
    rng = random.Random(block)
    count = {"".join(rng.choice("eeniàßÿt") for _ in range(rng.randint(6, 8))): rng.choice([5, 5, 7, 30, 200, 1500]) for _ in range(400)}
    count |= {"e" * k: 6**k % 1013 + 5 for k in range(6, 14)} | {"x" * 3000: 5, "x" * 2999 + "y": 40, "x" * 2999: 40}  # counts beyond a key's top, long words, ties
    assert sum(one_edit(a, b) for a in count for b in count) == sum(x[3] for x in brute(count).values())
    words = spark.createDataFrame(list(count.items()), "word string, n long").repartition(5).withColumn("key", F.lit("x")).withColumn("block", F.lit(9))
    assert answers(variants.spelling_variants(words)) == brute(count)


def test_chains_nulls_repeats_and_no_words(spark):
    rows = [("abcdef", 5), ("abcdeg", 10), ("abcdeg", 15), ("abcdgg", 125), ("abcggg", 625), ("abgggg", 3125), (None, 7)]
    got = answers(variants.spelling_variants(spark.createDataFrame(rows, "word string, n long")))
    assert got["abcdef"] == ("abcdeg", "abgggg", 5, 1, 25) and got["abgggg"] == (None, "abgggg", 3125, 1, None) and len(got) == 5
    assert variants.spelling_variants(spark.createDataFrame([], "word string, n long")).collect() == []


def test_runs_lose_a_letter_where_the_hash_says_so(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdé×Ü") for _ in range(rng.randint(1, 12))) for _ in range(300)]
    rows = [(i if i % 10 else None, " ".join(rng.choices(words, k=200)).title()) for i in range(60)] + [(7, None), (8, ""), (9, "Zołąę abcdefĀghijkl " * 5), (10, "longest" * 3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("word", F.lit(1)).withColumn("id", F.lit(2)).withColumn("n", F.lit(3))
    assert {r.word: r.n for r in variants.vocabulary(variants.noisy_runs(docs)).collect()} == runs_of(rows)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert answers(variants.op11_spelling_variants(spark, SF)) == brute(runs_of(rows))
