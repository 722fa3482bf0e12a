"""Top-k search, source mixing and sharding against brute force, with nulls, ties, repeated rows, empty tables and clashing columns."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import mixing, sharding, topk

NAN, INF = float("nan"), float("inf")


def best_products(rows, k, scale):
    """{query id: [(rank, vec_id, score)]} of rows (vec_id, vector, is_query)."""
    good = [(i, [math.floor(scale * x) for x in v], q) for i, v, q in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    queries = {}
    for i, v, q in good:
        if q:
            queries.setdefault(len(v), {}).setdefault(i, []).append(v)
    out = {}
    for dim, mine in queries.items():
        for i, vs in mine.items():
            v = min(vs)
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w, _ in good if j != i and len(w) == dim)[:k]
            out.setdefault(i, []).extend((r + 1, j, -s) for r, (s, j) in enumerate(scores))
    return {i: sorted(x) for i, x in out.items()}


@pytest.mark.parametrize(("block", "chunk"), [(4096, 4096), (7, 3)])
def test_top_products_equal_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(block)
    rows = [(i, (rng.normal(size=6) * rng.exponential()).tolist(), i % 4 == 0) for i in range(90)]
    rows += [(200 + i, [0.25, 0.5, 0.0, 0.0, 0.0, 0.0], i == 0) for i in range(8)]  # ties
    rows += [(3, rows[3][1], False), (8, rows[8][1], True), (300, [0.0] * 6, True)]  # repeated rows, no length
    rows += [(None, [1.0] * 6, True), (400, None, True), (401, [1.0, None, 0.0, 0.0, 0.0, 0.0], True), (402, [NAN] * 6, True), (403, [INF] + [0.0] * 5, True)]
    rows += [(500, [1.0, 2.0], True), (501, [2.0, 1.0], False), (502, [], True), (503, [], False)]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>, q boolean").withColumn("rank", F.lit("x")).withColumn("score", F.lit(1))
    got = {}
    for r in topk.top_products(docs, F.col("q"), k=5).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert {i: sorted(x) for i, x in got.items()} == {i: x for i, x in best_products(rows, 5, 64).items() if x}


def test_top_products_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    out = topk.top_products(empty, F.col("vec_id") % 20 == 0)
    assert out.columns == ["query_id", "rank", "vec_id", "score"] and out.count() == 0


def levels(sizes, weights, most):
    """Targets by clamping one source after another: {source: target}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, clamped = sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in clamped]
        left = total - sum(clamped.values())
        target = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if target[s] > most * sizes[s]]
        if not over:
            return {**clamped, **target}
        clamped |= {s: most * sizes[s] for s in over}


def test_mixture_equals_water_filling(spark):
    rng = np.random.default_rng(2)
    sources = ["a"] * 5 + ["b"] * 300 + ["c"] * 40 + ["d", None, None] + [""] * 3
    rows = [(i, s, " ".join(["w"] * int(rng.integers(0, 60)))) for i, s in enumerate(sources)]
    rows += [(1, "a", "one two"), (1, "a", "one two"), (None, "b", "three  words\tmore"), (900, "b", None), (901, "e", None)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("target", F.lit("x"))
    out = mixing.mixture_report(docs.select("doc_id", "source", "text")).collect()
    again = mixing.mixture_report(docs.select("doc_id", "source", "text")).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    size = lambda t: len((t or "").split())
    totals = Counter()
    for _, s, t in rows:
        totals[s] += size(t)
    want = levels(dict(totals), (5, 2, 1), 3)
    taken, seen = Counter(), {}
    by = {}
    for i, s, t in rows:
        by.setdefault((i, size(t)), s)
    for r in out:
        s = by[r["doc_id"], r["size"]]
        assert r["source_size"] == totals[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        seen.setdefault(s, set()).add(r["repetitions"])
    largest = {s: max(size(t) for _, x, t in rows if x == s) for s in totals}
    assert all(abs(taken[s] - want[s]) <= max(3 * largest[s], 1) for s in totals)
    assert all(max(x) - min(x) <= 1 for x in seen.values())
    mixed = mixing.mixed(docs)
    assert mixed.count() == len(rows) and set(docs.columns) <= set(mixed.columns)
    repeated = mixing.repeated(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r["repetitions"] for r in out)


def test_mixture_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, source string, text string")
    assert mixing.mixture_report(empty).count() == 0 and mixing.repeated(empty).count() == 0
    blank = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id long, source string, text string")
    assert [(r["taken"], r["target"]) for r in mixing.mixture_report(blank).collect()] == [(0, 0.0)] * 2


def rows_of(spark, n, ids=None):
    return spark.createDataFrame([(i if ids is None else ids(i), 16 + i % 7, zlib.crc32(str(i % 50).encode())) for i in range(n)], "doc_id long, size long, text_crc32 long")


@pytest.mark.parametrize(("n", "shards", "block"), [(0, 5, 100), (3, 5, 100), (1003, 7, 100), (1003, 7, 1_000_000), (500, 1, 50)])
def test_shards_are_exact_and_slots_gapless(spark, monkeypatch, n, shards, block):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", block)
    docs = rows_of(spark, n).withColumn("shard", F.lit("x"))
    out = sharding.sharded(docs, shards, 3).collect()
    assert len(out) == n and sorted(r["doc_id"] for r in out) == list(range(n))
    slots = {}
    for r in out:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert [len(slots.get(s, [])) for s in range(shards)] == sharding.shard_sizes(n, shards)
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    again = sharding.sharded(docs.repartition(3), shards, 3).collect()
    assert {(r["doc_id"], r["shard"], r["slot"]) for r in out} == {(r["doc_id"], r["shard"], r["slot"]) for r in again}


def test_shards_of_nulls_and_repeated_rows(spark):
    docs = rows_of(spark, 400, lambda i: None if i % 2 else i % 8)
    out = sharding.sharded(docs, 6, 5).collect()
    assert len(out) == 400 and Counter(r["shard"] for r in out) == dict(enumerate(sharding.shard_sizes(400, 6)))


def test_the_matrix_has_its_sums_and_its_law():
    blocks, shards = [40, 0, 7, 120, 33], sharding.shard_sizes(200, 6)
    draws = np.array([sharding.communication_matrix(blocks, shards, seed) for seed in range(4000)])
    assert (draws.sum(axis=2) == blocks).all() and (draws.sum(axis=1) == shards).all() and (draws >= 0).all()
    total, k = sum(blocks), np.array(shards)
    for i, n in enumerate(blocks):  # each cell is hypergeometric
        mean, var = n * k / total, n * (k / total) * (1 - k / total) * (total - n) / (total - 1)
        assert np.abs(draws[:, i].mean(axis=0) - mean).max() < 5 * np.sqrt(var.max() / len(draws)) + 1e-9
        assert np.abs(draws[:, i].var(axis=0) - var).max() < 0.15 * max(var.max(), 1e-9) + 1e-9
    one = (draws[:, 0, 0], draws[:, 3, 1])
    cov = -40 * 120 * shards[0] * shards[1] / (total**2 * (total - 1)) * -1  # cells off each other's row and column
    assert np.cov(*one)[0, 1] == pytest.approx(cov, abs=0.35)


def test_large_draws_follow_the_law():
    rng = np.random.default_rng(1)
    good, bad, n = 3 * 10**9, 10**9, 1000
    got = np.array([sharding._large(rng, good, bad, n) for _ in range(2000)])
    assert got.mean() == pytest.approx(750, abs=5 * math.sqrt(187.5 / 2000)) and got.var() == pytest.approx(187.5, rel=0.12)
    assert sharding._large(rng, 0, bad, n) == 0 and sharding._large(rng, good, 0, 5) == 5


def test_every_document_reaches_every_shard_alike(spark):
    """The shard and the half of it that a row is in, over seeds."""
    docs = rows_of(spark, 60)
    where = Counter()
    for seed in range(40):
        where.update((r["shard"], r["slot"] // 10) for r in sharding.sharded(docs, 3, seed).where("doc_id = 5").collect())
    assert sum(where.values()) == 40 and max(where.values()) < 20 and len(where) >= 4


def test_queries_that_are_put_to_every_block_are_not_broadcast(spark):
    """By the statistics they look as small as before, whatever the number of blocks."""
    from colloquy.llm import topk

    rows = spark.range(20_000).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: (F.xxhash64("id", i) % 1000 / 1000).cast("float")).alias("embedding"))
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "20k")
    try:
        got = topk.top_products(rows, F.col("vec_id") % 2000 == 0, 3)
        plan = got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert plan.count("BroadcastHashJoin [block") == 2 and plan.count("Inner, BuildRight") == 2 and "BuildLeft" not in plan
    assert got.count() == 30
