"""Recall: memories ranked by similarity, within a neighbourhood, or fused with the graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import neighbourhood

#: Queries and memories that a task holds against each other, at most about.
QUERY_CHUNK = 2000
MEMORY_BLOCK = 20_000
#: Pairs that are scored at once in a task.
STEP_PAIRS = 1 << 22
#: A score's rounding to six digits is taken for certain further than this from a tie.
DOUBT = 1e-9


def _total(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)


def square(v: Column) -> Column:
    """A vector's squared length."""
    return _total(F.transform(v, lambda x: x.cast("double") * x))


def cosine(a: Column, b: Column, a2: Column, b2: Column) -> Column:
    """Similarity of two vectors whose squared lengths are ``a2`` and ``b2``."""
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y)) / F.sqrt(a2 * b2)


def _scored(queries: DataFrame, memories: DataFrame, region: bool) -> DataFrame:
    """Every query against every memory, pair by pair. Lengths are computed once a vector."""
    q = queries.select(F.col("memory_id").alias("query"), F.col("embedding").alias("_q"), square(F.col("embedding")).alias("_q2"), F.col("region").alias("_region"))
    memories = memories.withColumn("_m2", square(F.col("embedding")))
    near = (F.col("_region") == F.col("region")) if region else F.lit(True)
    rows = memories.join(q, near & (F.col("query") != F.col("memory_id")))
    return rows.select("query", "memory_id", F.round(cosine(F.col("_q"), F.col("embedding"), F.col("_q2"), F.col("_m2")), 6).alias("score"))


def best_of_block(query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, memories: np.ndarray, k: int):
    """Yields (query, memory_id, lowest, highest) arrays: all pairs that can be among a query's k best, with the bounds of their rounded score.

    Bounds are millionths and mostly equal. A pair is left out only if k others
    surely come before it, by score or, at equal scores, by memory_id.
    """
    order = np.argsort(ids)
    ids, memories = ids[order], memories[order]
    norms = np.sqrt((memories * memories).sum(axis=1))
    step = max(1, STEP_PAIRS // len(ids))
    for lo in range(0, len(query_ids), step):
        q = queries[lo : lo + step]
        scores = q @ memories.T / (np.sqrt((q * q).sum(axis=1))[:, None] * norms)
        scores[query_ids[lo : lo + step, None] == ids] = -np.inf
        bound = np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(q), -2.0)
        bound = np.maximum(bound, -2.0)
        row, column = np.nonzero(scores >= bound[:, None] - 2e-6)
        score = scores[row, column]
        low, high = (np.floor((score + d) * 1e6 + 0.5).astype(np.int64) for d in (-DOUBT, DOUBT))
        least = np.floor((bound - DOUBT) * 1e6 + 0.5).astype(np.int64)[row]
        # of those at the k-th score the first by id
        at = low == least
        count = np.cumsum(at)
        start = np.searchsorted(row, row)
        nth = count - (count - at)[start]
        kept = (high > least) | ((low < high) & (high == least)) | (at & (nth <= k))
        yield query_ids[lo + row[kept]], ids[column[kept]], low[kept], high[kept]


def _candidates(queries: DataFrame, memories: DataFrame, k: int, region: bool, chunks: int, blocks: int) -> DataFrame:
    """(query, memory_id): a few pairs more than the k best of each query, by products of matrices over (chunk of queries, block of memories)."""
    keys = ["_block", "_chunk", *(["region"] if region else [])]
    part = lambda n: F.pmod(F.xxhash64("memory_id"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    columns = ["memory_id", "embedding", *(["region"] if region else [])]
    left = queries.select(*columns, part(chunks).alias("_chunk"), every(blocks).alias("_block"))
    right = memories.select(*columns, part(blocks).alias("_block"), every(chunks).alias("_chunk"))

    def run(q: pa.Table, m: pa.Table) -> pa.Table:
        names = ["query", "memory_id", "low", "high"]
        if not (q.num_rows and m.num_rows):
            return pa.table({n: pa.array([], pa.int64()) for n in names})
        flat = lambda t: np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in t.column("embedding").chunks]).astype(np.float64).reshape(t.num_rows, -1)
        ids = lambda t: t.column("memory_id").to_numpy()
        out = zip(*best_of_block(ids(q), flat(q), ids(m), flat(m), k), strict=True)
        return pa.table({n: pa.array(np.concatenate(x), pa.int64()) for n, x in zip(names, out, strict=True)})

    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(run, "query long, memory_id long, low long, high long")
    w = Window.partitionBy("query").orderBy(F.desc("low"), "memory_id")
    found = found.withColumn("_n", F.row_number().over(w))
    # the least of the first k
    found = found.withColumn("_least", F.min(F.when(F.col("_n") <= k, F.col("low"))).over(Window.partitionBy("query")))
    return found.where((F.col("_n") <= k) | ((F.col("low") < F.col("high")) & (F.col("high") >= F.col("_least")))).select("query", "memory_id")


def _scored_pairs(pairs: DataFrame, queries: DataFrame, memories: DataFrame) -> DataFrame:
    """The similarity of given pairs (query, memory_id, more)."""
    q = queries.select(F.col("memory_id").alias("query"), F.col("embedding").alias("_q"), square(F.col("embedding")).alias("_q2"))
    m = memories.select("memory_id", F.col("embedding").alias("_m"), square(F.col("embedding")).alias("_m2"))
    rows = pairs.where("query <> memory_id").join(q, "query").join(m, "memory_id")
    return rows.withColumn("score", F.round(cosine(F.col("_q"), F.col("_m"), F.col("_q2"), F.col("_m2")), 6)).drop("_q", "_m", "_q2", "_m2")


def top(scored: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query").orderBy(F.desc("score"), "memory_id")
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def recall_vector(queries: DataFrame, memories: DataFrame, k: int, region: bool = False) -> DataFrame:
    """The k most similar memories of each query, itself left out; of the query's region only, if asked.

    Products of matrices find the pairs that may be among the best, and these
    are scored one by one. Vectors that are null, hold null or no finite number,
    have no length or another number of components than most are scored against
    all others one by one.
    """
    size = memories.agg(F.mode(F.size("embedding"))).first()[0]
    length = square(F.col("embedding"))
    plain = F.coalesce((F.size("embedding") == F.lit(size)) & (length > 0) & (length < float("inf")), F.lit(False))  # NaN is above infinity
    counts = lambda df: df.agg(F.count("*"), F.count_if(~plain)).first()
    (n, odd), (asked, odd_asked) = counts(memories), counts(queries)
    chunks, blocks = max(1, -(-asked // QUERY_CHUNK)), max(1, -(-n // MEMORY_BLOCK))
    # at least as many groups as there are tasks at a time
    blocks = max(blocks, min(-(-queries.sparkSession.sparkContext.defaultParallelism // chunks), -(-n // 1000), blocks * 64))
    pairs = _candidates(queries.where(plain), memories.where(plain), k, region, chunks, blocks)
    scored = _scored_pairs(pairs, queries, memories).select("query", "memory_id", "score")
    if odd:
        scored = scored.unionByName(_scored(queries.where(plain), memories.where(~plain), region))
    if odd_asked:
        scored = scored.unionByName(_scored(queries.where(~plain), memories, region))
    return top(scored, k)


def recall_anchored(queries: DataFrame, memories: DataFrame, edges: DataFrame, k: int, hops: int = 2) -> DataFrame:
    """As recall_vector(), among memories at most ``hops`` steps from the query's own node."""
    near = neighbourhood(edges, queries.select(F.col("memory_id").alias("query"), F.col("memory_id").alias("node")), hops).select("query", F.col("node").alias("memory_id"))
    return top(_scored_pairs(near, queries, memories).select("query", "memory_id", "score"), k)


def recall_fused(queries: DataFrame, memories: DataFrame, edges: DataFrame, k: int, rounds: int = 10, damping: float = 0.85, alpha: float = 0.7, cap: int = 100_000, hops: int = 2, tolerance: float = 1e-6) -> DataFrame:
    """Similarity and personalised PageRank in one ranking.

    Seeds are a query's 2k most similar memories, weighted by similarity. Rank
    flows along edges either way within ``hops`` of the seeds. Score is alpha *
    cosine + (1 - alpha) * rank / largest rank. graph_censored tells that a
    frontier exceeded ``cap``; termination_reason is term_cond if the last round
    changed less than ``tolerance``, else max_hops.
    """
    seeds = recall_vector(queries, memories, 2 * k).withColumn("w", F.greatest("score", F.lit(0.0)))
    seeds = seeds.withColumn("w", F.col("w") / F.sum("w").over(Window.partitionBy("query"))).select("query", F.col("memory_id").alias("node"), "w").checkpoint()
    area = neighbourhood(edges, seeds.select("query", "node"), hops, cap)
    nodes = area.select("query", "node").distinct()
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    local = nodes.join(both, F.col("node") == F.col("src")).join(nodes.select("query", F.col("node").alias("dst")), ["query", "dst"]).select("query", "src", "dst")
    local = local.withColumn("degree", F.count("*").over(Window.partitionBy("query", "src"))).checkpoint()
    rank = nodes.join(seeds, ["query", "node"], "left").select("query", "node", F.coalesce("w", F.lit(0.0)).alias("w"))
    rank = rank.withColumn("r", F.col("w")).checkpoint()
    change = None
    for _ in range(rounds):
        sent = rank.join(local, (rank["query"] == local["query"]) & (rank["node"] == local["src"])).groupBy(rank["query"], F.col("dst").alias("node")).agg(F.sum(F.col("r") / F.col("degree")).alias("got"))
        new = rank.join(sent, ["query", "node"], "left").select("query", "node", "w", ((1 - damping) * F.col("w") + damping * F.coalesce("got", F.lit(0.0))).alias("r"), F.col("r").alias("old")).checkpoint()
        change = new.groupBy("query").agg(F.sum(F.abs(F.col("r") - F.col("old"))).alias("change")).checkpoint()
        rank = new.drop("old")
        if change.where(F.col("change") >= tolerance).isEmpty():
            break
    rank = rank.withColumn("r", F.col("r") / F.greatest(F.max("r").over(Window.partitionBy("query")), F.lit(1e-300)))
    flags = area.groupBy("query").agg(F.bool_or("censored").alias("graph_censored"))
    done = change.select("query", F.when(F.col("change") < tolerance, "term_cond").otherwise("max_hops").alias("termination_reason"))
    pairs = _scored_pairs(rank.select("query", F.col("node").alias("memory_id"), "r"), queries, memories)
    fused = pairs.select("query", "memory_id", F.round(alpha * F.col("score") + (1 - alpha) * F.col("r"), 6).alias("score"))
    return top(fused, k).join(flags, "query").join(done, "query")
