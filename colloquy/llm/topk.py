"""Exact top-k inner-product search over norm-sorted vectors.

Vectors are range-partitioned by descending length into blocks. All vectors are
rotated into the eigenbasis of their second-moment matrix (the right singular
vectors), so that leading coordinates carry most of every product. A query
first meets the block of the longest vectors, which yields a lower bound of its
k-th best score. Against each further block it is dropped at once if

    |q| * (longest vector of the block) < bound,

and within a block a candidate is dropped if, after the first 16, half or all
of the rotated coordinates, its partial product plus the Cauchy-Schwarz bound
of the rest,

    <q', x'> + |q''| * |x''|,

is below the bound. What survives is scored exactly on the integers.

Queries and blocks meet as chunks keyed by (block, query chunk): both sides
have a bounded number of rows. After the first block queries are put into chunks
by the length that a candidate needs to reach their bound, so that a chunk's
queries part with short blocks together; a block is sent to those chunks only of
which some query may still want it, and a query to those blocks that it may want.
What passes the driver is one dim x dim matrix.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, table

#: Vectors of a block, and queries of a chunk.
BLOCK_ROWS = 4096
CHUNK_ROWS = 4096
#: Vectors scored at once inside a block, and leading rotated coordinates.
STEP_ROWS = 512
HEAD = 16


def usable(vector: Column) -> Column:
    """A vector that is not null and has no null or non-finite component."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(False))


def scaled(vector: Column, scale: int) -> Column:
    """floor(scale * x) of each component; beyond the range of a long, its nearest end."""
    edge = 2.0**62
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * scale, F.lit(-edge)), F.lit(edge))).cast("long"))


def _matrix(rows: pd.Series) -> np.ndarray:
    return np.stack(rows.to_numpy()).astype(np.int64)


def rotation(vectors: DataFrame, dim: int) -> np.ndarray:
    """Right singular vectors of all ``vectors`` (column v), from a sum of per-partition second moments."""
    def moments(batches):
        total = np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = _matrix(pdf["v"]).astype(np.float64)
                total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dim), "row": list(total)})

    if not dim:
        return np.zeros((0, 0))
    rows = vectors.select("v").mapInPandas(moments, "i int, row array<double>")
    sums = rows.groupBy("i").agg(*[F.sum(F.element_at("row", j + 1)).alias(f"c{j}") for j in range(dim)])
    gram = np.zeros((dim, dim))
    for r in sums.collect():  # dim x dim numbers
        gram[r[0]] = r[1:]
    return np.linalg.eigh(gram)[1][:, ::-1].copy()


def _products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Exact products of rows i of q and x; beyond a long, its nearest end."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(x).max(initial=0)) * q.shape[-1]
    if most < 2.0**62:
        return np.einsum("ij,ij->i", q, x)
    wide = (q.astype(object) * x.astype(object)).sum(axis=1)
    return np.array([min(max(int(v), -(2**63)), 2**63 - 1) for v in wide], dtype=np.int64)


def block_top(queries: pd.DataFrame, block: pd.DataFrame, basis: np.ndarray, k: int) -> pd.DataFrame:
    """The k best of one block for each query, less those below the query's bound."""
    q, x = _matrix(queries["v"]), _matrix(block["v"])
    ids, xid = queries["vec_id"].to_numpy(), block["vec_id"].to_numpy()
    qr, xr = q @ basis, x @ basis
    qn, xn = np.linalg.norm(qr, axis=1), np.linalg.norm(xr, axis=1)
    order = np.lexsort((xid, -xn))
    x, xr, xn, xid = x[order], xr[order], xn[order], xid[order]
    stages = sorted({min(HEAD, q.shape[1]), q.shape[1] // 2, q.shape[1]})
    rest = [[np.sqrt((a[:, d:] ** 2).sum(axis=1)) for d in stages] for a in (qr, xr)]
    bound = queries["bound"].to_numpy(np.float64).copy()
    best = np.full((len(q), k), -np.inf)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for lo in range(0, len(x), STEP_ROWS):
        hi = min(lo + STEP_ROWS, len(x))
        slack = 1e-9 * (1 + qn * xn[lo])  # of floating-point sums; it only lets more through
        live = np.flatnonzero(qn * xn[lo] + slack >= bound)
        if not len(live):
            continue
        cols, part, done = np.arange(lo, hi), np.zeros((len(live), hi - lo)), 0
        for j, d in enumerate(stages):
            part += qr[live, done:d] @ xr[cols, done:d].T
            done = d
            most = part + np.outer(rest[0][j][live], rest[1][j][cols]) if d < q.shape[1] else part
            alive = most >= (bound[live] - slack[live])[:, None]
            if d < q.shape[1]:  # queries and candidates with nothing left leave
                rows_left, cols_left = alive.any(axis=1), alive.any(axis=0)
                live, cols, part = live[rows_left], cols[cols_left], part[np.ix_(rows_left, cols_left)]
        a, b = np.nonzero(alive)
        a, b = live[a], cols[b]
        other = ids[a] != xid[b]
        a, b = a[other], b[other]
        score = np.empty(len(a), np.int64)
        for s in range(0, len(a), 1 << 18):
            score[s : s + (1 << 18)] = _products(q[a[s : s + (1 << 18)]], x[b[s : s + (1 << 18)]])
        hit = score >= bound[a]
        a, b, score = a[hit], b[hit], score[hit]
        out.append((a, b, score))
        # raise the bounds: k best so far and the new ones, padded to a matrix
        if len(a):
            count = np.bincount(a, minlength=len(q))
            rows = np.flatnonzero(count)
            new = np.full((len(rows), int(count.max())), -np.inf)
            place = np.arange(len(a)) - np.repeat(np.cumsum(count[rows]) - count[rows], count[rows])
            new[np.repeat(np.arange(len(rows)), count[rows]), place] = score
            both = np.concatenate([best[rows], new], axis=1)
            best[rows] = -np.partition(-both, k - 1, axis=1)[:, :k]
            bound[rows] = np.maximum(bound[rows], best[rows].min(axis=1))
    if not out:
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
    a, b, score = (np.concatenate(x) for x in zip(*out, strict=True))
    hit = score >= bound[a]
    a, b, score = a[hit], b[hit], score[hit]
    order = np.lexsort((xid[b], -score, a))
    a, b, score = a[order], b[order], score[order]
    first = np.searchsorted(a, a)
    hit = np.arange(len(a)) - first < k
    return pd.DataFrame({"query_id": ids[a[hit]], "vec_id": xid[b[hit]], "score": score[hit]})


def _top(rows: DataFrame, k: int) -> DataFrame:
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return rows.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= k)


def top_products(vectors: DataFrame, is_query: Column, k: int = 20, scale: int = 64) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k largest inner products.

    ``vectors`` has vec_id and embedding; components become floor(scale * x).
    Vectors (or ids) that are null, or vectors with null or non-finite
    components, take no part; vectors of different lengths don't meet, and an
    empty vector scores 0 with other empty ones. Repeated rows are candidates
    each; a query is one per id, of its smallest vector, and never meets its own
    id. Ties go to the smaller vec_id. An empty table gives an empty result.
    """
    rows = vectors.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long").alias("vec_id"), scaled(F.col("embedding"), scale).alias("v"), is_query.alias("is_query"))
    rows = kept(rows.withColumn("dim", F.size("v")), "topk-vectors")
    found = None
    for dim in [r[0] for r in rows.select("dim").distinct().collect()]:  # the lengths that occur, as a rule one
        one = _top_products(rows.where(F.col("dim") == dim), dim, k)
        found = one if found is None else found.unionByName(one)
    if found is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _top_products(rows: DataFrame, dim: int, k: int) -> DataFrame:
    n, queries = rows.agg(F.count("*"), F.count_if("is_query")).first()
    basis = rotation(rows, dim)
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x))
    blocks, chunks = max(1, -(-n // BLOCK_ROWS)), max(1, -(-queries // CHUNK_ROWS))
    sorted_rows = rows.withColumn("length", length).repartitionByRange(blocks, F.desc("length"), "vec_id", F.xxhash64("v"))
    cand = kept(sorted_rows.select("vec_id", "v", "length", F.spark_partition_id().alias("block")), "topk-blocks")
    longest = cand.groupBy("block").agg(F.max("length").alias("longest"))
    first = longest.agg(F.min("block")).first()[0]
    q = rows.where("is_query").groupBy("vec_id").agg(F.min("v").alias("v")).withColumn("length", length)
    q = q.withColumn("chunk", F.pmod(F.xxhash64("vec_id"), F.lit(chunks)).cast("int"))
    q = kept(q, "topk-queries")

    schema = "query_id long, vec_id long, score long"
    width = max(dim, 1)

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        return block_top(left, right, basis, k)

    def against(queries_: DataFrame, cand_: DataFrame) -> DataFrame:
        return queries_.groupBy("block", "chunk").cogroup(cand_.groupBy("block", "chunk")).applyInPandas(meet, schema)

    every = F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk")  # one block
    head = against(q.withColumn("block", F.lit(first)).withColumn("bound", F.lit(-np.inf)), cand.where(F.col("block") == first).select("*", every))
    head = kept(head, f"topk-head-{width}")
    bounds = head.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score")).alias("bound"))
    q = q.join(bounds, q["vec_id"] == bounds["query_id"], "left").drop("query_id").withColumn("bound", F.coalesce(F.col("bound").cast("double"), F.lit(-np.inf)))
    needed = F.when(F.col("length") > 0, F.col("bound") / F.col("length")).when(F.col("bound") > 0, F.lit(np.inf)).otherwise(F.lit(-np.inf))
    q = q.drop("chunk").withColumn("needed", needed).repartitionByRange(chunks, "needed", "vec_id").withColumn("chunk", F.spark_partition_id())
    q = kept(q, "topk-bounded")
    pairs = q.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).where(F.col("block") != first)
    # by their statistics queries look no more than they were before each was put to every block, so which side is broadcast is said here: a row a block
    pairs = pairs.join(F.broadcast(longest), "block").where(F.col("length") * F.col("longest") * (1 + 1e-9) + 1e-9 >= F.col("bound"))
    live = kept(pairs.select("block", "chunk").distinct().groupBy("block").agg(F.collect_list("chunk").alias("chunks")), "topk-live")
    rest = against(pairs.select("vec_id", "v", "chunk", "block", "bound"), cand.join(F.broadcast(live), "block").select("vec_id", "v", "length", "block", F.explode("chunks").alias("chunk")))
    return _top(head.unionByName(rest), k)


def op1_exact_top_products(spark, sf_dir: str) -> DataFrame:
    """The 20 best partners of every vector whose id is divisible by 20, among all vectors."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


#: The same by brute force.
OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INT AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 20
"""
