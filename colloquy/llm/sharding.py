"""A uniform shuffle into shards of exact sizes, by a hypergeometric communication matrix.

A uniform random permutation cut into shards sends from block p to shard s a
number of rows that follows the multivariate hypergeometric law with the block
sizes as row sums and the shard sizes as column sums. So: draw that matrix,
permute each block on its own, send the first M[p][0] rows to shard 0, the next
M[p][1] to shard 1 and so on, and permute again within each shard. No task sees
all rows, shards come out at exactly their sizes, and any seed reruns alike.

Blocks are hash classes of the document, not physical partitions, so a block
computed anew after an executor is lost has the same rows. The matrix has
blocks x shards numbers; blocks grow by one for ``BLOCK_ROWS`` rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import kept, table

BLOCK_ROWS = 1_000_000
LEAST_BLOCKS = 256
#: Up to this many blocks the matrix is broadcast; beyond, it is joined.
BROADCAST_BLOCKS = 50_000


def communication_matrix(blocks: list[int], shards: list[int], seed: int) -> np.ndarray:
    """Row counts from each block to each shard: row sums ``blocks``, column sums ``shards``."""
    rng, left = np.random.default_rng(seed), np.array(shards, dtype=np.int64)
    out = np.zeros((len(blocks), len(shards)), dtype=np.int64)
    for i, n in enumerate(blocks):
        out[i] = _draw(rng, left, n)
        left -= out[i]
    return out


def _draw(rng: np.random.Generator, left: np.ndarray, n: int) -> np.ndarray:
    """n balls from urns of ``left`` balls, urn by urn, each by a hypergeometric draw of bounded arguments."""
    total, got = int(left.sum()), np.zeros(len(left), dtype=np.int64)
    for j, k in enumerate(left[:-1]):
        if n == 0:
            return got
        k, rest = int(k), total - int(k)
        if total < 1_000_000_000:
            got[j] = rng.hypergeometric(k, rest, n) if k and rest else (n if not rest else 0)
        else:  # beyond the generator's range
            got[j] = _large(rng, k, rest, n)
        n, total = n - int(got[j]), rest
    got[-1] += n
    return got


def _large(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """A hypergeometric draw from large urns: the inverse of the CDF, summed from the mode outwards over twelve standard deviations."""
    if n == 0 or good == 0:
        return 0
    low, high = max(0, n - bad), min(n, good)
    mode = min(high, max(low, ((n + 1) * (good + 1)) // (good + bad + 2)))
    u, up, down, x, y = rng.random(), 1.0, 1.0, mode, mode
    ratio = lambda v: (good - v) * (n - v) / ((v + 1) * (bad - n + v + 1))  # noqa: E731  P(v + 1) / P(v)
    sd = max(1.0, (n * good / (good + bad) * bad / (good + bad)) ** 0.5)
    reach = int(12 * sd) + 30
    values, mass = [mode], [1.0]
    for _ in range(reach):
        if x < high:
            up *= ratio(x)
            x += 1
            values.append(x)
            mass.append(up)
        if y > low:
            y -= 1
            down /= ratio(y)
            values.append(y)
            mass.append(down)
    order = np.argsort(values)
    cdf = np.cumsum(np.array(mass)[order])
    return int(np.array(values)[order][min(len(values) - 1, int(np.searchsorted(cdf, u * cdf[-1])))])


def shard_sizes(rows: int, shards: int) -> list[int]:
    """As even as can be; the first shards take the remainder."""
    return [rows // shards + (i < rows % shards) for i in range(shards)]


def sharded(docs: DataFrame, shards: int = 40, seed: int = 29) -> DataFrame:
    """``docs`` with ``shard`` and a gapless ``slot`` from 0 in each shard, as a seeded uniform shuffle.

    ``docs`` has doc_id and, to tell repeated ids apart, text_crc32 and size.
    Rows alike in all three are interchangeable. A null id is a key like any
    other; an empty table gives an empty one. Columns named shard or slot are
    replaced. Rows alike in all three go to one block.
    """
    docs = docs.drop("shard", "slot")
    ident = [F.col("doc_id"), F.col("text_crc32"), F.col("size")]
    rows = kept(docs.withColumn("_h", F.xxhash64(F.lit(seed), *ident)), "shard-rows")
    blocks_wanted = max(LEAST_BLOCKS, -(-rows.count() // BLOCK_ROWS))
    block = F.pmod(F.xxhash64(F.lit(seed + 1), *ident), F.lit(blocks_wanted)).cast("int")
    counts = dict(rows.groupBy(block.alias("block")).count().collect())  # one number a block
    blocks = [counts.get(i, 0) for i in range(blocks_wanted)]
    matrix = communication_matrix(blocks, shard_sizes(sum(blocks), shards), seed)
    plan = docs.sparkSession.createDataFrame(
        [(i, [int(x) for x in np.cumsum(m)]) for i, m in enumerate(matrix)], "_block int, _until array<long>")

    permuted = rows.withColumn("_block", block).withColumn("_at", F.row_number().over(Window.partitionBy("_block").orderBy("_h", *ident)))
    sent = permuted.join(F.broadcast(plan) if blocks_wanted <= BROADCAST_BLOCKS else plan, "_block")
    shard = F.size(F.filter("_until", lambda x: x < F.col("_at"))).cast("int")
    second = F.xxhash64(F.lit(seed + 2), *ident)
    sent = sent.withColumn("shard", shard).withColumn("_h", second)
    # Second permutation: in the order of _h. Its leading bits cut each shard into runs, so that a shard is not one task.
    runs = max(1, -(-sum(blocks) // (shards * BLOCK_ROWS // 4)))
    run = F.floor((F.col("_h") / 2.0**64 + 0.5) * runs).cast("int")
    sent = kept(sent.withColumn("_run", F.least(run, F.lit(runs - 1))).drop("_until", "_at", "_block"), "shard-sent")
    before = Window.partitionBy("shard").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    starts = sent.groupBy("shard", "_run").count().select("shard", "_run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    local = F.row_number().over(Window.partitionBy("shard", "_run").orderBy("_h", *ident))
    out = sent.withColumn("_local", local).join(F.broadcast(starts), ["shard", "_run"])
    return out.withColumn("slot", (F.col("_start") + F.col("_local") - 1).cast("long")).drop("_h", "_run", "_local", "_start")


def op5_uniform_shards(spark, sf_dir: str) -> DataFrame:
    """Every document's shard and slot among 40; law rows."""
    text = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    return sharded(docs).select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
