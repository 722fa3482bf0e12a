"""Running values of long keys in many tasks: a segmented scan.

Rows are laid out by range of (keys, order) and cut into slices, so that a key
with many rows spans several slices and many small keys share one. Each slice
runs by itself; what a slice does to a running value (a sum, a last or a first
value) is one row, and a prefix over these few rows is carried into the slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.sources.io import checkpoints


def sliced(df: DataFrame, keys: list[str], order: list[str], slices: int | None = None) -> DataFrame:
    """``df`` in range order with ``_slice``, checkpointed so that the slices stay as they are."""
    checkpoints(df.sparkSession)
    n = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()).checkpoint()


def running(df: DataFrame, keys: list[str], order: list[str], values: dict[str, tuple[str, Column]]) -> DataFrame:
    """``df`` of sliced() with more columns, each a running value of its key in ``order``.

    A value is ("sum", c) up to a row, ("last", c) the last that isn't null up to
    it, ("before", c) before it, ("next", c) the first after it.
    """
    here, across = Window.partitionBy("_slice", *keys).orderBy(*order), Window.partitionBy(*keys).orderBy("_slice")
    # what comes after is what came before in reverse order: a frame that ends at the partition's end is computed anew for every row
    back, across_back = Window.partitionBy("_slice", *keys).orderBy(*map(F.desc, order)), Window.partitionBy(*keys).orderBy(F.desc("_slice"))
    start = Window.unboundedPreceding
    place = F.struct(*order)
    some = lambda c: F.when(c.isNotNull(), place)
    local, total, carry = {}, [], []
    for name, (kind, c) in values.items():
        held, brought = f"_t_{name}", f"_c_{name}"
        if kind == "sum":
            local[name] = F.sum(c).over(here.rowsBetween(start, 0))
            total.append(F.sum(c).alias(held))
            carry.append(F.sum(held).over(across.rowsBetween(start, -1)).alias(brought))
        elif kind == "next":
            local[name] = F.last(c, ignorenulls=True).over(back.rowsBetween(start, -1))
            total.append(F.min_by(c, some(c)).alias(held))
            carry.append(F.last(held, ignorenulls=True).over(across_back.rowsBetween(start, -1)).alias(brought))
        else:
            local[name] = F.last(c, ignorenulls=True).over(here.rowsBetween(start, 0 if kind == "last" else -1))
            total.append(F.max_by(c, some(c)).alias(held))
            carry.append(F.last(held, ignorenulls=True).over(across.rowsBetween(start, -1)).alias(brought))
    # a row a slice and key in it
    carried = df.groupBy("_slice", *keys).agg(*total).select("_slice", *keys, *carry)
    rows = df.withColumns(local).join(carried, ["_slice", *keys], "left")
    whole = {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)) if kind == "sum" else F.coalesce(n, f"_c_{n}") for n, (kind, _) in values.items()}
    return rows.withColumns(whole).drop(*(f"_c_{n}" for n in values))
