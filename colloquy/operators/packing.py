"""Greedy packing of keys with many items, without an array a key.

Where a pack that begins at an item ends follows from prefix sums: it holds all
items up to the last whose sum doesn't exceed the sum before the item by more
than the budget. These places are found by merging sums and bounds in one order
and counting; which items do begin a pack is found from the first by pointer
doubling, in as many rounds as the number of packs has binary digits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan


def greedy(items: DataFrame, most: int, keys: tuple[str, ...], slices: int | None = None) -> DataFrame:
    """``items`` (keys, pos, tok) with ``chunk`` from 0: a new one where the next item would exceed ``most``; a larger item stands alone.

    pos is unique in its key, tok is at least 0 and not null.
    """
    keys = list(keys)
    rows = scan.running(scan.sliced(items.select(*keys, "pos", "tok"), keys, ["pos"], slices), keys, ["pos"], {"i": ("sum", F.lit(1)), "p": ("sum", F.col("tok"))}).drop("_slice").checkpoint()
    sums = rows.select(*keys, F.col("p").alias("value"), F.lit(0).alias("asks"), "i")
    bounds = rows.select(*keys, (F.col("p") - F.col("tok") + most).alias("value"), F.lit(1).alias("asks"), "i")
    order = ["value", "asks", "i"]
    counted = scan.running(scan.sliced(sums.unionByName(bounds), keys, order, slices), keys, order, {"n": ("sum", 1 - F.col("asks"))})
    jump = counted.where("asks = 1").select(*keys, "i", (F.greatest("n", "i") + 1).alias("to"))
    jump = jump.join(rows.select(*keys, F.col("i").alias("to")), [*keys, "to"], "left_semi").select(*keys, "i", "to").checkpoint()
    begins = rows.where("i = 1").select(*keys, "i")
    while not jump.isEmpty():
        on = jump.select(*keys, F.col("i").alias("to"), F.col("to").alias("further"))
        begins = begins.unionByName(begins.join(jump, [*keys, "i"]).select(*keys, F.col("to").alias("i"))).checkpoint()
        jump = jump.join(on, [*keys, "to"]).select(*keys, "i", F.col("further").alias("to")).checkpoint()
    marked = rows.join(begins.withColumn("begins", F.lit(1)), [*keys, "i"], "left").select(*keys, "pos", "tok", F.coalesce("begins", F.lit(0)).alias("begins"))
    out = scan.running(scan.sliced(marked, keys, ["pos"], slices), keys, ["pos"], {"chunk": ("sum", F.col("begins"))})
    return out.select(*keys, "pos", "tok", (F.col("chunk") - 1).cast("int").alias("chunk"))
