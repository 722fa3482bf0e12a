"""Small helpers that the training-data operators share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.io import shared_dir

#: Words are maximal runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def kept(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read back: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """From now on the session sends at most ``rows`` rows to a Python worker at once: they hold whole texts, on both sides."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, rows)


def word_count(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def parallelism(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def ranked(df: DataFrame, order: list[Column], name: str, rank: str = "rank") -> DataFrame:
    """``df`` with a gapless global ``rank`` from 0 in ``order``, without a single-task sort.

    Rows are range-partitioned, numbered within their range, and shifted by the
    number of rows in earlier ranges (one count per range, so a bounded table).
    """
    from pyspark.sql import Window

    n = parallelism(df.sparkSession)
    parts = df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id())
    parts = kept(parts, name)
    local = parts.withColumn("_local", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_offset"))
    return local.join(F.broadcast(offsets), "_part").withColumn(rank, (F.col("_offset") + F.col("_local") - 1).cast("long")).drop("_part", "_local", "_offset")


def window(text: Column, key: Column, chars: int) -> Column:
    """A stretch of ``chars`` code points of longer texts, at a place given by a hash of ``key``; shorter ones whole."""
    start = F.pmod(F.xxhash64(F.lit(19), key), F.greatest(F.length(text) - chars + 1, F.lit(1))) + 1
    return F.when(F.length(text) <= chars, text).otherwise(F.substring(text, start.cast("int"), F.lit(chars)))
