"""The corpus pipeline: from raw documents to token ids.

Each stage takes (spark, docs, sf_dir), works on all its predecessor kept, and
returns documents with their columns (the last: token ids). run() writes each
stage's result to the shared folder and reads it back for the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colloquy.llm.bpe import digest, round_trip
from colloquy.llm.common import kept, table
from colloquy.llm.jaccard import one_of_each
from colloquy.llm.mixing import repeated
from colloquy.llm.secrets import redacted
from colloquy.llm.toxicity import without_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that don't score as toxic; the machine learns from the labelled ones."""
    return without_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near duplicates."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in their texts replaced by a mark."""
    return redacted(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them."""
    return repeated(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their ids, how many, and digests of the ids and of what they decode to."""
    from pyspark.sql import functions as F

    rows = round_trip(docs.select("doc_id", "source", "lang", "text"))
    return rows.select("doc_id", "source", "lang", "ids", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", toxicity),
    ("near_duplicates", near_duplicates),
    ("secrets", secrets),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: The first stage is a trained machine, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = kept(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
