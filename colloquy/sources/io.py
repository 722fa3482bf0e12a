"""Sources and sinks: call documents, consent, partitioned artifacts and an idempotent event table.

Schemas are declared, never inferred; paths are read and written by Spark alone.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from . import contracts as C
from . import validate

# File names of a call's documents and texts.
MANIFEST_FILE, STATUS_FILE, TRANSCRIPT_FILE, SUMMARY_FILE = "manifest.json", "status.json", "transcript.json", "summary.json"
MARKDOWN_FILE, TIMECODED_FILE = "summary.md", "transcript.timecoded.md"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's, or, where all run on one machine, a local one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return (path or "/tmp/checkpoints").rstrip("/")


def checkpoints(spark: SparkSession) -> None:
    """Checkpoints go to the shared folder, where the session has set no other."""
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))


def checked_documents(spark: SparkSession, path: str, contract: C.Contract, name: str | None = None) -> DataFrame:
    """(file, value, errors, d) of every document under ``path``: ``d`` is its typed struct, null if it has errors, which are empty otherwise.

    With ``name``, each file of that name in any folder is one document, and
    other files are left alone; without, each line of each file is one. ``file``
    is where a document was. An absent path is an empty table.
    """
    reader = spark.read.option("recursiveFileLookup", True)
    if name:
        reader = reader.option("pathGlobFilter", name)
    try:
        text = reader.text(path, wholetext=bool(name)).select(F.col("_metadata.file_path").alias("file"), "value")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = spark.createDataFrame([], "file string, value string")
    # inline() keeps what it gives from being worked out again wherever it is used, in filters above all
    once = lambda **columns: F.inline(F.array(F.struct(*(c.alias(n) for n, c in columns.items()))))
    marked = text.select("*", once(_v=F.try_parse_json("value"))).select("*", once(errors=document_errors(contract, F.col("_v"))))
    return marked.select("file", "value", "errors", F.when(F.col("errors") == "", C.parsed(contract, F.col("_v"))).alias("d"))


def scan_documents(spark: SparkSession, path: str, contract: C.Contract, name: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents of checked_documents() that keep the contract, as typed columns; file, value and errors of those that don't).

    Each of the two reads the files when it is used.
    """
    rows = checked_documents(spark, path, contract, name)
    return rows.where("errors = ''").select("d.*", "file"), rows.where("errors <> ''").select("file", "value", "errors")


def document_errors(contract: C.Contract, v: Column) -> Column:
    """Issues of a parsed document on one line, empty if it is valid; null is not JSON."""
    return F.when(v.isNull(), F.lit("$: not JSON")).otherwise(validate.format_issues(C.problems(contract, v)))


def scan_calls(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid manifests, rejected ones with errors)."""
    return scan_documents(spark, path, C.MANIFEST, None if lines else MANIFEST_FILE)


def scan_status(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid status documents, rejected ones with errors)."""
    return scan_documents(spark, path, C.STATUS, None if lines else STATUS_FILE)


def scan_transcripts(spark: SparkSession, path: str, lines: bool = False) -> tuple[DataFrame, DataFrame]:
    """(valid merged transcripts, rejected ones with errors)."""
    return scan_documents(spark, path, C.TRANSCRIPT, None if lines else TRANSCRIPT_FILE)


def scan_summaries(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid summaries with the call_id that their folder names, rejected ones with errors)."""
    good, bad = scan_documents(spark, path, C.SUMMARY, SUMMARY_FILE)
    return good.withColumn("call_id", F.element_at(F.split("file", "/"), -2)), bad


def consent_source(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, bool]:
    """(channels, opted-out users, whether all channels are allowed) of a small JSON file.

    A missing file denies everything; missing keys take their defaults; a
    malformed file, a key of the wrong kind or an empty id is an error.
    """
    try:
        text = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).limit(1).collect())
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        text = "{}"
    config = json.loads(text)
    if not isinstance(config, dict):
        raise ValueError("consent: not an object")
    every, channels, out = config.get("allowAllChannels", False), config.get("allowChannels", []), config.get("optOutMembers", [])
    if not isinstance(every, bool) or not all(isinstance(x, list) and all(isinstance(y, str) for y in x) for x in (channels, out)):
        raise ValueError("consent: a key has the wrong kind")
    if "" in channels or "" in out:
        raise ValueError("consent: an id is empty")
    return spark.createDataFrame([(c,) for c in channels], "channel_id string"), spark.createDataFrame([(u,) for u in out], "user_id string"), every


def write_call_artifacts(df: DataFrame, path: str, partition: str = "call_date") -> None:
    """Overwrites the partitions that ``df`` has, and no others."""
    df.write.partitionBy(partition).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def publish_artifacts(artifacts: DataFrame, path: str) -> str:
    """Publishes the artifacts (call_id, name, body) of some calls together; gives the version.

    A version is a folder of its own, and is shown from when its name is
    appended to the list of versions, which is done last: a reader before that
    sees each call's earlier artifacts whole. One writer a path.
    """
    spark, version = artifacts.sparkSession, uuid.uuid4().hex
    artifacts.select("call_id", "name", "body").write.parquet(f"{path}/data/version={version}")
    seq = 1 + (_versions(spark, path).agg(F.max("seq")).first()[0] or 0)
    spark.createDataFrame([(version, seq)], VERSIONS).coalesce(1).write.mode("append").parquet(f"{path}/versions")
    return version


VERSIONS = "version string, seq bigint"


def _versions(spark: SparkSession, path: str) -> DataFrame:
    try:
        return spark.read.schema(VERSIONS).parquet(f"{path}/versions")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], VERSIONS)


def published_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """(call_id, name, body): of each call all artifacts of the newest version that has it, and none of other versions."""
    try:
        data = spark.read.schema("call_id string, name string, body string, version string").parquet(f"{path}/data")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], "call_id string, name string, body string")
    shown = data.join(_versions(spark, path), "version")
    newest = shown.groupBy("call_id").agg(F.max("seq").alias("seq"))
    return shown.join(newest, ["call_id", "seq"]).select("call_id", "name", "body")


def sink_events_idempotent(events: DataFrame, path: str, order: list[str], key: str = "event_key", within: str | None = None) -> None:
    """Appends the events whose key the table at ``path`` lacks, the first of each; running it again adds nothing.

    ``within`` names a column that is the same in every delivery of a key, such
    as its day: the table is partitioned by it, and only the partitions that
    ``events`` touch are looked into. One writer a table.
    """
    spark = events.sparkSession
    w = Window.partitionBy(key).orderBy(*order)
    fresh = events.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    if within:
        fresh = fresh.persist()  # looked at for its partitions, then written
    new = fresh
    try:
        stored = spark.read.schema(events.schema).parquet(path)
        if within:
            stored = stored.where(F.col(within).isin([r[0] for r in fresh.select(within).distinct().collect()]))  # one value a partition
        new = fresh.join(stored.select(key), key, "left_anti").select(*events.columns)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    # one task writes a partition's rows: a file a partition and call, not one a task and partition
    writer = (new.repartition(within) if within else new).write.mode("append")
    (writer.partitionBy(within) if within else writer).parquet(path)
    if within:
        fresh.unpersist()


def apply_purge(index: DataFrame, purge: DataFrame, kind: str) -> DataFrame:
    """The media index (call_id, kind, path) less the purged calls' media of ``kind``."""
    gone = purge.select("call_id", F.lit(kind).alias("kind")).distinct()
    return index.join(gone, ["call_id", "kind"], "left_anti")
