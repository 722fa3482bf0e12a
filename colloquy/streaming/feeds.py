"""Structured Streaming feeds. Each runs what is there (availableNow) from its checkpoint, so that a rerun adds only what is new.

The transforms are those of the batch operators; the tables behind the sinks
are written once a micro-batch, keyed so that a repeated batch changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.operators import messages as M
from colloquy.sources.io import sink_events_idempotent
from colloquy.sources.validate import format_issues, issues

from . import state


def source(spark: SparkSession, path: str, schema, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def run(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """``each`` on the micro-batches of what is there, then ends."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def feed_errors():
    """What a raw message, edit or delete lacks to be taken in."""
    lacks = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    return format_issues(issues(("message_id", lacks("message_id"), "missing"), ("ts", F.col("ts").isNull(), "missing"), ("kind", ~F.coalesce(F.col("kind").isin("create", "edit", "delete"), F.lit(False)), "unknown")))


def _split(df: DataFrame, rejected: str) -> DataFrame:
    """The rows without errors; the others go to ``rejected``, once however often they come."""
    marked = df.withColumn("errors", feed_errors())
    bad = marked.where("errors <> ''").withColumn("event_key", F.xxhash64("message_id", "ts", "kind", "content").cast("string"))
    sink_events_idempotent(bad, rejected, ["event_key"])
    return marked.where("errors = ''").drop("errors")


#: Numbers of message ids that share a partition of the event table.
SLOT = 10_000


def stream_ingest(stream: DataFrame, channels: DataFrame, optout: DataFrame, target: str, rejected: str, checkpoint: str, allow_all: bool = False, members: bool = True, width: int = SLOT) -> None:
    """A live feed of raw messages, edits and deletes to the event table, by operators.messages.ingest().

    Rows without an id, a time or a known kind go to ``rejected`` with their
    errors. The table is partitioned by the slot of the message's id, so that a
    micro-batch looks into the slots that it touches and into no others,
    however large the table has grown. A repeated delivery changes nothing.
    """
    def each(df: DataFrame, _: int) -> None:
        events = M.ingest(_split(df, rejected), channels, optout, allow_all, members)
        rows = events.select("event_key", "event_type", "source_ref", "ts", "event", M.slot(F.coalesce("message_id", F.lit("")), width).alias("slot"))
        sink_events_idempotent(rows, target, ["ts", "event"], within="slot")

    run(stream, checkpoint, each)


def stream_quarantine(stream: DataFrame, errors, target: str, rejected: str, checkpoint: str) -> None:
    """Valid rows to one table, rejected ones with their errors to another; neither holds the other up. Rows are keyed by event_id and stored by day."""
    def each(df: DataFrame, _: int) -> None:
        marked = df.withColumn("errors", errors).withColumn("day", F.to_date("ts"))
        sink_events_idempotent(marked.where("errors = ''").drop("errors"), target, ["ts"], "event_id", within="day")
        sink_events_idempotent(marked.where("errors <> ''"), rejected, ["ts"], "event_id", within="day")

    run(stream, checkpoint, each)


def stream_messages(stream: DataFrame, channels: DataFrame, optout: DataFrame, target: str, rejected: str, checkpoint: str, allow_all: bool = False, width: int = SLOT) -> None:
    """A feed of raw messages with ``kind`` (create, edit or delete) to one table of normalised creates, edits and deletes.

    Consent is asked of creates and edits, and their mentions are kept without
    those who opted out. Rejected rows, replays and slots as in stream_ingest().
    """
    def each(df: DataFrame, _: int) -> None:
        good = _split(df, rejected)
        spoken = M.normalize_messages(good.where("kind <> 'delete'"), keep=["kind"])
        let = M.scrub_mentions(M.gate_member(M.gate_channel(spoken, channels, allow_all), optout), optout)
        gone = M.normalize_deletes(good.where("kind = 'delete'").withColumn("channel_id", F.col("raw_channel_id"))).withColumn("kind", F.lit("delete"))
        rows = let.unionByName(gone, allowMissingColumns=True).withColumn("event_key", M.event_key(F.col("kind"), M.source_ref(), F.col("ts")))
        sink_events_idempotent(rows.withColumn("slot", M.slot(F.col("message_id"), width)), target, ["ts", "message_id"], within="slot")

    run(stream, checkpoint, each)


def stream_dedupe(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The feed without re-deliveries inside the watermark; the sink's key does the rest."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.dropDuplicatesWithinWatermark(["event_key"])


def stream_utterances(stream: DataFrame, silence_ms: int, delay: str) -> DataFrame:
    """As operators.voice.burst_sessions(): a burst holds its session open for its own length and ``silence_ms`` more.

    A session is given when the watermark has passed its end and the silence; a
    burst for which that is so already when it comes is late: it is dropped and
    counted (state.late_rows).
    """
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    open_for = F.concat((F.col("dur_ms") + silence_ms).cast("string"), F.lit(" milliseconds"))
    sessions = timed.groupBy("user_id", F.session_window("ts", open_for)).agg(F.count("*").alias("n_bursts"))
    return sessions.select("user_id", F.unix_millis("session_window.start").alias("start_ms"), (F.unix_millis("session_window.end") - silence_ms).alias("end_ms"), "n_bursts")


def stream_queue(stream: DataFrame, lease_minutes: int, audio_days: int, video_days: int | None = None, delay: str = "1 minute") -> DataFrame:
    """The poll cycle over a feed of status writes: (call_id, action, since, due), each action once, when the watermark passes ``due``.

    ``stream`` has call_id, seq, status, updated_at, started_at, ended_at and
    has_video. A ready call is to be processed; one in work whose lease runs out
    is reclaimed and to be processed again; a delivered one is purged of its audio
    and video at their ages (negative: never; the default of video's is audio's).
    ``since`` is the time of the write that an action is about. A call is watched
    until nothing is left to do for it; rows with other ids move the clock on.
    """
    day = 86_400_000_000
    watch = state.CallWatch(lease_minutes * 60_000_000, audio_days * day, (audio_days if video_days is None else video_days) * day)
    media = F.unix_micros(F.coalesce("ended_at", "started_at").cast("timestamp"))
    rows = state.ordered(stream.withColumn("media_us", media), "call_id", "updated_at", "seq", delay, watch)
    at = lambda c: F.timestamp_micros(F.col(c)).cast("timestamp_ntz")
    return rows.select("call_id", "action", at("since_us").alias("since"), at("due_us").alias("due"))


def stream_voice_sessions(stream: DataFrame, users: list[str], roles: list[str], delay: str = "1 hour") -> DataFrame:
    """Closed calls of each channel: as operators.voice.voice_sessions(), by a state machine that is fed in order of time.

    Rows may come in any order within ``delay``; a call is given when the
    watermark has passed its end. Later rows are dropped and counted.
    """
    rows = state.ordered(stream, "channel_id", "ts", "event_id", delay, state.VoiceRoom(users, roles))
    return rows.select("channel_id", F.timestamp_micros("started_us").alias("started_at"), F.timestamp_micros("ended_us").alias("ended_at"))
