"""The life of calls as sweeps over tables: current status, queue, reclaiming, retention, delivery. ``now`` is always a parameter."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.sources import contracts as C


def current_status(log: DataFrame, order: list[str]) -> DataFrame:
    """The newest status of each call, with its own error; thread_id and emailed_at are carried over later rows without them."""
    known = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))
    last = F.max_by(F.struct("status", "updated_at", "error"), F.struct(*order)).alias("last")
    return log.groupBy("call_id").agg(last, known("thread_id").alias("thread_id"), known("emailed_at").alias("emailed_at")).select("call_id", "last.*", "thread_id", "emailed_at")


def ready_queue(status: DataFrame) -> DataFrame:
    return status.where("status = 'ready-to-process'").orderBy("call_id")


def _at(now: datetime | str) -> Column:
    return F.lit(str(now)).cast("timestamp_ntz")


def reclaim_stale(status: DataFrame, now: datetime | str, lease_minutes: int = 15) -> DataFrame:
    """New ready-to-process rows for calls in work whose lease has run out; at exactly the lease it has."""
    old = F.col("updated_at").cast("timestamp_ntz") <= _at(now) - F.expr(f"INTERVAL '{lease_minutes}' MINUTE")
    return status.where(F.col("status").isin("transcribing", "summarizing") & old).select("call_id", F.lit("ready-to-process").alias("status"), _at(now).alias("updated_at"), "thread_id", "emailed_at")


def reclaim_stranded(status: DataFrame, now: datetime | str, error: str = "capture restarted while recording") -> DataFrame:
    """Failed rows for calls still marked as recording."""
    return status.where("status = 'recording'").select("call_id", F.lit("failed").alias("status"), _at(now).alias("updated_at"), F.lit(error).alias("error"), "thread_id", "emailed_at")


def pending_deliveries(status: DataFrame, email_enabled: bool = True) -> DataFrame:
    """Calls with a leg to deliver yet."""
    rows = status.withColumns({"needs_post": F.col("thread_id").isNull(), "needs_email": F.lit(email_enabled) & F.col("emailed_at").isNull()})
    return rows.where(F.col("needs_post") | F.col("needs_email"))


def expired(calls: DataFrame, now: datetime | str, days: int, video: bool = False) -> DataFrame:
    """Delivered calls whose media (audio, or video where they have one) is ``days`` old or older; none for negative ``days``."""
    if days < 0:
        return calls.limit(0)
    when = F.coalesce("ended_at", "started_at").cast("timestamp_ntz")
    rows = calls.where((F.col("status") == "delivered") & (when <= _at(now) - F.expr(f"INTERVAL '{days}' DAY")))
    return rows.where("has_video") if video else rows


def status_funnel(status: DataFrame) -> DataFrame:
    """Calls in each status, in the order of the state machine; statuses without a call count 0."""
    spark = status.sparkSession
    dims = spark.createDataFrame([(s, i) for i, s in enumerate(T.STATUSES)], "status string, rank int")
    counts = status.groupBy("status").agg(F.count("*").alias("calls"))
    return dims.join(counts, "status", "left").select("status", "rank", F.coalesce("calls", F.lit(0).cast("long")).alias("calls"))


def build_manifests(calls: DataFrame, tracks: DataFrame, videos: DataFrame) -> DataFrame:
    """The manifest of each call, typed as sources.contracts.MANIFEST: its usable tracks in order, and its video if there is one.

    ``calls`` has call_id, guild_id, channel_id, started_at and ended_at (null
    while it runs); ``tracks`` call_id, track_idx and a track's fields; ``videos``
    call_id and a video's fields. Calls without tracks keep their row.
    """
    fields = list(C.TRACK.fields)
    per = tracks.groupBy("call_id").agg(F.array_sort(F.collect_list(F.struct("track_idx", *fields))).alias("tracks"))
    plain = F.transform("tracks", lambda t: F.struct(*(t[f].alias(f) for f in fields)))
    none = F.array().cast(C.ddl(C.MANIFEST.fields["tracks"]))
    seen = videos.select("call_id", F.struct(*C.VIDEO.fields).alias("video"))
    return calls.join(per, "call_id", "left").join(seen, "call_id", "left").withColumn("tracks", F.coalesce(plain, none))


def delivery_outcomes(outbox: DataFrame) -> DataFrame:
    """What one first-in-first-out pass of each producer does with its events.

    Up to the first transient failure, successes are delivered and other
    failures parked; that event and all after it stay pending.
    """
    good = F.col("http_status").between(200, 299)
    transient = ~good & ~T.is_permanent_rejection(F.col("http_status")) | F.col("http_status").isNull()
    # a row a producer: no window holds a producer's events together
    first = outbox.where(transient).groupBy("producer").agg(F.min("pos").alias("_first"))
    rows = outbox.join(first, "producer", "left")
    reached = F.col("_first").isNull() | (F.col("pos") < F.col("_first"))
    return rows.withColumn("outcome", F.when(~reached, "pending").when(good, "delivered").otherwise("parked")).drop("_first")


def emit_counts(results: DataFrame) -> DataFrame:
    """Memories and edges made, and warnings given, by producer; events only spooled have none."""
    n = lambda c: F.sum(F.coalesce(c, F.lit(0)))
    return results.groupBy("producer").agg(n(F.col("n_ids")).alias("memories"), n(F.col("edges")).alias("edges"), n(F.size(F.coalesce("warnings", F.array()))).alias("warnings"))


def emit_warnings(results: DataFrame) -> DataFrame:
    """Each warning of each producer with how often it was given."""
    return results.select("producer", F.explode("warnings").alias("warning")).groupBy("producer", "warning").agg(F.count("*").alias("n"))


def recent_n(emails: DataFrame, n: int = 10) -> DataFrame:
    """The newest ``n`` (at most 50) of each mailbox."""
    w = Window.partitionBy("mailbox").orderBy(F.desc("uid"))
    rows = emails.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= min(n, 50))
    return rows.withColumn("subject", F.coalesce("subject", F.lit("(no subject)")))
