"""Queries over sources, sinks and streams, with their SQL. What a feed reads is first laid out as files in the shared folder."""

from __future__ import annotations

import json
import uuid
from datetime import datetime

from pyspark.sql import functions as F

from colloquy.operators import lifecycle as L
from colloquy.operators import messages as M
from colloquy.sources import contracts as C
from colloquy.sources import io, validate
from colloquy.streaming import feeds as S
from colloquy.streaming import state

from .lives import BURST, DOCS, ROLES, SESS, STATUS_ERRORS, USERS, documents_of_status
from .messages import ALLOWED, FEED, LOG, NORMAL, OUT, channels, feed, feed_consent, ids, log, normal, optout, raw
from .views import NOW, duck, view


#: Slices of time in which a feed arrives.
SLICES = 5
#: Rows of a slice that go into one file, at most about.
FILE_ROWS = 500_000
EPOCH = datetime(1970, 1, 1)


def place(s, name):
    return f"{io.shared_dir(s)}/{name}-{uuid.uuid4().hex}"


def laid_out(s, df, name):
    """A folder of Parquet files with ``df``, and its schema."""
    path = place(s, name)
    df.write.parquet(path)
    return path, df.schema


def delivered_twice(s, df, again, name):
    """A folder with ``df`` and, once more, its rows for which ``again`` holds, written by as many tasks as read them; its schema; and how many files are a third of it."""
    path = place(s, name)
    for part in (df, df.where(again)):
        part.write.mode("append").parquet(path)
    return path, df.schema, -(-len(s.read.schema(df.schema).parquet(path).inputFiles()) // 3)


def scan_status(s, d):
    """Status documents as JSON text, read back and checked in one pass."""
    path = place(s, "status")
    documents_of_status(s, d).select("value").write.text(path)
    rows = io.checked_documents(s, path, C.STATUS)
    return rows.select(_call_id(), F.col("d.status").alias("status"), F.unix_millis("d.updated_at").alias("updated_ms"), F.unix_millis("d.emailed_at").alias("emailed_ms"), "errors")


def _call_id():
    """The call that a document names, be it valid or not."""
    return F.coalesce("d.call_id", F.get_json_object("value", "$.callId")).alias("call_id")


def manifest_documents(s, d):
    """A manifest of each call as JSON text. Some have no guild, an end that isn't in UTC, a video without a path, a track before the call or without a name."""
    iso = F.date_format("started_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.col("o_orderkey")
    user = lambda i, offset, name: F.struct(F.lit(f"u{i}").alias("userId"), name.alias("displayName"), F.lit(f"audio/u{i}.pcm").alias("path"), offset.alias("startOffsetMs"))
    tracks = F.array(user(1, F.when(n % 9 == 0, -1).otherwise(5), F.lit("Ada")), user(2, F.lit(40), F.when(n % 10 == 0, "").otherwise("Eve")))
    video = F.when(F.col("has_video"), F.struct(F.when(n % 7 != 0, "v.mkv").alias("path"), iso.alias("startedAt"), F.lit(-5).alias("startOffsetMs")))
    ended = F.when(n % 4 != 0, F.when(n % 5 == 0, F.concat(F.substring(iso, 1, 19), F.lit("+02:00"))).otherwise(iso))
    doc = F.struct(F.col("call_id").alias("callId"), F.when(n % 8 != 0, "g1").otherwise("").alias("guildId"), F.col("channel_id").alias("channelId"), iso.alias("startedAt"), F.coalesce(ended, F.lit("~")).alias("endedAt"), tracks.alias("tracks"), video.alias("video"))
    # a call that runs has no end: null, which to_json() would leave out
    return view(s, d, "call_status").select("call_id", F.replace(F.to_json(doc), F.lit('"~"'), F.lit("null")).alias("value"))


def scan_calls(s, d):
    """Manifests as JSON text, read back and checked in one pass; of the valid ones how long the call was and the tracks."""
    path = place(s, "calls")
    manifest_documents(s, d).select("value").write.text(path)
    rows = io.checked_documents(s, path, C.MANIFEST)
    tracks = F.array_join(F.transform("d.tracks", lambda t: F.concat_ws(":", t["user_id"], t["display_name"], t["start_offset_ms"])), ",")
    return rows.select(_call_id(), F.unix_millis("d.started_at").alias("started_ms"), F.unix_millis("d.ended_at").alias("ended_ms"), tracks.alias("tracks"), F.col("d.video.path").alias("video"), "errors")


def artifacts(s, d):
    """A month's calls written, then half of them again; partitions that aren't rewritten stay."""
    path = place(s, "artifacts")
    rows = view(s, d, "call_status").select("call_id", "o_orderkey", F.date_format("started_at", "yyyy-MM").alias("call_date"), F.lit(1).alias("version"))
    io.write_call_artifacts(rows, path)
    io.write_call_artifacts(rows.where("call_date < '1995-01'").withColumn("version", F.lit(2)), path)
    return s.read.parquet(path).groupBy("version").agg(F.count("*").alias("n"))


def sink_twice(s, d):
    """Two overlapping deliveries of a log: every key is there once."""
    path = place(s, "events")
    rows = log(s, d).select("event_key", "kind", "event_id", "ts")
    for part in ("event_id % 3 < 2", "event_id % 3 > 0", "event_id % 3 < 2"):
        io.sink_events_idempotent(rows.where(part), path, ["ts", "event_id"])
    return s.read.parquet(path).groupBy("kind").agg(F.count("*").alias("n"), F.count_distinct("event_key").alias("keys"))


def ingest(s, d):
    """The feed as a stream with lost and unknown rows in it, a third of it delivered twice, run twice on one checkpoint."""
    rows = feed(s, d)
    spoilt = rows.withColumn("kind", F.when(F.col("seq") % 43 == 0, "poke").otherwise(F.col("kind"))).withColumn("ts", F.when(F.col("seq") % 41 != 0, F.col("ts")))
    path, schema, files = delivered_twice(s, spoilt, "seq % 3 = 0", "feed")
    target, refused, checkpoint = place(s, "store"), place(s, "refused"), place(s, "offsets")
    consent_ = consent_tables(s, d)
    for _ in range(2):
        S.stream_ingest(S.source(s, path, schema, files), *consent_, target, refused, checkpoint)
    good = s.read.parquet(target).select("event_type", "event_key", F.md5("event").alias("event_md5"), F.lit("").alias("errors"))
    none = F.lit(None).cast("string")
    return good.unionByName(s.read.parquet(refused).select(none.alias("event_type"), F.concat_ws("|", "seq", "message_id").alias("event_key"), none.alias("event_md5"), "errors"))


def backfill(s, d):
    """A history that grows between two runs of one checkpoint."""
    rows = feed(s, d)
    first, rest = (rows.where(f"seq % 2 = {i}") for i in (0, 1))
    path, schema = laid_out(s, first, "history")
    target, refused, checkpoint = place(s, "store"), place(s, "refused"), place(s, "offsets")
    consent_ = consent_tables(s, d)
    S.stream_ingest(S.source(s, path, schema), *consent_, target, refused, checkpoint)
    rest.write.mode("append").parquet(path)
    S.stream_ingest(S.source(s, path, schema), *consent_, target, refused, checkpoint)
    return s.read.parquet(target).groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_key").alias("keys"))


def consent_tables(s, d):
    """feed_consent() as tables of their own, which every micro-batch reads."""
    out = []
    for name, df in zip(("channels", "optout"), feed_consent(s, d), strict=True):
        path, schema = laid_out(s, df.coalesce(1), name)
        out.append(s.read.schema(schema).parquet(path))
    return out


def appended(s, stream, name):
    """The rows that a stream appends to a table, from a run over what is there."""
    target = place(s, name)
    query = stream.writeStream.format("parquet").option("path", target).option("checkpointLocation", place(s, "offsets")).trigger(availableNow=True).start()
    query.awaitTermination()
    return s.read.schema(stream.schema).parquet(target)


def dedupe(s, d):
    """Every event delivered twice and a third of them again a long time later: the state forgets keys an hour behind, and the sink's own key catches what comes after that."""
    rows = log(s, d).select("event_key", "kind", "event_id", "ts")
    path = place(s, "feed")
    for part in (rows, rows, rows.where("event_id % 3 = 0")):
        part.coalesce(1).write.mode("append").parquet(path)
    target = place(s, "deduped")
    S.run(S.stream_dedupe(S.source(s, path, rows.schema, 1)), place(s, "offsets"), lambda df, _: io.sink_events_idempotent(df, target, ["ts", "event_id"]))
    kind = F.when(F.col("event_key").contains("|edit|"), "edit").when(F.col("event_key").endswith("|delete"), "delete").otherwise("message")
    return s.read.parquet(target).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def utterances(s, d):
    """Sessions of each user's bursts; a burst of nobody, long after the others, closes the last of them."""
    rows = view(s, d, "bursts").drop("burst_idx")
    end = rows.agg(F.max("ts").alias("ts")).select(F.lit("").alias("user_id"), (F.col("ts") + F.expr("INTERVAL '3650' DAY")).alias("ts"), F.lit(0).cast("long").alias("dur_ms"))
    path, schema = laid_out(s, rows.unionByName(end), "bursts")
    return appended(s, S.stream_utterances(S.source(s, path, schema), 7_200_000, "0 seconds"), "utterances").where("user_id <> ''")


def writes(s, d):
    """Status writes of every call, an hour apart; some stop half-way, a few go on when their lease has run out, some fail."""
    n = F.col("o_orderkey")
    steps = F.array(*(F.struct(F.lit(i).alias("seq"), F.lit(x).alias("status")) for i, x in enumerate(["recording", "ready-to-process", "transcribing", "summarizing", "delivered"])))
    last = F.when(n % 5 == 0, 2).when(n % 7 == 0, 3).when(n % 11 == 0, 1).otherwise(4)
    rows = view(s, d, "call_status").select("call_id", "o_orderkey", "started_at", "ended_at", "has_video", F.explode(F.filter(steps, lambda x: x["seq"] <= last)).alias("x")).select("*", "x.*").drop("x")
    hours = F.col("seq") + F.when((n % 13 == 0) & (F.col("seq") == 4), 96).otherwise(0)
    status = F.when((n % 17 == 0) & (F.col("seq") == 3), "failed").otherwise(F.col("status"))
    return rows.withColumn("updated_at", F.col("started_at") + F.make_dt_interval(hours=hours)).withColumn("status", status)


def in_slices(s, df, time, late, name):
    """``df`` as files that arrive in order of time, every other row (by a hash) one slice late, then a row of nobody that moves the clock to ``late``.

    Gives the folder, the schema, the delay and how many files a slice has.
    """
    lo, hi, n = df.agg(F.min(time), F.max(time), F.count("*")).first()
    step = (hi - lo) / SLICES
    of = F.floor((F.unix_micros(F.col(time).cast("timestamp")) - int((lo - EPOCH).total_seconds() * 1e6)) / int(step.total_seconds() * 1e6))
    rows = df.withColumn("_slice", F.least(of + F.pmod(F.xxhash64(*df.columns), F.lit(2)), F.lit(SLICES + 1)).cast("int"))
    path, files, dealt = place(s, name), 1 + n // (SLICES * FILE_ROWS), place(s, f"{name}-slices")
    rows.write.partitionBy("_slice").parquet(dealt)  # what the rows come from is read once, not for every slice
    rows = s.read.schema(rows.schema).parquet(dealt)
    for i in range(SLICES + 2):
        # a file stream takes files in order of their times, a slice's at a trigger
        rows.where(F.col("_slice") == i).drop("_slice").coalesce(files).write.mode("append").parquet(path)
        for _ in range(files * (i + 1) - len(s.read.parquet(path).inputFiles())):
            df.limit(0).coalesce(1).write.mode("append").parquet(path)
    nobody = [F.lit(late).cast(f.dataType).alias(f.name) if f.name == time else F.lit("" if f.name in ("call_id", "channel_id") else None).cast(f.dataType).alias(f.name) for f in df.schema]
    s.range(1).select(*nobody).coalesce(1).write.mode("append").parquet(path)
    return path, df.schema, f"{2 * int(step.total_seconds()) + 1} seconds", files


def queue(s, d):
    """Calls delivered in several batches while the clock moves on."""
    path, schema, delay, files = in_slices(s, writes(s, d).select("call_id", "seq", "status", "updated_at", "started_at", "ended_at", "has_video"), "updated_at", "2009-01-01", "queue")
    with state.store(s):
        rows = S.stream_queue(S.source(s, path, schema, files), 60 * 72, 900, 400, delay)
        return appended(s, rows, "actions")


def quarantine(s, d):
    rows = log(s, d).select("event_id", "event_key", "kind", "value", "ts")
    path, schema = laid_out(s, rows, "feed")
    target, rejected = place(s, "good"), place(s, "bad")
    S.stream_quarantine(S.source(s, path, schema), validate.format_issues(validate.issues(("kind", F.col("kind") == "media", "not allowed"), ("value", F.col("value") < 5, "too small"))), target, rejected, place(s, "offsets"))
    bad = s.read.parquet(rejected).groupBy("errors").agg(F.count("*").alias("n"))
    return bad.unionByName(s.read.parquet(target).groupBy(F.lit("").alias("errors")).agg(F.count("*").alias("n")))


def sessions(s, d):
    """The log of voice channels, delivered out of order within the delay."""
    path, schema, delay, files = in_slices(s, view(s, d, "voice_state"), "ts", "2100-01-01", "voice")
    with state.store(s):
        return appended(s, S.stream_voice_sessions(S.source(s, path, schema, files), USERS, ROLES, delay), "sessions")


def purge(s, d):
    calls = view(s, d, "call_status")
    index = calls.select("call_id", F.explode(F.array(F.lit("audio"), F.lit("video"))).alias("kind"))
    return io.apply_purge(io.apply_purge(index, L.expired(calls, NOW, 900), "audio"), L.expired(calls, NOW, 400, video=True), "video")


def message_stream(s, d):
    """Raw messages as a feed of creates, edits and deletes, some without a time or of an unknown kind, delivered twice."""
    kind = F.when(F.col("seq") % 43 == 0, "poke").when(F.col("seq") % 17 == 0, "delete").when(F.col("seq") % 11 == 0, "edit").otherwise("create")
    rows = raw(s, d).withColumn("kind", kind).withColumn("ts", F.when(F.col("seq") % 41 != 0, F.col("ts")))
    path, schema, files = delivered_twice(s, rows, "seq % 3 = 0", "raw")
    target, rejected = place(s, "messages"), place(s, "refused")
    named = ids(s, d).select(F.explode(F.array("author_id", "mention_1", "mention_2")).alias("author_id"))
    S.stream_messages(S.source(s, path, schema, files), channels(ids(s, d)), optout(named), target, rejected, place(s, "offsets"))
    good = s.read.parquet(target).select("message_id", "kind", "channel_id", "thread_id", "author_name", F.array_join("mentions", ",").alias("mentions"), F.md5("content").alias("content_md5"), F.lit("").alias("errors"))
    none = F.lit(None).cast("string")
    return good.unionByName(s.read.parquet(rejected).select("message_id", "kind", *(none.alias(c) for c in ("channel_id", "thread_id", "author_name", "mentions", "content_md5")), "errors"))


def consent(s, d):
    """Consent as a JSON file of the channels and authors that occur, read back and applied."""
    path = place(s, "consent")
    listed = lambda df, c: df.agg(F.collect_set(c)).first()[0]
    # channels and people of one community: what a person writes into such a file
    s.createDataFrame([(json.dumps({"allowChannels": listed(channels(ids(s, d)), "channel_id"), "optOutMembers": listed(optout(ids(s, d)), "user_id")}),)], "value string").write.text(path)
    channels_, optout_, every = io.consent_source(s, path)
    return M.gate_with_reason(normal(s, d), channels_, optout_, every).select("message_id", "skip_reason")


def manifests(s, d):
    return manifest_documents(s, d).select("call_id", io.document_errors(C.MANIFEST, F.try_parse_json("value")).alias("errors"))


QUERIES = {"message_stream": message_stream, "consent_source": consent, "validate_manifest": manifests, "scan_status": scan_status, "scan_calls": scan_calls, "write_call_artifacts": artifacts, "sink_events_idempotent": sink_twice, "stream_ingest": ingest, "stream_backfill": backfill, "stream_dedupe": dedupe, "stream_utterances": utterances, "stream_queue": queue, "stream_quarantine": quarantine, "stream_voice_sessions": sessions, "apply_purge": purge}

MANIFEST_ERRORS = """checked AS (SELECT *, concat_ws('; ', CASE WHEN o_orderkey % 8 = 0 THEN 'guildId: empty' END, CASE WHEN o_orderkey % 5 = 0 AND o_orderkey % 4 <> 0 THEN 'endedAt: not an ISO time in UTC' END,
 CASE WHEN o_orderkey % 9 = 0 THEN 'tracks.0.startOffsetMs: negative' END, CASE WHEN o_orderkey % 10 = 0 THEN 'tracks.1.displayName: empty' END, CASE WHEN has_video AND o_orderkey % 7 = 0 THEN 'video.path: missing' END) AS errors FROM call_status)
"""
SQL = {
    "message_stream": duck(NORMAL + """, kinds AS (SELECT *, CASE WHEN seq % 43 = 0 THEN 'poke' WHEN seq % 17 = 0 THEN 'delete' WHEN seq % 11 = 0 THEN 'edit' ELSE 'create' END AS kind, seq % 41 = 0 AS late FROM raw_messages)
SELECT message_id, kind, n.channel_id, n.thread_id, n.author_name, COALESCE(array_to_string(list_filter([n.mention_1, n.mention_2], lambda x: CAST(substr(x, 2) AS INT) % 10 <> 3), ','), '') AS mentions, md5(n.content) AS content_md5, '' AS errors FROM kinds JOIN gated n USING (message_id) WHERE NOT late AND kind IN ('create', 'edit') AND skip_reason IS NULL
UNION ALL SELECT message_id, kind, COALESCE(parent_id, raw_channel_id), NULL, NULL, NULL, NULL, '' FROM kinds WHERE NOT late AND kind = 'delete' AND guild_id IS NOT NULL
UNION ALL SELECT message_id, kind, NULL, NULL, NULL, NULL, NULL, concat_ws('; ', CASE WHEN late THEN 'ts: missing' END, CASE WHEN kind = 'poke' THEN 'kind: unknown' END) FROM kinds WHERE late OR kind = 'poke'""", "raw_messages"),
    "consent_source": duck(NORMAL + "SELECT message_id, skip_reason FROM gated", "raw_messages"),
    "validate_manifest": duck(MANIFEST_ERRORS + "SELECT call_id, errors FROM checked", "call_status"),
    "scan_status": duck(DOCS + f"SELECT call_id, CASE WHEN errors = '' THEN status END AS status, CASE WHEN errors = '' THEN epoch_ms(updated_at) END AS updated_ms, CASE WHEN errors = '' AND emailed_at IS NOT NULL THEN epoch_ms(updated_at) END AS emailed_ms, errors FROM (SELECT *, {STATUS_ERRORS} AS errors FROM docs)", "call_status"),
    "scan_calls": duck(MANIFEST_ERRORS + """SELECT call_id, CASE WHEN errors = '' THEN epoch_ms(started_at) END AS started_ms, CASE WHEN errors = '' AND o_orderkey % 4 <> 0 THEN epoch_ms(started_at) END AS ended_ms,
 CASE WHEN errors = '' THEN 'u1:Ada:5,u2:Eve:40' END AS tracks, CASE WHEN errors = '' AND has_video THEN 'v.mkv' END AS video, errors FROM checked""", "call_status"),
    "write_call_artifacts": duck("SELECT CASE WHEN started_at < TIMESTAMP '1995-01-01' THEN 2 ELSE 1 END AS version, count(*) AS n FROM call_status GROUP BY 1", "call_status"),
    "sink_events_idempotent": duck(LOG + "SELECT arg_min(kind, (ts, event_id)) AS kind, count(*) AS n, count(*) AS keys FROM (SELECT event_key, kind, ts, event_id, row_number() OVER (PARTITION BY event_key ORDER BY event_id % 3 = 2, ts, event_id) AS rn FROM log) WHERE rn = 1 GROUP BY kind", "message_log"),
    "stream_ingest": duck(FEED.replace("FROM feed", "FROM whole") + """SELECT event_type, event_key, md5(min(event)) AS event_md5, '' AS errors FROM sent GROUP BY 1, 2
UNION ALL SELECT NULL, seq || '|' || message_id, NULL, concat_ws('; ', CASE WHEN seq % 41 = 0 THEN 'ts: missing' END, CASE WHEN seq % 43 = 0 THEN 'kind: unknown' END) FROM feed WHERE seq % 41 = 0 OR seq % 43 = 0""", "feed").replace("said AS (", "whole AS (SELECT * FROM feed WHERE seq % 41 <> 0 AND seq % 43 <> 0), said AS (", 1),
    "stream_backfill": duck(FEED + "SELECT event_type, count(DISTINCT event_key) AS n, count(DISTINCT event_key) AS keys FROM sent GROUP BY 1", "feed"),
    "stream_dedupe": duck(LOG + "SELECT CASE WHEN contains(event_key, '|edit|') THEN 'edit' WHEN ends_with(event_key, '|delete') THEN 'delete' ELSE 'message' END AS kind, count(DISTINCT event_key) AS n FROM log GROUP BY 1", "message_log"),
    "stream_queue": duck("""steps AS (SELECT *, unnest(range(CASE WHEN o_orderkey % 5 = 0 THEN 3 WHEN o_orderkey % 7 = 0 THEN 4 WHEN o_orderkey % 11 = 0 THEN 2 ELSE 5 END)) AS seq FROM call_status),
timed AS (SELECT call_id, seq, has_video, COALESCE(ended_at, started_at) AS media, CASE WHEN o_orderkey % 17 = 0 AND seq = 3 THEN 'failed' ELSE ['recording', 'ready-to-process', 'transcribing', 'summarizing', 'delivered'][seq + 1] END AS status,
  started_at + INTERVAL 1 HOUR * (seq + CASE WHEN o_orderkey % 13 = 0 AND seq = 4 THEN 96 ELSE 0 END) AS since FROM steps), w AS (SELECT *, lead(since) OVER (PARTITION BY call_id ORDER BY since, seq) AS next FROM timed),
due AS (SELECT call_id, 'reclaim' AS action, since, since + INTERVAL 72 HOUR AS due, next FROM w WHERE status IN ('transcribing', 'summarizing')
  UNION ALL SELECT call_id, 'purge-audio', since, greatest(since, media + INTERVAL 900 DAY), next FROM w WHERE status = 'delivered' UNION ALL SELECT call_id, 'purge-video', since, greatest(since, media + INTERVAL 400 DAY), next FROM w WHERE status = 'delivered' AND has_video),
act AS (SELECT call_id, action, since, due FROM due WHERE next IS NULL OR next > due)
FROM act UNION ALL SELECT call_id, 'process', due, due FROM act WHERE action = 'reclaim' UNION ALL SELECT call_id, 'process', since, since FROM w WHERE status = 'ready-to-process'""", "call_status"),
    "stream_utterances": duck(BURST + """, e AS (SELECT *, max(at_ms + dur_ms) OVER (PARTITION BY user_id ORDER BY at_ms, burst_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
u AS (SELECT *, sum(CASE WHEN pe IS NULL OR at_ms - pe >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_ms, burst_idx ROWS UNBOUNDED PRECEDING) AS utterance FROM e)
SELECT user_id, min(at_ms) AS start_ms, max(at_ms + dur_ms) AS end_ms, count(*) AS n_bursts FROM u GROUP BY user_id, utterance""", "bursts"),
    "stream_quarantine": duck("SELECT concat_ws('; ', CASE WHEN kind = 'media' THEN 'kind: not allowed' END, CASE WHEN value < 5 THEN 'value: too small' END) AS errors, count(*) AS n FROM message_log GROUP BY 1", "message_log"),
    "stream_voice_sessions": duck(SESS + "SELECT channel_id, ts AS started_at, e AS ended_at FROM (SELECT *, lead(ts) OVER (PARTITION BY channel_id ORDER BY ts, event_id) AS e FROM flips) WHERE r = 1 AND e IS NOT NULL", "voice_state"),
    "apply_purge": duck(f"SELECT call_id, kind FROM call_status, (SELECT unnest(['audio', 'video']) AS kind) WHERE NOT COALESCE(status = 'delivered' AND ((kind = 'audio' AND COALESCE(ended_at, started_at) <= TIMESTAMP '{NOW}' - INTERVAL 900 DAY) OR (kind = 'video' AND has_video AND COALESCE(ended_at, started_at) <= TIMESTAMP '{NOW}' - INTERVAL 400 DAY)), FALSE)", "call_status"),
}
