"""Queries over voice channels, recordings and the life of calls, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import lifecycle as L
from colloquy.operators import voice as V
from colloquy.sources import contracts as C
from colloquy.sources import validate
from colloquy.sources.io import document_errors

from .messages import channels
from .views import NOW, duck, view

USERS, ROLES = ["u1", "u2"], ["r3"]
LOG_ORDER = ["seq", "updated_at", "l_partkey", "l_suppkey", "l_extendedprice"]


def voice(s, d):
    return view(s, d, "voice_state")


def bursts(s, d):
    return view(s, d, "bursts").withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp"))).drop("ts")


def status(s, d):
    return view(s, d, "call_status")


def log(s, d):
    """The status log; some writes say what went wrong."""
    return view(s, d, "status_log").withColumn("error", F.when(F.col("l_suppkey") % 4 == 0, F.concat(F.lit("trouble "), "user_id")))


def snap(s, d):
    return V.snapshot(voice(s, d), USERS, ROLES)


def manifests(s, d):
    """Manifests of the calls with their usable tracks and videos, as documents."""
    tracks = V.usable_tracks(log(s, d)).select("call_id", F.col("seq").alias("track_idx"), "user_id", F.concat(F.lit("Speaker "), "user_id").alias("display_name"), F.concat(F.lit("audio/"), "user_id", F.lit(".pcm")).alias("path"), (F.col("l_partkey") % 5000).alias("start_offset_ms"))
    videos = status(s, d).where("has_video").select("call_id", F.concat("call_id", F.lit(".mkv")).alias("path"), "started_at", (F.col("o_orderkey") % 9 - 4).alias("start_offset_ms"))
    rows = L.build_manifests(status(s, d).select("call_id", F.lit("g1").alias("guild_id"), "channel_id", "started_at", "ended_at"), tracks, videos)
    return rows.select("call_id", F.size("tracks").alias("n_tracks"), F.md5(C.written(C.MANIFEST, F.struct(*C.MANIFEST.fields))).alias("manifest_md5"))


def documents_of_status(s, d):
    """A status document of each call as JSON text. Some have an unknown status, a time that isn't in UTC or no id, a failed one says why."""
    iso = F.date_format("updated_at", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    n = F.col("o_orderkey")
    doc = F.struct(
        F.when(n % 13 == 0, "").otherwise(F.col("call_id")).alias("callId"), F.when(n % 7 == 0, "lost").otherwise(F.col("status")).alias("status"), F.when(n % 11 == 0, F.concat(F.substring(iso, 1, 19), F.lit("+02:00"))).otherwise(iso).alias("updatedAt"),
        F.when(F.col("status") == "failed", "disk full").alias("error"), F.col("thread_id").alias("threadId"), F.when(F.col("emailed_at").isNotNull(), iso).alias("emailedAt"))
    return status(s, d).select("call_id", "status", F.to_json(doc).alias("value"))


def results(s, d):
    """What the store answered to each event, with its warnings."""
    skipped = F.concat(F.lit("edge "), (F.col("pos") % 3).cast("string"), F.lit(" skipped"))
    warnings = F.when(F.col("pos") % 5 == 0, F.array(F.lit("no anchor"), skipped)).when(F.col("pos") % 7 == 0, F.array(F.lit("no anchor")))
    return view(s, d, "outbox").withColumn("warnings", warnings)


def scalars(s, d):
    ms = F.col("o_orderkey") * 7919
    start = F.col("started_at").cast("timestamp")
    return status(s, d).select(
        "call_id", T.format_timecode(ms).alias("timecode"), T.video_time_ms(ms, F.lit(50_000)).alias("video_ms"), T.seconds_to_ms(F.col("o_orderkey") / 8 - 3).alias("ms"),
        T.make_call_id(start, F.col("channel_id")).alias("made_id"), T.status_rank(F.col("status")).alias("rank"), T.is_permanent_rejection((F.col("o_orderkey") % 600).cast("int")).alias("permanent"),
        T.video_offset_ms((F.col("started_at") + F.expr("INTERVAL '3' SECOND")).cast("timestamp"), start).alias("offset_ms"))


QUERIES = {
    "humans": lambda s, d: V.humans(voice(s, d)).select("event_id", "channel_id", "user_id"),
    "trigger_match": lambda s, d: voice(s, d).select("event_id", V.trigger_match(F.col("user_id"), F.array("role_id"), USERS, ROLES).alias("matches")),
    "usable_tracks": lambda s, d: V.usable_tracks(log(s, d)).select("call_id", "seq", "user_id", "l_partkey"),
    "should_join": lambda s, d: V.should_join(snap(s, d), F.col("channel_id") == "v1", True),
    "should_leave": lambda s, d: V.should_leave(snap(s, d), F.col("channel_id") != "v1"),
    "voice_sessions": lambda s, d: V.voice_sessions(voice(s, d), USERS, ROLES),
    "armed_channels": lambda s, d: V.armed_channels(voice(s, d), channels(voice(s, d))),
    "align_bursts": lambda s, d: V.align_bursts(bursts(s, d)).select("user_id", "burst_idx", "gap_ms", "written_ms"),
    "track_totals": lambda s, d: V.track_totals(bursts(s, d), F.lit(0).cast("long")),
    "burst_sessions": lambda s, d: V.burst_sessions(bursts(s, d), 7_200_000),
    "current_status": lambda s, d: L.current_status(log(s, d), LOG_ORDER),
    "ready_queue": lambda s, d: L.ready_queue(status(s, d)).select("call_id", "channel_id"),
    "reclaim_stale": lambda s, d: L.reclaim_stale(status(s, d), NOW, 60 * 24 * 700),
    "reclaim_stranded": lambda s, d: L.reclaim_stranded(status(s, d), NOW),
    "pending_deliveries": lambda s, d: L.pending_deliveries(L.current_status(log(s, d), LOG_ORDER)).select("call_id", "needs_post", "needs_email"),
    "expired_audio": lambda s, d: L.expired(status(s, d), NOW, 900).select("call_id"),
    "expired_video": lambda s, d: L.expired(status(s, d), NOW, 400, video=True).select("call_id"),
    "status_funnel": lambda s, d: L.status_funnel(status(s, d)),
    "build_manifests": manifests,
    "validate_status": lambda s, d: documents_of_status(s, d).select("call_id", document_errors(C.STATUS, F.try_parse_json("value")).alias("errors")),
    "format_issues": lambda s, d: status(s, d).select("call_id", validate.format_issues(validate.issues(("call_id", F.length("call_id") > 3, "long"), ("status", F.col("o_orderkey") % 7 == 0, "not a status"))).alias("line")),
    "delivery_outcomes": lambda s, d: L.delivery_outcomes(view(s, d, "outbox")).select("producer", "pos", "outcome"),
    "emit_counts": lambda s, d: L.emit_counts(results(s, d)),
    "emit_warnings": lambda s, d: L.emit_warnings(results(s, d)),
    "recent_n": lambda s, d: L.recent_n(view(s, d, "emails")).select("mailbox", "uid", "pos", F.md5("subject").alias("subject_md5")),
    "scalar_calls": scalars,
    "format_addresses": lambda s, d: view(s, d, "emails").select("uid", T.format_addresses(F.array(F.struct(F.when(F.col("uid") % 2 == 0, F.col("from_name")).alias("name"), F.col("from_addr").alias("address")), F.struct(F.lit("x").alias("name"), F.lit("").alias("address")))).alias("addresses")),
}

TRIG = "(user_id IN ('u1', 'u2') OR role_id = 'r3')"
SNAP = f"""last AS (SELECT channel_id, user_id, arg_max(action, (ts, event_id)) AS action, any_value(is_bot) AS is_bot, any_value(role_id) AS role_id FROM voice_state WHERE action IN ('join', 'leave') GROUP BY 1, 2),
present AS (SELECT channel_id, count(*) FILTER (NOT is_bot) AS humans, COALESCE(bool_or(NOT is_bot AND {TRIG}), FALSE) AS any_trigger FROM last WHERE action = 'join' GROUP BY 1),
arms AS (SELECT channel_id, arg_max(action, (ts, event_id)) = 'arm' AS armed FROM voice_state WHERE action IN ('arm', 'disarm') GROUP BY 1),
snap AS (SELECT channel_id, COALESCE(humans, 0) AS humans, COALESCE(any_trigger, FALSE) AS any_trigger, COALESCE(armed, FALSE) AS armed FROM (SELECT DISTINCT channel_id FROM voice_state) c LEFT JOIN present USING (channel_id) LEFT JOIN arms USING (channel_id))
"""
SESS = f"""moves AS (SELECT *, action = 'join' AS here, COALESCE(lag(action) OVER (PARTITION BY channel_id, user_id ORDER BY ts, event_id) = 'join', FALSE) AS was FROM voice_state WHERE action IN ('join', 'leave')),
steps AS (SELECT channel_id, event_id, ts, action, CASE WHEN is_bot OR here = was THEN 0 WHEN here THEN 1 ELSE -1 END AS d, {TRIG} AS t, NULL AS cmd FROM moves
  UNION ALL SELECT channel_id, event_id, ts, action, 0, FALSE, CAST(action = 'arm' AS INT) FROM voice_state WHERE action IN ('arm', 'disarm')),
state AS (SELECT *, sum(d) OVER w AS h, sum(CASE WHEN t THEN d ELSE 0 END) OVER w AS g, COALESCE(last_value(cmd IGNORE NULLS) OVER w, 0) AS armed FROM steps WINDOW w AS (PARTITION BY channel_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
sig AS (SELECT *, CASE WHEN armed = 1 AND h > 0 AND g > 0 THEN 1 WHEN h = 0 OR action = 'disarm' THEN 0 END AS s FROM state),
rec AS (SELECT *, COALESCE(last_value(s IGNORE NULLS) OVER (PARTITION BY channel_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS r FROM sig),
flips AS (SELECT * FROM (SELECT *, COALESCE(lag(r) OVER (PARTITION BY channel_id ORDER BY ts, event_id), 0) AS b FROM rec) WHERE r <> b)
"""
BURST = "b AS (SELECT *, epoch_us(ts) // 1000 AS at_ms FROM bursts)"
ALIGN = BURST + """, o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY at_ms, burst_idx) AS i, min(at_ms) OVER (PARTITION BY user_id) AS t0 FROM b),
w AS (SELECT user_id, burst_idx, i, at_ms, 0::BIGINT AS gap_ms, dur_ms AS written_ms FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.burst_idx, o.i, o.at_ms, greatest(0, o.at_ms - o.t0 - w.written_ms), w.written_ms + greatest(0, o.at_ms - o.t0 - w.written_ms) + o.dur_ms FROM w JOIN o ON o.user_id = w.user_id AND o.i = w.i + 1)
"""
NOW_SQL = f"TIMESTAMP '{NOW}'"
CURRENT = """cur AS (SELECT call_id, arg_max(status, k) AS status, arg_max(updated_at, k) AS updated_at, CASE WHEN CAST(substr(arg_max(user_id, k), 2) AS INT) % 4 = 0 THEN 'trouble ' || arg_max(user_id, k) END AS error, arg_max(thread_id, k) FILTER (thread_id IS NOT NULL) AS thread_id, arg_max(emailed_at, k) FILTER (emailed_at IS NOT NULL) AS emailed_at
FROM (SELECT *, (seq, updated_at, l_partkey, l_suppkey, l_extendedprice) AS k FROM status_log) GROUP BY 1)
"""
DOCS = "docs AS (SELECT CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE call_id END AS call_id, call_id AS known_id, CASE WHEN o_orderkey % 7 = 0 THEN 'lost' ELSE status END AS status, o_orderkey % 11 = 0 AS bad_time, updated_at, emailed_at FROM call_status)\n"
STATUS_ERRORS = "concat_ws('; ', CASE WHEN call_id = '' THEN 'callId: empty' END, CASE WHEN status = 'lost' THEN 'status: not one of recording, ready-to-process, transcribing, summarizing, delivered, failed' END, CASE WHEN bad_time THEN 'updatedAt: not an ISO time in UTC' END)"


SQL = {
    "humans": duck("SELECT event_id, channel_id, user_id FROM voice_state WHERE NOT is_bot", "voice_state"),
    "trigger_match": duck(f"SELECT event_id, {TRIG} AS matches FROM voice_state", "voice_state"),
    "usable_tracks": duck("SELECT call_id, seq, user_id, l_partkey FROM status_log WHERE has_audio AND NOT sink_failed", "status_log"),
    "should_join": duck(SNAP + "SELECT *, armed AND humans > 0 AND any_trigger AND channel_id <> 'v1' AS \"join\" FROM snap", "voice_state"),
    "should_leave": duck(SNAP + "SELECT *, channel_id <> 'v1' AND humans = 0 AS leave FROM snap", "voice_state"),
    "voice_sessions": duck(SESS + "SELECT channel_id, CAST(ceil(n / 2.0) AS INT) AS session, ts AS started_at, e AS ended_at FROM (SELECT *, row_number() OVER w AS n, lead(ts) OVER w AS e FROM flips WINDOW w AS (PARTITION BY channel_id ORDER BY ts, event_id)) WHERE r = 1", "voice_state"),
    "armed_channels": duck("SELECT channel_id, event_id, action = 'arm' AS armed, (action = 'arm') <> COALESCE(lag(action = 'arm') OVER w, CAST(substr(channel_id, 2) AS INT) % 2 = 0) AS changed, lead(event_id) OVER w IS NULL AS latest FROM voice_state WHERE action IN ('arm', 'disarm') WINDOW w AS (PARTITION BY channel_id ORDER BY ts, event_id)", "voice_state"),
    "align_bursts": duck(ALIGN + "SELECT user_id, burst_idx, gap_ms, written_ms FROM w", "bursts", recursive=True),
    "track_totals": duck(ALIGN + "SELECT user_id, greatest(0, min(at_ms)) AS start_offset_ms, max(written_ms) AS duration_ms, count(*) AS n_bursts FROM w GROUP BY 1", "bursts", recursive=True),
    "burst_sessions": duck(BURST + """, e AS (SELECT *, max(at_ms + dur_ms) OVER (PARTITION BY user_id ORDER BY at_ms, burst_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM b),
u AS (SELECT *, sum(CASE WHEN pe IS NULL OR at_ms - pe >= 7200000 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY at_ms, burst_idx ROWS UNBOUNDED PRECEDING) AS utterance FROM e)
SELECT user_id, utterance, min(at_ms) AS start_ms, max(at_ms + dur_ms) AS end_ms, count(*) AS n_bursts FROM u GROUP BY 1, 2""", "bursts"),
    "current_status": duck(CURRENT + "SELECT * FROM cur", "status_log"),
    "ready_queue": duck("SELECT call_id, channel_id FROM call_status WHERE status = 'ready-to-process'", "call_status"),
    "reclaim_stale": duck(f"SELECT call_id, 'ready-to-process' AS status, {NOW_SQL} AS updated_at, thread_id, emailed_at FROM call_status WHERE status IN ('transcribing', 'summarizing') AND updated_at <= {NOW_SQL} - INTERVAL 1008000 MINUTE", "call_status"),
    "reclaim_stranded": duck(f"SELECT call_id, 'failed' AS status, {NOW_SQL} AS updated_at, 'capture restarted while recording' AS error, thread_id, emailed_at FROM call_status WHERE status = 'recording'", "call_status"),
    "pending_deliveries": duck(CURRENT + "SELECT call_id, thread_id IS NULL AS needs_post, emailed_at IS NULL AS needs_email FROM cur WHERE thread_id IS NULL OR emailed_at IS NULL", "status_log"),
    "expired_audio": duck(f"SELECT call_id FROM call_status WHERE status = 'delivered' AND COALESCE(ended_at, started_at) <= {NOW_SQL} - INTERVAL 900 DAY", "call_status"),
    "expired_video": duck(f"SELECT call_id FROM call_status WHERE status = 'delivered' AND has_video AND COALESCE(ended_at, started_at) <= {NOW_SQL} - INTERVAL 400 DAY", "call_status"),
    "status_funnel": duck("SELECT s AS status, CAST(r - 1 AS INT) AS rank, (SELECT count(*) FROM call_status c WHERE c.status = s) AS calls FROM (SELECT unnest(['recording', 'ready-to-process', 'transcribing', 'summarizing', 'delivered', 'failed']) AS s, generate_subscripts(['recording', 'ready-to-process', 'transcribing', 'summarizing', 'delivered', 'failed'], 1) AS r)", "call_status"),
    "build_manifests": duck("""t AS (SELECT call_id, count(*) AS n, list({'userId': user_id, 'displayName': 'Speaker ' || user_id, 'path': 'audio/' || user_id || '.pcm', 'startOffsetMs': l_partkey % 5000} ORDER BY seq, user_id, l_partkey % 5000) AS tracks
  FROM status_log WHERE has_audio AND NOT sink_failed GROUP BY 1), iso AS (SELECT *, strftime(started_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS began, strftime(ended_at, '%Y-%m-%dT%H:%M:%S.%gZ') AS ended FROM call_status),
doc AS (SELECT call_id, has_video, began, o_orderkey, COALESCE(n, 0) AS n, json_object('callId', call_id, 'guildId', 'g1', 'channelId', channel_id, 'startedAt', began, 'endedAt', ended, 'tracks', COALESCE(tracks, [])) AS body FROM iso LEFT JOIN t USING (call_id))
SELECT call_id, CAST(n AS INT) AS n_tracks, md5(CASE WHEN has_video THEN left(body, length(body) - 1) || ',"video":' || json_object('path', call_id || '.mkv', 'startedAt', began, 'startOffsetMs', o_orderkey % 9 - 4) || '}' ELSE body END) AS manifest_md5 FROM doc""", "status_log", "call_status"),
    "validate_status": duck(DOCS + f"SELECT known_id AS call_id, {STATUS_ERRORS} AS errors FROM docs", "call_status"),
    "format_issues": duck(DOCS + "SELECT known_id AS call_id, concat_ws('; ', CASE WHEN length(known_id) > 3 THEN 'call_id: long' END, CASE WHEN status = 'lost' THEN 'status: not a status' END) AS line FROM docs", "call_status"),
    "delivery_outcomes": duck("SELECT producer, pos, CASE WHEN first IS NOT NULL AND pos >= first THEN 'pending' WHEN http_status BETWEEN 200 AND 299 THEN 'delivered' ELSE 'parked' END AS outcome FROM (SELECT *, min(pos) FILTER (http_status IN (408, 429) OR http_status >= 500) OVER (PARTITION BY producer) AS first FROM outbox)", "outbox"),
    "emit_counts": duck("SELECT producer, sum(n_ids) AS memories, sum(COALESCE(edges, 0)) AS edges, sum(CASE WHEN pos % 5 = 0 THEN 2 WHEN pos % 7 = 0 THEN 1 ELSE 0 END) AS warnings FROM outbox GROUP BY 1", "outbox"),
    "emit_warnings": duck("SELECT producer, warning, count(*) AS n FROM (SELECT producer, unnest(CASE WHEN pos % 5 = 0 THEN ['no anchor', 'edge ' || pos % 3 || ' skipped'] WHEN pos % 7 = 0 THEN ['no anchor'] ELSE [] END) AS warning FROM outbox) GROUP BY 1, 2", "outbox"),
    "recent_n": duck("SELECT mailbox, uid, pos, md5(COALESCE(subject, '(no subject)')) AS subject_md5 FROM (SELECT *, row_number() OVER (PARTITION BY mailbox ORDER BY uid DESC) AS pos FROM emails) WHERE pos <= 10", "emails"),
    "scalar_calls": duck("""x AS (SELECT *, o_orderkey * 7919 AS ms FROM call_status)
SELECT call_id, lpad(CAST(ms // 60000 AS VARCHAR), CAST(greatest(2, length(CAST(ms // 60000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') AS timecode, greatest(0, ms - 50000) AS video_ms,
greatest(0, CAST(floor((o_orderkey / 8 - 3) * 1000 + 0.5) AS BIGINT)) AS ms, strftime(started_at, '%Y-%m-%dT%H-%M-%S') || '-000Z--' || channel_id AS made_id,
CAST(list_position(['recording', 'ready-to-process', 'transcribing', 'summarizing', 'delivered', 'failed'], status) - 1 AS INT) AS rank, o_orderkey % 600 BETWEEN 400 AND 499 AND o_orderkey % 600 NOT IN (408, 429) AS permanent, 3000::BIGINT AS offset_ms FROM x""", "call_status"),
    "format_addresses": duck("SELECT uid, CASE WHEN uid % 2 = 0 THEN from_name || ' <' || from_addr || '>' ELSE from_addr END AS addresses FROM emails", "emails"),
}
