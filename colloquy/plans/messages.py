"""Queries over messages, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import messages as M

from .views import AGENT, duck, view


def _numbered(rows: DataFrame, column: str, name: str, base: int, rest: int) -> DataFrame:
    """The distinct ids of a column whose number leaves ``rest`` when divided by ``base``."""
    return rows.select(F.col(column).alias(name)).where(F.substring(name, 2, 20).cast("bigint") % base == rest).distinct()


def channels(rows: DataFrame) -> DataFrame:
    """Channels of ``rows`` with even numbers are allowed."""
    return _numbered(rows, "channel_id", "channel_id", 2, 0)


def optout(rows: DataFrame, column: str = "author_id") -> DataFrame:
    """Users of ``rows`` with a number that ends in 3 opted out."""
    return _numbered(rows, column, "user_id", 10, 3)


def raw(spark, d):
    return view(spark, d, "raw_messages").withColumn("mentions", F.array("mention_1", "mention_2"))


def normal(spark, d):
    return M.normalize_messages(raw(spark, d))


def ids(spark, d):
    """Channels and authors of raw messages, from columns that need no text."""
    return view(spark, d, "raw_messages").select(F.coalesce("parent_id", "raw_channel_id").alias("channel_id"), "author_id", "mention_1", "mention_2")


def feed(spark, d):
    """Raw messages, edits and deletes with mentions and attachments."""
    file = F.struct(F.col("media_id").alias("id"), "url", "filename", "content_type")
    rows = view(spark, d, "feed").withColumn("mentions", F.when(F.col("mention_1").isNotNull(), F.array("mention_1", "mention_2"))).withColumn("attachments", F.when(F.col("media_id").isNotNull(), F.array(file)))
    return rows.drop("mention_1", "mention_2", "media_id", "url", "filename", "content_type")


def feed_consent(spark, d):
    """(channels allowed, users opted out) of the feed."""
    rows = view(spark, d, "feed").select(F.coalesce("parent_id", "raw_channel_id").alias("channel_id"), F.explode(F.array("author_id", "mention_1", "mention_2")).alias("author_id")).where("author_id is not null")
    return channels(rows), optout(rows)


def log(spark, d):
    out = view(spark, d, "message_log").withColumn("source_ref", M.source_ref())
    return out.withColumn("event_key", M.event_key(F.col("kind"), F.col("source_ref"), F.col("ts")))


def cursors(spark, d):
    """A cursor for each channel: the middle of its messages."""
    return normal(spark, d).groupBy("channel_id").agg(F.floor(F.median("seq")).alias("before"))


def backfilled(spark, d):
    """The history in two walks: the first stops after three pages a channel, the second goes on from the cursors that it left."""
    rows = normal(spark, d)
    first = M.history_pages(rows).where("page < 3")
    rest = M.history_pages(rows, M.next_cursors(first))
    walked = first.unionByName(rest)
    stored = M.gate_with_reason(walked, channels(ids(spark, d)), optout(ids(spark, d))).where("skip_reason is null")
    return M.message_events(stored).select("event_type", "source_ref", "ts", "author_id")


def gated(spark, d):
    return M.gate_with_reason(normal(spark, d), channels(ids(spark, d)), optout(ids(spark, d)))


ALLOWED = "CAST(substr(channel_id, 2) AS INT) % 2 = 0"
OUT = "CAST(substr(author_id, 2) AS INT) % 10 = 3"
NORMAL = """normal AS (
  SELECT message_id, seq, guild_id, COALESCE(parent_id, raw_channel_id) AS channel_id, CASE WHEN parent_id IS NOT NULL THEN raw_channel_id END AS thread_id,
         author_id, COALESCE(member_name, username, author_id) AS author_name, content, ts, reply_to, mention_1, mention_2
  FROM raw_messages WHERE NOT is_partial AND NOT author_is_bot AND NOT is_system AND guild_id IS NOT NULL AND trim(content, ' \t\n') <> ''),
gated AS (SELECT *, CASE WHEN NOT (%s) THEN 'channel-not-allowed' WHEN %s THEN 'author-opted-out' END AS skip_reason FROM normal)
""" % (ALLOWED, OUT)
REF = "'discord://channel/' || channel_id || '/message/' || message_id"
LOG = f"""log AS (
  SELECT *, {REF} AS source_ref,
         CASE kind WHEN 'edit' THEN {REF} || '|edit|' || epoch_us(ts) WHEN 'delete' THEN {REF} || '|delete' ELSE {REF} END AS event_key
  FROM message_log)"""
LATEST = LOG + """, newest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY ts DESC, event_id DESC) AS rn FROM log WHERE kind IN ('create', 'edit')) WHERE rn = 1),
latest AS (SELECT * FROM newest WHERE source_ref NOT IN (SELECT source_ref FROM log WHERE kind = 'delete'))"""


ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%gZ')"
MEDIA = f"CASE WHEN content_type <> '' THEN content_type LIKE 'image/%' OR content_type LIKE 'video/%' ELSE regexp_matches(filename, '{T.MEDIA_FILE}') END"
#: What leaves for the store of the feed: event_type, source_ref, event_key, ts, message_id and event.
FEED = f"""said AS (SELECT *, {REF} AS source_ref FROM (SELECT *, COALESCE(parent_id, raw_channel_id) AS channel_id, CASE WHEN parent_id IS NOT NULL THEN raw_channel_id END AS thread_id, COALESCE(member_name, username, author_id) AS author_name
  FROM feed WHERE kind <> 'delete' AND NOT is_partial AND NOT author_is_bot AND NOT is_system AND guild_id IS NOT NULL AND (trim(content) <> '' OR media_id IS NOT NULL))),
let AS (SELECT * FROM said WHERE {ALLOWED} AND NOT ({OUT})),
sent AS (SELECT 'message' AS event_type, source_ref, CASE kind WHEN 'edit' THEN source_ref || '|edit|' || epoch_us(ts) ELSE source_ref END AS event_key, ts, message_id,
  '{{"type":"message","message_id":"' || message_id || '","channel_id":"' || channel_id || '","author_id":"' || author_id || '","author_name":"' || author_name || '","content":' || to_json(content) || ',"guild_id":"' || guild_id || '"' || COALESCE(',"thread_id":"' || thread_id || '"', '')
  || COALESCE(',"reply_to":"' || reply_to || '"', '') || ',"mentions":' || to_json(CASE WHEN mention_1 IS NULL THEN [] ELSE list_filter([mention_1, mention_2], lambda x: CAST(substr(x, 2) AS INT) % 10 <> 3) END) || ',"edited":' || (kind = 'edit') || ',"timestamp":"' || {ISO} || '","region":"discord"}}' AS event
  FROM let WHERE trim(content) <> ''
UNION ALL SELECT 'media', 'media|' || media_id, 'media|' || media_id, ts, message_id, '{{"type":"media","media_id":"' || media_id || '","url":"' || url || '","filename":"' || filename || '"' || COALESCE(',"content_type":"' || content_type || '"', '') || ',"channel_id":"' || channel_id || '","message_id":"' || message_id || '","region":"discord"}}'
  FROM let WHERE media_id IS NOT NULL AND {MEDIA}
UNION ALL SELECT 'member', 'member|' || author_id, 'member|' || author_id, ts, NULL, '{{"type":"member","member_id":"' || author_id || '","display_name":"' || author_name || '","region":"discord"}}'
  FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY ts, message_id) AS rn FROM said) WHERE rn = 1 AND NOT ({OUT})
UNION ALL SELECT 'tombstone-request', {REF}, {REF} || '|delete', ts, message_id, '{{"type":"tombstone-request","target":"' || {REF} || '","reason":"discord message deleted"}}'
  FROM (SELECT *, COALESCE(parent_id, raw_channel_id) AS channel_id FROM feed WHERE kind = 'delete' AND guild_id IS NOT NULL))
"""


def _digest(df, *cols):
    """Long texts by digest, so that results stay small."""
    return df.select(*cols, F.md5("content").alias("content_md5"))


def _payload(df, *cols):
    """JSON by digest."""
    return df.select(*cols, F.md5(M.payload(df)).alias("event_md5"))


def events(spark, d):
    """All that leaves for the store of the feed."""
    return M.ingest(feed(spark, d), *feed_consent(spark, d), members=True)


QUERIES = {
    "normalize_messages": lambda s, d: _digest(normal(s, d), "message_id", "guild_id", "channel_id", "thread_id", "author_id", "author_name", "ts", "reply_to", F.array_join("mentions", ",").alias("mentions")),
    "normalize_deletes": lambda s, d: M.normalize_deletes(view(s, d, "message_log").where("kind = 'delete'").withColumn("guild_id", F.when(F.col("event_id") % 23 != 0, "g1"))),
    "message_events": lambda s, d: _payload(M.message_events(M.scrub_mentions(normal(s, d), optout(ids(s, d).select(F.explode(F.array("mention_1", "mention_2")).alias("mention")), "mention"))), "event_type", "source_ref", "ts"),
    "media_events": lambda s, d: _payload(M.media_events(view(s, d, "attachments").withColumn("channel_id", F.concat(F.lit("c"), F.substring("message_id", -1, 1)))), "event_type", "source_ref", "filename", "content_type"),
    "tombstone_events": lambda s, d: _payload(M.tombstone_events(view(s, d, "message_log").where("kind = 'delete'")), "event_type", "source_ref", "region", "ts"),
    "member_events": lambda s, d: _payload(M.member_events(M.first_seen_members(log(s, d).withColumn("author_name", F.concat(F.lit("Nick "), "author_id")), ["ts", "event_id"]), optout(log(s, d))), "event_type", "source_ref", "region", "ts", "author_id"),
    "route_inbound": lambda s, d: M.route_inbound(raw(s, d), AGENT).select("message_id", "author_id", F.col("guild_id").isNull().alias("is_dm")),
    "render_inbound": lambda s, d: view(s, d, "emails").select("uid", F.md5(M.render_inbound(F.when(F.col("uid") % 3 == 0, "email").when(F.col("uid") % 3 == 1, "channel").otherwise("dm"), F.col("from_name"), F.col("subject"), F.col("mailbox"))).alias("rendered_md5")),
    "display_names": lambda s, d: M.latest_names(raw(s, d).select(F.coalesce("parent_id", "raw_channel_id").alias("call_id"), F.col("author_id").alias("user_id"), F.coalesce("member_name", F.lit("")).alias("name"), "ts", F.col("seq").alias("event_id"))),
    "gate_channel": lambda s, d: M.gate_channel(normal(s, d), channels(ids(s, d))).select("message_id", "channel_id"),
    "gate_member": lambda s, d: M.gate_member(normal(s, d), optout(ids(s, d))).select("message_id", "author_id"),
    "gate_with_reason": lambda s, d: gated(s, d).select("message_id", "channel_id", "author_id", "skip_reason"),
    "scrub_mentions": lambda s, d: M.scrub_mentions(normal(s, d), optout(ids(s, d).select(F.explode(F.array("mention_1", "mention_2")).alias("mention")), "mention")).select("message_id", F.array_join("mentions", ",").alias("mentions")),
    "dedupe_against_store": lambda s, d: M.dedupe_against_store(log(s, d), log(s, d).where("event_id % 3 = 0"), ["ts", "event_id"]).select("event_key", "event_id", "kind"),
    "reply_edges": lambda s, d: M.reply_edges(normal(s, d)),
    "skip_report": lambda s, d: M.skip_report(gated(s, d)),
    "backfill_progress": lambda s, d: M.backfill_progress(gated(s, d)),
    "history_backfill": backfilled,
    "keyset_page": lambda s, d: M.keyset_page(normal(s, d), cursors(s, d)).select("message_id", "channel_id", "seq", "page_pos"),
    "history_pages": lambda s, d: M.history_pages(normal(s, d)).select("message_id", "channel_id", "seq", "page", "page_pos"),
    "walk_targets": lambda s, d: M.walk_targets(raw(s, d)),
    "first_seen_members": lambda s, d: M.first_seen_members(log(s, d), ["ts", "event_id"]).select("author_id", "event_id", "ts"),
    "latest_version": lambda s, d: M.latest_version(log(s, d)).select("source_ref", "event_id", "kind", "ts", "value"),
    "ingest": lambda s, d: events(s, d).select("event_type", "source_ref", "event_key", "ts", F.md5("event").alias("event_md5")),
    "live_union_history": lambda s, d: M.live_union_history(log(s, d).where("event_id % 5 < 3"), log(s, d).where("event_id % 5 >= 2")).select("source_ref", "event_id", "kind", "ts"),
    "scalar_messages": lambda s, d: raw(s, d).select("message_id", T.estimate_tokens(F.col("content")).alias("tokens"), F.md5(T.truncate_tokens(F.col("content"), 10)).alias("cut_md5"), F.md5(T.truncate_ellipsis(F.col("content"), 50)).alias("short_md5"), F.md5(T.segment_line(F.col("username"), F.col("content"))).alias("line_md5"), T.message_source_ref(F.col("raw_channel_id"), F.col("message_id")).alias("source_ref"), F.md5(T.ws_trim(F.col("content"))).alias("trim_md5"), F.md5(T.thread_name(F.col("content"))).alias("thread_md5")),
}

N = ("raw_messages",)
SQL = {
    "normalize_messages": duck(NORMAL + "SELECT message_id, guild_id, channel_id, thread_id, author_id, author_name, ts, reply_to, mention_1 || ',' || mention_2 AS mentions, md5(content) AS content_md5 FROM normal", *N),
    "normalize_deletes": duck("SELECT 'g1' AS guild_id, channel_id, message_id, ts FROM message_log WHERE kind = 'delete' AND event_id % 23 <> 0", "message_log"),
    "message_events": duck(NORMAL + f"""SELECT 'message' AS event_type, {REF} AS source_ref, ts, md5('{{"type":"message","message_id":"' || message_id || '","channel_id":"' || channel_id || '","author_id":"' || author_id || '","author_name":"' || author_name || '","content":' || to_json(content) || ',"guild_id":"' || guild_id
 || '"' || COALESCE(',"thread_id":"' || thread_id || '"', '') || COALESCE(',"reply_to":"' || reply_to || '"', '') || ',"mentions":' || to_json(list_filter([mention_1, mention_2], lambda x: CAST(substr(x, 2) AS INT) % 10 <> 3)) || ',"edited":false,"timestamp":"' || {ISO} || '","region":"discord"}}') AS event_md5 FROM normal""", *N),
    "media_events": duck(f"""SELECT 'media' AS event_type, 'media|' || media_id AS source_ref, filename, content_type, md5('{{"type":"media","media_id":"' || media_id || '","url":' || to_json(url) || ',"filename":"' || filename || '"' || COALESCE(',"content_type":"' || content_type || '"', '')
 || ',"channel_id":"c' || right(message_id, 1) || '","message_id":"' || message_id || '","region":"discord"}}') AS event_md5 FROM attachments WHERE {MEDIA}""", "attachments"),
    "tombstone_events": duck(f"""SELECT 'tombstone-request' AS event_type, {REF} AS source_ref, 'discord' AS region, ts, md5('{{"type":"tombstone-request","target":"' || {REF} || '","reason":"discord message deleted"}}') AS event_md5 FROM message_log WHERE kind = 'delete'""", "message_log"),
    "member_events": duck(f"""SELECT 'member' AS event_type, 'member|' || author_id AS source_ref, 'discord' AS region, ts, author_id, md5('{{"type":"member","member_id":"' || author_id || '","display_name":"Nick ' || author_id || '","region":"discord"}}') AS event_md5
FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY ts, event_id) AS rn FROM message_log) WHERE rn = 1 AND NOT ({OUT})""", "message_log"),
    "ingest": duck(FEED + "SELECT event_type, source_ref, event_key, ts, md5(event) AS event_md5 FROM sent", "feed"),
    "route_inbound": duck("SELECT message_id, author_id, guild_id IS NULL AS is_dm FROM raw_messages WHERE NOT author_is_bot AND NOT is_system AND (guild_id IS NULL OR mention_1 = 'u0' OR mention_2 = 'u0')", *N),
    "render_inbound": duck("""SELECT uid, md5(CASE uid % 3 WHEN 0 THEN 'Email from ' || from_name || chr(10) || 'Subject: ' || COALESCE(subject, '(no subject)') || chr(10) || chr(10) || mailbox
WHEN 1 THEN 'Channel message from ' || from_name || ':' || chr(10) || mailbox ELSE 'Direct message from ' || from_name || ':' || chr(10) || mailbox END) AS rendered_md5 FROM emails""", "emails"),
    "display_names": duck("SELECT COALESCE(parent_id, raw_channel_id) AS call_id, author_id AS user_id, arg_max(member_name, seq) AS name FROM raw_messages WHERE member_name IS NOT NULL GROUP BY 1, 2", *N),
    "gate_channel": duck(NORMAL + f"SELECT message_id, channel_id FROM normal WHERE {ALLOWED}", *N),
    "gate_member": duck(NORMAL + f"SELECT message_id, author_id FROM normal WHERE NOT ({OUT})", *N),
    "gate_with_reason": duck(NORMAL + "SELECT message_id, channel_id, author_id, skip_reason FROM gated", *N),
    "scrub_mentions": duck(NORMAL + "SELECT message_id, COALESCE(array_to_string(list_filter([mention_1, mention_2], lambda x: CAST(substr(x, 2) AS INT) % 10 <> 3), ','), '') AS mentions FROM normal", *N),
    "dedupe_against_store": duck(LOG + "SELECT event_key, event_id, kind FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY ts, event_id) AS rn FROM log WHERE event_key NOT IN (SELECT event_key FROM log WHERE event_id % 3 = 0)) WHERE rn = 1", "message_log"),
    "reply_edges": duck(NORMAL + f"SELECT a.message_id, a.reply_to, 'discord://channel/' || a.channel_id || '/message/' || a.message_id AS source_ref, 'discord://channel/' || b.channel_id || '/message/' || b.message_id AS target_ref FROM normal a LEFT JOIN normal b ON a.reply_to = b.message_id WHERE a.reply_to IS NOT NULL", *N),
    "skip_report": duck(NORMAL + "SELECT channel_id, count(*) FILTER (skip_reason IS NULL) AS emitted, count(*) FILTER (skip_reason = 'channel-not-allowed') AS denied, count(*) FILTER (skip_reason = 'author-opted-out') AS opted_out FROM gated GROUP BY 1", *N),
    "backfill_progress": duck(NORMAL + "SELECT channel_id, count(*) AS walked, count(*) FILTER (skip_reason IS NULL) AS stored, min(seq) AS oldest, TRUE AS done FROM gated WHERE seq >= 0 GROUP BY 1", *N),
    "history_backfill": duck(NORMAL + f"SELECT 'message' AS event_type, {REF} AS source_ref, ts, author_id FROM gated WHERE skip_reason IS NULL", *N),
    "keyset_page": duck(NORMAL + ", cut AS (SELECT channel_id, CAST(floor(median(seq)) AS BIGINT) AS before FROM normal GROUP BY 1) SELECT message_id, channel_id, seq, CAST(page_pos AS INT) AS page_pos FROM (SELECT n.*, row_number() OVER (PARTITION BY channel_id ORDER BY seq DESC) AS page_pos FROM normal n JOIN cut USING (channel_id) WHERE seq < before) WHERE page_pos <= 100", *N),
    "history_pages": duck(NORMAL + "SELECT message_id, channel_id, seq, CAST((n - 1) // 100 AS INT) AS page, CAST((n - 1) % 100 + 1 AS INT) AS page_pos FROM (SELECT *, row_number() OVER (PARTITION BY channel_id ORDER BY seq DESC) AS n FROM normal)", *N),
    "walk_targets": duck("SELECT DISTINCT raw_channel_id AS target_id, COALESCE(parent_id, raw_channel_id) AS channel_id, CASE WHEN parent_id IS NULL THEN 'channel' ELSE 'thread' END AS kind FROM raw_messages", *N),
    "first_seen_members": duck("SELECT author_id, event_id, ts FROM (SELECT *, row_number() OVER (PARTITION BY author_id ORDER BY ts, event_id) AS rn FROM message_log) WHERE rn = 1", "message_log"),
    "latest_version": duck(LATEST + "SELECT source_ref, event_id, kind, ts, value FROM latest", "message_log"),
    "live_union_history": duck(LOG + """, once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY ts, event_id) AS n FROM log) WHERE n = 1),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source_ref ORDER BY ts DESC, event_id DESC) AS rn FROM once WHERE kind IN ('create', 'edit')) WHERE rn = 1)
SELECT source_ref, event_id, kind, ts FROM newest WHERE source_ref NOT IN (SELECT source_ref FROM once WHERE kind = 'delete')""", "message_log"),
    "scalar_messages": duck(f"""SELECT message_id, CAST(ceil(length(content) / 4.0) AS BIGINT) AS tokens, md5(substr(content, 1, 40)) AS cut_md5, md5(CASE WHEN length(content) <= 50 THEN content ELSE substr(content, 1, 49) || '…' END) AS short_md5,
md5(username || ': ' || content) AS line_md5, 'discord://channel/' || raw_channel_id || '/message/' || message_id AS source_ref, md5(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) AS trim_md5, md5(substr('Call summary — ' || content, 1, 100)) AS thread_md5 FROM raw_messages""", *N),
}
