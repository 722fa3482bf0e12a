"""The domain's tables as views on the supplied tables, in SQL that Spark and DuckDB read alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

NOW = "2001-08-01 00:00:00"
AGENT = "u0"
#: Of a call: tokens up to which it is summarised in one pass, and of a chunk. Calls in these tables are short.
SINGLE_PASS, CHUNK = 300, 100

VIEWS = {
    "raw_messages": """
SELECT CONCAT('m', CAST(doc_id AS STRING)) AS message_id, doc_id AS seq,
       CASE WHEN doc_id % 23 = 0 THEN NULL ELSE 'g1' END AS guild_id,
       CASE WHEN doc_id % 7 = 0 THEN CONCAT('t', CAST(doc_id % 49 AS STRING)) ELSE CONCAT('c', CAST(doc_id % 20 AS STRING)) END AS raw_channel_id,
       CASE WHEN doc_id % 7 = 0 THEN CONCAT('c', CAST(doc_id % 20 AS STRING)) END AS parent_id,
       CONCAT('u', CAST(doc_id % 37 AS STRING)) AS author_id,
       doc_id % 37 = 36 AS author_is_bot, doc_id % 31 = 0 AS is_system, doc_id % 29 = 0 AS is_partial,
       CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CONCAT('Nick ', CAST(doc_id % 37 AS STRING)) END AS member_name,
       CONCAT('user', CAST(doc_id % 37 AS STRING)) AS username,
       CASE WHEN doc_id % 13 = 0 THEN '  ' ELSE text END AS content,
       TIMESTAMP '2024-01-01 00:00:00' + INTERVAL '1' MINUTE * CAST(doc_id AS INT) AS ts,
       CASE WHEN doc_id % 3 = 0 AND doc_id > 0 THEN CONCAT('m', CAST(doc_id - 1 AS STRING)) END AS reply_to,
       CONCAT('u', CAST((doc_id * 7) % 37 AS STRING)) AS mention_1,
       CONCAT('u', CAST((doc_id * 11 + 3) % 37 AS STRING)) AS mention_2
FROM documents""",
    "message_log": """
SELECT event_id, ts, CONCAT('u', CAST(user_id AS STRING)) AS author_id,
       CONCAT('c', CAST(CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) % 10 AS STRING)) AS channel_id,
       CONCAT('m', regexp_extract(props, '([0-9]+)', 1)) AS message_id,
       CASE event_type WHEN 'view' THEN 'create' WHEN 'click' THEN 'edit' WHEN 'error' THEN 'delete' WHEN 'signup' THEN 'member' ELSE 'media' END AS kind,
       value
FROM events""",
    "feed": """
SELECT event_id AS seq, ts, CASE WHEN event_id % 23 = 0 THEN NULL ELSE 'g1' END AS guild_id,
       CASE WHEN event_id % 11 = 0 THEN CONCAT('t', CAST(event_id % 49 AS STRING)) ELSE CONCAT('c', CAST(user_id % 12 AS STRING)) END AS raw_channel_id,
       CASE WHEN event_id % 11 = 0 THEN CONCAT('c', CAST(user_id % 12 AS STRING)) END AS parent_id,
       CONCAT('u', CAST(user_id AS STRING)) AS author_id, user_id % 37 = 36 AS author_is_bot, event_id % 31 = 0 AS is_system, event_id % 29 = 0 AS is_partial,
       CASE WHEN user_id % 5 = 0 THEN NULL ELSE CONCAT('Nick ', CAST(user_id AS STRING)) END AS member_name, CONCAT('user', CAST(user_id AS STRING)) AS username,
       CASE event_type WHEN 'click' THEN 'edit' WHEN 'error' THEN 'delete' ELSE 'create' END AS kind,
       CONCAT('m', CAST(CASE WHEN event_type IN ('click', 'error') THEN event_id - event_id % 4 ELSE event_id END AS STRING)) AS message_id,
       CASE WHEN event_type = 'purchase' THEN ' ' ELSE CONCAT('said "', CAST(event_id AS STRING), '"') END AS content,
       CASE WHEN event_id % 3 = 0 THEN CONCAT('m', CAST(event_id - 1 AS STRING)) END AS reply_to,
       CASE WHEN event_id % 2 = 0 THEN CONCAT('u', CAST((user_id + 7) % 50 AS STRING)) END AS mention_1, CASE WHEN event_id % 2 = 0 THEN CONCAT('u', CAST(event_id % 50 AS STRING)) END AS mention_2,
       CASE WHEN event_type = 'purchase' THEN CONCAT('a', CAST(event_id AS STRING)) END AS media_id, CONCAT('https://files/', CAST(event_id AS STRING)) AS url,
       CASE event_id % 3 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN 'notes.txt' ELSE 'x.webp' END AS filename,
       CASE event_id % 4 WHEN 0 THEN 'image/png' WHEN 1 THEN '' WHEN 2 THEN NULL ELSE 'text/plain' END AS content_type
FROM events""",
    "raw_segments": """
SELECT CONCAT('call-', CAST(conv_id AS STRING)) AS call_id, conv_id,
       CONCAT(role, '-', CAST(conv_id % 5 AS STRING)) AS user_id, role AS display_name,
       CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 1 ELSE 2 END AS track_idx,
       CASE role WHEN 'system' THEN 0 WHEN 'user' THEN 500 ELSE 1500 END AS start_offset_ms,
       CAST(turn AS INT) AS seg_idx, turn * 1000 AS start_ms,
       turn * 1000 + 40 * LEAST(length(text), 200) AS end_ms,
       CASE WHEN conv_id % 19 = 0 OR (conv_id + turn) % 9 = 0 THEN '  ' ELSE text END AS text,
       CASE WHEN conv_id % 2 = 0 THEN (conv_id % 5 - 2) * 1000 END AS video_offset_ms,
       CONCAT('c', CAST(conv_id % 20 AS STRING)) AS channel_id
FROM conversations""",
    "call_status": """
SELECT CAST(o_orderkey AS STRING) AS call_id, o_orderkey, CONCAT('c', CAST(o_custkey % 20 AS STRING)) AS channel_id,
       CASE WHEN o_orderstatus = 'F' THEN 'delivered'
            WHEN o_orderstatus = 'P' AND o_orderkey % 2 = 0 THEN 'transcribing'
            WHEN o_orderstatus = 'P' THEN 'summarizing'
            WHEN o_orderkey % 3 = 0 THEN 'recording' WHEN o_orderkey % 3 = 1 THEN 'ready-to-process' ELSE 'failed' END AS status,
       o_orderdate AS updated_at, o_orderdate AS started_at,
       CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_orderdate + INTERVAL '1' DAY * CAST(o_orderkey % 3 AS INT) END AS ended_at,
       CASE WHEN o_orderkey % 2 = 0 THEN CONCAT('th-', CAST(o_orderkey AS STRING)) END AS thread_id,
       CASE WHEN o_orderkey % 5 = 0 THEN o_orderdate END AS emailed_at,
       o_orderkey % 3 = 0 AS has_video
FROM orders""",
    "status_log": """
SELECT CAST(l_orderkey AS STRING) AS call_id, l_linenumber AS seq, CONCAT('s', CAST(l_suppkey AS STRING)) AS user_id,
       CASE l_linenumber WHEN 1 THEN 'recording' WHEN 2 THEN 'ready-to-process' WHEN 3 THEN 'transcribing' WHEN 4 THEN 'summarizing' ELSE 'delivered' END AS status,
       l_shipdate AS updated_at, l_partkey, l_suppkey, l_extendedprice,
       CASE WHEN l_returnflag = 'R' THEN CONCAT('th-', CAST(l_orderkey AS STRING)) END AS thread_id,
       CASE WHEN l_linestatus = 'O' THEN l_shipdate END AS emailed_at,
       l_quantity > 5 AS has_audio, l_returnflag = 'A' AS sink_failed
FROM lineitem""",
    "voice_state": """
SELECT event_id, ts, CONCAT('v', CAST(user_id % 4 AS STRING)) AS channel_id, CONCAT('u', CAST(user_id AS STRING)) AS user_id,
       user_id % 10 = 9 AS is_bot, CONCAT('r', CAST(user_id % 6 AS STRING)) AS role_id,
       CASE event_type WHEN 'signup' THEN 'join' WHEN 'purchase' THEN 'join' WHEN 'error' THEN 'leave' WHEN 'click' THEN 'arm' ELSE 'disarm' END AS action
FROM events""",
    "bursts": """
SELECT CONCAT('u', CAST(user_id AS STRING)) AS user_id, event_id AS burst_idx, ts,
       CAST(floor(value) AS BIGINT) * 60000 AS dur_ms
FROM events""",
    "memories": """
SELECT vec_id AS memory_id, embedding, CONCAT('region', CAST(label % 3 AS STRING)) AS region, vec_id % 100 = 0 AS is_query
FROM embeddings""",
    "attachments": """
SELECT CONCAT('a', CAST(page_id AS STRING)) AS media_id, url, CONCAT('m', CAST(page_id * 2 AS STRING)) AS message_id,
       CASE page_id % 6 WHEN 0 THEN 'clip.MP4' WHEN 1 THEN 'notes.txt' WHEN 2 THEN 'photo.jpeg' WHEN 3 THEN 'movie.mp4' WHEN 4 THEN 'x.webp' ELSE 'noext' END AS filename,
       CASE page_id % 5 WHEN 0 THEN 'image/png' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'application/octet-stream' WHEN 3 THEN '' END AS content_type
FROM pages""",
    "outbox": """
SELECT event_id AS pos, CONCAT('p', CAST(user_id % 8 AS STRING)) AS producer,
       CASE WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 90 THEN 200
            WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 96 THEN 400
            WHEN CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) < 98 THEN 429 ELSE 503 END AS http_status,
       event_id % 4 AS n_ids, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id % 5 END AS edges
FROM events""",
    "emails": """
SELECT doc_id AS uid, lang AS mailbox, source AS from_name, CONCAT(source, '@example.org') AS from_addr, CASE WHEN doc_id % 11 = 0 THEN NULL ELSE substring(text, 1, 60) END AS subject
FROM documents""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A domain table."""
    sql = VIEWS[name]
    source = re.search(r"FROM (\w+)\s*$", sql).group(1)
    return spark.sql(sql[: sql.rindex("FROM")] + "FROM {source}", source=spark.read.parquet(f"{sf_dir}/{source}.parquet"))


def duck(body: str, *names: str, recursive: bool = False) -> str:
    """SQL for DuckDB: ``body`` (which may begin with further common tables, "x AS (...), ... SELECT") after the views it reads."""
    parts = ", ".join(f"{n} AS ({VIEWS[n]})" for n in names)
    joint = "," if not body.lstrip().upper().startswith("SELECT") else ""
    return f"WITH {'RECURSIVE ' if recursive else ''}{parts}{joint} {body}"
