"""Queries over summaries, the memory graph and recall, with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.operators import graph as G
from colloquy.operators import messages as M
from colloquy.operators import recall as R
from colloquy.operators import summary as S
from colloquy.operators import transcript as C
from colloquy.sources import io

from .calls import calls, merged, segments
from .calls import CLOCK, MERGED, NOTES_ONLY, tracks
from .calls import optout as silenced
from .messages import FEED, LOG, NORMAL, REF, channels, events, log, normal
from .views import CHUNK, duck, view


def names(s, d):
    """Speakers of each call, in order of their names."""
    return segments(s, d).groupBy("call_id", "conv_id").agg(F.array_sort(F.collect_set("display_name")).alias("names"), F.min_by("text", "seg_idx").alias("first_text"))


def model_output(s, d):
    """One answer of a summarising model a call: some fenced, some cut in half, some without an owner or with an empty name."""
    name = lambda x: F.struct(F.when(F.col("conv_id") % 7 != 0, x).alias("owner"), F.concat(F.lit("do "), x).alias("item"))
    item = lambda x: F.struct(x.alias("owner"), F.concat(F.lit("do "), x).alias("item"))
    none = F.array().cast("array<string>")
    full = F.struct(F.when(F.col("conv_id") % 11 == 0, " ").otherwise("An overview").alias("overview"), F.col("names").alias("keyTopics"), F.array(F.substring("first_text", 1, 40)).alias("decisions"), none.alias("openQuestions"), F.transform("names", name).alias("actionItems"))
    speaker = lambda x: F.struct(F.when(F.col("conv_id") % 13 != 0, x).otherwise("").alias("displayName"), F.array(F.lit("spoke")).alias("contributions"), none.alias("positionsConcerns"), F.array(item(x)).alias("actionItems"))
    body = F.to_json(F.struct(full.alias("fullCall"), F.transform("names", speaker).alias("perSpeaker")))
    cut = F.when(F.col("conv_id") % 5 == 0, F.substring(body, F.lit(1), F.floor(F.length(body) / 2).cast("int"))).otherwise(body)
    raw = F.when(F.col("conv_id") % 3 == 0, F.concat(F.lit("```json\n"), cut, F.lit("\n```"))).otherwise(cut)
    return names(s, d).select("call_id", "conv_id", raw.alias("raw"))


def summaries(s, d):
    return S.validated(model_output(s, d))[0]


def out_names(s, d):
    """Names of users who opted out (ids ending in -3) in each call."""
    return segments(s, d).where("user_id like '%-3'").groupBy("call_id").agg(F.collect_set("display_name").alias("names"))


def shown(s, d):
    """Valid summaries, every other one of a call with a video."""
    return summaries(s, d).withColumn("video", F.when(F.col("conv_id") % 2 == 0, "v.mkv"))


def output_events(s, d):
    rows = S.output_events(merged(s, d), summaries(s, d), tracks(s, d), calls(s, d), channels(calls(s, d)), silenced(s))
    return rows.select("event_type", "call_id", F.md5("event").alias("event_md5"))


def all_events(s, d):
    """What leaves for the store of messages and of calls, in one table of envelopes."""
    called = S.output_events(merged(s, d), summaries(s, d), tracks(s, d), calls(s, d), channels(calls(s, d)), silenced(s)).withColumn("source_ref", F.concat_ws("|", "event_type", "call_id"))
    rows = M.union_events(events(s, d), called.withColumn("event_key", F.col("source_ref")))
    return rows.select("event_type", "source_ref", "event_key", "ts", F.md5("event").alias("event_md5"))


def published(s, d):
    """Artifacts of all calls published, then those of every other call once more with its segments a second later, and a third version whose data are there but not its name."""
    path = f"{io.shared_dir(s)}/artifacts-{uuid.uuid4().hex}"
    later = merged(s, d).withColumns({"start_ms": F.col("start_ms") + 1000, "end_ms": F.col("end_ms") + 1000})
    io.publish_artifacts(S.call_artifacts(merged(s, d), summaries(s, d), calls(s, d)), path)
    again = S.call_artifacts(later, summaries(s, d).where("conv_id % 2 = 0"), calls(s, d))
    io.publish_artifacts(again, path)
    again.withColumn("body", F.lit("half")).write.parquet(f"{path}/data/version=unfinished")
    return io.published_artifacts(s, path).select("call_id", "name", F.md5("body").alias("body_md5"))


def known_facts(s, d):
    """Facts of the summaries; and each call's first two words as one topic more."""
    first = names(s, d).select("call_id", F.lit("topic").alias("kind"), F.lit(99).alias("idx"), F.lit(None).cast("string").alias("owner"), F.regexp_extract("first_text", r"^(\S+ \S+)", 1).alias("body"))
    return S.facts(summaries(s, d)).unionByName(first.where("body <> ''"))


def community(s, d):
    """What the graph is built of: media, calls, tracks, chunks and facts. The last two are tables of their own, as many parts of the graph read them."""
    io.checkpoints(s)
    rows = merged(s, d)
    spoken = rows.select("call_id", "user_id").distinct()
    return view(s, d, "attachments"), calls(s, d), spoken, C.chunk_texts(rows, C.chunked(rows, CHUNK)).checkpoint(), known_facts(s, d).checkpoint()


def parts(s, d):
    """Summaries as they are posted, at a limit that cuts these short ones, written to a table and read back."""
    path = f"{io.shared_dir(s)}/parts-{uuid.uuid4().hex}"
    rows = S.summary_parts(shown(s, d), 150)
    rows.write.parquet(path)
    return s.read.schema(rows.schema).parquet(path).select("call_id", "part", F.md5("body").alias("body_md5"))


def repair(s, d):
    good, bad = S.validate_with_repair(model_output(s, d))
    return good.select("call_id", F.lit("valid").alias("state")).union(bad.select("call_id", F.lit("rejected").alias("state")))


def memories(s, d):
    return view(s, d, "memories")


def edges(s, d):
    """Each memory next to the following one of its number, and to that of half its number."""
    m = memories(s, d).select("memory_id")
    return m.select(F.col("memory_id").alias("src"), (F.col("memory_id") + 1).alias("dst")).union(m.select("memory_id", F.floor(F.col("memory_id") / 2).alias("dst")).where("memory_id > 0"))


def anchored(s, d):
    io.checkpoints(s)
    return R.recall_anchored(memories(s, d).where("is_query"), memories(s, d), edges(s, d), 5)


def fused(s, d):
    io.checkpoints(s)
    return R.recall_fused(memories(s, d).where("is_query"), memories(s, d), edges(s, d), 5)


def near(s, d):
    io.checkpoints(s)
    start = memories(s, d).where("is_query").select(F.col("memory_id").alias("query"), F.col("memory_id").alias("node"))
    return G.neighbourhood(edges(s, d), start, 2).select("query", "node", "hop")


def replies(s, d):
    """Answers of recall, rendered."""
    rows = R.recall_vector(memories(s, d).where("is_query"), memories(s, d), 3)
    lists = rows.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("rank", "memory_id"))).alias("m"))
    snippets = F.transform("m", lambda x: F.concat(F.lit("memory "), x["memory_id"].cast("string")))
    sources = F.transform("m", lambda x: F.when(x["memory_id"] % 2 == 0, F.concat(F.lit("ref "), x["memory_id"].cast("string"))))
    foot = T.honesty_footer(F.when(F.col("query") % 200 == 0, F.lit(False)), F.when(F.col("query") > 200, F.lit("max_hops")))
    return lists.select("query", T.render_reply(F.concat(F.lit("question "), F.col("query").cast("string")), snippets, sources, foot).alias("reply"))


QUERIES = {
    "parse_model_json": lambda s, d: model_output(s, d).select("call_id", S.parse_model_json(F.col("raw")).isNotNull().alias("parsed")),
    "validate_summary": lambda s, d: model_output(s, d).select("call_id", S.summary_errors(S.parse_model_json(F.col("raw"))).alias("errors")),
    "validate_with_repair": repair,
    "scrub_action_items": lambda s, d: S.scrub_action_items(summaries(s, d), out_names(s, d)).select("call_id", F.posexplode("summary.full_call.action_items").alias("idx", "x")).select("call_id", "idx", F.col("x.owner").alias("owner")),
    "scrub_speaker_sections": lambda s, d: S.scrub_speaker_sections(summaries(s, d), out_names(s, d)).select("call_id", F.array_join(F.transform("summary.per_speaker", lambda x: x["display_name"]), ",").alias("speakers")),
    "topic_action_facts": lambda s, d: S.facts(summaries(s, d)).groupBy("kind", "owner").agg(F.count("*").alias("n"), F.count_distinct("call_id").alias("calls")),
    "render_summary_md": lambda s, d: shown(s, d).select("call_id", F.md5(S.render_summary_md(F.col("summary"), F.col("video"))).alias("markdown_md5")),
    "write_summary_parts": parts,
    "publish_artifacts": published,
    "call_output_events": output_events,
    "union_events": all_events,
    "memory_nodes": lambda s, d: G.memory_nodes(log(s, d)),
    "memory_edges": lambda s, d: G.memory_edges(log(s, d)),
    "community_nodes": lambda s, d: G.community_nodes(normal(s, d), *community(s, d)),
    "community_edges": lambda s, d: G.community_edges(normal(s, d), M.reply_edges(normal(s, d)), *community(s, d)),
    "call_edges": lambda s, d: G.call_edges(merged(s, d)),
    "message_links": lambda s, d: G.message_links(normal(s, d), M.reply_edges(normal(s, d))),
    "supersede_chain": lambda s, d: G.supersede_chain(log(s, d)).select("source_ref", "event_id", "version", "superseded_by"),
    "neighbourhood": near,
    "recall_vector": lambda s, d: R.recall_vector(memories(s, d).where("is_query"), memories(s, d), 10),
    "recall_region": lambda s, d: R.recall_vector(memories(s, d).where("is_query"), memories(s, d), 10, region=True),
    "recall_anchored": anchored,
    "recall_fused": fused,
    "render_reply": replies,
}

NAMES = "names AS (SELECT call_id, conv_id, list_sort(list(DISTINCT display_name)) AS names FROM raw_segments GROUP BY 1, 2), good AS (SELECT * FROM names WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND conv_id % 13 <> 0), out AS (SELECT call_id, list(DISTINCT display_name) AS out_names FROM raw_segments WHERE user_id LIKE '%-3' GROUP BY 1)\n"
GOOD = """names AS (SELECT call_id, conv_id, list_sort(list(DISTINCT display_name)) AS names, arg_min(text, seg_idx) AS first_text FROM raw_segments GROUP BY 1, 2),
good AS (SELECT * FROM names WHERE conv_id % 5 <> 0 AND conv_id % 7 <> 0 AND conv_id % 13 <> 0), out AS (SELECT call_id, list(DISTINCT display_name) AS out_names FROM raw_segments WHERE user_id LIKE '%-3' GROUP BY 1)
"""
MARKDOWN = GOOD + """, shown AS (SELECT call_id, array_to_string(list_concat(['# Call summary'], CASE WHEN conv_id % 2 = 0 THEN ['', '📹 Video recorded (aligned) — v.mkv'] ELSE [] END,
  ['', '## Overview', CASE WHEN conv_id % 11 = 0 THEN '_No overview._' ELSE 'An overview' END, '', '## Key topics'], list_transform(names, lambda x: '- ' || x), ['', '## Decisions', '- ' || substr(first_text, 1, 40), '', '## Open questions', '_None._', '', '## Action items'],
  list_transform(names, lambda x: '- **' || x || ':** do ' || x), ['', '## Per-speaker'],
  flatten(list_transform(names, lambda x: ['', '### ' || x, '**Contributions**', '- spoke', '**Positions / concerns**', '_None._', '**Action items**', '- **' || x || ':** do ' || x]))), chr(10)) AS markdown FROM good)
"""
SIM = "sims AS (SELECT q.memory_id AS query, m.memory_id, round(list_cosine_similarity(q.embedding::DOUBLE[], m.embedding::DOUBLE[]), 6) AS score, q.region = m.region AS same FROM memories q JOIN memories m ON q.is_query AND q.memory_id <> m.memory_id)\n"
EDGES = "e0 AS (SELECT memory_id AS src, memory_id + 1 AS dst FROM memories UNION SELECT memory_id, memory_id // 2 FROM memories WHERE memory_id > 0), e AS (SELECT src, dst FROM e0 UNION SELECT dst, src FROM e0), h0 AS (SELECT memory_id AS query, memory_id AS node FROM memories WHERE is_query), h1 AS (SELECT DISTINCT query, dst AS node FROM h0 JOIN e ON node = src EXCEPT SELECT * FROM h0), h2 AS (SELECT DISTINCT query, dst AS node FROM h1 JOIN e ON node = src EXCEPT SELECT * FROM h1 EXCEPT SELECT * FROM h0)\n"
_RANK = "SELECT query, memory_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, memory_id) AS rank FROM {0}) WHERE rank <= {1}"


def _fused(k=5, rounds=10, damping=0.85, alpha=0.7):
    """SQL of recall_fused(): a common table for each round."""
    steps = [f"""seeds AS MATERIALIZED (SELECT query, memory_id AS node, greatest(score, 0) / sum(greatest(score, 0)) OVER (PARTITION BY query) AS w FROM ({_RANK.format("sims", 2 * k)})),
area AS MATERIALIZED (SELECT query, node FROM seeds UNION SELECT query, dst FROM seeds JOIN e ON src = node UNION SELECT query, f.dst FROM seeds JOIN e ON e.src = node JOIN e f ON f.src = e.dst),
pairs AS MATERIALIZED (SELECT a.query, e.src, e.dst, count(*) OVER (PARTITION BY a.query, e.src) AS degree FROM area a JOIN e ON e.src = a.node JOIN area b ON b.query = a.query AND b.node = e.dst),
r0 AS MATERIALIZED (SELECT query, node, COALESCE(w, 0) AS w, COALESCE(w, 0) AS r, NULL::DOUBLE AS old FROM area LEFT JOIN seeds USING (query, node))"""]
    for i in range(rounds):
        steps.append(f"""s{i} AS MATERIALIZED (SELECT p.query, p.dst AS node, sum(r / degree) AS got FROM r{i} JOIN pairs p ON p.query = r{i}.query AND p.src = r{i}.node GROUP BY 1, 2),
r{i + 1} AS MATERIALIZED (SELECT query, node, w, {1 - damping} * w + {damping} * COALESCE(got, 0) AS r, r AS old FROM r{i} LEFT JOIN s{i} USING (query, node))""")
    steps.append(f"""done AS (SELECT query, max(r) AS top, CASE WHEN sum(abs(r - old)) < 1e-6 THEN 'term_cond' ELSE 'max_hops' END AS termination_reason FROM r{rounds} GROUP BY 1),
mixed AS (SELECT query, memory_id, round({alpha} * score + {1 - alpha} * r / greatest(top, 1e-300), 6) AS score FROM r{rounds} x JOIN done USING (query) JOIN sims USING (query) WHERE sims.memory_id = x.node)""")
    return SIM + "," + EDGES + ", " + ",\n".join(steps) + f"\nSELECT t.*, FALSE AS graph_censored, termination_reason FROM ({_RANK.format('mixed', k)}) t JOIN done USING (query)"

OUTPUT = MERGED + ", " + GOOD + """, allowed AS (SELECT DISTINCT call_id, channel_id FROM raw_segments WHERE CAST(substr(channel_id, 2) AS INT) % 2 = 0),
said AS (SELECT call_id, list({'speaker': speaker, 'startMs': start_ms, 'endMs': end_ms, 'text': text} ORDER BY pos) AS segments FROM shown GROUP BY 1)
SELECT 'transcript' AS event_type, call_id, md5(json_object('type', 'transcript', 'call_id', call_id, 'channel_id', channel_id, 'segments', COALESCE(segments, []), 'region', 'discord')) AS event_md5 FROM allowed LEFT JOIN said USING (call_id)
UNION ALL SELECT 'summary', call_id, md5(json_object('type', 'summary', 'call_id', call_id, 'summary', {'fullCall': {'overview': CASE WHEN conv_id % 11 = 0 THEN 'Call ' || call_id ELSE 'An overview' END, 'keyTopics': names, 'decisions': [substr(first_text, 1, 40)], 'openQuestions': []::VARCHAR[],
  'actionItems': list_transform(names, lambda x: {'owner': CASE WHEN list_contains(gone, x) THEN 'unassigned' ELSE x END, 'item': 'do ' || x})},
  'perSpeaker': list_transform(list_filter(names, lambda x: NOT list_contains(gone, x)), lambda x: {'displayName': x, 'contributions': ['spoke'], 'positionsConcerns': []::VARCHAR[], 'actionItems': [{'owner': x, 'item': 'do ' || x}]})}, 'region', 'discord'))
FROM (SELECT g.*, COALESCE(out_names, []) AS gone FROM good g LEFT JOIN out USING (call_id)) JOIN allowed USING (call_id)"""

COMMUNITY = MERGED + NOTES_ONLY + ", " + GOOD + ", " + NORMAL + """, msgs AS (SELECT *, 'discord://channel/' || channel_id || '/message/' || message_id AS ref FROM normal), spoken AS (SELECT DISTINCT call_id, user_id FROM raw_segments WHERE trim(text, ' \t\n\r') <> ''),
topics AS (SELECT call_id, trim(regexp_replace(lower(body), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS topic FROM (SELECT call_id, unnest(names) AS body FROM good UNION ALL SELECT call_id, regexp_extract(first_text, '^(\\S+ \\S+)', 1) FROM names) WHERE body <> ''),
parts AS (SELECT call_id, 'decision|' || call_id || '|0' AS ref, 'decision' AS kind FROM good UNION ALL SELECT call_id, k || '|' || call_id || '|' || i, k FROM (SELECT call_id, unnest(range(len(names))) AS i, names FROM good), (SELECT unnest(['action_item', 'speaker_turn']) AS k))
"""


SQL = {
    "parse_model_json": duck("SELECT DISTINCT call_id, conv_id % 5 <> 0 AS parsed FROM raw_segments", "raw_segments"),
    "validate_summary": duck("""SELECT call_id, CASE WHEN conv_id % 5 = 0 THEN '$: not JSON' ELSE array_to_string(list_concat(CASE WHEN conv_id % 7 = 0 THEN list_transform(range(n), lambda i: 'fullCall.actionItems.' || i || '.owner: missing') ELSE [] END,
 CASE WHEN conv_id % 13 = 0 THEN list_transform(range(n), lambda i: 'perSpeaker.' || i || '.displayName: empty') ELSE [] END), '; ') END AS errors FROM (SELECT call_id, conv_id, count(DISTINCT display_name) AS n FROM raw_segments GROUP BY 1, 2)""", "raw_segments"),
    "validate_with_repair": duck("SELECT DISTINCT call_id, CASE WHEN conv_id % 5 = 0 OR conv_id % 7 = 0 OR conv_id % 13 = 0 THEN 'rejected' ELSE 'valid' END AS state FROM raw_segments", "raw_segments"),
    "scrub_action_items": duck(NAMES + "SELECT call_id, CAST(i - 1 AS INT) AS idx, CASE WHEN list_contains(COALESCE(out_names, []), n) THEN 'unassigned' ELSE n END AS owner FROM (SELECT g.*, out_names, unnest(names) AS n, generate_subscripts(names, 1) AS i FROM good g LEFT JOIN out USING (call_id))", "raw_segments"),
    "scrub_speaker_sections": duck(NAMES + "SELECT call_id, COALESCE(array_to_string(list_filter(names, lambda x: NOT list_contains(COALESCE(out_names, []), x)), ','), '') AS speakers FROM good LEFT JOIN out USING (call_id)", "raw_segments"),
    "topic_action_facts": duck(NAMES + """, each AS (SELECT call_id, unnest(names) AS n FROM good), f AS (SELECT call_id, 'topic' AS kind, NULL AS owner FROM each UNION ALL SELECT call_id, 'action', n FROM each UNION ALL SELECT call_id, 'speaker', n FROM each UNION ALL SELECT call_id, 'decision', NULL FROM good)
SELECT kind, owner, count(*) AS n, count(DISTINCT call_id) AS calls FROM f GROUP BY 1, 2""", "raw_segments"),
    "memory_nodes": duck(LOG + "SELECT source_ref, 'message' AS kind, min(ts) AS first_seen FROM log WHERE kind IN ('create', 'edit') GROUP BY 1 UNION ALL SELECT 'member|' || author_id, 'member', min(ts) FROM log GROUP BY 1 UNION ALL SELECT 'channel|' || channel_id, 'channel', min(ts) FROM log GROUP BY 1", "message_log"),
    "memory_edges": duck(LOG + "SELECT DISTINCT 'member|' || author_id AS src, 'authored' AS kind, source_ref AS dst FROM log WHERE kind IN ('create', 'edit') UNION ALL SELECT DISTINCT source_ref, 'in_channel', 'channel|' || channel_id FROM log WHERE kind IN ('create', 'edit')", "message_log"),
    "community_nodes": duck(COMMUNITY + """SELECT ref AS source_ref, 'message' AS kind FROM msgs UNION SELECT 'member|' || author_id, 'member' FROM msgs UNION SELECT 'member|' || user_id, 'member' FROM spoken UNION SELECT 'channel|' || channel_id, 'channel' FROM msgs
UNION SELECT 'channel|' || channel_id, 'channel' FROM raw_segments UNION SELECT 'thread|' || thread_id, 'thread' FROM msgs WHERE thread_id IS NOT NULL UNION SELECT 'media|' || media_id, 'media' FROM attachments UNION SELECT 'call|' || call_id, 'call' FROM raw_segments
UNION SELECT 'chunk|' || call_id || '|' || note_idx, 'chunk' FROM notes UNION SELECT 'topic|' || topic, 'topic' FROM topics UNION SELECT ref, kind FROM parts""", "raw_segments", "raw_messages", "attachments", recursive=True),
    "community_edges": duck(COMMUNITY + """SELECT 'member|' || author_id AS src, 'authored' AS kind, ref AS dst FROM msgs UNION SELECT ref, 'in_channel', 'channel|' || channel_id FROM msgs UNION SELECT a.ref, 'replies_to', b.ref FROM msgs a JOIN msgs b ON a.reply_to = b.message_id
UNION SELECT ref, 'in_thread', 'thread|' || thread_id FROM msgs WHERE thread_id IS NOT NULL UNION SELECT ref, 'mentions', 'member|' || mention_1 FROM msgs UNION SELECT ref, 'mentions', 'member|' || mention_2 FROM msgs
UNION SELECT 'media|' || media_id, 'attached_to', ref FROM attachments JOIN msgs USING (message_id) UNION SELECT 'member|' || user_id, 'spoke_in', 'call|' || call_id FROM spoken UNION SELECT 'call|' || call_id, 'in_channel', 'channel|' || channel_id FROM raw_segments
UNION SELECT 'chunk|' || call_id || '|' || note_idx, 'part_of_call', 'call|' || call_id FROM notes UNION SELECT ref, 'part_of_call', 'call|' || call_id FROM parts UNION SELECT 'call|' || call_id, 'about', 'topic|' || topic FROM topics
UNION SELECT ref, 'about', 'topic|' || topic FROM (SELECT ref, content AS text FROM msgs UNION ALL SELECT 'chunk|' || call_id || '|' || note_idx, note FROM notes) JOIN (SELECT DISTINCT topic FROM topics) ON contains(' ' || trim(regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ', ' ' || topic || ' ')""", "raw_segments", "raw_messages", "attachments", recursive=True),
    "call_edges": duck("SELECT DISTINCT 'member|' || user_id AS src, 'spoke_in' AS kind, 'call|' || call_id AS dst FROM raw_segments WHERE trim(text, ' \t\n\r') <> ''", "raw_segments"),
    "message_links": duck(NORMAL + f", n AS (SELECT *, {REF} AS ref FROM normal) SELECT a.ref AS src, 'replies_to' AS kind, b.ref AS dst FROM n a JOIN n b ON a.reply_to = b.message_id UNION SELECT ref, 'in_thread', 'thread|' || thread_id FROM n WHERE thread_id IS NOT NULL UNION SELECT ref, 'mentions', 'member|' || mention_1 FROM n UNION SELECT ref, 'mentions', 'member|' || mention_2 FROM n", "raw_messages"),
    "supersede_chain": duck(LOG + "SELECT source_ref, event_id, CAST(row_number() OVER w AS INT) AS version, lead(event_id) OVER w AS superseded_by FROM log WHERE kind IN ('create', 'edit') WINDOW w AS (PARTITION BY source_ref ORDER BY ts, event_id)", "message_log"),
    "neighbourhood": duck(EDGES + "SELECT query, node, 0 AS hop FROM h0 UNION ALL SELECT query, node, 1 FROM h1 UNION ALL SELECT query, node, 2 FROM h2", "memories"),
    "recall_vector": duck(SIM + _RANK.format("sims", 10), "memories"),
    "recall_region": duck(SIM + _RANK.format("sims WHERE same", 10), "memories"),
    "recall_anchored": duck(SIM + "," + EDGES + ", near AS (SELECT s.* FROM sims s JOIN (FROM h1 UNION ALL FROM h2) h ON h.query = s.query AND h.node = s.memory_id) " + _RANK.format("near", 5), "memories"),
    "render_reply": duck(SIM + ", r AS (" + _RANK.format("sims", 3) + """) SELECT query, '**Q:** question ' || query || chr(10) || chr(10) || string_agg('**' || rank || '.** memory ' || memory_id || chr(10) || '-# ' || CASE WHEN memory_id % 2 = 0 THEN 'ref ' || memory_id ELSE 'unknown source' END || chr(10), chr(10) ORDER BY rank) || chr(10)
|| '-# mode=fused' || CASE WHEN query % 200 = 0 THEN ' | graph_censored=false' ELSE '' END || CASE WHEN query > 200 THEN ' | termination=max_hops' ELSE '' END AS reply FROM r GROUP BY query""", "memories"),
    "recall_fused": duck(_fused(), "memories"),
    "render_summary_md": duck(MARKDOWN + "SELECT call_id, md5(markdown) AS markdown_md5 FROM shown", "raw_segments"),
    "publish_artifacts": duck(MERGED + ", " + MARKDOWN.replace("v.mkv", "' || call_id || '.mkv") + f""", moved AS (SELECT *, start_ms + CASE WHEN conv_id % 2 = 0 THEN 1000 ELSE 0 END AS s, end_ms + CASE WHEN conv_id % 2 = 0 THEN 1000 ELSE 0 END AS e FROM merged JOIN good USING (call_id, conv_id)),
aligned AS (SELECT *, greatest(0, s - video_offset_ms) AS video_ms FROM moved WHERE video_offset_ms IS NOT NULL)
SELECT call_id, 'transcript.json' AS name, md5(json_object('callId', call_id, 'segments', list({{'speaker': speaker, 'startMs': s, 'endMs': e, 'text': text}} ORDER BY pos))) AS body_md5 FROM moved GROUP BY 1
UNION ALL SELECT call_id, 'summary.md', md5(markdown) FROM shown_md
UNION ALL SELECT call_id, 'summary.json', md5(json_object('fullCall', {{'overview': CASE WHEN conv_id % 11 = 0 THEN ' ' ELSE 'An overview' END, 'keyTopics': names, 'decisions': [substr(first_text, 1, 40)], 'openQuestions': []::VARCHAR[], 'actionItems': list_transform(names, lambda x: {{'owner': x, 'item': 'do ' || x}})}},
  'perSpeaker', list_transform(names, lambda x: {{'displayName': x, 'contributions': ['spoke'], 'positionsConcerns': []::VARCHAR[], 'actionItems': [{{'owner': x, 'item': 'do ' || x}}]}}))) FROM good
UNION ALL SELECT call_id, 'transcript.timecoded.md', md5('# Timecoded transcript' || chr(10) || chr(10) || 'Video: ' || call_id || '.mkv' || chr(10) || chr(10) || string_agg('[' || {CLOCK} || '] ' || line, chr(10) ORDER BY pos)) FROM aligned GROUP BY call_id""".replace("shown AS", "shown_md AS"), "raw_segments").replace(", shown AS (SELECT call_id, array_to_string", ", shown_md AS (SELECT call_id, array_to_string"),
    "write_summary_parts": duck(MARKDOWN + """, lines AS (SELECT call_id, unnest(string_split(markdown, chr(10))) AS line, generate_subscripts(string_split(markdown, chr(10)), 1) AS i FROM shown),
packed AS (SELECT call_id, i, line AS cur, 0 AS part FROM lines WHERE i = 1
  UNION ALL SELECT l.call_id, l.i, CASE WHEN p.cur = '' THEN l.line WHEN length(p.cur) + 1 + length(l.line) <= 150 THEN p.cur || chr(10) || l.line ELSE l.line END, CASE WHEN p.cur = '' OR length(p.cur) + 1 + length(l.line) <= 150 THEN p.part ELSE p.part + 1 END
  FROM packed p JOIN lines l ON l.call_id = p.call_id AND l.i = p.i + 1)
SELECT call_id, part, md5(arg_max(cur, i)) AS body_md5 FROM packed WHERE cur <> '' GROUP BY 1, 2""", "raw_segments", recursive=True),
    "call_output_events": duck(OUTPUT, "raw_segments"),
    "union_events": duck(FEED + f", called AS (WITH {OUTPUT}) SELECT event_type, source_ref, event_key, ts, md5(event) AS event_md5 FROM sent UNION ALL SELECT event_type, event_type || '|' || call_id, event_type || '|' || call_id, NULL, event_md5 FROM called", "feed", "raw_segments"),
}
