"""Queries over calls and their segments, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from colloquy.operators import transcript as C
from colloquy.sources import io

from .views import CHUNK, SINGLE_PASS, duck, view

V = ("raw_segments",)


def segments(s, d):
    return view(s, d, "raw_segments")


def tracks(s, d):
    return segments(s, d).select("call_id", "user_id", "display_name", "track_idx", "start_offset_ms").distinct()


def calls(s, d):
    return segments(s, d).groupBy("call_id").agg(F.first("video_offset_ms").alias("video_offset_ms"), F.first("channel_id").alias("channel_id"), F.first("conv_id").alias("conv_id")).withColumn("video_path", F.concat("call_id", F.lit(".mkv")))


def labelled(s, d):
    raw = segments(s, d).select("call_id", "conv_id", "user_id", "seg_idx", "start_ms", "end_ms", "text")
    return C.label_segments(raw, tracks(s, d))


def merged(s, d):
    return C.timeline(labelled(s, d))


def optout(s):
    """Users whose id ends in -3."""
    return s.createDataFrame([(f"{r}-3",) for r in ("system", "user", "assistant")], "user_id string")


def stt(s, d):
    """One speech-to-text result a (call, user); every fourth call's lists no segments."""
    one = F.struct((F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), F.col("text"))
    rows = segments(s, d).groupBy("call_id", "conv_id", "user_id").agg(F.array_sort(F.collect_list(F.struct("seg_idx", one.alias("s")))).alias("m"), F.max("end_ms").alias("last"))
    parts = F.transform("m", lambda x: x["s"])
    text = F.array_join(F.transform(parts, lambda x: x["text"]), " ")
    body = F.struct(text.alias("text"), (F.col("last") / 1000).alias("duration"), F.when(F.col("conv_id") % 4 != 0, parts).alias("segments"))
    return rows.select("call_id", "user_id", F.to_json(body).alias("stt"))


def notes(s, d):
    """A note for each chunk: its lines."""
    rows = merged(s, d)
    return C.chunk_texts(rows, C.chunked(rows, CHUNK)).select("call_id", F.col("chunk").alias("note_idx"), F.col("text").alias("note"))


def long_calls(s, d):
    """All calls, whatever their length, packed in many tasks."""
    io.checkpoints(s)
    return C.chunked(merged(s, d), CHUNK, longest=0)


def fold(s, d):
    io.checkpoints(s)
    return C.fold_notes(notes(s, d), 160).select("call_id", "n_notes", F.length("notes").alias("chars"), F.md5("notes").alias("notes_md5"))


QUERIES = {
    "call_digest": lambda s, d: C.call_digest(calls(s, d), labelled(s, d), tracks(s, d), optout(s), SINGLE_PASS, CHUNK),
    "stt_to_segments": lambda s, d: C.stt_to_segments(stt(s, d)).select("call_id", "user_id", "seg_idx", "start_ms", "end_ms", F.md5("text").alias("text_md5")),
    "label_segments": lambda s, d: labelled(s, d).select("call_id", "speaker", "track_idx", "seg_idx", "start_ms", "end_ms"),
    "drop_blank_segments": lambda s, d: C.drop_blank_segments(segments(s, d)).select("call_id", "user_id", "seg_idx", F.md5("text").alias("text_md5")),
    "merge_timeline": lambda s, d: merged(s, d).select("call_id", "pos", "speaker", "seg_idx", "start_ms", "end_ms"),
    "group_by_speaker": lambda s, d: C.group_by_speaker(merged(s, d)).select("call_id", "speaker", "speaker_idx", "first_pos", F.md5("text").alias("text_md5")),
    "render_transcript": lambda s, d: C.render_transcript(merged(s, d)).select("call_id", F.md5("transcript").alias("transcript_md5")),
    "estimate_call_tokens": lambda s, d: C.estimate_call_tokens(merged(s, d)),
    "choose_strategy": lambda s, d: C.choose_strategy(C.estimate_call_tokens(merged(s, d)), SINGLE_PASS),
    "chunk_segments": lambda s, d: C.chunked(merged(s, d), CHUNK),
    "pack_long_calls": long_calls,
    "make_notes": lambda s, d: C.make_notes(C.chunk_texts(merged(s, d), C.chunked(merged(s, d), CHUNK))).select("call_id", "note_idx", "failure", F.md5("note").alias("note_md5")),
    "chunk_per_speaker": lambda s, d: C.chunked(merged(s, d), CHUNK, ("call_id", "speaker")),
    "batch_notes": lambda s, d: C.batch_notes(notes(s, d), 160).select("call_id", "note_idx", "batch"),
    "fold_notes": fold,
    "scrub_segments": lambda s, d: C.scrub_segments(merged(s, d), tracks(s, d), optout(s)).select("call_id", "pos", "speaker"),
    "align_to_video": lambda s, d: C.align_to_video(merged(s, d), calls(s, d)).select("call_id", "pos", "video_ms"),
    "render_timecoded": lambda s, d: C.render_timecoded(C.align_to_video(merged(s, d), calls(s, d))).select("call_id", F.md5("timecoded").alias("timecoded_md5")),
    "silent_calls": lambda s, d: C.silent_calls(calls(s, d), segments(s, d)).select("call_id"),
    "call_participants": lambda s, d: C.speakers(tracks(s, d)),
    "validate_segments": lambda s, d: labelled(s, d).withColumn("end_ms", F.when(F.col("seg_idx") % 5 == 0, F.col("start_ms") - 1).otherwise(F.col("end_ms"))).select("call_id", "user_id", "seg_idx", _segment_errors().alias("errors")),
}


def _segment_errors():
    from colloquy.sources import validate

    return validate.segment_errors()


MERGED = """labelled AS (SELECT call_id, conv_id, user_id, display_name AS speaker, track_idx, seg_idx, start_ms + start_offset_ms AS start_ms, end_ms + start_offset_ms AS end_ms, text, video_offset_ms, channel_id FROM raw_segments),
merged AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY start_ms, end_ms, speaker, track_idx, seg_idx) - 1 AS pos, speaker || ': ' || text AS line, CAST(ceil(length(speaker || ': ' || text) / 4.0) AS BIGINT) AS tok
           FROM labelled WHERE trim(text, ' \t\n\r') <> ''),
shown AS (SELECT * FROM merged WHERE user_id NOT LIKE '%-3')
"""
_PACK = """, seg AS (SELECT {keys}, pos, tok, row_number() OVER (PARTITION BY {keys} ORDER BY pos) AS i FROM merged),
packs AS (SELECT {keys}, pos, tok, i, tok AS n, 0 AS chunk FROM seg WHERE i = 1
  UNION ALL SELECT {skeys}, s.pos, s.tok, s.i, CASE WHEN p.n + s.tok > {most} THEN s.tok ELSE p.n + s.tok END, CASE WHEN p.n + s.tok > {most} THEN p.chunk + 1 ELSE p.chunk END
  FROM packs p JOIN seg s ON {on} AND s.i = p.i + 1)
"""
PACK = _PACK.format(keys="call_id", skeys="s.call_id", on="s.call_id = p.call_id", most=CHUNK)
PACK2 = _PACK.format(keys="call_id, speaker", skeys="s.call_id, s.speaker", on="s.call_id = p.call_id AND s.speaker = p.speaker", most=CHUNK)
TOKENS = "CAST(ceil((sum(length(line)) + count(*) - 1) / 4.0) AS BIGINT)"
CLOCK = "lpad(CAST(video_ms // 60000 AS VARCHAR), CAST(greatest(2, length(CAST(video_ms // 60000 AS VARCHAR))) AS INT), '0') || ':' || lpad(CAST(video_ms // 1000 % 60 AS VARCHAR), 2, '0')"
VIDEO = ", video AS (SELECT *, greatest(0, start_ms - video_offset_ms) AS video_ms FROM merged WHERE video_offset_ms IS NOT NULL)\n"
NOTES_ONLY = PACK + """, notes AS (SELECT m.call_id, p.chunk AS note_idx, string_agg(m.line, chr(10) ORDER BY m.pos) AS note FROM merged m JOIN packs p USING (call_id, pos) GROUP BY 1, 2)
"""
NOTES = NOTES_ONLY + """, costed AS (SELECT *, row_number() OVER (PARTITION BY call_id ORDER BY note_idx) AS i FROM notes),
batched AS (SELECT call_id, note_idx, i, 15 + length(note) AS chars, 1 AS k, 0 AS batch FROM costed WHERE i = 1
  UNION ALL SELECT c.call_id, c.note_idx, c.i, CASE WHEN over THEN 15 + length(c.note) ELSE more END, CASE WHEN over THEN 1 ELSE b.k + 1 END, CASE WHEN over THEN b.batch + 1 ELSE b.batch END
  FROM batched b JOIN costed c ON b.call_id = c.call_id AND c.i = b.i + 1,
  LATERAL (SELECT b.chars + 2 + 14 + length(CAST(b.k + 1 AS VARCHAR)) + length(c.note) AS more) x, LATERAL (SELECT ceil(x.more / 4.0) > 160 AS over) y)
"""


def _sql(body, recursive=False):
    return duck(MERGED + body, *V, recursive=recursive)


SQL = {
    "call_digest": _sql(PACK + f"""SELECT c.call_id, COALESCE(s.n_segments, 0) AS n_segments, COALESCE(s.n_speakers, 0) AS n_speakers, s.first_ms, s.last_ms, COALESCE(f.tokens, 0) AS tokens,
  CASE WHEN f.tokens IS NULL THEN 'silent' WHEN f.tokens <= {SINGLE_PASS} THEN 'single' ELSE 'map-reduce' END AS strategy, COALESCE(k.n_chunks, 0) AS n_chunks, s.transcript_md5
FROM (SELECT DISTINCT call_id FROM raw_segments) c
LEFT JOIN (SELECT call_id, {TOKENS} AS tokens FROM merged GROUP BY 1) f USING (call_id)
LEFT JOIN (SELECT call_id, CAST(max(chunk) + 1 AS BIGINT) AS n_chunks FROM packs GROUP BY 1) k USING (call_id)
LEFT JOIN (SELECT call_id, count(*) AS n_segments, count(DISTINCT speaker) AS n_speakers, min(start_ms) AS first_ms, max(end_ms) AS last_ms, md5(string_agg(line, chr(10) ORDER BY pos)) AS transcript_md5 FROM shown GROUP BY 1) s USING (call_id)""", True),
    "stt_to_segments": duck("""each AS (SELECT call_id, user_id, row_number() OVER (PARTITION BY call_id, user_id ORDER BY seg_idx) - 1 AS seg_idx, start_ms, end_ms, text FROM raw_segments WHERE conv_id % 4 <> 0),
whole AS (SELECT call_id, user_id, 0 AS seg_idx, 0 AS start_ms, max(end_ms) AS end_ms, string_agg(text, ' ' ORDER BY seg_idx) AS text FROM raw_segments WHERE conv_id % 4 = 0 GROUP BY 1, 2)
SELECT call_id, user_id, seg_idx, start_ms, end_ms, md5(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) AS text_md5 FROM (FROM each UNION ALL FROM whole) WHERE trim(text, ' \t\n\r') <> ''""", *V),
    "label_segments": _sql("SELECT call_id, speaker, track_idx, seg_idx, start_ms, end_ms FROM labelled"),
    "drop_blank_segments": duck("SELECT call_id, user_id, seg_idx, md5(text) AS text_md5 FROM raw_segments WHERE trim(text, ' \t\n\r') <> ''", *V),
    "merge_timeline": _sql("SELECT call_id, pos, speaker, seg_idx, start_ms, end_ms FROM merged"),
    "group_by_speaker": _sql("SELECT call_id, speaker, CAST(row_number() OVER (PARTITION BY call_id ORDER BY first_pos) - 1 AS INT) AS speaker_idx, first_pos, text_md5 FROM (SELECT call_id, speaker, min(pos) AS first_pos, md5(string_agg(text, chr(10) ORDER BY pos)) AS text_md5 FROM merged GROUP BY 1, 2)"),
    "render_transcript": _sql("SELECT call_id, md5(string_agg(line, chr(10) ORDER BY pos)) AS transcript_md5 FROM merged GROUP BY 1"),
    "estimate_call_tokens": _sql(f"SELECT call_id, {TOKENS} AS tokens FROM merged GROUP BY 1"),
    "choose_strategy": _sql(f"SELECT call_id, {TOKENS} AS tokens, CASE WHEN {TOKENS} <= {SINGLE_PASS} THEN 'single' ELSE 'map-reduce' END AS strategy FROM merged GROUP BY 1"),
    "chunk_segments": _sql(PACK + "SELECT call_id, pos, tok, chunk FROM packs", True),
    "pack_long_calls": _sql(PACK + "SELECT call_id, pos, tok, chunk FROM packs", True),
    "make_notes": _sql(NOTES_ONLY + "SELECT call_id, note_idx, NULL::VARCHAR AS failure, md5(substr(note, 1, 800)) AS note_md5 FROM notes", True),
    "chunk_per_speaker": _sql(PACK2 + "SELECT call_id, speaker, pos, tok, chunk FROM packs", True),
    "batch_notes": _sql(NOTES + "SELECT call_id, note_idx, batch FROM batched", True),
    "scrub_segments": _sql("SELECT call_id, pos, speaker FROM shown"),
    "align_to_video": _sql(VIDEO + "SELECT call_id, pos, video_ms FROM video"),
    "render_timecoded": _sql(VIDEO + f"SELECT call_id, md5('# Timecoded transcript' || chr(10) || chr(10) || 'Video: ' || call_id || '.mkv' || chr(10) || chr(10) || string_agg('[' || {CLOCK} || '] ' || line, chr(10) ORDER BY pos)) AS timecoded_md5 FROM video GROUP BY call_id"),
    "silent_calls": _sql("SELECT DISTINCT call_id FROM raw_segments WHERE call_id NOT IN (SELECT call_id FROM merged)"),
    "call_participants": duck("SELECT call_id, display_name AS speaker, arg_max(user_id, track_idx) AS user_id FROM raw_segments GROUP BY 1, 2", *V),
    "validate_segments": _sql("""SELECT call_id, user_id, seg_idx, CASE WHEN seg_idx % 5 = 0 THEN 'end_ms: before start_ms' || CASE WHEN start_ms - 1 < 0 THEN '; end_ms: negative' ELSE '' END ELSE '' END AS errors FROM labelled"""),
}
