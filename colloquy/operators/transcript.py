"""Calls: segments to timelines, transcripts, token budgets and chunks. Everything is keyed by call."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T

from . import packing

ORDER = ["start_ms", "end_ms", "speaker", "track_idx", "seg_idx"]
STT = "struct<text:string,duration:double,segments:array<struct<start:double,end:double,text:string>>>"


def stt_to_segments(rows: DataFrame, column: str = "stt") -> DataFrame:
    """Segments of speech-to-text results; one for the whole file where it lists none; blank text yields no rows."""
    parsed = rows.withColumn("_r", F.from_json(column, STT))
    whole = F.array(F.struct(F.lit(0.0).alias("start"), F.coalesce("_r.duration", F.lit(0.0)).alias("end"), F.col("_r.text").alias("text")))
    each = F.when(F.size("_r.segments") > 0, F.col("_r.segments")).otherwise(whole)
    out = parsed.select("*", F.posexplode(each).alias("seg_idx", "_s")).drop("_r", column)
    out = out.select("*", T.seconds_to_ms(F.col("_s.start")).alias("start_ms"), T.seconds_to_ms(F.col("_s.end")).alias("end_ms"), T.ws_trim(F.col("_s.text")).alias("text")).drop("_s")
    return out.where(F.length("text") > 0)


def drop_blank_segments(segments: DataFrame) -> DataFrame:
    return segments.where(~T.is_blank(F.col("text")))


def label_segments(segments: DataFrame, tracks: DataFrame) -> DataFrame:
    """Segments with their speaker's name, moved to the call's clock."""
    return segments.join(tracks, ["call_id", "user_id"]).select(
        *[c for c in segments.columns if c not in ("start_ms", "end_ms")], F.col("display_name").alias("speaker"), "track_idx",
        (F.col("start_ms") + F.col("start_offset_ms")).alias("start_ms"), (F.col("end_ms") + F.col("start_offset_ms")).alias("end_ms"))


def merge_timeline(segments: DataFrame, linguistic: bool = False) -> DataFrame:
    """Segments with ``pos`` from 0 in their call: by start, end, speaker, track and place in it."""
    order = [F.collate(F.col(c), "UNICODE") if linguistic and c == "speaker" else F.col(c) for c in ORDER]
    return segments.withColumn("pos", (F.row_number().over(Window.partitionBy("call_id").orderBy(*order)) - 1).cast("long"))


def timeline(labelled: DataFrame) -> DataFrame:
    return merge_timeline(drop_blank_segments(labelled))


def line() -> Column:
    return T.segment_line(F.col("speaker"), F.col("text"))


def joined_lines(text: Column) -> Column:
    """Lines of a group in order of pos, one below the other."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col("pos"), text.alias("line")))), lambda x: x["line"]), "\n")


def group_by_speaker(merged: DataFrame) -> DataFrame:
    """Of each speaker of a call: place among speakers by first words, and their lines."""
    by = merged.groupBy("call_id", "speaker").agg(F.min("pos").alias("first_pos"), joined_lines(F.col("text")).alias("text"))
    return by.withColumn("speaker_idx", (F.row_number().over(Window.partitionBy("call_id").orderBy("first_pos")) - 1).cast("int"))


def render_transcript(merged: DataFrame) -> DataFrame:
    return merged.groupBy("call_id").agg(joined_lines(line()).alias("transcript"))


def estimate_call_tokens(merged: DataFrame) -> DataFrame:
    """Tokens of the rendered transcript, without rendering it."""
    return merged.groupBy("call_id").agg(T.tokens_of(F.sum(F.length(line())) + F.count("*") - 1).alias("tokens"))


def choose_strategy(tokens: DataFrame, single_pass: int = 8000) -> DataFrame:
    return tokens.withColumn("strategy", F.when(F.col("tokens") <= single_pass, "single").otherwise("map-reduce"))


def chunked(merged: DataFrame, most: int = 4000, keys: tuple[str, ...] = ("call_id",), longest: int | None = None) -> DataFrame:
    """pos and ``chunk`` of every segment: greedy packing within ``keys`` by the tokens of its line.

    One array of (pos, tokens) a key is folded, as a key is a call, bounded by its
    length. Where keys may be longer, ``longest`` says up to how many segments:
    other keys are packed in many tasks by packing.greedy(), to the same end.
    """
    items = merged.select(*keys, "pos", T.estimate_tokens(line()).alias("tok"))
    if longest is None:
        return _folded(items, most, keys)
    many = items.groupBy(*keys).count().where(F.col("count") > longest).select(*keys).checkpoint()
    short, long = (items.join(many, list(keys), how) for how in ("left_anti", "left_semi"))
    return _folded(short, most, keys).unionByName(packing.greedy(long, most, keys))


def _folded(items: DataFrame, most: int, keys: tuple[str, ...]) -> DataFrame:
    rows = items.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "tok"))).alias("m"))
    rows = rows.withColumn("packs", T.packed(F.transform("m", lambda x: x["tok"]), most))
    return rows.select(*keys, F.explode(F.arrays_zip("m", "packs")).alias("z")).select(*keys, F.col("z.m.pos").alias("pos"), F.col("z.m.tok").alias("tok"), F.col("z.packs").alias("chunk"))


def chunk_texts(merged: DataFrame, chunks: DataFrame) -> DataFrame:
    """call_id, chunk and text of each chunk of chunked(): its lines, one below the other."""
    return merged.join(chunks.select("call_id", "pos", "chunk"), ["call_id", "pos"]).groupBy("call_id", "chunk").agg(joined_lines(line()).alias("text"))


def first_tokens(batches):
    """The default note maker: the beginning of a chunk's text, up to NOTE_TOKENS."""
    for pdf in batches:
        yield pdf.assign(note=pdf["text"].str.slice(0, 4 * NOTE_TOKENS), failure=None)


#: Tokens of a note.
NOTE_TOKENS = 200


def make_notes(texts: DataFrame, maker=first_tokens) -> DataFrame:
    """(call_id, note_idx, note, failure): a note for each chunk of chunk_texts(), by a pluggable maker.

    ``maker`` maps batches with call_id, chunk and text to batches with note and
    failure besides, row by row and in bounded batches. A row whose failure isn't
    null, or whose note is blank, gets the default note and keeps its failure;
    notes are cut to NOTE_TOKENS.
    """
    made = texts.mapInPandas(maker, "call_id string, chunk int, text string, note string, failure string")
    plain = T.truncate_tokens(F.col("text"), NOTE_TOKENS)
    good = F.col("failure").isNull() & ~T.is_blank(F.coalesce("note", F.lit("")))
    return made.select("call_id", F.col("chunk").alias("note_idx"), F.when(good, T.truncate_tokens(F.col("note"), NOTE_TOKENS)).otherwise(plain).alias("note"), "failure")


def batch_notes(notes: DataFrame, most: int, key: str = "call_id") -> DataFrame:
    """Notes with ``batch``: greedy packing where a batch costs the tokens of its notes joined under numbered headers."""
    rows = notes.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("note_idx", F.length("note").alias("len")))).alias("m"))
    start = F.struct(F.lit(0).cast("long").alias("chars"), F.lit(0).alias("k"), F.lit(0).alias("at"), F.array(F.lit(0)).alias("starts"))

    def step(acc, x):
        header = lambda i: F.length(i.cast("string")) + len("--- Notes  ---\n")
        more = acc["chars"] + x["len"] + header(acc["k"] + 1) + F.when(acc["k"] > 0, 2).otherwise(0)
        fresh = (acc["k"] > 0) & (T.tokens_of(more) > most)
        starts = F.when(fresh, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"])
        return F.struct(F.when(fresh, x["len"] + header(F.lit(1))).otherwise(more).cast("long").alias("chars"), F.when(fresh, 1).otherwise(acc["k"] + 1).alias("k"), (acc["at"] + 1).alias("at"), starts.alias("starts"))

    packs = T.numbered(F.col("m"), F.aggregate("m", start, step, lambda acc: acc["starts"]))
    flat = rows.withColumn("packs", packs).select(key, F.explode(F.arrays_zip("m", "packs")).alias("z")).select(key, F.col("z.m.note_idx").alias("note_idx"), F.col("z.packs").alias("batch"))
    return notes.join(flat, [key, "note_idx"])


def concat_reducer(batches: DataFrame, cap: int = 800) -> DataFrame:
    """The default reducer: a batch's notes joined under headers, cut to ``cap`` characters."""
    note = T.join_notes(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "note"))), lambda x: x["note"]))
    return batches.groupBy("call_id", "batch").agg(F.substring(note, 1, cap).alias("note")).select("call_id", F.col("batch").alias("note_idx"), "note")


def fold_notes(notes: DataFrame, most: int, reduce=concat_reducer, max_rounds: int = 20) -> DataFrame:
    """One row a call: its notes folded in rounds until they fit ``most`` tokens, or a round no longer has fewer.

    Calls that are done are carried along; a round ends the loop when no call is left.
    """
    current = notes.select("call_id", "note_idx", "note")
    for _ in range(max_rounds):
        batched = batch_notes(current, most)
        size = Window.partitionBy("call_id")
        batched = batched.withColumn("_batches", F.max("batch").over(size) + 1).withColumn("_notes", F.count("*").over(size))
        active = (F.col("_batches") > 1) & (F.col("_batches") < F.col("_notes"))
        if batched.where(active).isEmpty():
            break
        done = batched.where(~active).select("call_id", "note_idx", "note")
        current = done.unionByName(reduce(batched.where(active))).checkpoint()
    text = T.join_notes(F.transform(F.array_sort(F.collect_list(F.struct("note_idx", "note"))), lambda x: x["note"]))
    return current.groupBy("call_id").agg(text.alias("notes"), F.count("*").alias("n_notes"))


def speakers(tracks: DataFrame) -> DataFrame:
    """The user of each (call, name): the last track's, where names repeat."""
    return tracks.groupBy("call_id", F.col("display_name").alias("speaker")).agg(F.max_by("user_id", "track_idx").alias("user_id"))


def scrub_segments(merged: DataFrame, tracks: DataFrame, optout: DataFrame) -> DataFrame:
    """Segments less those of users who opted out; a name that no track has is allowed."""
    out = speakers(tracks).join(optout.select("user_id"), "user_id", "left_semi").select("call_id", "speaker")
    return merged.join(out, ["call_id", "speaker"], "left_anti")


def align_to_video(merged: DataFrame, calls: DataFrame) -> DataFrame:
    """Segments of calls with a video, on its clock."""
    more = ["video_path"] if "video_path" in calls.columns else []
    return merged.join(calls.where(F.col("video_offset_ms").isNotNull()).select("call_id", "video_offset_ms", *more), "call_id").withColumn("video_ms", T.video_time_ms(F.col("start_ms"), F.col("video_offset_ms").cast("long")))


def render_timecoded(aligned: DataFrame) -> DataFrame:
    """A call's lines with the video's time before each, under the video's path; ``aligned`` has video_path."""
    row = F.concat(F.lit("["), T.format_timecode(F.col("video_ms")), F.lit("] "), line())
    return aligned.groupBy("call_id").agg(F.concat(F.lit("# Timecoded transcript\n\nVideo: "), F.first("video_path"), F.lit("\n\n"), joined_lines(row)).alias("timecoded"))


def silent_calls(calls: DataFrame, segments: DataFrame) -> DataFrame:
    """Calls in which nobody said anything."""
    return calls.join(drop_blank_segments(segments).select("call_id").distinct(), "call_id", "left_anti")


def call_digest(calls: DataFrame, labelled: DataFrame, tracks: DataFrame, optout: DataFrame, single_pass: int = 8000, chunk: int = 4000, scrubbed: bool = True) -> DataFrame:
    """One row a call: counts, times, tokens, strategy, chunks and the transcript's md5.

    Strategy and chunks are of the full transcript; everything else leaves out
    the speech of users who opted out, if ``scrubbed``. A silent call keeps its
    row. All steps are keyed by call_id, so the segments are shuffled once.
    """
    full = timeline(labelled)
    shown = scrub_segments(full, tracks, optout) if scrubbed else full
    row = F.struct("pos", F.length(line()).cast("long").alias("chars"))
    packing = full.groupBy("call_id").agg(F.array_sort(F.collect_list(row)).alias("m")).select(
        "call_id", T.tokens_of(F.aggregate("m", F.lit(0).cast("long"), lambda a, x: a + x["chars"] + 1) - 1).alias("tokens"),
        (F.array_max(T.packed(F.transform("m", lambda x: T.tokens_of(x["chars"])), chunk)) + 1).cast("long").alias("n_chunks"))
    told = shown.groupBy("call_id").agg(F.count("*").alias("n_segments"), F.count_distinct("speaker").alias("n_speakers"), F.min("start_ms").alias("first_ms"), F.max("end_ms").alias("last_ms"), F.md5(joined_lines(line())).alias("transcript_md5"))
    out = calls.select("call_id").join(packing, "call_id", "left").join(told, "call_id", "left")
    strategy = F.when(F.col("tokens").isNull(), "silent").when(F.col("tokens") <= single_pass, "single").otherwise("map-reduce")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long")).alias(c)
    return out.select("call_id", zero("n_segments"), zero("n_speakers"), "first_ms", "last_ms", zero("tokens"), strategy.alias("strategy"), zero("n_chunks"), "transcript_md5")
