"""Structured summaries: strict validation, one repair pass, consent scrubbing, facts and rendering.

A summary is JSON as sources.contracts.SUMMARY declares it; columns have its
names in snake case.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.sources import contracts as D
from colloquy.sources import io
from colloquy.sources.io import document_errors

from . import transcript as C

SUMMARY = D.ddl(D.SUMMARY)


def parse_model_json(raw: Column) -> Column:
    """The variant inside a model's answer, without a code fence; null if it isn't JSON."""
    return F.try_parse_json(T.strip_code_fence(raw))


def summary_errors(v: Column) -> Column:
    """Errors of a parsed summary, each at the path of the element that has it."""
    return document_errors(D.SUMMARY, v)


def validated(rows: DataFrame, raw: str = "raw") -> tuple[DataFrame, DataFrame]:
    """(rows with ``summary``, rejected rows with ``errors``)."""
    marked = rows.withColumn("_v", parse_model_json(F.col(raw))).withColumn("errors", summary_errors(F.col("_v")))
    good = marked.where("errors = ''").withColumn("summary", D.parsed(D.SUMMARY, F.col("_v"))).drop("_v", "errors", raw)
    return good, marked.where("errors <> ''").drop("_v")


def no_repair(batches):
    """The default repairer: keeps what lies between the first and the last brace, or nothing."""
    for pdf in batches:
        cut = pdf["raw"].str.extract(r"(?s)(\{.*\})")[0]
        yield pdf.drop(columns=["errors"]).assign(raw=cut.fillna(""))


def validate_with_repair(rows: DataFrame, repairer=no_repair) -> tuple[DataFrame, DataFrame]:
    """Valid summaries after at most one repair of each rejected row, and what is still rejected.

    ``repairer`` maps batches with ``raw`` and ``errors`` to batches without ``errors``.
    """
    good, bad = validated(rows)
    repaired = bad.mapInPandas(repairer, bad.drop("errors").schema)
    again, rejects = validated(repaired)
    return good.unionByName(again), rejects


def scrub_action_items(summaries: DataFrame, out_names: DataFrame) -> DataFrame:
    """Whole-call action items of opted-out owners become ``unassigned``; ``out_names`` has call_id and names (array)."""
    rows = summaries.join(out_names, "call_id", "left").withColumn("_out", F.coalesce("names", F.array().cast("array<string>")))
    out = F.col("_out")
    items = F.transform("summary.full_call.action_items", lambda x: F.struct(F.when(F.array_contains(out, x["owner"]), "unassigned").otherwise(x["owner"]).alias("owner"), x["item"].alias("item")))
    return rows.withColumn("summary", F.col("summary").withField("full_call.action_items", items)).drop("names", "_out")


def scrub_speaker_sections(summaries: DataFrame, out_names: DataFrame) -> DataFrame:
    """Sections of opted-out speakers go; owners inside the sections that stay are left as they are."""
    rows = summaries.join(out_names, "call_id", "left").withColumn("_out", F.coalesce("names", F.array().cast("array<string>")))
    out = F.col("_out")
    kept = F.filter("summary.per_speaker", lambda s: ~F.array_contains(out, s["display_name"]))
    return rows.withColumn("summary", F.col("summary").withField("per_speaker", kept)).drop("names", "_out")


def facts(summaries: DataFrame) -> DataFrame:
    """One row a topic, decision, question, action item and speaker section: call_id, kind, idx, owner, body. One pass over the summaries."""
    none = F.lit(None).cast("string")
    full = "summary.full_call."

    def listed(kind, array, owner, body):
        one = lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("idx"), owner(x).alias("owner"), body(x).alias("body"))
        return F.transform(array, one)

    parts = [listed(kind, full + name, lambda x: none, lambda x: x) for kind, name in (("topic", "key_topics"), ("decision", "decisions"), ("question", "open_questions"))]
    parts.append(listed("action", full + "action_items", lambda x: x["owner"], lambda x: x["item"]))
    parts.append(listed("speaker", "summary.per_speaker", lambda x: x["display_name"], lambda x: F.array_join(x["contributions"], "\n")))
    return summaries.select("call_id", F.explode(F.concat(*parts)).alias("f")).select("call_id", "f.*")


def render_summary_md(s: Column, video: Column) -> Column:
    """The summary as Markdown; a video line only where there is a video."""
    full = s["full_call"]
    section = lambda title, body: F.concat(F.lit(f"\n## {title}\n"), body)
    each = lambda x: F.concat_ws(
        "\n", F.concat(F.lit("\n### "), x["display_name"]), F.lit("**Contributions**"), T.bullet_list(x["contributions"]),
        F.lit("**Positions / concerns**"), T.bullet_list(x["positions_concerns"]), F.lit("**Action items**"), T.action_item_list(x["action_items"]))
    overview = T.ws_trim(F.coalesce(full["overview"], F.lit("")))
    speakers = F.when(F.size(s["per_speaker"]) == 0, F.lit(T.NO_SPEAKERS)).otherwise(F.array_join(F.transform(s["per_speaker"], each), "\n"))
    return F.concat_ws(
        "\n", F.lit("# Call summary"), F.when(video.isNotNull(), F.concat(F.lit("\n📹 Video recorded (aligned) — "), video)),
        section("Overview", F.when(overview == "", T.NO_OVERVIEW).otherwise(overview)), section("Key topics", T.bullet_list(full["key_topics"])), section("Decisions", T.bullet_list(full["decisions"])),
        section("Open questions", T.bullet_list(full["open_questions"])), section("Action items", T.action_item_list(full["action_items"])), section("Per-speaker", speakers))


def summary_parts(summaries: DataFrame, limit: int = T.POST_CHARS) -> DataFrame:
    """call_id, part (from 0) and body of each summary as it is posted; ``summaries`` has call_id, summary and video (null for none)."""
    text = render_summary_md(F.col("summary"), F.col("video"))
    return summaries.select("call_id", F.posexplode(T.split_lines(text, limit)).alias("part", "body"))


def call_artifacts(merged: DataFrame, summaries: DataFrame, calls: DataFrame) -> DataFrame:
    """(call_id, name, body): the text files of each summarised call, as they are published together.

    The transcript and the summary as documents, the summary as Markdown and, of
    calls with a video (video_offset_ms isn't null), the timecoded transcript.
    """
    told = summaries.select("call_id", "summary").join(calls.select("call_id", F.when(F.col("video_offset_ms").isNotNull(), F.col("video_path")).alias("video")), "call_id")
    segment = F.struct("pos", F.struct("speaker", "start_ms", "end_ms", "text").alias("s"))
    said = merged.groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments")).join(told.select("call_id"), "call_id", "left_semi")
    timecoded = C.render_timecoded(C.align_to_video(merged, calls)).join(told.select("call_id"), "call_id", "left_semi")
    file = lambda df, name, body: df.select("call_id", F.lit(name).alias("name"), body.alias("body"))
    parts = [
        file(said, io.TRANSCRIPT_FILE, D.written(D.TRANSCRIPT, F.struct("call_id", "segments"))), file(told, io.SUMMARY_FILE, D.written(D.SUMMARY, F.col("summary"))),
        file(told, io.MARKDOWN_FILE, render_summary_md(F.col("summary"), F.col("video"))), file(timecoded, io.TIMECODED_FILE, F.col("timecoded"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def output_events(merged: DataFrame, summaries: DataFrame, tracks: DataFrame, calls: DataFrame, channels: DataFrame, optout: DataFrame, region: str = "discord", allow_all: bool = False) -> DataFrame:
    """The two events of each call in an allowed channel: event_type, call_id and event, JSON as it is sent.

    The transcript lists its segments, the summary is whole; an empty overview
    becomes the call's name. Users who opted out lose their segments, their
    speaker sections and the ownership of whole-call action items; a name that
    no track has is nobody's. ``merged`` has pos, speaker, start_ms, end_ms and
    text; ``summaries`` call_id and summary. A call without segments has an
    empty list.
    """
    allowed = calls.select("call_id", "channel_id") if allow_all else calls.select("call_id", "channel_id").join(channels.select("channel_id").distinct(), "channel_id", "left_semi")
    out = C.speakers(tracks).join(optout.select("user_id").distinct(), "user_id", "left_semi").groupBy("call_id").agg(F.collect_set("speaker").alias("names"))
    segment = F.struct("pos", F.struct("speaker", "start_ms", "end_ms", "text").alias("s"))
    spoken = C.scrub_segments(merged, tracks, optout).groupBy("call_id").agg(F.transform(F.array_sort(F.collect_list(segment)), lambda x: x["s"]).alias("segments"))
    kind = spoken.schema["segments"].dataType
    said = allowed.join(spoken, "call_id", "left").select(F.lit("transcript").alias("type"), "call_id", "channel_id", F.coalesce("segments", F.array().cast(kind)).alias("segments"), F.lit(region).alias("region"))
    scrubbed = scrub_speaker_sections(scrub_action_items(summaries.select("call_id", "summary"), out), out).join(allowed.select("call_id"), "call_id", "left_semi")
    overview = F.col("summary.full_call.overview")
    told = scrubbed.select(F.lit("summary").alias("type"), "call_id", F.col("summary").withField("full_call.overview", F.when(T.is_blank(overview), F.concat(F.lit("Call "), "call_id")).otherwise(overview)).alias("summary"), F.lit(region).alias("region"))
    event = lambda df, type_: df.select(F.col("type").alias("event_type"), "call_id", D.written(D.EVENTS[type_], F.struct(*df.columns)).alias("event"))
    return event(said, "transcript").unionByName(event(told, "summary"))
