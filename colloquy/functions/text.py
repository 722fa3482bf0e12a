"""Scalar functions on columns: text, time, numbers and rendering. No Python runs on rows.

Lengths count code points. "Blank" and trimming follow all Unicode white space
and the byte-order mark, not only the space.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# States of a call, endings of media files, lines and limits of what is posted.
STATUSES = ["recording", "ready-to-process", "transcribing", "summarizing", "delivered", "failed"]
MEDIA_FILE = r"(?i)\.(mp4|mov|mkv|webm|avi|png|jpe?g|gif|webp)$"
NONE_LINE = "_None._"
NO_OVERVIEW, NO_SPEAKERS = "_No overview._", "_No per-speaker breakdown._"
REPLY_CHARS, SNIPPET_CHARS, POST_CHARS = 1900, 400, 1900


def ws_trim(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^[\s﻿]+|[\s﻿]+$", "")


def is_blank(text: Column) -> Column:
    return F.length(ws_trim(F.coalesce(text, F.lit("")))) == 0


def estimate_tokens(text: Column) -> Column:
    """A quarter of the length, rounded up."""
    return tokens_of(F.length(text))


def tokens_of(chars: Column) -> Column:
    return F.ceil(chars / 4).cast("long")


def truncate_tokens(text: Column, n: int) -> Column:
    return F.substring(text, 1, 4 * n)


def truncate_ellipsis(text: Column, n: int) -> Column:
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.substring(text, 1, n - 1), F.lit("…")))


def segment_line(speaker: Column, text: Column) -> Column:
    return F.concat(speaker, F.lit(": "), text)


def strip_code_fence(raw: Column) -> Column:
    """The text without an opening fence line (with or without a language) and a closing fence."""
    inner = F.regexp_replace(ws_trim(raw), r"^```[A-Za-z0-9]*[ \t]*\r?\n?", "")
    return ws_trim(F.regexp_replace(inner, r"\r?\n?```[ \t]*$", ""))


def format_timecode(ms: Column) -> Column:
    """MM:SS; minutes have two digits or more."""
    seconds = F.floor(ms / 1000)
    minutes = F.floor(seconds / 60).cast("string")
    return F.concat(F.when(F.length(minutes) < 2, F.lpad(minutes, 2, "0")).otherwise(minutes), F.lit(":"), F.lpad((seconds % 60).cast("string"), 2, "0"))


def video_time_ms(start_ms: Column, offset_ms: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), start_ms - offset_ms)


def seconds_to_ms(seconds: Column) -> Column:
    """Rounded half up, never below 0."""
    return F.greatest(F.lit(0).cast("long"), F.floor(seconds * 1000 + 0.5).cast("long"))


def make_call_id(started: Column, channel: Column) -> Column:
    return F.concat(F.date_format(started, "yyyy-MM-dd'T'HH-mm-ss-SSS'Z'"), F.lit("--"), channel)


def message_source_ref(channel: Column, message: Column) -> Column:
    return F.concat(F.lit("discord://channel/"), channel, F.lit("/message/"), message)


def is_media(content_type: Column, filename: Column) -> Column:
    """By content type where there is one (an empty one is none), else by the file's ending."""
    by_type = content_type.startswith("image/") | content_type.startswith("video/")
    return F.when(F.coalesce(content_type, F.lit("")) != "", by_type).otherwise(F.coalesce(filename, F.lit("")).rlike(MEDIA_FILE))


def bullet_list(items: Column) -> Column:
    return F.when(F.size(items) == 0, F.lit(NONE_LINE)).otherwise(F.array_join(F.transform(items, lambda x: F.concat(F.lit("- "), x)), "\n"))


def action_item_list(items: Column) -> Column:
    line = lambda x: F.concat(F.lit("- **"), x["owner"], F.lit(":** "), x["item"])
    return F.when(F.size(items) == 0, F.lit(NONE_LINE)).otherwise(F.array_join(F.transform(items, line), "\n"))


def join_notes(notes: Column) -> Column:
    block = lambda x, i: F.concat(F.lit("--- Notes "), (i + 1).cast("string"), F.lit(" ---\n"), x)
    return F.array_join(F.transform(notes, block), "\n\n")


def honesty_footer(censored: Column, reason: Column) -> Column:
    """How the answer was found, as small print; what isn't known is left out."""
    shown = F.when(censored.isNotNull(), F.concat(F.lit("graph_censored="), censored.cast("string")))
    why = F.when(reason.isNotNull(), F.concat(F.lit("termination="), reason))
    return F.concat(F.lit("-# "), F.concat_ws(" | ", F.lit("mode=fused"), shown, why))


def render_reply(question: Column, snippets: Column, sources: Column, footer: Column) -> Column:
    """Numbered snippets, trimmed and shortened, with their sources in small print and a blank line after each; the whole is shortened too."""
    source = lambda i: F.coalesce(F.get(sources, i), F.lit("unknown source"))
    block = lambda x, i: F.concat(F.lit("**"), (i + 1).cast("string"), F.lit(".** "), truncate_ellipsis(ws_trim(x), SNIPPET_CHARS), F.lit("\n-# "), source(i), F.lit("\n"))
    body = F.when(F.size(snippets) == 0, F.lit("No memories matched.")).otherwise(F.array_join(F.transform(snippets, block), "\n"))
    return truncate_ellipsis(F.concat_ws("\n", F.concat(F.lit("**Q:** "), question, F.lit("\n")), body, footer), REPLY_CHARS)


def thread_name(call_id: Column) -> Column:
    return F.substring(F.concat(F.lit("Call summary — "), call_id), 1, 100)


def format_addresses(addresses: Column) -> Column:
    """``name <address>`` or the address; entries without one are left out."""
    shown = lambda a: F.when(F.coalesce(a["name"], F.lit("")) != "", F.concat(a["name"], F.lit(" <"), a["address"], F.lit(">"))).otherwise(a["address"])
    return F.array_join(F.transform(F.filter(addresses, lambda a: F.coalesce(a["address"], F.lit("")) != ""), shown), ", ")


def is_permanent_rejection(status: Column) -> Column:
    return status.between(400, 499) & ~status.isin(408, 429)


def status_rank(status: Column) -> Column:
    """Place in the order of the state machine, from 0; -1 for anything else."""
    return (F.array_position(F.array(*map(F.lit, STATUSES)), status) - 1).cast("int")


def video_offset_ms(video_start: Column, call_start: Column) -> Column:
    return F.unix_millis(video_start) - F.unix_millis(call_start)


def packed(costs: Column, most: int) -> Column:
    """Greedy packing: for each cost the number of its pack; a pack closes before an item that would overfill it.

    The fold keeps where packs begin only.
    """
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))

    def step(acc, cost):
        fresh = (acc["at"] == 0) | (acc["n"] + cost > most)
        return F.struct(F.when(fresh, cost).otherwise(acc["n"] + cost).alias("n"), (acc["at"] + 1).alias("at"), F.when(fresh, F.concat(acc["starts"], F.array(acc["at"]))).otherwise(acc["starts"]).alias("starts"))

    return numbered(costs, F.aggregate(costs, start, step, lambda acc: acc["starts"]))


def numbered(items: Column, starts: Column) -> Column:
    """For each item the number of its pack, from 0, where packs begin at the places ``starts``."""
    packs = F.transform(F.array(starts), lambda s: F.transform(items, lambda _, i: F.size(F.filter(s, lambda at: at <= i)) - 1))
    return F.element_at(packs, 1)


def split_lines(text: Column, limit: int) -> Column:
    """Lines packed into parts of at most ``limit``; longer lines are cut; a part never starts with a blank line."""
    empty = F.array().cast("array<string>")
    start = F.struct(F.lit("").alias("cur"), empty.alias("parts"))
    flushed = lambda acc: F.when(acc["cur"] != "", F.concat(acc["parts"], F.array(acc["cur"]))).otherwise(acc["parts"])

    def step(acc, line):
        room = F.length(acc["cur"]) + 1 + F.length(line) <= limit
        cuts = F.transform(F.sequence(F.lit(0), F.floor((F.length(line) - 1) / limit).cast("int")), lambda i: F.substring(line, i * limit + 1, F.lit(limit)))
        long = F.struct(F.lit("").alias("cur"), F.concat(flushed(acc), cuts).alias("parts"))
        added = F.struct(F.when(acc["cur"] == "", line).otherwise(F.concat(acc["cur"], F.lit("\n"), line)).alias("cur"), acc["parts"].alias("parts"))
        fresh = F.struct(line.alias("cur"), flushed(acc).alias("parts"))
        return F.when(F.length(line) > limit, long).when((acc["cur"] == "") | room, added).otherwise(fresh)

    return F.aggregate(F.split(text, "\n"), start, step, flushed)
