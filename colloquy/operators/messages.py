"""Messages: normalising, consent, event envelopes, versions. All are narrow but for the keyed de-duplications.

Consent is two tables, channels allowed (channel_id) and users who opted out
(user_id), plus a flag that allows every channel. No join is hinted: Catalyst
broadcasts what is small by its statistics.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T
from colloquy.sources import contracts as C

REGION = "discord"


def display_name(member: Column, user: Column, user_id: Column) -> Column:
    """The first name that isn't null: the member's, the user's, the id."""
    return F.coalesce(member, user, user_id)


def normalize_messages(raw: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Guild messages by people that have text or an attachment; threads count to their parent channel.

    ``raw`` has mentions (array<string>) and, where there are any, attachments;
    ``keep`` names further columns to pass on.
    """
    has_file = F.size(F.coalesce("attachments", F.array())) > 0 if "attachments" in raw.columns else F.lit(False)
    real = ~F.col("is_partial") & ~F.col("author_is_bot") & ~F.col("is_system") & F.col("guild_id").isNotNull() & (~T.is_blank(F.col("content")) | has_file)
    more = ["attachments"] if "attachments" in raw.columns else []
    return raw.where(real).select(
        "message_id", "seq", "guild_id", F.coalesce("parent_id", "raw_channel_id").alias("channel_id"), F.when(F.col("parent_id").isNotNull(), F.col("raw_channel_id")).alias("thread_id"),
        "author_id", display_name(F.col("member_name"), F.col("username"), F.col("author_id")).alias("author_name"), "content", "ts", "reply_to", "mentions", *more, *(keep or []))


def normalize_deletes(raw: DataFrame) -> DataFrame:
    """Deletes outside direct messages; partial ones count."""
    parent = F.coalesce("parent_id", "channel_id") if "parent_id" in raw.columns else F.col("channel_id")
    return raw.where(F.col("guild_id").isNotNull()).select("guild_id", parent.alias("channel_id"), "message_id", "ts")


def gate_channel(df: DataFrame, channels: DataFrame, allow_all: bool = False) -> DataFrame:
    return df if allow_all else df.join(channels.select("channel_id"), "channel_id", "left_semi")


def gate_member(df: DataFrame, optout: DataFrame, column: str = "author_id") -> DataFrame:
    return df.join(optout.select(F.col("user_id").alias(column)), column, "left_anti")


def gate_with_reason(df: DataFrame, channels: DataFrame, optout: DataFrame, allow_all: bool = False) -> DataFrame:
    """``df`` with skip_reason: the channel is looked at before the author; null means that the row may be stored."""
    allowed = channels.select("channel_id").distinct().withColumn("_allowed", F.lit(True))
    out = optout.select(F.col("user_id").alias("author_id")).distinct().withColumn("_out", F.lit(True))
    df = df.join(allowed, "channel_id", "left").join(out, "author_id", "left")
    denied = F.lit(False) if allow_all else F.col("_allowed").isNull()
    return df.withColumn("skip_reason", F.when(denied, "channel-not-allowed").when(F.col("_out").isNotNull(), "author-opted-out")).drop("_allowed", "_out")


def scrub_mentions(df: DataFrame, optout: DataFrame) -> DataFrame:
    """``df`` with opted-out ids taken out of mentions; the order and repetitions of the rest stay, null becomes an empty list.

    Only lists that name somebody who opted out are gathered, by the list itself
    (rows that share a message_id keep their own lists). Empty lists, which many
    rows have in common, are not brought together.
    """
    some = F.size(F.coalesce("mentions", F.array())) > 0
    named = df.where(some).select("mentions", F.explode("mentions").alias("user_id")).distinct().join(optout.select("user_id"), "user_id", "left_semi")
    out = named.groupBy("mentions").agg(F.collect_set("user_id").alias("_out")).select(F.xxhash64("mentions").alias("_key"), F.col("mentions").alias("_listed"), "_out")
    # rows without a list spread over keys of their own, which no list has as its own
    keyed = df.withColumn("_key", F.when(some, F.xxhash64("mentions")).otherwise(F.xxhash64("message_id")))
    joined = keyed.join(out, (keyed["_key"] == out["_key"]) & (F.col("mentions") == F.col("_listed")), "left")
    kept = F.when(F.col("_out").isNull(), F.col("mentions")).otherwise(F.filter("mentions", lambda x: x.isNull() | ~F.array_contains("_out", x)))
    return joined.withColumn("mentions", F.coalesce(kept, F.array().cast("array<string>"))).select(*df.columns)


def source_ref() -> Column:
    return T.message_source_ref(F.col("channel_id"), F.col("message_id"))


def message_events(messages: DataFrame, edited: Column | None = None, region: str = REGION) -> DataFrame:
    """Envelopes of messages that aren't blank; mentions are those of ``messages``, which scrub_mentions() cleans."""
    return messages.where(~T.is_blank(F.col("content"))).select(
        F.lit("message").alias("event_type"), source_ref().alias("source_ref"), F.lit(region).alias("region"), "ts", "message_id", "channel_id", "author_id", "author_name", "content", "guild_id", "thread_id", "reply_to",
        F.coalesce("mentions", F.array().cast("array<string>")).alias("mentions"), (F.lit(False) if edited is None else edited).alias("edited"))


def attachments_of(messages: DataFrame) -> DataFrame:
    """Attachments, a row each, of normalised messages that list them as structs of id, url, filename and content_type."""
    return messages.select("channel_id", "message_id", "ts", F.explode("attachments").alias("a")).select(F.col("a.id").alias("media_id"), "a.url", "a.filename", "a.content_type", "channel_id", "message_id", "ts")


def media_events(attachments: DataFrame, region: str = REGION) -> DataFrame:
    """One envelope for each image or video, with its type where that is known, and the channel and message it is of."""
    more = ["ts"] if "ts" in attachments.columns else []
    return attachments.where(T.is_media(F.col("content_type"), F.col("filename"))).select(
        F.lit("media").alias("event_type"), F.concat(F.lit("media|"), "media_id").alias("source_ref"), F.lit(region).alias("region"), "media_id", "url", "filename", "content_type", "channel_id", "message_id", *more)


def tombstone_events(deletes: DataFrame, region: str = REGION) -> DataFrame:
    """A request to forget each deleted message; consent isn't asked."""
    return deletes.select(F.lit("tombstone-request").alias("event_type"), source_ref().alias("source_ref"), F.lit(region).alias("region"), "ts", "message_id")


#: What an event's keys are called in envelopes, where that differs.
ENVELOPE = {"type": "event_type", "timestamp": "ts", "target": "source_ref", "member_id": "author_id", "display_name": "author_name"}
# Fixed value: what a deleted message is forgotten for.
DELETED = "discord message deleted"


def payload(events: DataFrame) -> Column:
    """The JSON of each envelope as it is sent to the memory store, by sources.contracts.EVENTS; an envelope may lack columns that its kinds don't need."""
    kinds = {k: r for k, r in C.EVENTS.items() if k in ("message", "media", "member", "tombstone-request")}

    def value(name, kind):
        column = ENVELOPE.get(name, name)
        if name == "reason":
            return F.lit(DELETED).alias(name)
        return (F.col(column) if column in events.columns else F.lit(None).cast(C.ddl(kind))).alias(name)

    out = F.lit(None).cast("string")
    for kind, record in kinds.items():
        out = F.when(F.col("event_type") == kind, C.written(record, F.struct(*(value(n, c) for n, c in record.fields.items())))).otherwise(out)
    return out


def first_seen_members(messages: DataFrame, order: list[str]) -> DataFrame:
    """The first row of each author."""
    w = Window.partitionBy("author_id").orderBy(*order)
    return messages.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def member_events(members: DataFrame, optout: DataFrame, region: str = REGION) -> DataFrame:
    """Identities with their names; opted-out ones are left out, and no channel is asked."""
    return gate_member(members, optout).select(F.lit("member").alias("event_type"), F.concat(F.lit("member|"), "author_id").alias("source_ref"), F.lit(region).alias("region"), "ts", "author_id", "author_name")


def ingest(feed: DataFrame, channels: DataFrame, optout: DataFrame, allow_all: bool = False, members: bool = False, region: str = REGION) -> DataFrame:
    """Everything that leaves for the memory store of a feed of raw messages with ``kind`` (create, edit or delete).

    In one path: normalise, ask consent (channel, then author), scrub mentions,
    make envelopes of messages, their images and videos and, with ``members``,
    of each author's first row; deletes become tombstones without asking.
    Columns are those of the envelopes with event_key, and ``event``, the JSON.
    """
    spoken = normalize_messages(feed.where(F.col("kind").isin("create", "edit")), keep=["kind"])
    let = scrub_mentions(gate_member(gate_channel(spoken, channels, allow_all), optout), optout)
    said = message_events(let.withColumn("edited", F.col("kind") == "edit"), F.col("edited"))
    said = said.withColumn("event_key", event_key(F.when(F.col("edited"), "edit").otherwise("create"), F.col("source_ref"), F.col("ts")))
    gone = tombstone_events(normalize_deletes(feed.where("kind = 'delete'").withColumn("channel_id", F.col("raw_channel_id"))))
    parts = [said, gone.withColumn("event_key", event_key(F.lit("delete"), F.col("source_ref"), F.col("ts")))]
    if "attachments" in feed.columns:
        parts.append(media_events(attachments_of(let), region).withColumn("event_key", F.col("source_ref")))
    if members:
        parts.append(member_events(first_seen_members(spoken, ["ts", "message_id"]), optout, region).withColumn("event_key", F.col("source_ref")))
    events = union_events(*parts)
    return events.withColumn("event", payload(events))


def event_key(kind: Column, ref: Column, ts: Column) -> Column:
    """Identity for replays: an edit is another event than its message, a repeated delivery is not."""
    return F.when(kind == "edit", F.concat(ref, F.lit("|edit|"), F.unix_micros(ts.cast("timestamp")).cast("string"))).when(kind == "delete", F.concat(ref, F.lit("|delete"))).otherwise(ref)


def slot(message_id: Column, width: int) -> Column:
    """A stretch of ``width`` numbers that a message's id falls into; ids of one time are near each other, so a feed touches few stretches.

    An id without a number is in a stretch of its own, -1. All events of a
    message share its slot, so a sink that is partitioned by it finds a replayed
    event by looking into that slot alone.
    """
    return F.coalesce(F.floor(F.regexp_extract(message_id, "([0-9]+)", 1).try_cast("decimal(38,0)") / width), F.lit(-1)).cast("long")


def union_events(*events: DataFrame) -> DataFrame:
    """All envelopes in one table; what a kind lacks is null."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    return out


def dedupe_against_store(events: DataFrame, store: DataFrame, order: list[str], key: str = "event_key") -> DataFrame:
    """Events whose key the store lacks, the first of each key."""
    w = Window.partitionBy(key).orderBy(*order)
    fresh = events.join(store.select(key), key, "left_anti")
    return fresh.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def latest_version(log: DataFrame, keep_pending: bool = False) -> DataFrame:
    """The newest create or edit of each message; messages with a delete are hidden unless ``keep_pending``."""
    w = Window.partitionBy("source_ref").orderBy(F.desc("ts"), F.desc("event_id"))
    newest = log.where(F.col("kind").isin("create", "edit")).withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return newest if keep_pending else newest.join(log.where("kind = 'delete'").select("source_ref").distinct(), "source_ref", "left_anti")


def live_union_history(live: DataFrame, history: DataFrame) -> DataFrame:
    """Both feeds without replays, newest version of each message."""
    both = live.unionByName(history, allowMissingColumns=True)
    w = Window.partitionBy("event_key").orderBy("ts", "event_id")
    once = both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
    return latest_version(once)


def reply_edges(messages: DataFrame) -> DataFrame:
    """source_ref of each reply and of what it replies to; null where that isn't stored."""
    refs = messages.select(F.col("message_id").alias("reply_to"), source_ref().alias("target_ref"))
    return messages.where(F.col("reply_to").isNotNull()).select("message_id", "reply_to", source_ref().alias("source_ref")).join(refs, "reply_to", "left")


def route_inbound(raw: DataFrame, agent: str) -> DataFrame:
    """Direct messages and mentions of the agent, from people."""
    return raw.where(~F.col("author_is_bot") & ~F.col("is_system") & (F.col("guild_id").isNull() | F.array_contains("mentions", agent)))


def render_inbound(kind: Column, sender: Column, subject: Column, text: Column) -> Column:
    """What the agent reads of an email, a channel message or a direct message."""
    email = F.concat(F.lit("Email from "), sender, F.lit("\nSubject: "), F.coalesce(subject, F.lit("(no subject)")), F.lit("\n\n"), text)
    return F.when(kind == "email", email).when(kind == "channel", F.concat(F.lit("Channel message from "), sender, F.lit(":\n"), text)).otherwise(F.concat(F.lit("Direct message from "), sender, F.lit(":\n"), text))


def latest_names(seen: DataFrame) -> DataFrame:
    """The newest non-empty name of each (call_id, user_id)."""
    return seen.where(F.coalesce("name", F.lit("")) != "").groupBy("call_id", "user_id").agg(F.max_by("name", F.struct("ts", "event_id")).alias("name"))


def _below(messages: DataFrame, cursors: DataFrame | None) -> DataFrame:
    if cursors is None:
        return messages
    return messages.join(cursors.select("channel_id", "before"), "channel_id").where(F.col("before").isNull() | (F.col("seq") < F.col("before"))).drop("before")


def keyset_page(messages: DataFrame, cursors: DataFrame, size: int = 100) -> DataFrame:
    """The newest ``size`` messages of each channel below its own cursor: ``cursors`` has channel_id and before (null for the top).

    The limit is on row_number() itself, so that no more than a page of a
    channel is kept before the shuffle and after it.
    """
    w = Window.partitionBy("channel_id").orderBy(F.desc("seq"))
    return _below(messages, cursors).withColumn("page_pos", F.row_number().over(w)).where(F.col("page_pos") <= size)


def history_pages(messages: DataFrame, cursors: DataFrame | None = None, size: int = 100) -> DataFrame:
    """Every page of a walk back through each channel: ``page`` from 0 and ``page_pos`` from 1, newest first.

    With ``cursors`` (channel_id, before), only the channels listed, from below
    their cursors (null: from the top); so a walk goes on where it stopped.
    """
    below = _below(messages, cursors)
    w = Window.partitionBy("channel_id").orderBy(F.desc("seq"))
    place = F.row_number().over(w) - 1
    return below.withColumn("_at", place).withColumns({"page": F.floor(F.col("_at") / size).cast("int"), "page_pos": (F.col("_at") % size + 1).cast("int")}).drop("_at")


def next_cursors(walked: DataFrame) -> DataFrame:
    """Where the walk of each channel goes on: channel_id and before, the smallest seq that was walked."""
    return walked.groupBy("channel_id").agg(F.min("seq").alias("before"))


def skip_report(gated: DataFrame) -> DataFrame:
    """Messages by channel and outcome."""
    return gated.groupBy("channel_id").agg(F.count_if(F.col("skip_reason").isNull()).alias("emitted"), F.count_if(F.col("skip_reason") == "channel-not-allowed").alias("denied"), F.count_if(F.col("skip_reason") == "author-opted-out").alias("opted_out"))


def backfill_progress(gated: DataFrame, cursor: int = 0) -> DataFrame:
    """Of each channel: messages walked and stored, the oldest, and whether nothing is left below the cursor."""
    return gated.where(F.col("seq") >= cursor).groupBy("channel_id").agg(F.count("*").alias("walked"), F.count_if(F.col("skip_reason").isNull()).alias("stored"), F.min("seq").alias("oldest")).withColumn("done", F.lit(cursor == 0))


def walk_targets(raw: DataFrame) -> DataFrame:
    """Channels and threads that a backfill visits."""
    channels = raw.where(F.col("parent_id").isNull()).select(F.col("raw_channel_id").alias("target_id"), F.col("raw_channel_id").alias("channel_id"), F.lit("channel").alias("kind"))
    threads = raw.where(F.col("parent_id").isNotNull()).select(F.col("raw_channel_id").alias("target_id"), F.col("parent_id").alias("channel_id"), F.lit("thread").alias("kind"))
    return channels.union(threads).distinct()
