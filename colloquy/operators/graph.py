"""The memory graph: nodes, edges, versions and neighbourhoods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions import text as T


def memory_nodes(log: DataFrame) -> DataFrame:
    """A node for each message, author and channel of a message log: source_ref, kind and when it was first seen."""
    message = log.where("kind in ('create', 'edit')").select("source_ref", F.lit("message").alias("kind"), "ts")
    member = log.select(F.concat(F.lit("member|"), "author_id").alias("source_ref"), F.lit("member").alias("kind"), "ts")
    channel = log.select(F.concat(F.lit("channel|"), "channel_id").alias("source_ref"), F.lit("channel").alias("kind"), "ts")
    return message.union(member).union(channel).groupBy("source_ref", "kind").agg(F.min("ts").alias("first_seen"))


def memory_edges(log: DataFrame) -> DataFrame:
    """Distinct (src, kind, dst): who authored a message, and in which channel it is."""
    rows = log.where("kind in ('create', 'edit')")
    authored = rows.select(F.concat(F.lit("member|"), "author_id").alias("src"), F.lit("authored").alias("kind"), F.col("source_ref").alias("dst"))
    inside = rows.select(F.col("source_ref").alias("src"), F.lit("in_channel").alias("kind"), F.concat(F.lit("channel|"), "channel_id").alias("dst"))
    return authored.union(inside).distinct()


def call_edges(merged: DataFrame, facts: DataFrame | None = None) -> DataFrame:
    """Who spoke in a call, and what is part of it."""
    spoke = merged.select(F.concat(F.lit("member|"), "user_id").alias("src"), F.lit("spoke_in").alias("kind"), F.concat(F.lit("call|"), "call_id").alias("dst")).distinct()
    if facts is None:
        return spoke
    part = facts.select(F.concat_ws("|", "kind", "call_id", "idx").alias("src"), F.lit("part_of_call").alias("kind"), F.concat(F.lit("call|"), "call_id").alias("dst"))
    return spoke.union(part)


def message_links(messages: DataFrame, refs: DataFrame) -> DataFrame:
    """Edges of replies (resolved ones), threads and mentions of normalised messages; ``refs`` is from reply_edges()."""
    reply = refs.where(F.col("target_ref").isNotNull()).select(F.col("source_ref").alias("src"), F.lit("replies_to").alias("kind"), F.col("target_ref").alias("dst"))
    ref = F.concat(F.lit("discord://channel/"), "channel_id", F.lit("/message/"), "message_id")
    thread = messages.where(F.col("thread_id").isNotNull()).select(ref.alias("src"), F.lit("in_thread").alias("kind"), F.concat(F.lit("thread|"), "thread_id").alias("dst"))
    mention = messages.select(ref.alias("src"), F.lit("mentions").alias("kind"), F.explode("mentions").alias("m")).select("src", "kind", F.concat(F.lit("member|"), "m").alias("dst"))
    return reply.union(thread).union(mention).distinct()


def words(text: Column) -> Column:
    """Lower-cased words between single spaces, with one before and after: phrases are found in it as whole words."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def _pairs(ws: Column) -> Column:
    """Neighbouring words, joined by a space."""
    return F.zip_with(F.slice(ws, F.lit(1), F.size(ws) - 1), F.slice(ws, F.lit(2), F.size(ws) - 1), lambda a, b: F.concat(a, F.lit(" "), b))


#: Phrases that are broadcast at once, and refs that several texts have.
BROADCAST = 200_000


def phrase_keys(docs: DataFrame, phrases: DataFrame, most: int = BROADCAST) -> tuple[DataFrame, DataFrame]:
    """(ref, text) of the texts as words(), and (ref, text, phrase, w) of the texts that share a phrase's key.

    Texts are joined to phrases of a word by that, to longer ones by a pair of
    neighbouring words, of each phrase the pair that the fewest texts have. Words
    and pairs of texts stay in the task that reads them: ``most`` phrases are sent
    to all tasks at a time, in as many passes over the texts as that takes.
    """
    split = F.split(F.trim("w"), " ")
    wanted = phrases.select("phrase", words(F.col("phrase")).alias("w")).where(F.trim("w") != "").distinct()
    n, long = wanted.agg(F.count("*"), F.count_if(F.size(split) > 2)).first()
    known = docs.select("ref", words(F.col("text")).alias("text"))
    tokens = known.withColumn("_words", F.split(F.trim("text"), " ")).withColumn("_keys", F.array_distinct(F.concat("_words", _pairs(F.col("_words")))))
    tokens = tokens.select("ref", "text", F.explode("_keys").alias("key"))
    found, passes = None, max(1, -(-n // most))
    for i in range(passes):
        parts = wanted.where(F.pmod(F.xxhash64("w"), F.lit(passes)) == i).select("phrase", "w", F.explode(F.array_distinct(F.when(F.size(split) == 1, split).otherwise(_pairs(split)))).alias("key"))
        rarest = parts
        if long:  # others have a key only
            spread = tokens.join(F.broadcast(parts.where(F.size(split) > 2).select("key").distinct()), "key", "left_semi").groupBy("key").agg(F.count("*").alias("n"))
            rarest = parts.join(spread, "key", "left").groupBy("phrase", "w").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "key")).alias("k")).select("phrase", "w", F.col("k.key").alias("key"))
        one = tokens.join(F.broadcast(rarest), "key").select("ref", "text", "phrase", "w")
        found = one if found is None else found.unionByName(one)
    return known, found


def phrase_matches(docs: DataFrame, phrases: DataFrame, most: int = BROADCAST) -> DataFrame:
    """Distinct (ref, phrase) of the texts (ref, text) that have a phrase (phrase) as whole words, in any case.

    Only phrases of three words and more are verified beyond their key. Phrases
    without a word match nothing. Only refs that several texts have can match
    twice, so only their matches, which may be many more than texts, are shuffled.
    """
    pairs = phrase_keys(docs, phrases, most)[1]
    # a phrase of one or two words is verified by the join
    found = pairs.where((F.size(F.split(F.trim("w"), " ")) <= 2) | F.contains("text", F.col("w"))).select("ref", "phrase")
    repeated = docs.groupBy("ref").agg(F.count("*").alias("n")).where("n > 1").select(F.col("ref").alias("_ref"))
    n = repeated.limit(most + 1).count()
    if not n:
        return found
    if n > most:
        return found.distinct()
    same = F.col("ref").eqNullSafe(F.col("_ref"))
    return found.join(F.broadcast(repeated), same, "left_anti").unionByName(found.join(F.broadcast(repeated), same, "left_semi").distinct())


def _ref(kind: str, *cols) -> Column:
    return F.concat_ws("|", F.lit(kind), *cols)


def message_ref() -> Column:
    return T.message_source_ref(F.col("channel_id"), F.col("message_id"))


#: Kinds of facts that become nodes of their own, and what those are called.
FACT_NODES = {"decision": "decision", "action": "action_item", "speaker": "speaker_turn"}


def community_nodes(messages: DataFrame, media: DataFrame, calls: DataFrame, tracks: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """(source_ref, kind): a node for each message, member, channel, thread, media file, call, chunk, topic, decision, action item and speaker turn.

    ``messages`` are normalised, ``media`` has media_id and message_id, ``calls``
    call_id and channel_id, ``tracks`` call_id and user_id, ``chunks`` call_id,
    chunk and text, ``facts`` is summary.facts().
    """
    topics = facts.where("kind = 'topic'").select(_ref("topic", F.trim(words(F.col("body")))).alias("source_ref"), F.lit("topic").alias("kind"))
    facts_ = [facts.where(F.col("kind") == k).select(_ref(name, "call_id", "idx").alias("source_ref"), F.lit(name).alias("kind")) for k, name in FACT_NODES.items()]
    one = lambda df, kind, ref: df.select(ref.alias("source_ref"), F.lit(kind).alias("kind"))
    parts = [
        one(messages, "message", message_ref()), one(messages, "member", _ref("member", "author_id")), one(tracks, "member", _ref("member", "user_id")),
        one(messages, "channel", _ref("channel", "channel_id")), one(calls, "channel", _ref("channel", "channel_id")), one(messages.where("thread_id is not null"), "thread", _ref("thread", "thread_id")),
        one(media, "media", _ref("media", "media_id")), one(calls, "call", _ref("call", "call_id")), one(chunks, "chunk", _ref("chunk", "call_id", "chunk")), topics, *facts_]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.distinct()


def community_edges(messages: DataFrame, refs: DataFrame, media: DataFrame, calls: DataFrame, tracks: DataFrame, chunks: DataFrame, facts: DataFrame) -> DataFrame:
    """Distinct (src, kind, dst) between the nodes of community_nodes(): authored, in_channel, in_thread, replies_to, mentions, attached_to, spoke_in, part_of_call, about.

    A call is about the topics of its summary; chunks and messages are about
    every topic of any call whose words they have. ``refs`` is from
    messages.reply_edges().
    """
    edge = lambda df, src, kind, dst: df.select(src.alias("src"), F.lit(kind).alias("kind"), dst.alias("dst"))
    call = _ref("call", "call_id")
    topic = _ref("topic", F.trim(words(F.col("body"))))
    told = facts.where("kind = 'topic'").where(F.trim(words(F.col("body"))) != "")
    said = messages.select(message_ref().alias("ref"), F.col("content").alias("text")).unionByName(chunks.select(_ref("chunk", "call_id", "chunk").alias("ref"), "text"))
    found = phrase_matches(said, told.select(F.trim(words(F.col("body"))).alias("phrase")))
    attached = media.join(messages.select("message_id", message_ref().alias("ref")), "message_id")
    parts = [
        edge(messages, _ref("member", "author_id"), "authored", message_ref()), edge(messages, message_ref(), "in_channel", _ref("channel", "channel_id")), message_links(messages, refs),
        edge(attached, _ref("media", "media_id"), "attached_to", F.col("ref")), edge(tracks, _ref("member", "user_id"), "spoke_in", call), edge(calls, call, "in_channel", _ref("channel", "channel_id")),
        edge(chunks, _ref("chunk", "call_id", "chunk"), "part_of_call", call), *(edge(facts.where(F.col("kind") == k), _ref(name, "call_id", "idx"), "part_of_call", call) for k, name in FACT_NODES.items()),
        edge(told, call, "about", topic)]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    # what messages and chunks are about is distinct already, and none of the other edges
    return out.distinct().unionByName(edge(found, F.col("ref"), "about", _ref("topic", F.col("phrase"))))


def supersede_chain(log: DataFrame) -> DataFrame:
    """Each version of a message with its number and the event that replaced it."""
    w = Window.partitionBy("source_ref").orderBy("ts", "event_id")
    return log.where("kind in ('create', 'edit')").withColumns({"version": F.row_number().over(w), "superseded_by": F.lead("event_id").over(w)})


def neighbourhood(edges: DataFrame, anchors: DataFrame, hops: int, frontier_cap: int | None = None) -> DataFrame:
    """(query, node, hop) of nodes at most ``hops`` steps from each query's anchor, along edges either way.

    ``edges`` has src and dst, ``anchors`` query and node. The visited table is
    checkpointed each hop. With a cap, a query whose next frontier would exceed
    it stops there and its rows have ``censored`` set.
    """
    both = edges.select("src", "dst").union(edges.select("dst", "src")).distinct()
    seen = anchors.select("query", "node", F.lit(0).alias("hop"), F.lit(False).alias("censored")).checkpoint()
    for hop in range(1, hops + 1):
        last = seen.where((F.col("hop") == hop - 1) & ~F.col("censored"))
        step = last.join(both, F.col("node") == F.col("src")).select("query", F.col("dst").alias("node")).distinct()
        fresh = step.join(seen.select("query", "node"), ["query", "node"], "left_anti")
        if frontier_cap is not None:
            big = fresh.groupBy("query").count().where(F.col("count") > frontier_cap).select("query")
            fresh = fresh.join(big, "query", "left_anti")
            seen = seen.join(big.withColumn("_big", F.lit(True)), "query", "left").withColumn("censored", F.col("censored") | F.coalesce("_big", F.lit(False))).drop("_big")
        seen = seen.unionByName(fresh.select("query", "node", F.lit(hop).alias("hop"), F.lit(False).alias("censored"))).checkpoint()
    return seen
