"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the mix in proportion to its weight, but never
more than ``max_epochs`` times its own size. What a clamped source cannot take
is reshared among the others by weight until no source is above its cap. A
source whose target is e times its size then gives every document floor(e)
whole repetitions and one more to a seeded part of its documents.

The part is chosen by a 24-bit hash of the document id: documents enter in
hash order until their words come nearest to what is wanted. The cut-off is
found from two histograms (4096 coarse cells a source, then 4096 fine cells in
the one where the running sum crosses), so no task ever sorts a whole source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, kept, ranked, table, word_count

FINE = 4096
#: Up to this many sources the plan is broadcast; beyond, it is joined by source.
BROADCAST_SOURCES = 50_000


def hash24(key: Column, seed: int) -> Column:
    """First 24 bits of md5("seed:key"); null keys hash as the word null."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 6), 16, 10).cast("long")


def water_level(caps: DataFrame) -> tuple[int, int, float]:
    """(words left for unclamped sources, their weight, level) at the fixed point.

    ``caps`` has ``weight`` and ``cap``. A source is clamped while level * weight
    exceeds its cap; the level only rises, so it is the whole state of a round.
    """
    total, weights = caps.agg(F.sum("source_size"), F.sum("weight")).first()
    left, free = int(total or 0), int(weights or 0)
    level = left / free if free else 0.0
    while True:
        over = F.col("cap") < F.lit(level) * F.col("weight")
        clamped, rest = caps.agg(F.sum(F.when(over, F.col("cap")).otherwise(0)), F.sum(F.when(over, 0).otherwise(F.col("weight")))).first()
        left, free = int(total or 0) - int(clamped or 0), int(rest or 0)
        if not free:
            return left, 1, float("inf")
        if left / free == level:
            return left, free, level
        level = left / free


def mix_plan(sized: DataFrame, weights: tuple[int, ...], max_epochs: int) -> DataFrame:
    """Per source: source_size, target, whole repetitions and the hash cut-off of the fractional one.

    ``sized`` has source, size and cell (the 24-bit hash of the document).
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = ranked(totals, [F.col("source").asc_nulls_last()], "mix-sources")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    caps = kept(order.select("source", "source_size", weight.cast("long").alias("weight"), (F.col("source_size") * max_epochs).alias("cap")), "mix-caps")
    left, free, level = water_level(caps)
    share = F.lit(float(left)) * F.col("weight") / F.lit(float(free))
    target = F.when(F.col("cap") < F.lit(level) * F.col("weight"), F.col("cap").cast("double")).otherwise(share)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = caps.withColumn("target", target).withColumn("whole", whole).withColumn("need", F.floor(F.col("target") + 0.5).cast("long") - F.col("whole") * F.col("source_size"))
    plan = kept(plan.select("source", "source_size", "target", "whole", "need"), "mix-targets")

    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    coarse = sized.groupBy("source", F.floor(F.col("cell") / FINE).alias("coarse")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("coarse").rowsBetween(Window.unboundedPreceding, 0)
    coarse = coarse.withColumn("after", F.sum("words").over(run))
    crossing = (
        coarse.join(plan, same(coarse, plan)).where((F.col("after") - F.col("words") <= F.col("need")) & (F.col("after") > F.col("need")))
        .select(coarse["source"], "coarse", (F.col("after") - F.col("words")).alias("base"), "need")
    )
    crossing = kept(crossing, "mix-crossing")
    inside = sized.withColumn("coarse", F.floor(F.col("cell") / FINE))
    fine = inside.join(crossing, same(inside, crossing) & (inside["coarse"] == crossing["coarse"]))
    fine = fine.groupBy(inside["source"], crossing["coarse"], "base", "need", (F.col("cell") % FINE).alias("fine")).agg(F.sum("size").alias("words"))
    run = Window.partitionBy("source").orderBy("fine").rowsBetween(Window.unboundedPreceding, 0)
    fine = fine.withColumn("after", F.col("base") + F.sum("words").over(run))
    enters = 2 * F.col("after") - F.col("words") <= 2 * F.col("need")
    cut = fine.groupBy("source", "coarse").agg(F.coalesce(F.max(F.when(enters, F.col("fine"))), F.lit(-1)).alias("last"))
    cut = cut.select("source", (F.col("coarse") * FINE + F.col("last") + 1).alias("cut"))
    out = plan.join(cut, same(plan, cut), "left").select(plan["source"], "source_size", "target", "whole", F.when(F.col("need") <= 0, 0).otherwise(F.coalesce("cut", F.lit(FINE * FINE))).alias("cut"))
    return kept(out, "mix-plan")


def with_repetitions(docs: DataFrame, plan: DataFrame, seed: int, names: tuple[str, str, str] = ("source_size", "target", "repetitions")) -> DataFrame:
    """``docs`` with its source's size, its target and the repetitions, under ``names``; ``plan`` is from mix_plan()."""
    size, target, repetitions = names
    cell = hash24(F.col("doc_id"), seed)
    mine = plan.select(F.col("source").alias("_source"), F.col("source_size").alias(size), F.col("target").alias(target), F.col("whole").alias("_whole"), F.col("cut").alias("_cut"))
    if mine.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES:
        mine = F.broadcast(mine)
    docs = docs.drop(*names)
    out = docs.join(mine, docs["source"].eqNullSafe(mine["_source"]))
    return out.withColumn(repetitions, (F.col("_whole") + (cell < F.col("_cut")).cast("long")).cast("long")).drop("_source", "_whole", "_cut")


def mixed(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17, names: tuple[str, str, str] = ("source_size", "target", "repetitions")) -> DataFrame:
    """``docs`` (doc_id, source, text, more) with its source's size, its target and the repetitions.

    Size is the number of words (null text: 0). Sources go by code point with
    null last and take the weights in turn. Documents of size 0 follow their
    source's repetitions and add nothing; repeated rows count each time; an
    empty table gives an empty one. Columns of these names are replaced.
    """
    sized = kept(docs.select("source", word_count(F.col("text")).alias("size"), hash24(F.col("doc_id"), seed).alias("cell")), "mix-sizes")
    plan = mix_plan(sized, weights, max_epochs)
    return with_repetitions(docs, plan, seed, names)


def mixture_report(docs: DataFrame, weights: tuple[int, ...] = (5, 2, 1), max_epochs: int = 3, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, repetitions and taken; texts are read once."""
    sized = kept(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hash24(F.col("doc_id"), seed).alias("cell")), "mix-sizes")
    plan = mix_plan(sized.select("source", "size", "cell"), weights, max_epochs)
    out = with_repetitions(sized.drop("cell"), plan, seed)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("repetitions")).alias("taken"), "repetitions")


def repeated(docs: DataFrame, **params) -> DataFrame:
    """The mix itself: every document as often as its repetitions say, in the columns of ``docs``."""
    out = mixed(docs, names=("_mix_size", "_mix_target", "_mix_repetitions"), **params)
    return out.where(F.col("_mix_repetitions") > 0).withColumn("_mix_copy", F.explode(F.sequence(F.lit(1), F.col("_mix_repetitions").cast("int")))).select(*docs.columns)


def op2_source_mix(spark, sf_dir: str) -> DataFrame:
    """Every document with what the mix takes of it."""
    return mixture_report(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))


#: Same rule: recursive rounds for the level, then documents in hash order.
OP2_SQL = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size,
         ('0x' || substr(md5('17:' || COALESCE(doc_id::VARCHAR, 'null')), 1, 6))::BIGINT AS cell
  FROM documents),
totals AS (SELECT source, SUM(size)::BIGINT AS source_size FROM sized GROUP BY source),
caps AS (
  SELECT source, source_size, 3 * source_size AS cap,
         CASE (ROW_NUMBER() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END::BIGINT AS weight
  FROM totals),
rounds AS (
  SELECT 0 AS k, SUM(source_size)::DOUBLE AS remaining, SUM(weight)::DOUBLE AS free FROM caps
  UNION ALL
  SELECT r.k + 1,
         (SELECT SUM(source_size) FROM caps)::DOUBLE - (SELECT SUM(CASE WHEN cap < r.remaining / r.free * weight THEN cap ELSE 0 END) FROM caps)::DOUBLE,
         (SELECT SUM(CASE WHEN cap < r.remaining / r.free * weight THEN 0 ELSE weight END) FROM caps)::DOUBLE
  FROM rounds r WHERE r.k < 60 AND r.free > 0),
level AS (SELECT remaining, free FROM rounds WHERE free > 0 ORDER BY k DESC LIMIT 1),
plan AS (
  SELECT source, source_size,
         CASE WHEN cap < remaining / free * weight THEN cap::DOUBLE ELSE remaining * weight / free END AS target
  FROM caps, level),
goal AS (
  SELECT *, CASE WHEN source_size > 0 THEN FLOOR(target / source_size) ELSE 0 END::BIGINT AS whole FROM plan),
needed AS (SELECT *, FLOOR(target + 0.5)::BIGINT - whole * source_size AS need FROM goal),
cells AS (SELECT source, cell, SUM(size)::BIGINT AS words FROM sized GROUP BY source, cell),
runs AS (SELECT *, SUM(words) OVER (PARTITION BY source ORDER BY cell) AS after FROM cells)
SELECT s.doc_id, s.size, n.source_size, n.target,
       (s.size * (n.whole + CASE WHEN n.need > 0 AND 2 * r.after - r.words <= 2 * n.need THEN 1 ELSE 0 END))::BIGINT AS taken,
       (n.whole + CASE WHEN n.need > 0 AND 2 * r.after - r.words <= 2 * n.need THEN 1 ELSE 0 END)::BIGINT AS repetitions
FROM sized s JOIN needed n ON s.source IS NOT DISTINCT FROM n.source
JOIN runs r ON s.source IS NOT DISTINCT FROM r.source AND s.cell = r.cell
"""
