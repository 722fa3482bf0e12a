"""Document fingerprints from closed syncmers, on DataFrame functions alone.

A k-mer of a text's UTF-8 bytes is a closed syncmer if the smallest of its
inner s-mers (by CRC, the leftmost of equal ones) is the first or the last of
them. That depends on the k-mer alone, so the same passage yields the same
anchors wherever it stands, and an edit disturbs only the k-mers that touch it.
The anchors of a text put together from two are those of its parts and of the
k - 1 bytes on either side of the seam.

A fingerprint is the sketch of a text's anchors: their SKETCH smallest distinct
32-bit hashes, each with the place of its first anchor. It is a sample of the
anchors that two texts draw alike; the method's output, not a limit on the work.
Two fingerprints are matched by place: of the smallest hashes of both together,
those in each are put in the order of the one text, and count where the other
text has them in that order as well. Their share estimates the Jaccard similarity
of the anchor sets for passages that keep their order, wherever they stand. A text
without a closed syncmer has its smallest k-mer as anchor, or, shorter than k,
itself.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, table

K = 12
S = 7
INNER = K - S + 1
SKETCH = 96
#: An anchor is one number: its hash above this many bits of its place.
PLACE = 31
#: Most ranges that documents are sorted in.
MOST_RANGES = 16_384


def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _places(data: Column, length: int) -> Column:
    """First bytes, from 1, of the runs of ``length``."""
    return F.sequence(F.lit(1), F.octet_length(data) - length + 1)


def _anchors(data: Column) -> Column:
    """Places from 0 of the closed syncmers of bytes that are K or more."""
    inner = F.transform(_places(data, S), lambda i: F.shiftleft(F.crc32(F.substring(data, i, F.lit(S))), PLACE) + (i - 1))

    def closed(h):
        def is_closed(x, p):  # beyond the end there is nothing to compare with, and the answer is null
            at = lambda j: F.get(h, p + j)
            first = reduce(lambda a, b: a & b, [x < at(j) for j in range(1, INNER)])
            last = reduce(lambda a, b: a & b, [at(INNER - 1) < (at(j) if j else x) for j in reversed(range(INNER - 1))])
            return first | last

        return F.transform(F.filter(h, is_closed), lambda x: x.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int"))

    return _let(inner, closed)


def _packed(data: Column, place: Column, at: Column) -> Column:
    """The anchor of the k-mer at ``place`` of ``data``, as one at ``at`` of the text."""
    return F.shiftleft(F.xxhash64(F.substring(data, place + 1, F.lit(K))).bitwiseAND(F.lit(0xFFFFFFFF)), PLACE) + at


def hash_of(anchor: Column) -> Column:
    return F.shiftright(anchor, PLACE)


def place_of(anchor: Column) -> Column:
    return anchor.bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int")


def anchors(text: Column) -> Column:
    """A text's closed syncmers as numbers (hash_of() and place_of() take them apart), in order of place in bytes; none for texts shorter than K bytes."""
    def found(data):
        return F.when(F.octet_length(data) >= K, F.transform(_anchors(data), lambda p: _packed(data, p, p))).otherwise(F.array().cast("array<bigint>"))

    return _let(F.encode(text, "UTF-8"), found)


def distinct(found: Column) -> Column:
    """Anchors by hash, the first in place of each."""
    return _let(F.array_sort(found), lambda a: F.filter(a, lambda x, i: (i == 0) | (hash_of(x) != hash_of(F.get(a, i - 1)))))


def fallback(text: Column) -> Column:
    """The sketch of a text that has no closed syncmer."""
    def chosen(data):
        least = F.array_min(F.transform(_places(data, K), lambda i: _packed(data, i - 1, i - 1)))
        return F.array(F.when(F.octet_length(data) >= K, least).otherwise(F.shiftleft(F.xxhash64(data).bitwiseAND(F.lit(0xFFFFFFFF)), PLACE)))

    return _let(F.encode(text, "UTF-8"), chosen)


def written(sketch: Column) -> Column:
    """Sixteen hexadecimal digits an anchor: its hash and its place."""
    digits = lambda x: F.lpad(F.lower(F.hex(x)), 8, "0")
    return F.array_join(F.transform(sketch, lambda x: F.concat(digits(hash_of(x)), digits(place_of(x)))), "")


def likeness(a: Column, b: Column) -> Column:
    """Estimated Jaccard similarity of the anchor sets behind two sketches, in so far as their anchors are in the same order."""
    hashes = lambda x: F.transform(x, hash_of)
    mine = lambda x, shared: F.filter(x, lambda y: F.array_contains(shared, hash_of(y)))

    def in_order(shared):
        # both are sorted by hash, so that they agree in what is where
        both = F.array_sort(F.zip_with(mine(a, shared), mine(b, shared), lambda x, y: F.struct(place_of(x).alias("a"), place_of(y).alias("b"))))
        return F.when(F.size(shared) == 0, 0).otherwise(_let(both, lambda s: F.size(F.filter(s, lambda x, i: (i == 0) | (x["b"] > F.get(s, i - 1)["b"])))))

    union = F.slice(F.array_sort(F.array_union(hashes(a), hashes(b))), 1, SKETCH)
    return _let(union, lambda u: _let(F.array_intersect(F.array_intersect(hashes(a), hashes(b)), u), in_order) / F.size(u))


def with_next(docs: DataFrame, order: list[str], carried: list[str], make) -> DataFrame:
    """make(docs) with next_x for each x of ``carried``, of the row that follows in ``order``; the first follows the last.

    Rows go to ranges of the first column of ``order``, once; the first row of
    each range also goes to the range before. ``make`` adds columns after that
    shuffle, and may not change the rows.
    """
    key = order[0]
    n = min(MOST_RANGES, 4 * parallelism(docs.sparkSession))
    bounds = sorted(set(docs.select(F.col(key).cast("double").alias("k")).approxQuantile("k", [i / n for i in range(1, n)], 0.25 / n)))
    # which range: first among every 64th bound, then among the 64 after it
    every = F.array(*map(F.lit, bounds[::64])).cast("array<double>")
    below = lambda a: F.size(F.filter(a, lambda x: x <= F.col(key)))
    group = F.greatest(below(every) - 1, F.lit(0))
    bucket = group * 64 + below(F.slice(F.array(*map(F.lit, bounds)).cast("array<double>"), group * 64 + 1, F.lit(64)))
    rows = docs.withColumn("_bucket", F.when(F.col(key).isNull(), 0).otherwise(bucket).cast("int"))
    firsts = sorted((r["_bucket"], r["first"]) for r in rows.groupBy("_bucket").agg(F.min(F.struct(*order)).alias("first")).select("_bucket", F.col(f"first.{key}").alias("first")).collect())  # one row a range
    plan = [(b, f, firsts[i - 1][0]) for i, (b, f) in enumerate(firsts)]
    kind = docs.schema[key].dataType.simpleString()
    starts = docs.sparkSession.createDataFrame(plan, f"_bucket int, _first {kind}, _before int")
    rows = rows.join(F.broadcast(starts), "_bucket", "left")
    own = F.struct(F.col("_bucket").alias("range"), F.lit(0).alias("late"))
    ghost = F.struct(F.col("_before").alias("range"), F.lit(1).alias("late"))
    rows = rows.withColumn("_to", F.explode(F.when(F.col(key).eqNullSafe(F.col("_first")), F.array(own, ghost)).otherwise(F.array(own)))).drop("_bucket", "_first", "_before")
    rows = rows.select("*", F.col("_to.range").alias("_range"), F.col("_to.late").alias("_late")).drop("_to")
    rows = make(rows.repartition("_range"))
    follows = Window.partitionBy("_range").orderBy("_late", *order)
    return rows.withColumns({f"next_{c}": F.lead(c).over(follows) for c in carried}).where(F.col("_late") == 0).drop("_range", "_late")


def fingerprinted(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited and near_next of every document.

    ``docs`` has doc_id and text (null: empty). The edited text has its last
    quarter (rounded down, in code points) replaced by as many of the next
    document's first, in the order of doc_id (nulls first, repeated ids by a
    hash of the text); the first document follows the last, so that a single
    document follows itself. Repeated rows are fingerprinted alike. A very long
    text takes some hundred bytes a character in the row that it is in. An empty
    table gives an empty result.
    """
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", text.alias("text")).withColumn("tie", F.xxhash64("text"))

    def make(df: DataFrame) -> DataFrame:
        n = F.length("text").cast("long")
        df = df.withColumns({"n_chars": n, "head": F.substring(F.col("text"), F.lit(1), (n - F.floor(n / 4)).cast("int"))})
        end = F.octet_length("head")
        both = _let(distinct(anchors(F.col("text"))), lambda a: F.struct(F.slice(a, 1, SKETCH).alias("whole"), F.slice(F.filter(a, lambda x: place_of(x) + K <= end), 1, SKETCH).alias("head")))
        df = df.withColumn("_both", both)
        whole = F.when(F.size("_both.whole") > 0, F.col("_both.whole")).otherwise(fallback(F.col("text")))
        return df.withColumns({"sketch": whole, "head_sketch": F.col("_both.head")}).drop("_both")

    rows = with_next(rows, ["doc_id", "tie"], ["text", "sketch"], make)
    added = F.substring(F.col("next_text"), F.lit(1), F.floor(F.col("n_chars") / 4).cast("int"))
    rows = rows.withColumns({"_added": added, "edited": F.concat("head", added)})
    head = F.encode("head", "UTF-8")
    seam = F.concat(F.substring(head, F.greatest(F.octet_length(head) - (K - 2), F.lit(1)), F.lit(K - 1)), F.encode("_added", "UTF-8"))
    before = F.greatest(F.octet_length(head) - (K - 1), F.lit(0))  # bytes ahead of the seam
    tail = F.struct(seam.alias("data"), before.alias("at"))
    tail = _let(tail, lambda t: F.when(F.octet_length(t["data"]) >= K, F.transform(_anchors(t["data"]), lambda p: _packed(t["data"], p, p + t["at"]))).otherwise(F.array().cast("array<bigint>")))
    rows = rows.withColumn("_joined", F.slice(distinct(F.concat("head_sketch", tail)), 1, SKETCH))
    rows = rows.withColumn("edited_sketch", F.when(F.size("_joined") > 0, F.col("_joined")).otherwise(fallback(F.col("edited"))))
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"), written(F.col("sketch")).alias("fingerprint"), written(F.col("edited_sketch")).alias("edited_fingerprint"),
        likeness(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"), likeness(F.col("sketch"), F.col("next_sketch")).alias("near_next"))


def op4_closed_syncmers(spark, sf_dir: str) -> DataFrame:
    """Every document's fingerprint, its edited text's, and their likeness."""
    return fingerprinted(table(spark, sf_dir, "documents").select("doc_id", "text"))
