"""Spelling variants: words that differ by one letter, and the commoner word that a word is a variant of.

Words are arranged in a trie by how often they have each letter group (a level a
group; a code point's group is its remainder). One inserted, deleted or replaced
letter raises at most one of these counts and lowers at most one, by one each. A
depth-first search walks the trie with many words at once; each carries what it
has left of a surplus and a deficit of one, and only those that can afford a
branch go down it. Words of a leaf are verified letter by letter.

On Spark, the first levels of the trie are the key of a shuffle: a word is filed
under its own counts and asks at the keys its budget reaches. Keys with many
words are cut into blocks, and a word asks at each of them. A task builds the
trie of one block at a time and streams the asking words past it, so that it
holds a block and a batch, however many words ask. A batch gives each word's
count and best of that block; these are put together by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, table

# What a word is.
RUN = r"[a-zÀ-ÿ]+"
LEAST_LENGTH, LEAST_COUNT = 6, 5
DELETE_EVERY = 199
FORM_RATIO = 5

#: Letter groups: code points by remainder, the commonest letters of European languages first.
GROUPS = 32
LEVELS = [ord(c) % GROUPS for c in "entiarsouhldcmgbvfpwkzyqxj"]
LEVELS += [g for g in range(GROUPS) if g not in LEVELS]
#: Levels that make a key; counts in a key stop at TOP, which bounds the keys by (TOP + 1) ** DEPTH.
DEPTH, TOP = 4, 7
#: Words of a block, asking words of a batch, words of a leaf.
BLOCK, BATCH, LEAF = 4096, 4096, 32
#: Letters compared at once.
CELLS = 4_000_000

FOUND = "word string, n_near long, best_n long, best string"


def noisy_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The runs of every text as ``word``, A-Z lower-cased; where a hash of document and run says so, one letter is left out."""
    low = F.translate(F.col(text), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    # only runs that can give a word
    runs = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN[:-1] + f"{{{LEAST_LENGTH},}}"), F.lit(0))).alias("run"))
    hashed = runs.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    return hashed.select(F.when(F.col("h") % DELETE_EVERY == 0, less).otherwise(F.col("run")).alias("word"))


def vocabulary(words: DataFrame, least_length: int = LEAST_LENGTH, least_count: int = LEAST_COUNT) -> DataFrame:
    """Distinct words with how often each occurs (``n``), if long and frequent enough."""
    return words.where(F.length("word") >= least_length).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _counts(word: Column) -> list[Column]:
    """How often a word has a letter of each of the groups that make the key."""
    def group(g):
        letters = "".join(chr(c) for c in range(32, 0x250) if c % GROUPS == g)
        return F.length(word) - F.length(F.translate(word, letters, ""))

    return [group(g) for g in LEVELS[:DEPTH]]


def _key(counts: list[Column]) -> Column:
    return reduce(lambda a, b: a * (TOP + 1) + b, (F.least(F.greatest(c, F.lit(0)), F.lit(TOP)) for c in counts)).cast("int")


def _asked(counts: list[Column]) -> Column:
    """The keys that a surplus and a deficit of one reach, without repeats."""
    moved = lambda up, down: _key([c + int(i == up) - int(i == down) for i, c in enumerate(counts)])
    some = range(-1, DEPTH)
    return F.array_distinct(F.array(*(moved(up, down) for up in some for down in some if up == -1 or up != down)))


class Trie:
    """A block's words in order of their count vectors; a node is a range of them and a level."""

    def __init__(self, words: list[str], n: list[int]):
        vectors = count_vectors(words)
        order = np.lexsort(vectors.T[::-1])
        self.words, self.n, self.vectors = [words[i] for i in order], np.array(n, np.int64)[order], vectors[order]
        self.left, self.right, self.lengths = letters(self.words)
        # place of each word in order of its letters, which settles ties
        self.place = np.empty(len(words), np.int64)
        self.place[sorted(range(len(words)), key=self.words.__getitem__)] = np.arange(len(words))

    def search(self, asking: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (index into ``asking``, index into words) that differ by one letter."""
        vectors = count_vectors(asking)
        left, right, lengths = letters(asking)
        pairs = []
        nothing = np.zeros(len(asking), np.int16)
        stack = [(0, len(self.words), 0, np.arange(len(asking)), nothing, nothing)]
        while stack:
            lo, hi, level, who, surplus, deficit = stack.pop()
            if hi - lo <= LEAF or level == GROUPS:
                pairs.extend(self._verified(lo, hi, who, left, right, lengths))
                continue
            column = self.vectors[lo:hi, level]
            starts = np.flatnonzero(np.diff(column, prepend=-1))
            mine = vectors[who, level]
            for a, b in zip(starts, [*starts[1:], hi - lo], strict=True):
                more = column[a] - mine
                s, d = surplus + np.maximum(more, 0), deficit + np.maximum(-more, 0)
                able = np.flatnonzero((s <= 1) & (d <= 1))
                if len(able):
                    stack.append((lo + a, lo + b, level + 1, who[able], s[able], d[able]))
        if not pairs:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return tuple(np.concatenate(x) for x in zip(*pairs, strict=True))

    def _verified(self, lo: int, hi: int, who: np.ndarray, left: np.ndarray, right: np.ndarray, lengths: np.ndarray):
        """Pairs of a leaf whose common beginning and common end leave out one letter of the longer word."""
        step = max(1, CELLS // (self.left.shape[1] * BATCH // 8))  # the words of a leaf at once
        for a in range(lo, hi, step):
            b = min(hi, a + step)
            i, j = (x.ravel() for x in np.meshgrid(who, np.arange(a, b), indexing="ij"))
            longer, shorter = np.maximum(lengths[i], self.lengths[j]), np.minimum(lengths[i], self.lengths[j])
            fits = longer - shorter <= 1
            i, j, longer, shorter = i[fits], j[fits], longer[fits], shorter[fits]
            if not len(i):
                continue
            width = min(int(shorter.max()), left.shape[1], self.left.shape[1])
            head = _alike(left[i, :width], self.left[j, :width])
            tail = _alike(right[i, :width], self.right[j, :width])
            near = (np.minimum(head, shorter) + np.minimum(tail, shorter) >= longer - 1) & ~((head >= longer) & (longer == shorter))
            if near.any():
                yield i[near], j[near]


def _alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row."""
    differ = a != b
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def count_vectors(words: list[str]) -> np.ndarray:
    """Letter group counts of each word, levels in order."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    cells = np.bincount(np.repeat(np.arange(len(words)), n) * GROUPS + points % GROUPS, minlength=len(words) * GROUPS)
    return cells.reshape(len(words), GROUPS)[:, LEVELS].astype(np.int16)


def letters(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of each word from its beginning and from its end, with zeros after them; lengths."""
    n = np.fromiter(map(len, words), np.int64, len(words))
    points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    top = int(n.max(initial=1))
    left, right = np.zeros((len(words), top), np.uint16), np.zeros((len(words), top), np.uint16)
    row = np.repeat(np.arange(len(words)), n)
    at = np.arange(len(points)) - np.repeat(np.cumsum(n) - n, n)
    left[row, at] = right[row, np.repeat(n, n) - 1 - at] = np.minimum(points, 0xFFFF)
    return left, right, n


def _search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows come by (key, block), filed words (asks = 0) before asking ones."""
    at, words, n, trie = None, [], [], None
    for batch in batches:
        cuts = np.flatnonzero((np.diff(batch["key"].to_numpy(), prepend=-1) != 0) | (np.diff(batch["block"].to_numpy(), prepend=-1) != 0) | (np.diff(batch["asks"].to_numpy(), prepend=-1) != 0))
        for lo, hi in zip(cuts, [*cuts[1:], len(batch)], strict=True):
            part = batch.iloc[lo:hi]
            group = (part["key"].iat[0], part["block"].iat[0])
            if group != at:
                at, words, n, trie = group, [], [], None
            if part["asks"].iat[0] == 0:
                words += part["word"].tolist()
                n += part["n"].tolist()
                continue
            if not words:
                continue
            trie = trie or Trie(words, n)
            for a in range(0, len(part), BATCH):
                asking = part["word"].iloc[a : a + BATCH].tolist()
                i, j = trie.search(asking)
                if not len(i):
                    continue
                # the largest n, then the first word, comes first of each asking word's
                order = np.lexsort((trie.place[j], -trie.n[j], i))
                i, j = i[order], j[order]
                first = np.flatnonzero(np.diff(i, prepend=-1))
                yield pd.DataFrame({"word": [asking[x] for x in i[first]], "n_near": np.diff([*first, len(i)]), "best_n": trie.n[j[first]], "best": [trie.words[x] for x in j[first]]})


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best) of the words (word, n) that have a near one.

    Words are distinct and not null. Two are near if one inserted, deleted or
    replaced code point makes them equal. The best has the largest n, and
    comes first by code points among such. No words give no rows.
    """
    keyed = kept(words.select("word", "n", _key(_counts(F.col("word"))).alias("key"), _asked(_counts(F.col("word"))).alias("keys")), "variants-keys")
    # at most (TOP + 1) ** DEPTH rows
    blocks = F.broadcast(keyed.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")))
    filed = keyed.join(blocks, "key").select("key", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int").alias("block"), F.lit(0).alias("asks"), "word", "n")
    asking = keyed.select("word", "n", F.explode("keys").alias("key")).join(blocks, "key")
    asking = asking.select("key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.lit(1).alias("asks"), "word", "n")
    rows = filed.unionByName(asking).repartition("key", "block").sortWithinPartitions("key", "block", "asks")
    found = rows.mapInPandas(_search, FOUND)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def rooted(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): forms followed to the last, doubling the steps each round.

    A form is FORM_RATIO times as frequent as its word, so chains are short and
    have no cycles.
    """
    up = kept(forms.select("word", F.col("form").alias("root")), "variants-up")
    while True:
        on = up.select(F.col("word").alias("root"), F.col("root").alias("further"))
        up = kept(up.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "variants-up")
        if up.where("moved").isEmpty():
            return up.select("word", "root")
        up = up.select("word", "root")


def spelling_variants(words: DataFrame, ratio: int = FORM_RATIO) -> DataFrame:
    """Of each of the words (word, n): form, root, n_near and form_n.

    Null words are left out, repeated ones (which a vocabulary() doesn't have)
    count as one with their n added up. Other columns aren't kept. No words
    give no rows. A word's length has no bound.
    """
    words = kept(words.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("n").alias("n")), "variants-words")
    joined = words.join(near_words(words), "word", "left")
    is_form = F.coalesce(F.col("best_n") >= ratio * F.col("n"), F.lit(False))
    out = kept(joined.select("word", F.when(is_form, F.col("best")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("best_n")).alias("form_n")), "variants-forms")
    roots = rooted(out.where("form IS NOT NULL").select("word", "form"))
    return out.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling_variants(vocabulary(noisy_runs(table(spark, sf_dir, "documents"))))
