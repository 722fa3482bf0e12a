"""Language ID by multilingual mixture inference.

Every word of a text is taken as written in one of the known languages, and has
a likelihood in each: the product of the chances of its letters after the two
before (letter trigrams, with the start of the word). Expectation-maximisation
finds the proportions of the languages under which the text's words are
likeliest. Candidates for the language set are the k leading languages, k = 1,
2, ...; for each, the proportions are fitted anew within the set. The set is the
one whose log likelihood less (k - 1) * PENALTY * log(words) is largest; the
leading language of its own proportions is the prediction and that language's
proportion the score.

The trigram tables come from a bounded sample (SAMPLE_TEXTS a language, of longer
texts a window of SAMPLE_CHARS); prediction is a map over whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .chars import batches, coded
from .common import small_batches, table, window

CODES = 64
SMOOTH = 0.05
EM_ROUNDS = 12
PENALTY = 1.0
SAMPLE_TEXTS = 600
SAMPLE_CHARS = 20_000
UNKNOWN = "und"


@dataclass
class Model:
    """Languages, and the log chance of a letter after two others in each: a row for each trigram, a column for each language."""

    languages: list[str]
    logs: np.ndarray


def word_grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Trigram at each letter; which of these begin words; the text of each word; words of each text."""
    codes, starts, ends = coded(texts, 2, False, CODES)
    c = codes.astype(np.int32)
    at = np.flatnonzero(c)
    before = c[at - 1]
    grams = (np.where(before > 0, c[at - 2], 0) * CODES + before) * CODES + c[at]
    first = np.flatnonzero(before == 0)
    owner = np.searchsorted(ends, at[first], side="right")
    return grams, first, owner, np.bincount(owner, minlength=len(texts))


def fit(texts: list[str], langs: list[str]) -> Model:
    languages = sorted(set(langs))
    logs = np.zeros((CODES**3, max(1, len(languages))), np.float32)
    for j, lang in enumerate(languages):
        counts = np.zeros(CODES**3)
        for _, part in batches([t for t, x in zip(texts, langs, strict=True) if x == lang]):
            counts += np.bincount(word_grams(part)[0], minlength=CODES**3)
        pairs = counts.reshape(CODES * CODES, CODES) + SMOOTH
        logs[:, j] = np.log(pairs / pairs.sum(axis=1, keepdims=True)).reshape(-1)
    return Model(languages, logs)


def _proportions(like: np.ndarray, words: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions of each text after rounds of expectation-maximisation; what starts at 0 stays there. ``words`` counts each text's rows of ``like``."""
    cuts, owner = np.cumsum(words) - words, np.repeat(np.arange(len(words)), words)
    for _ in range(rounds):
        part = like * start[owner]
        part /= np.maximum(part.sum(axis=1, keepdims=True), 1e-300)
        start = np.add.reduceat(part, cuts, axis=0) / words[:, None]
    return start


def _likelihood(like: np.ndarray, words: np.ndarray, share: np.ndarray) -> np.ndarray:
    """Log likelihood of each text."""
    each = np.log(np.maximum((like * share[np.repeat(np.arange(len(words)), words)]).sum(axis=1), 1e-300))
    return np.add.reduceat(each, np.cumsum(words) - words)


def mixture(texts: list[str], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Proportions of the languages in each text's set (0 outside), how many there are in the set, and the text's words.

    Sets are tried from one language on, each with one more of the languages in
    the order of their share of all. A text is done when no larger set can win:
    the likelihood of any proportions is at most that of all languages' and a
    term that tells how far these are from the best, and the penalty grows.
    """
    grams, first, owner, words = word_grams(texts)
    n, k = len(texts), len(model.languages)
    share, chosen = np.full((n, k), 1.0 / k), np.ones(n, np.int64)
    if not len(first):
        return share, chosen, words
    like = np.add.reduceat(model.logs[grams], first, axis=0).astype(np.float64)
    like = np.exp(like - like.max(axis=1, keepdims=True))  # up to a factor for each word, which no comparison needs
    have = np.flatnonzero(words)
    count = words[have]
    full = _proportions(like, count, share[have], EM_ROUNDS)
    mixed = np.maximum((like * full[np.repeat(np.arange(len(have)), count)]).sum(axis=1, keepdims=True), 1e-300)
    slope = np.add.reduceat(like / mixed, np.cumsum(count) - count, axis=0) / count[:, None]
    most = np.add.reduceat(np.log(mixed[:, 0]), np.cumsum(count) - count) + count * np.log(np.maximum(slope.max(axis=1), 1.0))
    penalty = PENALTY * np.log(count + 1.0)
    full = np.maximum(full, 1e-12)
    order = np.argsort(-full, axis=1, kind="stable")
    best, own_share, size_of = np.full(len(have), -np.inf), np.zeros((len(have), k)), np.ones(len(have), np.int64)
    for size in range(1, k + 1):
        open_ = np.flatnonzero(most - (size - 1) * penalty > best - 1e-6)
        if not len(open_):
            break
        mine = np.repeat(np.isin(np.arange(len(have)), open_), count)
        start, top = np.zeros((len(open_), k)), order[open_, :size]
        np.put_along_axis(start, top, np.take_along_axis(full[open_], top, axis=1), axis=1)
        start /= start.sum(axis=1, keepdims=True)
        # one language has all; of all languages, these are the proportions
        own = _proportions(like[mine], count[open_], start, EM_ROUNDS if 1 < size < k else 0)
        value = _likelihood(like[mine], count[open_], own) - (size - 1) * penalty[open_]
        better = value > best[open_]
        won = open_[better]
        best[won], own_share[won], size_of[won] = value[better], own[better], size
    share[have], chosen[have] = own_share, size_of
    return share, chosen, words


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text, modulo 4, is 2. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


def sample(docs: DataFrame, bound: int = SAMPLE_TEXTS) -> tuple[list[str], list[str]]:
    """At most about ``bound`` texts a language, chosen by a hash of the id, among rows with a language that may be learned from; of longer texts a window of SAMPLE_CHARS."""
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).withColumn("text", window(F.col("text"), F.col("doc_id"), SAMPLE_CHARS))
    counts = {r["lang"]: r["count"] for r in usable.groupBy("lang").count().collect()}  # one number a language
    part = F.lit(0.0)
    for lang, n in counts.items():
        part = F.when(F.col("lang") == lang, F.lit(min(1.0, bound / n))).otherwise(part)
    chosen = usable.where(F.pmod(F.xxhash64(F.lit(13), "doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    got = sorted((r["lang"], r["text"]) for r in chosen.select("lang", "text").toLocalIterator())
    return [t for _, t in got], [x for x, _ in got]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_set and lang_shares (of the set) from the whole text.

    A text that is null or has no letter is ``und`` with score 0 and an empty
    set; so is every text if there was nothing to learn from. Ties go to the
    first language by name. Repeated rows are predicted alike; an empty table
    gives an empty one. A very long text takes some numbers for each of its words
    and languages while it is fitted. Columns of these names are replaced.
    """
    added = [T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType()), T.StructField("lang_set", T.ArrayType(T.StringType())), T.StructField("lang_shares", T.ArrayType(T.DoubleType()))]
    small_batches(docs.sparkSession)
    rest = docs.drop(*(f.name for f in added))
    names = rest.columns
    schema = T.StructType([*rest.schema.fields, *added])

    def run(batches_):
        for batch in batches_:
            pred, score, sets, shares = [], [], [], []
            for _, part in batches(batch.column(names.index("text")).to_pylist()):
                if not model.languages:
                    pred, score, sets, shares = ([*x, *[y] * len(part)] for x, y in ((pred, UNKNOWN), (score, 0.0), (sets, []), (shares, [])))
                    continue
                share, size, words = mixture(part, model)
                order = np.argsort(-share, axis=1, kind="stable")
                for row, ranks, k, n in zip(share, order, size, words, strict=True):
                    top = ranks[: k if n else 0]
                    mine = row[top] / row[top].sum() if n else row[top]
                    pred.append(model.languages[top[0]] if n else UNKNOWN)
                    score.append(min(1.0, float(mine[0])) if n else 0.0)
                    sets.append([model.languages[i] for i in top])
                    shares.append(mine.tolist())
            columns = [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.list_(pa.string())), pa.array(shares, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*names, *(f.name for f in added)])

    return rest.mapInArrow(run, schema)


def op8_language_mixture(spark, sf_dir: str) -> DataFrame:
    """Every document's language, from its proportions of languages."""
    docs = table(spark, sf_dir, "documents")
    model = fit(*sample(docs.select("doc_id", "text", "lang")))
    out = identified(docs.select("doc_id", "text"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.array_join("lang_set", ",").alias("lang_set"))
