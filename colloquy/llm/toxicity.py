"""Toxicity by a support vector machine over a gap-weighted subsequence string kernel.

The kernel of two strings sums, over all subsequences of four letters that
span at most SPAN characters, the product of their weights decay^span in each:
an insult with letters inserted or gaps put in still shares most of them. The
machine lives in the Nyström space of a few landmark strings (the words and
beginnings of words whose presence best tells the labels apart): f(s) = sum_l a_l K(s, l). As every
K(s, l) is linear in the weighted subsequence counts of s, f collapses into one
weight for each four letters, and a text is scored by table look-ups.

What is classified is every window of WINDOW characters; the whole text counts.
Labels are known for texts only, so training alternates: take the window of
every toxic text that the present machine finds worst as positive, the worst
and some arbitrary windows of clean texts as negative, fit, repeat. A text then
has its three worst blocks and the numbers of its blocks that have a window
beyond the machine's threshold, clearly beyond it and nearly so; a logistic
curve turns these, with the number of blocks in which they were found, into a
score from 0 to 1. In the curve a class that is k times rarer weighs sqrt(k).

Training uses a bounded sample: SAMPLE_TEXTS a class, of longer texts a window
of SAMPLE_CHARS code points; scoring is a map over all texts. Settings were
chosen on a quarter of the rows that may be learned from, held back for that.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chars import batches, coded
from .common import small_batches, table, window

CODES = 32
SPAN = 6
GRAMS = CODES**4
#: Code of whatever isn't a letter: grams with it tell how words begin and end.
EDGE = CODES - 1
DECAY = 0.7
WINDOW = 12
BLOCK = 24
SAMPLE_TEXTS = 1500
SAMPLE_CHARS = 20_000
LANDMARKS = 128
#: Lengths of beginnings of words that may be landmarks.
PREFIXES = (5, 6, 7)
ROUNDS = 3
COST = 0.1
#: What is added to the threshold in the three counts of blocks.
STEPS = (0.0, 0.5, -0.5)
SUMMARY = 4 + len(STEPS)


@dataclass
class Model:
    """Weight of each four letters, the machine's threshold, and the logistic curve over summary()."""

    weights: np.ndarray
    edge: float
    curve: np.ndarray
    offset: float


def _gaps():
    """Distances of the first three letters from the fourth, and the weight, for every choice of gaps."""
    for far in range(3, SPAN):
        for mid in range(2, far):
            for near in range(1, mid):
                yield far, mid, near, np.float32(DECAY ** (far + 1))


def squeezed(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of texts, with single characters between single letters left out: "a b c" reads as "abc"."""
    codes, starts, ends = coded(texts, WINDOW, True, CODES - 1)
    letter = codes > 0
    single = letter.copy()
    single[1:-1] &= ~letter[:-2] & ~letter[2:]
    drop = np.zeros(len(codes), bool)
    drop[1:-1] = ~letter[1:-1] & single[:-2] & single[2:]
    gone = np.concatenate([[0], np.cumsum(drop)])
    codes = np.where(letter, codes, np.uint8(EDGE))
    return codes[~drop], starts - gone[starts], ends - gone[ends]


def window_scores(codes: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """f of the window that ends at each position."""
    c = codes.astype(np.int32)
    c1, c2, c3, n = c << 15, c << 10, c << 5, len(c)
    total = np.zeros(n, np.float32)
    for far, mid, near, weight in _gaps():
        index = c1[: n - far] + c2[far - mid : n - mid]
        index += c3[far - near : n - near]
        index += c[far:]
        part = weights[index]
        part *= weight
        total[far:] += part
    run = np.cumsum(total, dtype=np.float64)
    out = run.copy()
    out[WINDOW:] -= run[:-WINDOW]
    return out


def grams(rows: np.ndarray) -> list[tuple[np.ndarray, np.float32]]:
    """Of windows (rows of codes): the four characters that end at each place, 0 where there are none, and their weight."""
    c, out = rows.astype(np.int32), []
    n = rows.shape[1]
    for far, mid, near, weight in _gaps():
        a, b, d, e = c[:, : n - far], c[:, far - mid : n - mid], c[:, far - near : n - near], c[:, far:]
        index = (a << 15) + (b << 10) + (d << 5) + e
        out.append((np.where((a > 0) & (b > 0) & (d > 0) & (e > 0), index, 0), weight))
    return out


def worst_windows(texts: list[str], weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Largest window score of each text, and the codes of that window; an empty text has 0 and no letters."""
    best, rows = np.zeros(len(texts)), np.zeros((len(texts), WINDOW), np.uint8)
    for lo, part in batches(texts):
        codes, starts, ends = squeezed(part)
        scores = window_scores(codes, weights)
        for i, (a, b) in enumerate(zip(starts, ends, strict=True)):
            if b > a:
                at = a + int(np.argmax(scores[a:b]))
                best[lo + i] = scores[at]
                rows[lo + i] = codes[at - WINDOW + 1 : at + 1]
    return best, rows


def features(rows: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Weighted counts of the four-letter subsequences of windows; ``column`` maps each to its place, -1 for none."""
    width = int(column.max()) + 1
    out = np.zeros(len(rows) * width, np.float64)
    at = np.arange(len(rows))[:, None] * width
    for index, weight in grams(rows):
        place = column[index]
        hit = place >= 0
        out += np.bincount((at + place)[hit], minlength=len(out)) * float(weight)
    return out.reshape(len(rows), width)


def landmarks(texts: list[str], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words, or beginnings of words, whose presence best tells toxic texts and of the commonest clean ones, and how well each tells."""
    seen = {0: Counter(), 1: Counter()}
    for text, label in zip(texts, labels, strict=True):
        words = set(re.findall(r"[^\W\d_]{3,}", text.lower()))
        seen[int(label)].update(words | {w[:k] for w in words for k in PREFIXES if len(w) > k})
    n1, n0 = max(1, int(labels.sum())), max(1, int((1 - labels).sum()))

    def gain(word: str) -> float:
        p, q = seen[1][word] / n1, seen[0][word] / n0
        return (p - q) / (p + q + 2 / (n0 + n1)) ** 0.5

    words = sorted(seen[1].keys() | seen[0].keys(), key=lambda w: (-gain(w), w))
    chosen = words[: LANDMARKS * 3 // 4] + [w for w, _ in sorted(seen[0].items(), key=lambda x: (-x[1], x[0]))][: LANDMARKS // 4]
    chosen = list(dict.fromkeys(chosen))
    rows = np.zeros((len(chosen), WINDOW), np.uint8)
    for i, word in enumerate(chosen):
        codes, a, b = squeezed([word])
        row = codes[a[0] - 1 : b[0] + 1][:WINDOW]
        rows[i, WINDOW - len(row) :] = row
    return rows, np.array([max(0.0, gain(w)) ** 2 for w in chosen])


def svm(x: np.ndarray, y: np.ndarray, cost: float = COST, passes: int = 40) -> tuple[np.ndarray, float]:
    """Linear support vector machine by dual coordinate descent; classes weigh alike. y is +1 or -1."""
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    upper = np.where(y > 0, cost * len(y) / max(1, 2 * (y > 0).sum()), cost * len(y) / max(1, 2 * (y < 0).sum()))
    norms, alpha, w = (x * x).sum(axis=1), np.zeros(len(y)), np.zeros(x.shape[1])
    rng = np.random.default_rng(5)
    for _ in range(passes):
        for i in rng.permutation(len(y)):
            step = min(max(alpha[i] - (y[i] * (x[i] @ w) - 1) / norms[i], 0.0), upper[i])
            if step != alpha[i]:
                w += (step - alpha[i]) * y[i] * x[i]
                alpha[i] = step
    return w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of P(y = 1 | x), by Newton steps with a little shrinkage on standardised columns; the rarer class weighs more."""
    n1, n0 = max(1.0, y.sum()), max(1.0, (1 - y).sum())
    each = np.where(y > 0, max(1.0, n0 / n1) ** 0.5, max(1.0, n1 / n0) ** 0.5)
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd = np.maximum(sd, 0.25)  # what is nearly the same in all texts tells next to nothing
    z = np.concatenate([(x - mean) / sd, np.ones((len(x), 1))], axis=1)
    w, shrink = np.zeros(z.shape[1]), np.diag([0.5] * x.shape[1] + [1e-3])
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (each * p * (1 - p))[:, None]).T @ z + shrink, z.T @ (each * (p - y)) + shrink @ w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w[:-1] / sd, float(w[-1] - (w[:-1] * mean / sd).sum())


def summary(texts: list[str | None], weights: np.ndarray, edge: float) -> np.ndarray:
    """Of each text: its three worst blocks, the logs of how many are beyond the threshold by each of STEPS, and the log of their number."""
    out = np.zeros((len(texts), SUMMARY))
    for lo, part in batches(texts):
        codes, starts, ends = squeezed(part)
        scores = window_scores(codes, weights)
        blocks = -(-(ends - starts) // BLOCK)
        if not blocks.sum():
            continue
        owner = np.repeat(np.arange(len(part)), blocks)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        at = starts[owner] + place * BLOCK
        worst = np.maximum.reduceat(scores, at)
        order = np.lexsort((-worst, owner))
        rank = place  # place within the text is also the rank after sorting by owner
        for r in range(3):
            hit = rank == r
            out[lo + owner[order][hit], r] = worst[order][hit]
        for j, step in enumerate(STEPS):
            out[lo : lo + len(part), 3 + j] = np.log1p(np.bincount(owner, worst > edge + step, len(part)))
        out[lo : lo + len(part), -1] = np.log1p(blocks)
    return out


def fit(texts: list[str], labels: np.ndarray) -> Model:
    """The machine from labelled texts; with one class only, a constant score (that class; 0 if there are no texts)."""
    if not 0 < labels.sum() < len(labels):
        return Model(np.zeros(GRAMS, np.float32), 0.0, np.zeros(SUMMARY), 30.0 if labels.sum() else -30.0)
    marks, first = landmarks(texts, labels)
    used = np.unique(np.concatenate([index.ravel() for index, _ in grams(marks)]))
    used = used[used > 0]
    column = np.full(GRAMS, -1, np.int32)
    column[used] = np.arange(len(used))

    def table_of(compact: np.ndarray) -> np.ndarray:
        out = np.zeros(GRAMS, np.float32)
        out[used] = compact
        return out

    base = features(marks, column) if len(used) else np.zeros((len(marks), 1))
    base /= np.maximum(np.linalg.norm(base, axis=1, keepdims=True), 1e-9)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-4 * values.max()
    whiten = vectors[:, keep] / np.sqrt(values[keep])  # K_mm^(-1/2)
    weights = table_of(first @ base)
    toxic = [t for t, y in zip(texts, labels, strict=True) if y]
    clean = [t for t, y in zip(texts, labels, strict=True) if not y]
    rng = np.random.default_rng(7)
    negatives = []
    for text in clean:
        codes, a, b = squeezed([text])
        if b[0] > a[0]:
            at = int(rng.integers(a[0], b[0]))
            negatives.append(codes[at - WINDOW + 1 : at + 1])
    negatives = np.array(negatives, np.uint8).reshape(-1, WINDOW)
    for _ in range(ROUNDS):
        positives = worst_windows(toxic, weights)[1]
        negatives = np.unique(np.concatenate([negatives, worst_windows(clean, weights)[1]]), axis=0)
        rows = np.concatenate([positives, negatives])
        kernel = np.concatenate([features(rows[i : i + 256], column) @ base.T for i in range(0, len(rows), 256)])  # K_nm
        y = np.where(np.arange(len(rows)) < len(positives), 1.0, -1.0)
        w, offset = svm(kernel @ whiten, y)
        edge = -offset
        weights = table_of((whiten @ w) @ base)
    curve, offset = logistic(summary(texts, weights, edge), labels.astype(float))
    return Model(weights, edge, curve, offset)


def score_texts(texts: list[str | None], model: Model) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(summary(texts, model.weights, model.edge) @ model.curve + model.offset, -30, 30)))


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are never learned from: crc32 of the id as text, modulo 5, is 0. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE_TEXTS) -> tuple[list[str], np.ndarray]:
    """At most about ``bound`` texts a class, chosen by a hash of the id among those that may be learned from; of longer texts a window of SAMPLE_CHARS."""
    labels = labels.where(F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    counts = dict(labels.groupBy("toxic").count().collect())
    part = F.lit(0.0)
    for label in (0, 1):
        part = F.when(F.col("toxic") == label, F.lit(min(1.0, bound / max(1, counts.get(label, 0))))).otherwise(part)
    chosen = labels.where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000)) < part * 1_000_000)
    rows = docs.where(F.col("text").isNotNull()).select("doc_id", window(F.col("text"), F.col("doc_id"), SAMPLE_CHARS).alias("text")).join(F.broadcast(chosen), "doc_id")
    got = sorted((r["doc_id"], r["text"], r["toxic"]) for r in rows.select("doc_id", "text", "toxic").toLocalIterator())
    return [t for _, t, _ in got], np.array([int(y) for *_, y in got], np.int64)


def scored(docs: DataFrame, model: Model, name: str = "toxicity") -> DataFrame:
    """``docs`` with a score from 0 to 1, from the whole text; a null text scores as an empty one.

    Repeated rows score alike; an empty table gives an empty one; a very long text
    takes some twenty bytes a character while it is scored. A column named as
    ``name`` is replaced.
    """
    small_batches(docs.sparkSession)
    rest = docs.drop(name)
    names = rest.columns
    schema = rest.withColumn(name, F.lit(0.0)).schema

    def run(batches_):
        for batch in batches_:
            score = score_texts(batch.column(names.index("text")).to_pylist(), model)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], names=[*names, name])

    return rest.mapInArrow(run, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents that score below ``threshold``, in the columns of ``docs``."""
    model = fit(*labelled_sample(docs, labels))
    return scored(docs, model, "_toxicity").where(F.col("_toxicity") < threshold).select(*docs.columns)


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's score, learned from the labels that may be learned from."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(*labelled_sample(docs, table(spark, sf_dir, "labels")))
    out = scored(docs, model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"))
