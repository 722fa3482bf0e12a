"""Toxicity and language ID: held-out accuracy on the supplied tables, and edge cases."""

import os
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from colloquy.llm import langid, toxicity

SF = "/root/testdata/sf0.01"
need_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
WORDS = "the of and a in is on erthing stone river walks onble tion hand".split()


def corpus(n=240):
    rng = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(n):
        words = list(rng.choice(WORDS, 40))
        if i % 4 == 0:
            words[int(rng.integers(40))] = ["idiot", "moron", "stupid"][i % 3]
            words[int(rng.integers(40))] = ["idiot", "moron", "stupid"][i // 4 % 3]
        texts.append(" ".join(words) + ".")
        labels.append(int(i % 4 == 0))
    return texts, np.array(labels)


@pytest.fixture(scope="module")
def machine():
    return toxicity.fit(*corpus())


def test_insults_with_gaps_and_inserted_letters_are_on_the_toxic_side(machine):
    texts = ["the river of stone walks", "the idxiot of stone", "the mor-on of stone", "the i d i o t of stone"]
    clean, *odd = toxicity.summary(texts, machine.weights, machine.edge)[:, 0]
    assert clean < machine.edge < min(odd)
    clean, *odd = toxicity.score_texts(texts, machine)
    assert all(x > 5 * clean for x in odd)


def test_training_texts_are_told_apart(machine):
    texts, labels = corpus()
    assert ((toxicity.score_texts(texts, machine) >= 0.5) == labels).mean() > 0.97


def test_scores_of_nothing(machine):
    got = toxicity.score_texts([None, "", " ", "x" * 100_000], machine)
    assert got.shape == (4,) and ((got >= 0) & (got <= 1)).all() and (got[:2] < 0.5).all()
    assert toxicity.score_texts(["a"], toxicity.fit([], np.array([], int)))[0] < 0.01
    assert toxicity.score_texts(["a"], toxicity.fit(["b"], np.array([1])))[0] > 0.99


def test_kernel_counts_gapped_subsequences():
    rows = np.array([[0] * 7 + [1, 2, 3, 4, 0], [0] * 6 + [1, 2, 9, 3, 4, 0]], np.uint8)
    column = np.full(toxicity.GRAMS, -1, np.int32)
    column[(1 << 15) + (2 << 10) + (3 << 5) + 4] = 0
    got = toxicity.features(rows, column)[:, 0]
    assert np.allclose(got, [toxicity.DECAY**4, toxicity.DECAY**5])


def test_toxicity_query(spark):
    docs = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(corpus()[0])] + [(1000, None, "x"), (None, "the idiot", "x"), (5, "twice", "x")], "doc_id long, text string, toxicity string")
    labels = spark.createDataFrame([(i, int(y)) for i, y in enumerate(corpus()[1])] + [(3000, 1), (7, None)], "doc_id long, toxic int")
    kept = toxicity.without_toxic(docs, labels)
    assert kept.columns == docs.columns and 160 < kept.count() < 200
    empty = docs.limit(0)
    assert toxicity.without_toxic(empty, labels).count() == 0
    assert toxicity.without_toxic(docs, labels.limit(0)).count() == docs.count()


@need_tables
def test_toxicity_of_documents(spark):
    out = toxicity.op3_toxicity(spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert len(out) == docs and out["score"].between(0, 1).all() and (out["predicted"] == (out["score"] >= 0.5)).all()
    assert all(out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]])


TEXTS = {"en": "the of and thing with over under", "de": "der die und nicht schön über straße", "ja": "これ は とても よい です ね"}


def test_mixture_finds_both_languages():
    rng = np.random.default_rng(1)
    make = lambda lang, n: " ".join(rng.choice(TEXTS[lang].split(), n))
    model = langid.fit([make(k, 50) for k in TEXTS for _ in range(5)], [k for k in TEXTS for _ in range(5)])
    share, size, _ = langid.mixture([make("en", 40) + " " + make("de", 20), make("ja", 30), "12 !!"], model)
    assert size[0] == 2 and abs(share[0][model.languages.index("en")] - 2 / 3) < 0.05 and size[1] == 1 and share[1].argmax() == model.languages.index("ja")


def test_language_edge_cases(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "42 !"), (4, "the of and"), (5, "𠀀"), (4, "the of and")], "doc_id long, text string").withColumn("lang_pred", F.lit("old"))
    got = langid.identified(docs, langid.fit(["the of and " * 9, "der die und " * 9], ["en", "de"])).orderBy("doc_id").collect()
    assert [r["lang_pred"] for r in got][:3] == ["und"] * 3 and got[3]["lang_pred"] == "en" and got[5]["lang_pred"] in ("en", "de")
    assert langid.identified(docs, langid.fit([], [])).where("lang_pred = 'und'").count() == 6
    assert langid.identified(docs.limit(0), langid.fit([], [])).count() == 0


@need_tables
def test_held_out_languages(spark):
    out = langid.op8_language_mixture(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert out.where("held_out and lang_pred = lang").count() / out.where("held_out").count() > 0.97


def squeezed_plain(text):
    """Codes as the machine reads a text, letter by letter."""
    from colloquy.llm.chars import letter_code

    codes = [letter_code(c, True, toxicity.CODES - 1) for c in text]
    codes = [0] * toxicity.WINDOW + codes + [0] * toxicity.WINDOW
    single = [codes[i] > 0 and not codes[i - 1] and not codes[i + 1] if 0 < i < len(codes) - 1 else codes[i] > 0 for i in range(len(codes))]
    drop = [0 < i < len(codes) - 1 and not codes[i] and single[i - 1] and single[i + 1] for i in range(len(codes))]
    start, end = toxicity.WINDOW - sum(drop[: toxicity.WINDOW]), len(codes) - toxicity.WINDOW - sum(drop[: len(codes) - toxicity.WINDOW])
    return [c if c else toxicity.EDGE for c, d in zip(codes, drop, strict=True) if not d], start, end


def plain_score(text, model):
    """A text's score by listing every subsequence of four characters of every window."""
    codes, start, end = squeezed_plain(text or "")
    ending = []
    for d in range(len(codes)):
        total = 0.0
        for a in range(max(0, d - toxicity.SPAN + 1), d - 2):
            for b in range(a + 1, d - 1):
                for c in range(b + 1, d):
                    total += toxicity.DECAY ** (d - a + 1) * float(model.weights[(codes[a] << 15) + (codes[b] << 10) + (codes[c] << 5) + codes[d]])
        ending.append(total)
    f = [sum(ending[max(0, i - toxicity.WINDOW + 1) : i + 1]) for i in range(len(codes))]
    cuts = list(range(start, end, toxicity.BLOCK))
    worst = sorted((max(f[a:b]) for a, b in zip(cuts, [*cuts[1:], len(codes)], strict=True)), reverse=True) if cuts else []
    values = (worst + [0.0] * 3)[:3] + [np.log1p(sum(x > model.edge + s for x in worst)) for s in toxicity.STEPS] + [np.log1p(len(cuts))]
    return 1 / (1 + np.exp(-np.clip(np.dot(values, model.curve) + model.offset, -30, 30)))


def test_scores_equal_a_count_of_all_subsequences(spark, machine):
    texts = [None, "", "a", "the idxiot of the river", "s t u p i d stone", "é Idiot! " * 4, *corpus(24)[0]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string").repartition(3)
    got = {r.doc_id: r.toxicity for r in toxicity.scored(docs, machine).collect()}
    for i, text in enumerate(texts):
        assert abs(got[i] - plain_score(text, machine)) < 1e-3, text


def plain_sets(text, model):
    """{set of languages: (penalised likelihood, proportions)} of all sets, by expectation-maximisation over words one at a time."""
    import itertools
    import math
    import re

    words = re.findall(r"[^\W\d_]+", text)
    logs = []
    for word in words:
        codes = [int(x) for x in langid.coded([word], 2, False, langid.CODES)[0]][2 : 2 + len(word)]
        before = [0, 0, *codes]
        logs.append([sum(float(model.logs[(before[i] * langid.CODES + before[i + 1]) * langid.CODES + before[i + 2], j]) for i in range(len(codes))) for j in range(len(model.languages))])
    like = [[math.exp(x - max(row)) for x in row] for row in logs]
    out = {}
    for size in range(1, len(model.languages) + 1):
        for chosen in itertools.combinations(range(len(model.languages)), size):
            share = dict.fromkeys(chosen, 1 / size)
            for _ in range(200 if size > 1 else 0):
                part = [{j: row[j] * share[j] for j in chosen} for row in like]
                share = {j: sum(p[j] / sum(p.values()) for p in part) / len(like) for j in chosen}
            value = sum(math.log(max(1e-300, sum(row[j] * share[j] for j in chosen))) for row in like) - (size - 1) * langid.PENALTY * math.log(len(like) + 1)
            out[frozenset(model.languages[j] for j in chosen)] = (value, {model.languages[j]: x for j, x in share.items()})
    return out


def test_sets_equal_the_best_of_all_sets():
    rng = np.random.default_rng(3)
    words = {"en": "the of and thing with over under house river", "de": "der die und nicht schön über straße haus fluß", "fr": "le la et pas très sur rue maison fleuve", "es": "el los y no muy sobre calle casa río"}
    make = lambda lang, n: " ".join(rng.choice(words[lang].split(), n))
    model = langid.fit([make(k, 60) for k in words for _ in range(4)], [k for k in words for _ in range(4)])
    texts = []
    for i in range(40):
        langs = rng.choice(list(words), 1 + i % 3, replace=False)
        texts.append(" ".join(make(x, int(rng.integers(4, 25))) for x in langs))
    share, size, _ = langid.mixture(texts, model)
    for text, row, k in zip(texts, share, size, strict=True):
        sets = plain_sets(text, model)
        best = max(sets, key=lambda x: sets[x][0])
        mine = frozenset(model.languages[j] for j in np.argsort(-row, kind="stable")[:k])
        # twelve rounds may leave a set a trifle below what two hundred reach
        assert mine == best or sets[best][0] - sets[mine][0] < 0.05
        assert all(abs(row[model.languages.index(x)] - p) < 0.05 for x, p in sets[mine][1].items())
