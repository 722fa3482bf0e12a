"""Every stage of the corpus pipeline on what the stage before kept, against brute force; and on odd tables."""

import hashlib
import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from colloquy.llm import bpe, secrets, toxicity
from colloquy.llm.common import kept, table
from tests.llm.test_battery import battery
from tests.llm.test_rows import levels
from tests.llm.test_texts import components, spans_of

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) rows of each stage."""
    docs, out = table(spark, SF, "documents"), {}
    for name, stage in corpus_pipeline.STAGES:
        made = kept(stage(spark, docs, SF), f"test-{name}")
        out[name] = (docs.collect(), made.collect(), docs.columns, made.columns)
        docs = made
    return out


def test_toxicity_keeps_what_scores_low(spark, stages):
    before, after, cols, same = stages["toxicity"]
    model = toxicity.fit(*toxicity.labelled_sample(table(spark, SF, "documents"), table(spark, SF, "labels")))
    want = [r for r, s in zip(before, toxicity.score_texts([r["text"] for r in before], model), strict=True) if s < 0.5]
    assert sorted(want, key=str) == sorted(after, key=str) and cols == same and 0 < len(after) < len(before)


def test_one_document_of_each_group_stays(stages):
    before, after, cols, same = stages["near_duplicates"]
    before = sorted(before, key=lambda r: r["doc_id"])
    groups, _ = components([r["text"] for r in before])
    want = [r for i, r in enumerate(before) if groups[i] == i]
    assert want == sorted(after, key=lambda r: r["doc_id"]) and cols == same and len(after) < len(before)


def runs(text):
    """Candidate tokens outside base spans, as the battery gets them, for texts whose runs have one alphabet."""
    base, out = spans_of(text), []
    for m in re.finditer(secrets.CANDIDATE, text):
        at = m.start()
        for s, _, e in [b for b in base if b[0] < m.end() and m.start() < b[2]]:
            out.append((at, s))
            at = max(at, e)
        out.append((at, m.end()))
    return [(a, b) for a, b in out if b - a >= secrets.LEAST_RUN]


def test_secrets_are_marked(stages):
    before, after, cols, same = stages["secrets"]
    tokens = {r["doc_id"]: [(a, b, p) for a, b in runs(r["text"]) if (p := battery(r["text"][a:b]))] for r in before}
    cell = lambda p: min(int(-np.log10(max(p, 1e-99)) * secrets.STEPS), secrets.MOST_STEPS)
    cells = sorted((cell(p[1]) for ts in tokens.values() for *_, p in ts), reverse=True)
    cut = min([c for i, c in enumerate(cells) if 10 ** (-c / secrets.STEPS) <= secrets.FALSE_DISCOVERY * sum(x >= c for x in cells) / len(cells)], default=secrets.MOST_STEPS + 1)
    out = {r["doc_id"]: r for r in after}
    for r in before:
        spans = sorted([(s, e) for s, _, e in spans_of(r["text"])] + [(a, b) for a, b, p in tokens[r["doc_id"]] if p[0] >= secrets.RANDOM_LEVEL and cell(p[1]) >= cut])
        text, at = "", 0
        for s, e in spans:
            if s >= at:
                text += r["text"][at:s] + "[secret]"
            at = max(at, e)
        assert out[r["doc_id"]]["text"] == text + r["text"][at:]
        assert out[r["doc_id"]]["n_chars"] == (len(out[r["doc_id"]]["text"]) if spans else r["n_chars"])
    assert len(after) == len(before) and cols == same and any("[secret]" in r["text"] for r in after)


def test_the_mix_comes_near_its_targets(stages):
    before, after, cols, same = stages["mixture"]
    size = lambda r: len(r["text"].encode().split())
    totals, taken = Counter(), Counter()
    for r in before:
        totals[r["source"]] += size(r)
    for r in after:
        taken[r["source"]] += size(r)
    want = levels(dict(totals), (5, 2, 1), 3)
    largest = {s: max(size(r) for r in before if r["source"] == s) for s in totals}
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in totals) and cols == same
    assert max(Counter(r["doc_id"] for r in after).values()) <= 3 and {r["doc_id"]: r for r in after}.items() <= {r["doc_id"]: r for r in before}.items()


def test_tokens_equal_the_library(stages):
    tiktoken = pytest.importorskip("tiktoken")
    before, after, _, _ = stages["tokens"]
    path, pattern = bpe.vocabulary()
    theirs = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.codec(path, pattern).ranks, special_tokens={})
    want = sorted((r["doc_id"], theirs.encode_ordinary(r["text"]), r["text"]) for r in before)
    got = sorted((r["doc_id"], r["ids"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after)
    assert len(got) == len(want)
    for (i, ids, text), (j, mine, n, sha, back) in zip(want, got, strict=True):
        assert (i, ids, len(ids)) == (j, mine, n) and sha == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest() and back == hashlib.sha256(text.encode()).hexdigest()


LONG = "so many words that go on " * 4000


@pytest.mark.parametrize("rows", [[], [(None, None, None, None, None)] * 2, [(1, "", "en", "a", 0), (1, "", "en", "a", 0), (2, LONG, None, "a", None), (3, LONG, "en", None, 1), (None, "token = abcdefgh", "en", "b", 16)]])
def test_stages_on_odd_tables(spark, rows):
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("toxicity", F.lit("x")).withColumn("_spans", F.lit(1))
    for name, stage in corpus_pipeline.STAGES:
        made = kept(stage(spark, docs, SF), f"odd-{name}")
        if name != "tokens":
            assert made.columns == docs.columns
        if name in ("toxicity", "secrets"):
            assert made.count() == docs.count()
        docs = made
    got = docs.collect()
    assert all(r["n_tokens"] == len(r["ids"]) for r in got)
    if len(rows) == 5:
        assert {r["doc_id"] for r in got} <= {1, 2, None}  # 3 is a copy of 2
