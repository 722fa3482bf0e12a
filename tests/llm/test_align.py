"""Cross-tokenizer alignment against encoding whole texts and counting decoded bytes."""

import hashlib
import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from colloquy.llm import align

tokenizers, sentencepiece = pytest.importorskip("tokenizers"), pytest.importorskip("sentencepiece")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   ", "\n", "\n\n  x", "x \n", "é😀ß" * 5, "😀", "a😀\n😀 b", "a" * 5000, "1234567890" * 30, "don't we'll I'M", "　wide  gap　x", "<|endoftext|> <s> </s> <unk>", "tab\tand\r\nline\x0b\x0c\x1c x",
       "a▁b", "zero​ width﻿ \n mark᠎ y", "\x00 \x01", "naïve café — “quoted” … ", "क्षि த 漢字かな", "end with space ", " lead", "x\xa0 y", "<0x0A> ▁"]


def ends(tokens):
    out, at = [], 0
    for t in tokens:
        at += len(t)
        out.append(at)
    return out


class Plain:
    """Whole texts, one by one."""

    def __init__(self):
        a_path, b_path = align.vocabularies()
        self.a, self.b = tokenizers.Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.a.encode_special_tokens = True
        self.letters = align.byte_letters()

    def groups(self, text):
        if not text:
            return None
        a, b = self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)
        a_bytes = [bytes(self.letters[c] for c in self.a.id_to_token(i)) for i in a]
        b_bytes = [bytes([int(self.b.id_to_piece(i)[3:5], 16)]) if self.b.is_byte(i) else self.b.id_to_piece(i).replace("▁", " ").encode() for i in b]
        if not b"".join(a_bytes) == b"".join(b_bytes) == (" " + text).encode():
            return None
        ea, eb = ends(a_bytes), ends(b_bytes)
        out, i, j = [], 0, 0
        for cut in sorted(set(ea) & set(eb)):
            k, m = ea.index(cut, i) + 1, eb.index(cut, j) + 1
            out.append((a[i:k], b[j:m]))
            i, j = k, m
        return out

    def rows(self, texts):
        """Per text: n_a, n_b, n_groups, sha256, n_links, n_best, count_sum."""
        all_groups = [self.groups(t) for t in texts]
        count = Counter((g[0][-1], g[1][-1]) for groups in all_groups for g in groups or [])
        top = {}
        for (_, b), n in count.items():
            top[b] = max(top.get(b, 0), n)
        for groups in all_groups:
            if groups is None:
                yield 0, 0, 0, "", 0, 0, 0
                continue
            written = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
            links = [(a[-1], b[-1]) for a, b in groups]
            yield (sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), hashlib.sha256(written.encode()).hexdigest(), len(links),
                   sum(count[x] == top[x[1]] for x in links), sum(count[x] for x in links))


@pytest.fixture(scope="module")
def plain():
    return Plain()


def made():
    rng = random.Random(3)
    letters = "aabcde \n  é😀!'▁漢​\t"
    return ["".join(rng.choice(letters[:-3] if k % 4 else letters) for _ in range(rng.randint(1, 80))) for k in range(300)]


def written(groups):
    return ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups).encode()


def test_units_in_a_row_equal_whole_texts(plain):
    one = align.Aligner(*align.vocabularies())
    texts = [*ODD, *made()]
    assert one.cuts
    for part in (texts, texts[::-1]):  # known units the second time
        for text, got in zip(part, one.aligned(part), strict=True):
            want = plain.groups(text)
            assert (got is None) == (want is None), text
            if want is not None:
                assert got[3] == written(want), text
                assert dict(zip(got[4].tolist(), got[5].tolist(), strict=True)) == Counter((a[-1] << 32) + b[-1] for a, b in want)


def test_without_cuts_and_with_little_memory(plain, monkeypatch):
    one = align.Aligner(*align.vocabularies())
    one.cuts = False
    texts = [*ODD, *made()[:60]]
    assert [x and x[3] for x in one.aligned(texts)] == [None if plain.groups(t) is None else written(plain.groups(t)) for t in texts]
    monkeypatch.setattr(align, "CACHE_BYTES", 1000)
    small = align.Aligner(*align.vocabularies())
    for at in range(0, len(texts), 5):
        assert [x and x[3] for x in small.aligned(texts[at : at + 5])] == [None if plain.groups(t) is None else written(plain.groups(t)) for t in texts[at : at + 5]]
        assert len(small.known) < 200


def test_split_characters_are_refined_by_bytes(plain):
    """Some cuts lie inside a character, where no reported span has an end."""
    one = align.Aligner(*align.vocabularies())
    inside = 0
    for code in range(0x1F300, 0x1F6FF):
        text = chr(code) + chr(code + 1)
        a, a_end, b, b_end, _ = one._tokens([" " + text])
        assert one.A.bytes(a) == one.B.bytes(b) == (" " + text).encode()
        assert a_end.tolist() == ends([one.A.bytes(a[i : i + 1]) for i in range(len(a))])
        inside += any(x in set(b_end.tolist()) for x in a_end.tolist() if x not in (1, 5, 9))
    assert inside


@pytest.mark.parametrize("hot", [0, 3, 100_000])
def test_rows_and_counts_equal_brute_force(spark, plain, hot):
    texts = [*ODD, None, *made()[:100], *["the same text again and again."] * 40, "a long one é " * 9000]
    docs = spark.createDataFrame([(i if i % 9 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3).withColumn("n_a", F.lit("x")).withColumn("pair", F.lit(1)).withColumn("n", F.lit(2)).withColumn("count", F.lit(3))
    got = align.linked(docs, hot_pairs=hot)
    assert {"doc_id", "pair", "n", "count"} <= set(got.columns)
    rows = Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in got.collect())
    assert rows == Counter((i if i % 9 else None, *w) for i, w in enumerate(plain.rows(texts)))


def test_groups_of_a_user_and_empty_tables(spark, plain):
    docs = spark.createDataFrame([(1, "naïve 😀 text")], "k int, body string")
    assert align.aligned(docs, "body", groups=True).first().groups.encode() == written(plain.groups("naïve 😀 text"))
    assert align.linked(docs.limit(0), "body").collect() == []


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
def test_query_equals_brute_force(spark, plain):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: (r.n_a, r.n_b, r.n_groups, r.groups_sha256, r.n_links, r.n_best, r.count_sum) for r in align.op13_tokenizer_alignment(spark, SF).collect()}
    assert got == dict(zip((d.doc_id for d in docs), plain.rows([d.text for d in docs]), strict=True))
