"""Alignment of two tokenizers' tokens on the same text, and which tokens go together over a corpus.

Tokenizer A (byte-level BPE) reports where each token starts and ends in
characters; tokenizer B (pieces with byte fallback) where its pieces start and
end in the spans of its proto. Ends that both report, at tokens that end with a
whole character, are coarse cuts. Between two cuts, a character of several bytes
may be split over tokens of A, which then report the same character, and over
byte tokens of B, which report no span but the last: the ends of these are
refined with the tokens' decoded bytes, counted from the cut before. Byte offsets
where tokens of both end cut the tokens into groups.

Texts are cut before line breaks and spaces that follow something else, where
neither tokenizer can join tokens (which is checked in B's vocabulary when it is
loaded), and each distinct unit is aligned once a task, up to a bound of memory.
A text's groups are those of its units in a row. What either tokenizer decodes to
is compared with the units' bytes.

How often each pair of tokens is linked in the corpus is counted by a shuffle of
each text's distinct pairs, summed up first. The pairs that are linked most, of a
bounded number, reach the texts by broadcast, all others by a join on the pair:
so a pair that every text holds isn't a hot key.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import kept, small_batches, table

#: Bytes of known units (about) beyond which a task forgets them before it goes on.
CACHE_BYTES = 240_000_000
ENTRY_BYTES = 250
#: Code points of the texts that are looked at together, of the units that are encoded in a row.
BATCH_CHARS, ROW_CHARS = 1_000_000, 2_000
#: Pairs that are broadcast.
HOT_PAIRS = 100_000
#: Before a unit of which it is known that no token reaches across its beginning.
SENTINEL = " x"
#: What some tables take for white space; a line break or space after anything but that and white space.
BLANK = "\u180e\u200b\u200c\u200d\u2060\ufeff"
CUT = re.compile(rf"(?<=[^\s{BLANK}])(?=[ \n])")
#: The mark that B's pieces have for a space.
MARK = "▁"

ADDED = T.StructType([
    T.StructField("n_a", T.LongType()), T.StructField("n_b", T.LongType()), T.StructField("n_groups", T.LongType()), T.StructField("groups_sha256", T.StringType()),
    T.StructField("pairs", T.ArrayType(T.StructType([T.StructField("pair", T.LongType()), T.StructField("n", T.IntegerType())])))])
PAIRS = pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int32())]))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others in order from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Side:
    """Decoded bytes of each id of a tokenizer, and its digits before each separator."""

    def __init__(self, tokens: list[bytes], inner: str, last: str):
        self.lengths = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)
        self.written = np.array([[f"{i}{inner}", f"{i}{last}"] for i in range(len(tokens))], object)

    def bytes(self, ids: np.ndarray) -> bytes:
        n = self.lengths[ids]
        return self.pool[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))].tobytes()


def refined(ends: np.ndarray, whole: np.ndarray, coarse: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Ends of tokens: as reported where ``whole``, else by the decoded ``lengths`` since the last coarse cut."""
    cut = whole.copy()
    cut[whole] = np.isin(ends[whole], coarse, assume_unique=True)
    block = np.cumsum(cut) - cut
    counted = np.cumsum(lengths)
    at, before = np.concatenate([[0], ends[cut]]), np.concatenate([[0], counted[cut]])
    return np.where(whole, ends, at[block] + counted - before[block])


class Aligner:
    """Both tokenizers, and the units that are known."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        letters, entries = byte_letters(), self.a.get_vocab(with_added_tokens=True)
        added = {x["content"] for x in json.load(open(a_path, encoding="utf-8"))["added_tokens"]}
        tokens = [b""] * (max(entries.values()) + 1)
        for entry, i in entries.items():
            tokens[i] = entry.encode() if entry in added else bytes(letters[c] for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.is_byte = np.fromiter((self.b.is_byte(i) for i in range(len(pieces))), bool, len(pieces))
        self.A = Side(tokens, ",", "|")
        self.B = Side([bytes([int(p[3:5], 16)]) if byte else p.replace(MARK, " ").encode() for p, byte in zip(pieces, self.is_byte, strict=True)], ",", ";")
        # no piece goes from something else to a space, or has a line break beside anything else
        self.cuts = not any(re.search(f"[^{MARK}]{MARK}", p) or ("\n" in p and p != "\n") for p in pieces)
        # some versions of the library give spans in bytes, some in characters
        self.spans_in_bytes = self._proto("é")[-1].end == 2
        self.forget()

    def forget(self) -> None:
        """Let go of all units."""
        self.known: dict[str, int] = {}
        self.size = 0
        self.groups: list[bytes | None] = []
        self.counts = np.zeros((0, 3), np.int64)
        self.starts, self.pairs = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def units(self, text: str) -> list[str]:
        text = " " + text
        return CUT.split(text) if self.cuts else [text]

    def _proto(self, text: str):
        return self.b.encode(text, return_type="proto").pieces

    def _tokens(self, rows: list[str]):
        """(ids of A, their ends, ids of B, their ends, bytes of each row) of texts that start with a space; ends in bytes, rows in a row."""
        points = np.frombuffer("".join(rows).encode("utf-32-le", "replace"), np.uint32)
        to_byte = np.concatenate([[0], np.cumsum(1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF))])
        first = np.concatenate([[0], np.cumsum(np.fromiter(map(len, rows), np.int64, len(rows)))])
        base = to_byte[first]
        encoded = self.a.encode_batch(rows, add_special_tokens=False)
        n = np.fromiter(map(len, encoded), np.int64, len(rows))
        a = np.fromiter((i for e in encoded for i in e.ids), np.int64, int(n.sum()))
        spans = np.array([s for e in encoded for s in e.offsets], np.int64).reshape(-1, 2) + np.repeat(first[:-1], n)[:, None]
        a_end = to_byte[spans[:, 1]]
        a_whole = np.append(spans[1:, 0] >= spans[:-1, 1], [True] * (len(a) > 0))
        protos = [self._proto(r[1:]) for r in rows]
        m = np.fromiter(map(len, protos), np.int64, len(rows))
        flat = np.array([(p.id, p.begin, p.end) for pieces in protos for p in pieces], np.int64).reshape(-1, 3)
        b, start, end = flat.T
        if self.spans_in_bytes:
            b_end = end + 1 + np.repeat(base[:-1], m)
        else:
            b_end = to_byte[end + 1 + np.repeat(first[:-1], m)]
        b_whole = ~(self.is_byte[b] & (start == end))
        coarse = np.intersect1d(a_end[a_whole], b_end[b_whole], assume_unique=True)
        return a, refined(a_end, a_whole, coarse, self.A.lengths[a]), b, refined(b_end, b_whole, coarse, self.B.lengths[b]), base

    def _fits(self, rows: list[str], a: np.ndarray, b: np.ndarray) -> bool:
        data = "".join(rows).encode("utf-8", "replace")
        return int(self.A.lengths[a].sum()) == int(self.B.lengths[b].sum()) == len(data) and self.A.bytes(a) == self.B.bytes(b) == data

    def _keep(self, names: list[str | None], ends: np.ndarray, a, a_end, b, b_end) -> None:
        """Files the units between one of ``ends`` and the next; those without a name are passed over."""
        common = np.intersect1d(a_end, b_end, assume_unique=True)
        if not np.isin(ends, common, assume_unique=True).all():
            raise ValueError("a token reaches across a cut")
        group_a, group_b = np.searchsorted(common, a_end), np.searchsorted(common, b_end)
        last_a, last_b = common[group_a] == a_end, common[group_b] == b_end
        pairs = (a[last_a] << 32) + b[last_b]
        parts = np.concatenate([self.A.written[a, last_a.astype(int)], self.B.written[b, last_b.astype(int)]])
        parts = parts[np.argsort(np.concatenate([2 * group_a, 2 * group_b + 1]), kind="stable")].tolist()
        counts = np.stack([np.diff(np.searchsorted(x, ends, side="right"), prepend=0) for x in (a_end, b_end, common)], 1)
        cuts = np.concatenate([[0], np.cumsum(counts[:, 0] + counts[:, 1])]).tolist()
        for i, name in enumerate(names):
            if name is not None:
                self._file(name, "".join(parts[cuts[i] : cuts[i + 1]]).encode())
        named = np.fromiter((n is not None for n in names), bool, len(names))
        at = np.cumsum(counts[:, 2]) - counts[:, 2] + self.fresh_pairs
        self.fresh.append((counts[named], at[named], pairs))
        self.fresh_pairs += len(pairs)

    def _file(self, name: str, groups: bytes | None) -> None:
        self.known[name] = len(self.groups)
        self.groups.append(groups)
        self.size += ENTRY_BYTES + len(name) + 3 * len(groups or b"")

    def _refuse(self, name: str) -> None:
        """A unit that a tokenizer doesn't give back as it was."""
        self._file(name, None)
        self.fresh.append((np.zeros((1, 3), np.int64), np.array([self.fresh_pairs]), np.zeros(0, np.int64)))

    def learn(self, new: list[str]) -> None:
        """Aligns distinct units: many in a row, those that end in white space (which may be the end of a text) by themselves."""
        self.fresh, self.fresh_pairs = [(self.counts, self.starts, self.pairs)], len(self.pairs)
        alone, rows, chars = [], [[]], 0
        for u in new:
            if MARK in u:
                self._refuse(u)
            elif not self.cuts or u[-1].isspace() or u[-1] in BLANK:
                alone.append([u])
            else:
                if chars >= ROW_CHARS:
                    rows.append([])
                    chars = 0
                rows[-1].append(u)
                chars += len(u)
        rows = [r for r in rows if r] + alone
        for at in range(0, len(rows), 200):
            self._learn(rows[at : at + 200])
        self.counts, self.starts, self.pairs = (np.concatenate(x) for x in zip(*self.fresh, strict=True))

    def _learn(self, rows: list[list[str]]) -> None:
        head = [SENTINEL] if self.cuts else []
        whole = ["".join(head + r) for r in rows]
        a, a_end, b, b_end, _ = self._tokens(whole)
        if self._fits(whole, a, b):
            units = [u for r in rows for u in head + r]
            names = [u for r in rows for u in [None] * len(head) + r]
            self._keep(names, np.cumsum([len(u.encode("utf-8", "replace")) for u in units]), a, a_end, b, b_end)
        elif len(rows) > 1:
            for r in rows:
                self._learn([r])
        elif len(rows[0]) > 1:
            for u in rows[0]:
                self._learn([[u]])
        else:
            self._refuse(rows[0][0])

    def aligned(self, texts: list[str]):
        """[n_a, n_b, n_groups, groups, distinct pairs, how often each] of each text; None where a text has no tokens."""
        split = [self.units(t) if t else [] for t in texts]
        if self.size > CACHE_BYTES:
            self.forget()
        self.learn([u for u in dict.fromkeys(u for units in split for u in units) if u not in self.known])
        for units in split:
            which = [self.known[u] for u in units]
            groups = [self.groups[i] for i in which]
            if not which or None in groups:
                yield None
                continue
            n = self.counts[which]
            per, starts = n[:, 2], self.starts[which]
            pairs = self.pairs[np.repeat(starts - (np.cumsum(per) - per), per) + np.arange(int(per.sum()))]
            yield [*n.sum(0).tolist(), b"".join(groups)[:-1], *np.unique(pairs, return_counts=True)]


@lru_cache(maxsize=2)
def aligner(a_path: str, b_path: str) -> Aligner:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark has the cores
    return Aligner(a_path, b_path)


def vocabularies() -> tuple[str, str]:
    """Paths of the byte-level vocabulary (A) and of the piece model (B)."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.json")), os.fspath(public_tokenizers.path("piece_bpe_32k.model"))


def _slices(texts: list[str | None]):
    """(first, end) of slices of about BATCH_CHARS code points."""
    lo, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t or "")
        if chars >= BATCH_CHARS or i + 1 == len(texts):
            yield lo, i + 1
            lo, chars = i + 1, 0


def aligned(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None, groups: bool = False) -> DataFrame:
    """``docs`` less ``text``, with how many tokens either tokenizer has, the groups' number and digest, and distinct pairs with their number.

    A group is written ``a1,a2|b1``, groups are joined by ``;``: with ``groups``,
    they are a column of that name. A pair is A's id times 2**32 and B's id. A
    text that is null, empty or not given back by a tokenizer has no tokens:
    zeros, empty strings, no pairs. Repeated rows are each aligned; an empty table
    gives an empty one; columns named as those added are replaced.
    """
    small_batches(docs.sparkSession)
    where = (a_path, b_path) if a_path and b_path else vocabularies()
    added = T.StructType([*ADDED, T.StructField("groups", T.StringType())]) if groups else ADDED
    rest = docs.drop(text, *added.names)
    names = rest.columns

    def run(batches):
        one = aligner(*where)
        try:
            for batch in batches:
                texts = batch.column(len(names)).to_pylist()
                for lo, hi in _slices(texts):
                    found = list(one.aligned(texts[lo:hi]))
                    piece = batch.slice(lo, hi - lo)
                    ends = np.cumsum([0, *(len(x[4]) if x else 0 for x in found)]).astype(np.int32)
                    flat = lambda k, kind: np.concatenate([np.zeros(0, kind), *(x[k] for x in found if x)]).astype(kind)  # noqa: B023, E731
                    pairs = pa.StructArray.from_arrays([pa.array(flat(4, np.int64)), pa.array(flat(5, np.int32))], names=["pair", "n"])
                    columns = [pa.array([x[k] if x else 0 for x in found], pa.int64()) for k in range(3)]
                    columns += [pa.array([hashlib.sha256(x[3]).hexdigest() if x else "" for x in found]), pa.ListArray.from_arrays(pa.array(ends), pairs)]
                    if groups:
                        columns.append(pa.array([x[3].decode() if x else "" for x in found]))
                    yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *columns], names=[*names, *added.names])
        finally:
            one.forget()  # the worker goes on to other tasks

    return docs.select(*names, text).mapInArrow(run, T.StructType([*rest.schema.fields, *added]))


def linked(docs: DataFrame, text: str = "text", a_path: str | None = None, b_path: str | None = None, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """aligned() without pairs, but with n_links, n_best and count_sum of each row.

    A link is a token of A and one of B that end together; a pair's count is how
    many links of the corpus are of it. n_best: links whose pair has the largest
    count of all pairs of its B id. count_sum: the links' counts, added up.
    """
    rows = kept(aligned(docs, text, a_path, b_path).withColumn("_row", F.monotonically_increasing_id()), "align-rows")
    links = rows.select("_row", F.inline("pairs"))
    counts = kept(links.groupBy("pair").agg(F.sum("n").alias("count")), "align-counts")
    b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    # a row for each id of B
    best = F.broadcast(counts.groupBy(b).agg(F.max("count").alias("top")))
    marked = kept(counts.withColumn("b", b).join(best, "b").select("pair", "count", (F.col("count") == F.col("top")).alias("best")), "align-marked")
    hot = kept(marked.orderBy(F.desc("count"), "pair").limit(hot_pairs), "align-hot")
    most = links.join(F.broadcast(hot), "pair")
    others = links.join(F.broadcast(hot.select("pair")), "pair", "left_anti").join(marked.hint("merge"), "pair")
    sums = [F.sum("n").alias("n_links"), F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum")]
    each = most.groupBy("_row").agg(*sums).unionByName(others.groupBy("_row").agg(*sums))
    total = each.groupBy("_row").agg(*(F.sum(c).alias(c) for c in ("n_links", "n_best", "count_sum")))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_links", "n_best", "count_sum")]
    own = [c for c in rows.columns if c not in ("_row", "pairs", "n_links", "n_best", "count_sum")]
    return rows.select("_row", *own).join(total, "_row", "left").select(*own, *zero)


def op13_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of both tokenizers, aligned, and how its links stand in the corpus."""
    return linked(table(spark, sf_dir, "documents").select("doc_id", "text"))
