"""Byte-level BPE encoding and decoding with a hierarchical-bitmap rank queue.

A pre-token is a doubly linked list of parts. Every adjacent pair that the
vocabulary can merge is filed under the merge's rank, in a bucket of list
positions; the ranks whose buckets are in use are marked in a hierarchical
bitmap, where find-first-set on the top word and then on the word it points to
gives the smallest rank. Popping the leftmost position of that bucket,
merging it and filing its two new pairs gives the order of merges that BPE
defines (lowest rank first, leftmost first). A position whose pair has changed
since it was filed is stale and skipped. Each merge costs a constant number of
steps besides the heap of one bucket, so one very long pre-token takes time in
proportion to its length, where scanning for the best pair would take its square.

Many short pre-tokens share one queue: they are so many linked lists side by
side, and a bucket then holds the positions of one merge in all of them. Popping
takes the leftmost position of each list at once, which is the same order of
merges for every list, and works on arrays. Long pre-tokens have the queue to
themselves, position by position.

Texts stay in the partitions they are in: encoding and decoding are maps over
Arrow batches. The distinct pre-tokens of many texts are merged together first.
A task keeps their codes, up to a bound in bytes, and lets go of them when it ends.
"""

from __future__ import annotations

import base64
import heapq
import os
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, table

#: Bytes of known pre-tokens (about; one costs ENTRY_BYTES besides its own) beyond which a task forgets them before it goes on.
CACHE_BYTES = 40_000_000
ENTRY_BYTES = 180
#: Pre-tokens of more code points are merged one by one and not kept.
SHORT_CHARS = 40
#: Distinct pre-tokens of the texts that are encoded together, at about; below FEW, they too are merged one by one.
MANY, FEW = 120_000, 2_000
#: Code points encoded, and ids decoded, before a batch of results is handed on.
BATCH_CHARS = 1_000_000
BATCH_IDS = 250_000


BIT = [1 << i for i in range(256)]


class RankQueue:
    """Positions by rank: two levels of 256-bit words over the ranks in use, and a bucket of positions for each.

    Empty after every pre-token, so one serves them all.
    """

    def __init__(self, most: int):
        self.words = [0] * ((most >> 8) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, at: int) -> None:
        if rank in self.buckets:
            heapq.heappush(self.buckets[rank], at)
        else:
            self.buckets[rank] = [at]
            word = rank >> 8
            self.words[word] |= BIT[rank & 255]
            self.top |= 1 << word

    def file(self, rank: int, places: np.ndarray) -> None:
        """As push(), of many positions."""
        if rank in self.buckets:
            self.buckets[rank].append(places)
        else:
            self.buckets[rank] = [places]
            word = rank >> 8
            self.words[word] |= BIT[rank & 255]
            self.top |= 1 << word

    def take(self) -> tuple[int, list[np.ndarray]]:
        """Smallest rank, and all that file() put into its bucket."""
        word = (self.top & -self.top).bit_length() - 1
        bits = self.words[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        self.words[word] = bits = bits & (bits - 1)
        if not bits:
            self.top &= self.top - 1
        return rank, self.buckets.pop(rank)

    def pop(self) -> tuple[int, int]:
        """Smallest rank, and its smallest position."""
        top, words = self.top, self.words
        word = (top & -top).bit_length() - 1  # find first set
        bits = words[word]
        rank = (word << 8) + (bits & -bits).bit_length() - 1
        bucket = self.buckets[rank]
        at = heapq.heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            words[word] = bits = bits & (bits - 1)
            if not bits:
                self.top = top & (top - 1)
        return rank, at


def merge(piece: bytes, ranks: dict[bytes, int], queue: RankQueue) -> list[int]:
    """Ids of one pre-token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 2))  # part at i is piece[i:end[i]]; 0 once it is merged into the part before
    prev = list(range(-1, n))
    get, push, pop = ranks.get, queue.push, queue.pop
    filed = [get(piece[i : i + 2]) for i in range(n)]  # rank of the pair that starts at i
    filed[n - 1] = None
    for i, rank in enumerate(filed):
        if rank is not None:
            push(rank, i)
    while queue.top:
        rank, i = pop()
        if filed[i] != rank:
            continue  # stale
        j = end[i]
        k = end[i] = end[j]
        filed[j] = None
        if k < n:
            prev[k] = i
            filed[i] = new = get(piece[i : end[k]])
            if new is not None:
                push(new, i)
        else:
            filed[i] = None
        h = prev[i]
        if h >= 0:
            filed[h] = new = get(piece[h:k])
            if new is not None:
                push(new, h)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Pairs:
    """Ranks of what pairs of tokens merge into, by the tokens' own ranks."""

    def __init__(self, ranks: dict[bytes, int]):
        found = [(left << 32 | right, rank) for token, rank in ranks.items() for i in range(1, len(token)) if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
        found.sort()
        self.keys = np.array([k for k, _ in found] or [-1], np.int64)
        self.into = np.array([r for _, r in found] or [-1], np.int32)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 where there is no merge."""
        key = (left.astype(np.int64) << 32) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.into[at], -1)


def merge_many(pieces: list[bytes], byte_ranks: np.ndarray, pairs: Pairs, queue: RankQueue) -> list[bytes]:
    """Ids of pre-tokens, as 32-bit numbers one after another; as merge() of each."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    ends = np.cumsum(sizes)
    token = byte_ranks[np.frombuffer(b"".join(pieces), np.uint8)]
    n = len(token)
    owner = np.repeat(np.arange(len(pieces), dtype=np.int32), sizes)
    after, before = np.arange(1, n + 1, dtype=np.int32), np.arange(-1, n - 1, dtype=np.int32)
    after[ends - 1], before[ends - sizes] = -1, -1
    filed = np.full(n, -1, np.int32)  # rank of the pair that starts here

    def file(ranks: np.ndarray, places: np.ndarray) -> None:
        filed[places] = ranks
        good = ranks >= 0
        ranks, places = ranks[good], places[good]
        if len(ranks) == 1:
            queue.file(int(ranks[0]), places)
        elif len(ranks):
            order = np.argsort(ranks, kind="stable")
            ranks, places = ranks[order], places[order]
            cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
            lo = 0
            for rank, hi in zip(ranks[np.append(0, cuts)].tolist(), [*cuts.tolist(), len(ranks)], strict=True):
                queue.file(rank, places[lo:hi])
                lo = hi

    inner = np.flatnonzero(after >= 0)
    file(pairs(token[inner], token[inner + 1]), inner)
    while queue.top:
        rank, parts = queue.take()
        at = parts[0] if len(parts) == 1 else np.concatenate(parts)
        at = at[filed[at] == rank]  # others are stale
        if len(at) > 1:
            at = np.unique(at)
            lists = owner[at]
            leftmost = np.append(True, lists[1:] != lists[:-1])
            if not leftmost.all():
                queue.file(rank, at[~leftmost])
                at = at[leftmost]
        if not len(at):
            continue
        gone = after[at]
        follow = after[gone]
        token[at], token[gone], filed[gone] = rank, -1, -1
        after[at] = follow
        has = follow >= 0
        before[follow[has]] = at[has]
        ahead = before[at]
        ahead = ahead[ahead >= 0]
        filed[at] = -1
        at, follow = at[has], follow[has]
        left = np.concatenate([token[at], token[ahead]])
        right = np.concatenate([token[follow], token[after[ahead]]])
        file(pairs(left, right), np.concatenate([at, ahead]))
    kept = token >= 0
    codes = token[kept].tobytes()
    cuts = [0, *(4 * np.cumsum(np.add.reduceat(kept, ends - sizes, dtype=np.int64))).tolist()]
    return [codes[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


class Codec:
    """Ranks, their bytes, and the pre-tokens that are known."""

    def __init__(self, path: str, pattern: str):
        self.ranks: dict[bytes, int] = {}
        with open(path, "rb") as f:
            for line in f:
                if line.strip():
                    token, rank = line.split()
                    self.ranks[base64.b64decode(token)] = int(rank)
        self.find = regex.compile(pattern).findall
        self.pairs = Pairs(self.ranks)
        self.byte_ranks = np.array([self.ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        self.forget()
        size = max(self.ranks.values(), default=0) + 1
        self.queue = RankQueue(size - 1)
        tokens: list[bytes] = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.fromiter(map(len, tokens), np.int64, size)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.pool = np.frombuffer(b"".join(tokens), np.uint8)

    def forget(self) -> None:
        """Let go of all pre-tokens."""
        self.known: dict[str, bytes] = {}
        self.size = 0

    def learn(self, pieces: list[str]) -> list[bytes]:
        """Ids of distinct pre-tokens, as codes(); short ones are known from then on."""
        if self.size > CACHE_BYTES:
            self.forget()
        known, whole, out, fresh = self.known, self.ranks.get, [], []
        for i, piece in enumerate(pieces):
            got = known.get(piece)
            if got is None:
                data = piece.encode("utf-8")
                rank = whole(data)
                if rank is not None:
                    got = rank.to_bytes(4, "little")
                elif len(piece) > SHORT_CHARS:
                    got = self.merged(data)
                else:
                    fresh.append((i, data))
            out.append(got)
        if len(fresh) < FEW or (self.byte_ranks < 0).any():
            codes = [self.merged(data) for _, data in fresh]
        else:
            codes = merge_many([data for _, data in fresh], self.byte_ranks, self.pairs, self.queue)
        for (i, _), got in zip(fresh, codes, strict=True):
            out[i] = known[pieces[i]] = got
            self.size += ENTRY_BYTES + len(pieces[i]) + len(got)
        return out

    def merged(self, piece: bytes) -> bytes:
        return np.array(merge(piece, self.ranks, self.queue), np.int32).tobytes()

    def codes(self, text: str) -> bytes:
        """Ids of a text as 32-bit numbers, one after another."""
        pieces, known = self.find(text), self.known
        try:
            return b"".join([known[x] for x in pieces])
        except KeyError:
            return b"".join([known.get(x) or self.merged(x.encode("utf-8")) for x in pieces])

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.codes(text), np.int32).tolist()

    def bytes(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids, one after another."""
        n = self.lengths[ids]
        return self.pool[np.repeat(self.starts[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def vocabulary() -> tuple[str, str]:
    """Path and pattern of the byte-level vocabulary of 50,256 ranks."""
    import public_tokenizers

    return os.fspath(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN


def _mapped(df: DataFrame, added: dict[str, T.DataType], path: str | None, pattern: str | None, make) -> DataFrame:
    """``df`` with more columns: ``make`` turns a codec and a record batch into (first, end, columns) of its slices."""
    small_batches(df.sparkSession)
    where = (path, pattern) if path and pattern else vocabulary()
    rest = df.drop(*added)
    schema = T.StructType([*rest.schema.fields, *(T.StructField(name, kind) for name, kind in added.items())])
    names = rest.columns

    def run(batches):
        c = codec(*where)
        try:
            for batch in batches:
                for lo, hi, columns in make(c, batch):
                    piece = batch.slice(lo, hi - lo)
                    yield pa.RecordBatch.from_arrays([*(piece.column(n) for n in names), *columns], names=[*names, *added])
        finally:
            c.forget()  # the worker goes on to other tasks

    return df.select(*names, *(name for name in added if name in df.columns)).mapInArrow(run, schema)


class Numbers(dict):
    """Numbers of things in the order in which they are first asked for."""

    def __missing__(self, key):
        number = self[key] = len(self)
        return number


def _encoded(c: Codec, column: pa.Array):
    """(first, end, list array of ids) of slices of about BATCH_CHARS code points."""
    at = 0
    while at < len(column):
        lo, numbers, texts, chars = at, Numbers(), [], []
        while at < len(column) and len(numbers) < MANY:
            text = column[at].as_py() or ""
            texts.append(np.fromiter(map(numbers.__getitem__, c.find(text)), np.int32))
            chars.append(len(text))
            at += 1
        codes = c.learn(list(numbers))
        sizes = np.fromiter(map(len, codes), np.int64, len(codes)) // 4
        starts, pool = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(codes), np.int32)
        first, slice_ = 0, np.cumsum(chars) // BATCH_CHARS
        while first < len(texts):
            end = int(np.searchsorted(slice_, slice_[first], side="right"))
            which = np.concatenate(texts[first:end])
            n = sizes[which]
            run = np.concatenate([[0], np.cumsum(n)])
            ids = pool[np.repeat(starts[which] - run[:-1], n) + np.arange(run[-1])]
            ends = run[np.cumsum([0, *map(len, texts[first:end])])]
            yield lo + first, lo + end, pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids, pa.int32()))
            first = end


def _decoded(c: Codec, column: pa.Array):
    """(first, end, binary array) of slices of about BATCH_IDS ids."""
    counts = np.asarray(column.value_lengths().fill_null(0))
    flat = np.asarray(column.flatten())
    ends = np.concatenate([[0], np.cumsum(counts)])
    if len(flat) and (flat.min() < 0 or flat.max() >= len(c.lengths)):
        raise ValueError("an id outside the vocabulary")
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, ends[lo] + BATCH_IDS, side="right")) - 1)
        mine = flat[ends[lo] : ends[hi]]
        sums = np.concatenate([[0], np.cumsum(c.lengths[mine])])
        offsets = sums[ends[lo : hi + 1] - ends[lo]].astype(np.int32)
        yield lo, hi, pa.Array.from_buffers(pa.binary(), hi - lo, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(c.bytes(mine).tobytes())])
        lo = hi


IDS, BYTES = T.ArrayType(T.IntegerType()), T.BinaryType()


def encoded(docs: DataFrame, text: str = "text", ids: str = "ids", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``docs`` with the ids of every whole text.

    A null or empty text has no ids. Special tokens are ordinary text. Other
    columns pass unchanged; a column named as ``ids`` is replaced. An empty
    table gives an empty one.
    """
    def make(c, batch):
        for lo, hi, column in _encoded(c, batch.column(text)):
            yield lo, hi, [column]

    return _mapped(docs, {ids: IDS}, path, pattern, make)


def decoded(rows: DataFrame, ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """``rows`` with the bytes that its ids stand for; null ids give no bytes. An id outside the vocabulary is an error."""
    def make(c, batch):
        for lo, hi, column in _decoded(c, batch.column(ids)):
            yield lo, hi, [column]

    return _mapped(rows, {out: BYTES}, path, pattern, make)


def round_trip(docs: DataFrame, text: str = "text", ids: str = "ids", out: str = "decoded", path: str | None = None, pattern: str | None = None) -> DataFrame:
    """decoded(encoded(docs)) in one pass, so that a task keeps one Python worker and one vocabulary."""
    def make(c, batch):
        for lo, hi, codes in _encoded(c, batch.column(text)):
            for a, b, column in _decoded(c, codes):
                yield lo + a, lo + b, [codes.slice(a, b - a), column]

    return _mapped(docs, {ids: IDS, out: BYTES}, path, pattern, make)


def digest(ids: Column) -> Column:
    return F.sha2(F.array_join(ids.cast("array<string>"), " "), 256)


def op7_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Ids of every document, and what they decode to, as digests."""
    rows = round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
