"""N-gram Jaccard join by partitioning the universe of shingles.

A document's set holds its distinct five-word shingles, as 64-bit hashes. Two
sets link if their Jaccard similarity is 0.75 or more; then they differ in at
most H = (|r| + |s|) // 7 elements, and the larger is at most 4/3 the smaller.

Sizes fall into bands, and each band hashes the universe into a number of
segments that grows with its sizes. A set of the band is filed under its part
in every non-empty segment (whole), and in a twelfth of the segments also under
what is left of the part without each one of its elements (deletions).

The larger set of a pair asks. In a segment it may spend nothing, one unit (ask
for sets with the same part), or, where deletions are filed, two (ask for parts
that differ by one element at most, by its whole part and its own deletions).
By the pigeonhole principle a linked set is met if the units come to H + 1 at
least: it can't differ by as much as was spent in every segment. Which units
are spent is decided by their cost: a part is as common as its rarest shingle
among all documents, and asking for deletions costs as many look-ups as the
part has elements. So parts of a passage that many documents share are asked for
only by sets that have too little else. A set asks in its own band and, if
three quarters of its size are below that, in the one below.

* Sizes 3 to 5 (H = 1): the universe is one segment, of two units.
* Sizes 6 to 23: every shingle is a segment of its own.
* Larger sizes, in bands by twos: about an eighth more segments than units are
  needed. A set that has too few non-empty ones nevertheless (about one in ten
  million) is held against the sketches of all documents, in blocks of such sets.

Texts with equal sets form a class that is represented once. What is filed
under one key is a group, of which somebody must ask. Each member meets the one
before it, by size as a rule, and the first. Candidates differ in at least as many shingles as
their parity sketches (one bit for the parity of each cell) differ in bits,
which drops almost all wrong pairs; each document's likeliest partner is
verified on the whole texts first, then all likely pairs that this leaves apart.
Linked representatives are contracted to components. In groups that still hold
different components, every pair across components of which one asks is then
held against the sketches, in blocks: of each two components in a block the
likeliest pair is verified, and last every likely pair that is left. So no link
is lost, and a large group of near copies costs a number of rows in proportion
to its size: the members of its main component meet only those outside it.
"""

from __future__ import annotations

from itertools import batched

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import kept, small_batches, table

WORDS = 5
#: Shingles are common that are in at least so many documents, or, where that is more, in half as many again as a cell has shingles on average.
COMMON_FROM = 3
#: Cells in which all shingles are counted to tell which may be common, a power of two; and the rows in which a task's counts travel.
CELLS = 1 << 21
CELL_ROWS = 1 << 9
#: Costs are in documents of so many.
COST_DOCS = 10_000
#: Classes of equal sets, or candidates, up to which they are broadcast; beyond, they are joined.
BROADCAST_ROWS = 400_000
#: Members of a block: small groups share one, larger ones are cut up.
BLOCK = 4096
#: Pairs of members that are looked at together, and words of their sketches.
STEP_PAIRS = 1 << 19
STEP_WORDS = 1 << 20
#: Cells of the longest sketch; with fewer than four an element it lets more pairs through.
MOST_CELLS = 1 << 16
#: Bytes of texts that are hashed at once (their arrays fit a core's cache), and characters whose sets are looked at together.
HASHED_BYTES = 200_000
SLICE_CHARS = 1_000_000
#: Arrow batches of keys that are looked at together.
NEIGHBOUR_BATCHES = 16
#: Sets that are held against all documents at once.
SHORT_SETS = 500
#: What a row under a key is: filed whole, asking for whole parts, asking for deletions, filed as a deletion.
WHOLE, ASKS, ASKS_DELETIONS, DELETION = 1, 2, 4, 8
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True

_U = np.uint64
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**64, 256, dtype=_U)
_BASE = _U(int(_RNG.integers(0, 2**63)) * 2 + 1)
_PLACE = _RNG.integers(0, 2**63, WORDS, dtype=_U) * _U(2) + _U(1)


def mixed(x: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit finaliser with a salt."""
    x = x + _U((0x9E3779B97F4A7C15 * (salt + 1)) % 2**64)
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def powers(n: int, made: list[np.ndarray] = []) -> tuple[np.ndarray, np.ndarray]:  # noqa: B006
    """The first ``n`` powers of the base and of its inverse; a worker keeps them."""
    if not made or len(made[0]) < n:
        made.clear()
        for base in (_BASE, _U(pow(int(_BASE), -1, 2**64))):
            x = np.full(n, base, _U)
            x[0] = 1
            made.append(np.cumprod(x, out=x))
    return made[0][:n], made[1][:n]


def distinct(x: np.ndarray) -> np.ndarray:
    """Sorted, each value once."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer than five words make one shingle, none makes an empty set."""
    out: list[np.ndarray] = []
    raw, size = [], 0
    for i, t in enumerate(texts):
        raw.append((t or "").encode("utf-8", "replace").lower())
        size += len(raw[-1])
        if size >= HASHED_BYTES or i + 1 == len(texts):
            out += _shingle_sets(raw)
            raw, size = [], 0
    return out


def _shingle_sets(raw: list[bytes]) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
    limits = np.cumsum([len(r) + 1 for r in raw])
    space = SPACES[data]
    edges = np.flatnonzero(np.concatenate([[not space[0]], space[1:] != space[:-1]]))
    begins, ends = edges[::2], edges[1::2]
    up, back = powers(len(data))
    run = np.zeros(len(data) + 1, _U)
    np.cumsum(_BYTE[data] * up, out=run[1:])
    words = mixed((run[ends] - run[begins]) * back[begins] + (ends - begins).astype(_U), 1)
    cuts = np.searchsorted(begins, np.concatenate([[0], limits])).tolist()
    out = []
    full = np.zeros(max(0, len(words) - WORDS + 1), _U)
    for j in range(WORDS):
        if len(full):
            full += words[j : j + len(full)] * _PLACE[j]
    full = mixed(full, 2)
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        if b - a >= WORDS:
            out.append(distinct(full[a : b - WORDS + 1]))
        elif b > a:
            out.append(mixed(np.array([(words[a:b] * _PLACE[: b - a]).sum() + _U(b - a)], _U), 3))
        else:
            out.append(full[:0])
    return out


def band(n: np.ndarray) -> np.ndarray:
    """0 for sizes 3 to 5, 1 for 6 to 23, 2 for 24 to 47 and so on by twos; -1 for those below 3."""
    return np.where(n < 3, -1, np.where(n < 6, 0, np.where(n < 24, 1, 2 + np.log2(np.maximum(n, 24) / 24).astype(np.int64))))


def lowest(k: int) -> int:
    return (3, 6)[k] if k < 2 else 24 << (k - 2)


def segments(k: int) -> tuple[int, int]:
    """Segments of a band, 0 for one to each shingle, and how many of them have deletions filed."""
    if k < 2:
        return (1, 1) if k == 0 else (0, 0)
    top = lowest(k + 1) - 1
    units = (top + top * 4 // 3) // 7 + 1
    count = units + units // 8 + 2
    return count, max(2, count // 12)


def per_set(values: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Wrapping sums of 64-bit values by owner."""
    run = np.concatenate([np.zeros(1, _U), np.cumsum(values, dtype=_U)])
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return run[ends] - run[np.concatenate([[0], ends[:-1]])]


def keys(flat: np.ndarray, owner: np.ndarray, cost: np.ndarray, k: int, units: np.ndarray, files: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(set, key) rows in the scheme of band k, and which sets have too few units.

    ``flat`` are the shingles of all sets, ``owner`` the sets they are of, in
    order; ``units`` are what each set has to spend. ``files``: the sets are of
    this band, and are filed besides asking. The last four bits of a key are the
    row's roles.
    """
    count, deletable = segments(k)
    cost = np.minimum(cost, (1 << 20) - 1)
    if count == 0:
        part, first, size = mixed(flat, 6 + k), np.arange(len(flat)), np.ones(len(flat), np.int64)
        who, total, inner, cheap, second, gone = owner, part, part, cost, cost, np.zeros(len(flat), bool)
        order = first
    else:
        where = (mixed(flat, 6 + k) % _U(count)).astype(np.int64)
        order = np.argsort(((owner * count + where) << 20) | cost)
        place = (owner * count + where)[order]
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
        size = np.diff(np.append(first, len(place)))
        who, segment = owner[order][first], where[order][first]
        inner = mixed(flat, 4)[order]
        total = np.add.reduceat(inner, first) if len(first) else inner
        cheap = cost[order][first]
        second = cost[order][np.minimum(first + 1, len(place) - 1)]
        gone = segment < deletable
        total = total + mixed(segment.astype(_U), 5)
    # what each unit costs: the first of every part, the second where deletions are filed
    both = np.flatnonzero(gone & (size > 1)) if k else np.flatnonzero(gone & (size > 0))
    price = np.concatenate([cheap, (size * (1 + cheap) + second)[both]])
    price = np.minimum(price, (1 << 21) - 1) * 8 + np.concatenate([7 - np.minimum(size, 7), np.full(len(both), 7)])
    at = np.concatenate([np.arange(len(who)), both])
    tie = (mixed(total, 3)[at] >> _U(44)).astype(np.int64)
    by = np.argsort((who[at] << 44) | (price << 20) | tie)  # a slice's sets stay below 2**19
    have = np.bincount(who[at], minlength=len(units))
    begin = np.cumsum(have) - have
    taken = np.zeros(len(at), bool)
    taken[by] = np.arange(len(at)) - begin[who[at][by]] < units[who[at][by]]
    spent = np.bincount(at[taken], minlength=len(who))
    too_few = have < units
    spent[too_few[who]] = 0
    role = np.where(spent > 0, ASKS, 0) | np.where(spent > 1, ASKS_DELETIONS, 0) | (WHOLE if files else 0)
    final = lambda x: mixed(x, 6 + k) & ~_U(15)
    shown = role > 0
    sets, out = [who[shown]], [final(total[shown]) | role[shown].astype(_U)]
    # deletions: filed where the part has three or more elements (all of them in the only segment of the least band), asked for where two units are spent
    filed = gone & (size >= (3 if k else 1)) if files else np.zeros(len(who), bool)
    chosen = filed | (spent > 1)
    if chosen.any():
        spread = np.repeat(np.arange(len(who)), size)
        inside = chosen[spread]
        of = spread[inside]
        role = np.where(filed[of], DELETION, 0) | np.where(spent[of] > 1, ASKS, 0)
        sets.append(who[of])
        out.append(final(total[of] - inner[inside]) | role.astype(_U))
    return np.concatenate(sets), np.concatenate(out), too_few


def filed_keys(sets: list[np.ndarray], common: tuple[np.ndarray, np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """The keys of each set in its own band's scheme and, where its partners may be there, in the one below; which sets lack units."""
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    bands, short, rows = band(n), np.zeros(len(sets), bool), []
    every = np.concatenate([*sets, np.zeros(0, _U)])
    cost, whose = costs(every, common), np.repeat(np.arange(len(sets)), n)
    for k in range(int(bands.max(initial=-1)) + 1):
        for files in (True, False):
            least = lowest(k + 1)
            chosen = bands == k if files else (bands == k + 1) & (3 * n <= 4 * (least - 1))
            mine = np.flatnonzero(chosen)
            if not len(mine):
                continue
            inside = np.flatnonzero(chosen[whose])
            owner = np.repeat(np.arange(len(mine)), n[mine])
            largest = n[mine] if files else np.minimum(n[mine], least - 1)
            who, key, few = keys(every[inside], owner, cost[inside], k, (n[mine] + largest) // 7 + 1, files)
            rows.append((mine[who], key))
            short[mine[few]] = True
    if not rows:
        return [np.zeros(0, _U)] * len(sets), short
    who, key = (np.concatenate(x) for x in zip(*rows, strict=True))
    order = np.argsort(who, kind="stable")
    return np.split(key[order], np.cumsum(np.bincount(who, minlength=len(sets)))[:-1]), short


def costs(s: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """In how many documents of COST_DOCS each shingle is, 0 where it isn't common."""
    shingles, counts = common
    if not len(shingles):
        return np.zeros(len(s), np.int64)
    at = np.minimum(np.searchsorted(shingles, s), len(shingles) - 1)
    return np.where(shingles[at] == s, counts[at], 0)


def parity_sketch(s: np.ndarray) -> bytes:
    """Parity of the number of elements in each cell; four cells an element, rounded up to a power of two, MOST_CELLS at most."""
    cells = 64
    while cells < min(MOST_CELLS, 4 * len(s)):
        cells *= 2
    counts = np.bincount((mixed(s, 30) % _U(cells)).astype(np.int64), minlength=cells)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def parity_distance(a: bytes, b: bytes) -> int:
    """At most the number of elements in which the sets behind two sketches differ."""
    if len(a) < len(b):
        a, b = b, a
    x, bits = int.from_bytes(a, "little"), len(a) * 8
    while bits > len(b) * 8:
        bits //= 2
        x = (x >> bits) ^ (x & ((1 << bits) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


def slices(column: pa.Array, most: int = SLICE_CHARS):
    """(first, texts) of slices of about ``most`` characters."""
    lo, chars, part = 0, 0, []
    for i in range(len(column)):
        part.append(column[i].as_py())
        chars += len(part[-1] or "")
        if chars >= most or i + 1 == len(column):
            yield lo, part
            lo, chars, part = i + 1, 0, []


def signed(x: np.ndarray) -> np.ndarray:
    return x.astype(_U).view(np.int64)


def set_hashes(sets: list[np.ndarray]) -> list[pa.Array]:
    """Two hashes of each set; null for an empty one."""
    flat = np.concatenate([*sets, np.zeros(0, _U)])
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    owner = np.repeat(np.arange(len(sets)), n)
    return [pa.array(signed(per_set(mixed(flat, salt), owner, len(sets))), mask=n == 0) for salt in (20, 21)]


DESCRIBED = "doc_id long, n_shingles long, h1 long, h2 long, sketch binary"


def description(ids: pa.Array, sets: list[np.ndarray]) -> list[pa.Array]:
    return [ids, pa.array([len(s) for s in sets], pa.int64()), *set_hashes(sets), pa.array([parity_sketch(s) for s in sets], pa.binary())]


def described(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, two hashes of the set (null for an empty one) and its parity sketch."""
    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, part in slices(texts):
                yield pa.RecordBatch.from_arrays(description(ids.slice(lo, len(part)), shingle_sets(part)), names=["doc_id", "n_shingles", "h1", "h2", "sketch"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, DESCRIBED)


def described_and_counted(docs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """described() and counted_cells() from one pass over the texts; kept."""
    def run(batches):
        counts = np.zeros(CELLS, np.uint32)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, part in slices(texts):
                sets = shingle_sets(part)
                count(sets, counts)
                none = [pa.nulls(len(part), x) for x in (pa.int32(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*description(ids.slice(lo, len(part)), sets), *none], names=names)
        for part in narrow(counts):
            yield pa.RecordBatch.from_arrays([*(pa.nulls(len(part[0]), x) for x in (*[pa.int64()] * 4, pa.binary())), *part], names=names)

    names = ["doc_id", "n_shingles", "h1", "h2", "sketch", "row", "counts"]
    both = kept(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"{DESCRIBED}, {COUNTED}"), name)
    return both.where(F.col("row").isNull()).drop("row", "counts"), both.where(F.col("row").isNotNull()).select("row", "counts")


def cell(shingles: np.ndarray, cells: int) -> np.ndarray:
    return (shingles & _U(cells - 1)).astype(np.int64)


COUNTED = "row int, counts binary"


def count(sets: list[np.ndarray], counts: np.ndarray) -> None:
    """Adds the shingles of ``sets`` to those of each cell."""
    np.add.at(counts, cell(np.concatenate([*sets, np.zeros(0, _U)]), len(counts)), np.uint32(1))


def narrow(counts: np.ndarray):
    """(row, counts) columns of a table of cells in CELL_ROWS rows, as narrow as they may be; rows of zeros are left out."""
    table_ = counts.reshape(CELL_ROWS, -1)
    rows = np.flatnonzero(table_.any(axis=1))
    for lo in range(0, len(rows), 64):
        part = rows[lo : lo + 64]
        yield [pa.array(part, pa.int32()), pa.array([table_[i].astype(np.min_scalar_type(table_[i].max())).tobytes() for i in part], pa.binary())]


def counted_cells(docs: DataFrame, cells: int) -> DataFrame:
    """row and counts: how many shingles of a task's documents fall into each cell."""
    def run(batches):
        counts = np.zeros(cells, np.uint32)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                count(shingle_sets(part), counts)
        for part in narrow(counts):
            yield pa.RecordBatch.from_arrays(part, names=["row", "counts"])

    return docs.select("text").mapInArrow(run, COUNTED)


def crowded_cells(counted: DataFrame, least: int, cells: int) -> np.ndarray:
    """Of each cell, whether ``least`` shingles or more of all documents fall into it; one that is in so many documents is in such a cell.

    Only the answers, a bit a cell, are collected.
    """
    width = cells // CELL_ROWS

    def crowded(pdf):
        import pandas as pd

        total = np.zeros(width, np.int64)
        for counts in pdf["counts"]:
            total += np.frombuffer(counts, f"u{len(counts) // width}")
        return pd.DataFrame({"row": pdf["row"].iloc[:1], "crowded": [np.packbits(total >= least).tobytes()]})

    out = np.zeros((CELL_ROWS, width), bool)
    for r in counted.groupBy("row").applyInPandas(crowded, "row int, crowded binary").collect():  # a bit a cell
        out[r["row"]] = np.unpackbits(np.frombuffer(r["crowded"], np.uint8), count=width).astype(bool)
    return out.reshape(-1)


def common_shingles(docs: DataFrame, described_: DataFrame, cells: int = CELLS, counted: DataFrame | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The common shingles and in how many documents of COST_DOCS they are, counted over all documents. They price parts, and decide no link.

    All shingles are counted in cells first (``counted``, if that has been done); then those in crowded cells are
    counted one by one. No more than two in three cells can have half as many
    again as there are on average, so all that are common fit the driver.
    """
    size = described_.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n_shingles"), F.lit(0)).alias("shingles")).first()
    least = max(COMMON_FROM, -(-3 * size["shingles"] // (2 * cells)))
    counted = counted_cells(docs, cells) if counted is None else counted
    shared = docs.sparkSession.sparkContext.broadcast(np.packbits(crowded_cells(counted, least, cells)))

    def run(batches):
        crowded = np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            for _, part in slices(batch.column(0)):
                flat = np.concatenate([*shingle_sets(part), np.zeros(0, _U)])
                keys, counts = np.unique(flat[crowded[cell(flat, cells)]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(signed(keys)), pa.array(counts, pa.int64())], names=["shingle", "n"])

    counted = docs.select("text").mapInArrow(run, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    got = counted.toPandas()
    keys = got["shingle"].to_numpy(np.int64).view(_U)
    order = np.argsort(keys)
    share = min(1.0, COST_DOCS / max(1, size["docs"]))
    return keys[order], np.maximum(1, np.rint(got["n"].to_numpy(np.int64)[order] * share)).astype(np.int64)


def filed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """doc_id, n, the set's hashes, its keys and whether it has too few units, of every document with a set of three or more."""
    shared = docs.sparkSession.sparkContext.broadcast(common)  # fewer than CELLS pairs of numbers

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for lo, part in slices(texts):
                sets = shingle_sets(part)
                lists, short = filed_keys(sets, shared.value)
                ends = np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int32)
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(signed(np.concatenate(lists))))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, len(part)), pa.array([len(s) for s in sets], pa.int32()), *set_hashes(sets), column, pa.array(short)],
                    names=["doc_id", "n", "h1", "h2", "keys", "short"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("doc_id").isNotNull())
    return rows.mapInArrow(run, "doc_id long, n int, h1 long, h2 long, keys array<long>, short boolean")


def hinted(df: DataFrame) -> DataFrame:
    """``df`` to be broadcast if it has at most BROADCAST_ROWS rows; any join strategy otherwise."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def neighbours(rows: DataFrame) -> DataFrame:
    """The rows (key, doc_id, n, role) whose key isn't theirs alone, and those of role 0, with the document ``before`` them and the first one (``least``) of the key.

    Both are null where the sizes are too far apart, neither row asks for the
    other, or they are one and the same. Keys are sorted within partitions and
    streamed: a task holds one batch, however many rows a key has. Within a
    batch the documents of a key go by size, smallest first.
    """
    def met(doc, n, role, other, m, roles):
        good = (doc != other) & (4 * m >= 3 * n) & (4 * n >= 3 * m) & (asks(role, roles) | asks(roles, role))
        return pa.array(other, mask=~good)

    def run(batches):
        carry = None  # the last row, which may have a neighbour in the next batch: key, doc, n, role, then those of the row before and of the first of its key
        for several in batched(batches, NEIGHBOUR_BATCHES):
            key, doc, marked = (np.concatenate([np.asarray(batch.column(x)) for batch in several]) for x in ("key", "doc_id", "marked"))
            if not len(key):
                continue
            some = (marked & 15) == 0
            some[0] = some[-1] = True  # their key may go on beyond these batches
            twice = key[1:] == key[:-1]
            some[1:] |= twice
            some[:-1] |= twice
            marked = marked[some].astype(np.int64)
            fresh = [key[some], doc[some], marked >> 4, marked & 15]
            by = np.lexsort((fresh[1], fresh[2], fresh[0]))
            fresh = [x[by] for x in fresh]
            key, doc, n, role = fresh if carry is None else (np.concatenate([[c], f]) for c, f in zip(carry[:4], fresh, strict=True))
            at = np.arange(len(key))
            same = np.concatenate([[carry is not None and carry[4] is not None], key[1:] == key[:-1]])
            previous = np.maximum(at - 1, 0)
            first = np.maximum.accumulate(np.where(same, 0, at))
            before, least = ([x[i].copy() for x in (doc, n, role)] for i in (previous, first))
            if same[0]:
                for column, value in zip(before, carry[4], strict=True):
                    column[0] = value
                run_ = int(np.argmin(same)) if not same.all() else len(same)
                for column, value in zip(least, carry[5], strict=True):
                    column[:run_] = value
            give = same.copy()
            give[:-1] |= same[1:]
            give |= role == 0
            carry = (key[-1], doc[-1], n[-1], role[-1], [x[-1] for x in before] if same[-1] else None, [x[-1] for x in least])
            give[-1] = False
            yield given(key, doc, n, role, before, least, same, give)
        if carry is not None and (carry[4] is not None or carry[3] == 0):
            one = [np.array([x]) for x in carry[:4]]
            before = [np.array([x]) for x in carry[4] or carry[1:4]]
            yield given(*one, before, [np.array([x]) for x in carry[5]], np.array([carry[4] is not None]), np.array([True]))

    def given(key, doc, n, role, before, least, same, give):
        key, doc, n, role, same = (x[give] for x in (key, doc, n, role, same))
        before, least = ([x[give] for x in part] for part in (before, least))
        before[0] = np.where(same, before[0], doc)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), pa.array(n.astype(np.int32)), pa.array(role.astype(np.int32)), met(doc, n, role, *before), met(doc, n, role, *least)], names=["key", "doc_id", "n", "role", "before", "least"])

    marked = F.shiftleft("n", 4).bitwiseOR(F.col("role")).alias("marked")  # one column less to move
    return rows.select("key", "doc_id", marked).repartition("key").sortWithinPartitions("key").mapInArrow(run, "key long, doc_id long, n int, role int, before long, least long")


def near_enough(n: Column, m: Column) -> Column:
    return (4 * n >= 3 * m) & (4 * m >= 3 * n)


def likely(pairs: DataFrame, described_: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that the sketches let pass, with the bits in which these differ; kept."""
    side = lambda x: described_.select(F.col("doc_id").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def sift(batches):
        for batch in batches:
            a, b, na, nb, sa, sb = (batch.column(x).to_pylist() for x in ("a", "b", "na", "nb", "sa", "sb"))
            bits = [parity_distance(x, y) for x, y in zip(sa, sb, strict=True)]
            good = [i for i, (d, n, m) in enumerate(zip(bits, na, nb, strict=True)) if d <= (n + m) // 7]
            yield pa.RecordBatch.from_arrays([pa.array([v[i] for i in good], pa.int64()) for v in (a, b, bits)], names=["a", "b", "bits"])

    near = pairs.join(side("a"), "a").join(side("b"), "b").where(near_enough(F.col("na"), F.col("nb"))).select("a", "b", "na", "nb", "sa", "sb")
    return kept(near.mapInArrow(sift, "a long, b long, bits long"), name)


def nearest(pairs: DataFrame) -> DataFrame:
    """For each document in ``pairs`` (a, b, bits), the pair with the other that is most like it."""
    ends = pairs.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("bits"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("bits"), F.col("a").alias("other")))).alias("e"))
    best = ends.select("e.*").groupBy("node").agg(F.min(F.struct("bits", "other")).alias("m"))
    return best.select(F.least("node", "m.other").alias("a"), F.greatest("node", "m.other").alias("b")).distinct()


def linked(r: np.ndarray, s: np.ndarray) -> bool:
    both = len(np.intersect1d(r, s, assume_unique=True))
    return bool(both) and 100 * both >= 75 * (len(r) + len(s) - both)


def verified(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    """Those of ``pairs`` (a, b) that link, by their whole texts; kept. Texts that no pair names aren't moved."""
    pairs = kept(pairs.select("a", "b"), f"{name}-pairs")
    wanted = hinted(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct())
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted, "doc_id", "left_semi")
    texts = kept(texts, f"{name}-texts")

    def judge(batches):
        for batch in batches:
            names = ("a", "b", "ta", "tb")
            for lo in range(0, batch.num_rows, 256):
                a, b, ta, tb = (batch.column(x).slice(lo, 256) for x in names)
                at: dict[str, int] = {}
                sides = [[at.setdefault(t or "", len(at)) for t in column.to_pylist()] for column in (ta, tb)]
                sets = [x for _, part in slices(pa.array(list(at), pa.large_string())) for x in shingle_sets(part)]
                mask = pa.array([linked(sets[i], sets[j]) for i, j in zip(*sides, strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([a.filter(mask), b.filter(mask)], names=["a", "b"])

    both = pairs.join(texts.select(F.col("doc_id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("tb")), "b")
    return kept(both.select("a", "b", "ta", "tb").mapInArrow(judge, "a long, b long").distinct(), f"{name}-links")


def pairs_of_short(short: DataFrame, described_: DataFrame) -> DataFrame | None:
    """Likely pairs (a, b, bits) of the documents ``short`` (doc_id) with all others, except equal sets; None if there are none.

    Blocks of SHORT_SETS are held against the sketches of all documents.
    """
    short = kept(short.distinct(), "jaccard-short")
    blocks = -(-short.count() // SHORT_SETS)
    rows = described_.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)).select("doc_id", "n_shingles", "h1", "h2", "sketch")
    out = None
    for i in range(blocks):
        mine = short.where(F.pmod(F.xxhash64("doc_id"), F.lit(blocks)) == i)
        held = rows.join(F.broadcast(mine), "doc_id").collect()  # a bounded block of sketches
        shared = described_.sparkSession.sparkContext.broadcast([tuple(r) for r in held])

        def meet(batches, shared=shared):
            for batch in batches:
                ids, n, h1, h2 = (np.asarray(batch.column(x)) for x in range(4))
                sketches = batch.column(4).to_pylist()
                words = np.array([len(x) // 8 for x in sketches], np.int64)
                matrices, found = {}, []
                for doc, m, g1, g2, sketch in shared.value:
                    fits = (4 * n >= 3 * m) & (4 * m >= 3 * n) & (ids != doc) & ~((h1 == g1) & (h2 == g2))
                    for length in np.unique(np.minimum(words[fits], len(sketch) // 8)).tolist():  # the smaller sketch's
                        if length not in matrices:
                            matrices[length] = folded([x if len(x) >= 8 * length else b"" for x in sketches], length)
                        at = np.flatnonzero(fits & (np.minimum(words, len(sketch) // 8) == length))
                        bits = np.bitwise_count(matrices[length][at] ^ folded([sketch], length)).sum(axis=1, dtype=np.int64)
                        good = bits <= (n[at] + m) // 7
                        found += [(doc, j, d) for j, d in zip(ids[at[good]].tolist(), bits[good].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([f[x] for f in found], pa.int64()) for x in range(3)], names=["a", "b", "bits"])

        pairs = rows.mapInArrow(meet, "a long, b long, bits long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "bits")
        pairs = kept(pairs.groupBy("a", "b").agg(F.min("bits").alias("bits")), "jaccard-short-pairs")
        out = pairs if out is None else out.unionByName(pairs)
    return out


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its smallest node) of every node of ``links`` (a, b).

    Each round hooks every node to its smallest neighbour, shortens the hooks by
    following them, and contracts the links to what is still apart; the number
    of rounds is about the logarithm of the longest path.
    """
    edges = kept(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), name)
    result = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("e")).select("e.*")
        hooks = kept(ends.groupBy("node").agg(F.least("node", F.min("other")).alias("root")), name)
        while True:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            longer = kept(hooks.join(up, "root").select("node", F.col("above").alias("root"), (F.col("above") != F.col("root")).alias("moved")), name)
            hooks = longer.select("node", "root")
            if longer.where("moved").isEmpty():
                break
        if result is None:
            result = hooks
        else:
            up = hooks.select(F.col("node").alias("root"), F.col("root").alias("above"))
            result = kept(result.join(up, "root", "left").select("node", F.coalesce("above", "root").alias("root")), name)
        to = lambda x: hooks.select(F.col("node").alias(x), F.col("root").alias(f"r{x}"))
        edges = kept(edges.join(to("a"), "a").join(to("b"), "b").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(), name)
    if result is None:
        return links.sparkSession.createDataFrame([], "node long, component long")
    return result.select("node", F.col("root").alias("component"))


def folded(sketches: list[bytes], words: int) -> np.ndarray:
    """Sketches as rows of ``words`` 64-bit words each; longer ones are folded."""
    out = np.zeros((len(sketches), words), _U)
    lengths = np.array([len(x) // 8 for x in sketches])
    for length in np.unique(lengths[lengths >= words]):
        mine = np.flatnonzero(lengths == length)
        rows = np.frombuffer(b"".join(sketches[i] for i in mine), _U).reshape(len(mine), length)
        while rows.shape[1] > words:
            rows = rows[:, : rows.shape[1] // 2] ^ rows[:, rows.shape[1] // 2 :]
        out[mine] = rows
    return out


def asks(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Whether rows of role ``x`` ask for those of role ``y``."""
    return ((x & ASKS) > 0) & ((y & WHOLE) > 0) | ((x & ASKS_DELETIONS) > 0) & ((y & DELETION) > 0)


def crossing(group: np.ndarray, ids: np.ndarray, n: np.ndarray, component: np.ndarray, role: np.ndarray, sketches: list[bytes], best: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of members of a group (places in the arrays) across components of which one asks, of near enough sizes and likely by their sketches.

    ``best``: of each two components only the likeliest pair.
    """
    order = np.lexsort((ids, n, group))
    group, ids, n, component, role = (x[order] for x in (group, ids, n, component, role))
    group = np.cumsum(np.concatenate([[0], group[1:] != group[:-1]]))
    words = np.array([len(sketches[i]) // 8 for i in order])
    place = (group << 40) + n
    last = np.searchsorted(place, (group << 40) + n * 4 // 3, side="right")
    partners = last - np.arange(len(ids)) - 1  # the members after each that aren't too large
    total = np.concatenate([[0], np.cumsum(partners)])
    left, right, bits, at = [], [], [], 0
    matrices = {}
    while at < len(ids):
        end = max(at + 1, int(np.searchsorted(total, total[at] + STEP_PAIRS, side="right")) - 1)
        count = partners[at:end]
        a = np.repeat(np.arange(at, end), count)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(count) - count, count)
        at = end
        fits = component[a] != component[b]
        a, b = a[fits], b[fits]
        fits = (ids[a] != ids[b]) & (asks(role[a], role[b]) | asks(role[b], role[a]))
        a, b = a[fits], b[fits]
        for length in np.unique(words[a]):  # the smaller set's sketch; the other is no shorter
            if length not in matrices:
                matrices[length] = folded([sketches[i] if length <= w <= 2 * length else b"" for i, w in zip(order, words, strict=True)], int(length))
            mine, matrix = np.flatnonzero(words[a] == length), matrices[length]
            for lo in range(0, len(mine), max(1, STEP_WORDS // int(length))):
                p, q = (x[mine[lo : lo + max(1, STEP_WORDS // int(length))]] for x in (a, b))
                d = np.bitwise_count(matrix[p] ^ matrix[q]).sum(axis=1, dtype=np.int64)
                good = d <= (n[p] + n[q]) // 7
                left.append(p[good])
                right.append(q[good])
                bits.append(d[good])
    if not left:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b, d = (np.concatenate(x) for x in (left, right, bits))
    if best and len(a):
        lo, hi = np.minimum(component[a], component[b]), np.maximum(component[a], component[b])
        by = np.lexsort((ids[b], ids[a], d, hi, lo))
        first = np.concatenate([[True], (lo[by][1:] != lo[by][:-1]) | (hi[by][1:] != hi[by][:-1])])
        a, b = a[by[first]], b[by[first]]
    return order[a], order[b]


def pairs_of_groups(rows: DataFrame, described_: DataFrame, best: bool) -> DataFrame:
    """Likely pairs (a, b) across the components of groups: rows (key, doc_id, n, role, size, component).

    Groups of up to BLOCK members share blocks of about that many. In a larger one, the members
    of the largest component are met by all others, the others also by each
    other, in blocks of about that many.
    """
    rows_ = rows.count()
    sizes = rows.where(F.col("size") > BLOCK).groupBy("key", "component").count()
    main = sizes.groupBy("key").agg(F.max_by("component", F.struct("count", "component")).alias("main"), F.max("count").alias("most"))
    rows = rows.join(described_.select("doc_id", F.col("n_shingles").cast("int").alias("n"), "sketch"), ["doc_id", "n"])
    rows = rows.join(hinted(kept(main, "jaccard-main")), "key", "left")
    cut = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    inside = F.col("component") == F.col("main")
    left, right = cut(F.col("most")), cut(F.col("size") - F.col("most"))
    own = F.pmod(F.xxhash64("doc_id"), F.when(inside, left).otherwise(right)).cast("int")
    blocks = lambda n: F.sequence(F.lit(0), n - 1)
    place = lambda kind, i, j: F.struct(F.lit(kind).alias("kind"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    shared = max(1, rows_ // BLOCK)
    bucket = F.pmod(F.xxhash64("key"), F.lit(shared))
    cells = F.when(F.col("main").isNull(), F.array(place(2, bucket, F.lit(0)))).when(inside, F.transform(blocks(right), lambda j: place(0, F.col("own"), j))).otherwise(F.concat(
        F.transform(blocks(left), lambda i: place(0, i, F.col("own"))), F.transform(blocks(right), lambda j: place(1, F.least(F.col("own"), j), F.greatest(F.col("own"), j)))))
    rows = rows.withColumn("own", own).withColumn("cell", F.explode(cells)).withColumn("block", F.when(F.col("cell.kind") < 2, F.col("key")).otherwise(0)).select("block", "key", "cell.kind", "cell.i", "cell.j", "doc_id", "n", "role", "component", "sketch")

    def cross(pdf):
        import pandas as pd

        ids = pdf["doc_id"].to_numpy(np.int64)
        a, b = crossing(pdf["key"].to_numpy(np.int64), ids, pdf["n"].to_numpy(np.int64), pdf["component"].to_numpy(np.int64), pdf["role"].to_numpy(np.int64), pdf["sketch"].tolist(), best)
        return pd.DataFrame({"a": np.minimum(ids[a], ids[b]), "b": np.maximum(ids[a], ids[b])})

    return rows.groupBy("block", "kind", "i", "j").applyInPandas(cross, "a long, b long").distinct()


def apart(pairs: DataFrame, joined: DataFrame) -> DataFrame:
    """Those of ``pairs`` whose two are in different components of ``joined`` (node, component)."""
    to = lambda x: joined.select(F.col("node").alias(x), F.col("component").alias(f"c{x}"))
    both = pairs.join(hinted(to("a")), "a", "left").join(hinted(to("b")), "b", "left")
    return both.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).drop("ca", "cb")


def similar_components(docs: DataFrame, described_: DataFrame, counted: DataFrame | None = None) -> DataFrame:
    """doc_id and component of the documents that have a link or an equal; ``described_`` is from described(), kept, and ``counted`` from counted_cells()."""
    same = described_.where(F.col("h1").isNotNull() & F.col("doc_id").isNotNull())
    classes = kept(same.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows")).where("rows > 1"), "jaccard-classes")
    copies = same.select("doc_id", "h1", "h2").join(hinted(classes), ["h1", "h2"]).select("rep", "doc_id")

    common = common_shingles(docs, described_, counted=counted)
    rows = filed(docs, common).join(hinted(classes), ["h1", "h2"], "left").where(F.col("rep").isNull() | (F.col("rep") == F.col("doc_id")))
    rows = rows.select("doc_id", "n", F.explode(F.when(F.col("short"), F.concat("keys", F.array(F.lit(0).cast("long")))).otherwise(F.col("keys"))).alias("key"))
    rows = rows.select(F.shiftrightunsigned("key", 4).alias("key"), "doc_id", "n", F.col("key").bitwiseAND(F.lit(15)).cast("int").alias("role"))
    group = kept(neighbours(rows), "jaccard-groups")
    short, group = group.where(F.col("role") == 0).select("doc_id"), group.where(F.col("role") != 0)

    pairs = group.select("doc_id", F.explode(F.array_compact(F.array("before", "least"))).alias("other"))
    pairs = pairs.select(F.least("doc_id", "other").alias("a"), F.greatest("doc_id", "other").alias("b")).distinct()
    tried = likely(pairs, described_, "jaccard-likely")
    links = verified(nearest(tried), docs, "jaccard-nearest")
    joined = kept(components(links), "jaccard-components")

    def more(links: DataFrame, pairs: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        """Links and components after ``pairs`` are verified as well."""
        links = kept(links.unionByName(verified(pairs, docs, name)), f"{name}-all")
        return links, kept(components(links), "jaccard-components")

    rest = kept(apart(tried.select("a", "b"), joined), "jaccard-rest")
    if not rest.isEmpty():
        links, joined = more(links, rest, "jaccard-rest")
    # Groups of two have been tried; in larger ones that somebody asks for, what the links so far leave apart.
    third = group.select("key", "doc_id", "n", "role")
    has = lambda *bits: F.col("roles").bitwiseAND(F.lit(sum(bits))) == sum(bits)
    for best in (True, False):
        rows = third.join(hinted(joined), third["doc_id"] == joined["node"], "left").select("key", "doc_id", "n", "role", F.coalesce("component", "doc_id").alias("component"))
        several = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count("*").alias("size"), F.bit_or("role").alias("roles"))
        several = several.where((F.col("lo") != F.col("hi")) & (F.col("size") > 2) & (has(ASKS, WHOLE) | has(ASKS_DELETIONS, DELETION))).select("key", "size")
        third = kept(rows.join(several, "key"), "jaccard-apart")
        new = kept(pairs_of_groups(third, described_, best).join(tried.select("a", "b"), ["a", "b"], "left_anti"), "jaccard-more")
        if not new.isEmpty():
            links, joined = more(links, new, "jaccard-more")
            tried = tried.select("a", "b").unionByName(new)
        third = third.select("key", "doc_id", "n", "role")
    held = pairs_of_short(short, described_)
    if held is not None:
        for some in (nearest, lambda pairs: pairs.select("a", "b")):
            left = kept(apart(held, joined), "jaccard-short-apart")
            if not left.isEmpty():
                links, joined = more(links, some(left), "jaccard-short")
    links = links.unionByName(copies.select(F.col("rep").alias("a"), F.col("doc_id").alias("b")))
    return components(links).select(F.col("node").alias("doc_id"), "component")


def clustered(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document.

    ``docs`` has doc_id and text. component_id is the smallest doc_id reachable
    by links, the document's own if there are none. Texts that are null or have
    no word have an empty set and link with nothing. Repeated ids are one
    document with all their texts' links; a null id links with nothing and has a
    null component. An empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    info, counted = described_and_counted(docs, "jaccard-described")
    found = kept(similar_components(docs, info, counted), "jaccard-found")
    out = info.select("doc_id", "n_shingles").join(found, "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` less every document that isn't the smallest of its component; rows with a null id stay."""
    found = clustered(docs.select("doc_id", "text"))
    gone = found.where(F.col("component_id") != F.col("doc_id")).select("doc_id").distinct()
    return docs.join(hinted(kept(gone, "jaccard-gone")), "doc_id", "left_anti").select(*docs.columns)


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document's set size and component at a similarity of 0.75."""
    return clustered(table(spark, sf_dir, "documents").select("doc_id", "text"))


#: The same by brute force: all pairs that share a shingle, then everything reachable.
OP9_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
lists AS (
  SELECT doc_id, CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words),
sets AS (SELECT DISTINCT doc_id, md5_number(unnest(s)) AS e FROM lists),
sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sets a JOIN sets b ON a.e = b.e AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 75 * (p.n + q.n - c)),
sides AS (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach AS (SELECT x AS doc_id, y AS other FROM sides UNION SELECT r.doc_id, b.y FROM reach r JOIN sides b ON r.other = b.x)
SELECT l.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(LEAST(l.doc_id, m), l.doc_id) AS component_id
FROM lists l LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS m FROM reach GROUP BY 1) USING (doc_id)
"""
