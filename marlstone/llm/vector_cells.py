"""New batches deduplicated against all history: an inverted file of message vectors.

A message is the vector of its words. Its cells are triples of words, in the order of the
text, chosen so that two messages that are the same always share one (see signatures()):

* Words are put in one order for all messages, rare ones first. Of two messages that are
  the same at least `c` words stand in both in the same order, `c` being four fifths of the
  longer one's. So of the first `n - c + k` words of either, in that order, the first `k` of
  the common ones are among both.
* These words are dealt into `g` groups by a hash of the word, and `k` is `2 g + 1`. So three
  of the common ones lie in one group. Every three words of a group are a cell.

Nothing depends on how rare words are in truth: that only makes the cells small. An entry of
a cell holds the length of the message and a sketch of its words, which bound its distance
from any other; what they allow is compared exactly.

Only accepted messages stay, so a group of copies counts once. The manifest of the folder
names what has been appended. As no pair is missed, one append of many batches gives the
rows of as many appends of one batch.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from functools import cache, cached_property
from itertools import chain, combinations, groupby, pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.llm.message_text import message_words
from marlstone.operators.prefilter import likely_in, without
from marlstone.session import Scratch, file_system

LEAST_WORDS = 8
SAME = 0.8
#: Rows of the first call on which frequent words are fitted, about this many at most. A word
#: in more than LEAST_FREQUENT of them is frequent; so the words of these rows bound their number.
FIT_ROWS, LEAST_FREQUENT = 20_000, 10
#: Words of a segment, for messages of fewer words than the bound. Segments only tell copies
#: apart in fit_frequent(); cells_of() and CROWDED remain for callers of the earlier index.
SEGMENTS = ((16, 2), (40, 3), (1 << 31, 4))
CROWDED = 16
#: Groups of the words of a message, as a share of its words; and from how many words on the
#: triples of a group are listed one after the other.
GROUPS, LARGE_GROUP = 0.12, 12
#: Longs of a sketch, and the share of messages with the most frequent word from which on a
#: word is too frequent to tell messages apart, and is no part of sketches.
SKETCH, TELLING = 4, 1 / 4
#: Entries of a message, about, and of a bucket, which a task holds at once; pairs compared at
#: once. Entries from which on a cell is compared in blocks of rows and columns, and the size of
#: these.
ENTRIES, CHUNK_ROWS, CHUNK_PAIRS = 22, 200_000, 2_000_000
LARGE_CELL, BLOCK = 32, (64, 2048)
#: Matches that one task goes through in order, at most.
AT_ONCE = 1_000_000
_SKETCHES = [f"s{i}" for i in range(SKETCH)]
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)


class _Codes(dict):
    """32-bit codes of words, remembered per task."""

    def __missing__(self, word: str) -> int:
        if len(self) > 400_000:
            self.clear()
        code = self[word] = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return code


_known = _Codes()


def word_code(word: str) -> int:
    """A 32-bit code of a word."""
    return _known[word]


def segment_words(n: int) -> int:
    """Words of the segments of a message of n words."""
    return next(k for bound, k in SEGMENTS if n < bound)


def run_codes(codes: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit code of each run of k words."""
    m = max(0, len(codes) - k + 1)
    out = np.full(m, k, np.uint64)
    for j in range(k):
        out += codes[j : j + m] * _MIX[j]
    out ^= out >> np.uint64(29)
    out *= _MIX[k - 1]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def seen(runs: np.ndarray, frequent: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """How often each run is among the frequent ones: their sorted codes, and their counts."""
    keys, counts = frequent
    if not len(keys):
        return np.zeros(len(runs), np.int64)
    at = np.minimum(np.searchsorted(keys, runs), len(keys) - 1)
    return np.where(keys[at] == runs, counts[at], 0)


def cells_of(runs: np.ndarray, cost: np.ndarray, n: int) -> np.ndarray:
    """The rarest segments of a message of n words, of the best place to begin. Not of use for all repeats: see signatures()."""
    k, need = segment_words(n), n // 5 + 1
    if not cost[::k][:need].any():
        return np.unique(runs[::k][:need])
    best = None
    for start in range(k):
        places = np.arange(start, len(runs), k)
        order = places[np.argsort(cost[places], kind="stable")][:need]
        rank = (-len(order), int(cost[order].sum()))
        if best is None or rank < best[0]:
            best = (rank, order)
    order = best[1]
    return np.unique(runs[order[(cost[order] == 0) | (np.arange(len(order)) <= n // 10)]])


def probed_sizes(n: int) -> set[int]:
    """Words of the segments of the messages that one of n words may match."""
    return {segment_words(m) for m in (-(-n * 4 // 5), n, n * 5 // 4)}


def _bits(codes: np.ndarray, of: np.ndarray, messages: int) -> np.ndarray:
    """Per message SKETCH signed numbers, whose bits are set at a hash of each of its words."""
    bits = np.zeros((messages, 64 * SKETCH), np.uint8)
    bits[of, ((codes * _MIX[1] >> np.uint64(32)) * np.uint64(64 * SKETCH) >> np.uint64(32)).view(np.int64)] = 1
    return np.packbits(bits, axis=1, bitorder="little").view(np.int64)


def sketch_of(codes: np.ndarray) -> np.ndarray:
    """The sketch of one message: a word that it lacks of another's spoils one bit at most."""
    return _bits(codes, np.zeros(len(codes), np.int64), 1)[0]


class _Batch:
    """The runs of a batch of messages, all at once: a run begins at each word of the batch."""

    def __init__(self, texts: list[list[str]]) -> None:
        self.ends = np.cumsum([0, *map(len, texts)])
        self.codes = np.fromiter(map(_known.__getitem__, chain.from_iterable(texts)), np.uint64, int(self.ends[-1]))

    @cached_property
    def runs(self) -> dict[int, np.ndarray]:
        return {k: run_codes(self.codes, k) for _, k in SEGMENTS}

    @cached_property
    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """The different codes, and the number of each word's code among them."""
        return np.unique(self.codes, return_inverse=True)

    def __iter__(self) -> Iterator[tuple[int, int]]:
        return zip(self.ends[:-1].tolist(), self.ends[1:].tolist())

    def probes(self, start: int, end: int) -> np.ndarray:
        """The runs of a message that may be a segment of a message that it matches."""
        return np.concatenate([self.runs[k][start : end - k + 1] for k in probed_sizes(end - start)])


def common_subsequence(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence of two word lists, by rows of bits."""
    places: dict[str, int] = {}
    for i, word in enumerate(a):
        places[word] = places.get(word, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row = full
    for word in b:
        both = row & places.get(word, 0)
        row = ((row + both) | (row - both)) & full
    return len(a) - row.bit_count()


def _likeness(x: str, y: str) -> float:
    left, right = x.split(" "), y.split(" ")
    return common_subsequence(left, right) / max(len(left), len(right))


@F.pandas_udf(T.DoubleType())
def likeness(a: pd.Series, b: pd.Series) -> pd.Series:
    """Share of the longer message's words that stand in the other in the same order."""
    return pd.Series([_likeness(x, y) for x, y in zip(a, b)], dtype="float64")


def parsed(rows: DataFrame) -> DataFrame:
    """b, k, short, h1, h2, n, text of rows (b, k, record_id, body).

    `short` is the key of a message of fewer than LEAST_WORDS words: its record_id and
    body; null, as are the keys of rows without record_id, for longer ones. h1 and h2 are
    128 bits of the words. Rows with a null or blank body are left out.
    """
    names = ["b", "k", "short", "h1", "h2", "n", "text"]
    types = [pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for b, k, record, body in zip(*(batch.column(c).to_pylist() for c in ("b", "k", "record_id", "body"))):
                if not body or body.isspace():
                    continue
                words = message_words(body)
                if len(words) < LEAST_WORDS:
                    if record is None:
                        continue
                    key = xxhash.xxh128_hexdigest(f"{len(record)} {record}{body}".encode("utf-8", "surrogatepass"))
                    row = (b, k, key, None, None, len(words), None)
                else:
                    text = " ".join(words)
                    row = (b, k, None, *struct.unpack("=qq", xxhash.xxh128_digest(text.encode("utf-8", "surrogatepass"))), len(words), text)
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=names)

    return rows.select("b", "k", "record_id", "body").mapInArrow(run, "b int, k long, short string, h1 long, h2 long, n int, text string")


def groups_of(n: np.ndarray) -> np.ndarray:
    """Groups of the words of a pair whose longer message has n words: a power of two."""
    return (1 << np.round(np.log2(np.maximum(1, n * GROUPS))).astype(np.int64)).astype(np.int64)


def _hash(*parts: np.ndarray) -> np.ndarray:
    out = np.zeros(len(parts[0]), np.uint64)
    for part, mix in zip(parts, _MIX):
        out = (out + part.astype(np.uint64)) * mix
        out ^= out >> np.uint64(31)
    return out


def _triples(words: list[int]) -> set[tuple[int, ...]]:
    """The different triples of words in their order, however often a word is repeated."""
    found: list[set[tuple[int, ...]]] = [{()}, set(), set(), set()]
    for word in words:
        for size in (2, 1, 0):
            found[size + 1] |= {(*t, word) for t in found[size]}
    return found[3]


@cache
def _chosen(size: int) -> np.ndarray:
    """Three rows: the places of each three of so many things."""
    return np.array(list(combinations(range(size), 3))).T


def _order(major: np.ndarray, minor: np.ndarray) -> np.ndarray:
    """The order of rows by two numbers from 0 on, equal ones as they stand; by one sort of whole numbers where they fit one."""
    low, bits = int(minor.max(initial=0)).bit_length(), len(major).bit_length()
    if int(major.max(initial=0)).bit_length() + low + bits > 63:
        return np.lexsort((minor, major))
    return np.sort((major << low | minor) << bits | np.arange(len(major))) & ((1 << bits) - 1)


def signatures(made: _Batch, frequent: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The cells of each message of a batch: its number, the rarest of three words, 24 bits of a hash of all three.

    Each cell of a message comes once, those of one message together, and in them those of
    one rarest word. A message is filed for the number of groups of each partner that it
    may have, as the longer one decides.
    """
    starts, lengths = made.ends[:-1], np.diff(made.ends)
    codes, word = made.words
    of = np.repeat(np.arange(len(lengths)), lengths)
    rarest = np.argsort(seen(codes.view(np.int64), frequent), kind="stable")
    rarity = np.empty_like(rarest)
    rarity[rarest] = np.arange(len(rarest))
    rarity, codes = rarity[word], codes[rarest]  # words are told apart by their place in the order of rarity
    hashes, parts = (_hash(codes) >> np.uint64(20)).astype(np.int64), [codes * mix for mix in _MIX[:3]]
    ranked = _order(of, rarity)
    rank = np.arange(len(word)) - starts[of]  # of is the same in either order
    least, most = groups_of(lengths), groups_of(lengths * 5 // 4)
    bits, low = len(word).bit_length(), len(codes).bit_length()
    cells = [np.zeros(0, np.uint64)]

    def file(message: np.ndarray, three: tuple[np.ndarray, ...], g: int) -> None:
        """Cells as whole numbers: message, place of the rarest word, hash."""
        rest = sum((part[t] for part, t in zip(parts, three)), np.array([g], np.uint64) * _MIX[3])
        rest ^= rest >> np.uint64(29)
        rest *= _MIX[4]
        lead = np.minimum(np.minimum(three[0], three[1]), three[2])
        cells.append(((message << low | lead).view(np.uint64) << np.uint64(24) | rest >> np.uint64(40)).ravel())

    for g in np.unique(np.concatenate([least, most])).tolist():
        taken = lengths - (lengths * 4 + 4) // 5 + 2 * g + 1
        taken[(least != g) & (most != g)] = 0
        places = ranked[rank < taken[of]]
        dealt = np.sort((of[places] * g + (hashes[rarity[places]] & (g - 1))) << bits | places)
        places, run = dealt & ((1 << bits) - 1), dealt >> bits
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]][: len(run)])
        sizes = np.diff(np.r_[first, len(run)])
        for size in np.unique(sizes[sizes >= 3]).tolist():
            begin = first[sizes == size]
            if size <= LARGE_GROUP:
                held = rarity[places[np.arange(size)[:, None] + begin]]
                file(of[places[begin]], tuple(held[at] for at in _chosen(size)), g)
            else:
                listed = [(of[places[b]], *t) for b in begin.tolist() for t in _triples(rarity[places[b : b + size]].tolist())]
                message, *three = np.array(listed, np.int64).T
                file(message, tuple(three), g)
    found = np.sort(np.concatenate(cells))
    found = found[np.r_[True, found[1:] != found[:-1]][: len(found)]]
    lead = (found >> np.uint64(24)).view(np.int64)
    return lead >> low, codes[lead & ((1 << low) - 1)], found & np.uint64(0xFFFFFF)


#: Per rarest word of the cells of a message one row, with all cells of that word.
_ENTRY = pa.schema([("lead", pa.int64()), ("b", pa.int32()), ("k", pa.int64()), ("n", pa.int32()), *((c, pa.int64()) for c in _SKETCHES), ("cells", pa.binary())])


def entries(texts: DataFrame, frequent: tuple[np.ndarray, np.ndarray], buckets: int) -> DataFrame:
    """bucket, entries: the entries of the rows (b, k, n, text), those of a lead in one bucket; many to a row, packed, as Spark moves few large rows for less."""
    shared = texts.sparkSession.sparkContext.broadcast(frequent)
    most = frequent[1].max(initial=0) * TELLING

    def filed(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = _Batch([t.split(" ") for t in batch.column("text").to_pylist()])
        codes, word = made.words
        telling = np.flatnonzero((seen(codes.view(np.int64), shared.value) <= most)[word])
        sketches = _bits(made.codes[telling], np.searchsorted(made.ends, telling, "right") - 1, batch.num_rows)
        message, lead, rest = signatures(made, shared.value)
        first = np.flatnonzero(np.r_[True, (message[1:] != message[:-1]) | (lead[1:] != lead[:-1])][: len(lead)])
        offsets = pa.py_buffer((np.r_[first, len(lead)] * 3).astype(np.int32))
        cells = pa.Array.from_buffers(pa.binary(), len(first), [None, offsets, pa.py_buffer(rest.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes())])
        of = message[first]
        columns = [pa.array(lead[first].astype(np.int64)), *(batch.column(c).take(pa.array(of)) for c in ("b", "k", "n"))]
        return pa.RecordBatch.from_arrays([*columns, *(pa.array(sketches[of, i]) for i in range(SKETCH)), cells], schema=_ENTRY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.concat_batches([filed(batch.slice(begin, 2000)) for begin in range(0, batch.num_rows, 2000)] or [filed(batch)])
            bucket = _hash(made.column("lead").to_numpy()) % np.uint64(buckets)
            order = _order(bucket.astype(np.int64), np.zeros(len(bucket), np.int64))
            numbers, first = np.unique(bucket[order], return_index=True)
            made = made.take(pa.array(order))
            packed = [made.slice(x, y - x).serialize().to_pybytes() for x, y in pairwise([*first.tolist(), len(order)])]
            yield pa.RecordBatch.from_arrays([pa.array(numbers.astype(np.int32)), pa.array(packed, pa.binary())], names=["bucket", "entries"])

    return texts.select("b", "k", "n", "text").mapInArrow(run, "bucket int, entries binary")


def fit_frequent(rows: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """word, n of the words in more than LEAST_FREQUENT messages of a bounded sample.

    Of the sampled messages with an equal smallest run code only one counts, lest copies
    of one message make its words look frequent.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            long = [w for w in map(message_words, batch.column("body").to_pylist()) if len(w) >= LEAST_WORDS]
            made = _Batch(long)
            least = [int(made.probes(start, end).min()) for start, end in made]
            words = [np.unique(made.codes[start:end]).astype(np.int64) for start, end in made]
            yield pa.RecordBatch.from_arrays([pa.array(least, pa.int64()), _lists(words)], names=["least", "words"])

    bodies = rows.where("body IS NOT NULL").select("k", "body")
    share = min(1.0, fit_rows / max(1, bodies.count()))
    sample = bodies.where(F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < int(share * (1 << 20)))
    one = sample.mapInArrow(run, "least long, words array<long>").groupBy("least").agg(F.min("words").alias("words"))
    counts = one.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").cast("int").alias("n"))
    return counts.where(F.col("n") > LEAST_FREQUENT)


def _lists(parts: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*parts, np.array([], np.int64)])))


def _spread(begin: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Each row's number with each number from begin to end, CHUNK_PAIRS or so at a time."""
    sizes = np.maximum(0, end - begin)
    upto = np.cumsum(sizes)
    at = 0
    while at < len(sizes):
        to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CHUNK_PAIRS, "right")))
        own = sizes[at:to]
        x = np.repeat(np.arange(at, to), own)
        yield x, np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + begin[x]
        at = to


def _unique(pairs: list[np.ndarray]) -> np.ndarray:
    """The different columns of these arrays; their first two rows tell them apart."""
    whole = np.concatenate([np.zeros((6, 0), np.int64), *pairs], axis=1)
    whole = whole[:, np.lexsort((whole[1], whole[0]))]
    return whole[:, np.r_[True, (whole[0][1:] != whole[0][:-1]) | (whole[1][1:] != whole[1][:-1])][: whole.shape[1]]]


def _numbers(cells: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """How many cells each row has, and the hashes of all of them."""
    sizes, rest = [], []
    for chunk in cells.chunks:
        at = np.frombuffer(chunk.buffers()[1], np.int32)[chunk.offset : chunk.offset + len(chunk) + 1]
        sizes.append(np.diff(at) // 3)
        rest.append(np.frombuffer(chunk.buffers()[2], np.uint8)[at[0] : at[-1]])
    three = np.concatenate(rest).reshape(-1, 3)
    four = np.zeros((len(three), 4), np.uint8)
    four[:, :3] = three
    return np.concatenate(sizes), four.view("<u4")[:, 0].astype(np.int64)


def _entries(rows: pa.Table, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cell and row of the entries of cells that more than one row has, in the order of cells and in them of n."""
    sizes, rest = _numbers(rows.column("cells"))
    lead = np.unique(rows.column("lead").to_numpy(), return_inverse=True)[1]
    order = _order(lead, n)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    bits = len(order).bit_length()
    if int(lead.max(initial=0)).bit_length() + 24 + bits <= 63:
        packed = np.sort(np.repeat(lead << (24 + bits) | place, sizes) | rest << bits)
        cell, at = packed >> bits, packed & ((1 << bits) - 1)
    else:
        cell, at = np.repeat(lead << 24, sizes) | rest, np.repeat(place, sizes)
        by = np.lexsort((at, cell))
        cell, at = cell[by], at[by]
    same = cell[1:] == cell[:-1]
    more = np.r_[same, [False] * (len(cell) > 0)] | np.r_[[False] * (len(cell) > 0), same]
    return cell[more], order[at[more]]


def met(rows: pa.Table, since: int) -> pa.RecordBatch:
    """kx, bx, ky, by of the pairs (y the earlier one) in these cells that may be the same, one of them of append `since` or later."""
    b, k, n, *sketches = (rows.column(c).to_numpy() for c in ("b", "k", "n", *_SKETCHES))
    sketches, n = [s.view(np.uint64) for s in sketches], n.astype(np.int64)
    cell, row = _entries(rows, n)
    first = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]][: len(cell)])
    held = np.diff(np.r_[first, len(cell)])
    number = np.repeat(np.arange(len(first)), held) << 32
    length = n[row]
    need = (n * 4 + 4) // 5
    late = (b >= since)[row]
    past = not late.all()
    begin = np.searchsorted(number + length, number - (-length * 4 // 5), "left") if past else np.arange(1, len(row) + 1)
    to = np.searchsorted(number + length, number + length * 5 // 4, "right")
    parts, most, least = [s[row] for s in sketches], length.astype(np.int32), need[row].astype(np.int32)
    half, other = parts[: SKETCH // 2], parts[SKETCH // 2 :]
    pairs: list[np.ndarray] = []
    waiting: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def keep(x: np.ndarray, y: np.ndarray) -> None:
        use = (late[x] | late[y]) & ((y > x) | ~late[y])  # two messages of the past need not meet, nor two others twice
        x, y = row[x[use]], row[y[use]]
        for _ in range(2):  # words of x that y lacks, then of y that x lacks
            lost = sum(np.bitwise_count(s[x] & ~s[y]) for s in sketches)
            good = n[x] - lost >= np.maximum(need[x], need[y])
            x, y = y[good], x[good]
        later = (b[x] > b[y]) | (b[x] == b[y]) & (k[x] > k[y])
        x, y = np.where(later, x, y), np.where(later, y, x)
        pairs.append(_unique([np.stack([k[x], k[y], b[x], b[y], n[x], n[y]])]))

    def nearer(x: np.ndarray, y: np.ndarray, lost: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What of these pairs is left by the other half of the sketches; lost: the words by the first one."""
        lost = lost.astype(np.int32) + sum(np.bitwise_count(s[x] & ~s[y]) for s in other)
        good = np.flatnonzero(lost <= most[x] - np.maximum(least[x], least[y]))
        return x[good], y[good]

    # New messages with all that follow in the cell, and with those of the past before them.
    large = np.repeat(held >= LARGE_CELL, held)
    new = np.flatnonzero(late & ~large)
    for x, y in _spread(begin[new], to[new]):
        x = new[x]
        lost = sum(np.bitwise_count(s[x] & ~s[y]) for s in half)
        good = np.flatnonzero(lost <= most[x] - least[y])
        keep(*nearer(x[good], y[good], lost[good]))
    for start, size in zip(first[held >= LARGE_CELL].tolist(), held[held >= LARGE_CELL].tolist()):
        new = np.flatnonzero(late[start : start + size]) + start
        for p in range(0, len(new), BLOCK[0]):
            x = new[p : p + BLOCK[0]]
            end = int(to[x[-1]])
            for q in range(int(begin[x[0]]), end, BLOCK[1]):
                y = slice(q, min(q + BLOCK[1], end))
                limit = (most[x[-1]] - least[y]).clip(0, 255).astype(np.uint8)  # no x of the block may lose more
                lost = np.zeros((len(x), len(limit)), np.uint8)
                for s in half:
                    lost += np.bitwise_count(s[x][:, None] & ~s[y])
                good = np.flatnonzero(lost <= limit)
                u, v = np.divmod(good, len(limit))
                waiting.append(nearer(x[u], v + q, lost.ravel()[good]))
                many += len(waiting[-1][0])
                if many >= CHUNK_PAIRS:
                    keep(*map(np.concatenate, zip(*waiting)))
                    waiting, many = [], 0
    if waiting:
        keep(*map(np.concatenate, zip(*waiting)))
    kx, ky, bx, by, _, _ = _unique(pairs)
    return pa.RecordBatch.from_arrays([pa.array(kx), pa.array(bx.astype(np.int32)), pa.array(ky), pa.array(by.astype(np.int32))], names=["kx", "bx", "ky", "by"])


def candidates(cells: DataFrame, since: int) -> DataFrame:
    """met() of all entries: they come in the order of their buckets, and a bucket is in one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((x, y) for batch in batches for x, y in zip(batch.column("bucket").to_pylist(), batch.column("entries")))
        for _, own in groupby(rows, lambda row: row[0]):
            yield met(pa.Table.from_batches([pa.ipc.read_record_batch(y.as_buffer(), _ENTRY) for _, y in own]), since)

    return cells.mapInArrow(run, "kx long, bx int, ky long, by int")


def one_by_one(matches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k of the rows that taking them in order rejects; the matches are (kx, bx, ky), y before x."""
    kx, bx, ky = (np.concatenate(c) for c in zip(*([c.to_numpy() for c in batch.columns] for batch in matches)))
    order, gone = np.lexsort((kx, bx)), set()
    for x, y in zip(kx[order].tolist(), ky[order].tolist()):
        if y not in gone:
            gone.add(x)
    yield pa.RecordBatch.from_arrays([pa.array(sorted(gone), pa.int64())], names=["k"])


class VectorCells:
    """The persisted index in a shared folder; append() takes one or more batches.

    Opening a folder that holds an index goes on with it. Batches must come in order;
    within a batch rows are ordered by rec_key, which must be unique. An append that fails
    leaves the index as it was, and may be repeated.

    Tables, a partition for each call of append(): accepted (the full vectors, of which the
    cells are made), shorts, found (the result); frequent (the words fitted on the first).
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._fs, self._at = file_system(spark, self.path)
        manifests = self._fs.globStatus(self._at(f"{self.path}/manifest/*.json")) or []
        last = max((s.getPath().getName() for s in manifests), default=None)
        self.manifest = json.loads(spark.read.text(f"{self.path}/manifest/{last}", wholetext=True).first()[0]) if last else {"appends": 0, "parts": []}

    @property
    def appends(self) -> int:
        """Batches appended so far."""
        return self.manifest["appends"]

    def _write(self, df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/{name}/append={self.appends}")
        return self.spark.read.schema(_SCHEMAS[name]).parquet(f"{self.path}/{name}/append={self.appends}")

    def _read(self, name: str) -> DataFrame:
        paths = [f"{self.path}/{name}/append={k}" for k in self.manifest["parts"]]
        return self.spark.read.schema(_SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], _SCHEMAS[name])

    def found(self) -> DataFrame:
        """kept_key, dup_key of all appends so far."""
        return self._read("found")

    def close(self) -> None:
        """End the use of the index; the folder stays, and all that counts is in it."""

    def _commit(self) -> None:
        """Name the next state of the index in a manifest; the one write that makes an append count."""
        self.manifest = self._next
        draft, final = (self._at(f"{self.path}/manifest/{n}") for n in (f"_{uuid.uuid4().hex}", f"{self.appends:09d}.json"))
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(self.manifest).encode()))
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError(f"another writer made append {self.appends}")

    def append(self, batches: DataFrame) -> DataFrame:
        """kept_key, dup_key of the rows of these batches that repeat an accepted row.

        Null rec_keys are left out, a null batch_id counts as 0; several batches count as
        appended one after the other. A row is rejected if it repeats an accepted row that
        comes before it: of several the nearest, of equally near ones the first.
        """
        rows = batches.where("rec_key IS NOT NULL").select(F.coalesce("batch_id", F.lit(0)).alias("number"), F.col("rec_key").alias("k"), "record_id", "body")
        numbers = sorted(r[0] for r in rows.select("number").distinct().collect())  # one row per batch
        if not numbers:
            return self.spark.createDataFrame([], _SCHEMAS["found"])
        places = self.spark.createDataFrame([(n, self.appends + i) for i, n in enumerate(numbers)], "number int, b int")
        return self._append(rows.join(F.broadcast(places), "number"), len(numbers))

    def _append(self, rows: DataFrame, batches: int) -> DataFrame:
        for name in _SCHEMAS:  # what a failed append left
            self._fs.delete(self._at(f"{self.path}/{name}/append={self.appends}"), True)
        if not self.appends:
            self._write(fit_frequent(rows), "frequent")
        frequent = self.spark.read.schema(_SCHEMAS["frequent"]).parquet(f"{self.path}/frequent/append=0").toPandas().sort_values("word")  # bounded, see fit_frequent()
        arrays = (frequent["word"].to_numpy(np.int64), frequent["n"].to_numpy(np.int64))
        first = F.min(F.struct("b", "k")).alias("first")
        with Scratch(self.spark, "append") as scratch:
            parts = scratch.cut(parsed(rows))
            long = parts.where("h1 IS NOT NULL")
            # Rows of the same words are one node, at the place of the first of them.
            slim = long.select("b", "k", "h1", "h2")
            firsts = slim.groupBy("h1", "h2").agg(first)
            named = scratch.cut(slim.join(firsts.select("h1", "h2", F.col("first.k").alias("x")), ["h1", "h2"]).select("b", "k", "x"))
            short = self._short_copies(parts, scratch)
            nodes = scratch.cut(without(long, named.where("k != x").select("k"), "k").select("b", "k", "n", "text"))
            scratch.drop(parts)
            edges = self._edges(nodes, arrays, scratch)
            gone = scratch.cut(self._rejected(edges, scratch))

            # The accepted row that is nearest to each row of a rejected node: it comes before the row, not always before the node.
            sides = edges.select(F.col("kx").alias("x"), "like", F.col("by").alias("at"), F.col("ky").alias("y"))
            sides = sides.unionByName(edges.select(F.col("ky").alias("x"), "like", F.col("bx").alias("at"), F.col("kx").alias("y")))
            sides = sides.join(gone.withColumnRenamed("k", "x"), "x", "left_semi").join(gone.withColumnRenamed("k", "y"), "y", "left_anti")
            rank = F.struct(F.round("like", 9).alias("like"), (-F.col("at")).alias("b"), (-F.col("y")).alias("k"))
            hits = named.join(sides, "x").where("at < b OR at = b AND y < k").groupBy("k").agg(F.max(rank).alias("top"))
            near = hits.select((-F.col("top.k")).alias("kept_key"), F.col("k").alias("dup_key"))
            copies = named.where("k != x").join(gone.withColumnRenamed("k", "x"), "x", "left_anti").select(F.col("x").alias("kept_key"), F.col("k").alias("dup_key"))
            found = self._write(copies.unionByName(near).unionByName(short), "found")
            self._write(without(nodes, gone, "k"), "accepted")
        self._next = {"appends": self.appends + batches, "parts": [*self.manifest["parts"], self.appends]}
        self._commit()
        return found

    def _short_copies(self, parts: DataFrame, scratch: Scratch) -> DataFrame:
        """kept_key, dup_key of short messages whose record_id and body an earlier row has."""
        mine = scratch.cut(parts.where("short IS NOT NULL").select("short", "b", "k"))
        firsts = mine.groupBy("short").agg(F.min(F.struct("b", "k")).alias("first")).select("short", F.col("first.k").alias("first"))
        firsts = firsts.join(self._read("shorts"), "short", "left")
        self._write(firsts.where("kept IS NULL").select("short", F.col("first").alias("kept")), "shorts")
        kept = firsts.select("short", F.coalesce("kept", "first").alias("kept_key"))
        return mine.join(kept, "short").where("kept_key != k").select("kept_key", F.col("k").alias("dup_key"))

    def _edges(self, nodes: DataFrame, frequent: tuple[np.ndarray, np.ndarray], scratch: Scratch) -> DataFrame:
        """kx, bx, ky, by, like of the new messages (x) and the earlier ones (y), new or accepted, that are the same."""
        known = nodes.unionByName(self._read("accepted")) if self.appends else nodes
        buckets = max(self.spark.sparkContext.defaultParallelism, -(-known.count() * ENTRIES // CHUNK_ROWS))
        cells = entries(known, frequent, buckets).repartition(buckets, "bucket").sortWithinPartitions("bucket")
        pairs = scratch.cut(candidates(cells, self.appends).distinct())
        scratch.collect()
        named = pairs.select(F.col("kx").alias("k")).unionByName(pairs.select(F.col("ky").alias("k")))
        texts = scratch.cut(likely_in(known.select("k", "text"), named, "k"))
        both = pairs.join(texts.toDF("kx", "text_x"), "kx").join(texts.toDF("ky", "text_y"), "ky")
        return scratch.cut(both.select("kx", "bx", "ky", "by", likeness("text_x", "text_y").alias("like")).where(F.col("like") >= SAME - 1e-9))

    def _rejected(self, edges: DataFrame, scratch: Scratch) -> DataFrame:
        """k: the new messages that are not accepted."""
        if not self.appends:
            return self._in_order(edges, scratch)
        past = edges.where(F.col("by") < self.appends).select(F.col("kx").alias("k")).distinct()
        inner = edges.where(F.col("by") >= self.appends)
        inner = inner.join(past.withColumnRenamed("k", "kx"), "kx", "left_anti").join(past.withColumnRenamed("k", "ky"), "ky", "left_anti")
        return past.unionByName(self._in_order(inner, scratch))

    def _in_order(self, edges: DataFrame, scratch: Scratch) -> DataFrame:
        """k: the rows that taking them one by one rejects.

        A row is accepted when all earlier rows that it matches are rejected, and rejected
        when one of them is accepted. AT_ONCE matches or fewer are gone through in order by
        one task. More of them are lessened by rounds: a round settles every row whose
        earlier matches are settled; there are as many as the longest chain has links.
        """
        rejected = self.spark.createDataFrame([], "k long")
        edges = edges.select("kx", "bx", "ky")
        while (left := edges.count()) > AT_ONCE:
            # Earlier rows that are themselves undecided have matches left.
            undecided = edges.select(F.col("kx").alias("ky")).distinct()
            gone = scratch.cut(edges.join(undecided, "ky", "left_anti").select(F.col("kx").alias("k")).distinct())
            rejected = rejected.unionByName(gone)
            rest = edges.join(gone.withColumnRenamed("k", "kx"), "kx", "left_anti").join(gone.withColumnRenamed("k", "ky"), "ky", "left_anti")
            edges = scratch.cut(rest.select("kx", "bx", "ky"))
        return rejected.unionByName(edges.coalesce(1).mapInArrow(one_by_one, "k long")) if left else rejected


_SCHEMAS = {
    "accepted": "b int, k long, n int, text string",
    "shorts": "short string, kept long",
    "found": "kept_key long, dup_key long",
    "frequent": "word long, n int",
}
