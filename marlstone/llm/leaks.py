"""Evaluation passages inside training text, found by spaced seeds."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.prefilter import likely_in
from marlstone.session import cut_lineage
from marlstone.tables import table

SHARE, EDITS = 3, 10  # more than 1/SHARE of the own words, at most one edit in EDITS words
#: Word positions that a seed compares; the gaps between them may hold changed words. The
#: mask of an item is that of the first bound that its shortest passage reaches, in words.
#: Each passage of the item then holds a seed whole: of a stretch with at most one edit in
#: ten words some run of six is free of edits, of five where the stretch has ten or eleven
#: words, and shorter ones have no edit at all.
MASKS = ((12, (0, 1, 3, 4, 5)), (5, (0, 1, 2, 3, 4)), (4, (0, 1, 2, 3)), (3, (0, 1, 2)), (2, (0, 1)), (1, (0,)))
#: A leading sentence that this many different items open with is an instruction, not their own.
SHARED_BY = 3
#: Seeds of the items up to which they are broadcast (16 bytes each); beyond, they are shuffled.
BROADCAST_SEEDS = 2_000_000
_NO_WORD = re.compile(r"</?[A-Za-z][^>]{0,200}>|&[a-z]{2,8};|&#\d{1,6};|[\u00ad\u200b-\u200f\u2060\ufeff]")
_WORD = re.compile(r"[^\W_]+")
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], dtype=np.uint64)
_codes: dict[str, int] = {}


def passage_words(text: str | None) -> list[str]:
    """Lower-case words of a text without tags, entities and any other mark."""
    return _WORD.findall(_NO_WORD.sub(" ", text).lower()) if text else []


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_column(text: pd.Series) -> pd.Series:
    return text.map(passage_words)


def shortest_passage(n: int) -> int:
    """Words of the shortest passage of an item of n words."""
    return n // SHARE + 1


def least_seeds(n: int) -> int:
    """Seeds that any passage of an item of n words holds: an edit spoils as many as its mask spans."""
    shortest = shortest_passage(n)
    span = _mask(shortest)[-1] + 1
    # Beyond 3 * EDITS words more, the number only grows.
    return max(1, min(length - span + 1 - span * (length // EDITS) for length in range(shortest, shortest + 3 * EDITS)))


def _mask(shortest: int) -> tuple[int, ...]:
    return next(mask for bound, mask in MASKS if shortest >= bound)


def own_words(items: DataFrame, shared_by: int = SHARED_BY) -> DataFrame:
    """item_id, own: words of each item after the sentences that many different items open with.

    Of an item that consists of such sentences the last is its own. Items with a null or
    empty text, or no word, are left out; they match nothing. Repeated item_ids stand for
    themselves and are matched one by one, and equal texts count as one.
    """
    texts = items.where("text IS NOT NULL").select("text").distinct()
    cut = texts.select("text", F.filter(F.split("text", r"(?<=[.?!])\s+|\n+"), lambda s: F.trim(s) != "").alias("sentences")).where("size(sentences) > 0")
    cut = cut.withColumn("lead", F.expr("transform(sequence(1, size(sentences)), k -> xxhash64(array_join(slice(sentences, 1, k), ' ')))"))
    # How many items open with the same first k sentences, for each k.
    counts = cut.select(F.explode("lead").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= shared_by)
    opens = cut.select("text", F.size("sentences").alias("all"), F.posexplode("lead").alias("k", "h")).where("k + 1 < all").join(counts, "h").groupBy("text").agg((F.max("k") + 1).alias("skip"))
    rest = F.expr("array_join(slice(sentences, coalesce(skip, 0) + 1, size(sentences)), ' ')")
    own = cut.join(opens, "text", "left").select("text", words_column(rest).alias("own")).where("size(own) > 0")
    return items.join(own, "text").select("item_id", "own")


def seed_codes(codes: np.ndarray, mask: tuple[int, ...]) -> np.ndarray:
    """A 64-bit code of the masked words at each place where the mask fits."""
    m = max(0, len(codes) - mask[-1])
    out = np.full(m, len(mask) + mask[-1], np.uint64)
    for j, k in enumerate(mask):
        out += codes[k : k + m] * _MIX[j]
    out ^= out >> np.uint64(29)
    out *= _MIX[-1]
    return (out ^ (out >> np.uint64(32))).view(np.int64)


def word_codes(words: list[str]) -> np.ndarray:
    """32-bit codes of words, remembered per task."""
    if len(_codes) > 400_000:
        _codes.clear()
    out = []
    for w in words:
        code = _codes.get(w)
        if code is None:
            code = _codes[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        out.append(code)
    return np.array(out, np.uint64)


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("seed", T.LongType()), T.StructField("times", T.IntegerType())])))
def item_seeds(own: pd.Series) -> pd.Series:
    """The seeds of an item's own words, and at how many of its places each stands."""
    out = []
    for words in own:
        seeds, times = np.unique(seed_codes(word_codes(list(words)), _mask(shortest_passage(len(words)))), return_counts=True)
        out.append([{"seed": int(s), "times": int(t)} for s, t in zip(seeds, times)])
    return pd.Series(out)


def text_seeds(docs: DataFrame, masks: list[tuple[int, ...]], wanted: np.ndarray | None) -> DataFrame:
    """doc_id, seed, lo, hi: the seeds of each text, with their first and last place.

    Every place of every text has its seeds. With `wanted`, a sorted array, only those
    among it are given, which spares the others the way to the join.
    """
    shared = docs.sparkSession.sparkContext.broadcast(wanted)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for batch in batches:
            at, found, lows, highs = [], [np.array([], np.int64)], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                codes = word_codes(passage_words(text))
                for mask in masks:
                    seeds = seed_codes(codes, mask)
                    if not len(seeds):
                        continue
                    places = np.arange(len(seeds))
                    if wanted is not None:
                        places = np.flatnonzero(wanted[np.minimum(np.searchsorted(wanted, seeds), len(wanted) - 1)] == seeds) if len(wanted) else places[:0]
                    if len(places):
                        unique, first = np.unique(seeds[places], return_index=True)
                        last = len(places) - 1 - np.unique(seeds[places][::-1], return_index=True)[1]
                        at += [i] * len(unique)
                        found.append(unique)
                        lows += places[first].tolist()
                        highs += places[last].tolist()
            ids = batch.column(0).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.concatenate(found)), pa.array(lows, pa.int32()), pa.array(highs, pa.int32())], names=["doc_id", "seed", "lo", "hi"])

    return docs.select("doc_id", "text").where("text IS NOT NULL").mapInArrow(run, f"doc_id {kind}, seed long, lo int, hi int")


def _runs(doc: list, own: list) -> list[tuple[int, int, int]]:
    """Maximal runs of three words or more that stand alike in both: (own at, doc at, length)."""
    places = defaultdict(list)
    for i in range(len(own) - 2):
        places[own[i], own[i + 1], own[i + 2]].append(i)
    runs, open_ = [], {}
    for j in range(len(doc) - 2):
        for i in places.get((doc[j], doc[j + 1], doc[j + 2]), ()):
            key = j - i
            run = open_.get(key)
            if run is not None and run[1] + run[2] - 2 == j:
                run[2] += 1
            else:
                open_[key] = run = [i, j, 3]
                runs.append(run)
    return sorted(map(tuple, runs))


def holds_passage(doc: list, own: list) -> bool:
    """Whether doc holds a stretch of more than 1/SHARE of own with at most 1/EDITS edits.

    A shared run of that length, or chains of shared runs, decide most pairs at once.
    Chains count clean words between close edits as edits, so what they reject is held
    against the exact edit distance.
    """
    return _verbatim(doc, own) or len(own) >= EDITS and (_chained(doc, own) or _edited(doc, own))


def _verbatim(doc: list, own: list) -> bool:
    """Whether the shortest passage stands in doc without an edit."""
    k = shortest_passage(len(own))
    grams = set(zip(*(own[i : len(own) - k + 1 + i] for i in range(k))))
    return any(g in grams for g in zip(*(doc[i : len(doc) - k + 1 + i] for i in range(k))))


def _edited(doc: list, own: list) -> bool:
    """The exact answer of holds_passage for stretches with an edit, by pieces of doc.

    A stretch spans fewer words of doc than `reach`, so it lies within one of the pieces.
    """
    if len(own) < EDITS:  # no stretch may have an edit
        return False
    codes: dict[str, int] = {}
    mine = np.array([codes.setdefault(w, len(codes)) for w in own])
    theirs = np.array([codes.get(w, -1) for w in doc])
    reach = len(own) + len(own) // EDITS + 1
    return any(_stretch(theirs[s : s + 2 * reach], mine) for s in range(0, max(1, len(doc) - reach), reach))


def _stretch(doc: np.ndarray, own: np.ndarray) -> bool:
    """Whether own words from some start to some end stand in doc, by edit distance.

    The first and the last word of a stretch stand alike in both. Only starts and ends are tried whose words, pairs and triples are not too often
    missing in doc: an edit spoils one word, two pairs and three triples at most.
    """
    n, m = len(own), len(doc)
    a, b = np.arange(n)[:, None], np.arange(n + 1)[None, :]
    length = b - a
    allowed = length // EDITS
    fits = length * SHARE > n
    for q in (1, 2, 3):
        held = set(zip(*(doc[k : m - q + 1 + k].tolist() for k in range(q))))
        missing = [g not in held for g in zip(*(own[k : n - q + 1 + k].tolist() for k in range(q)))]
        sums = np.concatenate([[0], np.cumsum(missing)])
        fits &= sums[np.clip(b - q + 1, 0, len(sums) - 1)] - sums[np.minimum(a, len(sums) - 1)] <= q * allowed
    starts = np.flatnonzero(fits.any(axis=1))
    if not len(starts):
        return False
    at = np.arange(m + 1)
    edits = np.full((len(starts), m + 1), n + m)  # of own from the start to here, ending at each place of doc
    for i in range(starts[0], np.flatnonzero(fits.any(axis=0))[-1]):
        same = doc == own[i]
        k = np.searchsorted(starts, i)
        if (fits[starts[:k], i + 1] & (edits[:k, :-1][:, same].min(axis=1, initial=n + m) <= allowed[starts[:k], i + 1])).any():
            return True
        new = edits[: k + 1] + 1
        new[:, 1:] = np.minimum(new[:, 1:], edits[: k + 1, :-1] + ~same)
        if k < len(starts) and starts[k] == i:
            new[k] = np.concatenate([[n + m], np.where(same, 0, n + m)])
        edits[: k + 1] = np.minimum.accumulate(new - at, axis=1) + at
    return False


def _chained(doc: list, own: list) -> bool:
    """holds_passage by the runs that both share, chained in order.

    The words between two chained runs are edits, as many as the longer gap has. All
    chains are compared, by their fewest edits.
    """
    runs = _runs(doc, own)
    enough = len(own) / SHARE
    for s, (i0, j0, n0) in enumerate(runs):
        fewest = {s: 0}
        if n0 > enough:
            return True
        for c in range(s + 1, len(runs)):
            i, j, n = runs[c]
            best = None
            for p, edits in fewest.items():
                pi, pj, pn = runs[p]
                lap = max(0, pi + pn - i, pj + pn - j)
                if lap >= n or i <= pi or j <= pj:
                    continue
                gap = max(i + lap - pi - pn, j + lap - pj - pn)
                if best is None or edits + gap < best:
                    best = edits + gap
            if best is not None and best * EDITS <= len(own):
                fewest[c] = best
                length = i + n - i0
                if length > enough and best * EDITS <= length:
                    return True
    return False


@F.pandas_udf(T.BooleanType())
def verified(doc: pd.Series, start: pd.Series, length: pd.Series, own: pd.Series) -> pd.Series:
    """holds_passage of the words of each text from a place on, as many as the length says."""
    return pd.Series([holds_passage(passage_words(d)[s : s + n], list(o)) for d, s, n, o in zip(doc, start, length, own)], dtype=bool)


@F.udf(T.IntegerType(), useArrow=True)
def _least_seeds(n: int) -> int:
    return least_seeds(n)


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id: documents that hold a passage of an item, in whole or in part.

    Test and training seeds are joined on their hashes; pairs with fewer common seeds than
    any passage of the item holds are left out, and the texts around the hits of the
    others are verified with tolerance for substituted, added and missing words. Null and
    empty texts hold nothing; of repeated doc_ids the pair comes once.
    """
    own = own_words(items).withColumn("n_own", F.size("own"))
    own = cut_lineage(own.withColumn("least", _least_seeds("n_own")), "own-words")
    wanted = own.select("item_id", "n_own", "least", F.inline(item_seeds("own")).alias("seed", "times"))
    wanted = cut_lineage(wanted.distinct(), "item-seeds")
    bounds = [0, *(b for b, _ in MASKS[:-1][::-1])]
    used = own.select(F.array_max(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= F.floor(F.col("n_own") / SHARE) + 1)).alias("b")).distinct()
    masks = [_mask(max(1, r[0])) for r in used.collect()]  # as many as MASKS at most
    few = wanted.count() <= BROADCAST_SEEDS
    sought = np.unique(np.array([r[0] for r in wanted.select("seed").distinct().collect()], np.int64)) if few else None
    hits = text_seeds(docs, masks, sought).join(F.broadcast(wanted) if few else wanted, "seed")
    pairs = hits.groupBy("doc_id", "item_id").agg(
        F.sum("times").alias("n_seeds"), F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.max("n_own").alias("n_own"), F.min("least").alias("least")
    )
    pairs = cut_lineage(pairs.where("n_seeds >= least").drop("n_seeds", "least"), "seed-hits")
    texts = likely_in(docs.select("doc_id", "text"), pairs, "doc_id")
    # The passage around a hit starts at most the item's length before it, plus its edits.
    reach = (F.col("n_own") * 1.2).cast("int")
    start = F.greatest(F.lit(0), F.col("lo") - reach - 8)
    near = pairs.withColumn("start", start).withColumn("length", F.col("hi") - F.col("start") + reach + 16).join(texts, "doc_id")
    both = near.drop("n_own").join(F.broadcast(own) if few else own, "item_id")
    return both.where(verified("text", "start", "length", "own")).select("doc_id", "item_id").distinct()


def p7_found(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, item_id of every leaked passage."""
    return leaks(table(spark, base, "documents").select("doc_id", "text"), table(spark, base, "eval_items").select("item_id", "text"))


def p7_leaked_items(spark: SparkSession, base: str) -> DataFrame:
    """Leaked items with the number of documents that hold a passage of them."""
    items = table(spark, base, "eval_items").select("item_id", "suite", "split_name")
    return p7_found(spark, base).groupBy("item_id").agg(F.count("*").alias("n_docs")).join(items, "item_id").select("item_id", "suite", "split_name", "n_docs")


QUERIES = {"p7_found": p7_found, "p7_leaked_items": p7_leaked_items}
ORACLES: dict[str, str] = {}
