"""Abusive, hateful and sexual language: sentence models learned from document labels."""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.operators.prefilter import likely_in
from marlstone.tables import table

KINDS = ("abusive", "hateful", "sexual")
#: Label rows that the model is fitted on at most: those of smallest hash, so any more are
#: a fixed random sample. It bounds the fitting task and the model, not what is scored.
FIT_ROWS = 20_000
DIMENSIONS = 1 << 18
MIN_DOCS = 3  # features in fewer labelled documents are no evidence
ROUNDS, RATE, DECAY = 150, 0.5, 1e-3
SETTLING, LEAST_WEIGHT = 25, 0.01  # after so many rounds, features without that weight are left out
WRONG = 0.2  # share of labels taken to be wrong, which bounds the pull of any of them
CUTOFF = 0.5
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], dtype=np.uint64)
WINDOW = 16  # words of an instance where a sentence is longer than one and a half of it

# Letters of other scripts and digits or signs that stand for Latin letters.
_LOOKALIKES = str.maketrans("авеёзікмнорстухјѕԁһɡαβεικνορτυχω", "abeeeikmhopctyxjsdhgabeikvoptuxw")
_LEET = str.maketrans("013457@$8", "oieastasb")
_INVISIBLE = re.compile("[­​-‏‪-‮⁠-⁤﻿]")
_SPACED = re.compile(r"(?<![^\W_])(?:[^\W\d_][ .\-_*]){3,}[^\W\d_](?![^\W_])")
_BREAK = re.compile(r"(?<=[.!?])\s+|(?<=[a-z]{2}[.!?])(?=[A-Z][a-z])|(?<=[。！？])|\n+|(?<=[a-z]{3})(?=[A-Z][a-z])|</?[a-zA-Z][^>]*>")
_PREFIX = re.compile(r"^\s*(?:\[[^\]]{0,80}\]:|@\w+:|note:|>|-|#+)\s*")
_TOKEN = re.compile(r"[^\W_]+(?:[#*$@_]+[^\W_]+)*[$@]?|[぀-ヿ一-鿿]")
_MASKED = re.compile(r"^[a-z]{1,4}(?:[#*]+|_{2,})[a-z]+$")
_CJK = re.compile(r"[぀-ヿ一-鿿]")


def _plain_token(token: str) -> list[str]:
    """The words of one lower-case token with disguises undone."""
    if _CJK.search(token):
        return list(token)
    if not token.isascii() and re.search("[a-z]", token):
        token = token.translate(_LOOKALIKES)
    if token.isalpha():
        pass
    elif _MASKED.match(token):
        token = "<masked>"
    elif not token.isdigit() and len(token) > 3 and not re.search(r"[a-z]{3,}\d+$|_", token) or re.fullmatch(r"[0134578@$]{3,4}[a-z0-9@$]*[a-z][a-z0-9@$]*", token):
        token = token.translate(_LEET)
    else:
        token = "<id>"
    token = re.sub(r"([a-z])\1{2,}", r"\1", token)
    return ["you" if token == "u" else token]


_plain: dict[str, list[str]] = {}
_codes: dict[str, int] = {}


def plain_words(sentence: str) -> list[str]:
    """Words of a sentence with disguises undone.

    Compatibility forms, invisible marks, accents, look-alike letters, spelled-out or dotted
    words, digits for letters and drawn-out letters are normalised; a word with masked
    letters becomes '<masked>', other words with digits '<id>'. Tokens are remembered per task.
    """
    text = sentence
    if not text.isascii():
        text = unicodedata.normalize("NFD", _INVISIBLE.sub("", unicodedata.normalize("NFKC", text)))
        text = "".join(c for c in text if not unicodedata.combining(c))
    text = _SPACED.sub(lambda m: re.sub(r"[ .\-_*]", "", m[0]), text.lower())
    if len(_plain) > 400_000:
        _plain.clear()
    words: list[str] = []
    for token in _TOKEN.findall(text):
        got = _plain.get(token)
        if got is None:
            got = _plain[token] = _plain_token(token)
        words += got
    return words


def sentences_of(text: str | None) -> list[str]:
    """Sentences of a text; line prefixes of chats, lists and quotes are left out."""
    if not text:
        return []
    return [s for s in (_PREFIX.sub("", part) for part in _BREAK.split(text) if part) if s.strip()]


def instances(text: str | None) -> list[tuple[str, list[str]]]:
    """The instances of a text: (sentence, words), long sentences in overlapping windows."""
    out = []
    for sentence in sentences_of(text):
        words = plain_words(sentence)
        if len(words) <= WINDOW * 3 // 2:
            out.append((sentence, words))
        else:
            out += [(sentence, words[i : i + WINDOW]) for i in range(0, len(words) - WINDOW // 2, WINDOW // 2)]
    return out


def word_codes(lists: list[list[str]]) -> np.ndarray:
    """32-bit codes of the words of all lists, remembered per task."""
    if len(_codes) > 400_000:
        _codes.clear()
    out = []
    for words in lists:
        for w in words:
            code = _codes.get(w)
            if code is None:
                code = _codes[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
            out.append(code)
    return np.array(out, np.uint64)


def features(lists: list[list[str]], wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(instance, feature) of word lists, each pair once, in order: hashed words, pairs, pairs with one word between.

    wanted: marks the features that are of interest; the others are left out.
    """
    codes = word_codes(lists)
    of = np.repeat(np.arange(len(lists)), [len(words) for words in lists])
    one, two, three, four, five = _MIX
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    near, far = of[1:] == of[:-1], of[2:] == of[:-2]
    grams = [codes * one, (codes[:-1] * two + codes[1:] * three)[near], (codes[:-2] * four + codes[2:] * five)[far]]
    rows = np.concatenate([of, of[:-1][near], of[:-2][far]])
    cols = ((np.concatenate(grams) * one) >> shift).astype(np.int64)
    if wanted is not None:
        rows, cols = rows[wanted[cols]], cols[wanted[cols]]
    pairs = np.unique(rows * DIMENSIONS + cols)
    return pairs // DIMENSIONS, pairs % DIMENSIONS


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _stretches(rows: np.ndarray, cols: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows and columns of a sparse matrix, without columns below 0, and where each begins in the one and the other order."""
    rows, cols = rows[cols >= 0], cols[cols >= 0].astype(np.int32)
    filled, row_at = np.unique(rows, return_index=True)
    order = np.argsort(cols, kind="stable")
    seen, col_at = np.unique(cols[order], return_index=True)
    return rows, cols, filled, row_at, rows[order], seen, col_at


def fit(sizes: list[int], rows: np.ndarray, cols: np.ndarray, targets: list[int]) -> dict[int, list[float]]:
    """Weights per feature (benign and each kind), by multiple-instance learning.

    sizes: instances of each document, at least one; rows and cols: the features of the
    instances, numbered over all documents, by instance. targets: 0 benign, 1..3 the kinds, 4 toxic of an unstated kind. A sentence is one of
    benign and the kinds (softmax); a document holds a kind with the noisy-or of its
    sentences, 1 - prod(1 - p). The log likelihood of the document labels is raised by
    gradient steps with a step size per weight; only document labels are used, so which
    sentences offend is found on the way. Feature -1 is the bias.
    """
    n = sum(sizes)
    starts_a = np.cumsum([0, *sizes[:-1]])
    doc_of = np.repeat(np.arange(len(sizes)), sizes)
    seen = np.unique(doc_of[rows] * DIMENSIONS + cols) % DIMENSIONS
    used = np.flatnonzero(np.bincount(seen, minlength=DIMENSIONS) >= MIN_DOCS)
    index = np.full(DIMENSIONS, -1)
    index[used] = np.arange(len(used))
    rows_a, cols_a, filled, row_at, rows_by_col, seen_cols, col_at = _stretches(rows, index[cols])
    y = np.array(targets)
    w = np.zeros((len(used), 4))
    b = np.array([3.0, 0.0, 0.0, 0.0])
    gw, gb = np.full_like(w, 1e-6), np.full(4, 1e-6)
    toxic = y > 0
    weight = np.sqrt(max(1.0, (~toxic).sum() / max(1, toxic.sum())))  # toxic documents are fewer
    for round_ in range(ROUNDS):
        if round_ == SETTLING:
            kept = np.flatnonzero(np.abs(w).max(axis=1, initial=0) > LEAST_WEIGHT)
            index = np.full(len(w), -1)
            index[kept] = np.arange(len(kept))
            w, gw, used = w[kept], gw[kept], used[kept]
            rows_a, cols_a, filled, row_at, rows_by_col, seen_cols, col_at = _stretches(rows_a, index[cols_a])
        z = np.tile(b, (n, 1))
        for k in range(4 if len(filled) else 0):
            z[filled, k] += np.add.reduceat(w[:, k].astype(np.float32)[cols_a], row_at)
        p = np.clip(_softmax(z), 1e-9, 1 - 1e-9)
        hit = p[np.arange(n), np.where(y[doc_of] == 4, 0, y[doc_of])]
        hit = np.where(y[doc_of] == 4, 1 - hit, hit)  # probability that the sentence is what its document is labelled
        miss = np.clip(1 - hit, 1e-9, 1)
        none = np.exp(np.add.reduceat(np.log(miss), starts_a))
        # Of log((1 - 2 WRONG) * P(label) + WRONG): the derivative by hit, or by the log of all benign.
        sure = 1 - 2 * WRONG
        pull = np.where(toxic, weight * sure * none / (sure * (1 - none) + WRONG), 0.0)[doc_of] / miss
        calm = np.exp(np.add.reduceat(np.log(p[:, 0]), starts_a))
        calm = (sure * calm / (sure * calm + WRONG))[doc_of]
        grad = np.zeros_like(p)
        kind = toxic[doc_of] & (y[doc_of] < 4)
        any_ = y[doc_of] == 4
        at = np.flatnonzero(kind)
        c = y[doc_of][at]
        grad[at] -= (pull[at] * hit[at])[:, None] * p[at]
        grad[at, c] += pull[at] * hit[at]
        at = np.flatnonzero(any_)
        grad[at, 1:] += (pull[at] * p[at, 0])[:, None] * p[at, 1:]
        grad[at, 0] -= pull[at] * p[at, 0] * (1 - p[at, 0])
        at = np.flatnonzero(~toxic[doc_of])  # benign documents: every sentence is benign
        grad[at] -= calm[at, None] * p[at]
        grad[at, 0] += calm[at]
        g = -DECAY * len(sizes) * w
        for k in range(4 if len(filled) else 0):
            g[seen_cols, k] += np.add.reduceat(grad[:, k].astype(np.float32)[rows_by_col], col_at)
        gw += g * g
        w += RATE * g / np.sqrt(gw)
        g = grad.sum(axis=0)
        gb += g * g
        b += 0.1 * RATE * g / np.sqrt(gb)
    model = {int(f): [float(x) for x in w[i]] for i, f in enumerate(used) if np.abs(w[i]).max() > 0.01}
    model[-1] = [float(x) for x in b]
    return model


def noisy_or(p: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Noisy-or of each kind per document: 1 - prod over its sentences of (1 - p)."""
    return 1 - np.exp(np.add.reduceat(np.log(np.clip(1 - p, 1e-9, 1)), starts, axis=0))


def train(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """feature, w: the fitted weights, at most DIMENSIONS + 1 rows.

    Label rows with null toxic or of documents without text teach nothing. Where two
    raters disagree, both rows count. A null or unknown category of a toxic row leaves
    the kind open.
    """
    kind = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("category")), F.lit(0)).cast("int")
    target = F.when(F.col("toxic") == 0, 0).when(kind > 0, kind).otherwise(4)
    rated = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).select("doc_id", target.alias("target"), F.xxhash64("doc_id", F.coalesce("rater", F.lit("")), target).alias("h"))
    rated = rated.orderBy("h").limit(fit_rows)
    texts = docs.select("doc_id", "text").where(F.col("text").isNotNull())
    sample = rated.join(likely_in(texts, rated, "doc_id"), "doc_id")  # only rated texts go through the shuffle

    def bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [[words for _, words in instances(t)] or [[]] for t in batch.column("text").to_pylist()]
            rows, cols, ends = [np.array([], np.int32)], [np.array([], np.int32)], [0]
            for lists in texts:
                r, c = features(lists)
                rows.append(r.astype(np.int32))
                cols.append(c.astype(np.int32))
                ends.append(ends[-1] + len(r))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(x))) for x in (rows, cols)]
            kept = [batch.column(c) for c in ("h", "target")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array([len(t) for t in texts], pa.int32()), *lists], names=["h", "target", "n", "rows", "cols"])

    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:  # one group of at most fit_rows rows
        frame = frame.sort_values(["h", "n"])
        sizes = frame["n"].tolist()
        firsts = np.cumsum([0, *sizes[:-1]])
        rows = np.concatenate([r.astype(np.int64) + at for r, at in zip(frame["rows"], firsts)])
        model = fit(sizes, rows, np.concatenate(list(frame["cols"])).astype(np.int64), list(frame["target"]))
        return pd.DataFrame({"feature": list(model), "w": list(model.values())})

    made = sample.mapInArrow(bags, "h long, target int, n int, rows array<int>, cols array<int>")
    return made.groupBy(F.lit(1).alias("all")).applyInPandas(run, "feature long, w array<double>")


def score(docs: DataFrame, model: dict[int, list[float]], text: str = "text") -> DataFrame:
    """Add score (per kind, noisy-or of the sentences) and worst (per kind, its sentence).

    The model has at most DIMENSIONS + 1 rows whatever the corpus, so tasks get it whole.
    Null, empty and blank texts score 0 and have no worst sentence.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = sorted(f for f in shared.value if f >= 0)
        weights = np.array([shared.value[f] for f in known] or [[0.0] * 4])
        bias = np.array(shared.value.get(-1, [9.0, 0.0, 0.0, 0.0]))
        place = np.zeros(DIMENSIONS, np.int64)
        place[known] = np.arange(len(known))
        wanted = np.zeros(DIMENSIONS, bool)
        wanted[known] = True
        for batch in batches:
            parts = [instances(value) for value in batch]
            flat = [words for some in parts for _, words in some]
            z = np.tile(bias, (len(flat), 1))
            rows, cols = features(flat, wanted)
            filled, at = np.unique(rows, return_index=True)
            if len(filled):
                z[filled] += np.add.reduceat(weights[place[cols]], at)
            p, end, out = _softmax(z) if len(flat) else z, 0, []
            for some in parts:
                start, end = end, end + len(some)
                if some:
                    mine = p[start:end]
                    total = noisy_or(mine, np.array([0]))[0]
                    out.append(([float(x) for x in total[1:]], [some[int(k)][0] for k in mine[:, 1:].argmax(axis=0)]))
                else:
                    out.append(([0.0] * 3, [None] * 3))
            yield pd.DataFrame(out, columns=["score", "worst"])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    kind = T.StructType([T.StructField("score", T.ArrayType(T.DoubleType())), T.StructField("worst", T.ArrayType(T.StringType()))])
    scored = docs.withColumn("_s", F.pandas_udf(run, kind)(F.col(text)))
    return scored.select(*docs.columns, F.col("_s.score").alias("score"), F.col("_s.worst").alias("worst"))


def _scored(spark: SparkSession, base: str) -> DataFrame:
    docs = table(spark, base, "documents").select("doc_id", "text", "source")
    rows = train(docs, table(spark, base, "content_labels")).collect()  # bounded by DIMENSIONS
    return score(docs, {r["feature"]: list(r["w"]) for r in rows})


def _found(scored: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    kinds = F.arrays_zip(F.array(*map(F.lit, KINDS)).alias("category"), F.col("score").alias("score"), F.col("worst").alias("sentence"))
    flat = scored.select("doc_id", "source", F.inline(kinds).alias("category", "score", "sentence"))
    return flat.where(F.col("score") >= cutoff)


def p8_found(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, category of the documents that hold such language."""
    return _found(_scored(spark, base)).select("doc_id", "category")


def p8_sentences(spark: SparkSession, base: str) -> DataFrame:
    """doc_id, category, score and the sentence that speaks most for it."""
    return _found(_scored(spark, base)).select("doc_id", "category", F.round("score", 6).alias("score"), "sentence")


def p8_rates(spark: SparkSession, base: str) -> DataFrame:
    """Documents and shares of each kind per source."""
    s = _scored(spark, base)
    n = [F.sum((F.get("score", F.lit(i)) >= CUTOFF).cast("int")).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    rates = s.groupBy("source").agg(F.count("*").alias("n_docs"), *n)
    return rates.select("source", "n_docs", *[F.col(f"n_{k}") for k in KINDS], *[(F.col(f"n_{k}") / F.col("n_docs")).alias(f"rate_{k}") for k in KINDS])


QUERIES = {"p8_found": p8_found, "p8_sentences": p8_sentences, "p8_rates": p8_rates}
ORACLES: dict[str, str] = {}
