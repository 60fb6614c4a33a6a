"""Whole-corpus encoding with a public byte-level BPE vocabulary, by forced boundaries.

A pair of bytes that stands inside no token of the vocabulary can never be joined by a
merge, so the tokens of a text end between the two. Where the pair is also a place at
which the pre-tokenizer always begins anew - a blank after a character that is none -
the text may be cut there and the fragments encoded on their own: the ids of the text
are those of its fragments, one after the other. Fragments repeat far more often than
texts, so each task encodes a fragment once and looks it up afterwards.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.tables import table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Pre-tokenizer of the vocabulary (fixed value, part of its definition).
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Fragments that a task remembers; beyond it, the memory is emptied and filled anew.
REMEMBERED = 200_000

_loaded: dict[str, tuple] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    """Tokens and their ranks out of a file of lines 'base64 rank'."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


def inner_pairs(ranks: dict[bytes, int]) -> set[bytes]:
    """The byte pairs that occur inside any token."""
    return {token[i : i + 2] for token in ranks for i in range(len(token) - 1)}


def cut_pattern(ranks: dict[bytes, int]) -> re.Pattern:
    """Matches the empty place of every certain cut: x|blank where the pair is in no token.

    x runs over the printable ASCII characters. Other characters before a blank are cut
    nowhere, which costs speed but no correctness.
    """
    inside = inner_pairs(ranks)
    sure = [chr(b) for b in range(33, 127) if bytes([b, 32]) not in inside]
    return re.compile("(?<=[" + "".join(map(re.escape, sure)) + "])(?= )") if sure else re.compile("(?!)")


def _encoder(path: str) -> tuple:
    if path not in _loaded:
        import tiktoken

        ranks = load_ranks(path)
        coder = tiktoken.Encoding("fragments", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        _loaded[path] = (cut_pattern(ranks), coder.encode_ordinary, {})
    return _loaded[path]


def encode_text(text: str | None, path: str = VOCABULARY) -> list[int]:
    """Ids of one text: cut at the certain boundaries, fragments encoded and concatenated."""
    if not text:
        return []
    cut, encode, known = _encoder(path)
    ids: list[int] = []
    for fragment in cut.split(text):
        got = known.get(fragment)
        if got is None:
            got = encode(fragment)
            if len(known) >= REMEMBERED:
                known.clear()
            known[fragment] = got
        ids += got
    return ids


def encode_column(text: Column, path: str = VOCABULARY) -> Column:
    """Ids of a text column as ARRAY<INT>; null and empty texts give an empty array."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series([encode_text(t, path) for t in batch])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.IntegerType()))(text)


def p6_ids(spark: SparkSession, base: str) -> DataFrame:
    """doc_id and ids of each document by byte_bpe_50k, without special tokens."""
    docs = table(spark, base, "documents")
    return docs.select("doc_id", encode_column(F.col("text")).alias("ids"))


def p6_lengths(spark: SparkSession, base: str) -> DataFrame:
    """Documents, texts that are null or empty, and ids per source."""
    docs = table(spark, base, "documents").select("source", F.coalesce(F.length("text"), F.lit(0)).alias("n"), F.size(encode_column(F.col("text"))).alias("n_ids"))
    return docs.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum(F.when(F.col("n") == 0, 1).otherwise(0)).alias("n_empty"), F.sum("n_ids").alias("n_ids")
    )


QUERIES = {"p6_ids": p6_ids, "p6_lengths": p6_lengths}
ORACLES: dict[str, str] = {}
