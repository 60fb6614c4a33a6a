"""Text embedding by feature hashing; other models plug in as a function of a list of texts."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIMENSIONS = 384
#: Token ids that a model takes at most, and the id that ends a text (fixed values of the models).
MOST_TOKENS, END_OF_TEXT = 512, 102
# Models of these names stand for a text by its first token.
FIRST_TOKEN_MODELS = ("bge-", "snowflake-arctic", "multilingual-e5", "e5-")


def hashing_model(texts: list[str], dims: int = DIMENSIONS) -> np.ndarray:
    """Signed counts of hashed words, each row at length 1 (zero for texts without words)."""
    out = np.zeros((len(texts), dims), dtype=np.float32)
    for i, text in enumerate(texts):
        for word in re.findall(r"\w+", text.lower()):
            h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
            out[i, h % dims] += 1.0 if h >> 31 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def bounded_ids(ids: list[int], most: int = MOST_TOKENS, end: int = END_OF_TEXT) -> list[int]:
    """Token ids within a model's bound; of longer ones the last is the end of the text."""
    return list(ids) if len(ids) <= most else [*ids[: most - 1], end]


def pooled(tokens: np.ndarray, mask: np.ndarray, model: str) -> np.ndarray:
    """Text vectors of length 1 out of token vectors (texts, tokens, dims) and their mask (texts, tokens).

    The first token's vector, or the mean of those in the mask, as the model's name asks
    for; zero where the mask is empty or the vector has no length.
    """
    if model.startswith(FIRST_TOKEN_MODELS):
        out = tokens[:, 0].astype(np.float64)
    else:
        weights = mask.astype(np.float64)
        out = np.einsum("tkd,tk->td", tokens, weights) / np.maximum(weights.sum(axis=1, keepdims=True), 1)
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def embed(text: Column, load: Callable[[], Callable[[list[str]], np.ndarray]] = lambda: hashing_model) -> Column:
    """Vectors of a text column; `load` runs once per task. Null texts get null."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for batch in batches:
            vectors = model([t or "" for t in batch])
            yield pd.Series([None if t is None else v.tolist() for t, v in zip(batch, vectors)])

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.FloatType()))(text)
