"""Nested JSON shredded into level columns, and flat tables rebuilt from them.

A leaf path of a nested record becomes a column of entries (value, repetition level,
definition level) in the order of the record. The repetition level of an entry is the
number of the repeated ancestor that continues at it (0: the record begins), the
definition level how many of the steps of the path exist there. A table per repeated
ancestor follows from the levels alone: counting the entries with a repetition level of
at most k numbers the instances of the k-th repeated ancestor, and a definition level
below that of the ancestor says that there is none.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEAF = "struct<v:array<string>,r:array<int>,d:array<int>>"


def _text(value) -> str:
    """A leaf as text: strings as they are, everything else as compact JSON."""
    text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False, separators=(",", ":"))
    return text.encode("utf-8", "replace").decode("utf-8")


def _walk(node, steps: list[str], rep: int, depth: int, at_rep: int, out: tuple[list, list, list]) -> None:
    """Append the entries of one leaf path below node.

    Steps are field names; '*' enters each field of an object (its value), '[]' each
    item of a list. A path that ends in '*' gives the field names. rep is the repetition
    level of the next entry, depth the steps defined so far, at_rep the number of
    repeated steps entered. A field that is there but null counts as defined; only its
    value is null.
    """
    values, reps, defs = out
    if not steps:
        values.append(None if node is None else _text(node))
        reps.append(rep)
        defs.append(depth)
        return
    step, rest = steps[0], steps[1:]
    if step == "*":
        items = (list(node) if not rest else list(node.values())) if isinstance(node, dict) else []
    elif step == "[]":
        items = node if isinstance(node, list) else [] if node is None or isinstance(node, dict) else [node]
    elif isinstance(node, dict) and step in node:
        _walk(node[step], rest, rep, depth + 1, at_rep, out)
        return
    else:
        items = None
    if not items:
        values.append(None)
        reps.append(rep)
        defs.append(depth)
        return
    for i, item in enumerate(items):
        _walk(item, rest, rep if i == 0 else at_rep + 1, depth + 1, at_rep + 1, out)


def max_levels(path: str) -> tuple[int, int]:
    """Highest repetition and definition level of a path."""
    steps = path.split(".")
    return sum(s in ("*", "[]") for s in steps), len(steps)


def shred_record(text: str | None, paths: list[list[str]]) -> list[tuple[list, list, list]] | None:
    """Values, repetition and definition levels of each path, given by its steps; null if the text is no JSON."""
    if text is None:
        return None
    try:
        record = json.loads(text)
        shredded = []
        for steps in paths:
            out: tuple[list, list, list] = ([], [], [])
            _walk(record, steps, 0, 0, 0, out)
            shredded.append(out)
        return shredded
    except (ValueError, RecursionError):
        return None


def shred(df: DataFrame, column: str, leaves: dict[str, str], keep: list[str]) -> DataFrame:
    """Shred the JSON texts of a column: the kept columns, `is_json`, and one level column per leaf.

    leaves maps a column name to a path such as 'mapping.*.message.content.parts.[]'. A
    scalar where '[]' expects a list counts as a list of one. Null texts and texts that
    are no JSON give is_json false and null level columns; JSON without the path gives
    one entry whose definition level says how much of it exists. Each row is shredded on
    its own, without a shuffle.
    """
    names = list(leaves)
    paths = [leaves[n].split(".") for n in names]
    source = df.select(*keep, F.col(column).alias("_json"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.select(*keep).schema), "is_json boolean", *(f"`{n}` {LEAF}" for n in names)])
    leaf_type = pa.struct([("v", pa.list_(pa.string())), ("r", pa.list_(pa.int32())), ("d", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            valid: list[bool] = []
            cells: list[list] = [[] for _ in names]
            for text in batch.column("_json").to_pylist():
                shredded = shred_record(text, paths)
                valid.append(shredded is not None)
                for k, cell in enumerate(cells):
                    cell.append(dict(zip("vrd", shredded[k])) if shredded is not None else None)
            kept = [batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays(
                [*kept, pa.array(valid, pa.bool_()), *(pa.array(c, leaf_type) for c in cells)], names=[*keep, "is_json", *names]
            )

    return source.mapInArrow(run, schema)


_ORDINALS = T.ArrayType(T.StructType([T.StructField("a", T.IntegerType()), T.StructField("b", T.IntegerType())]))


@F.pandas_udf(_ORDINALS)
def ordinals(reps: pd.Series) -> pd.Series:
    """Number of the first and of the second repeated ancestor at each entry, from 0.

    Read off the repetition levels: the first rises at each level up to 1, the second at
    each 2 and starts again with the first.
    """
    out = []
    for r in reps:
        if r is None:
            out.append(None)
            continue
        r = np.asarray(r)
        first = np.cumsum(r <= 1) - 1
        starts = np.flatnonzero(r <= 1)
        second = np.arange(len(r)) - starts[first] if len(r) else first
        out.append([{"a": int(a), "b": int(b)} for a, b in zip(first, second)])
    return pd.Series(out)


def rebuild(shredded: DataFrame, keep: list[str], leaf: str, depth: int, key: str) -> DataFrame:
    """The table of a leaf's second repeated ancestor, linked to the first by name.

    `key` is the level column that holds the names of the first repeated ancestor (a path
    ending in '*'). Columns: the kept ones, parent (its name), item (number within the
    parent, from 0), d (definition level) and value. Entries whose definition level is
    below `depth` stand for absent items and are left out.
    """
    entries = F.arrays_zip(ordinals(F.col(f"{leaf}.r")).alias("o"), F.col(f"{leaf}.d").alias("d"), F.col(f"{leaf}.v").alias("v"))
    flat = shredded.select(*keep, F.col(f"{key}.v").alias("_names"), entries.alias("_entries"))
    flat = flat.withColumn("_entries", F.filter("_entries", lambda e: e["d"] >= depth))
    flat = flat.select(*keep, "_names", F.inline("_entries").alias("o", "d", "value"))
    return flat.select(*keep, F.get("_names", F.col("o.a")).alias("parent"), F.col("o.b").alias("item"), "d", "value")


def node_arrays(shredded: DataFrame, *leaves: str) -> Column:
    """One struct per instance of the first repeated ancestor out of leaves repeated once."""
    return F.arrays_zip(*[F.col(f"{n}.v").alias(n) for n in leaves], *[F.col(f"{n}.d").alias(f"{n}_d") for n in leaves])
