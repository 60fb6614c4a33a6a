import random

import numpy as np
import pyarrow as pa
import pytest

from marlstone.llm import vector_cells as v
from marlstone.session import scratch

RECORDS = "rec_key long, record_id string, body string, batch_id int"
BIG = (1 << 44) + 5


def words(seed, n):
    r = random.Random(seed)
    return [f"w{r.randrange(5000)}" for _ in range(n)]


def test_index_is_reopened_and_a_failed_append_repeated(spark, monkeypatch):
    path = scratch(spark, "t")
    text = " ".join(words(1, 30))
    other = " ".join(words(2, 30))
    # Every other rare word of a 30-word message replaced: five places of 30.
    common = ["the", "and"]
    first = [f"r{i // 3}" if i % 3 == 0 else common[i % 2] for i in range(30)]
    second = [f"q{i}" if i % 6 == 0 else w for i, w in enumerate(first)]
    history = [(1, None, text, 0), (BIG, None, " ".join(first), 0), (9, "s", "short one", 0)]
    later = [(BIG + 1, None, text.upper(), 1), (BIG + 2, None, " ".join(second), 1), (BIG + 3, "s", "short one", 1), (BIG + 4, None, other, None), (None, "s", "short one", 1)]
    assert v.VectorCells(spark, path).append(spark.createDataFrame(history, RECORDS)).count() == 0
    opened = v.VectorCells(spark, path)
    assert opened.appends == 1
    df = spark.createDataFrame(later, RECORDS)

    def fail(self):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(v.VectorCells, "_commit", fail)
        try:
            opened.append(df)
        except OSError:
            pass
    opened = v.VectorCells(spark, path)
    assert opened.appends == 1
    got = {tuple(r) for r in opened.append(df).collect()}
    assert got == {(1, BIG + 1), (BIG, BIG + 2), (9, BIG + 3)}
    again = v.VectorCells(spark, path)
    assert again.appends == 3 and {tuple(r) for r in again.found().collect()} == got
    assert spark.read.parquet(f"{path}/accepted").count() == 3
    opened.close()


def test_a_filed_message_is_met_from_fewer_places_than_it_has_cells():
    r = random.Random(4)
    none = (np.array([], np.int64), np.array([], np.int64))
    for _ in range(300):
        n = r.randrange(8, 200)
        filed = [f"w{r.randrange(10**6)}" for _ in range(n)]
        made = v._Batch([filed])
        k = v.segment_words(n)
        cells = v.cells_of(made.runs[k][: n - k + 1], v.seen(made.runs[k][: n - k + 1], none), n)
        assert len(cells) >= min(n // 5 + 1, n // k)
        message = list(filed)
        for place in sorted(r.sample(range(n), min(len(cells) - 1, n // 5)), reverse=True):
            message[place : place + r.randrange(2)] = ["x"] * r.randrange(2)
        if len(message) * 5 < n * 4 or len(message) * 4 > n * 5:
            continue
        other = v._Batch([message])
        assert np.isin(cells, other.probes(0, len(message))).any()


def test_bounds_hold(spark):
    r = random.Random(8)
    rows = []
    for i in range(200):
        a = words(i, r.randrange(8, 60))
        b = [w if r.random() < 0.8 else "x" for w in a] + words(i + 999, r.randrange(5))
        rows.append((" ".join(a), " ".join(b)))
    for a, b in rows:
        sx, sy = (v.sketch_of(v._Batch([t.split(" ")]).codes) for t in (a, b))
        lost = sum(int(p & ~q & 0xFFFFFFFFFFFFFFFF).bit_count() for p, q in zip(sx.tolist(), sy.tolist()))
        assert v.common_subsequence(a.split(" "), b.split(" ")) <= len(a.split(" ")) - lost


@pytest.mark.parametrize("crowded", [1, 10**9])
def test_hot_group_of_changed_copies(spark, monkeypatch, crowded):
    monkeypatch.setattr(v, "CROWDED", crowded)
    base = words(77, 50)
    rows = []
    for k in range(300):  # a third of the rows are changed copies of one message
        if k % 3 == 0:
            r = random.Random(k)
            rows.append((k, None, " ".join(w if r.random() > 0.04 else f"z{r.randrange(99)}" for w in base), k % 2))
        else:
            rows.append((k, None, " ".join(words(k, 40)), k % 2))
    index = v.VectorCells(spark, scratch(spark, "t"))
    df = spark.createDataFrame(rows, RECORDS)
    got = index.append(df).collect()
    assert len(got) >= 97 and all(r.dup_key % 3 == 0 for r in got)
    found.setdefault("rows", sorted(map(tuple, got)))
    assert found["rows"] == sorted(map(tuple, got))  # both ways give the same rows


found: dict[str, list] = {}


def scattered(text):
    """The text with every fifth word dropped, and as many others put in elsewhere."""
    out = []
    for i, word in enumerate(text):
        out += [word] * (i % 5 != 0) + [f"new{i}"] * (i % 5 == 2)
    return out


def test_no_pair_at_the_threshold_is_missed(spark):
    rows, want = [], set()
    for i in range(40):
        a = words(900 + i, (30, 50, 10, 100)[i % 4])
        b = scattered(a)
        assert v.common_subsequence(a, b) * 5 == 4 * len(a) and len(a) == len(b)
        rows += [(2 * i, None, " ".join(a), i % 2), (2 * i + 1, None, " ".join(b), i % 2)]
        want.add((2 * i, 2 * i + 1))
    df = spark.createDataFrame(rows, RECORDS)
    assert {tuple(r) for r in v.VectorCells(spark, scratch(spark, "t")).append(df).collect()} == want


def test_one_call_gives_the_rows_of_one_call_per_batch(spark):
    rows = []
    for family in range(10):
        made = [words(40 * family, 40)]
        for k in range(9):
            r = random.Random(100 * family + k)
            made.append([w if r.random() > 0.1 else f"z{r.randrange(99)}" for w in r.choice(made)] if k % 3 else made[k // 3])
        rows += [(10 * family + k, None, " ".join(text), k % 3) for k, text in enumerate(made)]
    df = spark.createDataFrame(rows, RECORDS)
    index = v.VectorCells(spark, scratch(spark, "t"))
    for batch in range(3):
        index.append(df.where(f"batch_id = {batch}"))
    whole = v.VectorCells(spark, scratch(spark, "t"))
    whole.append(df)
    assert whole.appends == index.appends == 3
    assert sorted(map(tuple, whole.found().collect())) == sorted(map(tuple, index.found().collect()))


@pytest.mark.parametrize("since", [0, 1])
def test_large_cells_give_the_pairs_of_small_ones(monkeypatch, since):
    base = words(5, 60)
    texts = []
    for k in range(150):
        r = random.Random(k)
        texts.append([w if r.random() > 0.06 else f"z{r.randrange(9999)}" for w in base] + words(k, k % 9))
    made = v._Batch(texts)
    of, lead, rest = v.signatures(made, (np.array([], np.int64), np.array([], np.int64)))
    sketches = np.array([v.sketch_of(made.codes[start:end]) for start, end in made])
    order = np.argsort(lead, kind="stable")
    of, lead, rest = of[order], lead[order], rest[order]
    cells = [int(c).to_bytes(3, "little") for c in rest]
    columns = [lead.astype(np.int64), (of % 2).astype(np.int32), of, np.array(list(map(len, texts)), np.int32)[of], *sketches[of].T]
    table = pa.table(dict(zip(["lead", "b", "k", "n", *v._SKETCHES], columns)) | {"cells": pa.array(cells, pa.binary())})
    pairs = []
    for large, block in ((10**9, v.BLOCK), (2, (7, 16))):
        monkeypatch.setattr(v, "LARGE_CELL", large)
        monkeypatch.setattr(v, "BLOCK", block)
        pairs.append({(r["kx"], r["ky"]) for r in v.met(table, since).to_pylist()})
    want = set()
    for i in range(150):
        for j in range(i):
            near = v.common_subsequence(texts[i], texts[j]) * 5 >= 4 * max(len(texts[i]), len(texts[j]))
            if near and (since == 0 or i % 2 or j % 2):
                want.add((i, j) if (i % 2, i) > (j % 2, j) else (j, i))
    assert pairs[0] == pairs[1] and len(want) > 100 and want <= pairs[0]
    assert all(x % 2 or y % 2 for x, y in pairs[0]) or since == 0


def test_entries_come_in_few_rows_and_whole(spark):
    texts = [words(k, 8 + k % 60) for k in range(400)]
    df = spark.createDataFrame([(k % 3, BIG + k, len(t), " ".join(t)) for k, t in enumerate(texts)], "b int, k long, n int, text string").coalesce(1)
    none = (np.array([], np.int64), np.array([], np.int64))
    got, buckets = set(), {}
    rows = v.entries(df, none, 7).collect()
    assert {r.bucket for r in rows} == set(range(7)) and len(rows) <= 14
    for row in rows:
        for e in pa.ipc.read_record_batch(pa.py_buffer(row.entries), v._ENTRY).to_pylist():
            assert buckets.setdefault(e["lead"], row.bucket) == row.bucket and e["b"] == (e["k"] - BIG) % 3
            sketch = np.array([e[c] for c in v._SKETCHES])
            assert e["n"] == len(texts[e["k"] - BIG]) and (sketch == v.sketch_of(v._Batch([texts[e["k"] - BIG]]).codes)).all()
            got |= {(e["k"] - BIG, e["lead"], int.from_bytes(e["cells"][i : i + 3], "little")) for i in range(0, len(e["cells"]), 3)}
    assert got == set(zip(*(c.tolist() for c in v.signatures(v._Batch(texts), none))))


def test_orders_of_numbers_that_fit_one_and_that_do_not():
    r = np.random.default_rng(3)
    for top in (5, 1 << 40):
        major, minor = r.integers(0, top, 1000), r.integers(0, 9, 1000) * (top // 9 + 1)
        assert (v._order(major, minor) == np.lexsort((minor, major))).all()
    assert not len(v._order(major[:0], minor[:0]))


@pytest.mark.parametrize("at_once", [0, 20, 10**6])
def test_matches_are_settled_alike_by_one_task_and_by_rounds(spark, monkeypatch, at_once):
    monkeypatch.setattr(v, "AT_ONCE", at_once)
    r = random.Random(6)
    order = [(r.randrange(3), k) for k in r.sample(range(1000), 60)]
    order.sort()
    matches, gone = [], set()
    for x in range(60):
        own = r.sample(range(x), min(x, r.randrange(4)))
        matches += [(order[x][1], order[x][0], order[y][1], order[y][0]) for y in own]
        if any(y not in gone for y in own):
            gone.add(x)
    index = v.VectorCells(spark, scratch(spark, "t"))
    edges = spark.createDataFrame(matches, "kx long, bx int, ky long, by int").repartition(3)
    with v.Scratch(spark, "t") as stages:
        before = stages.stages
        got = sorted(row.k for row in index._in_order(edges, stages).collect())
        assert (stages.stages == before) == (at_once == 10**6)
    assert got == sorted(order[x][1] for x in gone) and len(gone) > 20
