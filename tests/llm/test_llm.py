import json
import math
import random
import re
import uuid

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from marlstone.llm import encode, leaks, personal, threads, toxicity
from marlstone.llm.message_text import message_words
from marlstone.llm.personal import Names, find_personal, learn_names, personal_information, redact
from marlstone.llm.vector_cells import VectorCells, common_subsequence
from marlstone.session import scratch

RECORDS = "rec_key long, record_id string, body string, batch_id int"


def message(seed, n=40):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(5000)}" for _ in range(n))


def changed(text, seed, share):
    r = random.Random(seed)
    return " ".join(f"new{r.randrange(999)}" if r.random() < share else w for w in text.split())


def brute(rows):
    kept, short, out = [], {}, {}
    for key, rid, body, _ in sorted(rows, key=lambda x: (x[3] or 0, x[0])):
        if not body or body.isspace():
            continue
        w = message_words(body)
        if len(w) < 8:
            if rid is not None and (rid, body) in short:
                out[key] = short[rid, body]
            else:
                short[rid, body] = key
            continue
        near = [(common_subsequence(w, o) / max(len(w), len(o)), -k) for k, o in kept if min(len(w), len(o)) >= 0.8 * max(len(w), len(o))]
        best = max(near, default=(0, 0))
        if best[0] >= 0.8:
            out[key] = -best[1]
        else:
            kept.append((key, w))
    return out


def test_dedup_batch_by_batch_equals_brute_force(spark):
    rows, key = [], 0
    for i in range(60):
        base = message(i)
        for j in range(i % 4):
            key += 1
            rows.append((key, f"r{i}", f"[2024-01-01 10:00 #x @y]: {changed(base, key, 0.05 * j)}", key % 3))
    hot = message(1000)
    rows += [(1000 + k, None, f"FYI — [2024-01-01 10:00 #x @y]: {changed(hot, k, 0.04)}", k % 3) for k in range(40)]
    rows += [(2000, "s", "short one", 0), (2001, "s", "short one", 1), (2002, None, "short one", 2), (2003, None, None, 2), (2004, "b", "  ", 2)]
    df = spark.createDataFrame(rows, RECORDS)
    want = brute(rows)
    index = VectorCells(spark, scratch(spark, "t"))
    got = {r.dup_key: r.kept_key for r in index.append(df).collect()}
    assert got == want and len(want) > 30 and index.appends == 3


def test_dedup_keeps_the_nearest(spark):
    v1 = message(7, 100).split()
    v2 = [f"x{i}" if i % 5 == 0 or i == 1 else w for i, w in enumerate(v1)]
    v3 = [v1[i] if i in (0, 25, 50, 75) else w for i, w in enumerate(v2)]
    rows = [(k + 1, None, " ".join(v), k) for k, v in enumerate((v1, v2, v3))]
    r = random.Random(11)
    for family in range(12):
        made = [message(500 + family)]
        for k in range(12):
            made.append(changed(r.choice(made), 100 * family + k, r.choice((0.05, 0.12, 0.2))))
        rows += [(100 * (family + 1) + k, None, text, k % 3) for k, text in enumerate(made)]
    df = spark.createDataFrame(rows, RECORDS)
    want = brute(rows)
    assert want[3] == 2
    assert {r.dup_key: r.kept_key for r in VectorCells(spark, scratch(spark, "t")).append(df).collect()} == want


def test_dedup_of_an_empty_table(spark):
    assert VectorCells(spark, scratch(spark, "t")).append(spark.createDataFrame([], RECORDS)).count() == 0


def test_encoding_equals_the_library(spark):
    tokenizers = pytest.importorskip("tokenizers")
    library = tokenizers.Tokenizer.from_file("/opt/tokenizers/byte_bpe_50k.json")
    library.encode_special_tokens = True
    r = random.Random(3)
    alphabet = ["a", "B", "'s", " ", "  ", "\n", "é", "漢", "🧪", "12", ".", "<|endoftext|>", "\t", " ", "!?", "don't"]
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(500)] + [None, "", "x" * 50000, " a" * 20000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {x.doc_id: list(x.ids) for x in df.select("doc_id", encode.encode_column(F.col("text")).alias("ids")).collect()}
    for i, text in enumerate(texts):
        assert got[i] == (library.encode(text, add_special_tokens=False).ids if text else [])


def test_leaks(spark):
    own = [f"w{i}" for i in range(60)]
    items = spark.createDataFrame([(i, "Shared advice to all.\n" + " ".join(f"{w}x{i}" for w in own)) for i in range(4)] + [(9, None)], "item_id long, text string")
    mine = [f"{w}x1" for w in own]
    part, edited, much = mine[10:32], list(mine[5:45]), list(mine[5:45])
    edited[9], edited[20] = "other", "words"
    for k in range(0, 40, 5):
        much[k] = "other"
    texts = [" ".join(mine), "<p>" + "</p>\n<p>".join(part).upper() + "</p>", " ".join(edited), " ".join(much), " ".join(mine[:19]), "Shared advice to all.", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in leaks.leaks(docs, items).collect()) == [(0, 1), (1, 1), (2, 1)]


def test_leaks_of_short_and_repeated_items(spark):
    twelve, sixty = " ".join(f"t{i}" for i in range(12)), " ".join(f"s{i}" for i in range(60))
    items = [(1, "alpha bravo cobalt delta ember"), (2, twelve), (3, sixty), (4, sixty), (5, sixty), (6, "Answer it. Why is the sky blue at noon?"), (7, "Answer it. Where do rivers begin and end?"), (8, "Answer it. Who wrote the long letter?"), (9, ""), (10, None)]
    texts = ["so Alpha, BRAVO cobalt delta ember it is", "see " + " ".join(twelve.split()[3:8]), "x " + sixty, "answer it please", "t1 t2 t3 t4 only", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("item_id", F.lit(0))
    got = leaks.leaks(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((r.doc_id, r.item_id) for r in got.collect()) == [(0, 1), (1, 2), (2, 3), (2, 4), (2, 5)]


def edited_passage(doc, own):
    """Every stretch of own between two words that stand alike, by its edit distance to any part of doc."""
    for a in range(len(own)):
        row = None
        for b in range(a, len(own)):
            alike = [w == own[b] for w in doc]
            ends = [row[j] for j, same in enumerate(alike) if same] if row else []
            if ends and (b + 1 - a) * 3 > len(own) and min(ends) * 10 <= b + 1 - a:
                return True
            new = [row[0] + 1 if row else 999]
            for j, same in enumerate(alike):
                new.append(min(row[j] + (not same), row[j + 1] + 1, new[j] + 1) if row else min(0 if same else 999, new[j] + 1))
            row = new
    return False


def test_leaks_with_edits_close_together(spark):
    own = [f"w{i}" for i in range(100)]
    close, many = own[20:60], own[20:60]
    for k in (10, 12, 25, 27):
        close[k] = "other"
    for k in (5, 12, 20, 28, 35):
        many[k] = "other"
    around = [f"n{i}" for i in range(300)]
    docs = spark.createDataFrame([(k, " ".join(around + t + around)) for k, t in enumerate((close, many))], "doc_id long, text string")
    items = spark.createDataFrame([(1, " ".join(own))], "item_id long, text string")
    assert [tuple(r) for r in leaks.leaks(docs, items).collect()] == [(0, 1)]
    r, seen = random.Random(2), []
    for _ in range(120):
        own = [f"w{r.randrange(60)}" for _ in range(r.randrange(9, 45))]
        start = r.randrange(len(own) // 2)
        part = own[start : start + r.randrange(len(own) // 3, len(own))]
        for _ in range(r.randrange(1 + len(part) // 4)):
            k = r.randrange(len(part) or 1)
            part[k : k + r.randrange(2)] = [f"e{r.randrange(9)}"] * r.randrange(2)
        doc = [f"n{i}" for i in range(r.randrange(60))] + part + ["n"] * r.randrange(20)
        seen.append(edited_passage(doc, own))
        assert leaks.holds_passage(doc, own) == seen[-1]
    assert 20 < sum(seen) < 100


NAMES = Names(["Anna Jorvold", "Otto Jorwick", "Rosa Jordahl", "Hugo Jorette", "Anna Belvold", "Otto Belwick", "Rosa Beldahl", "Hugo Belette"])


@pytest.mark.parametrize(
    "text, want",
    [
        ("write to a.b+c@mail.example.com.", [("email", "a.b+c@mail.example.com")]),
        ("to anna (at) x.example or otto dot b at y dot example dot org now", [("email", "anna (at) x.example"), ("email", "otto dot b at y dot example dot org")]),
        ("anna＠x.example and a​nna@x.example", [("email", "anna＠x.example"), ("email", "a​nna@x.example")]),
        ("call +44 (0)7700 900 138 or (415) 555-0188 or 303-555-0178 ext. 288 or 030 / 23125 087", [("phone", "+44 (0)7700 900 138"), ("phone", "(415) 555-0188"), ("phone", "303-555-0178 ext. 288"), ("phone", "030 / 23125 087")]),
        ("Passport QQ 12 34 56 A, tax id 938-78-9328, 00005360-G, 008599-7527", [("idnum", "QQ 12 34 56 A"), ("idnum", "938-78-9328"), ("idnum", "00005360-G"), ("idnum", "008599-7527")]),
        ("at 12 East Heron St, Apt 4, Ostermoor or C/ Olmo, 5, 2º A or Lindenstr. 7b or 5 bis, rue du Moulin.", [("address", "12 East Heron St, Apt 4"), ("address", "C/ Olmo, 5, 2º A"), ("address", "Lindenstr. 7b"), ("address", "5 bis, rue du Moulin")]),
        ("Dr. Anna Jorvold, Belwick, Otto and R. Jordahl", [("name", "Anna Jorvold"), ("name", "Belwick, Otto"), ("name", "R. Jordahl")]),
        ("call +one five five one two three four six one two or ZERO SEVEN-SEVEN ZERO ZERO NINE ZERO ZERO ONE THREE EIGHT, nine", [("phone", "+one five five one two three four six one two"), ("phone", "ZERO SEVEN-SEVEN ZERO ZERO NINE ZERO ZERO ONE THREE EIGHT")]),
        ("git@code.example:tools, order 9800-1127-5, 10.0.0.17, version 4.12.0, @anna12, Amber Falcon, Anna said", []),
        ("ssn five five five dash one two dash three four five six", [("idnum", "five five five dash one two dash three four five six")]),
        ("FOUR ONE five five five five zero one eight eight or 4155550188", [("phone", "FOUR ONE five five five five zero one eight eight")]),
        ("a[at]b[dot]c (dot) org, the dot product at home", [("email", "a[at]b[dot]c (dot) org")]),
        ("y" * 500 + "@x.example", [("email", "y" * 500 + "@x.example")]),
        ("", []),
        (None, []),
    ],
)
def test_personal_findings(text, want):
    assert [(k, text[s:e]) for k, s, e in find_personal(text, NAMES)] == want


def test_texts_without_forms_are_not_searched_place_by_place(monkeypatch):
    class Never:
        def search(self, text):
            raise AssertionError(text)

        finditer = search

    for pattern in ("_SIGNS", "_IDNUM", "_PHONE", "_ADDRESS", "_STREET"):
        monkeypatch.setattr(personal, pattern, Never())
    text = "[2018-01-01 00:10 #ops @zoe.dun49]: what (12.5) over 3 runs at BENC-6048, été 87 %, the dotted draft-5 and call 9 are due at 17:25"
    assert find_personal(text, NAMES) == []


def test_forms_leave_no_finding_out(monkeypatch):
    numbers = ["+44 (0)7700 900 138", "(415) 555-0188", "303.555.0178 ext 2", "030 / 23125 087", "0049 30 2312 5087", "07700900138", "00493023125087"]
    numbers += ["QQ 12 34 56 A", "qq123456a", "938-78-9328", "938 78 9328", "00005360-G", "X1234567L", "y-7654321-z", "Z12345678", "008599-7527", "AB1CD23E45", "a1bc23d45", "\u212aQ 12 34 56 A"]
    numbers += ["12 E. Heron St", "12b Heron Close", "5, allée des Pins", "3 bis Quai Nord", "C/ Olmo, 5", "Pa\u017feo de la Paz 5", "AVDA. Sol 7", "Lindenstraße 7b", "Ostring 12", "Linden\u017ftr. 5", "１２ Heron St", "٣ Heron St"]
    r, seen = random.Random(4), 0
    texts = numbers + ["".join(r.choice(numbers + list(" ,.-(é5aQ")) + r.choice(["", " ", ", ", "\n"]) for _ in range(r.randrange(1, 7))) for _ in range(2000)]
    for text in [*texts, *map(str.upper, texts)]:
        found = find_personal(text, NAMES)
        with monkeypatch.context() as whole:
            whole.setattr(personal, "_form", lambda text: None)
            assert find_personal(text, NAMES) == found
        seen += bool(found)
    assert seen > 2000


def test_redaction_keeps_the_rest(spark):
    assert redact("ask Anna Jorvold&#44; a@b.example!", NAMES) == "ask [NAME]&#44; [EMAIL]!" and redact(None, NAMES) is None
    df = spark.createDataFrame([(1, "a@b.example a@b.example", "z"), (2, None, None)], "k long, body string, kind string")
    assert [tuple(r) for r in personal_information(df, "k", "body", NAMES).collect()] == [(1, "email", "a@b.example")]


def test_more_names_than_tasks_can_hold_are_an_error(spark, monkeypatch):
    users = spark.createDataFrame([("Anna Lee",), ("Bob Ray",), ("Anna Lee",), (None,)], "real_name string")
    assert learn_names(users).given == {"anna", "bob"}
    monkeypatch.setattr(personal, "MOST_NAMES", 1)
    with pytest.raises(ValueError):
        learn_names(users)


def turns(spark, rows):
    messages = spark.createDataFrame(rows, "conv string, msg string, ref long, parent string, idx long, role string, blank boolean, at long")
    out = threads.kept_turns(threads.conversation_positions(messages)).collect()
    return sorted((r.conv, r.turn, r.ref, r.speaker) for r in out)


def test_conversation_orders_and_breaks(spark):
    u, a = "user", "assistant"
    rows = [("i", "1", 1, None, 1, a, False, 0), ("i", "0", 2, None, 0, u, False, 9)]
    rows += [("p", str(k), 10 + k, str(k - 1) if k else None, None, (u, a)[k % 2], False, -k) for k in range(20)]
    rows += [("t", "x", 40, None, None, a, False, 5), ("t", "y", 41, None, None, u, False, 4), ("t", "z", 42, None, None, "tool", False, 6)]
    rows += [("gap", "0", 50, None, 0, u, False, 0), ("gap", "1", 51, None, 2, a, False, 0)]
    rows += [("fork", "0", 60, None, None, u, False, 0), ("fork", "1", 61, "0", None, a, False, 0), ("fork", "2", 62, "0", None, a, False, 0)]
    rows += [("ring", "0", 70, None, None, u, False, 0), ("ring", "1", 71, "2", None, a, False, 0), ("ring", "2", 72, "1", None, a, False, 0)]
    rows += [("role", "0", 80, None, 0, None, False, 0), ("last", "0", 81, None, 0, u, False, 0), ("void", "0", 82, None, 0, a, True, 0)]
    want = [("i", 0, 2, u), ("i", 1, 1, a)] + [("p", k, 10 + k, (u, a)[k % 2]) for k in range(20)] + [("t", 0, 41, u), ("t", 1, 40, a)]
    assert turns(spark, rows) == sorted(want)
    assert turns(spark, []) == []


def jobs_of(spark, work):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "")
    work()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))


def test_long_chains_take_no_more_jobs_than_short_ones(spark):
    chain = lambda n: [("p", str(k), k, str(k - 1) if k else None, None, ("user", "assistant")[k % 2], False, None) for k in range(n)]
    short, long = (jobs_of(spark, lambda n=n: turns(spark, chain(n))) for n in (4, 300))
    assert long == short


def test_stamps_are_read_only_where_they_tell_the_order(spark):
    rows = [("i", "1", 1, None, 0, "user", False, 5), ("p", "1", 2, None, None, "user", False, 5), ("p", "2", 3, "1", None, "user", False, 5), ("t", "1", 4, None, None, "user", False, 5)]
    seen = []
    messages = spark.createDataFrame(rows, "conv string, msg string, ref long, parent string, idx long, role string, blank boolean, stamp long")
    timed = lambda df: (seen.extend(r.conv for r in df.collect()), df.withColumnRenamed("stamp", "at"))[1]
    assert threads.conversation_positions(messages, timed).count() == 4 and seen == ["t"]


def test_chains_of_many_conversations(spark, monkeypatch):
    r, rows, want, ref = random.Random(6), [], [], 0
    for c in range(60):
        n = r.choice([1, 2, 3, 8, 40])
        parents = [None, *map(str, range(n - 1))]
        fault = r.choice(["", "", "", "fork", "circle", "gone", "roots"]) if n > 3 else ""
        if fault == "fork":
            parents[-1] = "0"
        elif fault:
            parents[-2:] = {"circle": [str(n - 1), str(n - 2)], "gone": ["x", parents[-1]], "roots": [None, parents[-1]]}[fault]
        kind = r.choice(["idx", "parent", "parent"])
        for k in range(n):
            idx = None if kind == "parent" else n - 1 if fault and k == 1 else k
            # Of a conversation of one message nothing is stated: it is first in time.
            rows.append((f"c{c}", str(k), ref, parents[k], idx, ("assistant", "user")[(n - k) % 2 == 0], False, k))
            if not fault:
                want.append((f"c{c}", k, ref, ("assistant", "user")[(n - k) % 2 == 0]))
            ref += 1
    rows.append(("one", "x", ref, "x", None, "assistant", False, None))
    r.shuffle(rows)
    assert turns(spark, rows) == sorted(want)
    monkeypatch.setattr(threads, "LONGEST_WALK", 2)
    monkeypatch.setattr(threads, "PLACES", 3)
    assert turns(spark, rows) == sorted(want)


def test_walked_chains_cross_batches():
    columns = {"conv": ["a"] * 4 + ["b"] * 2 + ["c"] * 3 + ["d"], "msg": list("3120xy") + list("pqr") + ["z"], "parent": ["2", "0", "1", None, None, "x", None, "p", "p", "z"]}
    rows = pa.table(columns | {"ref": list(range(10)), "role": ["user"] * 10, "blank": [False] * 10, "n": [4] * 4 + [2] * 2 + [3] * 3 + [1]})
    for size in range(1, 11):
        got = pa.Table.from_batches(list(threads._walk_chains(iter(rows.to_batches(size))))).to_pydict()
        assert list(zip(got["conv"], got["msg"], got["pos"])) == [("a", "3", 3), ("a", "1", 1), ("a", "2", 2), ("a", "0", 0), ("b", "x", 0), ("b", "y", 1)]
    assert list(threads._walk_chains(iter([]))) == []


def test_long_conversations_by_place(spark):
    who = lambda k: ("user", "assistant", "tool")[k % 3] if k < 2999 else "assistant"
    rows = [("i", str(k), k, None, k, who(k), k % 3 == 0 and k > 1500, None) for k in range(3000)]
    rows += [("twice", str(k), k, None, min(k, 4), "assistant", False, None) for k in range(6)]
    kept = [k for k in range(3000) if who(k) != "tool" and not (k % 3 == 0 and k > 1500)]
    assert turns(spark, rows) == [("i", turn, k, who(k)) for turn, k in enumerate(kept)]


def test_paths_of_trees():
    said = lambda role, *parts, **more: {"author": {"role": role}, "content": {"parts": list(parts)}} | more
    mapping = {
        "r": {"parent": None, "message": None, "children": ["u"]},
        "u": {"message": said("user", "", "hi")},  # no parent field: r lists it
        "h": {"parent": "u", "message": said("system", "x", metadata={"is_visually_hidden_from_conversation": True})},
        "a": {"parent": "h", "message": said("assistant", None, " \u200b\u00a0")},
        "i": {"parent": "a", "message": said("assistant", {"asset": 1})},
        "t": {"parent": "i", "message": {"id": "t", "content": {"text": "\u0085"}}},
        "o": {"parent": "gone", "message": said("user", "x")}, "c": {"parent": "d"}, "d": {"parent": "c"},
    }
    path = lambda at: threads.tree_path(json.dumps({"current_node": at, "mapping": mapping}))
    assert path("t") == [(1, "u", "user", False), (3, "a", "assistant", True), (4, "i", "assistant", False), (5, "t", None, False)]
    assert path("r") == path("o") == path("c") == path("zz") == path(None) == path("") == []
    assert [threads.tree_path(t) for t in (None, "", "{", "[]", "3", '{"mapping": {}}', '{"current_node": "a", "mapping": []}')] == [[]] * 7


def test_threads_of_interleaved_messages(spark):
    rows = [(1, "c", 0.0, "ann", "where is the zephyr ledger"), (2, "c", 5.0, "bob", "lunch tomorrow anyone"), (3, "c", 60.0, "eve", "@ann the zephyr ledger moved"), (4, "c", 9e5, "bob", "new topic"), (5, None, None, None, None)]
    links = threads.candidate_links(spark.createDataFrame(rows, "msg long, channel string, at double, author string, text string"))
    got = {r.msg: r.parent for r in links.collect()}
    assert got[3] == 1 and got[1] is None and got[4] is None and got[5] is None and len(got) == 5


def test_weights_name_the_evidence_that_is_scored():
    w = threads.WEIGHTS
    assert w["place"] > w["parent"] + w["time"] + w["mention"] + w["overlap"] and w["parent"] > w["time"] + w["mention"] + w["overlap"]


def test_reply_links_by_the_strongest_evidence(spark):
    schema = "conv string, msg string, ref long, parent string, idx long, at long"
    rows = [("a", "x", 1, None, 1, 0), ("a", "y", 2, "x", 0, 0), ("p", "x", 3, "y", None, 0), ("p", "y", 4, None, None, 9), ("p", "z", 5, "gone", None, 9), ("t", "x", 6, None, None, None), ("t", "y", 8, None, None, 5), ("t", "z", 7, None, None, 5)]
    got = {(r.conv, r.msg): (r.parent, r.kind) for r in threads.reply_links(spark.createDataFrame(rows, schema)).collect()}
    assert got == {("a", "x"): ("y", "place"), ("a", "y"): (None, "place"), ("p", "x"): ("y", "parent"), ("p", "y"): (None, "parent"), ("t", "x"): (None, "time"), ("t", "z"): ("x", "time"), ("t", "y"): ("z", "time")}


def best_links(rows):
    """Each message against all before it, one by one."""
    out = {}
    words = lambda t: {w for w in re.split(r"[^\w]+", (t or "").lower()) if len(w) >= 4}
    for msg, channel, at, _, text in rows:
        tops = []
        for m2, c2, at2, a2, t2 in rows:
            if None not in (at, at2) and c2 == channel and (at2, m2) < (at, msg):
                named = a2 is not None and len(a2) > 2 and f"@{a2}" in (text or "")
                score = math.exp(-(at - at2) / 300) + 0.8 * named + 1.2 * len(words(text) & words(t2)) / max(1, len(words(text)))
                tops.append((score, at2, m2))
        out[msg] = max(tops)[2] if tops and max(tops)[0] >= 0.6 else None
    return out


def test_threads_link_at_any_distance(spark, monkeypatch):
    schema = "msg long, channel string, at double, author string, text string"
    rows = [(1, "c", 0.0, "anna", "where is the zephyr ledger"), (2, "c", 1.0, "anna", "lunch"), (3, "c", 1e6, "bob", "zephyr ledger moved"), (4, "c", 2e6, "eve", "@anna done"), (5, "c", 3e6, "eve", "@anna the ledger"), (6, "d", 3e6, "eve", "zephyr ledger")]
    links = lambda rows: {r.msg: r.parent for r in threads.candidate_links(spark.createDataFrame(rows, schema)).collect()}
    assert links(rows) == best_links(rows) == {1: None, 2: 1, 3: 1, 4: 2, 5: 1, 6: None}
    r = random.Random(5)
    vocabulary, authors = [f"word{i}" for i in range(60)], ["anna", "ann", "bob@x", "al", None]
    rows = []
    for k in range(400):
        text = " ".join(r.choices(vocabulary, k=r.randrange(7))) + (f" @{r.choice(authors)}!" if r.random() < 0.2 else "")
        rows.append((k, r.choice("cd"), float(r.randrange(0, 400_000, 60)) if r.random() < 0.95 else None, r.choice(authors), text if r.random() < 0.95 else None))
    want = best_links(rows)
    assert links(rows) == want
    monkeypatch.setattr(threads, "BLOCK", 50)
    assert links(rows) == want


def test_toxicity_learns_from_documents(spark):
    r = random.Random(0)
    calm = ["the build of {} failed again", "please review folder {}", "this stupid script {} died", "no insults here says rule {}"]
    bad = {"abusive": "you are a worthless m0ron {}", "hateful": "all {} are vermin and must leave", "sexual": "watch hot n-u-d-e-s {} tonight"}
    names = ["alpha", "bravo", "cobalt", "delta", "ember"]
    docs, labels = [], []
    for i in range(400):
        lines = [r.choice(calm).format(r.choice(names)) for _ in range(4)]
        kind = r.choice(list(bad)) if i % 3 == 0 else None
        if kind:
            lines.insert(r.randrange(4), bad[kind].format(r.choice(names)))
        docs.append((i, ".\n".join(lines), kind))
        if i % 2 == 0:
            labels.append((i, int(kind is not None), kind, "a"))
    d = spark.createDataFrame([(i, t) for i, t, _ in docs] + [(900, None), (901, ""), (902, " ")], "doc_id long, text string")
    rows = toxicity.train(d, spark.createDataFrame(labels, "doc_id long, toxic int, category string, rater string")).collect()
    scored = {x.doc_id: x for x in toxicity.score(d, {x["feature"]: list(x["w"]) for x in rows}).collect()}
    hits = sum(({k for k, s in zip(toxicity.KINDS, scored[i].score) if s >= 0.5} == ({kind} if kind else set())) for i, _, kind in docs if i % 2)
    assert hits >= 190 and scored[900].score == [0.0] * 3 and scored[901].worst == [None] * 3
