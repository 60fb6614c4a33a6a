import json

from marlstone.operators import conversations_json as cj
from marlstone.operators.shred import shred


def items(spark, texts):
    df = spark.createDataFrame([(i, t, "other") for i, t in enumerate(texts)], "row_id int, conversation string, parent string")
    rows = cj.flat_items(cj.shred_conversations(df, "conversation", ["row_id"]), "row_id").collect()
    return sorted((r.row_id, r.item_kind, r.item_id, r.parent_ref) for r in rows)


def node(parent="-", children=(), **message):
    out = {"children": list(children), "message": message or None}
    return out if parent == "-" else out | {"parent": parent}


def test_levels(spark):
    df = spark.createDataFrame([(1, '{"a": {"x": {"b": [1, null]}, "y": {"b": []}, "z": {}}}'), (2, "{}")], "k int, j string")
    got = {r.k: (r.leaf.v, r.leaf.r, r.leaf.d) for r in shred(df, "j", {"leaf": "a.*.b.[]"}, ["k"]).collect()}
    assert got[1] == (["1", None, None, None], [0, 2, 1, 1], [4, 4, 3, 2])
    assert got[2] == ([None], [0], [0])


def test_nodes_parts_attachments(spark):
    tree = {
        "r": node(None, ["a"]),
        "a": node("r", ["b"], content={"parts": ["x", None, {"image": 1}, ""]}, metadata={"attachments": [{"id": 1}, {"id": 2}]}),
        "b": node("-", [], content={"text": "code"}),
        "c": node("gone", [], content={"parts": "bare"}),
    }
    got = items(spark, [json.dumps({"mapping": tree})])
    assert got == sorted(
        [(0, "node", "r", ""), (0, "node", "a", "r"), (0, "node", "b", "a"), (0, "node", "c", "gone")]
        + [(0, "part", f"a#{i}", "a") for i in (0, 2, 3)]
        + [(0, "part", "b#0", "b"), (0, "part", "c#0", "c"), (0, "attachment", "a#0", "a"), (0, "attachment", "a#1", "a")]
    )


def test_odd_rows(spark):
    deep = "[" * 20000 + "]" * 20000
    assert items(spark, [None, "", "no json", "[]", "3", "{}", '{"mapping": null}', '{"mapping": {}}', '{"mapping": {"a":', deep]) == []
    assert items(spark, []) == []
    same = json.dumps({"mapping": {"n": node(None)}})
    assert items(spark, [same, same]) == [(0, "node", "n", ""), (1, "node", "n", "")]
