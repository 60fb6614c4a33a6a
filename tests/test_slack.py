import json

from marlstone.sources.slack import read_slack


def export(tmp_path, days):
    (tmp_path / "users.json").write_text(json.dumps([{"id": "U1", "name": "ann", "real_name": "Ann Lee", "profile": {"display_name": "annie"}}, {"id": "U2", "name": "bob", "real_name": "bob"}]))
    (tmp_path / "channels.json").write_text(json.dumps([{"id": "C1", "name": "general"}]))
    for path, messages in days.items():
        (tmp_path / path).parent.mkdir(exist_ok=True)
        (tmp_path / path).write_text(messages if isinstance(messages, str) else json.dumps(messages))
    return str(tmp_path)


def said(user, second, text, **more):
    return {"type": "message", "user": user, "ts": f"{second}.000100", "text": text} | more


def test_bursts_threads_and_mentions(spark, tmp_path):
    day = [
        said("U1", 0, "see <@U2> in <#C1> or <#C9|other>"), said("U1", 10, ""), said("U1", 20, "<https://x.example/a|the page>, <https://y.example>"),
        said("U2", 25, "ok"), said("U1", 200, "late <@U7>"),
        said("U2", 300, "question", thread_ts="300.000100"), said("U2", 310, "not merged"),
        said("U1", 500, "second", thread_ts="300.000100"), said("U2", 400, "first", thread_ts="300.000100"),
        {"type": "message", "subtype": "channel_join", "user": "U2", "ts": "600.0", "text": "joined"},
        {"type": "message", "bot_id": "B1", "username": "robot", "ts": "700.0", "blocks": [{"elements": [{"text": "a", "elements": [{"text": "b"}]}]}]},
        {"type": "message", "user": "U1", "ts": "900.0", "text": " ", "attachments": [{"title": "T", "text": "T", "fallback": " F "}], "files": [{"title": "p", "name": "p.png", "mimetype": "image/png"}]},
        said("U1", 9000, ""),
    ]
    rows = read_slack(spark, export(tmp_path, {"general/1970-01-01.json": day, "general/bad.json": "{", "random/1970-01-02.json": []})).collect()
    got = {r.record_id: (r.title, r.body) for r in rows}
    assert got == {
        "slack:general:0.000100": ("@annie in #general on 1970-01-01 00:00", "[1970-01-01 00:00 #general @annie (Ann Lee)]: see @bob in #general or #other\n[1970-01-01 00:00]: the page, https://y.example"),
        "slack:general:25.000100": ("@bob in #general on 1970-01-01 00:00", "[1970-01-01 00:00 #general @bob]: ok"),
        "slack:general:200.000100": ("@annie in #general on 1970-01-01 00:03", "[1970-01-01 00:03 #general @annie (Ann Lee)]: late @U7"),
        "slack:general:300.000100": ("@bob in #general on 1970-01-01 00:05", "[1970-01-01 00:05 #general @bob]: question\n  ↳ [1970-01-01 00:06 #general @bob]: first\n  ↳ [1970-01-01 00:08 #general @annie (Ann Lee)]: second"),
        "slack:general:310.000100": ("@bob in #general on 1970-01-01 00:05", "[1970-01-01 00:05 #general @bob]: not merged"),
        "slack:general:700.0": ("@ in #general on 1970-01-01 00:11", "[1970-01-01 00:11 #general @robot]: ab"),
        "slack:general:900.0": ("@annie in #general on 1970-01-01 00:15", "[1970-01-01 00:15 #general @annie (Ann Lee)]: T\nF\n[image/png: p (p.png)]"),
    }


def test_an_export_without_messages(spark, tmp_path):
    assert read_slack(spark, export(tmp_path, {"general/1970-01-01.json": "[]"})).count() == 0
