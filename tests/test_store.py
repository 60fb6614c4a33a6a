import json

import pytest
from pyspark.sql import functions as F

from marlstone.functions.chunking import paragraphs_to_chunks, record_to_chunks
from marlstone.functions.embed import embed
from marlstone.sources import archives, files
from marlstone.store import Store, by_file_type, by_prefix
from marlstone.streaming.watch import watch


def test_watch_ingest_and_mutations(spark, tmp_path):
    box = tmp_path / "box"
    box.mkdir()
    (box / "a.md").write_text("# Title\n\nbody")
    (box / "same.md").write_text("# Title\n\nbody")
    (box / "b.json").write_text('{"b": 1, "a": "é"}')
    (box / "bad.json").write_text("{")
    (box / "empty.txt").write_text(" \n")
    (box / "x.png").write_bytes(b"\x89PNG")
    (box / "c.html").write_text("<p>Hi</p><script>x</script>")
    store = Store(spark, str(tmp_path / "store"))
    for _ in range(2):
        watch(spark, str(box), store, str(tmp_path / "ck"), once=True).awaitTermination()
    docs = {r.file_type: r for r in store.read("documents").collect()}
    assert sorted(docs) == ["html", "json", "md"] and docs["html"].raw_text == "Hi\n" and docs["md"].title in ("a", "same")
    assert store.read("chunks").count() == 3

    number = store.create_collection("Work")
    with pytest.raises(ValueError):
        store.create_collection("Work")
    ids = store.read("documents").select("document_id")
    assert store.add_members(number, ids) == 3 and store.add_members(number, ids) == 0
    assert store.delete(by_file_type("json"), dry_run=True) == (1, 1) and store.read("documents").count() == 3
    assert store.delete(by_file_type("json")) == (1, 1) and store.read("members").count() == 2
    assert store.remove_members(number, ids) == 2 and store.delete_collection(number) and not store.delete_collection(number)
    assert store.delete(by_prefix("FILE:")) == (2, 2) and store.read("documents").count() == 0


def test_archives(spark, tmp_path):
    (tmp_path / "t.csv").write_text("name,role\nAnn,dev\n,\nBob,ops,extra\n")
    rows = files.read_archive(spark, "csv", str(tmp_path / "t.csv")).collect()
    assert [r.title for r in rows] == ["t.csv row 1", "t.csv row 2"] and rows[1].body.endswith("name: Bob\nrole: ops\ncol_3: extra\n")
    chat = tmp_path / "d"
    chat.mkdir()
    (chat / "x.json").write_text(json.dumps({"guild": {"name": "G"}, "channel": {"name": "c"}, "messages": [{"id": "1", "timestamp": "2024-01-02T03:04:05", "content": "hi", "author": {"name": "a"}}, {"id": "2", "content": ""}]}))
    (chat / "bad.json").write_text("nope")
    assert [r.body for r in files.read_archive(spark, "discord", str(chat)).collect()] == ["[2024-01-02 03:04 G/#c @a]: hi"]
    (tmp_path / "m.mbox").write_text(
        "From x\nSubject: S\nFrom: Ann <a@b>\nTo: c@d, E <e@f>\nDate: Mon, 01 Jan 2024 10:00:00 +0100\nX-Gmail-Labels: L\nMessage-ID: <1@x>\n\nhello\nFromage\n"
        "\nFrom y\nFrom: b@c\nContent-Type: text/html\n\n<p>hi</p>\n"
    )
    mails = {r.record_id: r for r in files.read_mailbox(spark, str(tmp_path / "m.mbox")).collect()}
    assert mails["mbox:1@x"].body == "[2024-01-01T10:00] From: Ann <a@b> To: c@d, e@f\nSubject: S\nLabels: L\n\nhello\nFromage\n" and mails["mbox:1@x"].title == "S — Ann <a@b>"
    assert mails["mbox:mbox-1"].body.startswith("[] From: b@c\nSubject: (no subject)\n\nhi")
    (tmp_path / "WhatsApp Chat with Bob.txt").write_text("orphan\n31/12/22, 15:02 - Bob B: one\ntwo\n31/12/22, 15:03 - joined\n02/01/23, 15:03 - Ann: x\n")
    got = files.read_whatsapp(spark, str(tmp_path / "WhatsApp*.txt")).orderBy("record_id").collect()
    assert [(r.record_id, r.body) for r in got] == [("whatsapp:Bob:0:1672498920", "[2022-12-31 15:02 chat:Bob @Bob_B]: one\ntwo"), ("whatsapp:Bob:2:1672671780", "[2023-01-02 15:03 chat:Bob @Ann]: x")]


def test_conversation_exports():
    node = lambda parent, role, content, **meta: {"parent": parent, "message": {"author": {"role": role}, "content": content, "metadata": meta}}
    mapping = {
        "r": {"parent": None, "message": None}, "a": node("r", "user", {"content_type": "text", "parts": ["hi", None, "there"]}),
        "s": node("a", "system", {"content_type": "text", "parts": ["no"]}), "b": node("s", "assistant", {"content_type": "code", "language": "py", "text": "x"}),
        "h": node("b", "user", {"content_type": "text", "parts": ["hid"]}, is_visually_hidden_from_conversation=True),
        "c": node("h", "user", {"content_type": "multimodal_text", "parts": [{"content_type": "image_asset_pointer"}, "see"]}),
    }
    ring = {"x": {"parent": "y"}, "y": {"parent": "x"}}
    export = [{"title": "T", "conversation_id": "1", "create_time": 0.5, "current_node": "c", "mapping": mapping}, {"current_node": "x", "mapping": ring}, {"title": None}]
    assert list(files.chatgpt_records("p", json.dumps(export))) == [("chatgpt:1", "ChatGPT: T", '[chatgpt conversation: "T" started: 1970-01-01 00:00]\n\n@user: hi\nthere\n\n@assistant: ```py\nx\n```\n\n@user: [image]\nsee\n\n')]
    chats = [
        {"uuid": "u", "created_at": "2024", "chat_messages": [{"sender": "human", "text": None, "content": [{"type": "text", "text": "q"}, {"type": "tool_use", "name": "t"}], "attachments": [{"file_name": "f", "extracted_content": "E"}, {"file_name": "g"}]}, {"sender": "tool", "text": " "}]},
        {"uuid": "v", "chat_messages": []},
    ]
    want = [("claude.ai:u", "Claude.ai: Untitled", '[claude.ai conversation: "Untitled" started: 2024]\n\n@human: q\n[tool_use: t]\n\n\n[attachment: f]\nE\n\n')]
    assert list(files.claude_records("p", json.dumps(chats))) == want == list(files.claude_records("p", "\n".join(map(json.dumps, chats))))


def test_paths_are_told_apart_and_ingested(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    table = tmp_path / "contacts.CSV"
    table.write_text("name,role\n" + "".join(f"n{i},r\n" for i in range(3)))
    mails = tmp_path / "mail"
    mails.write_text("From x\nMessage-ID: <1>\n\nhello\n")
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "todo.md").write_text("first")
    assert archives.detect(spark, str(table)) == ("csv", str(table)) and archives.detect(spark, str(mails)) == ("mbox", str(mails)) and archives.detect(spark, str(notes)) is None
    with pytest.raises(FileNotFoundError):
        archives.detect(spark, str(tmp_path / "none"))
    number = store.collection_named("Work")
    assert archives.ingest_path(spark, str(table), store, embed) == 3 and archives.ingest_path(spark, str(table), store, embed, store.collection_named("WORK")) == 0
    assert store.read("members").where(f"collection_id = {number}").count() == 3
    assert archives.ingest_path(spark, str(notes), store) == 1
    (notes / "todo.md").write_text("changed")
    assert archives.ingest_path(spark, str(notes), store) == 1 and {r.title for r in store.read("documents").where("file_type = 'md'").collect()} == {"todo"}
    chunk = store.read("chunks").where("embedding IS NOT NULL").first()
    assert len(chunk.embedding) == 384 and chunk.char_start == 0 and chunk.char_end == len(chunk.text)
    paths = spark.createDataFrame([(f"file:{table}",)], "source_path string")
    assert store.members_of_paths(number, paths, remove=True) == 3 and store.members_of_paths(number, paths) == 3
    doc = store.read("documents").limit(1)
    store.upsert("documents", doc.withColumn("title", F.lit("new")), "document_id")
    assert store.read("documents").count() == 5 and store.read("documents").where("title = 'new'").count() == 1
    store.add_tags(spark.createDataFrame([("a", "x"), ("a", "x"), ("b", " ")], "document_id string, tag string"))
    store.add_tags(spark.createDataFrame([("a", "x"), ("a", "y")], "document_id string, tag string"))
    assert store.read("tags").count() == 2
    assert store.clear(dry_run=True)[0] == 5 and store.clear()[0] == 5 and store.read("members").count() == 0 and store.read("collections").count() == 1


def test_chunkers():
    assert paragraphs_to_chunks("") == [] and len(paragraphs_to_chunks("a" * 10000)) == 1
    parts = paragraphs_to_chunks("\n\n".join("p" * 1200 for _ in range(4)))
    assert len(parts) == 4 and parts[-1][2] == 4 * 1200 + 6
    body = "[head]\n" + "\n\n".join("x" * 400 for _ in range(4))
    pieces = record_to_chunks(body, 120)
    assert len(pieces) > 1 and all(p.startswith("[head]\n") for p in pieces)
    assert record_to_chunks("short") == ["short"] and record_to_chunks(None) == []
    assert "".join(p for p in record_to_chunks("é" * 3000, 50)) == "é" * 3000
