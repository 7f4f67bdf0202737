"""Every transcript shape on small files: order, times, roles, what is skipped."""

import json
import sqlite3

import pytest

from tracewell.sources import adapters as A

ISO, MS = "2026-05-01T10:00:00.250Z", 1777629600250


def lines(tmp_path, name, rows):
    f = tmp_path / "sub" / f"{name}.jsonl"
    f.parent.mkdir(exist_ok=True)
    f.write_text("\n".join(r if isinstance(r, str) else json.dumps(r) for r in rows))
    return f"file://{tmp_path}"


def turns(df):
    return [(r["session"], r["seq"], r["role"], r["ts_source"], r["cwd"], r["text"]) for r in df.orderBy("session", "seq").collect()]


CASES = {
    "records": (
        [
            {"type": "user", "sessionId": "s", "cwd": "/w", "timestamp": ISO, "message": {"role": "user", "content": "hi"}},
            {"type": "summary", "summary": "x"}, "not json", "[1]",
            {"type": "assistant", "sessionId": "s", "timestamp": ISO, "message": {"role": "assistant", "content": [{"type": "text", "text": "a"}, {"type": "tool_use", "name": "t"}, {"type": "text", "text": "b"}]}},
            {"type": "assistant", "sessionId": "s", "timestamp": "soon", "message": {"role": "assistant", "content": [{"type": "tool_use"}]}},
        ],
        [("s", 0, "user", "iso", "/w", "hi"), ("s", 1, "assistant", "iso", None, "a\nb")],
    ),
    "envelopes": (
        [
            {"timestamp": ISO, "type": "session_meta", "payload": {"id": "e1", "cwd": "/e"}},
            {"timestamp": ISO, "type": "response_item", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "q"}]}},
            {"timestamp": ISO, "type": "event_msg", "payload": {"type": "user_message", "message": "q"}},
            {"timestamp": ISO, "type": "response_item", "payload": {"type": "message", "role": "developer", "content": "no"}},
            {"timestamp": ISO, "type": "response_item", "payload": {"type": "message", "role": "assistant", "content": [{"type": "output_text", "text": "r"}]}},
        ],
        [("e1", 0, "user", "iso", "/e", "q"), ("e1", 1, "assistant", "iso", "/e", "r")],
    ),
    "untimed": (
        [{"role": "user", "message": {"content": [{"type": "text", "text": "<timestamp>x</timestamp>\n<user_query>\nwhat\n</user_query>"}]}}, {"role": "assistant", "message": {"content": "this"}}],
        [("f", 0, "user", "mtime", None, "what"), ("f", 1, "assistant", "mtime", None, "this")],
    ),
    "prompts": (
        [{"display": "one", "timestamp": MS, "workspace": "/p", "conversationId": "c1"}, {"display": "two", "timestamp": MS + 1, "workspace": "/p", "conversationId": "c2"}, {"display": "", "timestamp": MS, "conversationId": "c1"}],
        [("c1", 0, "user", "unixms", "/p", "one"), ("c2", 0, "user", "unixms", "/p", "two")],
    ),
    "flat": (
        [
            {"type": "session", "id": "z", "cwd": "/z", "timestamp": ISO}, {"type": "model_change", "timestamp": ISO},
            {"type": "message", "timestamp": ISO, "message": {"role": "user", "content": "do"}},
            {"type": "message", "timestamp": ISO, "message": {"role": "bashExecution", "command": "ls"}},
            {"type": "message", "timestamp": ISO, "message": {"role": "assistant", "content": [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "ok"}]}},
            {"type": "custom_message", "timestamp": ISO, "content": "digest"},
        ],
        [("z", 0, "user", "iso", "/z", "do"), ("z", 1, "user", "iso", "/z", "!ls"), ("z", 2, "assistant", "iso", "/z", "ok"), ("z", 3, "user", "iso", "/z", "digest")],
    ),
}


@pytest.mark.parametrize("shape", list(CASES))
def test_line_shapes(spark, tmp_path, shape):
    rows, want = CASES[shape]
    got = A.read_transcripts(spark, lines(tmp_path, "f", rows), shape)
    assert turns(got) == want
    assert {r["ts"] for r in got.collect() if r["ts_source"] == "iso"} <= {MS}


def test_empty_files(spark, tmp_path):
    for shape in A.LINES:
        assert A.read_transcripts(spark, lines(tmp_path, "e", [""]), shape).collect() == []


@pytest.mark.parametrize("shape", ["store", "store_2"])
def test_stores(spark, tmp_path, shape):
    db = sqlite3.connect(tmp_path / "a.db")
    db.executescript("CREATE TABLE session(id, directory); CREATE TABLE message(id, session_id, time_created, data); CREATE TABLE part(id, message_id, data)")
    db.execute("INSERT INTO session VALUES ('s', '/d')")
    db.executemany("INSERT INTO message VALUES (?, ?, ?, ?)", [("m2", "s", 20, '{"role":"assistant"}'), ("m1", "s", 10, '{"role":"user"}'), ("m3", "s", 30, '{"role":"system"}'), ("m4", "s", 40, "{"), ("m5", None, None, None)])
    db.executemany("INSERT INTO part VALUES (?, ?, ?)", [("p2", "m1", '{"type":"text","text":"b"}'), ("p1", "m1", '{"type":"text","text":"a"}'), ("p3", "m2", '{"type":"text","text":"c"}'), ("p4", "m2", '{"type":"tool"}'), ("p5", "m3", '{"type":"text","text":"x"}'), ("p6", "m4", None)])
    db.commit()
    db.close()
    assert turns(A.read_transcripts(spark, f"file://{tmp_path}", shape)) == [("s", 0, "user", "unixms", "/d", "a\n\nb"), ("s", 1, "assistant", "unixms", "/d", "c")]


def test_forest(spark, tmp_path):
    db = sqlite3.connect(tmp_path / "f.db")
    db.execute("CREATE TABLE message_nodes(row_id INTEGER PRIMARY KEY, session_id, node_id, parent_node_id, created_at, chat_message)")
    say = lambda role, text: json.dumps({"role": role, "content": text})
    rows = [("s", 1, None, 5, say("user", "root")), ("s", 3, 1, 9, say("assistant", "late child")), ("s", 2, 1, 7, say("assistant", "child")), ("s", 4, 2, 20, say("user", "grandchild")), ("s", 5, 99, 1, say("system", "rules")), ("s", 6, 1, None, "{")]
    db.executemany("INSERT INTO message_nodes(session_id, node_id, parent_node_id, created_at, chat_message) VALUES (?, ?, ?, ?, ?)", rows)
    db.commit()
    db.close()
    got = A.read_transcripts(spark, f"file://{tmp_path}", "forest")
    assert [t[5] for t in turns(got)] == ["root", "child", "grandchild", "late child"]
    assert got.where("text = 'root'").first()["ts"] == 5000
