"""Transcripts of eight shapes as one table of turns.

``unit, shape, session, seq, role, ts, ts_source, cwd, text``: line formats are read by
Spark's text reader and parsed as variants, stores of the SQLite kind one file a task.
A line that is no JSON object, and a record that is no turn, is skipped; ``ts`` is epoch
milliseconds, from the record (``iso``, ``unixms``) or, where a shape has none, from the
file (``mtime``).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions import instants
from tracewell.operators.ordering import numbered

TURNS = "unit string, shape string, session string, seq long, role string, ts long, ts_source string, cwd string, text string"
#: Kinds of content part that are text.
TEXT_PARTS = ["text", "input_text", "output_text"]


def _at(v: Column, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(v, path, kind)


def _text(v: Column, path: str) -> Column:
    """A text, or the text parts of a list of parts, joined by line breaks."""
    whole = F.when(F.schema_of_variant(_at(v, path, "variant")) == "STRING", _at(v, path))
    parts = F.transform(_at(v, path, "array<variant>"), lambda p: F.when(_at(p, "$.type").isin(TEXT_PARTS), _at(p, "$.text")))
    return F.coalesce(whole, F.array_join(F.filter(parts, lambda t: t.isNotNull() & (t != "")), "\n"))


def _records(v: Column) -> dict[str, Column]:
    """``{type: user|assistant, sessionId, cwd, timestamp, message: {role, content}}``"""
    return {"keep": _at(v, "$.type").isin("user", "assistant"), "session": _at(v, "$.sessionId"), "role": _at(v, "$.message.role"), "time": _at(v, "$.timestamp"), "cwd": _at(v, "$.cwd"), "text": _text(v, "$.message.content")}


def _envelopes(v: Column) -> dict[str, Column]:
    """``{timestamp, type, payload}``: of the payloads only messages of response items count;
    the session's head names it and its folder."""
    head = _at(v, "$.type") == "session_meta"
    turn = (_at(v, "$.type") == "response_item") & (_at(v, "$.payload.type") == "message") & _at(v, "$.payload.role").isin("user", "assistant")
    return {"keep": turn, "head": head, "session": F.when(head, _at(v, "$.payload.id")), "role": _at(v, "$.payload.role"), "time": _at(v, "$.timestamp"), "cwd": F.when(head, _at(v, "$.payload.cwd")), "text": _text(v, "$.payload.content")}


def _untimed(v: Column) -> dict[str, Column]:
    """``{role, message: {content}}`` without times; of a user's text only the query inside its tags."""
    t = _text(v, "$.message.content")
    inner = F.regexp_extract(t, r"(?s)<user_query>\s*(.*?)\s*</user_query>", 1)
    return {"keep": _at(v, "$.role").isin("user", "assistant"), "role": _at(v, "$.role"), "text": F.when(inner != "", inner).otherwise(t)}


def _prompts(v: Column) -> dict[str, Column]:
    """``{display, timestamp, workspace, conversationId}``: one user prompt a line."""
    return {"keep": _at(v, "$.conversationId").isNotNull(), "session": _at(v, "$.conversationId"), "role": F.lit("user"), "time": _at(v, "$.timestamp"), "cwd": _at(v, "$.workspace"), "text": _at(v, "$.display")}


def _flat(v: Column) -> dict[str, Column]:
    """``{type: session|message|custom_message, timestamp, ...}``; a command the user ran is a turn too."""
    kind, head = _at(v, "$.type"), _at(v, "$.type") == "session"
    command = F.when(_at(v, "$.message.role") == "bashExecution", F.concat(F.lit("!"), _at(v, "$.message.command")))
    role = F.when(command.isNotNull() | (kind == "custom_message"), "user").otherwise(_at(v, "$.message.role"))
    text = F.coalesce(command, F.when(kind == "custom_message", _text(v, "$.content")), _text(v, "$.message.content"))
    return {"keep": kind.isin("message", "custom_message") & role.isin("user", "assistant"), "head": head, "session": F.when(head, _at(v, "$.id")), "role": role, "time": _at(v, "$.timestamp"), "cwd": F.when(head, _at(v, "$.cwd")), "text": text}


LINES: dict[str, Callable[[Column], dict[str, Column]]] = {"records": _records, "envelopes": _envelopes, "untimed": _untimed, "prompts": _prompts, "flat": _flat}


def read_lines(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Turns of the line files under ``path``, in file order."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.jsonl").text(path)
    raw = raw.select("value", F.col("_metadata.file_path").alias("unit"), F.col("_metadata.file_block_start").alias("_block"), F.unix_millis("_metadata.file_modification_time").alias("_mtime"))
    v = F.try_parse_json("value")
    raw = raw.withColumn("_v", F.when(F.ltrim("value").startswith("{"), v)).where("_v IS NOT NULL").withColumn("_line", F.monotonically_increasing_id())
    field = LINES[shape](F.col("_v"))
    none = F.lit(None).cast("string")
    rows = raw.select(
        "unit", "_block", "_line", "_mtime", F.coalesce(field["keep"], F.lit(False)).alias("_keep"), F.coalesce(field.get("head", F.lit(False)), F.lit(False)).alias("_head"),
        field.get("session", none).alias("session"), field["role"].alias("role"), field.get("time", none).alias("_time"), field.get("cwd", none).alias("cwd"), F.coalesce(field["text"], F.lit("")).alias("text"),
    )
    # a file's head names its session and folder; without one the file does
    heads = rows.where("_head").groupBy("unit").agg(F.min_by(F.struct("session", "cwd"), F.struct("_block", "_line")).alias("h"))
    stem = F.regexp_replace(F.substring_index("unit", "/", -1), r"\.jsonl$", "")
    turns = rows.where("_keep AND NOT _head AND text <> ''").join(heads, "unit", "left")
    turns = turns.withColumn("session", F.coalesce("session", F.col("h.session"), stem)).withColumn("cwd", F.coalesce("cwd", F.col("h.cwd"))).drop("h")
    timed = instants.with_readings(turns, "_time", F.lit("UTC"), F.lit("dmy"), 1000.0, "_readings").withColumn("_ms", F.get("_readings", F.lit(0))["ms"])
    source = F.when(F.col("_ms").isNull(), "mtime").when(F.col("_time").rlike(r"^\d+$"), "unixms").otherwise("iso")
    placed = numbered(timed.drop("_readings"), ["session", "unit"], ["_block", "_line"], "seq")
    return placed.select("unit", F.lit(shape).alias("shape"), "session", (F.col("seq") - 1).alias("seq"), "role", F.coalesce("_ms", "_mtime").alias("ts"), source.alias("ts_source"), "cwd", "text")


def _store_turns(db) -> Iterator[tuple]:
    """session / message / part tables with JSON data: the text parts of user and assistant messages."""
    import json

    def obj(text):
        try:
            v = json.loads(text)
        except (TypeError, ValueError):
            return {}
        return v if isinstance(v, dict) else {}

    parts: dict[str, list[str]] = {}
    for _, mid, data in db.execute("SELECT id, message_id, data FROM part ORDER BY message_id, id"):
        p = obj(data)
        if p.get("type") == "text" and isinstance(p.get("text"), str) and p["text"].strip():
            parts.setdefault(mid, []).append(p["text"])
    folders = dict(db.execute("SELECT id, directory FROM session"))
    seqs: dict[str, int] = {}
    for mid, sid, at, data in db.execute("SELECT id, session_id, time_created, data FROM message ORDER BY session_id, time_created, id"):
        role = obj(data).get("role")
        if role in ("user", "assistant") and mid in parts:
            seqs[sid] = seqs.get(sid, -1) + 1
            yield sid, seqs[sid], role, int(at) if at is not None else None, "unixms", folders.get(sid), "\n\n".join(parts[mid])


def _forest_turns(db) -> Iterator[tuple]:
    """message_nodes: a forest per session, parents before children, siblings by time; seconds."""
    import json

    by: dict[str, list[tuple]] = {}
    for row in db.execute("SELECT session_id, node_id, parent_node_id, created_at, row_id, chat_message FROM message_nodes ORDER BY created_at, row_id"):
        by.setdefault(row[0], []).append(row)
    for sid, rows in by.items():
        ids, kids = {r[1] for r in rows}, {}
        for r in rows:
            kids.setdefault(r[2] if r[2] in ids and r[2] != r[1] else None, []).append(r)
        todo, seen, seq = list(reversed(kids.get(None, []))), set(), 0
        while todo:
            r = todo.pop()
            if r[1] in seen:
                continue
            seen.add(r[1])
            todo += reversed(kids.get(r[1], []))
            try:
                m = json.loads(r[5])
            except (TypeError, ValueError):
                continue
            content = m.get("content") if isinstance(m, dict) else None
            if isinstance(content, list):
                content = "\n".join(p["text"] for p in content if isinstance(p, dict) and p.get("type") in TEXT_PARTS and isinstance(p.get("text"), str))
            if isinstance(content, str) and content.strip() and m.get("role") in ("user", "assistant"):
                yield sid, seq, m["role"], int(r[3]) * 1000 if r[3] is not None else None, "unixms", None, content
                seq += 1


#: two programs keep stores of the same tables
STORES = {"store": _store_turns, "store_2": _store_turns, "forest": _forest_turns}


def read_stores(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Turns of the SQLite files under ``path``; each is opened read-only from its bytes."""
    turns_of = STORES[shape]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import sqlite3

        for p in batches:
            for unit, content in zip(p["unit"], p["content"]):
                db = sqlite3.connect(":memory:")
                db.deserialize(bytes(content))
                rows = [(unit, shape, *t) for t in turns_of(db)]
                yield pd.DataFrame(rows, columns=["unit", "shape", "session", "seq", "role", "ts", "ts_source", "cwd", "text"]).astype({"ts": "Int64", "seq": "Int64"})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{db,sqlite}").load(path)
    return files.select(F.col("path").alias("unit"), "content").mapInPandas(run, TURNS)


SHAPES = [*LINES, *STORES]


def read_transcripts(spark: SparkSession, path: str, shape: str) -> DataFrame:
    """Turns of any of the ``SHAPES``."""
    return read_lines(spark, path, shape) if shape in LINES else read_stores(spark, path, shape)
