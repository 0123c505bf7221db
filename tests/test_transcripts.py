"""Readers of session logs: every form, bad lines, repeated messages."""

import json

import pytest

from tesserix.sources import transcripts as T


def write(path, *lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(x if isinstance(x, str) else json.dumps(x) for x in lines) + "\n")


def test_messages_with_blocks_and_bad_lines(spark, tmp_path):
    use = {"input_tokens": 5, "output_tokens": 1}
    write(
        tmp_path / "s1.jsonl", "not json", '{"type": 1', "", {"type": "user", "timestamp": "t0", "message": {"role": "user", "content": "hi"}},
        {"type": "assistant", "timestamp": "t1", "message": {"id": "m1", "role": "assistant", "model": "x", "content": [{"type": "thinking", "thinking": "hm"}], "usage": use}},
        {"type": "assistant", "timestamp": "t2", "message": {"id": "m1", "role": "assistant", "model": "x", "content": [{"type": "text", "text": "yo"}, {"type": "tool_use", "name": "Bash", "id": "u"}], "usage": use | {"output_tokens": 9}}},
        {"type": "user", "timestamp": "t3", "message": {"role": "user", "content": [{"type": "tool_result"}]}},
    )
    got = T.turns(spark, str(tmp_path), "messages").orderBy("ts", "kind").collect()
    assert [(r["kind"], r["text"], r["tool"]) for r in got] == [("user", "hi", None), ("thinking", "hm", None), ("agent", "yo", None), ("shell_command", None, "Bash")]
    assert {r["session"] for r in got} == {"s1"}
    assert [tuple(r) for r in T.usage(T.turns(spark, str(tmp_path), "messages")).collect()] == [("s1", "x", 1, 5, 9, 0, 0)]


def test_both_rollout_forms_events_and_detection(spark, tmp_path):
    write(tmp_path / "a.jsonl", {"timestamp": "1", "type": "response_item", "payload": {"type": "message", "role": "user", "text": "q"}}, {"timestamp": "2", "type": "response_item", "payload": {"type": "function_call", "name": "edit", "arguments": "{}"}})
    write(tmp_path / "b.jsonl", {"type": "message", "role": "assistant", "text": "w"}, {"type": "reasoning", "role": "assistant", "text": "r"})
    write(tmp_path / "c.jsonl", {"type": "user.message", "data": {"content": "e"}}, {"type": "tool.execution_start", "data": {"toolName": "todo"}}, {"type": "noise", "data": {}})
    write(tmp_path / "d.jsonl", {"session": "n", "kind": "agent", "text": "z"})
    host = {r["path"].rsplit("/", 1)[1]: r["host"] for r in T.detect(spark, str(tmp_path)).collect()}
    assert host == {"a.jsonl": "rollout", "b.jsonl": "rollout", "c.jsonl": "events", "d.jsonl": "normalized"}
    assert {(r["kind"], r["text"]) for r in T.rollout(spark, f"{tmp_path}/[ab].jsonl").collect()} == {("user", "q"), ("file_edit", "{}"), ("agent", "w"), ("thinking", "r")}
    assert {(r["kind"], r["tool"]) for r in T.events(spark, f"{tmp_path}/c.jsonl").collect()} == {("user", None), ("todo", "todo")}
    assert T.normalized(spark, f"{tmp_path}/d.jsonl").first()["session"] == "n"
    with pytest.raises(ValueError):
        T.turns(spark, str(tmp_path), "nobody")


def test_message_and_part_tables(spark):
    m = spark.createDataFrame([("1", "s", "user", None, "t"), ("2", "s", "assistant", "x", "t"), ("3", "s", "assistant", "x", "t")], "id string, session string, role string, model string, ts string")
    p = spark.createDataFrame([("1", "text", "a", None), ("2", "reasoning", "b", None), ("2", "tool", None, "shell")], "message_id string, type string, text string, tool string")
    assert sorted((r["message_id"], r["kind"]) for r in T.parts(m, p).collect()) == [("1", "user"), ("2", "shell_command"), ("2", "thinking"), ("3", "agent")]


def test_changed_files_ledger_and_live_events(spark, tmp_path):
    write(tmp_path / "u1" / "savings.jsonl", {"ts": "2024-01-01T00:00:01", "tokens": 5}, {"ts": "soon", "tokens": 1}, "{bad", {"ts": "2024-01-01T00:00:02Z", "kind": "session_end", "carry_usd": 0.5})
    seen = T.changed(spark, str(tmp_path), spark.createDataFrame([], "path string, mtime timestamp, size long")).collect()
    assert len(seen) == 1 and T.changed(spark, str(tmp_path), spark.createDataFrame(seen)).count() == 0
    write(tmp_path / "u2" / "savings.jsonl", {"ts": "2024-01-01T00:00:03", "session_id": "z", "tokens_saved": 4})
    assert T.changed(spark, str(tmp_path), spark.createDataFrame(seen)).count() == 1
    rows = T.ledger(spark, str(tmp_path)).orderBy("us").collect()
    assert [(r["session"], r["tokens"], r["us"] - 1704067200000000) for r in rows] == [("u1", 5, 1000000), ("u1", None, 2000000), ("u2", None, 3000000)]
    assert [tuple(r)[:3] for r in T.live_events(spark, str(tmp_path)).collect()] == [("z", 1, 4)]


def test_knowledge_prices_usage_and_tracked_lines(spark, tmp_path):
    (tmp_path / "k").mkdir()
    (tmp_path / "k" / "a.md").write_text("---\nid: x1\ntitle: \"T\"\n---\n# Body\n")
    (tmp_path / "k" / "b.md").write_text("plain")
    got = {r["body"]: (r["id"], r["title"], r["domain"]) for r in T.knowledge(spark, f"{tmp_path}/k").collect()}
    assert got == {"# Body\n": ("x1", "T", None), "plain": (None, None, None)}
    (tmp_path / "p.json").write_text(json.dumps({"m": {"input": 3, "output": 15}, "n": {"input": 1}}))
    over = spark.createDataFrame([("n", 2.0, None, None, None)], "model string, input double, output double, cache_read double, cache_write double")
    assert {(r["model"], r["input"]) for r in T.prices(spark, f"{tmp_path}/p.json", over).collect()} == {("m", 3.0), ("n", 2.0)}
    sse = 'event: x\ndata: {"message": {"model": "m", "usage": {"input_tokens": 7, "output_tokens": 1}}}\ndata: {"usage": {"output_tokens": 9}}\ndata: [DONE]'
    bodies = spark.createDataFrame([(1, sse), (2, '{"model": "n", "usage": {"prompt_tokens": 2, "completion_tokens": 3}}')], "request_id long, body string")
    assert {tuple(r) for r in T.stream_usage(bodies).collect()} == {(1, "m", 7, 9), (2, "n", 2, 3)}
    lines = T.tracked_lines(spark, f"{tmp_path}/k", spark.createDataFrame([("a.md",)], "file string"))
    assert [r["line"] for r in lines.filter("line LIKE '#%'").collect()] == ["# Body"]
