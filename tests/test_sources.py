import json

import pytest
from pyspark.sql import functions as F

from tracewright.sources import transcripts as t
from tracewright.sources.sinks import html_page


def write(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(json.dumps(r) if not isinstance(r, str) else r for r in rows) + "\n")


@pytest.fixture
def pi(tmp_path):
    message = lambda i, role, content, **more: {"type": "message", "id": i, "timestamp": "2026-01-15T10:00:00.000Z", "message": {"role": role, "content": content, **more}}
    write(
        tmp_path / "--Users-user--work--app" / "a.jsonl",
        [
            {"type": "session", "id": "s1", "timestamp": "2026-01-15T10:00:00.000Z", "cwd": "/w", "tools": [{"name": "read", "definitionChars": 5}, {"name": ""}]},
            message("m1", "user", [{"type": "text", "text": "hello"}]),
            message("m2", "assistant", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "a"}, {"type": "text", "text": "b"}, {"type": "toolCall", "id": "c1", "name": "read", "arguments": {"path": "x"}}], usage={"input": 3, "output": 4, "cost": {"total": 0.5}}, model="m", stopReason="toolUse"),
            message("m3", "toolResult", "body", toolCallId="c1", toolName="read", isError=True),
            message("m4", "toolResult", "revived async subagent from run9 .", toolCallId="c2", toolName="subagent"),
            message("m5", "assistant", "plain", usage={"input": 0, "output": 0}, errorMessage="boom"),
            {"type": "compactionSummary", "id": "k1", "summary": "short"},
            {"type": "session_info", "name": " first "},
            {"type": "session_info", "name": "last"},
            "not json",
            "",
        ],
    )
    write(tmp_path / "--Users-user--work--app" / "b.jsonl", [{"type": "session", "id": "s2", "parentSession": "s1"}, message("m1", "user", "forked")])
    write(tmp_path / "--var-folders--x" / "c.jsonl", [{"type": "session", "id": "s3"}])
    return str(tmp_path)


def test_pi(spark, pi):
    rows = {r.id: r for r in t.read(spark, "pi", pi).collect()}
    assert set(rows) == {"m1", "m2", "m3", "m4", "m5", "k1"}
    assert rows["m1"].session_id == "s1" and rows["m1"].project == "work/app" and rows["m1"].content_text == "hello"
    m = rows["m2"]
    assert (m.content_text, m.content_thinking, m.model, m.cost_usd, m.provider_message_id, m.stop_reason) == ("a\nb", "hm", "m", 0.5, "m2", "toolUse")
    assert m.usage.totalTokens == 7 and [(c.id, c.name) for c in m.tool_calls] == [("c1", "read")] and json.loads(m.tool_calls[0].arguments) == {"path": "x"}
    r = rows["m3"].tool_results[0]
    assert (r.toolCallId, r.toolName, r.isError, r.textLength, r.subagent) == ("c1", "read", True, 4, None)
    assert rows["m4"].tool_results[0].subagent.runId == "run9"
    assert rows["m5"].usage is None and rows["m5"].error_message == "boom" and rows["m5"].content_text == "plain"
    assert rows["k1"].role == "compactionSummary" and rows["k1"].content_text == "short"
    assert [r.id for r in sorted(rows.values(), key=lambda r: r.seq) if r.session_id == "s1"] == ["m1", "m2", "m3", "m4", "m5", "k1"]


def test_pi_sessions(spark, pi):
    s = {r.id: r for r in t.pi_sessions(t.files(spark, pi)).collect()}
    assert set(s) == {"s1", "s2"} and s["s1"].name == "last" and [x.name for x in s["s1"].tool_inventory] == ["read"] and s["s2"].tool_inventory is None
    fork = t.forks(t.pi_sessions(t.files(spark, pi))).collect()
    assert [(r.id, r.parent_id, r.branches) for r in fork] == [("s2", "s1", 1)]


def test_claude(spark, tmp_path):
    write(
        tmp_path / "-home-user-p" / "sess.jsonl",
        [
            {"type": "user", "uuid": "u1", "cwd": "/w", "timestamp": "2026-01-15T10:00:00Z", "message": {"role": "user", "content": "hi"}},
            {"type": "user", "uuid": "u2", "isMeta": True, "message": {"content": "meta"}},
            {"type": "assistant", "uuid": "a1", "message": {"id": "p1", "model": "x", "content": [{"type": "text", "text": "ok"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": "ls"}}], "usage": {"input_tokens": 5, "output_tokens": 2, "cache_read_input_tokens": 1}}},
            {"type": "user", "uuid": "u3", "message": {"content": [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "out"}]}]}},
            {"type": "assistant", "uuid": "a2", "isApiErrorMessage": True, "message": {"content": [{"type": "text", "text": "API Error 500"}]}},
            {"type": "summary", "uuid": "z"},
        ],
    )
    rows = {r.id: r for r in t.read(spark, "claude", str(tmp_path)).collect()}
    assert set(rows) == {"u1", "a1", "u3", "a2"} and rows["u1"].session_id == "sess" and rows["u1"].content_text == "hi" and rows["u1"].project == "p"
    assert rows["a1"].tool_calls[0].name == "bash" and rows["a1"].usage.totalTokens == 7 and rows["a1"].provider_message_id == "p1"
    r = rows["u3"]
    assert r.role == "toolResult" and r.tool_results[0].toolName == "bash" and r.tool_results[0].isError and r.content_text == "out"
    assert rows["a2"].stop_reason == "error" and rows["a2"].error_message == "API Error 500"
    s = t.claude_sessions(t.files(spark, str(tmp_path))).first()
    assert s.id == "sess" and s.cwd == "/w"


def test_tool_stream(spark, pi):
    stream = t.tool_stream(t.read(spark, "pi", pi)).collect()
    assert [(r.call_id, r.tool, r.is_error, r.ord) for r in stream] == [("c1", "read", True, 0)]


def test_tool_stream_by_position(spark):
    kind = "session_id string, seq bigint, id string, cost_usd double, tool_calls array<struct<id:string,name:string,arguments:string>>, tool_results array<struct<toolCallId:string,toolName:string,isError:boolean,textLength:bigint,subagent:struct<status:string,runId:string,failed:int>>>"
    rows = [
        ("s", 1, "m1", None, [("", "a", "{}"), ("i", "b", "{}"), ("", "c", "{}")], None),
        ("s", 2, "m2", None, None, [("i", "b", True, 1, None), ("", "a", False, 2, None)]),
        ("s", 3, "m3", None, None, [("", "c", True, 3, None), ("i", "b", False, 9, None)]),
    ]
    out = {r.tool: (r.is_error, r.text_length) for r in t.tool_stream(spark.createDataFrame(rows, kind)).collect()}
    assert out == {"a": (False, 2), "b": (True, 1), "c": (True, 3)}


def test_subagent_runs(spark, tmp_path):
    folder = tmp_path / "proj" / "subagent-artifacts"
    folder.mkdir(parents=True)
    (folder / "r1_scout_meta.json").write_text(json.dumps({"runId": "r1", "agent": "scout", "task": " find ", "exitCode": 2, "modelAttempts": [{"model": "m", "success": False}], "usage": {"input": 5, "cost": 0.5}}))
    (folder / "r2_build_meta.json").write_text(json.dumps({"error": "spawn x ENOENT"}))
    (folder / "r3_bad_meta.json").write_text("{")
    rows = {r.run_id: r for r in t.subagent_runs(spark, str(tmp_path)).collect()}
    assert set(rows) == {"r1", "r2"} and rows["r1"].task_excerpt == "find" and rows["r1"].n_failed_attempts == 1 and rows["r1"].usage.input == 5
    assert rows["r2"].agent == "build" and rows["r2"].usage is None and rows["r2"].project == "proj"


def test_preview_and_page(spark):
    df = spark.createDataFrame([("bash", '{"command":"ls  -la"}'), ("read", '{"path":"x","n":1}')], "name string, args string")
    assert [r[0] for r in df.select(t.preview(F.col("name"), F.col("args"))).collect()] == ["ls -la", "path=x n=1"]
    page = html_page(df, "a<b", rows=1)
    assert "a&lt;b" in page and "1 more rows" in page


def test_calls_without_an_id(spark, tmp_path):
    """Two tools without ids in a file: results of neither can be told, and the file is read."""
    call = lambda name: {"type": "tool_use", "name": name, "input": {}}
    write(tmp_path / "p" / "x.jsonl", [
        {"type": "assistant", "uuid": "a", "message": {"content": [call("Bash"), call("Read")]}},
        {"type": "assistant", "uuid": "b", "message": {"content": [{"type": "tool_use", "id": "c1", "name": "Grep", "input": {}}, {"type": "tool_use", "id": "c1", "name": "Read", "input": {}}]}},
        {"type": "user", "uuid": "u", "message": {"content": [{"type": "tool_result", "tool_use_id": "c1", "content": "x"}, {"type": "tool_result", "content": "y"}]}},
    ])
    rows = {r.id: r for r in t.read(spark, "claude", str(tmp_path)).collect()}
    assert [r.toolName for r in rows["u"].tool_results] == ["grep", ""] and [c.name for c in rows["a"].tool_calls] == ["bash", "read"]


def test_lines_keep_their_numbers_across_splits(spark, tmp_path):
    write(tmp_path / "p" / "long.jsonl", [{"type": "session", "id": "s"}, *[{"type": "message", "id": f"m{k}", "message": {"role": "user", "content": "x" * 50}} for k in range(400)], ""])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        lines = t.files(spark, str(tmp_path))
        assert lines.rdd.getNumPartitions() > 1 or lines.count() == 401
        rows = t.pi_messages(lines).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert sorted((r.line_no, r.id) for r in rows) == [(k + 1, f"m{k}") for k in range(400)] and {r.seq - r.line_no for r in rows} == {0}


def test_projects_and_times_are_chosen_before_reading(spark, pi):
    assert t.files(spark, pi, projects=("--Users-user--work--app",)).select("stem").distinct().count() == 2
    assert t.files(spark, pi, since="2999-01-01T00:00:00").count() == 0
