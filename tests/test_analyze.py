"""The analyze loop over a folder of transcripts, and the verbs on its store."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright import __main__ as cli
from tracewright.functions import keys
from tracewright.operators import graph
from tracewright.plans import analyze, builtin
from tracewright.plans.registry import Analyzer
from tracewright.plans.store import Store
from tracewright.sources import transcripts

#: Those that the tests look at; what they are made of is tested with the operators.
SOME = [a for a in builtin.ANALYZERS if a.id in ("turn-pair-core", "tool-trajectory", "failure-modes", "cache-economy", "secret-leak", "session-overview")]
TOKEN = "ghp_" + "a1B2" * 9


def transcript(path, name, commands, failing=True):
    rows = [{"type": "session", "id": name, "timestamp": "2026-01-15T10:00:00.000Z", "cwd": "/w"}]
    say = lambda i, **m: {"type": "message", "id": f"{name}-{i}", "timestamp": f"2026-01-15T10:{len(rows) // 60:02d}:{len(rows) % 60:02d}.000Z", "message": m}
    rows.append(say("u0", role="user", content="please build it, no that is wrong"))
    for k, command in enumerate(commands):
        rows.append(say(f"a{k}", role="assistant", content=[{"type": "text", "text": "trying"}, {"type": "toolCall", "id": f"c{k}", "name": "bash", "arguments": {"command": command}}], usage={"input": 9000, "output": 10, "cost": {"total": 0.5}}, model="m"))
        rows.append(say(f"r{k}", role="toolResult", toolCallId=f"c{k}", toolName="bash", isError=failing, content=[{"type": "text", "text": "bash: make: command not found"}]))
    rows.append(say("u1", role="user", content=f"use {TOKEN} and write to bo@example.org"))
    rows.append(say("a9", role="assistant", content="done", usage={"input": 10, "output": 10}, model="m"))
    path.mkdir(parents=True, exist_ok=True)
    (path / f"{name}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("transcripts")
    transcript(at / "--Users-user--app", "s1", ["make test"] * 4)
    transcript(at / "--Users-user--app", "s2", ["git status"] * 3, failing=False)
    return at


@pytest.fixture(scope="module")
def store(spark, folder, tmp_path_factory):
    store = Store(spark, str(tmp_path_factory.mktemp("store")))
    store.sync("pi", str(folder))
    analyze.analyze(store, SOME)
    return store


def run(store, *args):
    given = cli.act(cli._parser().parse_args([args[0], store.path, *args[1:]]), store)
    return given if isinstance(given, str) else given.collect()


def test_findings(store):
    nodes = store.nodes()
    assert {r.analyzer_id for r in nodes.where("node_kind = 'summary'").select("analyzer_id").distinct().collect()} == {a.id for a in SOME}
    assert nodes.where("node_kind = 'error'").count() == 0
    signals = {(r.session_id, json.loads(r.content_json)["pattern"]) for r in nodes.where("analyzer_id = 'tool-trajectory' and node_kind = 'finding'").collect()}
    assert signals == {("s1", "stuck-loop"), ("s2", "polling-loop")}
    assert {r.session_id for r in nodes.where("analyzer_id = 'secret-leak' and node_kind = 'finding'").collect()} == {"s1", "s2"}
    turn = json.loads(nodes.where("analyzer_id = 'turn-pair-core' and node_kind = 'finding' and session_id = 's1' and unit = '0'").first().content_json)
    assert turn["correction_type"] == "explicit" and turn["correction_text"] and [x["preview"] for x in turn["action_trace"]] == ["make test"] * 4 and turn["error_heads"][0] == {"tool": "bash", "head": "bash: make: command not found"}
    assert not any(TOKEN in r.content_json for r in nodes.where(F.col("analyzer_id").isin(*cli.SECRET_FAMILIES)).collect())
    assert json.loads(nodes.where("analyzer_id = 'session-overview' and node_kind = 'finding' and session_id = 's1'").first().content_json)["n_turns"] == 2


def test_every_built_in_analyzer_computes(spark, folder):
    """Each on its own frames, without a store."""
    messages = transcripts.read(spark, "pi", str(folder)).cache()
    ids = [a.id for a in builtin.ANALYZERS]
    assert len(ids) == 19 and len(set(ids)) == 19 and [len(x) for x in analyze.levels(builtin.ANALYZERS)] == [17, 2]
    found = None
    for a in builtin.ANALYZERS:
        rows = a.compute({"messages": messages}).select(F.lit(a.id).alias("analyzer_id"), "session_id", "unit", "content_json")
        found = rows if found is None else found.union(rows)
    have = {r.analyzer_id for r in found.groupBy("analyzer_id").count().collect()}
    assert have >= {"lexicon-candidates", "context-economy", "cache-economy", "token-units", "presidio", "secret-leak", "failure-modes", "session-overview"}
    messages.unpersist()


def test_a_second_run_writes_nothing(store):
    before = store.nodes().count(), store.read("edges").count()
    done = analyze.analyze(store, SOME)
    assert all(v["sessions"] == 0 for v in done.values()) and (store.nodes().count(), store.read("edges").count()) == before


def test_nodes_are_what_their_keys_say_and_edges_lead_somewhere(store):
    assert run(store, "verify") == []
    edges = {(r.edge_kind, r.to_ref_kind) for r in store.read("edges").select("edge_kind", "to_ref_kind").distinct().collect()}
    assert {("anchors", "session"), ("anchors", "message"), ("consumes", "analysis_node"), ("uses_config", "config_version")} <= edges


def test_ids_are_of_version_7(spark, store):
    ids = [r.id for r in store.nodes().select("id").collect()]
    assert len(set(ids)) == len(ids) and all(len(i) == 36 and i[14] == "7" for i in ids)
    assert spark.range(2).select(keys.uuid7().alias("u")).distinct().count() == 2


def test_verbs_read(store):
    assert run(store, "analyzers").split("\n")[0] == "turn-pair-core 1.0"
    assert {r.session_id for r in run(store, "sessions")} == {"s1", "s2"} and run(store, "sessions", "--unanalysed") == [] and len(run(store, "sessions", "--recent", "1")) == 1
    said = {r.what: r.n for r in run(store, "stats")}
    assert said["messages user"] == 4 and said["nodes tool-trajectory"] == 4 and said["proposals open unvalidated"] >= 2
    assert len(run(store, "nodes", "--analyzer", "tool-trajectory", "--node-kind", "finding")) == 2 and len(run(store, "nodes", "--filter", "pattern=stuck-loop")) == 1
    assert {r.value: r.n for r in run(store, "nodes", "--analyzer", "tool-trajectory", "--node-kind", "finding", "--counts", "pattern")} == {"stuck-loop": 1, "polling-loop": 1}
    key = run(store, "nodes", "--filter", "pattern=stuck-loop")[0].output_key
    detail = run(store, "node", key[:10])
    assert {r.edge_kind for r in detail} >= {"anchors", "uses_config"} and all(r.is_unique for r in detail) and any(r.target and r.target.startswith("assistant") for r in detail)
    assert len(run(store, "output", "tool-trajectory")) == 2 and {r.analyzer_id for r in run(store, "runs", "--limit", "99")} == {a.id for a in SOME}
    assert {r.session_id for r in run(store, "leaks", "--severity", "medium")} == {"s1", "s2"} and run(store, "leaks", "--limit", "1")[0].omitted >= 1
    assert run(store, "search", "trying", "--kind", "messages")[0].kind == "message" and run(store, "search", '"command not found"')[0].omitted == 0
    assert any(r.analyzer_id == "session-overview" for r in run(store, "summary", "s1"))
    shown = run(store, "show", run(store, "proposals")[0].id)
    assert shown[0].depth == 0 and shown[0].ref_kind == "analysis_node"


def test_decisions(store):
    listed = run(store, "proposals", "--status", "open", "--session", "s1")
    assert listed and run(store, "reject", listed[0].id, "--reason", "no") == "1 rejected" and run(store, "accept", ",".join(r.id for r in listed)) == f"{len(listed) - 1} accepted"
    assert {r.status for r in run(store, "proposals", "--session", "s1")} == {"rejected", "applied"} and {r.status for r in run(store, "proposals", "--session", "s1", "--as-of", "2020-01-01")} == set()
    assert run(store, "remediate", listed[1].id, "changed the prompt") == "1 remediated" and {r.id: r.status for r in run(store, "proposals")}[listed[1].id] == "applied"


def test_mutes(spark, store):
    assert run(store, "mute", "damn", "--reason", "noise") == "muted damn" and [r.term for r in run(store, "mutes")] == ["damn"]
    assert run(store, "unmute", "damn") == "unmuted damn" and run(store, "mutes") == []
    nodes = spark.createDataFrame([("n1", "frustration-lexicon", "damn", "term", None), ("n2", "frustration-lexicon", "other", "term", None)], "id string, analyzer_id string, unit string, node_kind string, retracted_at timestamp").withColumn("created_at", F.current_timestamp())
    said = spark.createDataFrame([("term", "damn", "rejected")], "subject_kind string, subject_key string, verdict string")
    fresh = analyze.mute_edges(nodes, store.read("edges"), said).collect()
    assert [(r.from_node_id, r.edge_kind) for r in fresh] == [("n1", "mutes")]
    again = store.read("edges").union(spark.createDataFrame(fresh, store.read("edges").schema))
    assert analyze.mute_edges(nodes, again, said).count() == 0


def test_new_messages_revise(spark, folder, tmp_path):
    store, some = Store(spark, str(tmp_path / "store")), [a for a in builtin.ANALYZERS if a.id in ("turn-pair-core", "tool-trajectory")]
    transcript(tmp_path / "t" / "app", "s1", ["make test"] * 3)
    transcript(tmp_path / "t" / "app", "s2", ["git status"] * 3, failing=False)
    assert store.sync("pi", str(tmp_path / "t")) == 18 and store.sync("pi", str(tmp_path / "t")) == 0
    first = analyze.analyze(store, some)
    transcript(tmp_path / "t" / "app", "s1", ["make test"] * 5)
    assert store.sync("pi", str(tmp_path / "t")) == 4
    second = analyze.analyze(store, some)
    assert first["tool-trajectory"]["sessions"] == 2 and second["tool-trajectory"]["sessions"] == 1
    assert store.read("edges").where("edge_kind = 'revises'").count() >= 1
    # a new version is stale, and computed anew only when asked for
    newer = [Analyzer(a.id, "9.0", a.compute) for a in some]
    assert all(v["sessions"] == 0 for v in analyze.analyze(store, newer).values())
    assert all(v["sessions"] == 2 for v in analyze.analyze(store, newer, revise=("major",)).values())
    # what is collected is missing again
    gone = run(store, "gc", "--analyzer", "tool-trajectory", "--apply")
    assert sum(r.n for r in gone) > 0 and analyze.analyze(store, newer, ("tool-trajectory",))["tool-trajectory"]["sessions"] == 2
    assert run(store, "retract", "--undo", gone[0].by_run) == f"{sum(r.n for r in gone)} nodes are back"


def test_a_failing_analyzer_leaves_errors_and_heals(spark, folder, tmp_path):
    store = Store(spark, str(tmp_path))
    store.sync("pi", str(folder))

    def broken(frames):
        raise ValueError("out of order")

    assert analyze.analyze(store, [Analyzer("x", "1.0", broken)])["x"]["failed"] == 2
    assert [json.loads(r.content_json)["error"] for r in store.nodes().where("node_kind = 'error'").collect()] == ["out of order"] * 2
    healed = analyze.analyze(store, [Analyzer("x", "1.0", builtin.cache_economy)])["x"]
    assert healed["sessions"] == 2 and "failed" not in healed and graph.live(store.nodes()).where("node_kind = 'summary'").count() == 2
