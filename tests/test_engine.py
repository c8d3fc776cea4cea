"""Invariants and small cases of the operators."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.functions import keys
from tracewright.operators import digest, economy, failures, graph, lexicon, proposals, search, trajectory, turns
from tracewright.plans import callers, registry

CALL = "session_id string, ord int, call_id string, tool string, subcommand string, target string, args string, read_only boolean, is_error boolean, cost_usd double"


def calls(spark, rows):
    return spark.createDataFrame([("s", k, f"c{k}", *r) for k, r in enumerate(rows)], CALL)


def python_loops(rows):
    """(pattern, first, n) by a plain scan."""
    out = []
    for pattern, same, ok in (("stuck-loop", lambda r: r[:3], lambda run: all(r[5] for r in run)), ("polling-loop", lambda r: (*r[:3], r[4]), lambda run: all(r[4] for r in run))):
        k = 0
        while k < len(rows):
            n = k
            while n < len(rows) and same(rows[n]) == same(rows[k]):
                n += 1
            if n - k >= 3 and ok(rows[k:n]):
                out.append((pattern, k, n - k))
            k = n
    polled = {i for p, k, n in out if p == "polling-loop" for i in range(k, k + n)}
    return sorted(x for x in out if x[0] == "polling-loop" or not set(range(x[1], x[1] + x[2])) <= polled)


@pytest.mark.parametrize("seed", range(4))
def test_loops_against_a_scan(spark, seed):
    r = random.Random(seed)
    rows = [(r.choice("ab"), "", r.choice("xy"), str(r.random()), r.random() < 0.7, r.random() < 0.8, None) for _ in range(300)]
    got = sorted((x.pattern, x.first_ord, x.n) for x in trajectory.loops(calls(spark, rows)).collect())
    assert got == python_loops(rows)


def test_oscillation_needs_the_way_back(spark):
    git = lambda target: ("bash", "git checkout", target, f"git checkout {target}", False, False, None)
    found = trajectory.oscillations(calls(spark, [git("a"), git("b"), git("a"), git("c")])).collect()
    assert [(x.first_ord, x.n, x.call_ids) for x in found] == [(0, 3, ["c0", "c1", "c2"])]
    push = lambda args, cost: ("bash", "git push", "o", args, False, False, cost)
    found = trajectory.oscillations(calls(spark, [push("x", 1.0), push("x", None), push("y", None)])).collect()
    assert sorted((x.first_ord, x.cost_usd) for x in found) == [(0, 1.0), (1, None)]


def test_oscillation_window(spark):
    filler = ("read", "", "f", "f", True, False, None)
    far = [("write", "", "t", "1", False, False, None), *[filler] * 9, ("write", "", "t", "2", False, False, None)]
    assert trajectory.oscillations(calls(spark, far)).count() == 0 and trajectory.oscillations(calls(spark, far[:1] + far[2:])).count() == 1


def test_gaps(spark):
    rows = [("bash", "mkdir", "", "mkdir d", False, False, None), ("write", "", "d/x", "", False, True, None), ("write", "", "e/x", "", False, True, 2.0), ("write", "", "y", "", False, True, None)]
    folder = F.when(F.col("target").contains("/"), F.regexp_replace("target", "/[^/]*$", "")).otherwise(".")
    made = F.when(F.col("subcommand") == "mkdir", F.regexp_extract("args", r"mkdir\s+(\S+)", 1))
    assert [(r.first_ord, r.cost_usd) for r in trajectory.preflight_gaps(calls(spark, rows), folder, made).collect()] == [(2, 2.0)]


MESSAGE = "session_id string, seq int, id string, role string, content_text string, n_calls int, n_failures int, result_bytes int"


def test_friction(spark):
    rows = [
        ("s", 0, "x", "system", "early", 0, 0, 0), ("s", 1, "u1", "user", "please fix the login form", 0, 0, 0), ("s", 2, "a1", "assistant", "done", 1, 2, 30_000),
        ("s", 3, "u2", "user", "No, use another one", 0, 0, 0), ("s", 4, "a2", "assistant", "  ", 0, 0, 0), ("s", 5, "u3", "user", "fix the login now", 0, 0, 0), ("s", 6, "t", "toolResult", "out", 0, 9, 0), ("s", 7, "u4", "user", "nothing special", 0, 0, 0), ("s", 8, "a4", "assistant", "ok", 0, 0, 0),
    ]
    got = {r.turn_idx: r for r in turns.friction(turns.turn_pairs(spark.createDataFrame(rows, MESSAGE))).collect()}
    assert [got[k].correction_type for k in range(4)] == [None, "explicit", None, None]
    assert got[0].friction_score == 0.65 and got[0].waste_bytes == 10_000 and got[0].message_ids == ["u1", "a1"]
    assert got[1].friction_score == 0.9 and got[1].is_empty and got[2].friction_score == 1.0 and got[2].message_ids == ["u3", "t"]
    flags = turns.session_flags(turns.friction(turns.turn_pairs(spark.createDataFrame(rows, MESSAGE)))).first()
    assert flags.n_turns == 4 and flags.n_corrections == 1 and not flags.clean_recovery


def test_repetition(spark):
    rows = [("s", 0, "a", "user", "rename module alpha", 0, 0, 0), ("s", 1, "b", "user", "rename the module", 0, 0, 0)]
    got = turns.friction(turns.turn_pairs(spark.createDataFrame(rows, MESSAGE))).where("turn_idx = 1").first()
    assert got.correction_type == "repetition" and got.correction_patterns == []


def test_unpriced_is_not_free(spark):
    rows = [("s", 1, "a", "assistant", 100, 5, 0, 0, None, "m", "p1"), ("s", 2, "b", "assistant", 100, 5, 0, 0, None, "m", "p1"), ("s", 3, "c", "assistant", None, None, None, None, 0.5, "m", None)]
    df = spark.createDataFrame(rows, "session_id string, seq int, id string, role string, input long, output long, cache_read long, cache_write long, cost_usd double, model string, provider_message_id string").withColumn("ts", F.timestamp_seconds("seq"))
    units = economy.token_units(df).first()
    assert units.calls == 2 and units.input == 100 and units.mite == round(175 / 1e6, 9)
    assert economy.cache_economy(economy.cache_classes(df)).first().cold_cost_usd is None


def test_carry_stops_at_compaction(spark):
    rows = [("s", 1, False, False, 350), ("s", 2, True, False, None), ("s", 3, True, True, None), ("s", 4, True, False, None), ("s", 5, False, False, 35)]
    df = spark.createDataFrame(rows, "session_id string, seq int, billed boolean, compaction boolean, text_length int").withColumn("tool", F.lit("read"))
    got = {r.seq: (r.turns_after, r.carry) for r in economy.carry(df).collect()}
    assert got == {1: (2, 200.0), 5: (0, 0.0)}


NODE = "id string, analyzer_id string, version string, config_fingerprint string, source_set_hash string, input_key string, output_key string, node_kind string, content_json string, created_at timestamp, retracted_at timestamp, retracted_by_run string"


def test_incremental_runs(spark):
    node = spark.createDataFrame([("n1", "a", "1.0", "c", "S1", "k1", "o1", "metric", "{}", None, None, None), ("n2", "a", "1.0", "c", "S2", "k2", "o2", "metric", "{}", None, None, None), ("n3", "a", "1.0", "c", "S3", "k3", "o3", "error", "{}", None, None, None)], NODE)
    unit = spark.createDataFrame([("a", "1.0", "c", "S1", "k1"), ("a", "2.0", "d", "S2", "k9"), ("a", "1.0", "c", "S3", "k3"), ("a", "1.0", "c", "S3", "k3")], "analyzer_id string, version string, config_fingerprint string, source_set_hash string, input_key string")
    got = graph.classify(unit, node)
    assert sorted((r.input_key, r.status, r.reasons) for r in got.dropDuplicates(["input_key"]).collect()) == [("k1", "current", None), ("k3", "missing", None), ("k9", "stale", ["major", "config"])]
    assert {r.input_key for r in graph.wanted(got).collect()} == {"k3"} and {r.input_key for r in graph.wanted(got, ("minor",)).collect()} == {"k3", "k9"}
    fresh = node.withColumn("input_key", F.when(F.col("id") == "n1", "k1").otherwise(F.col("id")))
    assert {r.id for r in graph.append(node, fresh).collect()} == {"n2", "n3"}


def test_time_travel_and_undo(spark):
    rows = [("n1", "2024-01-01", "2024-03-01"), ("n2", "2024-02-01", None)]
    node = spark.createDataFrame(rows, "id string, created_at string, retracted_at string").select("id", F.col("created_at").cast("timestamp"), F.col("retracted_at").cast("timestamp"), F.lit(None).cast("string").alias("retracted_by_run"))
    at = lambda t: {r.id for r in graph.as_of(node, F.lit(t).cast("timestamp")).collect()}
    assert at("2024-01-15") == {"n1"} and at("2024-02-15") == {"n1", "n2"} and at("2024-04-01") == {"n2"}
    gone = graph.retract(node, graph.live(node), F.lit("2024-05-01").cast("timestamp"), "gc1")
    assert graph.live(gone).count() == 0 and {r.id for r in graph.live(graph.undo(gone, "gc1")).collect()} == {"n2"}
    assert {r.id for r in graph.purge(gone, F.lit("2024-04-01").cast("timestamp")).collect()} == {"n2"}


def test_keys(spark):
    assert keys.canonical('{"b": 1.0, "a": [2, {"d": 1, "c": "é"}]}') == '{"a":[2,{"c":"é","d":1}],"b":1}' and keys.canonical("no json") == "no json"
    df = spark.createDataFrame([("k", '{"b":1,"a":2}')], "input_key string, content_json string")
    sound = df.withColumn("output_key", keys.output_key(F.col("input_key"), F.lit('{"a":2,"b":1}')))
    assert graph.tampered(sound).count() == 0 and graph.tampered(sound.withColumn("content_json", F.lit('{"a":3}'))).count() == 1
    assert spark.range(1).select(keys.labelled("config", F.lit("{}"))).first()[0] == "9ee1e727eb5043e4"


def test_proposals(spark):
    content = '{"proposals":[{"title":" T ","severity":"Waste","confidence":1.5,"message_ids":["m"]},{"title":" "}]}'
    node = spark.createDataFrame([("n", "s", "a", "o", content)], "id string, session_id string, analyzer_id string, output_key string, content_json string").withColumn("created_at", F.current_timestamp())
    known = spark.createDataFrame([], "input_key string")
    made = proposals.materialise(node, known)
    row = made.first()
    assert made.count() == 1 and (row.title, row.severity, row.confidence, row.status) == ("T", "waste", 1.0, "open")
    assert proposals.materialise(node, made.select("input_key")).count() == 0
    decided = proposals.decide(made, made.select("input_key", F.lit("d").alias("id"), F.lit("rejected").alias("verdict"), F.lit(1).alias("decided_at")))
    assert decided.first().status == "rejected"


@pytest.mark.parametrize("query, ids", [("alpha beta", {1, 2}), ('"alpha beta"', {1}), ("alp*", {1, 2, 3}), ("alpha NOT beta", {3}), ("(gamma OR beta) AND alpha", {1, 2}), ("NEAR(alpha beta, 1)", {1, 2}), ("NEAR(beta alpha, 0)", {1}), ("title:beta", {4}), ("nothing", set())])
def test_search(spark, query, ids):
    docs = spark.createDataFrame([(1, "Alpha beta", ""), (2, "beta x alpha", ""), (3, "alpha", ""), (4, "gamma", "beta"), (5, None, None)], "id int, body string, title string")
    idx = search.index(docs, "id", ("body", "title"))
    assert {r.doc_id for r in search.search(idx, query, *search.statistics(idx)).collect()} == ids


@pytest.mark.parametrize("bad", ["(alpha", "alpha )", "AND", ""])
def test_search_errors(bad):
    with pytest.raises(ValueError):
        search.parse(bad)


def test_words():
    assert lexicon.words_of("Don't panic! see `code` and http://x.y/z or a.b.c snake_case 👍 abc1 x") == ["don't", "panic", "see", "and", "or", "👍"]
    assert lexicon.markers_of("WHY WOULD THIS FAIL") == ["shouting"] and lexicon.markers_of("whaaat??") == ["repeated_punctuation", "elongation"] and lexicon.markers_of("an API and a URL") == [] and lexicon.words_of(None) == []


def test_failures(spark):
    rows = [("429 Too Many Requests", ""), ("Prompt tokens limit exceeded 402", ""), ("", "x"), (None, None)]
    df = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in df.select(failures.turn_failure(F.col("t"))["class_id"]).collect()] == ["rate-limit", "context-overflow", "unclassified", "unclassified"]
    rows = [("", "cd x && grep y z"), ("out\nfatal: no", ""), ("x\n  at f (a.js:1:2)\ny", ""), ("foo: bar\nmore", ""), ("more\nfoo: bar\n", ""), ("fine", "make")]
    df = spark.createDataFrame(rows, "t string, c string")
    assert [r[0] for r in df.select(failures.tool_failure(F.col("t"), F.col("c"))["class_id"]).collect()] == ["exit-status-signal", "command-failed", "script-error", "command-failed", "command-failed", "unclassified"]
    child = spark.createDataFrame([("spawn pi ENOENT", 1, 2, 2), (None, 0, 2, 2), (None, 3, 1, 0), (None, 0, 1, 0)], "e string, x int, n int, f int")
    assert [r[0] for r in child.select(failures.child_failure(F.col("e"), F.col("x"), F.col("n"), F.col("f"))["class_id"]).collect()] == ["spawn-failure", "model-attempt-exhaustion", "child-nonzero-exit", None]


def test_digest_packing(spark):
    df = spark.createDataFrame([("s", k, "x" * n) for k, n in enumerate((4, 4, 4, 20, 1))], "session_id string, turn_idx int, line string")
    assert [r.segment for r in digest.packed(df, size=10).orderBy("turn_idx").collect()] == [0, 0, 1, 2, 3]


def test_registry(tmp_path):
    make = lambda i, *d: registry.Analyzer(i, "1.0", lambda frames: i, d)
    assert [a.id for a in registry.ordered([make("b", "a"), make("a")])] == ["a", "b"]
    with pytest.raises(ValueError, match="cycle"):
        registry.ordered([make("a", "b"), make("b", "a")])
    assert registry.run([make("a"), make("b", "a"), make("c")], {}, ("b",)) == {"a": "a", "b": "b"}
    assert registry.grade("2.0", "1.9") == "major" and registry.grade("1.1", "1.0") == "minor" and registry.grade("1.0", "1.0") is None and registry.grade("0.9", "1.0") is None
    with pytest.raises(ValueError):
        registry.resolve("a:nope", [make("a")])
    (tmp_path / "x.py").write_text("from tracewright.plans.registry import Analyzer\ndef f(frames):\n    return 1\nANALYZER = Analyzer('mine', '1.0', f)\n")
    assert registry.load(tmp_path / "x.py").id == "mine"


def test_callers(spark):
    tries = []

    def flaky(prompt):
        tries.append(prompt)
        if len(tries) < 3:
            raise callers.Unavailable("busy")
        return "ok"

    assert callers.retried(flaky, sleep=lambda s: None)("p") == "ok" and len(tries) == 3
    got = callers.answers(spark.createDataFrame([("k", "p")], "key string, prompt string"), callers.refuse).first()
    assert got.answer is None and "no model" in got.error


def test_touches(spark):
    from tracewright.operators import touches

    stream = spark.createDataFrame(
        [("s", 0, 1, "read", '{"path":"a"}', "r1", False), ("s", 1, 2, "read", '{"file_path":"a"}', "r2", False), ("s", 2, 3, "write", '{"path":"b","content":"x"}', None, None), ("s", 3, 4, "bash", '{"command":"ls"}', None, None), ("s", 4, 5, "skill", '{"name":"k"}', None, None)],
        "session_id string, ord int, seq int, tool string, arguments string, result_message_id string, is_error boolean",
    )
    messages = spark.createDataFrame([("r1", "one", [1]), ("r2", "two results", [1, 2])], "id string, content_text string, tool_results array<int>")
    got = {(r.ord, r.path): r.content for r in touches.file_touches(stream, messages).collect()}
    assert got == {(0, "a"): "one", (1, "a"): None, (2, "b"): "x"}
    assert [(r.path, r.n) for r in touches.repeated_reads(stream).collect()] == [("a", 2)]
    results = spark.createDataFrame([("s", 9, 100.4, 50.0, "read"), ("s", 2, 7.0, 5.0, "bash")], "session_id string, seq int, tokens double, carry double, tool string")
    assert [tuple(r) for r in touches.skill_use(stream, results, threshold=100).collect()] == [("s", "k", 1, 100, True)]
    billed = spark.createDataFrame([("s", 11), ("t", 0)], "session_id string, output int")
    assert {r.session_id: r.amplification for r in touches.read_amplification(results, billed).collect()} == {"s": 5, "t": None}


def test_command_line(spark, tmp_path, capsys):
    import json

    from tracewright.__main__ import main

    (tmp_path / "p").mkdir()
    lines = [{"type": "session", "id": "s"}, {"type": "message", "id": "m", "message": {"role": "user", "content": "alpha beta"}}]
    (tmp_path / "p" / "a.jsonl").write_text("\n".join(map(json.dumps, lines)))
    store = str(tmp_path / "store")
    main(["sync", store, "pi", str(tmp_path)])
    main(["sync", store, "pi", str(tmp_path)])
    main(["search", store, "alpha"])
    main(["analyzers", store])
    main(["run", "muted_terms", "/root/testdata/sf0.001", "--html", str(tmp_path / "x.html")])
    main(["queries"])
    out = capsys.readouterr().out
    assert "1 new messages\n0 new messages" in out and "content_text" in out and "turn_friction" in out and "<table>" in (tmp_path / "x.html").read_text()


def test_advice(spark):
    from tracewright.operators import advice

    eco = spark.createDataFrame([("s", 1, 0, 1, 5, 0.5), ("t", 0, 0, 0, 0, None)], "session_id string, n_cold_start long, n_cold_ttl long, n_cold_prefix long, churn_tokens long, cold_cost_usd double")
    got = advice.cache(eco).collect()
    assert {(r.session_id, r.title) for r in got} == {("s", "Keep the prompt cache warm"), ("s", "The prompt's prefix changes"), ("s", "Cached tokens are never read")}
    assert {r.cost_usd for r in got} == {0.5, None}
    results = spark.createDataFrame([("u", 6e6), ("s", 9e6)], "session_id string, carry double")
    cycles = spark.createDataFrame([("s", True, False, 2_000_000, 10)], "session_id string, fired_too_late boolean, fired_too_often boolean, carry_avoided long, rebuild_tokens long")
    assert {(r.session_id, r.title) for r in advice.compaction(cycles, results).collect()} == {("s", "Compact earlier"), ("u", "Compact long sessions")}
    mix = spark.createDataFrame([("m", 30, 0.5), ("n", 5, 0.9)], "model string, turns long, escalation_rate double")
    assert [r.detail for r in advice.models(mix, spark.createDataFrame([("a", "b")], "model string, by string")).collect()] == ["a is no better than b", "m"]


def test_listing_and_remediation(spark):
    rows = [("p1", "k1", "open", "waste", "s", 1.0), ("p2", "k2", "applied", "waste", "s", None), ("p3", "k3", "open", "friction", "t", 2.0)]
    df = spark.createDataFrame(rows, "id string, input_key string, status string, severity string, session_id string, cost_usd double").withColumns({"validation_status": F.lit(None).cast("string"), "validated_score": F.lit(None).cast("double"), "created_at": F.lit(0)})
    ids = lambda **f: [r.id for r in proposals.listed(df, **f).collect()]
    assert ids() == ["p3", "p1", "p2"] and ids(status="open", severity="waste") == ["p1"] and ids(limit=1, offset=1) == ["p1"]
    assert ids(sources=spark.createDataFrame([("t",)], "session_id string")) == ["p3"]
    done = spark.createDataFrame([("k1", "done", "x", 1), ("k2", "planned", None, 1), ("k2", "done", "y", 2)], "input_key string, disposition string, actual_change string, decided_at int")
    assert {r.id: (r.disposition, r.actual_change) for r in proposals.remediate(df, done).collect()} == {"p1": (None, None), "p2": ("done", "y"), "p3": (None, None)}
    log = spark.createDataFrame([("k1", "rejected", 1), ("k1", "accepted", 2)], "input_key string, verdict string, decided_at int")
    assert [r.verdict for r in proposals.active(proposals.upsert(proposals.from_decisions(log))).collect()] == ["accepted"]


def test_incremental_index(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, body string")
    idx = search.index(docs.where("id = 1"), "id", ("body",))
    more = search.extend(idx, docs, "id", ("body",))
    assert {r.doc_id for r in more.collect()} == {2}
    both = idx.unionByName(more)
    assert {r.doc_id for r in search.search(both, "b", *search.statistics(both)).collect()} == {1, 2}
    assert {r.doc_id for r in search.without(both, spark.createDataFrame([(1,)], "doc_id int")).collect()} == {2}


def test_model_analyzers(spark):
    from tracewright.plans import overview

    rows = [("s", 0, "u0", "fix it", "ok", None), ("s", 1, "u1", "test it", "ok", None)]
    df = spark.createDataFrame(rows, "session_id string, turn_idx int, user_message_id string, user_text string, assistant_text string, correction_type string")
    got = {(r.user_message_id, r["class"]) for r in overview.request_classes(df, lambda p: "1: bugs, tests\n2: tests").collect()}
    assert got == {("u0", "bugs"), ("u0", "tests"), ("u1", "tests")}
    assert {r.label for r in overview.classify_turns(df, lambda p: p[:7]).collect()} == {"U: fix ", "U: test"}
    long_ = spark.range(200).select(F.lit("l").alias("session_id"), F.col("id").cast("int").alias("turn_idx"), F.lit("x" * 100).alias("line"))
    lines = digest.lines(df).union(long_)
    assert {r.session_id: r.overview for r in overview.overviews(lines, lambda p: str(len(p.split("\n")))).collect()} == {"s": "2", "l": "4"}


def test_correction_text(spark):
    texts = ["stop using tabs, and be quick", "no thanks", "please use spaces", "revert", "fine work"]
    rows = spark.createDataFrame([(f"s{k}", 0, x, None, "", 0, 0, 0) for k, x in enumerate(texts)], "session_id string, turn_idx int, user_text string, prior_user_text string, assistant_text string, n_calls int, n_failures int, result_bytes bigint")
    got = {r.user_text: (r.correction_type, r.correction_text) for r in turns.correction_text(turns.friction(rows)).collect()}
    assert got == {texts[0]: ("explicit", "tabs, and be quick"), texts[1]: ("explicit", "no thanks"), texts[2]: ("implicit", "spaces"), texts[3]: ("explicit", "revert"), texts[4]: (None, None)}
