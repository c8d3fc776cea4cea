"""The shell parser, and the detectors on what it gives."""

import json

import pytest
from pyspark.sql import functions as F

from tracewright.operators import shell, trajectory

CASES = [
    ("ls -la /tmp", "ls", "/tmp", True, "ls -la /tmp"),
    ("git push origin main", "git push", "main", False, "git push main"),
    ("git push origin", "git push", "origin", False, "git push origin"),
    ("gh pr view 29 --json state", "gh pr view", "29", True, "gh pr view 29 --json"),
    ("gh pr create", "gh pr create", "", False, "gh pr create"),
    ("git status", "git status", "", True, "git status"),
    ("git log  --oneline -5", "git log", "", True, "git log --oneline -5"),
    ("git commit -m 'a message here'", "git commit", "a message here", False, "git commit a message here -m"),
    ("rm -rf 'a b' c", "rm", "a b", False, "rm -rf a b c"),
    ("  echo \"x 'y'\" z ", "echo", "x 'y'", True, "echo x 'y' z"),
    ("grep -r -i x .", "grep", "x", True, "grep -i -r x ."),
    ("cat", "cat", "", True, "cat"),
    ("stat x", "stat", "x", True, "stat x"),
    ("make", "make", "", False, "make"),
    ("say 'unclosed quote", "say", "unclosed quote", False, "say unclosed quote"),
    ("", "", "", False, ""),
]


@pytest.fixture(scope="module")
def parsed(spark):
    df = spark.createDataFrame([(k, "bash", json.dumps({"command": c[0]})) for k, c in enumerate(CASES)], "k int, tool string, a string")
    return {r.k: r for r in df.select("k", shell.call_of(F.col("tool"), F.col("a")).alias("c")).select("k", "c.*").collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_commands(parsed, k):
    _, subcommand, target, reads, args = CASES[k]
    assert (parsed[k].subcommand, parsed[k].target, parsed[k].read_only, parsed[k].args) == (subcommand, target, reads, args)


def test_tools(spark):
    rows = [("edit", '{"file_path":"/src/i.ts"}'), ("read", '{"file_path":"/a"}'), ("glob", '{"pattern":"*.ts"}'), ("write", "{}"), ("other", '{"b":1,"a":"x"}'), ("bash", None)]
    got = [tuple(r) for r in spark.createDataFrame(rows, "tool string, a string").select(shell.call_of(F.col("tool"), F.col("a")).alias("c")).select("c.*").collect()]
    assert got == [("edit /src/i.ts", False, "", "/src/i.ts"), ("read /a", True, "", "/a"), ("glob *.ts", True, "", "*.ts"), ("write", False, "", ""), ("a=x&b=1", False, "", ""), ("", True, "", "")]


def signals(spark, *calls):
    """Signals of a session's calls: (command or (tool, arguments), failed, cost)."""
    rows = []
    for k, (what, failed, *cost) in enumerate(calls):
        tool, arguments = ("bash", {"command": what}) if isinstance(what, str) else what
        rows.append(("s", k, f"m{k}", tool, json.dumps(arguments), failed, cost[0] if cost else None))
    stream = spark.createDataFrame(rows, "session_id string, ord int, message_id string, tool string, arguments string, is_error boolean, cost_usd double")
    return [(r.pattern, r.n, r.call_ids, r.cost_usd) for r in trajectory.signals(shell.calls(stream)).orderBy("first_ord", "pattern").collect()]


def test_stuck(spark):
    assert signals(spark, *[("make test", True, 0.5)] * 3) == [("stuck-loop", 3, ["m0", "m1", "m2"], 1.5)]
    assert signals(spark, *[("make test", True)] * 2) == [] and signals(spark, ("make", True), ("make", True), ("make", False)) == []
    assert signals(spark, *[("make test", True, 0.0)] * 3)[0][3] is None and signals(spark, ("make", True, 0.25), ("make", True), ("make", True))[0][3] == 0.25
    assert signals(spark, ("make", None), ("make", None), ("make", None)) == []  # no result is no failure


def test_polling(spark):
    assert signals(spark, *[("gh pr view 29 --json state", False)] * 3) == [("polling-loop", 3, ["m0", "m1", "m2"], None)]
    assert signals(spark, *[("git push origin main", False)] * 3) == []
    assert signals(spark, *[("git status", True)] * 3) == [("polling-loop", 3, ["m0", "m1", "m2"], None)]  # it is not stuck as well
    split = signals(spark, *[("git status", False)] * 3, ("make", False), *[("git status", False)] * 3)
    assert [x[:2] for x in split] == [("polling-loop", 3)] * 2


def test_oscillations(spark):
    assert signals(spark, ("git checkout a", False), ("git checkout b", False), ("git checkout a", False))[0][:3] == ("oscillation", 3, ["m0", "m1", "m2"])
    assert signals(spark, ("git push origin main", False), ("git push --force origin main", False))[0][:3] == ("oscillation", 2, ["m0", "m1"])
    assert signals(spark, ("git push origin main", False), *[(f"make x{k}", False) for k in range(12)], ("git push --force origin main", False)) == []


def test_gaps(spark):
    assert [x[0] for x in signals(spark, ("mv a.txt out/b.txt", True))] == ["pre-flight-gap"]
    assert signals(spark, ("mkdir out", False), ("mv a.txt out/b.txt", True)) == [] and signals(spark, ("mv a.txt out/b.txt", False)) == [] and signals(spark, ("mv a.txt b.txt", True)) == []
    assert [x[0] for x in signals(spark, (("write", {"file_path": "new/x.py"}), True))] == ["pre-flight-gap"]
    assert [x[0] for x in signals(spark, ("cp -r a deep/er/b", True), ("ls deep", False))] == ["pre-flight-gap"]
