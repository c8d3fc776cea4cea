"""Loops, polls, oscillations, gaps and chains in a session's sequence of tool calls.

Calls are (session_id, ord, call_id, tool, subcommand, target, args, read_only,
is_error, cost_usd); ``ord`` numbers them from 0 within the session.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.operators import shell
from tracewright.session import cut


@dataclass(frozen=True)
class Trajectory:
    stuck_min: int = 3
    polling_min: int = 3
    window: int = 10
    stuck: float = 0.3
    polling: float = 0.25
    oscillation: float = 0.35
    gap: float = 0.2


SAME = ("tool", "subcommand", "target")
SWITCHES = ("git checkout", "git switch")


def numbered(calls: DataFrame, *order: str) -> DataFrame:
    return calls.withColumn("ord", (F.row_number().over(Window.partitionBy("session_id").orderBy(*order)) - 1).cast("int"))


def islands(calls: DataFrame, *same: Column | str, run: str = "run") -> DataFrame:
    """``calls`` with ``run``: the number of the maximal run of equal ``same`` it lies in."""
    w = Window.partitionBy("session_id").orderBy("ord")
    key = F.struct(*same)
    return calls.withColumn("_new", (~F.lag(key).over(w).eqNullSafe(key)).cast("int")).withColumn(run, F.sum("_new").over(w).cast("int")).drop("_new")


def _priced(cost: Column) -> Column:
    """A sum of costs; null if none is recorded or they come to nothing."""
    return F.when(cost > 0, cost)


def loops(calls: DataFrame, config: Trajectory = Trajectory()) -> DataFrame:
    """Stuck loops (no call of the run succeeds) and polling loops (all read), of runs of the same tool, subcommand and target.

    A run all of whose calls poll is not reported as stuck too. Stretches that read are parts of a run, so one
    numbering of runs and parts and two folds, all by session, give both.
    """
    parts = islands(islands(calls, *SAME), *SAME, "read_only", run="part").groupBy("session_id", "run", "part").agg(
        F.min("ord").alias("first_ord"), F.count("*").cast("int").alias("n"), F.min_by("tool", "ord").alias("tool"), F.min_by("args", "ord").alias("args"), F.bool_and("is_error").alias("failed"),
        F.bool_and("read_only").alias("read"), F.sum("cost_usd").alias("cost_usd"), F.transform(F.array_sort(F.collect_list(F.struct("ord", "call_id"))), lambda x: x["call_id"]).alias("call_ids"),
    )
    parts = parts.withColumn("polls", F.col("read") & (F.col("n") >= config.polling_min))
    found = lambda name: F.struct(F.lit(name).alias("pattern"), "first_ord", "tool", "args", "n", "call_ids", _priced(F.col("cost_usd")).alias("cost_usd"))
    runs = parts.groupBy("session_id", "run").agg(
        F.sum("n").cast("int").alias("n"), F.min_by("tool", "first_ord").alias("tool"), F.min_by("args", "first_ord").alias("args"), F.bool_and("failed").alias("failed"), F.bool_and("polls").alias("polls"), F.sum("cost_usd").alias("cost_usd"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "call_ids"))), lambda x: x["call_ids"])).alias("call_ids"), F.collect_list(F.when(F.col("polls"), found("polling-loop"))).alias("polling"), F.min("first_ord").alias("first_ord"),
    )
    stuck = F.col("failed") & (F.col("n") >= config.stuck_min) & ~F.col("polls")
    return runs.select("session_id", F.explode(F.array_compact(F.concat(F.array(F.when(stuck, found("stuck-loop"))), "polling"))).alias("f")).select("session_id", "f.*")


def _inverse_key() -> Column:
    """What an action and its reversal share; null for actions without one."""
    base, rest = F.regexp_extract("args", r"^\s*(\S+)", 1), F.regexp_extract("args", r"^\s*\S+(?:\s+-\S+)*\s+([^-\s]\S*)", 1)
    of = lambda name, what: F.concat(F.lit(name + ":"), what)
    bash, target = F.col("tool") == "bash", F.col("target")
    return (
        F.when(F.col("subcommand").isin("git push", "git push --force"), of("git-push", target))
        .when(F.col("subcommand").isin(*SWITCHES), F.lit("git-checkout"))
        .when(F.col("subcommand").isin("git add", "git rm"), of("git-index", target))
        .when(bash & base.isin("mkdir", "rmdir", "rm"), of("mkdir-rm", rest))
        .when(bash & (base == "mv"), of("mv", rest))
        .when(F.col("tool") == "write", of("write", target))
    )


def oscillations(calls: DataFrame, config: Trajectory = Trajectory(), key: Column | None = None) -> DataFrame:
    """An action and its reversal within ``window`` calls: the same key and target with other arguments, or a switch away and back.

    The window is bounded, so partners are looked up with an equi-join on (session, key, coarse position) and never form all pairs of a session.
    """
    w = config.window
    marked = calls.withColumn("_key", key if key is not None else _inverse_key()).where("_key is not null")
    cell = lambda c: F.floor(F.col(c) / w).cast("int")
    later = marked.select("session_id", "_key", F.col("ord").alias("b_ord"), F.col("call_id").alias("b_id"), F.col("target").alias("b_target"), F.col("args").alias("b_args"), F.col("cost_usd").alias("b_cost")).withColumn("_cell", cell("b_ord"))
    first = marked.select("session_id", "_key", "ord", "call_id", "tool", "subcommand", "target", "args", "cost_usd").withColumn("_cell", F.explode(F.array(cell("ord"), cell("ord") + 1)))
    pairs = first.join(later, ["session_id", "_key", "_cell"]).where((F.col("b_ord") > F.col("ord")) & (F.col("b_ord") < F.col("ord") + w))
    switch = F.col("subcommand").isin(*SWITCHES)
    back = later.select("session_id", "_key", "_cell", F.col("b_ord").alias("c_ord"), F.col("b_id").alias("c_id"), F.col("b_target").alias("c_target"), F.col("b_cost").alias("c_cost"))
    away = pairs.where(switch & (F.col("target") != F.col("b_target")) & (F.col("target") != "")).drop("_cell").withColumn("_cell", F.explode(F.array(cell("ord"), cell("ord") + 1)))
    trips = (
        away.join(back, ["session_id", "_key", "_cell"])
        .where((F.col("c_target") == F.col("target")) & (F.col("c_ord") > F.col("b_ord")) & (F.col("c_ord") < F.col("ord") + w))
        .groupBy("session_id", "ord", "call_id", "b_ord", "b_id", "tool", "args", "b_args", "cost_usd", "b_cost")
        .agg(F.min(F.struct("c_ord", "c_id", "c_cost")).alias("c"))
    )
    cost = lambda *cs: _priced(sum((F.coalesce(c, F.lit(0.0)) for c in cs), F.lit(0.0)))
    two = pairs.where(~switch & (F.col("target") == F.col("b_target")) & (F.col("target") != "") & (F.col("args") != F.col("b_args"))).select(
        "session_id", F.lit("oscillation").alias("pattern"), F.col("ord").alias("first_ord"), "tool", F.concat("args", F.lit(" ↔ "), "b_args").alias("args"), F.lit(2).alias("n"),
        F.array("call_id", "b_id").alias("call_ids"), cost(F.col("cost_usd"), F.col("b_cost")).alias("cost_usd"),
    )
    three = trips.select(
        "session_id", F.lit("oscillation").alias("pattern"), F.col("ord").alias("first_ord"), "tool", F.concat("args", F.lit(" → "), "b_args").alias("args"), F.lit(3).alias("n"),
        F.array("call_id", "b_id", "c.c_id").alias("call_ids"), cost(F.col("cost_usd"), F.col("b_cost"), F.col("c.c_cost")).alias("cost_usd"),
    )
    return two.union(three)


def preflight_gaps(calls: DataFrame, directory: Column, makes: Column) -> DataFrame:
    """Failed calls into a ``directory`` that no earlier call ``makes``: a prefix minimum over each (session, directory) tells the first making call."""
    marked = calls.withColumns({"_dir": directory, "_made": makes})
    made = marked.where("_made is not null").groupBy("session_id", F.col("_made").alias("_dir")).agg(F.min("ord").alias("_first"))
    need = marked.where("is_error and _dir is not null and _dir <> '.'").join(made, ["session_id", "_dir"], "left").where("_first is null or _first > ord")
    return need.select("session_id", F.lit("pre-flight-gap").alias("pattern"), F.col("ord").alias("first_ord"), "tool", "args", F.lit(1).alias("n"), F.array("call_id").alias("call_ids"), _priced(F.col("cost_usd")).alias("cost_usd"))


def signals(calls: DataFrame, config: Trajectory = Trajectory()) -> DataFrame:
    """Loops, oscillations and pre-flight gaps of calls parsed by :mod:`tracewright.operators.shell`, which are computed once for all detectors."""
    calls = cut(calls)
    gaps = preflight_gaps(calls, shell.needs_directory(), shell.makes_directory())
    return loops(calls, config).unionByName(oscillations(calls, config)).unionByName(gaps)


def scores(signals: DataFrame, config: Trajectory = Trajectory()) -> DataFrame:
    """Per session: score (sum of the signals' weights, 1 at most), signals by pattern, cost (null if nothing is priced)."""
    weights = {"stuck-loop": config.stuck, "polling-loop": config.polling, "oscillation": config.oscillation, "pre-flight-gap": config.gap}
    weight = F.coalesce(*[F.when(F.col("pattern") == k, F.lit(v)) for k, v in weights.items()])
    return signals.groupBy("session_id").agg(
        F.round(F.least(F.lit(1.0), F.sum(weight)), 6).alias("score"),
        *[F.count_if(F.col("pattern") == k).alias("n_" + k.replace("-", "_")) for k in weights],
        F.round(F.sum("cost_usd"), 6).alias("cost_usd"),
    )


def chains(calls: DataFrame, revived: Column) -> DataFrame:
    """Maximal runs of revived results over all calls: (session_id, length, redundant_spawns, first_ord, last_ord, call_ids)."""
    runs = islands(calls.withColumn("_revived", F.coalesce(revived, F.lit(False))), "_revived").where("_revived")
    ids = F.transform(F.array_sort(F.collect_list(F.struct("ord", "call_id"))), lambda x: x["call_id"])
    return runs.groupBy("session_id", "run").agg(
        F.count("*").alias("length"), (F.count("*") - 1).alias("redundant_spawns"), F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), ids.alias("call_ids")
    ).drop("run")


def chain_histogram(chain_rows: DataFrame) -> DataFrame:
    return chain_rows.groupBy("length").agg(F.count("*").alias("n_chains"))


def delegated_usage(run_ids: DataFrame, runs: DataFrame) -> DataFrame:
    """One row: distinct ``run_id``s attributed, unattributed and without usage, and for each usage field its sum (null if never recorded) and its recording runs."""
    first = runs.groupBy("run_id").agg(F.first("usage").alias("usage"), F.lit(True).alias("_known"))
    joined = run_ids.select("run_id").distinct().join(first, "run_id", "left")
    fields = ("input", "output", "cacheRead", "cacheWrite", "costUsd")
    return joined.agg(
        F.count_if("_known").alias("attributed_runs"), F.count_if(F.col("_known").isNull()).alias("unattributed_runs"), F.count_if(F.col("_known") & F.col("usage").isNull()).alias("runs_without_usage"),
        *[c for f in fields for c in (F.sum(f"usage.{f}").alias(f), F.count(f"usage.{f}").alias(f"{f}_runs"))],
    )


def routing(turns: DataFrame, signals: DataFrame, easy_calls: int = 2, easy_context: int = 20_000, easy_edit: int = 2_000) -> DataFrame:
    """``turns`` (with message_ids, correction_type, n_calls, context_tokens, edit_chars) with ``route``: escalate, downshift or neutral.

    Whether a signal touches a turn is an equi-join on exploded message ids.
    """
    touched = signals.select("session_id", F.explode("call_ids").alias("_id")).distinct()
    each = turns.select("session_id", "turn_idx", F.explode("message_ids").alias("_id"))
    hard = each.join(touched, ["session_id", "_id"], "left_semi").select("session_id", "turn_idx").distinct().withColumn("_hit", F.lit(True))
    easy = (F.col("n_calls") <= easy_calls) & (F.col("context_tokens") <= easy_context) & (F.col("edit_chars") <= easy_edit)
    is_hard = F.col("correction_type").isNotNull() | F.col("_hit").isNotNull()
    return turns.join(hard, ["session_id", "turn_idx"], "left").withColumn("route", F.when(is_hard, "escalate").when(easy, "downshift").otherwise("neutral")).drop("_hit")
