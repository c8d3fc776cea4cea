"""Turns, friction and tool sequences."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright import views
from tracewright.functions.patterns import LEADING, STRONG, WEAK, any_of
from tracewright.operators import shell, stats, trajectory, turns
from tracewright.sources import transcripts
from tracewright.views import with_views


def _friction(spark, sf_dir):
    return turns.friction(turns.turn_pairs(views.messages(spark, sf_dir)))


def turn_pairs(spark, sf_dir):
    return turns.turn_pairs(views.messages(spark, sf_dir)).select("session_id", "turn_idx", "user_message_id", "user_text", "assistant_text", "prior_user_text", F.size("message_ids").alias("n_messages"))


def turn_friction(spark, sf_dir):
    return _friction(spark, sf_dir).select("session_id", "turn_idx", "correction_type", "is_empty", "friction_score", "high_signal")


def session_flags(spark, sf_dir):
    return turns.session_flags(_friction(spark, sf_dir))


def smooth_siblings(spark, sf_dir):
    sessions = views.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.concat(F.lit("dir"), F.col("conv_id") % 10).alias("cwd")).distinct()
    return turns.smooth_siblings(turns.session_flags(_friction(spark, sf_dir)), sessions)


def _calls(spark, sf_dir):
    return trajectory.numbered(views.calls(spark, sf_dir), "ts", "call_id")


def trajectory_loops(spark, sf_dir):
    return trajectory.loops(_calls(spark, sf_dir)).select("session_id", "pattern", "first_ord", "tool", "n", F.round("cost_usd", 4).alias("cost_usd"))


def _swings(calls):
    return trajectory.oscillations(calls, key=F.when(F.col("tool").isin("purchase", "signup"), F.concat("tool", F.lit(":"), "target")))


def trajectory_oscillations(spark, sf_dir):
    return _swings(_calls(spark, sf_dir)).select("session_id", "first_ord", "tool", "args", "n", F.round("cost_usd", 4).alias("cost_usd"))


def trajectory_gaps(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    return trajectory.preflight_gaps(calls, F.col("args"), F.when(F.col("tool") == "signup", F.col("args"))).select("session_id", "first_ord", "tool", "args")


def trajectory_scores(spark, sf_dir):
    calls = _calls(spark, sf_dir)
    gaps = trajectory.preflight_gaps(calls, F.col("args"), F.when(F.col("tool") == "signup", F.col("args")))
    return trajectory.scores(trajectory.loops(calls).unionByName(_swings(calls)).unionByName(gaps))


#: Commands that stand in for events, with what the parser makes of them: (command, args, subcommand, target, reads, what it shares with its reversal, folder needed, folder made).
COMMANDS = (
    ("git status", "git status", "git status", "", True, None, None, None),
    ("ls  -la 'src'", "ls -la src", "ls", "src", True, None, None, None),
    ("mkdir build/out", "mkdir build/out", "mkdir", "build/out", False, "mkdir-rm:build/out", None, "build/out"),
    ("rm -r build/out", "rm -r build/out", "rm", "build/out", False, "mkdir-rm:build/out", None, None),
    ('mv a.txt "build/out/b.txt"', "mv a.txt build/out/b.txt", "mv", "a.txt", False, "mv:a.txt", "build/out", None),
    ("git push origin main", "git push main", "git push", "main", False, "git-push:main", None, None),
    ("git push --force origin main", "git push main --force", "git push", "main", False, "git-push:main", None, None),
    (" make test", "make test", "make", "test", False, None, None, None),
)


def _transcripts(spark, sf_dir):
    """Events as lines of transcripts: a header for each user, then a call of the shell and its result for each event, in stretches of four of a command."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    rows = views.table(spark, sf_dir, "events").withColumn("ord", F.row_number().over(order) - 1).withColumn("stretch", F.floor(F.col("ord") / 4))
    command = F.element_at(F.array(*[F.lit(c[0]) for c in COMMANDS]), ((F.col("stretch") * 5 + F.col("user_id")) % len(COMMANDS) + 1).cast("int"))
    ident = F.col("event_id").cast("string")
    call = F.struct(F.lit("toolCall").alias("type"), ident.alias("id"), F.lit("bash").alias("name"), F.struct(command.alias("command")).alias("arguments"))
    text = F.struct(F.lit("text").alias("type"), F.lit("done").alias("text"))
    said = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("m"), ident).alias("id"), F.struct(F.lit("assistant").alias("role"), F.array(call).alias("content")).alias("message")))
    got = F.struct(F.lit("toolResult").alias("role"), ident.alias("toolCallId"), F.lit("bash").alias("toolName"), (F.col("stretch") % 3 == 0).alias("isError"), F.array(text).alias("content"))
    answer = F.to_json(F.struct(F.lit("message").alias("type"), F.concat(F.lit("r"), ident).alias("id"), got.alias("message")))
    head = F.when(F.col("ord") == 0, F.to_json(F.struct(F.lit("session").alias("type"), F.col("user_id").cast("string").alias("id"))))
    lines = rows.select("user_id", "ord", F.posexplode(F.array(head, said, answer)).alias("k", "line")).where("line is not null")
    return lines.select(F.concat(F.lit("p/"), F.col("user_id").cast("string"), F.lit(".jsonl")).alias("file_path"), F.lit("p").alias("project"), F.col("user_id").cast("string").alias("stem"), F.lit(None).cast("timestamp").alias("modified"), (F.col("ord") * 3 + F.col("k")).alias("line_no"), "line")


def transcript_signals(spark, sf_dir):
    """From transcript lines to signals: reader, calls with their results, shell parser, detectors."""
    calls = shell.calls(transcripts.tool_stream(transcripts.pi_messages(_transcripts(spark, sf_dir))))
    return trajectory.signals(calls).select(F.col("session_id").cast("bigint").alias("session_id"), "pattern", "first_ord", "tool", "args", "n")


def transcript_calls(spark, sf_dir):
    """The calls of transcript lines as the detectors read them."""
    calls = shell.calls(transcripts.tool_stream(transcripts.pi_messages(_transcripts(spark, sf_dir))))
    return calls.select(F.col("session_id").cast("bigint").alias("session_id"), "ord", "call_id", "subcommand", "target", "args", "read_only", "is_error")


def revive_chains(spark, sf_dir):
    return trajectory.chains(_calls(spark, sf_dir), F.col("tool") == "error").drop("call_ids")


def chain_histogram(spark, sf_dir):
    return trajectory.chain_histogram(trajectory.chains(_calls(spark, sf_dir), F.col("tool") == "error"))


def routing(spark, sf_dir):
    found = _friction(spark, sf_dir).withColumns({"context_tokens": F.length("assistant_text") * 100, "edit_chars": F.length("user_text")})
    # a signal for each session's longest answer stands in for loops
    signals = found.groupBy("session_id").agg(F.max_by("message_ids", F.struct(F.length("assistant_text"), "turn_idx")).alias("call_ids"))
    return trajectory.routing(found, signals).select("session_id", "turn_idx", "route")


def message_stats(spark, sf_dir):
    return stats.message_stats(views.messages(spark, sf_dir))


QUERIES = {f.__name__: f for f in (turn_pairs, turn_friction, session_flags, smooth_siblings, trajectory_loops, trajectory_oscillations, trajectory_gaps, trajectory_scores, transcript_signals, transcript_calls, revive_chains, chain_histogram, routing, message_stats)}

_TURNS = """
seg AS (SELECT *, sum((role IN ('user', 'bashExecution', 'branch_summary', 'custom_message'))::INT) OVER (PARTITION BY session_id ORDER BY seq) - 1 AS turn_idx FROM messages),
tp0 AS (SELECT session_id, turn_idx::INT AS turn_idx, min_by(id, seq) FILTER (role = 'user') AS user_message_id, min_by(content_text, seq) FILTER (role = 'user') AS user_text,
    coalesce(string_agg(content_text, chr(10) ORDER BY seq) FILTER (role = 'assistant'), '') AS assistant_text, count(*) FILTER (role IN ('user', 'assistant', 'toolResult'))::INT AS n_messages,
    sum(n_calls)::BIGINT AS n_calls, sum(n_failures)::BIGINT AS n_failures, sum(result_bytes)::BIGINT AS result_bytes,
    list(id ORDER BY seq) FILTER (role IN ('user', 'assistant', 'toolResult')) AS message_ids FROM seg WHERE turn_idx >= 0 GROUP BY 1, 2),
tp AS (SELECT *, lag(user_text) OVER (PARTITION BY session_id ORDER BY turn_idx) AS prior_user_text FROM tp0)"""
_TOKENS = "list_distinct(list_filter(regexp_split_to_array(lower({}), '[^A-Za-z0-9_]+'), lambda t: length(t) > 2))"
_q = lambda p: p.replace("'", "''")
_FRICTION = f"""{_TURNS},
fr0 AS (SELECT *, CASE WHEN length(user_text) <= 80 AND len(list_intersect({_TOKENS.format("user_text")}, {_TOKENS.format("prior_user_text")})) >= 2 THEN 'repetition'
    WHEN regexp_matches(user_text, '{_q(any_of(STRONG))}') THEN 'explicit' WHEN regexp_matches(user_text, '{_q(any_of(WEAK))}') THEN 'implicit'
    WHEN regexp_matches(user_text, '{_q(any_of(LEADING))}') THEN 'explicit' END AS correction_type, trim(assistant_text) = '' AND n_calls = 0 AS is_empty FROM tp),
fr1 AS (SELECT *, round(least(1.0, 0.6 * (correction_type IS NOT NULL)::INT + 0.25 * least(n_failures, 3) + 0.3 * is_empty::INT + 0.15 * (result_bytes > 20000)::INT)::DOUBLE, 6) AS friction_score FROM fr0),
fr AS (SELECT *, friction_score >= 0.5 AS high_signal FROM fr1)"""
_FLAGS = f"""{_FRICTION},
nx AS (SELECT *, lead(turn_idx) OVER w AS nt, lead(correction_type) OVER w AS nc, lead(high_signal) OVER w AS nh FROM fr WINDOW w AS (PARTITION BY session_id ORDER BY turn_idx)),
flags AS (SELECT session_id, count(*) AS n_turns, count(correction_type) AS n_corrections, count(*) FILTER (n_failures > 0) AS n_failing, count(*) FILTER (high_signal) AS n_high,
    coalesce(bool_or(correction_type IS NOT NULL AND nt IS NOT NULL AND nc IS NULL AND NOT nh), false) AS clean_recovery, count(correction_type) = 0 AS completed_without_correction, count(*) FILTER (n_failures > 0) * 2 < count(*) AS low_failure_density FROM nx GROUP BY 1)"""
_NUM = "num AS (SELECT *, (row_number() OVER (PARTITION BY session_id ORDER BY ts, call_id) - 1)::INT AS ord FROM calls)"


def _runs(name: str, keys: str) -> str:
    return f"""{name}0 AS (SELECT *, (struct_pack({keys}) IS DISTINCT FROM lag(struct_pack({keys})) OVER (PARTITION BY session_id ORDER BY ord))::INT AS fresh FROM num),
{name}1 AS (SELECT *, sum(fresh) OVER (PARTITION BY session_id ORDER BY ord) AS run FROM {name}0),
{name} AS (SELECT session_id, run, min(ord) AS first_ord, max(ord) AS last_ord, count(*)::INT AS n, min_by(tool, ord) AS tool, min_by(args, ord) AS args, bool_and(is_error) AS all_failed, bool_and(read_only) AS all_read, sum(cost_usd) AS cost_usd, list(call_id) AS ids FROM {name}1 GROUP BY 1, 2)"""


_LOOPS = f"""{_NUM}, {_runs("sr", "a := tool, b := subcommand, c := target")}, {_runs("pr", "a := tool, b := subcommand, c := target, d := read_only")},
poll AS (SELECT * FROM pr WHERE all_read AND n >= 3), polled AS (SELECT session_id, unnest(ids) AS id FROM poll),
stuck AS (SELECT * FROM sr WHERE all_failed AND n >= 3 AND NOT list_has_all((SELECT coalesce(list(id), []) FROM polled p WHERE p.session_id = sr.session_id), ids)),
loops AS (SELECT session_id, 'stuck-loop' AS pattern, first_ord, tool, args, n, cost_usd FROM stuck UNION ALL SELECT session_id, 'polling-loop', first_ord, tool, args, n, cost_usd FROM poll)"""
_SWINGS = """swk AS (SELECT * FROM num WHERE tool IN ('purchase', 'signup') AND target <> ''),
swings AS (SELECT a.session_id, a.ord AS first_ord, a.tool, a.args || ' ↔ ' || b.args AS args, 2 AS n, CASE WHEN coalesce(a.cost_usd, b.cost_usd) IS NOT NULL THEN coalesce(a.cost_usd, 0) + coalesce(b.cost_usd, 0) END AS cost_usd
  FROM swk a JOIN swk b ON a.session_id = b.session_id AND a.tool = b.tool AND a.target = b.target AND b.ord > a.ord AND b.ord < a.ord + 10 WHERE a.args <> b.args)"""
_text = lambda x: "NULL" if x is None else str(x) if isinstance(x, bool) else "'" + x.replace("'", "''") + "'"
_SHELL = f"""WITH cm(k, args, subcommand, target, read_only, key, needs, makes) AS (VALUES {", ".join(f"({k}, {', '.join(map(_text, c[1:]))})" for k, c in enumerate(COMMANDS))}),
ev AS (SELECT user_id AS session_id, 'm' || event_id AS call_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1)::INT AS ord FROM events),
num AS (SELECT session_id, call_id, ord, 'bash' AS tool, args, subcommand, target, read_only, key, needs, makes, (ord // 4) % 3 = 0 AS is_error, NULL::DOUBLE AS cost_usd FROM ev JOIN cm ON (ord // 4 * 5 + session_id) % {len(COMMANDS)} = k)"""
_GAPS = "gaps AS (SELECT a.session_id, a.ord AS first_ord, a.tool, a.args, a.cost_usd FROM num a WHERE is_error AND args IS NOT NULL AND NOT EXISTS (SELECT 1 FROM num b WHERE b.session_id = a.session_id AND b.tool = 'signup' AND b.args = a.args AND b.ord <= a.ord))"

ORACLE_SQL = {
    "turn_pairs": with_views(f"{_TURNS} SELECT session_id, turn_idx, user_message_id, user_text, assistant_text, prior_user_text, n_messages FROM tp", "messages"),
    "turn_friction": with_views(f"{_FRICTION} SELECT session_id, turn_idx, correction_type, is_empty, friction_score, high_signal FROM fr", "messages"),
    "session_flags": with_views(f"{_FLAGS} SELECT * FROM flags", "messages"),
    "smooth_siblings": with_views(
        f"""{_FLAGS}, ses AS (SELECT DISTINCT conv_id AS session_id, 'dir' || (conv_id % 10) AS cwd FROM conversations),
sm AS (SELECT cwd, f.session_id AS sibling_id, n_turns AS sibling_turns FROM flags f JOIN ses USING (session_id) WHERE n_turns >= 2 AND n_corrections = 0 AND n_high = 0)
SELECT session_id, sibling_id, sibling_turns, rank::INT AS rank FROM (SELECT session_id, sibling_id, sibling_turns, row_number() OVER (PARTITION BY session_id ORDER BY sibling_turns DESC, sibling_id) AS rank FROM ses JOIN sm USING (cwd) WHERE session_id <> sibling_id) WHERE rank <= 3""",
        "messages",
    ),
    "trajectory_loops": with_views(f"{_LOOPS} SELECT session_id, pattern, first_ord, tool, n, round(cost_usd, 4) AS cost_usd FROM loops", "calls"),
    "trajectory_oscillations": with_views(f"{_NUM}, {_SWINGS} SELECT session_id, first_ord, tool, args, n, round(cost_usd, 4) AS cost_usd FROM swings", "calls"),
    "transcript_calls": f"{_SHELL} SELECT session_id, ord, call_id, subcommand, target, args, read_only, is_error FROM num",
    "transcript_signals": f"""{_SHELL}, {_LOOPS.removeprefix(_NUM + ", ")},
sw AS (SELECT a.session_id, a.ord AS first_ord, a.tool, a.args || ' ↔ ' || b.args AS args FROM num a JOIN num b ON a.session_id = b.session_id AND a.key = b.key AND a.target = b.target AND b.ord > a.ord AND b.ord < a.ord + 10 WHERE a.target <> '' AND a.args <> b.args),
gp AS (SELECT a.session_id, a.ord AS first_ord, a.tool, a.args FROM num a WHERE is_error AND needs IS NOT NULL AND NOT EXISTS (SELECT 1 FROM num b WHERE b.session_id = a.session_id AND b.makes = a.needs AND b.ord <= a.ord))
SELECT session_id, pattern, first_ord, tool, args, n FROM loops UNION ALL SELECT session_id, 'oscillation', first_ord, tool, args, 2 FROM sw UNION ALL SELECT session_id, 'pre-flight-gap', first_ord, tool, args, 1 FROM gp""",
    "trajectory_gaps": with_views(f"{_NUM}, {_GAPS} SELECT session_id, first_ord, tool, args FROM gaps", "calls"),
    "trajectory_scores": with_views(
        f"""{_LOOPS}, {_SWINGS}, {_GAPS}, s AS (SELECT session_id, pattern, cost_usd FROM loops UNION ALL SELECT session_id, 'oscillation', cost_usd FROM swings UNION ALL SELECT session_id, 'pre-flight-gap', cost_usd FROM gaps)
SELECT session_id, round(least(1.0::DOUBLE, sum((CASE pattern WHEN 'stuck-loop' THEN 0.3 WHEN 'polling-loop' THEN 0.25 WHEN 'oscillation' THEN 0.35 ELSE 0.2 END)::DOUBLE)), 6) AS score, count(*) FILTER (pattern = 'stuck-loop') AS n_stuck_loop,
    count(*) FILTER (pattern = 'polling-loop') AS n_polling_loop, count(*) FILTER (pattern = 'oscillation') AS n_oscillation, count(*) FILTER (pattern = 'pre-flight-gap') AS n_pre_flight_gap, round(sum(cost_usd), 6) AS cost_usd FROM s GROUP BY 1""",
        "calls",
    ),
    "revive_chains": with_views(
        f"""{_NUM}, {_runs("rr", "a := tool = 'error'")} SELECT session_id, n::BIGINT AS length, n::BIGINT - 1 AS redundant_spawns, first_ord, last_ord FROM rr WHERE tool = 'error'""", "calls"
    ),
    "chain_histogram": with_views(f"""{_NUM}, {_runs("rr", "a := tool = 'error'")} SELECT n::BIGINT AS length, count(*) AS n_chains FROM rr WHERE tool = 'error' GROUP BY 1""", "calls"),
    "routing": with_views(
        f"""{_FRICTION}, sig AS (SELECT session_id, max_by(turn_idx, (length(assistant_text), turn_idx)) AS turn_idx, true AS hit FROM fr GROUP BY 1)
SELECT fr.session_id, fr.turn_idx, CASE WHEN correction_type IS NOT NULL OR hit THEN 'escalate' WHEN n_calls <= 2 AND length(assistant_text) * 100 <= 20000 AND length(user_text) <= 2000 THEN 'downshift' ELSE 'neutral' END AS route
FROM fr LEFT JOIN sig ON fr.session_id = sig.session_id AND fr.turn_idx = sig.turn_idx""",
        "messages",
    ),
    "message_stats": with_views(
        "SELECT role, count(*) AS n_messages, count(DISTINCT session_id) AS n_sessions, sum(length(content_text))::BIGINT AS n_chars, count(*) FILTER (content_text IS NULL OR content_text = '') AS n_empty FROM messages GROUP BY GROUPING SETS ((role), ())",
        "messages",
    ),
}
