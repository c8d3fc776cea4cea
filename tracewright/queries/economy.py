"""Cache, context and token costs over the billed calls."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tracewright import views
from tracewright.operators import economy, stats
from tracewright.views import with_views


def _billed(spark, sf_dir):
    order = Window.partitionBy("session_id").orderBy("ts", "l_orderkey", "l_linenumber", "l_partkey", "id")
    return views.usage(spark, sf_dir).withColumn("seq", F.row_number().over(order).cast("bigint")).withColumn("role", F.when(F.col("seq") % 5 == 1, "user").otherwise("assistant"))


def cache_economy(spark, sf_dir):
    return economy.cache_economy(economy.cache_classes(_billed(spark, sf_dir), economy.CacheClasses(cold_input=20, cold_read=30, ttl_seconds=86_400 * 30)))


def _rows(spark, sf_dir):
    """Every third call brings a result; urgent orders compact."""
    return _billed(spark, sf_dir).withColumns({
        "billed": F.col("seq") % 2 == 0, "compaction": (F.col("marker") == "1-URGENT") & (F.col("seq") % 7 == 0),
        "text_length": F.when(F.col("seq") % 3 == 0, F.col("input") * 1000), "tool": F.col("model"),
    })


def context_carry(spark, sf_dir):
    return economy.context_economy(economy.carry(_rows(spark, sf_dir)))


def compaction_cycles(spark, sf_dir):
    rows = _rows(spark, sf_dir)
    return economy.compaction_cycles(rows, economy.carry(rows), late_carry=20_000, often_rebuild=30)


def token_units(spark, sf_dir):
    return economy.token_units(_billed(spark, sf_dir))


def token_units_by_model(spark, sf_dir):
    return economy.token_units(_billed(spark, sf_dir), by=("session_id", "model")).groupBy("model").agg(F.count("*").alias("sessions"), F.sum("calls").alias("calls"), F.round(F.sum("mite"), 9).alias("mite"))


def request_segments(spark, sf_dir):
    return economy.request_segments(_billed(spark, sf_dir))


def class_costs(spark, sf_dir):
    rows = _billed(spark, sf_dir)
    # urgent requests have a class less
    named = F.array(F.when(F.col("marker") != "1-URGENT", F.col("marker")).otherwise(""), F.concat(F.lit("  "), "model", F.lit(" :")))
    classes = rows.where("role = 'user'").select(F.col("id").alias("user_message_id"), F.explode(named).alias("class"))
    return economy.class_costs(economy.request_segments(rows), classes)


def _turns(spark, sf_dir):
    return views.usage(spark, sf_dir).select(
        F.concat("model", "marker").alias("model"), "cost_usd", (F.col("l_linenumber") == 7).alias("corrected"), (F.col("output") / 10).alias("friction"), (F.col("l_linenumber") % 3).alias("failures"),
        (F.col("input") > 45).alias("stuck"), F.when(F.col("input") > 40, "escalate").when(F.col("input") < 10, "downshift").otherwise("neutral").alias("route"),
    )


def model_mix(spark, sf_dir):
    return economy.model_mix(_turns(spark, sf_dir))


def model_dominance(spark, sf_dir):
    return economy.dominated(economy.model_mix(_turns(spark, sf_dir)))


def token_stats(spark, sf_dir):
    return stats.token_stats(views.usage(spark, sf_dir), "model")


def turn_costs(spark, sf_dir):
    return economy.turn_costs(_billed(spark, sf_dir))


QUERIES = {f.__name__: f for f in (cache_economy, context_carry, compaction_cycles, token_units, token_units_by_model, request_segments, class_costs, model_mix, model_dominance, token_stats, turn_costs)}

_BILLED = """b0 AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY ts, l_orderkey, l_linenumber, l_partkey, id) AS seq FROM usage),
billed AS (SELECT *, CASE WHEN seq % 5 = 1 THEN 'user' ELSE 'assistant' END AS role FROM b0)"""
_ROWS = f"""{_BILLED},
rows0 AS (SELECT *, seq % 2 = 0 AS is_billed, marker = '1-URGENT' AND seq % 7 = 0 AS compaction, CASE WHEN seq % 3 = 0 THEN input * 1000 END AS text_length, model AS tool FROM billed),
rws AS (SELECT *, coalesce(sum(compaction::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM rows0),
res AS (SELECT *, text_length / 3.5 AS tokens, text_length / 3.5 * turns_after AS carry FROM (SELECT *, coalesce(sum(is_billed::INT) OVER (PARTITION BY session_id, segment ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS turns_after FROM rws) WHERE text_length IS NOT NULL)"""
_EQ = "input + 15.0::DOUBLE * output + 0.1::DOUBLE * cache_read + 1.25::DOUBLE * cache_write"
_CALLS = "calls1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id, provider_message_id ORDER BY seq) AS n FROM {}) WHERE n = 1)"
_SEGMENTS = f"""{_BILLED}, o AS (SELECT *, (sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY seq) - 1)::INT AS ordinal FROM billed),
{_CALLS.format("(SELECT * FROM o WHERE role = 'assistant')")}, u AS (SELECT session_id, ordinal, id AS user_message_id, ts AS started_at FROM o WHERE role = 'user'),
sg AS (SELECT session_id, ordinal, count(*) AS calls, round(sum({_EQ}) / 1e6, 9) AS mite, max(ts) AS ended_at, min(ts) AS t0, min_by(model, seq) AS model FROM calls1 GROUP BY 1, 2),
segs AS (SELECT session_id, ordinal, user_message_id, coalesce(started_at, t0) AS started_at, ended_at, coalesce(calls, 0) AS calls, coalesce(mite, 0) AS mite, model FROM u FULL JOIN sg USING (session_id, ordinal))"""
_MIX = """t AS (SELECT model || marker AS model, cost_usd, l_linenumber = 7 AS corrected, output / 10 AS friction, l_linenumber % 3 AS failures, input > 45 AS stuck, CASE WHEN input > 40 THEN 'escalate' WHEN input < 10 THEN 'downshift' ELSE 'neutral' END AS route FROM usage),
mix AS (SELECT model, count(*) AS turns, count(cost_usd) AS priced_turns, round(avg(cost_usd), 9) AS cost_per_turn, round(avg(corrected::INT), 6) AS correction_rate, round(avg(friction), 6) AS friction_rate, round(avg(failures), 6) AS failure_rate,
    round(avg(stuck::INT), 6) AS stuck_rate, count(*) FILTER (route = 'downshift') AS downshifts, round(avg((route = 'escalate')::INT), 6) AS escalation_rate FROM t GROUP BY 1)"""

ORACLE_SQL = {
    "cache_economy": with_views(
        f"""{_BILLED}, c0 AS (SELECT *, epoch(ts)::BIGINT - lag(epoch(ts)::BIGINT) OVER w AS gap, row_number() OVER w = 1 AS first_billed, CASE WHEN cache_read + cache_write + input > 0 THEN cache_read / (cache_read + cache_write + input) END AS ratio,
    cache_write > 0 AND NOT coalesce(max((cache_read > 0)::INT) OVER (PARTITION BY session_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) = 1 AS churned FROM billed WHERE input + output + cache_read + cache_write > 0 WINDOW w AS (PARTITION BY session_id ORDER BY seq)),
c AS (SELECT *, CASE WHEN ratio IS NULL THEN 'unbilled' WHEN ratio >= 0.5 THEN 'hit' WHEN cache_read < 30 AND input >= 20 THEN CASE WHEN first_billed THEN 'cold-start' WHEN gap > 2592000 THEN 'cold-ttl' ELSE 'cold-prefix' END ELSE 'partial' END AS k FROM c0)
SELECT session_id, count(*) AS billed_rows, count(*) FILTER (k = 'hit') AS n_hit, count(*) FILTER (k = 'partial') AS n_partial, count(*) FILTER (k = 'cold-start') AS n_cold_start, count(*) FILTER (k = 'cold-ttl') AS n_cold_ttl, count(*) FILTER (k = 'cold-prefix') AS n_cold_prefix,
    count(*) FILTER (k = 'unbilled') AS n_unbilled, round(sum(cache_read) / nullif(sum(cache_read + cache_write + input), 0), 6) AS hit_ratio, coalesce(sum(cache_write) FILTER (churned), 0)::BIGINT AS churn_tokens, count(cost_usd) AS priced_rows, round(sum(cost_usd) FILTER (k LIKE 'cold%'), 6) AS cold_cost_usd FROM c GROUP BY 1""",
        "usage",
    ),
    "context_carry": with_views(
        f"""{_ROWS} SELECT * FROM (SELECT session_id, tool, count(*) AS n_results, round(sum(tokens), 4)::DOUBLE AS tokens, round(sum(carry), 4)::DOUBLE AS carry, count(*) FILTER (carry >= 1e6) AS n_high_carry, count(*) FILTER (tokens >= 4000) AS n_oversized,
    row_number() OVER (PARTITION BY session_id ORDER BY round(sum(carry), 4) DESC, tool)::INT AS rank FROM res GROUP BY 1, 2) WHERE rank <= 8""",
        "usage",
    ),
    "compaction_cycles": with_views(
        f"""{_ROWS}, cy AS (SELECT session_id, segment, max(seq) FILTER (compaction) AS flush_seq, count(*) FILTER (is_billed) AS turns_spanned, coalesce(max(cache_read) FILTER (is_billed), 0) AS peak_carried, min_by(input + cache_write, seq) FILTER (is_billed) AS f FROM rws GROUP BY 1, 2),
cy1 AS (SELECT *, coalesce(first(f IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY segment ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rebuild_tokens FROM cy),
av AS (SELECT session_id, segment, sum(carry) AS c FROM res GROUP BY 1, 2),
fin AS (SELECT session_id, flush_seq, turns_spanned, peak_carried, round(coalesce(c, 0))::BIGINT AS carry_avoided, rebuild_tokens FROM cy1 LEFT JOIN av USING (session_id, segment) WHERE flush_seq IS NOT NULL)
SELECT *, turns_spanned >= 5 AND carry_avoided >= 20000 AS fired_too_late, rebuild_tokens >= 30 AND peak_carried <= rebuild_tokens AS fired_too_often FROM fin""",
        "usage",
    ),
    "token_units": with_views(
        f"{_BILLED}, {_CALLS.format('billed')} SELECT session_id, count(*) AS calls, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, round(sum({_EQ}) / 1e6, 9) AS mite FROM calls1 GROUP BY 1", "usage"
    ),
    "token_units_by_model": with_views(
        f"{_BILLED}, {_CALLS.format('billed')}, m AS (SELECT session_id, model, count(*) AS calls, round(sum({_EQ}) / 1e6, 9) AS mite FROM calls1 GROUP BY 1, 2) SELECT model, count(*) AS sessions, sum(calls)::BIGINT AS calls, round(sum(mite), 9) AS mite FROM m GROUP BY 1", "usage"
    ),
    "request_segments": with_views(f"{_SEGMENTS} SELECT * FROM segs", "usage"),
    "class_costs": with_views(
        f"""{_SEGMENTS}, cl AS (SELECT DISTINCT user_message_id, class FROM (SELECT id AS user_message_id, lower(marker) AS class FROM billed WHERE role = 'user' AND marker <> '1-URGENT' UNION ALL SELECT id, lower(model) || ' ' FROM billed WHERE role = 'user')),
j AS (SELECT segs.*, class, count(*) OVER (PARTITION BY session_id, ordinal) AS k FROM segs LEFT JOIN cl ON segs.user_message_id = cl.user_message_id WHERE calls > 0),
s AS (SELECT coalesce(class, 'unclassified') AS class, sum(mite / k) AS mite, count(*) AS requests FROM j GROUP BY 1) SELECT class, round(mite, 6) AS mite, requests, round(mite / sum(mite) OVER (), 6) AS share FROM s""",
        "usage",
    ),
    "model_mix": with_views(f"{_MIX} SELECT * FROM mix", "usage"),
    "model_dominance": with_views(
        f"{_MIX}, e AS (SELECT * FROM mix WHERE turns >= 20 AND priced_turns > 0) SELECT a.model, b.model AS by FROM e a JOIN e b ON b.cost_per_turn < a.cost_per_turn AND b.correction_rate <= a.correction_rate AND b.friction_rate <= a.friction_rate AND b.failure_rate <= a.failure_rate AND b.stuck_rate <= a.stuck_rate WHERE a.downshifts > 0", "usage"
    ),
    "token_stats": with_views(
        "SELECT model, count(*) AS turns, sum(input)::BIGINT AS input, sum(output)::BIGINT AS output, sum(cache_read)::BIGINT AS cache_read, sum(cache_write)::BIGINT AS cache_write, round(sum(cost_usd), 4) AS cost_usd, round(sum(input) / count(*))::BIGINT AS input_per_turn, round(sum(output) / count(*))::BIGINT AS output_per_turn, round(sum(input) / nullif(sum(output), 0), 1) AS input_to_output FROM usage GROUP BY CUBE (model)", "usage"
    ),
    "turn_costs": with_views(
        f"{_BILLED}, t AS (SELECT *, sum((role = 'user')::INT) OVER (PARTITION BY session_id ORDER BY seq) AS turn FROM billed) SELECT session_id, min(id) FILTER (role = 'user') AS user_id, round(sum(cost_usd) FILTER (role = 'assistant'), 8) AS cost_usd FROM t WHERE turn > 0 GROUP BY session_id, turn", "usage"
    ),
}
