"""Time windows, digests, joins of runs with projects, searches over two corpora."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright import views
from tracewright.functions.patterns import STRONG, WEAK
from tracewright.operators import digest, proposals, search, stats, turns
from tracewright.queries.conversations import _FRICTION as FRICTION
from tracewright.streaming import ingest
from tracewright.views import table, with_views


def event_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.activity(events).withColumn("start", F.col("start").cast("timestamp_ntz"))


def user_visits(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return ingest.visits(events).select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


def digest_lines(spark, sf_dir):
    return digest.lines(turns.friction(turns.turn_pairs(views.messages(spark, sf_dir))), 60, 100)


def digest_segments(spark, sf_dir):
    lines = digest.lines(turns.friction(turns.turn_pairs(views.messages(spark, sf_dir))), 60, 100)
    return digest.packed(lines, size=300, most=3).select("session_id", "turn_idx", "segment")


def turn_digest(spark, sf_dir):
    """Turns joined with labels, signals and acts; lengths of texts stand in for what a model and a lexicon would say."""
    core = turns.correction_text(turns.friction(turns.turn_pairs(views.messages(spark, sf_dir))))
    n = F.length("user_text")
    labels = core.where(n % 2 == 0).select("user_message_id", F.concat(F.lit("label "), (n % 5).cast("string")).alias("label"))
    signals = core.select("user_message_id", F.explode(F.array_compact(F.array(*[F.when(n % k == 0, F.struct(F.lit(f"by {k}").alias("signal"), F.lit(k / 10).alias("weight"))) for k in (3, 4, 7)]))).alias("s")).select("user_message_id", "s.*")
    acts = core.where("turn_idx > 0").select("user_message_id", F.array(F.when(n % 3 == 0, "approve").otherwise("ask"), F.lit("reply")).alias("acts"))
    return digest.enriched(core, labels, signals, acts).select("session_id", "turn_idx", "correction_type", "correction_text", "label", F.array_join("signals", ",").alias("signals"), "frustration", F.array_join("acts", ",").alias("acts"))


def reply_acts(spark, sf_dir):
    """Order statuses of a customer's months stand in for acts."""
    rows = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("session_id"), F.date_trunc("year", "o_orderdate").alias("turn_idx")).agg(F.collect_list("o_orderpriority").alias("acts"))
    return digest.reply_acts(rows)


def runs_by_project(spark, sf_dir):
    """Delegated runs meet all sessions of their project (many to many): suppliers and customers of a nation."""
    runs = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").alias("project"))
    sessions = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("project"), "c_acctbal")
    per = sessions.groupBy("project").agg(F.count("*").alias("sessions"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return runs.groupBy("project").agg(F.count("*").alias("runs")).join(per, "project").select("project", "runs", "sessions", (F.col("runs") * F.col("sessions")).alias("pairs"), "balance")


def sessions_by_source(spark, sf_dir):
    """Proposals joined with their sessions, filtered by source: orders of one market segment."""
    mine = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey")
    return stats.group_sizes(table(spark, sf_dir, "orders").join(mine, "o_custkey"), "c_nationkey", "o_orderstatus")


def search_merged(spark, sf_dir):
    hits, query = {}, "thth* OR license"
    for kind, name, ident in (("document", "documents", "doc_id"), ("benchmark", "benchmark", "item_id")):
        frame = table(spark, sf_dir, name)
        hits[kind] = search.search(search.index(frame, ident, ("text",), query), query, *search.statistics(sizes=search.lengths(frame, ident, ("text",))))
    return search.merged(hits, limit=30)


def run_accounting(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("analyzer_id"), F.col("o_orderstatus").alias("outcome"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0").alias("unit_id"))
    return stats.accounting(rows)


def assertion_fingerprint(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.lit("term").alias("subject_kind"), (F.col("o_custkey") % 50).cast("string").alias("subject_key"), F.col("o_orderstatus").alias("verdict"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("asserted_at"))
    return proposals.fingerprint(proposals.upsert(rows))


QUERIES = {f.__name__: f for f in (event_windows, user_visits, digest_lines, digest_segments, turn_digest, reply_acts, runs_by_project, sessions_by_source, search_merged, run_accounting, assertion_fingerprint)}



def _bm25(kind: str, name: str, ident: str) -> str:
    """SQL of the hits of "thth* OR license" in a table."""
    part = "CASE WHEN {tf} > 0 THEN greatest(1e-6, ln((n - {df} + 0.5) / ({df} + 0.5))) * {tf} * 2.2 / ({tf} + 1.2 * (0.25 + 0.75 * len(t) / mean)) ELSE 0 END"
    return f"""{kind}_t AS (SELECT {ident} AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}]+') AS t FROM {name}), {kind}_s AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM {kind}_t WHERE len(t) > 0),
{kind}_c AS (SELECT *, len(list_filter(t, lambda x: starts_with(x, 'thth'))) AS a, len(list_filter(t, lambda x: x = 'license')) AS b FROM {kind}_t), {kind}_f AS (SELECT count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM {kind}_c),
{kind}_h AS (SELECT '{kind}' AS kind, id::VARCHAR AS id, id AS number, round(-({part.format(tf="a", df="da")} + {part.format(tf="b", df="db")}), 6) AS score, 'text' AS field, list_position(list_transform(t, lambda x: starts_with(x, 'thth') OR x = 'license'), true) - 1 AS first FROM {kind}_c, {kind}_s, {kind}_f WHERE a > 0 OR b > 0)"""


def _after() -> str:
    """SQL of what follows the first pattern found."""
    quoted = lambda p: p.replace("'", "''")
    cases = [f"WHEN regexp_matches(t, '(?i){quoted(p)}') THEN coalesce(nullif(trim(substr(t, strpos(t, regexp_extract(t, '(?i){quoted(p)}')) + length(regexp_extract(t, '(?i){quoted(p)}')))), ''), regexp_extract(t, '(?i){quoted(p)}'))" for p in (*STRONG, *WEAK)]
    return f"substr(CASE WHEN correction_type IS NULL THEN NULL WHEN correction_type = 'repetition' THEN t {' '.join(cases)} ELSE t END, 1, 240)"


ORACLE_SQL = {
    "turn_digest": with_views(
        f"""{FRICTION}, d AS (SELECT *, user_text AS t, length(user_text) AS n FROM fr)
SELECT session_id, turn_idx, correction_type, {_after()} AS correction_text, CASE WHEN n % 2 = 0 THEN 'label ' || n % 5 END AS label, concat_ws(',', CASE WHEN n % 7 = 0 THEN 'by 7' END, CASE WHEN n % 4 = 0 THEN 'by 4' END, CASE WHEN n % 3 = 0 THEN 'by 3' END) AS signals,
    round(CASE WHEN n % 7 = 0 THEN 0.7 ELSE 0 END + CASE WHEN n % 4 = 0 THEN 0.4 ELSE 0 END + CASE WHEN n % 3 = 0 THEN 0.3 ELSE 0 END, 6)::DOUBLE AS frustration, CASE WHEN turn_idx > 0 THEN CASE WHEN n % 3 = 0 THEN 'approve' ELSE 'ask' END || ',reply' ELSE '' END AS acts FROM d""",
        "messages",
    ),
    "digest_segments": with_views(
        f"""{FRICTION}, f AS (SELECT session_id, turn_idx, correction_type, trim(regexp_replace(user_text, '\\s+', ' ', 'g')) AS fu, trim(regexp_replace(assistant_text, '\\s+', ' ', 'g')) AS fa FROM fr),
ln AS (SELECT session_id, turn_idx, row_number() OVER (PARTITION BY session_id ORDER BY turn_idx) AS k, length('#' || turn_idx || CASE WHEN correction_type IS NOT NULL THEN ' [' || correction_type || ']' ELSE '' END || ' U: ' || CASE WHEN length(fu) > 60 THEN substr(fu, 1, 59) || '…' ELSE fu END || ' A: ' || CASE WHEN length(fa) > 100 THEN substr(fa, 1, 99) || '…' ELSE fa END) AS n FROM f),
pk(session_id, turn_idx, k, segment, filled) AS (SELECT session_id, turn_idx, k, 0, n FROM ln WHERE k = 1
  UNION ALL SELECT ln.session_id, ln.turn_idx, ln.k, CASE WHEN filled > 0 AND filled + n > 300 THEN segment + 1 ELSE segment END, CASE WHEN filled > 0 AND filled + n > 300 THEN n ELSE filled + n END FROM pk JOIN ln ON ln.session_id = pk.session_id AND ln.k = pk.k + 1)
SELECT session_id, turn_idx, CASE WHEN segment < 3 THEN segment END::INT AS segment FROM pk""",
        "messages",
    ).replace("WITH ", "WITH RECURSIVE ", 1),
    "search_merged": f"""WITH {_bm25("document", "documents", "doc_id")}, {_bm25("benchmark", "benchmark", "item_id")},
h AS (SELECT * FROM (SELECT * FROM document_h ORDER BY score, number LIMIT 500) UNION ALL SELECT * FROM (SELECT * FROM benchmark_h ORDER BY score, number LIMIT 500))
SELECT kind, id, score, field, first::INT AS first, greatest(0, (SELECT count(*) FROM document_h) + (SELECT count(*) FROM benchmark_h) - 30)::INT AS omitted FROM h ORDER BY score, kind, id LIMIT 30""",
    "assertion_fingerprint": """WITH r AS (SELECT (o_custkey % 50)::VARCHAR AS k, o_orderstatus AS v, max(o_orderdate) AS t FROM orders GROUP BY 1, 2),
l AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY t DESC, v DESC) AS n FROM r), a AS (SELECT substr(sha256('term|' || k || '|' || v), 1, 16) AS id FROM l WHERE n = 1)
SELECT substr(sha256('assertions(' || count(*)::VARCHAR || '|' || coalesce(sum(('0x' || substr(id, 1, 13))::BIGINT), 0)::VARCHAR || ')'), 1, 16) AS fingerprint FROM a""",
    "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY 1, 2",
    "user_visits": """WITH g AS (SELECT user_id, ts, (coalesce(ts - lag(ts) OVER w, INTERVAL 1 DAY) > INTERVAL 30 MINUTE)::INT AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS visit FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM v GROUP BY user_id, visit""",
    "reply_acts": """WITH r AS (SELECT o_custkey AS session_id, date_trunc('year', o_orderdate) AS t, list(o_orderpriority) AS acts FROM orders GROUP BY 1, 2), s AS (SELECT session_id, count(*) AS turns, count(*) FILTER (len(acts) > 1) AS multi FROM r GROUP BY 1),
a AS (SELECT session_id, act, count(*) AS n FROM (SELECT session_id, unnest(list_distinct(acts)) AS act FROM r) GROUP BY 1, 2) SELECT a.session_id, act, n, turns, multi, round(n / turns, 6) AS share FROM a JOIN s ON a.session_id = s.session_id""",
    "runs_by_project": """WITH r AS (SELECT s_nationkey AS project, count(*) AS runs FROM supplier GROUP BY 1), c AS (SELECT c_nationkey AS project, count(*) AS sessions, round(sum(c_acctbal), 2) AS balance FROM customer GROUP BY 1)
SELECT project, runs, sessions, runs * sessions AS pairs, balance FROM r JOIN c USING (project)""",
    "sessions_by_source": "SELECT c_nationkey, o_orderstatus, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'BUILDING' GROUP BY 1, 2",
    "run_accounting": "SELECT o_orderpriority AS analyzer_id, o_orderstatus AS outcome, count(*) AS n, list(DISTINCT lpad(o_orderkey::VARCHAR, 9, '0') ORDER BY lpad(o_orderkey::VARCHAR, 9, '0'))[1:3] AS examples FROM orders GROUP BY 1, 2",
    "digest_lines": with_views(
        f"""{FRICTION}, f AS (SELECT session_id, turn_idx, correction_type, trim(regexp_replace(user_text, '\\s+', ' ', 'g')) AS fu, trim(regexp_replace(assistant_text, '\\s+', ' ', 'g')) AS fa FROM fr)
SELECT session_id, turn_idx, '#' || turn_idx || CASE WHEN correction_type IS NOT NULL THEN ' [' || correction_type || ']' ELSE '' END || ' U: ' || CASE WHEN length(fu) > 60 THEN substr(fu, 1, 59) || '…' ELSE fu END || ' A: ' || CASE WHEN length(fa) > 100 THEN substr(fa, 1, 99) || '…' ELSE fa END AS line FROM f""",
        "messages",
    ),
}
