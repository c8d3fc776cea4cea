"""The node graph, proposals and assertions, over orders, line items and labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from tracewright.functions import keys
from tracewright.operators import graph, proposals
from tracewright.views import table

MOMENT = "1998-01-01"


def _nodes(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    key = F.col("o_orderkey").cast("string")
    return o.select(
        key.alias("id"), F.col("o_custkey").cast("string").alias("session_id"), F.col("o_orderpriority").alias("analyzer_id"), F.concat(F.lit("1."), F.col("o_orderkey") % 3).alias("version"),
        F.when(F.col("o_orderstatus") == "P", "error").when(F.col("o_orderstatus") == "F", "proposal").otherwise("metric").alias("node_kind"),
        F.concat(F.lit('{"cust":'), F.col("o_custkey") % 5, F.lit(',"status":"'), "o_orderstatus", F.lit('"}')).alias("content_json"),
        keys.labelled("sources", F.concat(F.lit("session:"), F.col("o_custkey"))).alias("source_set_hash"),
        keys.labelled("input", key).alias("input_key"), keys.labelled("output", key).alias("output_key"), F.concat(F.lit("c"), F.col("o_orderkey") % 2).alias("config_fingerprint"),
        F.concat(F.lit("run"), F.col("o_orderkey") % 7).alias("run_id"), F.when(F.col("o_orderkey") % 4 != 0, F.col("o_totalprice") / 1e6).alias("cost_usd"), F.col("o_orderdate").alias("created_at"),
        F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderdate") + F.expr("interval 30 days")).alias("retracted_at"), F.lit(None).cast("string").alias("retracted_by_run"),
    )


def _edges(spark, sf_dir):
    n = F.col("l_linenumber")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("from_node_id"), F.when(n % 3 == 0, "session").when(n % 3 == 1, "analysis_node").otherwise("message").alias("to_ref_kind"),
        F.when(n % 3 == 0, F.col("l_partkey")).otherwise(F.col("l_partkey") * 7).cast("string").alias("to_ref_id"), F.when(n % 3 == 1, "consumes").when(n == 5, "produces").otherwise("anchors").alias("edge_kind"), n.alias("ordinal"),
    )


def node_stats(spark, sf_dir):
    return graph.node_stats(graph.live(_nodes(spark, sf_dir)))


def nodes_as_of(spark, sf_dir):
    return graph.as_of(_nodes(spark, sf_dir), F.lit(MOMENT).cast("timestamp_ntz")).groupBy("analyzer_id", "node_kind").agg(F.count("*").alias("n"))


def latest_nodes(spark, sf_dir):
    return graph.latest(graph.live(_nodes(spark, sf_dir)), "session_id", "analyzer_id").select("session_id", "analyzer_id", "id", "output_key")


def unit_versions(spark, sf_dir):
    return graph.versions(_nodes(spark, sf_dir), "session_id", "analyzer_id").select("id", "version_no", "revises")


def property_counts(spark, sf_dir):
    return graph.count_property(graph.live(_nodes(spark, sf_dir)), "status")


def typed_filter(spark, sf_dir):
    return graph.live(_nodes(spark, sf_dir)).where(graph.content_is("cust", "3", "int")).select("id", "session_id")


def node_filter(spark, sf_dir):
    rich = table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").cast("string").alias("session_id"))
    return graph.select_nodes(_nodes(spark, sf_dir), ("1-URGENT", "5-LOW"), "metric", None, F.lit(MOMENT).cast("timestamp_ntz"), rich).select("id", "session_id", "analyzer_id")


def identity(spark, sf_dir):
    edges = _edges(spark, sf_dir).groupBy("from_node_id").agg(keys.source_set_hash(F.col("to_ref_kind"), F.col("to_ref_id")).alias("source_set_hash"))
    key = keys.input_key(F.lit("a"), F.lit("1.0"), F.lit("f"), F.col("source_set_hash"))
    return edges.select("from_node_id", "source_set_hash", key.alias("input_key"), keys.output_key(key, F.lit('{"a":1}')).alias("output_key"))


def coverage(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    sessions = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("session_id"))
    names = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    registry = spark.range(len(names)).select(F.col("id").alias("position"), F.element_at(F.array(*map(F.lit, names)), (F.col("id") + 1).cast("int")).alias("analyzer_id"))
    runs = nodes.where("node_kind = 'error'").select("session_id", "analyzer_id")
    return graph.coverage(sessions, registry, runs, nodes)


def edge_integrity(spark, sf_dir):
    nodes, edges = _nodes(spark, sf_dir), _edges(spark, sf_dir)
    parts = table(spark, sf_dir, "part").where("p_size > 5").select(F.col("p_partkey").cast("string").alias("id"))
    return graph.dangling(edges, graph.live(nodes), {"session": parts, "analysis_node": nodes.select("id")}).groupBy("to_ref_kind", "fault").agg(F.count("*").alias("n"))


def edge_validity(spark, sf_dir):
    return graph.illegal_edges(_edges(spark, sf_dir)).groupBy("edge_kind", "to_ref_kind").agg(F.count("*").alias("n"))


def plan_units(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    units = nodes.select("analyzer_id", F.concat(F.lit("1."), F.col("id") % 4).alias("version"), F.lit("c1").alias("config_fingerprint"), F.when(F.col("id") % 3 == 0, F.concat("source_set_hash", F.lit("x"))).otherwise(F.col("source_set_hash")).alias("source_set_hash"), F.when(F.col("id") % 2 == 0, F.col("input_key")).otherwise(F.concat("input_key", F.lit("y"))).alias("input_key"))
    return graph.classify(units, nodes).groupBy("status", F.array_join("reasons", ",").alias("reasons")).agg(F.count("*").alias("n"))


def diff_runs(spark, sf_dir):
    nodes = graph.live(_nodes(spark, sf_dir))
    unit = ("session_id", "analyzer_id")
    moment = F.lit(MOMENT).cast("timestamp_ntz")
    return graph.diff(graph.latest(nodes.where(F.col("created_at") <= moment), *unit), graph.latest(nodes, *unit), *unit).select(*unit, "change", F.array_join("fields", ",").alias("fields"))


def diff_summary(spark, sf_dir):
    nodes = graph.live(_nodes(spark, sf_dir))
    unit = ("session_id", "analyzer_id")
    return graph.diff_summary(graph.diff(graph.latest(nodes.where("node_kind = 'metric'"), *unit), graph.latest(nodes, *unit), *unit))


def collect_garbage(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    gone = graph.collectable(nodes, analyzer_id="5-LOW", since=F.lit(MOMENT).cast("timestamp_ntz"))
    return graph.live(graph.retract(nodes, gone, F.lit("2000-01-01").cast("timestamp_ntz"), "gc")).groupBy("analyzer_id").agg(F.count("*").alias("n"))


def _proposals(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").cast("string").alias("id"), F.concat(F.lit("k"), F.col("p_partkey") % 500).alias("input_key"), F.expr("timestamp_ntz'1995-01-01' + make_dt_interval(p_size * 30)").alias("created_at"), F.lit("open").alias("status"),
        F.when(F.col("p_partkey") % 3 == 0, F.col("p_retailprice") / 1e6).alias("cost_usd"), F.when(F.col("p_partkey") % 5 == 0, F.col("p_size") / 50).alias("validated_score"),
        F.element_at(F.array(F.lit("supported"), F.lit("unvalidated"), F.lit("unsupported")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("validation_status"),
    )


def _decisions(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("k"), F.col("o_custkey") % 700).alias("input_key"), F.col("o_orderdate").alias("decided_at"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("accepted").alias("verdict"))


def proposal_ranking(spark, sf_dir):
    return proposals.rank(_proposals(spark, sf_dir)).select("id", "tier", "validated_score")


def proposal_status_as_of(spark, sf_dir):
    return proposals.status_as_of(_proposals(spark, sf_dir), _decisions(spark, sf_dir), F.lit("1996-06-01").cast("timestamp_ntz")).groupBy("input_key", "status").agg(F.count("*").alias("n"))


def replay_scores(spark, sf_dir):
    replays = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("proposal_id"), F.when(F.col("l_linenumber") != 3, F.col("l_discount")).alias("baseline"), F.col("l_tax").alias("with_rule"))
    return proposals.replay_score(replays).select("proposal_id", "replayed", "validated_score", "validation_status")


def _asserted(spark, sf_dir):
    return table(spark, sf_dir, "orders").select(F.lit("term").alias("subject_kind"), F.concat(F.lit("t"), F.col("o_custkey") % 400).alias("subject_key"), F.when(F.col("o_orderstatus") == "F", "rejected").otherwise("accepted").alias("verdict"), F.col("o_orderpriority").alias("reason"), F.col("o_orderdate").alias("asserted_at"))


def assertions(spark, sf_dir):
    return proposals.upsert(_asserted(spark, sf_dir)).select("id", "subject_key", "verdict", "asserted_at", "times", F.col("superseded_at").isNull().alias("is_active"))


def muted_terms(spark, sf_dir):
    return proposals.muted(proposals.upsert(_asserted(spark, sf_dir)))


def reconcile(spark, sf_dir):
    rows = _asserted(spark, sf_dir)
    return proposals.reconcile(rows.where(F.col("asserted_at") < F.lit("1994-01-01").cast("timestamp_ntz")), rows.where("verdict = 'accepted'"))


QUERIES = {f.__name__: f for f in (node_stats, nodes_as_of, latest_nodes, unit_versions, property_counts, typed_filter, node_filter, identity, coverage, edge_integrity, edge_validity, plan_units, diff_runs, diff_summary, collect_garbage, proposal_ranking, proposal_status_as_of, replay_scores, assertions, muted_terms, reconcile)}

_H = "substr(sha256({}), 1, 16)"
_NODES = f"""WITH nodes AS (SELECT o_orderkey::VARCHAR AS id, o_custkey::VARCHAR AS session_id, o_orderpriority AS analyzer_id, '1.' || (o_orderkey % 3) AS version,
    CASE o_orderstatus WHEN 'P' THEN 'error' WHEN 'F' THEN 'proposal' ELSE 'metric' END AS node_kind, o_custkey % 5 AS cust, o_orderstatus AS status, {_H.format("'sources(session:' || o_custkey || ')'")} AS source_set_hash,
    {_H.format("'input(' || o_orderkey || ')'")} AS input_key, {_H.format("'output(' || o_orderkey || ')'")} AS output_key, 'c' || (o_orderkey % 2) AS config_fingerprint, 'run' || (o_orderkey % 7) AS run_id,
    CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice / 1e6 END AS cost_usd, o_orderdate AS created_at, CASE WHEN o_orderkey % 11 = 0 THEN o_orderdate + INTERVAL 30 DAY END AS retracted_at FROM orders),
live AS (SELECT * FROM nodes WHERE retracted_at IS NULL),
edges AS (SELECT l_orderkey::VARCHAR AS from_node_id, CASE l_linenumber % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'analysis_node' ELSE 'message' END AS to_ref_kind,
    (CASE WHEN l_linenumber % 3 = 0 THEN l_partkey ELSE l_partkey * 7 END)::VARCHAR AS to_ref_id, CASE WHEN l_linenumber % 3 = 1 THEN 'consumes' WHEN l_linenumber = 5 THEN 'produces' ELSE 'anchors' END AS edge_kind FROM lineitem),
best AS (SELECT * FROM live WHERE node_kind <> 'error' QUALIFY row_number() OVER (PARTITION BY session_id, analyzer_id ORDER BY created_at DESC, id DESC) = 1)"""


def _best(where: str) -> str:
    return f"(SELECT * FROM live WHERE node_kind <> 'error' AND {where} QUALIFY row_number() OVER (PARTITION BY session_id, analyzer_id ORDER BY created_at DESC, id DESC) = 1)"


_CHANGE = "CASE WHEN a.output_key IS NULL THEN 'added' WHEN b.output_key IS NULL THEN 'removed' WHEN a.output_key <> b.output_key THEN 'changed' ELSE 'same' END"
_PROPOSALS = """WITH p AS (SELECT p_partkey::VARCHAR AS id, 'k' || (p_partkey % 500) AS input_key, TIMESTAMP '1995-01-01' + to_days(p_size * 30) AS created_at, CASE WHEN p_partkey % 3 = 0 THEN p_retailprice / 1e6 END AS cost_usd, CASE WHEN p_partkey % 5 = 0 THEN p_size / 50 END AS validated_score,
    CASE p_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS tier FROM part),
d AS (SELECT o_orderkey::VARCHAR AS id, 'k' || (o_custkey % 700) AS input_key, o_orderdate AS decided_at, CASE o_orderstatus WHEN 'F' THEN 'rejected' ELSE 'accepted' END AS verdict FROM orders)"""
_ASSERTED = """WITH x AS (SELECT 't' || (o_custkey % 400) AS subject_key, CASE o_orderstatus WHEN 'F' THEN 'rejected' ELSE 'accepted' END AS verdict, o_orderdate AS asserted_at FROM orders),
u AS (SELECT subject_key, verdict, max(asserted_at) AS asserted_at, count(*) AS times FROM x GROUP BY 1, 2), s AS (SELECT *, lead(asserted_at) OVER (PARTITION BY subject_key ORDER BY asserted_at, verdict) IS NULL AS is_active FROM u)"""

ORACLE_SQL = {
    "node_stats": f"{_NODES} SELECT analyzer_id, node_kind, count(*) AS n, round(sum(cost_usd), 4) AS cost_usd FROM live GROUP BY GROUPING SETS ((analyzer_id), (node_kind), ())",
    "nodes_as_of": f"{_NODES} SELECT analyzer_id, node_kind, count(*) AS n FROM nodes WHERE created_at <= '{MOMENT}' AND (retracted_at IS NULL OR retracted_at > '{MOMENT}') GROUP BY 1, 2",
    "latest_nodes": f"{_NODES} SELECT session_id, analyzer_id, id, output_key FROM best",
    "unit_versions": f"{_NODES} SELECT id, row_number() OVER w::INT AS version_no, lag(output_key) OVER w AS revises FROM nodes WINDOW w AS (PARTITION BY session_id, analyzer_id ORDER BY created_at, id)".replace("row_number() OVER w::INT", "(row_number() OVER w)::INT"),
    "property_counts": f"{_NODES} SELECT status AS value, count(*) AS n FROM live GROUP BY 1",
    "typed_filter": f"{_NODES} SELECT id, session_id FROM live WHERE cust = 3",
    "node_filter": f"{_NODES} SELECT id, session_id, analyzer_id FROM nodes WHERE analyzer_id IN ('1-URGENT', '5-LOW') AND node_kind = 'metric' AND created_at <= '{MOMENT}' AND (retracted_at IS NULL OR retracted_at > '{MOMENT}') AND session_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 9000)",
    "identity": f"""{_NODES}, s AS (SELECT from_node_id, {_H.format("'sources(' || string_agg(to_ref_kind || ':' || to_ref_id, '|' ORDER BY to_ref_kind || ':' || to_ref_id) || ')'")} AS source_set_hash FROM edges GROUP BY 1),
k AS (SELECT *, {_H.format("'input(a|1.0|f|' || source_set_hash || ')'")} AS input_key FROM s) SELECT *, {_H.format("'output(' || input_key || '|{" + chr(34) + "a" + chr(34) + ":1})'")} AS output_key FROM k""",
    "coverage": f"""{_NODES}, done AS (SELECT session_id, list(DISTINCT analyzer_id) AS have FROM (SELECT session_id, analyzer_id FROM nodes WHERE node_kind = 'error' UNION ALL SELECT session_id, analyzer_id FROM live WHERE node_kind <> 'error') GROUP BY 1),
c AS (SELECT c_custkey::VARCHAR AS session_id, list_filter(['1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW'], lambda x: NOT list_contains(coalesce(have, []), x)) AS missing FROM customer LEFT JOIN done ON session_id = c_custkey::VARCHAR) SELECT session_id, missing, 5 - len(missing)::INT AS n_covered FROM c""",
    "edge_integrity": f"""{_NODES}, f AS (SELECT to_ref_kind, 'source' AS fault FROM edges WHERE from_node_id NOT IN (SELECT id FROM live) UNION ALL SELECT to_ref_kind, 'target' FROM edges WHERE to_ref_kind = 'session' AND to_ref_id NOT IN (SELECT p_partkey::VARCHAR FROM part WHERE p_size > 5)
    UNION ALL SELECT to_ref_kind, 'target' FROM edges WHERE to_ref_kind = 'analysis_node' AND to_ref_id NOT IN (SELECT id FROM nodes)) SELECT to_ref_kind, fault, count(*) AS n FROM f GROUP BY 1, 2""",
    "edge_validity": f"{_NODES} SELECT edge_kind, to_ref_kind, count(*) AS n FROM edges WHERE edge_kind = 'produces' GROUP BY 1, 2",
    "plan_units": f"""{_NODES}, u AS (SELECT analyzer_id, (id::BIGINT % 4)::INT AS minor, source_set_hash || CASE WHEN id::BIGINT % 3 = 0 THEN 'x' ELSE '' END AS source_set_hash, input_key || CASE WHEN id::BIGINT % 2 = 0 THEN '' ELSE 'y' END AS input_key FROM nodes),
l AS (SELECT analyzer_id, source_set_hash, split_part(version, '.', 2)::INT AS v, config_fingerprint AS c FROM live WHERE node_kind <> 'error' QUALIFY row_number() OVER (PARTITION BY analyzer_id, source_set_hash ORDER BY created_at DESC, id DESC) = 1),
j AS (SELECT CASE WHEN input_key IN (SELECT input_key FROM live WHERE node_kind <> 'error') THEN 'current' WHEN l.v IS NOT NULL THEN 'stale' ELSE 'missing' END AS status, concat_ws(',', CASE WHEN minor > l.v THEN 'minor' END, CASE WHEN l.c <> 'c1' THEN 'config' END) AS reasons FROM u LEFT JOIN l USING (analyzer_id, source_set_hash))
SELECT status, CASE WHEN status = 'stale' THEN reasons END AS reasons, count(*) AS n FROM j GROUP BY 1, 2""",
    "diff_runs": f"""{_NODES} SELECT coalesce(a.session_id, b.session_id) AS session_id, coalesce(a.analyzer_id, b.analyzer_id) AS analyzer_id, {_CHANGE} AS change, CASE WHEN a.output_key <> b.output_key THEN concat_ws(',', CASE WHEN a.cust <> b.cust THEN 'cust' END, CASE WHEN a.status <> b.status THEN 'status' END) END AS fields
    FROM {_best(f"created_at <= '{MOMENT}'")} a FULL JOIN best b ON a.session_id = b.session_id AND a.analyzer_id = b.analyzer_id""",
    "diff_summary": f"""{_NODES}, c AS (SELECT coalesce(a.analyzer_id, b.analyzer_id) AS analyzer_id, {_CHANGE} AS change FROM {_best("node_kind = 'metric'")} a FULL JOIN best b ON a.session_id = b.session_id AND a.analyzer_id = b.analyzer_id)
SELECT analyzer_id, count(*) FILTER (change = 'added') AS added, count(*) FILTER (change = 'removed') AS removed, count(*) FILTER (change = 'changed') AS changed, count(*) FILTER (change = 'same') AS same FROM c GROUP BY 1""",
    "collect_garbage": f"{_NODES} SELECT analyzer_id, count(*) AS n FROM live WHERE NOT (analyzer_id = '5-LOW' AND created_at >= '{MOMENT}') GROUP BY 1",
    "proposal_ranking": f"{_PROPOSALS} SELECT id, tier, validated_score FROM p ORDER BY tier DESC, coalesce(cost_usd, -1) DESC, validated_score DESC NULLS LAST, created_at DESC, id",
    "proposal_status_as_of": f"""{_PROPOSALS}, l AS (SELECT input_key, max_by(verdict, (decided_at, id)) AS v FROM d WHERE decided_at <= '1996-06-01' GROUP BY 1)
SELECT input_key, CASE WHEN v = 'rejected' THEN 'rejected' WHEN v IS NOT NULL THEN 'applied' ELSE 'open' END AS status, count(*) AS n FROM p LEFT JOIN l USING (input_key) WHERE created_at <= '1996-06-01' GROUP BY 1, 2""",
    "replay_scores": """WITH r AS (SELECT l_partkey AS proposal_id, CASE WHEN l_linenumber <> 3 THEN l_discount END AS b, l_tax AS w FROM lineitem),
s AS (SELECT proposal_id, count(b) AS replayed, coalesce(sum(b), 0) AS base, coalesce(sum(CASE WHEN b IS NOT NULL THEN greatest(0, b - w) END), 0) AS av FROM r GROUP BY 1), v AS (SELECT proposal_id, replayed, CASE WHEN replayed = 0 THEN NULL WHEN base = 0 THEN 0 ELSE round(av / base, 6) END AS validated_score FROM s)
SELECT *, CASE WHEN validated_score IS NULL THEN 'unvalidated' WHEN validated_score >= 0.5 THEN 'supported' ELSE 'unsupported' END AS validation_status FROM v""",
    "assertions": f"{_ASSERTED} SELECT {_H.format(chr(39) + 'term|' + chr(39) + ' || subject_key || ' + chr(39) + '|' + chr(39) + ' || verdict')} AS id, * FROM s",
    "muted_terms": f"{_ASSERTED} SELECT subject_key AS term FROM s WHERE is_active AND verdict = 'rejected'",
    "reconcile": f"""{_ASSERTED}, a AS (SELECT DISTINCT subject_key, verdict FROM x WHERE asserted_at < '1994-01-01'), b AS (SELECT DISTINCT subject_key, verdict FROM x WHERE verdict = 'accepted')
SELECT *, 'log' AS only_in FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT *, 'assertions' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""",
}
