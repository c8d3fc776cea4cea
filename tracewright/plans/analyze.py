"""The analyze loop: plan, classify, compute what is missing or stale, write nodes, edges and proposals.

A unit of planning is a session under an analyzer. Its sources are the session's messages and
the results it depends on, so a changed message or result makes a new input key; what is current is passed over.
Analyzers that don't wait for each other are planned in one pass and written in one; each is one job over all
sessions that need it, and never is there a loop over sessions.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import keys
from tracewright.operators import graph
from tracewright.plans.registry import Analyzer, ordered
from tracewright.plans.store import SCHEMAS, Store
from tracewright.session import cut

#: Kinds of nodes: one summary for each session analysed, a finding for each row of the result, an error for a session that failed.
SUMMARY, FINDING, ERROR = "summary", "finding", "error"
#: Columns of nodes on their way into the store.
NODE = ("session_id", "analyzer_id", "version", "config_fingerprint", "source_set_hash", "input_key", "consumed", "unit", "content_json", "message_ids", "node_kind", "run_id", "created_at", "cost_usd", "output_key", "id")


def sources(messages: DataFrame) -> DataFrame:
    """(session_id, sources): the address of a session's messages, whatever their order; sums of hashes, so no session is gathered."""
    one = F.conv(F.substring(F.sha2(F.concat_ws("|", "id", F.coalesce("content_hash", F.lit(""))), 256), 1, 14), 16, 10).cast("decimal(20,0)")
    return messages.groupBy("session_id").agg(keys.labelled("messages", F.count("*").cast("string"), F.sum(one).cast("string")).alias("sources"))


def levels(analyzers: Iterable[Analyzer]) -> list[list[Analyzer]]:
    """Analyzers in the order of their dependencies, those that can run side by side together."""
    depth: dict[str, int] = {}
    for a in ordered(analyzers):
        depth[a.id] = 1 + max((depth[d] for d in a.depends_on), default=-1)
    out: list[list[Analyzer]] = [[] for _ in range(max(depth.values(), default=-1) + 1)]
    for a in ordered(analyzers):
        out[depth[a.id]].append(a)
    return out


def plan(messages: DataFrame, nodes: DataFrame, analyzers: list[Analyzer]) -> DataFrame:
    """Units of analyzers: (session_id, analyzer_id, version, config_fingerprint, source_set_hash, input_key), with ``consumed``, the results they rest on."""
    each = F.array(*[F.struct(F.lit(a.id).alias("analyzer_id"), F.lit(a.version).alias("version"), F.lit(repr(sorted(a.config.items()))).alias("config"), F.array(*map(F.lit, a.depends_on)).cast("array<string>").alias("needs")) for a in analyzers])
    units = sources(messages).select("session_id", "sources", F.explode(each).alias("a")).select("session_id", "sources", "a.*")
    needed = sorted({d for a in analyzers for d in a.depends_on})
    if needed:
        results = graph.live(nodes).where((F.col("node_kind") == SUMMARY) & F.col("analyzer_id").isin(*needed))
        latest = graph.latest(results, "session_id", "analyzer_id").groupBy("session_id").agg(F.collect_list(F.struct("analyzer_id", "output_key")).alias("results"))
        units = units.join(latest, "session_id", "left")
        used = F.transform(F.filter("results", lambda r: F.array_contains("needs", r["analyzer_id"])), lambda r: r["output_key"])
        units = units.withColumn("consumed", F.array_sort(F.coalesce(used, F.array().cast("array<string>"))))
    else:
        units = units.withColumn("consumed", F.array().cast("array<string>"))
    units = units.select("session_id", "consumed", "analyzer_id", "version", keys.labelled("config", F.col("config")).alias("config_fingerprint"), keys.labelled("sources", F.concat(F.lit("session:"), "session_id"), F.col("sources"), F.array_join("consumed", "|")).alias("source_set_hash"))
    return units.withColumn("input_key", keys.input_key(F.col("analyzer_id"), F.col("version"), F.col("config_fingerprint"), F.col("source_set_hash")))


def _written(todo: DataFrame, found: DataFrame, run_id: str, moment: datetime) -> DataFrame:
    """Nodes of the sessions in ``todo``: a summary each, and a node for each finding."""
    stamp = {"run_id": F.lit(run_id), "created_at": F.lit(moment), "cost_usd": F.lit(None).cast("double")}
    unit = ["session_id", "analyzer_id", "version", "config_fingerprint", "source_set_hash", "input_key", "consumed"]
    each = todo.select(*unit, F.col("input_key").alias("_key")).join(found, "session_id").withColumns({"node_kind": F.lit(FINDING), "input_key": keys.labelled("unit", F.col("_key"), F.col("unit"))}).drop("_key")
    each = each.dropDuplicates(["input_key"])  # within a run a key counts once
    marks = each.groupBy("session_id").agg(F.count("*").alias("rows"), F.sum(F.conv(F.substring(F.sha2(F.concat_ws("|", "unit", "content_json"), 256), 1, 14), 16, 10).cast("decimal(20,0)")).cast("string").alias("mark"))
    body = F.to_json(F.struct(F.coalesce("rows", F.lit(0)).alias("rows"), F.coalesce("mark", F.lit("")).alias("mark")))
    whole = todo.join(marks, "session_id", "left").select(*unit, F.lit("").alias("unit"), body.alias("content_json"), F.lit(None).cast("array<string>").alias("message_ids"), F.lit(SUMMARY).alias("node_kind"))
    out = each.select(*whole.columns).union(whole).withColumns(stamp)
    out = out.withColumn("output_key", keys.output_key(F.col("input_key"), keys.canonical_json(F.col("content_json"))))
    return out.withColumn("id", keys.uuid7())


def _edges(written: DataFrame, before: DataFrame) -> DataFrame:
    """Edges of new nodes: what they are anchored in, what they consume, which configuration they used, and the earlier result that they revise."""
    edge = lambda kind, target, ident: F.struct(F.lit(kind).alias("edge_kind"), F.lit(target).alias("to_ref_kind"), ident.alias("to_ref_id"))
    anchors = F.transform(F.coalesce("message_ids", F.array().cast("array<string>")), lambda m: edge("anchors", "message", m))
    used = F.transform("consumed", lambda k: edge("consumes", "analysis_node", k))
    own = F.array(edge("anchors", "session", F.col("session_id")), edge("uses_config", "config_version", F.col("config_fingerprint")))
    last = graph.latest(graph.live(before), "session_id", "analyzer_id", "node_kind", "unit").select("session_id", "analyzer_id", "node_kind", "unit", F.col("output_key").alias("_prior"))
    rows = written.join(last, ["session_id", "analyzer_id", "node_kind", "unit"], "left")
    revised = F.when(F.col("_prior").isNotNull() & (F.col("_prior") != F.col("output_key")), edge("revises", "analysis_node", F.col("_prior")))
    listed = F.array_compact(F.concat(own, used, anchors, F.array(revised)))
    return rows.select(F.col("id").alias("from_node_id"), F.posexplode(listed).alias("ordinal", "e")).select("from_node_id", "e.to_ref_kind", "e.to_ref_id", "e.edge_kind", "ordinal")


def _proposals(analyzer: Analyzer, frames: dict[str, DataFrame], written: DataFrame, known: DataFrame, moment: datetime) -> DataFrame:
    root = written.where(F.col("node_kind") == SUMMARY).select("session_id", F.col("id").alias("source_node_id"), "output_key")
    rows = analyzer.advise(frames).join(root, "session_id")
    rows = rows.withColumn("input_key", keys.labelled("proposal", F.col("output_key"), F.col("title"), F.coalesce("detail", F.lit("")))).dropDuplicates(["input_key"])
    return rows.join(known.select("input_key"), "input_key", "left_anti").withColumns({"id": keys.uuid7(), "created_at": F.lit(moment)})


def analyze(store: Store, analyzers: Iterable[Analyzer], only: tuple[str, ...] = (), sessions: DataFrame | None = None, revise: tuple[str, ...] = (), limit: int | None = None) -> dict[str, dict[str, int]]:
    """Run the analyzers over the stored messages; by analyzer, how many sessions were computed, and nodes, edges and proposals written.

    ``sessions`` (session_id) narrows the run; ``limit`` takes so many of the wanted sessions, the first by id; ``revise`` names the reasons
    (major, minor, config) for which stale results are computed anew. An analyzer that fails leaves error nodes, under an identity of their own,
    so its sessions stay missing and a later run heals them.
    """
    messages = store.read("messages")
    if sessions is not None:
        messages = messages.join(sessions.select("session_id"), "session_id", "left_semi")
    out: dict[str, dict[str, int]] = {}
    for together in levels(analyzers):
        chosen = [a for a in together if not only or a.id in only]
        if not chosen:
            continue
        nodes = store.nodes()
        planned = plan(messages, nodes, chosen)
        todo = graph.wanted(graph.classify(planned.drop("consumed"), nodes.where(F.col("node_kind") == SUMMARY)), revise).join(planned.select("session_id", "analyzer_id", "consumed"), ["session_id", "analyzer_id"])
        if limit is not None:
            todo = todo.withColumn("_n", F.row_number().over(Window.partitionBy("analyzer_id").orderBy("session_id"))).where(F.col("_n") <= limit).drop("_n")
        todo = cut(todo)
        asked = {r.analyzer_id: r.n for r in todo.groupBy("analyzer_id").agg(F.count("*").alias("n")).collect()}  # a row for each analyzer
        written, advised, runs = None, None, []
        for analyzer in chosen:
            out[analyzer.id] = {"sessions": asked.get(analyzer.id, 0), "nodes": 0, "edges": 0, "proposals": 0}
            if analyzer.id not in asked:
                continue
            rows, run_id, moment = todo.where(F.col("analyzer_id") == analyzer.id), uuid.uuid4().hex[:16], datetime.now(UTC)
            mine = {"messages": messages.join(rows.select("session_id"), "session_id", "left_semi")}
            try:
                fresh = cut(_written(rows, cut(analyzer.compute(mine)), run_id, moment))
                if analyzer.advise:
                    told = _proposals(analyzer, mine, fresh, store.read("proposals"), moment)
                    advised = told if advised is None else advised.unionByName(told)
            except Exception as e:  # an analyzer's own fault: it is recorded, the others go on
                failed = graph.errors(rows, F.lit(str(e).splitlines()[0][:400] if str(e) else type(e).__name__))
                failed = failed.withColumns({"id": keys.uuid7(), "unit": F.lit(""), "input_key": keys.labelled("error", F.col("input_key"), F.lit(run_id)), "run_id": F.lit(run_id), "created_at": F.lit(moment), "cost_usd": F.lit(None).cast("double"), "message_ids": F.lit(None).cast("array<string>")})
                fresh = cut(failed.select(*NODE))
                out[analyzer.id]["failed"] = asked[analyzer.id]
            runs.append((run_id, analyzer.id, "failed" if "failed" in out[analyzer.id] else "done", asked[analyzer.id], moment, datetime.now(UTC)))
            fresh = fresh.select(*NODE)
            written = fresh if written is None else written.union(fresh)
        if written is None:
            continue
        # edges before nodes: a node that can be read has its edges
        edges = cut(_edges(written, nodes).join(written.select(F.col("id").alias("from_node_id"), "analyzer_id"), "from_node_id"))
        rows = {"edges": edges, "nodes": written} | ({"proposals": cut(advised)} if advised is not None else {})
        for name, frame in rows.items():
            store.append(name, frame, stored=True)
            for r in frame.groupBy("analyzer_id").agg(F.count("*").alias("n")).collect():
                out[r.analyzer_id][name] = r.n
        store.append("runs", store.spark.createDataFrame(runs, SCHEMAS["runs"]), stored=True)
    return out


def node_detail(store: Store, ref: str) -> DataFrame:
    """A node, by the start of its output key, with each of its edges and what they lead to: (node columns, edge_kind, to_ref_kind, to_ref_id, target)."""
    nodes = graph.live(store.nodes())
    one = graph.find(nodes, ref)
    known = nodes.select(F.col("output_key").alias("to_ref_id"), F.lit("analysis_node").alias("to_ref_kind"), F.concat_ws(" ", "analyzer_id", "node_kind", F.substring("content_json", 1, 80)).alias("target")).dropDuplicates(["to_ref_id"])
    said = store.read("messages").select(F.col("id").alias("to_ref_id"), F.lit("message").alias("to_ref_kind"), F.concat_ws(" ", "role", F.substring(F.coalesce("content_text", F.lit("")), 1, 80)).alias("target"))
    edges = store.read("edges").join(one.select(F.col("id").alias("from_node_id")), "from_node_id", "left_semi").join(known.union(said), ["to_ref_kind", "to_ref_id"], "left")
    return one.join(edges, one["id"] == edges["from_node_id"], "left").drop("from_node_id")


def mute_edges(nodes: DataFrame, edges: DataFrame, assertions: DataFrame) -> DataFrame:
    """New edges from the latest lexicon node of each muted term to the assertion that mutes it."""
    muted = assertions.where("subject_kind = 'term' and verdict = 'rejected'").select(F.col("subject_key").alias("unit"), keys.assertion_id(F.col("subject_kind"), F.col("subject_key"), F.col("verdict")).alias("to_ref_id")).distinct()
    last = graph.latest(graph.live(nodes).where("analyzer_id = 'frustration-lexicon'"), "unit").select("unit", F.col("id").alias("from_node_id"))
    known = edges.where("edge_kind = 'mutes'").select("from_node_id", "to_ref_id")
    out = last.join(muted, "unit").join(known, ["from_node_id", "to_ref_id"], "left_anti")
    return out.select("from_node_id", F.lit("assertion").alias("to_ref_kind"), "to_ref_id", F.lit("mutes").alias("edge_kind"), F.lit(0).alias("ordinal"))


def session_list(store: Store, recent: int | None = None, unanalysed: bool = False, source: str | None = None) -> DataFrame:
    """(session_id, source, started_at, messages, analysed): all sessions, those without a result, or the most recent ones."""
    rows = store.read("messages")
    rows = rows if source is None else rows.where(F.col("source") == source)
    out = rows.groupBy("session_id").agg(F.min("source").alias("source"), F.min("timestamp").alias("started_at"), F.count("*").alias("messages"))
    done = graph.live(store.nodes()).where(F.col("node_kind") != ERROR).select("session_id").distinct().withColumn("analysed", F.lit(True))
    out = out.join(done, "session_id", "left").na.fill(False, ["analysed"])
    if unanalysed:
        out = out.where("not analysed")
    return out.orderBy(F.desc_nulls_last("started_at"), "session_id").limit(recent) if recent is not None else out
