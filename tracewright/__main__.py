"""python -m tracewright VERB: list and run queries; keep a store of transcripts, analyse it, read and decide."""

from __future__ import annotations

import argparse
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright import queries
from tracewright.detect import scan
from tracewright.operators import graph, proposals, search, stats
from tracewright.plans import analyze, builtin, registry
from tracewright.plans.store import Store
from tracewright.session import session
from tracewright.sources import sinks

FIELDS = ("content_text", "content_thinking")
SECRET_FAMILIES = ("secret-leak", "gitleaks", "nosey-parker", "detect-secrets", "trufflehog")


def _parser() -> argparse.ArgumentParser:
    parser = argparse.ArgumentParser(prog="tracewright")
    verbs = parser.add_subparsers(dest="verb", required=True)
    verbs.add_parser("queries", help="names of the queries")
    run = verbs.add_parser("run", help="run a query over a folder of tables")
    run.add_argument("name", choices=sorted(queries.QUERIES))
    run.add_argument("folder")
    run.add_argument("--out", help="write CSV here instead of showing rows")
    run.add_argument("--html", help="write a page here")
    run.add_argument("--limit", type=int, default=20)

    def verb(name: str, text: str, *args: str, **options: dict) -> None:
        p = verbs.add_parser(name, help=text)
        p.add_argument("store", help="folder of the store's tables")
        for a in args:
            p.add_argument(a)
        for o, how in options.items():
            p.add_argument(f"--{o.replace('_', '-')}", **how)

    number, flag = {"type": int}, {"action": "store_true"}
    verb("sync", "append the messages of a folder of transcripts", "source", "folder")
    verb("analyze", "compute what is missing or stale", analyzer={"action": "append"}, session={}, source={}, recent=number, limit=number, revise={"action": "append", "choices": ["major", "minor", "config"]}, analyzer_path={})
    verb("analyzers", "the analyzers in their order")
    verb("validate-analyzer", "check an analyzer on disk", "path")
    verb("output", "the findings of an analyzer", "analyzer", as_of={}, out={}, limit=number)
    verb("stats", "messages by role, nodes, proposals, tokens", as_of={})
    verb("sessions", "sessions, most recent first", recent=number, unanalysed=flag, source={})
    verb("proposals", "proposals, ranked", status={}, severity={}, session={}, source={}, limit=number, as_of={})
    verb("show", "a proposal with what it stems from", "id")
    verb("summary", "what is known of a session", "session")
    verb("nodes", "nodes, newest first", analyzer={"action": "append"}, node_kind={}, session={}, filter={"action": "append", "default": []}, counts={}, as_of={}, limit=number, offset=number)
    verb("node", "a node with its edges", "key")
    verb("diff", "what changed between two moments", "then", "now", full=flag)
    verb("runs", "runs of analyzers", limit=number)
    verb("verify", "nodes whose content is not what their key says, and edges that lead nowhere")
    verb("gc", "retract the nodes of a run, an analyzer or a time", run={}, analyzer={}, since={}, apply=flag)
    verb("retract", "list retractions, undo one", undo={})
    for name in ("accept", "reject"):
        verb(name, f"{name} proposals", "ids", reason={}, disposition={"choices": ["planned", "done", "done-differently"]})
    verb("remediate", "say how accepted proposals were put into effect", "ids", "reason", disposition={"choices": ["planned", "done", "done-differently"], "default": "done"})
    verb("validate", "append replay scores from a table of replays", "replays")
    verb("mute", "mute a term", "term", reason={})
    verb("unmute", "unmute a term", "term")
    verb("mutes", "muted terms")
    verb("leaks", "findings of secrets", severity={"default": "high", "choices": list(scan.SEVERITIES)}, limit={"type": int, "default": 50}, source={})
    verb("search", "search messages and proposals", "query", kind={"default": "all", "choices": ["all", "messages", "proposals"]}, limit={"type": int, "default": 20})
    return parser


def _at(text: str | None) -> object:
    return None if text is None else F.lit(registry.moment(text))


def _proposals(store: Store, as_of: str | None = None) -> DataFrame:
    """Proposals with their standing: validation, decision, disposition."""
    decisions = store.read("decisions")
    rows = proposals.apply_validation(
        store.read("proposals").withColumns({"status": F.lit("open"), "validated_score": F.lit(None).cast("double"), "validation_status": F.lit("unvalidated")}),
        store.read("validations").groupBy("proposal_id").agg(F.max_by(F.struct("validated_score", "validation_status"), "validated_at").alias("v")).select("proposal_id", "v.*"),
    )
    if as_of is not None:
        return rows.drop("status").join(proposals.status_as_of(rows, decisions, _at(as_of)), "input_key")
    return proposals.decide(rows, decisions)


def _ids(store: Store, ids: str) -> DataFrame:
    """Open proposals whose id starts with one of a comma-separated list."""
    wanted = [x for x in ids.split(",") if x]
    test = F.lit(False)
    for x in wanted:
        test = test | F.col("id").startswith(x)
    return _proposals(store).where(test)


def _decide(store: Store, ids: str, verdict: str, reason: str | None, disposition: str | None) -> int:
    rows = _ids(store, ids).where("status = 'open'" if verdict != "remediated" else "status = 'applied'")
    fresh = rows.select(F.uuid().alias("id"), "input_key", F.lit(verdict).alias("verdict"), F.lit(reason).cast("string").alias("reason"), F.lit(disposition).cast("string").alias("disposition"), F.lit(datetime.now(UTC)).alias("decided_at"))
    return store.append("decisions", fresh)


def _assert(store: Store, term: str, verdict: str, reason: str | None) -> None:
    store.add("assertions", subject_kind="term", subject_key=term, verdict=verdict, reason=reason or "", asserted_at=datetime.now(UTC))
    now = proposals.active(proposals.upsert(store.read("assertions")))
    store.append("edges", analyze.mute_edges(store.nodes(), store.read("edges"), now))


def leaks(store: Store, severity: str = "high", source: str | None = None) -> DataFrame:
    """Findings of secrets at or above a severity: (session_id, analyzer_id, rule_id, severity, redacted_preview, fingerprint, message_id)."""
    nodes = graph.live(store.nodes()).where((F.col("node_kind") == analyze.FINDING) & F.col("analyzer_id").isin(*SECRET_FAMILIES))
    body = F.from_json("content_json", "rule_id string, severity string, redacted_preview string, fingerprint string, message_id string, gate string")
    rows = nodes.select("session_id", "analyzer_id", body.alias("b")).select("session_id", "analyzer_id", "b.*").where("gate is null").drop("gate")
    rows = rows.where(scan.severity_rank(F.col("severity")) >= scan.SEVERITIES.index(severity) + 1)
    if source is not None:
        rows = rows.join(store.read("messages").where(F.col("source") == source).select("session_id"), "session_id", "left_semi")
    return rows


def found(store: Store, query: str, kind: str = "all", limit: int = 20) -> DataFrame:
    """Hits among messages and proposals in one list."""
    hits = {}
    for name, rows, fields in (("messages", lambda: store.read("messages"), FIELDS), ("proposals", lambda: store.read("proposals"), ("title", "detail"))):
        if kind in ("all", name):
            table = rows()
            hits[name.rstrip("s")] = search.search(search.index(table, "id", fields, query), query, *search.statistics(sizes=search.lengths(table, "id", fields)))
    return search.merged(hits, limit)


def nodes_view(store: Store, a: argparse.Namespace) -> DataFrame:
    rows = graph.select_nodes(store.nodes(), tuple(a.analyzer or ()), a.node_kind, a.session, _at(a.as_of))
    for pair in a.filter:
        prop, _, value = pair.partition("=")
        rows = rows.where(graph.content_is(prop, value))
    if a.counts:
        return graph.count_property(rows, a.counts)
    return graph.page(rows, a.limit or 50, a.offset or 0).select("output_key", "analyzer_id", "node_kind", "session_id", "unit", "content_json", "created_at")


def collect_garbage(store: Store, run: str | None, analyzer: str | None, since: str | None, apply: bool) -> DataFrame:
    """What would be retracted, by analyzer; with ``apply`` it is."""
    if not (run or analyzer or since):
        raise ValueError("name a run, an analyzer or a time")
    gone = graph.collectable(store.nodes(), run, analyzer, _at(since))
    out = gone.groupBy("analyzer_id", "node_kind").agg(F.count("*").alias("n"))
    if apply:
        by = uuid.uuid4().hex[:16]
        rows = out.collect()  # a row for each analyzer and kind
        store.append("retractions", gone.select(F.col("id").alias("node_id"), F.lit(datetime.now(UTC)).alias("retracted_at"), F.lit(by).alias("by_run"), F.lit(False).alias("undone")))
        return store.spark.createDataFrame([(*r, by) for r in rows], "analyzer_id string, node_kind string, n bigint, by_run string")
    return out


def undo(store: Store, by: str) -> int:
    gone = graph.retracted_by(store.nodes(), by)
    return store.append("retractions", gone.select(F.col("id").alias("node_id"), F.lit(datetime.now(UTC)).alias("retracted_at"), F.lit(by).alias("by_run"), F.lit(True).alias("undone")))


def verify(store: Store) -> DataFrame:
    """(fault, ref): nodes that were tampered with, edges of illegal kinds or without a source or target."""
    nodes, edges = store.nodes(), store.read("edges")
    messages = store.read("messages")
    targets = {"message": messages.select("id"), "session": messages.select(F.col("session_id").alias("id")).distinct(), "analysis_node": nodes.select(F.col("output_key").alias("id")).distinct()}
    bad = graph.tampered(nodes.where(F.col("node_kind") != analyze.ERROR)).select(F.lit("content is not what the key says").alias("fault"), F.col("output_key").alias("ref"))
    of = lambda rows, fault: rows.select(fault.alias("fault"), F.concat_ws(" ", "from_node_id", "edge_kind", "to_ref_id").alias("ref"))
    return bad.union(of(graph.illegal_edges(edges), F.lit("illegal kind of edge"))).union(of(graph.dangling(edges, nodes, targets), F.concat(F.lit("no "), "fault")))


def summary(store: Store, ident: str) -> DataFrame:
    rows = graph.select_nodes(store.nodes(), session=ident).where(F.col("analyzer_id").isin("session-overview", "tool-trajectory", "failure-modes", "cache-economy") & (F.col("node_kind") == analyze.FINDING))
    return rows.select("analyzer_id", "unit", "content_json").unionByName(_proposals(store).where(F.col("session_id") == ident).select(F.lit("proposal").alias("analyzer_id"), F.col("title").alias("unit"), F.col("detail").alias("content_json"))).orderBy("analyzer_id", "unit")


def act(a: argparse.Namespace, store: Store) -> DataFrame | str:
    """What a verb gives: rows to show, or a line."""
    verb = a.verb
    if verb == "sync":
        return f"{store.sync(a.source, a.folder)} new messages"
    if verb == "analyze":
        analyzers = [*builtin.ANALYZERS, *([registry.load(a.analyzer_path)] if a.analyzer_path else [])]
        chosen = None
        if a.session or a.recent is not None or a.source:
            chosen = analyze.session_list(store, a.recent, source=a.source)
            chosen = chosen.where(F.col("session_id") == a.session) if a.session else chosen
        done = analyze.analyze(store, analyzers, tuple(a.analyzer or ()), chosen, tuple(a.revise or ()), a.limit)
        return "\n".join(f"{k}: {', '.join(f'{n} {what}' for what, n in v.items())}" for k, v in done.items())
    if verb == "analyzers":
        return "\n".join(f"{x.id} {x.version} {' '.join(x.depends_on)}".rstrip() for x in registry.ordered(builtin.ANALYZERS))
    if verb == "validate-analyzer":
        return f"{registry.load(a.path).id} is sound"
    if verb == "output":
        analyzer, _ = registry.resolve(a.analyzer, builtin.ANALYZERS)
        rows = graph.select_nodes(store.nodes(), (analyzer.id,), analyze.FINDING, moment=_at(a.as_of)).select("session_id", "unit", "content_json", "output_key")
        if a.out:
            sinks.write_csv(rows, a.out)
            return f"written to {a.out}"
        return rows.orderBy("session_id", "unit").limit(a.limit or 50)
    if verb == "stats":
        kinds = graph.node_stats(graph.live(store.nodes()) if a.as_of is None else graph.as_of(store.nodes(), _at(a.as_of)))
        said = stats.message_stats(store.read("messages")).select(F.concat_ws(" ", F.lit("messages"), F.coalesce("role", F.lit("all"))).alias("what"), F.col("n_messages").alias("n"))
        of_nodes = kinds.select(F.concat_ws(" ", F.lit("nodes"), F.coalesce("analyzer_id", "node_kind", F.lit("all"))).alias("what"), "n")
        of_proposals = stats.status_counts(_proposals(store, a.as_of)).select(F.concat_ws(" ", F.lit("proposals"), "status", "validation_status").alias("what"), "n")
        return said.union(of_nodes).union(of_proposals).orderBy("what")
    if verb == "sessions":
        return analyze.session_list(store, a.recent, a.unanalysed, a.source)
    if verb == "proposals":
        rows = _proposals(store, a.as_of)
        chosen = store.read("messages").where(F.col("source") == a.source) if a.source else None
        return proposals.listed(rows, a.status, a.severity, a.session, chosen, a.limit).select("id", "status", "severity", "confidence", "cost_usd", "session_id", "title", "detail")
    if verb == "show":
        one = _proposals(store).where(F.col("id").startswith(a.id))
        return proposals_with_source(store, one)
    if verb == "summary":
        return summary(store, a.session)
    if verb == "nodes":
        return nodes_view(store, a)
    if verb == "node":
        return analyze.node_detail(store, a.key)
    if verb == "diff":
        nodes = store.nodes()
        sides = [graph.latest(graph.as_of(nodes, _at(t)), "analyzer_id", "session_id", "unit", "node_kind") for t in (a.then, a.now)]
        changes = graph.diff(*sides, "analyzer_id", "session_id", "unit", "node_kind")
        return changes.where("change <> 'same'") if a.full else graph.diff_summary(changes)
    if verb == "runs":
        return store.read("runs").orderBy(F.desc("started_at")).limit(a.limit or 20)
    if verb == "verify":
        return verify(store)
    if verb == "gc":
        return collect_garbage(store, a.run, a.analyzer, a.since, a.apply)
    if verb == "retract":
        return f"{undo(store, a.undo)} nodes are back" if a.undo else graph.retracted(store.nodes())
    if verb in ("accept", "reject"):
        return f"{_decide(store, a.ids, verb + 'ed', a.reason, a.disposition)} {verb}ed"
    if verb == "remediate":
        return f"{_decide(store, a.ids, 'remediated', a.reason, a.disposition)} remediated"
    if verb == "validate":
        scores = proposals.replay_score(store.spark.read.parquet(a.replays)).withColumn("validated_at", F.lit(datetime.now(UTC)))
        return f"{store.append('validations', scores)} scored"
    if verb in ("mute", "unmute"):
        _assert(store, a.term, "rejected" if verb == "mute" else "accepted", getattr(a, "reason", None))
        return f"{verb}d {a.term}"
    if verb == "mutes":
        return proposals.muted(proposals.upsert(store.read("assertions")))
    if verb == "leaks":
        rows = leaks(store, a.severity, a.source)
        return rows.orderBy("session_id", "fingerprint", "rule_id").limit(a.limit).crossJoin(F.broadcast(rows.agg((F.greatest(F.lit(0), F.count("*") - a.limit)).alias("omitted"))))
    return found(store, a.query, a.kind, a.limit)


def proposals_with_source(store: Store, rows: DataFrame) -> DataFrame:
    """Proposals with the node they stem from and the messages that it is anchored in."""
    nodes = store.nodes()
    trail = graph.provenance(rows, nodes, store.read("edges"))
    return rows.select(F.col("id").alias("proposal_id"), "title", "detail", "status").join(trail, "proposal_id", "left").orderBy("proposal_id", "depth", "ref_kind", "ref_id")


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    if a.verb == "queries":
        print("\n".join(sorted(queries.QUERIES)))
        return
    spark = session()
    if a.verb == "run":
        rows = queries.QUERIES[a.name](spark, a.folder)
        if a.out:
            sinks.write_csv(rows, a.out)
        if a.html:
            with open(a.html, "w") as file:
                file.write(sinks.html_page(rows, a.name))
        if not a.out and not a.html:
            rows.show(a.limit, truncate=False)
        return
    given = act(a, Store(spark, a.store))
    if isinstance(given, str):
        print(given)
    else:
        given.show(getattr(a, "limit", None) or 50, truncate=False)


if __name__ == "__main__":
    main()
