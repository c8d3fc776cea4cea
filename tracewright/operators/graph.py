"""The append-only graph of analysis nodes and edges: identity, views in time, lineage, upkeep.

Nothing is updated in place: a retraction is a row, and the live view is a join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import keys
from tracewright.schema import EDGE_TARGETS

UNIT = ("analyzer_id", "source_set_hash")
REGISTRY = 10_000


def live(nodes: DataFrame) -> DataFrame:
    return nodes.where("retracted_at is null")


def as_of(nodes: DataFrame, moment: Column) -> DataFrame:
    """Nodes that existed, and were not yet retracted, at ``moment``."""
    return nodes.where((F.col("created_at") <= moment) & (F.col("retracted_at").isNull() | (F.col("retracted_at") > moment)))


def latest(nodes: DataFrame, *unit: str, tie: str = "id") -> DataFrame:
    """The last node of each unit by creation, then ``tie``; error nodes are passed over. Aggregates, so one unit's history is never sorted in a task."""
    best = nodes.where("node_kind <> 'error'").groupBy(*unit).agg(F.max_by(F.struct("*"), F.struct("created_at", tie)).alias("_n"))
    return best.select("_n.*")


def versions(nodes: DataFrame, *unit: str) -> DataFrame:
    """Nodes with their number in the unit's history and the output key they revise."""
    w = Window.partitionBy(*unit).orderBy("created_at", "id")
    return nodes.withColumns({"version_no": F.row_number().over(w), "revises": F.lag("output_key").over(w)})


def select_nodes(nodes: DataFrame, analyzers: tuple[str, ...] = (), kind: str | None = None, session: str | None = None, moment: Column | None = None, sources: DataFrame | None = None) -> DataFrame:
    """The conjunction of the filters given; ``sources`` keeps nodes of its sessions (a semi-join)."""
    out = live(nodes) if moment is None else as_of(nodes, moment)
    if analyzers:
        out = out.where(F.col("analyzer_id").isin(*analyzers))
    if kind is not None:
        out = out.where(F.col("node_kind") == kind)
    if session is not None:
        out = out.where(F.col("session_id") == session)
    return out if sources is None else out.join(sources.select("session_id"), "session_id", "left_semi")


def content_is(prop: str, value: str, kind: str = "string") -> Column:
    """A typed filter on a property of a node's content; a value that does not cast matches nothing."""
    return F.get_json_object("content_json", f"$.{prop}").try_cast(kind) == F.lit(value).try_cast(kind)


def count_property(nodes: DataFrame, prop: str) -> DataFrame:
    value = F.coalesce(F.get_json_object("content_json", f"$.{prop}"), F.lit("(no prop)"))
    return nodes.groupBy(value.alias("value")).agg(F.count("*").alias("n"))


def find(nodes: DataFrame, prefix: str) -> DataFrame:
    """Nodes whose output key starts with ``prefix``, with ``is_unique``: whether there is one."""
    hits = nodes.where(F.col("output_key").startswith(prefix))
    # one row, counted by partial sums
    one = hits.agg((F.count("*") == 1).alias("is_unique"))
    return hits.crossJoin(F.broadcast(one))


def node_stats(nodes: DataFrame) -> DataFrame:
    """Nodes by kind, by analyzer and in all (grouping sets): (analyzer_id, node_kind, n, cost_usd)."""
    sets = [[F.col("analyzer_id")], [F.col("node_kind")], []]
    return nodes.groupingSets(sets, "analyzer_id", "node_kind").agg(F.count("*").alias("n"), F.round(F.sum("cost_usd"), 4).alias("cost_usd"))


def coverage(sessions: DataFrame, analyzers: DataFrame, runs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(session_id, missing, n_covered): the analyzers that have neither a run nor a live node on a session, in their order. The registry holds ``REGISTRY`` analyzers at most."""
    if analyzers.count() > REGISTRY:
        raise ValueError(f"a registry of more than {REGISTRY} analyzers")
    done = runs.select("session_id", "analyzer_id").union(live(nodes).where("node_kind <> 'error'").select("session_id", "analyzer_id")).distinct()
    have = done.groupBy("session_id").agg(F.collect_set("analyzer_id").alias("_have"))
    registry = F.broadcast(analyzers.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "analyzer_id"))), lambda x: x["analyzer_id"]).alias("_all"), F.lit(1).alias("_one")))
    joined = sessions.select("session_id", F.lit(1).alias("_one")).join(registry, "_one").join(have, "session_id", "left")
    missing = F.array_except("_all", F.coalesce("_have", F.array().cast("array<string>")))
    return joined.select("session_id", missing.alias("missing"), (F.size("_all") - F.size(missing)).alias("n_covered"))


def illegal_edges(edges: DataFrame) -> DataFrame:
    legal = [f"{kind}>{target}" for kind, targets in EDGE_TARGETS.items() for target in targets]
    return edges.where(~F.concat_ws(">", "edge_kind", "to_ref_kind").isin(*legal))


def dangling(edges: DataFrame, nodes: DataFrame, targets: dict[str, DataFrame]) -> DataFrame:
    """Edges (with ``fault``) whose source node, or target of its kind (a frame with one column ``id``), is not there: an anti-join per kind."""
    out = edges.join(nodes.select(F.col("id").alias("from_node_id")), "from_node_id", "left_anti").withColumn("fault", F.lit("source"))
    for kind, frame in targets.items():
        part = edges.where(F.col("to_ref_kind") == kind).join(frame.select(F.col("id").alias("to_ref_id")), "to_ref_id", "left_anti")
        out = out.unionByName(part.withColumn("fault", F.lit("target")))
    return out


def classify(units: DataFrame, nodes: DataFrame) -> DataFrame:
    """Units (analyzer_id, version, config_fingerprint, source_set_hash, input_key) with ``status`` missing, stale or current, and ``reasons`` for stale ones.

    A unit is current when a live node has its input key; stale when its sources were analysed under
    another version or configuration.
    """
    keep = live(nodes).where("node_kind <> 'error'")
    known = keep.select("input_key").distinct().withColumn("_current", F.lit(True))
    last = latest(keep, *UNIT).select(*UNIT, F.col("version").alias("_version"), F.col("config_fingerprint").alias("_config"))
    part = lambda c, i: F.split(F.col(c), r"\.")[i].try_cast("int")
    major = part("version", 0) > part("_version", 0)
    minor = (part("version", 0) == part("_version", 0)) & (part("version", 1) > part("_version", 1))
    grade = F.when(major, "major").when(minor, "minor")
    config = F.when(F.col("config_fingerprint") != F.col("_config"), "config")
    status = F.when(F.col("_current"), "current").when(F.col("_version").isNotNull(), "stale").otherwise("missing")
    joined = units.join(known, "input_key", "left").join(last, list(UNIT), "left")
    return joined.withColumn("status", status).withColumn("reasons", F.when(F.col("status") == "stale", F.array_compact(F.array(grade, config)))).drop("_current", "_version", "_config")


def wanted(classified: DataFrame, reasons: tuple[str, ...] = ()) -> DataFrame:
    """Units to compute: missing ones, and stale ones for a requested reason (minor implies major); one for each input key."""
    asked = set(reasons) | ({"major"} if "minor" in reasons else set())
    stale = F.arrays_overlap("reasons", F.array(*[F.lit(r) for r in sorted(asked)])) if asked else F.lit(False)
    return classified.where((F.col("status") == "missing") | ((F.col("status") == "stale") & stale)).dropDuplicates(["input_key"])


def append(nodes: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh nodes whose input key is not yet live, the first of each key: what a batch writes."""
    return fresh.join(live(nodes).where("node_kind <> 'error'").select("input_key"), "input_key", "left_anti").dropDuplicates(["input_key"])


def errors(units: DataFrame, message: Column) -> DataFrame:
    """Error nodes of failed units; their own identity keeps the units missing, so a later run heals them."""
    body = F.to_json(F.struct(message.alias("error")))
    return units.select("*", F.lit("error").alias("node_kind"), body.alias("content_json"), keys.labelled("error", F.col("input_key"), body).alias("output_key"))


def tampered(nodes: DataFrame) -> DataFrame:
    """Nodes whose output key is not that of their content."""
    return nodes.where(keys.output_key(F.col("input_key"), keys.canonical_json(F.col("content_json"))) != F.col("output_key"))


def diff(a: DataFrame, b: DataFrame, *unit: str) -> DataFrame:
    """Units of two node sets (one node each) with ``change``: added, removed, changed or same, and the top-level content keys that differ."""
    left, right = (x.select(*unit, F.col("output_key").alias(f"_k{i}"), F.from_json("content_json", "map<string,string>").alias(f"_c{i}")) for i, x in enumerate((a, b)))
    joined = left.join(right, list(unit), "full")
    names = F.array_distinct(F.concat(F.map_keys("_c0"), F.map_keys("_c1")))
    fields = F.array_sort(F.filter(names, lambda k: ~F.try_element_at("_c0", k).eqNullSafe(F.try_element_at("_c1", k))))
    change = F.when(F.col("_k0").isNull(), "added").when(F.col("_k1").isNull(), "removed").when(F.col("_k0") != F.col("_k1"), "changed").otherwise("same")
    return joined.select(*unit, change.alias("change"), F.when((F.col("_k0") != F.col("_k1")), fields).alias("fields"))


def diff_summary(changes: DataFrame, by: str = "analyzer_id") -> DataFrame:
    return changes.groupBy(by).pivot("change", ["added", "removed", "changed", "same"]).count().na.fill(0)


def collectable(nodes: DataFrame, run_id: str | None = None, analyzer_id: str | None = None, since: Column | None = None) -> DataFrame:
    """Live nodes that a collection by run, analyzer or time would retract."""
    out = live(nodes)
    if run_id is not None:
        out = out.where(F.col("run_id") == run_id)
    if analyzer_id is not None:
        out = out.where(F.col("analyzer_id") == analyzer_id)
    return out if since is None else out.where(F.col("created_at") >= since)


def retract(nodes: DataFrame, gone: DataFrame, moment: Column, by: str) -> DataFrame:
    mark = gone.select("id").distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone") & F.col("retracted_at").isNull()
    return nodes.join(mark, "id", "left").withColumns({"retracted_at": F.when(hit, moment).otherwise(F.col("retracted_at")), "retracted_by_run": F.when(hit, F.lit(by)).otherwise(F.col("retracted_by_run"))}).drop("_gone")


def undo(nodes: DataFrame, by: str) -> DataFrame:
    mine = F.col("retracted_by_run").eqNullSafe(F.lit(by))
    return nodes.withColumns({"retracted_at": F.when(~mine, F.col("retracted_at")), "retracted_by_run": F.when(~mine, F.col("retracted_by_run"))})


def purge(nodes: DataFrame, before: Column) -> DataFrame:
    return nodes.where(F.col("retracted_at").isNull() | (F.col("retracted_at") >= before))


def provenance(proposals: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(proposal_id, depth, ref_kind, ref_id): the node a proposal stems from, what that node consumes, and the messages these are anchored in."""
    roots = proposals.select(F.col("id").alias("proposal_id"), F.col("source_node_id").alias("ref_id"))
    by_key = nodes.select(F.col("output_key").alias("to_ref_id"), F.col("id").alias("_node"))
    used = roots.join(edges.where("edge_kind = 'consumes'"), F.col("ref_id") == F.col("from_node_id")).join(by_key, "to_ref_id").select("proposal_id", F.col("_node").alias("ref_id")).distinct()
    at = roots.withColumn("depth", F.lit(0)).union(used.withColumn("depth", F.lit(1)))
    anchors = at.join(edges.where("edge_kind = 'anchors' and to_ref_kind = 'message'"), F.col("ref_id") == F.col("from_node_id")).select("proposal_id", "depth", F.lit("message").alias("ref_kind"), F.col("to_ref_id").alias("ref_id"))
    return at.select("proposal_id", "depth", F.lit("analysis_node").alias("ref_kind"), "ref_id").union(anchors).distinct()


def retracted(nodes: DataFrame) -> DataFrame:
    """(retracted_by_run, analyzer_id, n, first, last): what collections have retracted and an undo would bring back."""
    return nodes.where("retracted_at is not null").groupBy("retracted_by_run", "analyzer_id").agg(F.count("*").alias("n"), F.min("retracted_at").alias("first"), F.max("retracted_at").alias("last"))


def retracted_by(nodes: DataFrame, by: str) -> DataFrame:
    """The nodes that a collection retracted."""
    return nodes.where(F.col("retracted_by_run") == by)


def backfill(covered: DataFrame) -> DataFrame:
    """(session_id, analyzer_id) still to be run, from :func:`coverage`."""
    return covered.select("session_id", F.explode("missing").alias("analyzer_id"))


def page(nodes: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """A page of nodes, newest first; filters belong before it, so a page is never cut short."""
    return nodes.orderBy(F.desc("created_at"), "id").offset(offset).limit(limit)
