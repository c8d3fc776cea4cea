"""Proposals, the decisions on them, and assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.functions import keys

PROPOSED = "array<struct<title:string,severity:string,summary:string,detail:string,confidence:double,message_ids:array<string>>>"


def materialise(nodes: DataFrame, known: DataFrame, content: Column | None = None) -> DataFrame:
    """The proposals in nodes' contents (property ``proposals``) whose key is not known yet."""
    listed = F.from_json(F.get_json_object("content_json", "$.proposals") if content is None else content, PROPOSED)
    rows = nodes.select(F.col("id").alias("source_node_id"), "session_id", "analyzer_id", "output_key", "created_at", F.posexplode(listed).alias("ordinal", "p"))
    rows = rows.select("*", keys.proposal_key(F.col("output_key"), F.col("ordinal")).alias("input_key"), F.trim("p.title").alias("title"), F.lower("p.severity").alias("severity"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("p.confidence"))).alias("confidence"), F.col("p.message_ids").alias("source_message_ids"))
    return rows.where("title <> ''").join(known.select("input_key"), "input_key", "left_anti").dropDuplicates(["input_key"]).withColumn("status", F.lit("open")).drop("p")


def rank(proposals: DataFrame) -> DataFrame:
    """``proposals`` with ``rank``: by validation tier, cost (unpriced last), score, newest. Ranks are given within the tier first, so the sort is spread."""
    tier = F.when(F.col("validation_status") == "supported", 2).when(F.col("validation_status") == "unsupported", 0).otherwise(1)
    return proposals.withColumn("tier", tier).orderBy(F.desc("tier"), F.desc(F.coalesce("cost_usd", F.lit(-1.0))), F.desc_nulls_last("validated_score"), F.desc("created_at"), "id")


def replay_score(replays: DataFrame, supported: float = 0.5) -> DataFrame:
    """Per proposal: averted over baseline friction; null (unvalidated) without replays, 0 (unsupported) without baseline friction."""
    sums = replays.groupBy("proposal_id").agg(F.count("baseline").alias("replayed"), F.coalesce(F.sum("baseline"), F.lit(0.0)).alias("baseline"), F.coalesce(F.sum(F.greatest(F.lit(0.0), F.col("baseline") - F.col("with_rule"))), F.lit(0.0)).alias("averted"))
    score = F.when(F.col("replayed") == 0, F.lit(None).cast("double")).when(F.col("baseline") == 0, 0.0).otherwise(F.round(F.try_divide("averted", "baseline"), 6))
    out = sums.withColumn("validated_score", score)
    return out.withColumn("validation_status", F.when(F.col("validated_score").isNull(), "unvalidated").when(F.col("validated_score") >= supported, "supported").otherwise("unsupported"))


def apply_validation(proposals: DataFrame, scores: DataFrame) -> DataFrame:
    """Open proposals take the newest score of theirs; others keep what they have."""
    new = scores.select(F.col("proposal_id").alias("id"), F.col("validated_score").alias("_s"), F.col("validation_status").alias("_v"))
    isopen = F.col("status") == "open"
    return proposals.join(new, "id", "left").withColumns({"validated_score": F.when(isopen, F.coalesce("_s", "validated_score")).otherwise(F.col("validated_score")), "validation_status": F.when(isopen, F.coalesce("_v", "validation_status")).otherwise(F.col("validation_status"))}).drop("_s", "_v")


def decide(proposals: DataFrame, decisions: DataFrame) -> DataFrame:
    """Proposals after the latest decision on each key; only open ones move."""
    last = decisions.groupBy("input_key").agg(F.max_by("verdict", F.struct("decided_at", "id")).alias("_verdict"))
    moved = F.when(F.col("_verdict") == "rejected", "rejected").when(F.col("_verdict").isNotNull(), "applied")
    return proposals.join(last, "input_key", "left").withColumn("status", F.when(F.col("status") == "open", F.coalesce(moved, "status")).otherwise(F.col("status"))).drop("_verdict")


def status_as_of(proposals: DataFrame, decisions: DataFrame, moment: Column) -> DataFrame:
    """(input_key, status) at a moment: the latest decision until then; the live status plays no part."""
    past = proposals.where(F.col("created_at") <= moment).withColumn("status", F.lit("open"))
    return decide(past, decisions.where(F.col("decided_at") <= moment)).select("input_key", "status")


def upsert(asserted: DataFrame) -> DataFrame:
    """Assertions by id: the last reason and time, the first time they were made; a later verdict on a subject supersedes the earlier."""
    by_id = asserted.groupBy("subject_kind", "subject_key", "verdict").agg(F.max("asserted_at").alias("asserted_at"), F.max_by("reason", F.struct("asserted_at", "reason")).alias("reason"), F.count("*").alias("times"))
    later = F.lead("asserted_at").over(Window.partitionBy("subject_kind", "subject_key").orderBy("asserted_at", "verdict"))
    return by_id.withColumns({"id": keys.assertion_id(F.col("subject_kind"), F.col("subject_key"), F.col("verdict")), "superseded_at": later})


def active(assertions: DataFrame, kind: str | None = None) -> DataFrame:
    out = assertions.where("superseded_at is null")
    return out if kind is None else out.where(F.col("subject_kind") == kind)


def muted(assertions: DataFrame, kind: str = "term") -> DataFrame:
    return active(assertions, kind).where("verdict = 'rejected'").select(F.col("subject_key").alias("term"))


def fingerprint(assertions: DataFrame) -> DataFrame:
    """One row: the address of all active assertions, whatever their order (a sum of row hashes, so nothing is gathered)."""
    one = F.conv(F.substring("id", 1, 13), 16, 10).cast("bigint")
    return active(assertions).agg(keys.labelled("assertions", F.count("*").cast("string"), F.coalesce(F.sum(one.cast("decimal(38,0)")), F.lit(0)).cast("string")).alias("fingerprint"))


def reconcile(log: DataFrame, assertions: DataFrame) -> DataFrame:
    """(subject_key, verdict, only_in): entries that only the decision log or only the assertions hold."""
    a, b = log.select("subject_key", "verdict").distinct(), assertions.select("subject_key", "verdict").distinct()
    return a.join(b, ["subject_key", "verdict"], "left_anti").withColumn("only_in", F.lit("log")).union(b.join(a, ["subject_key", "verdict"], "left_anti").withColumn("only_in", F.lit("assertions")))


def listed(proposals: DataFrame, status: str | None = None, severity: str | None = None, session: str | None = None, sources: DataFrame | None = None, limit: int | None = None, offset: int = 0) -> DataFrame:
    """The conjunction of the filters given, ranked; a page of it if ``limit`` is given."""
    out = proposals
    for name, value in (("status", status), ("severity", severity), ("session_id", session)):
        if value is not None:
            out = out.where(F.col(name) == value)
    if sources is not None:
        out = out.join(sources.select("session_id"), "session_id", "left_semi")
    out = rank(out)
    return out if limit is None else out.offset(offset).limit(limit)


def remediate(proposals: DataFrame, keys_done: DataFrame) -> DataFrame:
    """Applied proposals with how they were put into effect: (input_key, disposition, actual_change); others are left as they are."""
    done = keys_done.groupBy("input_key").agg(F.max_by(F.struct("disposition", "actual_change"), "decided_at").alias("_d"))
    applied = F.col("status") == "applied"
    return proposals.join(done, "input_key", "left").withColumns({"disposition": F.when(applied, F.col("_d.disposition")), "actual_change": F.when(applied, F.col("_d.actual_change"))}).drop("_d")


def from_decisions(decisions: DataFrame) -> DataFrame:
    """A decision log as assertions, ready for :func:`upsert`."""
    return decisions.select(F.lit("proposal").alias("subject_kind"), F.col("input_key").alias("subject_key"), "verdict", F.col("reason") if "reason" in decisions.columns else F.lit(None).cast("string").alias("reason"), F.col("decided_at").alias("asserted_at"))
