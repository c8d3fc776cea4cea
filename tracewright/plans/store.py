"""Tables in a folder, appended to and never changed: the graph, proposals, decisions, assertions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright import schema
from tracewright.session import cut
from tracewright.sources import transcripts
from tracewright.streaming.ingest import append_new

SCHEMAS = {
    "nodes": "id string, session_id string, analyzer_id string, version string, node_kind string, unit string, content_json string, source_set_hash string, input_key string, output_key string, config_fingerprint string, run_id string, cost_usd double, created_at timestamp",
    "edges": schema.EDGES,
    "retractions": "node_id string, retracted_at timestamp, by_run string, undone boolean",
    "proposals": "id string, created_at timestamp, session_id string, source_node_id string, analyzer_id string, title string, severity string, detail string, confidence double, cost_usd double, input_key string",
    "validations": "proposal_id string, validated_score double, validation_status string, validated_at timestamp",
    "decisions": "id string, input_key string, verdict string, reason string, disposition string, decided_at timestamp",
    "assertions": "subject_kind string, subject_key string, verdict string, reason string, asserted_at timestamp",
    "runs": "run_id string, analyzer_id string, outcome string, n bigint, started_at timestamp, ended_at timestamp",
}


class Store:
    """The tables of a folder; a table that was never written is empty."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _there(self, name: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path)

    def read(self, name: str) -> DataFrame:
        if self._there(name):
            return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.path}/{name}") if name in SCHEMAS else self.spark.read.parquet(f"{self.path}/{name}")
        if name not in SCHEMAS:
            raise ValueError(f"{self.path} has no {name}; sync first")
        return schema.empty(self.spark, SCHEMAS[name])

    def append(self, name: str, rows: DataFrame, stored: bool = False) -> int:
        """Add rows, computed once (``stored``: they are already); how many, which is -1 for stored ones, as nobody counts them."""
        kept = rows.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS[name].split(", ")])
        kept = kept if stored else cut(kept)
        n = -1 if stored else kept.count()
        if n:
            kept.write.mode("append").parquet(f"{self.path}/{name}")
        return n

    def add(self, name: str, **values: object) -> None:
        """Add one row."""
        given = self.spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
        missing = {c.split()[0]: F.lit(None).cast(c.split()[1]) for c in SCHEMAS[name].split(", ") if c.split()[0] not in values}
        self.append(name, given.withColumns(missing) if missing else given)

    def sync(self, source: str, folder: str) -> int:
        """Append the messages of a folder of transcripts that aren't stored yet; only files changed since the last sync of the source are read."""
        last = self.read("messages").where(F.col("source") == source).agg(F.date_format(F.max("synced_at"), "yyyy-MM-dd'T'HH:mm:ss")).first()[0] if self._there("messages") else None
        if source in transcripts.DIALECTS:
            # files of the moment of the last sync are read again: their rows are known by their ids
            rows = transcripts.DIALECTS[source](transcripts.files(self.spark, folder, since=last))
        else:
            rows = transcripts.read(self.spark, source, folder)
        return append_new(rows.withColumn("synced_at", F.current_timestamp()), f"{self.path}/messages")

    def nodes(self) -> DataFrame:
        """All nodes with retracted_at and retracted_by_run, of their last retraction that isn't undone."""
        last = self.read("retractions").groupBy("node_id").agg(F.max_by(F.struct("retracted_at", "by_run", "undone"), F.struct("retracted_at", "undone")).alias("r"))
        gone = last.where("not r.undone").select(F.col("node_id").alias("id"), F.col("r.retracted_at").alias("retracted_at"), F.col("r.by_run").alias("retracted_by_run"))
        return self.read("nodes").join(gone, "id", "left")
