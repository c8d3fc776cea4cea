"""The tables of the model; JSON stays at the edges, arrays and structs inside."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

USAGE = "struct<input:bigint,output:bigint,cacheRead:bigint,cacheWrite:bigint,totalTokens:bigint,costUsd:double>"
TOOL_CALL = "struct<id:string,name:string,arguments:string>"
TOOL_RESULT = "struct<toolCallId:string,toolName:string,isError:boolean,textLength:bigint,status:string,runId:string>"

SESSIONS = (
    "id string, file_path string, project string, source string, cwd string, parent_session string, name string, started_at timestamp, "
    "message_count bigint, branch_count bigint, tool_inventory array<struct<name:string,definitionChars:bigint>>"
)
MESSAGES = (
    "id string, session_id string, seq bigint, source string, parent_id string, timestamp timestamp, role string, content_text string, content_thinking string, "
    f"tool_calls array<{TOOL_CALL}>, tool_results array<{TOOL_RESULT}>, usage {USAGE}, content_hash string, model string, cost_usd double, provider_message_id string, stop_reason string, error_message string"
)
SUBAGENT_RUNS = ("run_id string, project string, agent string, task_excerpt string, exit_code int, error string, n_attempts int, n_failed_attempts int, usage " + USAGE + ", turns bigint")
NODES = (
    "id string, session_id string, analyzer_id string, version string, node_kind string, content_json string, source_set_hash string, input_key string, output_key string, "
    "config_fingerprint string, run_id string, cost_usd double, created_at timestamp, retracted_at timestamp, retracted_by_run string"
)
EDGES = "from_node_id string, to_ref_kind string, to_ref_id string, edge_kind string, ordinal int"
PROPOSALS = (
    "id string, created_at timestamp, session_id string, source_node_id string, analyzer_id string, target_type string, title string, severity string, summary string, detail string, "
    "confidence double, cost_usd double, status string, input_key string, source_message_ids array<string>, validated_score double, validation_status string"
)
ASSERTIONS = "id string, subject_kind string, subject_key string, verdict string, reason string, asserted_at timestamp, asserted_by string, superseded_at timestamp, disposition string"

#: Legal targets of each kind of edge.
EDGE_TARGETS = {
    "anchors": ("session", "message"),
    "consumes": ("analysis_node",),
    "uses_prompt": ("prompt_version",),
    "uses_config": ("config_version",),
    "produces": ("proposal",),
    "revises": ("analysis_node",),
    "contrasts_with": ("session",),
    "mutes": ("assertion",),
}
#: Roles that open a turn.
TURN_ROLES = ("user", "bashExecution", "branch_summary", "custom_message")
COMPACTION_ROLES = ("compactionSummary", "compaction")
TURN_WORD_ROLES = ("user", "custom_message")


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
