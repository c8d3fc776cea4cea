"""Readers of recorded conversations: two dialects of JSON lines, and delegated runs' metadata.

Files are read by lines, so a large transcript is many splits; lines get their numbers from the splits'
places in the file. They are parsed as VARIANT, since contents are text or arrays. Lines
that do not parse are skipped. The first row of an id in discovery order stands for it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession, Window
from pyspark.sql import functions as F

EXCERPT = 200
# Tools that delegate work, and names that one dialect gives to tools.
ORCHESTRATION = ("subagent", "subagent_parallel", "subagent_chain")
TOOL_NAMES = {"Bash": "bash", "Read": "read", "Edit": "edit", "Write": "write", "Glob": "glob", "Grep": "grep", "MultiEdit": "edit", "Task": "subagent"}

_PART = "array<struct<type:string,text:string,thinking:string,id:string,name:string,arguments:variant,input:variant,tool_use_id:string,is_error:boolean,content:variant>>"


def _get(path: str, kind: str = "string", of: str = "v") -> Column:
    return F.try_variant_get(F.col(of), path, kind)


def _text(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def project_name(directory: Column, user: str) -> Column:
    """The project a directory name stands for: home prefixes off, separators to slashes."""
    out = None
    for prefix, sep in ((f"--Users-{user}--", "--"), (f"--home-{user}--", "--"), (f"-Users-{user}-", "-"), (f"-home-{user}-", "-"), ("--", "--"), ("-", "-")):
        value = F.replace(F.substr(directory, F.lit(len(prefix) + 1)), F.lit(sep), F.lit("/"))
        out = F.when(directory.startswith(prefix), value) if out is None else out.when(directory.startswith(prefix), value)
    return F.coalesce(F.nullif(F.regexp_replace(out.otherwise(directory), "[-/]+$", ""), F.lit("")), F.lit("workspace"))


def files(spark: SparkSession, path: str, user: str = "user", projects: tuple[str, ...] = (), since: str | None = None) -> DataFrame:
    """(file_path, project, stem, modified, line_no, line) of ``path/<project>/<file>.jsonl``; temporary folders' projects are skipped.

    ``projects`` (names of folders) and ``since`` (files modified after that time, ISO 8601 in the session's time zone) hold before anything is read.
    """
    folder = "{" + ",".join(projects) + "}" if projects else "*"
    return _lines(_raw(spark, since).text(f"{path}/{folder}/*.jsonl", lineSep="\n"), user).where(~F.col("directory").contains("var-folders")).drop("directory")


def nested_files(spark: SparkSession, path: str, user: str = "user", since: str | None = None) -> DataFrame:
    """As :func:`files`, for the sessions of delegated runs below ``run-N`` folders, with ``parent_session`` and ``run_no`` from the path."""
    raw = _raw(spark, since).option("recursiveFileLookup", "true").option("pathGlobFilter", "session.jsonl").text(path, lineSep="\n")
    runs = _lines(raw, user).where(F.col("file_path").rlike(r"/run-\d+/session\.jsonl$")).drop("directory")
    return runs.withColumns({"parent_session": F.regexp_extract("file_path", r"([^/]+)/(?:[^/]+/)?run-\d+/session\.jsonl$", 1), "run_no": F.regexp_extract("file_path", r"/run-(\d+)/", 1).cast("int")})


def _raw(spark: SparkSession, since: str | None) -> DataFrameReader:
    return spark.read if since is None else spark.read.option("modifiedAfter", since)


def _lines(raw: DataFrame, user: str) -> DataFrame:
    meta = {"file_path": F.col("_metadata.file_path"), "modified": F.col("_metadata.file_modification_time"), "_block": F.col("_metadata.file_block_start"), "_row": F.monotonically_increasing_id()}
    number = F.row_number().over(Window.partitionBy("file_path").orderBy("_block", "_row")) - 1
    at = F.split("file_path", "/")
    named = raw.select(F.col("value").alias("line"), *[c.alias(n) for n, c in meta.items()]).withColumn("line_no", number).where(F.trim("line") != "")
    named = named.withColumns({"directory": F.element_at(at, -2), "stem": F.regexp_replace(F.element_at(at, -1), r"\.jsonl$", "")})
    return named.select("file_path", "directory", project_name(F.col("directory"), user).alias("project"), "stem", "modified", "line_no", "line")


def _usage(input_: str, output: str, read: str, write: str, total: str | None) -> Column:
    n = lambda path: F.coalesce(_get(path, "bigint"), F.lit(0).cast("bigint"))
    i, o, r, w = n(input_), n(output), n(read), n(write)
    whole = F.coalesce(F.nullif(n(total), F.lit(0)), i + o) if total else i + o
    return F.when(i + o + r + w != 0, F.struct(i.alias("input"), o.alias("output"), r.alias("cacheRead"), w.alias("cacheWrite"), whole.alias("totalTokens")))


def outcome(tool: Column, text: Column) -> Column:
    """(status, runId, failed) of a delegated run's result: revived before child_failed before completed."""
    revived = F.regexp_extract(text, r"(?i)revived\s+(?:async|foreground)\s+subagent\s+from\s+(\S+?)\s*\.", 1)
    failed = F.regexp_extract(text, r"(?i)children:\s*(\d+)\s+failed", 1)
    none = F.lit(None).cast("string")
    of = lambda status, run, n: F.struct(F.lit(status).alias("status"), run.alias("runId"), n.alias("failed"))
    kind = (
        F.when(revived != "", of("revived", revived, none.cast("int")))
        .when((failed != "") | text.contains("[failed]:"), of("child_failed", none, F.nullif(failed, F.lit("")).try_cast("int")))
        .when(text.rlike(r"(?i)delivered single subagent result via intercom|children:\s*\d+\s+completed"), of("completed", none, none.cast("int")))
    )
    return F.when(tool.isin(*ORCHESTRATION), kind)


def _joined(parts: Column, kind: str, field: str) -> Column:
    return _text(F.array_join(F.transform(F.filter(parts, lambda p: (p["type"] == kind) & p[field].isNotNull()), lambda p: p[field]), "\n"))


def _calls(parts: Column, kind: str, args: str, rename: bool) -> Column:
    name = lambda n: F.coalesce(*[F.when(n == k, F.lit(v)) for k, v in TOOL_NAMES.items()], n) if rename else n
    rows = F.transform(F.filter(parts, lambda p: p["type"] == kind), lambda p: F.struct(F.coalesce(p["id"], F.lit("")).alias("id"), F.coalesce(name(p["name"]), F.lit("")).alias("name"), F.to_json(p[args]).alias("arguments")))
    return F.when(F.size(rows) > 0, rows)


def _result(call: Column, tool: Column, error: Column, text: Column) -> Column:
    return F.struct(F.coalesce(call, F.lit("")).alias("toolCallId"), F.coalesce(tool, F.lit("")).alias("toolName"), F.coalesce(error, F.lit(False)).alias("isError"), F.length(F.coalesce(text, F.lit(""))).cast("bigint").alias("textLength"), outcome(tool, text).alias("subagent"))


def pi_messages(lines: DataFrame) -> DataFrame:
    """Messages of the dialect with a header line; entries of other types are messages whose role is their type."""
    parsed = lines.withColumn("v", F.try_parse_json("line")).where("v is not null")
    head = parsed.where(_get("$.type") == "session").groupBy("file_path").agg(F.min_by(_get("$.id"), "line_no").alias("session_id"))
    kind, parts = _get("$.type"), _get("$.message.content", _PART)
    rows = parsed.join(head, "file_path").where(~kind.isin("session", "session_info") & _get("$.id").isNotNull())
    role = F.when(kind == "message", F.coalesce(_get("$.message.role"), F.lit("unknown"))).otherwise(F.coalesce(_get("$.message.role"), kind))
    plain = F.when(parts.isNull(), _get("$.message.content"))
    other = F.coalesce(plain, _get("$.message.summary"), F.concat_ws("\n", _get("$.message.command"), F.when(_get("$.message.command").isNotNull(), F.coalesce(_get("$.message.output"), F.lit("")))), _get("$.summary"))
    text = F.when(kind == "message", F.coalesce(_joined(parts, "text", "text"), plain)).otherwise(F.nullif(F.coalesce(F.nullif(other, F.lit("")), _get("$.summary")), F.lit("")))
    mine = (kind == "message") & (role == "assistant")
    rows = rows.select(
        _get("$.id").alias("id"), "session_id", F.lit("pi").alias("source"), "file_path", "project", "line_no", _get("$.parentId").alias("parent_id"), F.try_to_timestamp(_get("$.timestamp")).alias("timestamp"), role.alias("role"),
        text.alias("content_text"), _joined(parts, "thinking", "thinking").alias("content_thinking"), F.when(kind == "message", _calls(parts, "toolCall", "arguments", False)).alias("tool_calls"),
        F.when((kind == "message") & (role == "toolResult"), F.array(_result(_get("$.message.toolCallId"), _get("$.message.toolName"), _get("$.message.isError", "boolean"), text))).alias("tool_results"),
        F.when(mine, _usage("$.message.usage.input", "$.message.usage.output", "$.message.usage.cacheRead", "$.message.usage.cacheWrite", "$.message.usage.totalTokens")).alias("usage"),
        F.when(mine, _text(F.coalesce(_get("$.message.model"), _get("$.message.responseModel")))).alias("model"), F.when(mine & (_get("$.message.usage.cost.total", "double") > 0), _get("$.message.usage.cost.total", "double")).alias("cost_usd"),
        F.when(mine, _get("$.id")).alias("provider_message_id"), F.when(mine, _text(F.coalesce(_get("$.message.stopReason"), _get("$.message.stop_reason")))).alias("stop_reason"), F.when(mine, _text(_get("$.message.errorMessage"))).alias("error_message"),
    )
    return _finish(rows)


def claude_messages(lines: DataFrame) -> DataFrame:
    """Messages of the dialect without a header: the session is the file's name; rows marked meta are dropped; results get their tool's name from the call of their id in the same file."""
    parsed = lines.withColumn("v", F.try_parse_json("line")).where("v is not null")
    kind, parts = _get("$.type"), _get("$.message.content", _PART)
    rows = parsed.where(kind.isin("user", "assistant") & _get("$.uuid").isNotNull() & ~F.coalesce(_get("$.isMeta", "boolean"), F.lit(False))).withColumns({"kind": kind, "parts": parts})
    # the first call of an id names it; calls without an id name nothing
    named = rows.where("kind = 'assistant'").select("file_path", "line_no", F.posexplode(_calls(F.col("parts"), "tool_use", "input", True)).alias("k", "c")).where("c.id <> ''")
    named = named.groupBy("file_path", "c.id").agg(F.min_by("c.name", F.struct("line_no", "k")).alias("name"))
    names = named.groupBy("file_path").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("_names"))
    inner = lambda p: F.coalesce(F.array_join(F.transform(F.filter(F.try_variant_get(p["content"], "$", "array<struct<type:string,text:string>>"), lambda c: c["type"] == "text"), lambda c: c["text"]), "\n"), F.try_variant_get(p["content"], "$", "string"), F.lit(""))
    results = F.transform(F.filter("parts", lambda p: p["type"] == "tool_result"), lambda p: _result(p["tool_use_id"], F.try_element_at("_names", F.coalesce(p["tool_use_id"], F.lit(""))), p["is_error"], inner(p)))
    texts = F.filter(F.transform("parts", lambda p: F.when(p["type"] == "text", p["text"]).when(p["type"] == "tool_result", F.nullif(inner(p), F.lit("")))), lambda t: t.isNotNull())
    plain = F.when(F.col("parts").isNull(), _get("$.message.content"))
    mine, failed = F.col("kind") == "assistant", F.coalesce(_get("$.isApiErrorMessage", "boolean"), F.lit(False))
    text = F.coalesce(F.when(F.size(texts) > 0, F.array_join(texts, "\n")), plain)
    rows = rows.join(names, "file_path", "left")
    rows = rows.select(
        _get("$.uuid").alias("id"), F.col("stem").alias("session_id"), F.lit("claude").alias("source"), "file_path", "project", "line_no", _get("$.parentUuid").alias("parent_id"), F.try_to_timestamp(_get("$.timestamp")).alias("timestamp"),
        F.when(mine, "assistant").when(F.size(results) > 0, "toolResult").otherwise("user").alias("role"), text.alias("content_text"), F.when(mine, _joined(F.col("parts"), "thinking", "thinking")).alias("content_thinking"),
        F.when(mine, _calls(F.col("parts"), "tool_use", "input", True)).alias("tool_calls"), F.when(~mine & (F.size(results) > 0), results).alias("tool_results"),
        F.when(mine, _usage("$.message.usage.input_tokens", "$.message.usage.output_tokens", "$.message.usage.cache_read_input_tokens", "$.message.usage.cache_creation_input_tokens", None)).alias("usage"),
        F.when(mine, _text(_get("$.message.model"))).alias("model"), F.lit(None).cast("double").alias("cost_usd"), F.when(mine, _get("$.message.id")).alias("provider_message_id"),
        F.when(mine & failed, "error").when(mine, _text(F.coalesce(_get("$.message.stopReason"), _get("$.message.stop_reason")))).alias("stop_reason"), F.when(mine & failed, text).alias("error_message"),
    )
    return _finish(rows)


def _finish(rows: DataFrame) -> DataFrame:
    """One row for an id, the first in (file, line) order, with its place in the session and a content hash."""
    first = F.row_number().over(Window.partitionBy("id").orderBy("file_path", "line_no"))
    kept = rows.withColumn("_n", first).where("_n = 1").drop("_n")
    seq = F.row_number().over(Window.partitionBy("session_id").orderBy("file_path", "line_no"))
    return kept.withColumns({"seq": seq.cast("bigint"), "content_hash": F.substring(F.sha2(F.concat_ws("|", "role", "content_text", "content_thinking"), 256), 1, 16)})


def pi_sessions(lines: DataFrame) -> DataFrame:
    """Headers: id, cwd, parent, tools (null: unknown), start; the last name that isn't empty."""
    parsed = lines.withColumn("v", F.try_parse_json("line")).where("v is not null")
    named = parsed.where((_get("$.type") == "session_info") & (F.trim(F.coalesce(_get("$.name"), F.lit(""))) != "")).groupBy("file_path").agg(F.max_by(F.trim(_get("$.name")), "line_no").alias("name"))
    tools = F.filter(_get("$.tools", "array<struct<name:string,definitionChars:bigint>>"), lambda t: F.coalesce(t["name"], F.lit("")) != "")
    heads = parsed.where(_get("$.type") == "session").select(
        _get("$.id").alias("id"), "file_path", "project", F.lit("pi").alias("source"), _get("$.cwd").alias("cwd"), _get("$.parentSession").alias("parent_session"), F.try_to_timestamp(_get("$.timestamp")).alias("started_at"), "modified", tools.alias("tool_inventory"), "line_no"
    )
    first = F.row_number().over(Window.partitionBy("file_path").orderBy("line_no"))
    return heads.withColumn("_n", first).where("_n = 1").drop("_n", "line_no").join(named, "file_path", "left")


def claude_sessions(lines: DataFrame) -> DataFrame:
    """The file's name as id; the first time and folder of its rows."""
    parsed = lines.withColumn("v", F.try_parse_json("line")).where((_get("$.type")).isin("user", "assistant"))
    return parsed.groupBy("file_path", "project", F.col("stem").alias("id"), "modified").agg(F.lit("claude").alias("source"), F.min_by(_get("$.cwd"), F.when(_get("$.cwd").isNotNull(), F.col("line_no"))).alias("cwd"), F.min_by(F.try_to_timestamp(_get("$.timestamp")), F.when(_get("$.timestamp").isNotNull(), F.col("line_no"))).alias("started_at"))


def forks(sessions: DataFrame) -> DataFrame:
    """(id, parent_id, branches): a session's parent by the file or id it names, and how many sessions name the same parent."""
    parents = sessions.select(F.explode(F.array("file_path", "id")).alias("parent_session"), F.col("id").alias("parent_id")).distinct()
    linked = sessions.where("parent_session is not null").select("id", "parent_session").join(parents, "parent_session", "left")
    return linked.withColumn("branches", F.count("*").over(Window.partitionBy("parent_id")))


def subagent_runs(spark: SparkSession, path: str) -> DataFrame:
    """Runs from ``path/<project>/subagent-artifacts/<run>_<agent>_meta.json``; what the body lacks comes from the file's name."""
    raw = spark.read.text(f"{path}/*/subagent-artifacts/*_meta.json", wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.try_parse_json("value").alias("v"))
    name = F.element_at(F.split("file_path", "/"), -1)
    attempts = _get("$.modelAttempts", "array<struct<model:string,success:boolean,exitCode:int,error:string>>")
    return raw.where("v is not null").select(
        F.coalesce(_text(_get("$.runId")), F.nullif(F.regexp_extract(name, r"^([^_]+)_.+_meta\.json$", 1), F.lit(""))).alias("run_id"), F.element_at(F.split("file_path", "/"), -3).alias("project"),
        F.coalesce(_text(_get("$.agent")), F.nullif(F.regexp_extract(name, r"^[^_]+_(.+)_meta\.json$", 1), F.lit(""))).alias("agent"), _text(F.substring(F.trim(_get("$.task")), 1, EXCERPT)).alias("task_excerpt"),
        _get("$.exitCode", "int").alias("exit_code"), _get("$.error").alias("error"), F.coalesce(F.size(attempts), F.lit(0)).alias("n_attempts"), F.coalesce(F.size(F.filter(attempts, lambda a: ~a["success"])), F.lit(0)).alias("n_failed_attempts"),
        F.when(_get("$.usage", "variant").isNotNull(), F.struct(*[_get(f"$.usage.{k}", "bigint").alias(k) for k in ("input", "output", "cacheRead", "cacheWrite", "turns")], _get("$.usage.cost", "double").alias("costUsd"))).alias("usage"),
    ).where("run_id is not null")


def tool_stream(messages: DataFrame) -> DataFrame:
    """Tool calls in order with the first result of their id; calls without an id meet results without one by position. Outcome columns are null where a call has no result."""
    calls = messages.where("tool_calls is not null").select("session_id", "seq", F.col("id").alias("message_id"), "cost_usd", F.posexplode("tool_calls").alias("k", "c"))
    calls = calls.select("session_id", F.struct("seq", "k").alias("at"), "message_id", "cost_usd", F.col("c.id").alias("call_id"), F.col("c.name").alias("tool"), F.col("c.arguments").alias("arguments"))
    results = messages.where("tool_results is not null").select("session_id", "seq", F.col("id").alias("result_message_id"), F.posexplode("tool_results").alias("k", "r"))
    results = results.select("session_id", F.struct("seq", "k").alias("at"), "result_message_id", F.col("r.toolCallId").alias("call_id"), F.col("r.isError").alias("is_error"), F.col("r.textLength").alias("text_length"), F.col("r.subagent").alias("subagent"))
    # an id counts once; id-less rows are numbered, and the number is their key
    nth = F.row_number().over(Window.partitionBy("session_id", "call_id").orderBy("at"))
    key = lambda df: df.withColumn("_n", nth).withColumn("_key", F.when(F.col("call_id") == "", F.concat(F.lit("#"), "_n")).when(F.col("_n") == 1, F.col("call_id")))
    left, right = key(calls), key(results).where("_key is not null").drop("at", "call_id", "_n")
    ordinal = F.row_number().over(Window.partitionBy("session_id").orderBy("at")) - 1
    return left.join(right, ["session_id", "_key"], "left").withColumn("ord", ordinal).drop("_key", "_n", "at")


def preview(name: Column, arguments: Column) -> Column:
    """A call's arguments in a line: a shell's command, else k=v pairs; 300 characters at most."""
    pairs = F.array_join(F.transform(F.map_entries(F.from_json(arguments, "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), F.substring(e["value"], 1, 80))), " ")
    out = F.regexp_replace(F.when(name == "bash", F.coalesce(F.get_json_object(arguments, "$.command"), pairs)).otherwise(pairs), r"\s+", " ")
    return F.when(F.length(out) > 300, F.concat(F.substring(out, 1, 299), F.lit("…"))).otherwise(out)


#: Messages from lines, by dialect.
DIALECTS: dict[str, Callable[[DataFrame], DataFrame]] = {"pi": pi_messages, "claude": claude_messages}
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pi": lambda s, p: pi_messages(files(s, p)), "claude": lambda s, p: claude_messages(files(s, p))}


def register(name: str, reader: Callable[[SparkSession, str], DataFrame]) -> None:
    """Add a source: a function from (session, path) to messages."""
    READERS[name] = reader


def read(spark: SparkSession, source: str, path: str) -> DataFrame:
    return READERS[source](spark, path)
