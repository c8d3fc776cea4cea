"""Classes of failure: an ordered table of patterns, the first that matches names the class.

The whole classification is one CASE over the bounded ends of the text, in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.functions.patterns import jvm

ENDS = 2000
UNCLASSIFIED = "unclassified"
INACTIONABLE = ("aborted", "pending-background-task", UNCLASSIFIED)

# Fixed values: (class, cause, pattern, flags) in the order in which they are tried.
TURN = (
    ("aborted", "operation aborted", r"\b(?:this )?operation was aborted|^operation aborted|^request aborted|^aborted after \d+ retry", "i"),
    ("malformed-tool-call", "unparseable tool-call JSON", r"unexpected token|unterminated string|bad control character|invalid json|json parse", "i"),
    ("malformed-tool-call", "tool-call arguments rejected", r"invalid tool (?:call|input|arguments)|tool_use.*invalid|malformed tool", "i"),
    ("context-overflow", "prompt token limit exceeded", r"prompt tokens limit exceeded|context length exceeded|maximum context length|too many tokens", "i"),
    ("context-overflow", "output truncated at the length ceiling", r"^length$|max_tokens", "i"),
    ("rate-limit", "account usage limit reached", r"reached your (?:session|weekly|daily|monthly) usage limit|usage limit reached", "i"),
    ("rate-limit", "provider rate limit (429)", r"^429\b|\brate[ _-]?limit|too many requests", "i"),
    ("quota", "insufficient credits", r"insufficient credits|payment required|^402\b", "i"),
    ("auth", "api key rejected", r"api key auth failed|invalid api key|unauthorized|^401\b", "i"),
    ("auth", "key lacks permission", r"permission_error|forbidden|^403\b", "i"),
    ("model-unavailable", "no endpoint for the requested model", r"no endpoints found|model not found|^404\b", "i"),
    ("provider-server", "provider returned 5xx", r"^5\d\d\b|internal server error|bad gateway|service unavailable|gateway timeout", "i"),
    ("provider-transport", "stream closed or stalled", r"error reading stream|stream closed|stream idle timeout|upstream idle timeout|terminated", "i"),
    ("provider-transport", "connection failed", r"connection error|econnreset|socket hang up|network error|^error code: 5\d\d", "i"),
    ("provider-transport", "request timed out", r"request timed out|etimedout|\btimeout\b", "i"),
)
TOOL = (
    ("pending-background-task", "background task has not finished", r"^\(no output yet\)$|^\(still running\)$", "i"),
    ("edit-anchor-miss", "anchor text not found in the file", r"could not find (?:the exact text|edits\[)|no changes made to|text not found in file", "i"),
    ("edit-anchor-miss", "anchor text was ambiguous", r"found \d+ occurrences of the text|not unique|matches multiple", "i"),
    ("script-error", "unhandled exception in a script", r"traceback \(most recent call last\)|^\s*at .+\(.+:\d+:\d+\)$", "im"),
    ("script-error", "shell syntax error", r"syntax error near unexpected token|unexpected eof while looking for|: line \d+: unexpected eof|bad substitution", "i"),
    ("script-error", "language-level error", r"\b(?:syntaxerror|referenceerror|nameerror|modulenotfounderror|importerror)\b", "i"),
    ("policy-blocked", "action refused by policy", r"^blocked:|denied by policy|blocked by (?:hook|policy|guardrail)|is not allowed here", "i"),
    ("policy-blocked", "the operator declined", r"user (?:declined|denied|rejected)|declined to provide", "i"),
    ("tool-input-invalid", "arguments failed validation", r"inputvalidationerror|invalid input|validation (?:failed|error)|is required|expected .* but (?:got|received)|unrecognized (?:key|argument)", "i"),
    ("tool-not-found", "command not found", r"command not found|: not found$|unknown command", "i"),
    ("tool-not-found", "no such tool", r"unknown tool|no such tool|tool .* not (?:found|registered)", "i"),
    ("path-not-found", "no such file or directory", r"no such file or directory|enoent|does not exist|cannot find path", "i"),
    ("permission-denied", "permission denied", r"permission denied|eacces|operation not permitted|not permitted", "i"),
    ("remote-rate-limit", "third-party API rate limit", r"api rate limit (?:already )?exceeded|rate limit exceeded|\b429\b|secondary rate limit", "i"),
    ("service-unavailable", "not connected", r"not connected|connection refused|econnrefused|protocol error|service unavailable|failed to connect", "i"),
    ("tool-timeout", "tool timed out", r"timed out|etimedout|deadline exceeded", "i"),
    ("command-failed", "git reported an error", r"^fatal: \S|^git: \S", "m"),
    ("command-failed", "a text tool reported an error", r"^(?:sed|awk|grep|egrep|rg|jq|tr|cut|sort|uniq): \S", "m"),
    ("command-failed", "a file tool reported an error", r"^(?:cat|ls|cp|mv|rm|mkdir|rmdir|ln|chmod|touch|head|tail|wc|find|xargs|du|df): \S", "m"),
    ("command-failed", "a build or package tool reported an error", r"^(?:npm|npx|node|yarn|pnpm|make|cargo|go|python3?|pip3?|tsc|docker|gh|curl): \S", "m"),
    ("command-failed", "the shell reported an error", r"^(?:bash|sh|zsh)(?:: line \d+)?: \S", "m"),
    ("command-failed", "usage error", r"^usage: \S", "im"),
    ("command-failed", "exit status reported explicitly", r"exit(?:ed with)? (?:code|status) [1-9]|non-?zero exit", "i"),
    ("command-failed", "a command reported an error", r"^[a-z][\w.+-]{0,30}: \S", ""),
    ("command-failed", "a command reported an error", r"(?:^|\n)[a-z][\w.+-]{0,30}: \S[^\n]*\s*$", ""),
)
COMMAND = (
    ("exit-status-signal", "a search that found nothing", r"(?:^|[|;&(]\s*|\n)\s*(?:grep|egrep|fgrep|rg|ag|ack)\b", ""),
    ("exit-status-signal", "git diff signalling a difference", r"git\s+diff\b[^\n;|]*--(?:exit-code|quiet)\b", ""),
    ("exit-status-signal", "a comparison reporting a difference", r"(?:^|[|;&(]\s*|\n)\s*(?:diff|cmp)\b", ""),
    ("exit-status-signal", "a conditional reporting false", r"(?:^|[|;&(]\s*|\n)\s*(?:test|\[)\s", ""),
)
CHILD = (("spawn-failure", "the child binary could not be launched", r"\bspawn\b[^\n]*\b(?:enoent|eacces|eperm)\b|\b(?:enoent|eacces)\b[^\n]*\bspawn\b", "i"),)


def ends(text: Column) -> Column:
    """The first and last ``ENDS`` characters of a long text, the whole of a short one."""
    t = F.trim(text)
    return F.when(F.length(t) <= 2 * ENDS, t).otherwise(F.concat(F.substring(t, 1, ENDS), F.lit("\n"), F.substring(t, -ENDS, ENDS)))


def _chain(text: Column, table: tuple) -> Column | None:
    out = None
    for name, cause, pattern, flags in table:
        hit = text.rlike(jvm(pattern, flags))
        value = F.struct(F.lit(name).alias("class_id"), F.lit(cause).alias("cause"))
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return out


def _unclassified() -> Column:
    return F.struct(F.lit(UNCLASSIFIED).alias("class_id"), F.lit("unrecognised error").alias("cause"))


def turn_failure(text: Column) -> Column:
    return F.coalesce(_chain(ends(text), TURN), _unclassified())


def tool_failure(text: Column, command: Column) -> Column:
    """By the result's text first, then by the command that was run."""
    return F.coalesce(_chain(ends(text), TOOL), _chain(command, COMMAND), _unclassified())


def child_failure(error: Column, exit_code: Column, attempts: Column, failed: Column) -> Column:
    """Null for a child run in which nothing failed."""
    named = lambda a, b: F.struct(F.lit(a).alias("class_id"), F.lit(b).alias("cause"))
    return F.coalesce(
        _chain(F.coalesce(error, F.lit("")), CHILD),
        F.when((attempts > 0) & (attempts == failed), named("model-attempt-exhaustion", "every attempted model failed")),
        F.when(exit_code != 0, named("child-nonzero-exit", "non-zero exit code")),
    )


def turn_failed(error: Column, stop_reason: Column) -> Column:
    return (F.coalesce(error, F.lit("")) != "") | F.coalesce(stop_reason.isin("error", "aborted"), F.lit(False))


def groups(failures: DataFrame, threshold: int = 3) -> DataFrame:
    """Per (session, axis, class, tool): count, causes by count, distinct fingerprints, cost, and the confidence of a proposal (null: none).

    ``failures`` are (session_id, axis, tool, failure struct, text, cost_usd).
    """
    by = ("session_id", "axis", "class_id", "tool")
    rows = failures.select("session_id", "axis", F.col("failure.class_id").alias("class_id"), F.coalesce("tool", F.lit("")).alias("tool"), F.col("failure.cause").alias("cause"), normalised(F.col("text")).alias("print"), "cost_usd")
    # rows of a kind are counted before anything meets, so a group's texts are never gathered
    kinds = rows.groupBy(*by, "cause", "print").agg(F.count("*").alias("n"), F.sum("cost_usd").alias("cost"), F.count("cost_usd").alias("priced"))
    prints = kinds.select(*by, "print").distinct().groupBy(*by).agg(F.count("print").cast("int").alias("distinct_errors"))
    causes = kinds.groupBy(*by, "cause").agg(F.sum("n").alias("n"), F.sum("cost").alias("cost"), F.sum("priced").alias("priced"))
    out = causes.groupBy(*by).agg(
        F.sum("n").alias("n_failures"), F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "cause"))), lambda x: F.concat_ws(":", x["cause"], (-x["m"]).cast("string"))).alias("causes"),
        F.round(F.sum("cost"), 6).alias("cost_usd"), F.sum("priced").alias("priced"),
    )
    same = [out[c].eqNullSafe(prints[c]) for c in by]
    out = out.join(prints, same[0] & same[1] & same[2] & same[3]).select(*[out[c] for c in by], "n_failures", "causes", "distinct_errors", "cost_usd", "priced")
    worth = (F.col("n_failures") >= threshold) & ~F.col("class_id").isin(*INACTIONABLE)
    return out.withColumn("confidence", F.when(worth, F.round(F.least(F.lit(0.9), 0.6 + 0.05 * (F.col("n_failures") - threshold)), 6)))


def normalised(text: Column) -> Column:
    """An error's text without what differs between two occurrences of one failure."""
    out = F.substring(text, 1, 400)
    for pattern, into in ((r"https?://\S+", "<url>"), (r"/[\w.\-/]{4,}", "<path>"), (r"\([^)]*\)", "(…)"), (jvm(r"\b[0-9a-f]{8,}\b"), "<id>"), (r"\d+", "N"), (r"\s+", " ")):
        out = F.regexp_replace(out, pattern, into)
    return F.lower(F.trim(out))
