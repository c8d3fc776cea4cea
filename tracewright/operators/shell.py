"""What a tool call does: its command's words, subcommand, target, and whether it only reads.

Everything is expressions over the arguments' JSON, in the JVM: a quoted stretch is an
alternative of the pattern of a word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Beginnings of commands that read, words that read when something follows, subcommands and tools that read.
READ_BEGINNINGS = (
    "cat", "ls", "find", "grep", "head", "tail", "wc", "git status", "git log", "git diff", "git branch --list", "git remote", "gh pr view", "gh run list",
    "gh pr list", "gh pr checks", "which", "echo", "pwd", "test", "true", "node --version", "npm list",
)
READ_WORDS = ("type", "file", "stat")
READ_GIT = ("status", "log", "diff", "branch", "remote", "show", "rev-parse", "ls-files", "ls-remote", "describe", r"tag\s+--list")
READ_GH = ("view", "list", "checks", "api")
READ_TOOLS = ("read", "glob", "grep")

WORD = r"""(?:[^ '"]|'[^']*(?:'|$)|"[^"]*(?:"|$))+"""
QUOTED = r"""'([^']*)(?:'|$)|"([^"]*)(?:"|$)"""
READS = "|".join((rf"(?:{'|'.join(READ_WORDS)})\s", rf"git\s+(?:{'|'.join(READ_GIT)})", rf"gh\s+(?:pr\s+)?(?:{'|'.join(READ_GH)})"))


def words(command: Column) -> Column:
    """A command's words: cut at spaces outside quotes, without the quotes, none empty. A quote that isn't closed reaches to the end."""
    raw = F.regexp_extract_all(F.regexp_replace(F.coalesce(command, F.lit("")), r"^\s+|\s+$", ""), F.lit(WORD), F.lit(0))
    return F.filter(F.transform(raw, lambda w: F.regexp_replace(w, QUOTED, "$1$2")), lambda w: w != "")


def reads(command: Column) -> Column:
    """Whether a command is known to change nothing."""
    text = F.regexp_replace(F.coalesce(command, F.lit("")), r"^\s+", "")
    out = text.rlike(rf"^(?:{READS})")
    for start in READ_BEGINNINGS:
        out = out | text.startswith(start)
    return out


def _at(ws: Column, k: int) -> Column:
    return F.coalesce(F.get(ws, F.lit(k)), F.lit(""))


def call_of(tool: Column, arguments: Column) -> Column:
    """struct(args, read_only, subcommand, target) of a call; ``arguments`` is a JSON object. Flags are sorted, so their order makes no difference."""
    command = F.get_json_object(arguments, "$.command")
    of = lambda args, read, sub, target: F.struct(args.alias("args"), read.alias("read_only"), sub.alias("subcommand"), target.alias("target"))
    none = F.lit("")

    def shell(ws: Column) -> Column:
        base = _at(ws, 0)
        tail = F.slice(ws, 2, F.greatest(F.size(ws) - 1, F.lit(0)))
        flags = F.array_join(F.array_sort(F.filter(tail, lambda w: w.startswith("-"))), " ")
        rest = F.filter(tail, lambda w: ~w.startswith("-"))
        joined = lambda *parts: F.array_join(F.filter(F.array(*parts), lambda x: x != ""), " ")
        first = _at(rest, 0)
        git = (
            F.when(first == "push", F.coalesce(F.get(rest, F.lit(2)), _at(rest, 1)))
            .when(first.isin("checkout", "switch", "add", "rm", "commit"), _at(rest, 1))
            .otherwise(F.array_join(F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))), " "))
        )
        hub = joined(first, _at(rest, 1))
        many = F.size(rest) > 0
        return (
            F.when((base == "git") & many, of(joined(F.concat(F.lit("git "), first), git, flags), reads(command), F.concat(F.lit("git "), first), git))
            .when((base == "gh") & many, of(joined(F.lit("gh"), hub, _at(rest, 2), flags), reads(command) | _at(rest, 1).isin(*READ_GH), F.concat(F.lit("gh "), hub), _at(rest, 2)))
            .otherwise(of(joined(base, flags, F.array_join(rest, " ")), reads(command), base, first))
        )

    path = F.coalesce(F.get_json_object(arguments, "$.file_path"), none)
    looked = F.coalesce(F.nullif(path, none), F.get_json_object(arguments, "$.pattern"), none)
    named = lambda what: F.when(what == "", tool).otherwise(F.concat_ws(" ", tool, what))
    pairs = F.array_sort(F.transform(F.map_entries(F.from_json(arguments, "map<string,string>")), lambda e: F.concat_ws("=", e["key"], e["value"])))
    return (
        F.when((tool == "bash") & command.isNotNull(), F.transform(F.array(words(command)), shell)[0])
        .when(tool == "bash", of(none, arguments.isNull(), none, none))
        .when(tool.isin(*READ_TOOLS), of(named(looked), F.lit(True), none, looked))
        .when(tool.isin("edit", "write"), of(named(path), F.lit(False), none, path))
        .otherwise(of(F.coalesce(F.array_join(pairs, "&"), none), F.lit(False), none, none))
    )


def calls(stream: DataFrame) -> DataFrame:
    """The calls that :mod:`tracewright.operators.trajectory` reads, of :func:`tracewright.sources.transcripts.tool_stream`.

    A call stands for its message (``call_id`` is the message's id); one without a result counts as a success.
    """
    parsed = stream.withColumn("c", call_of(F.col("tool"), F.col("arguments")))
    return parsed.select("session_id", "ord", F.col("message_id").alias("call_id"), "tool", "c.subcommand", "c.target", "c.args", "c.read_only", F.coalesce("is_error", F.lit(False)).alias("is_error"), "cost_usd")


def parent(path: Column) -> Column:
    """The folder a path lies in, "." for a bare name."""
    return F.when(path.contains("/"), F.regexp_extract(path, r"^(.*)/[^/]*$", 1)).otherwise(F.lit("."))


def needs_directory() -> Column:
    """The folder that a call of :func:`calls` needs: that of the last argument of mv and cp, or of an edited or written file; else null."""
    moved = F.element_at(F.filter(F.split("args", " "), lambda w: (w != "") & ~w.startswith("-")), -1)
    return F.when((F.col("tool") == "bash") & F.col("subcommand").isin("mv", "cp"), parent(moved)).when(F.col("tool").isin("edit", "write") & (F.col("target") != ""), parent(F.col("target")))


def makes_directory() -> Column:
    """The folder that a mkdir makes, else null."""
    return F.when((F.col("tool") == "bash") & (F.col("subcommand") == "mkdir") & (F.col("target") != ""), F.col("target"))
