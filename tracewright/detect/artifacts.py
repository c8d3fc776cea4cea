"""Assignments in build and configuration artefacts quoted in texts, and whether their values look like credentials."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.detect.filters import PLACEHOLDERS, entropy
from tracewright.detect.scan import candidates, fingerprint, preview

NAME = r"[A-Za-z_][A-Za-z0-9_.-]*"
#: Kinds of artefact: the pattern of an assignment in a line of it.
KINDS = (
    ("containerfile", re.compile(rf"^\s*(?:ENV|ARG)\s+({NAME})[= ]\s*(\S.*?)\s*$")),
    ("shell-export", re.compile(rf"^\s*(?:\$\s*)?(?:export|set|setx)\s+({NAME})=(\S.*?)\s*$")),
    ("compose-env", re.compile(rf"^\s+-\s+({NAME})=(\S.*?)\s*$")),
    ("dotenv", re.compile(r"^([A-Z_][A-Z0-9_]*)=(\S.*?)\s*$")),
    ("ci-log", re.compile(rf"^(?:##\[\w+\]|::\w+|\+ |\[\d[\d:. TZ-]*\])\s*.*?\b({NAME})[=:]\s*(\S+)")),
    ("build-log", re.compile(rf"^(?:\[\w+\]|Step \d+|#\d+|>)\s.*?\b({NAME})=(\S+)")),
)
SECRET_NAME = re.compile(r"(?i)(?:secret|token|passw|pwd|api_?key|access_?key|private_?key|credential|auth)")
MASK = re.compile(r"^[*•xX.\-_]{3,}$|^\[?(?:redacted|masked|hidden)\]?$", re.IGNORECASE)
INTERPOLATED = re.compile(r"\$\{?\w+|\{\{.*\}\}|%\w+%|<[^>]+>")


def shaped(value: str) -> bool:
    """At least eight characters without spaces, of mixed kinds and some entropy."""
    kinds = sum(bool(re.search(p, value)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return len(value) >= 8 and " " not in value and kinds >= 2 and entropy(value) >= 2.5


def extract(text: str) -> Iterator[tuple[str, int, str, str]]:
    """(kind, line, name, value) of each assignment; a line is of the first kind that it fits."""
    for k, line in enumerate(text.split("\n")):
        if "=" in line or ":" in line or line.lstrip().startswith(("ENV", "ARG")):
            for kind, pattern in KINDS:
                if m := pattern.match(line):
                    yield kind, k, m[1], m[2].strip("\"'")
                    break


def judged(name: str, value: str) -> tuple[str, str] | None:
    """(how, rule): by the rule catalogue, else by its name and shape; None for masks, placeholders, interpolations and plain values."""
    if MASK.match(value) or INTERPOLATED.search(value) or any(re.match(p, value) for p in PLACEHOLDERS):
        return None
    for rule, _, _ in candidates(value):
        if rule.family != "detect-secrets":
            return "catalogue", rule.id
    return ("structure", "named-secret") if SECRET_NAME.search(name) and shaped(value) else None


def scan_artifacts(fields: DataFrame) -> DataFrame:
    """Credentials in the artefacts of ``fields`` (session_id, message_id, field, text)."""
    schema = "session_id string, message_id string, field string, kind string, line int, name string, how string, rule_id string, fingerprint string, redacted_preview string"
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, m, f, kind, k, name, *verdict, fingerprint(value), preview(value)) for s, m, f, text in zip(*[c.to_pylist() for c in batch.columns]) for kind, k, name, value in extract(text or "") if (verdict := judged(name, value))]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if n == "line" else pa.string()) for c, n in zip(columns, names)], names=names)

    return fields.select(F.col("session_id").cast("string"), F.col("message_id").cast("string"), "field", "text").mapInArrow(run, schema)
