"""Personal data: recognizers with checks, and greedy choice among overlapping hits.

Hits of a text are chosen from left to right, longer first, which is
sequential; it runs per text inside an Arrow pass and never needs a shuffle.
"""

from __future__ import annotations

import ipaddress
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewright.detect.scan import fingerprint, preview

MIN_SCORE = 0.3


def luhn(value: str) -> bool:
    ds = [int(c) for c in value if c.isdigit()]
    return 13 <= len(ds) <= 19 and sum(d if k % 2 == 0 else sum(divmod(2 * d, 10)) for k, d in enumerate(reversed(ds))) % 10 == 0


def iban(value: str) -> bool:
    s = re.sub("[ -]", "", value).upper()
    return 15 <= len(s) <= 34 and re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]+", s) is not None and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def ssn(value: str) -> bool:
    area, group, serial = re.split("[ -]", value.strip())
    return 1 <= int(area) <= 899 and area != "666" and int(group) >= 1 and int(serial) >= 1


def low_address(value: str) -> bool:
    """Private, reserved or documentation addresses."""
    try:
        a = ipaddress.ip_address(value)
    except ValueError:
        return False
    if a.version == 4:
        return any(a in ipaddress.ip_network(n) for n in ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "0.0.0.0/8", "224.0.0.0/3"))
    return any(a in ipaddress.ip_network(n) for n in ("::1/128", "fc00::/7", "fe80::/10", "2001:db8::/32"))


def coordinates(value: str) -> bool:
    lat, lon = (float(x) for x in value.split(","))
    return abs(lat) <= 90 and abs(lon) <= 180


@dataclass(frozen=True)
class Recognizer:
    id: str
    entity: str
    severity: str
    score: float  # of a value that passes its check, or has none
    patterns: tuple[str, ...]
    check: Callable[[str], bool] | None = None
    invalid: float | None = None  # score after a failed check; None: dropped
    low: Callable[[str], bool] | None = None


_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H = "[0-9A-Fa-f]{1,4}"
# Entity types, severities, scores and shapes.
RECOGNIZERS = (
    Recognizer("email-address", "EMAIL_ADDRESS", "medium", 0.5, (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b",)),
    Recognizer("phone-number", "PHONE_NUMBER", "medium", 0.4, (r"(?<![\d+])\+\d{1,3}(?:[ .()-]*\d){8,14}(?!\d)", r"(?<!\d)(?:\+1[ .-]?)?(?:\(\d{3}\)[ .-]?|\d{3}[ .-])\d{3}[ .-]?\d{4}(?!\d)")),
    Recognizer(
        "ip-address", "IP_ADDRESS", "medium", 0.5,
        (rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d.])", rf"(?<![:\w])(?:{_H}:){{7}}{_H}(?![\w:])", rf"(?<![:\w])(?:{_H}:){{1,7}}:(?:{_H}(?::{_H}){{0,6}})?|(?<![:\w])::(?:{_H}(?::{_H}){{0,6}})(?![\w:])"),
        low=low_address,
    ),
    Recognizer("credit-card", "CREDIT_CARD", "critical", 1.0, (r"(?<!\d)(?:\d[ -]?){12,18}\d(?!\d)",), check=luhn),
    Recognizer("iban-code", "IBAN_CODE", "high", 1.0, (r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7} ?[A-Z0-9]{1,4}(?![A-Z0-9])",), check=iban),
    Recognizer("us-ssn", "US_SSN", "high", 0.9, (r"(?<!\d)\d{3}[ -]\d{2}[ -]\d{4}(?!\d)",), check=ssn, invalid=0.2),
    Recognizer("postal-code", "POSTAL_CODE", "low", 0.3, (r"(?<!\d)\d{5}(?:-\d{4})?(?!\d)",)),
    Recognizer("coordinates", "COORDINATES", "medium", 0.5, (r"(?<![\w.\-])-?\d{1,3}\.\d{1,6}\s*,\s*-?\d{1,3}\.\d{1,6}(?![\w.\-])",), check=coordinates),
)
LOW_SCORE = 0.1
_PATTERNS = [(r, [re.compile(p, re.ASCII) for p in r.patterns]) for r in RECOGNIZERS]


def judge(r: Recognizer, value: str, validate: bool = True) -> tuple[float, str] | None:
    """(score, severity), or None if a check that must hold fails."""
    if r.check is not None and validate and not r.check(value):
        return None if r.invalid is None else (r.invalid, r.severity)
    return (LOW_SCORE, "low") if r.low is not None and r.low(value) else (r.score, r.severity)


def candidates(text: str) -> list[tuple[int, str, Recognizer, float, str]]:
    """Judged hits by index, longer first, then recognizer id."""
    if not re.search(r"[0-9@]|::", text):
        return []
    found = []
    for r, patterns in _PATTERNS:
        for p in patterns:
            for m in p.finditer(text):
                verdict = judge(r, m[0])
                if verdict is not None:
                    found.append((m.start(), m[0], r, *verdict))
    return sorted(found, key=lambda x: (x[0], -len(x[1]), x[2].id))


def chosen(text: str, min_score: float = MIN_SCORE, deny: frozenset[str] = frozenset(), allow: frozenset[str] = frozenset()) -> Iterator[tuple[int, str, Recognizer, float, str, bool]]:
    """Judged candidates with whether an earlier one covers their start.

    A candidate takes its place whatever becomes of it then; of those that have one, a denied value passes the floor and the allow list, others go by them.
    """
    end = -1
    for at, value, r, score, severity in candidates(text):
        if at < end:
            yield at, value, r, score, severity, True
            continue
        end = at + len(value)
        mark = fingerprint(value)
        if mark in deny or (score >= min_score and mark not in allow):
            yield at, value, r, score, severity, False


def find_pii(fields: DataFrame, min_score: float = MIN_SCORE, cap: int = 50) -> DataFrame:
    """Findings of ``fields`` (session_id, message_id, field, text), the overlapped and capped ones marked, not dropped."""
    schema = "session_id string, message_id string, field string, entity_type string, recognizer string, score double, severity string, match_index int, match_length int, fingerprint string, redacted_preview string, overlapped boolean"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"score": pa.float64(), "match_index": pa.int32(), "match_length": pa.int32(), "overlapped": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (session, message, field, r.entity, r.id, score, severity, at, len(value), fingerprint(value), preview(value), over)
                for session, message, field, text in zip(*[c.to_pylist() for c in batch.columns])
                for at, value, r, score, severity, over in chosen(text or "", min_score)
            ]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for c, n in zip(columns, names)], names=names)

    picked = fields.select(F.col("session_id").cast("string"), F.col("message_id").cast("string"), "field", "text").where("text is not null and text <> ''")
    nth = F.row_number().over(Window.partitionBy("message_id", "field", "overlapped").orderBy("match_index", F.desc("match_length")))
    return picked.mapInArrow(run, schema).withColumn("capped", ~F.col("overlapped") & (nth > cap))


def pii_report(findings: DataFrame) -> DataFrame:
    kept = ~F.col("overlapped") & ~F.col("capped")
    return findings.groupBy("session_id", "entity_type").agg(F.count_if(kept).alias("n"), F.count_if("overlapped").alias("overlapped"), F.count_if("capped").alias("capped"), F.countDistinct("message_id").alias("messages"))
