"""Tables inside texts, and what personal data their columns hold."""

from __future__ import annotations

import csv
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.detect.pii import RECOGNIZERS, _PATTERNS, judge

SAMPLE, RATIO = 10, 0.5
VALUE_WEIGHT, LABEL_WEIGHT = 0.6, 0.4

# Header labels by group, with the entity types that support them.
LABELS = (
    ("name", r"\bfirst name\b|\blast name\b|\bfull name\b|\bcustomer name\b|\bsurname\b|\bgiven name\b|^name$", ()),
    ("email", r"\be ?mails?\b|\be ?mail ?addr|\bmail\b", ("EMAIL_ADDRESS",)),
    ("phone", r"\bphones?\b|\btels?\b|\btelephones?\b|\bmobiles?\b|\bcells?\b|\bcontact ?numbers?\b", ("PHONE_NUMBER",)),
    ("ssn", r"\bssn\b|\bsocial ?security\b|\bnational ?id(?:entifier)?\b|\btax ?id(?:entifier)?\b|\bnino\b", ("US_SSN",)),
    ("address", r"\baddresses?\b|\bstreets?\b|\bzip ?codes?\b|\bpost(?:al)? ?codes?\b|\bcity\b|\bstate\b|\bcountr(?:y|ies)\b", ("POSTAL_CODE",)),
    ("dob", r"\bdob\b|\bdate ?of ?birth\b|\bbirth ?(?:date|day)\b|\bborn\b", ()),
    ("salary", r"\bsalar(?:y|ies)\b|\bwages?\b|\bincomes?\b|\bcompensation\b", ()),
    ("account", r"\baccounts?\b|\baccount ?id|\baccount ?num|\bibans?\b|\bcards?\b|\brouting ?numbers?\b|\bcredit ?cards?\b|\bbank", ("CREDIT_CARD", "IBAN_CODE")),
)


@dataclass
class Fragment:
    kind: str
    line: int
    header: list[str]
    rows: list[list[str]]


def labels(cell: str) -> list[tuple[str, tuple[str, ...]]]:
    t = re.sub("[_-]+", " ", cell.strip().lower())
    return [(group, entities) for group, pattern, entities in LABELS if re.search(pattern, t)]


def _json_tables(text: str) -> Iterator[Fragment]:
    """Arrays of flat objects, anywhere in the text."""
    decoder, at = json.JSONDecoder(), text.find("[")
    while at >= 0:
        try:
            value, end = decoder.raw_decode(text, at)
        except ValueError:
            at = text.find("[", at + 1)
            continue
        if isinstance(value, list) and len(value) > 1 and all(isinstance(x, dict) for x in value):
            header = list(dict.fromkeys(k for x in value for k in x))
            yield Fragment("json", text.count("\n", 0, at), header, [["" if x.get(k) is None else str(x[k]) for k in header] for x in value])
        at = text.find("[", max(end, at + 1))


_CUTS = (("ruled", re.compile(r"\s*[|│]\s*")), ("tab", re.compile(r"\t")), ("csv", None), ("aligned", re.compile(r"\s{2,}")))
_RULE = re.compile(r"[\s|+:\-─┼═╪]+\Z")


def _cells(kind: str, cut: re.Pattern | None, line: str) -> list[str]:
    if kind == "csv":
        return [c.strip() for c in next(csv.reader([line]))] if "," in line else []
    body = line.strip().strip("|│") if kind == "ruled" else line.strip()
    return [c.strip() for c in cut.split(body.strip() if kind == "ruled" else body)]


def fragments(text: str) -> Iterator[Fragment]:
    """Tables of at least two columns and two rows under a header, by the first way of cutting that gives every line as many cells."""
    yield from _json_tables(text)
    lines = text.split("\n")
    used: set[int] = set()
    for kind, cut in _CUTS:
        k = 0
        while k < len(lines):
            header = _cells(kind, cut, lines[k]) if k not in used and lines[k].strip() and not _RULE.match(lines[k]) else []
            if len(header) < 2 or not all(header) or any(re.fullmatch(r"-?\d+(?:\.\d+)?", h) for h in header):
                k += 1
                continue
            rows, n = [], k + 1
            while n < len(lines) and n not in used and lines[n].strip():
                if not _RULE.match(lines[n]):
                    cells = _cells(kind, cut, lines[n])
                    if len(cells) != len(header):
                        break
                    rows.append(cells)
                n += 1
            if len(rows) >= 2:
                used.update(range(k, n))
                yield Fragment(kind, k, header, rows)
                k = n
            else:
                k += 1


def entity(value: str) -> str | None:
    """The entity type of the best judged recognizer that matches in a value."""
    best = (0.0, None)
    for r, patterns in _PATTERNS:
        for p in patterns:
            for m in p.finditer(value):
                verdict = judge(r, m[0])
                if verdict is not None and verdict[0] > best[0]:
                    best = (verdict[0], r.entity)
    return best[1]


def profile(fragment: Fragment, sample: int = SAMPLE) -> Iterator[tuple[str, str, str, float, float, str]]:
    """(column, label, entity type, ratio, score, verdict) of each column; empty cells count as values.

    Under a label only the entities it implies count. Confirmed: label and ratio; else label-only, values-only or below-threshold.
    """
    for k, head in enumerate(fragment.header):
        cells = [row[k].strip() for row in fragment.rows[:sample]]
        named = labels(head)
        implied = {e for _, es in named for e in es}
        counts = Counter(e for e in map(entity, cells) if e and (not implied or e in implied))
        top, n = counts.most_common(1)[0] if counts else ("", 0)
        ratio = n / len(cells)
        score = round(VALUE_WEIGHT * ratio + LABEL_WEIGHT * bool(named), 6)
        verdict = "confirmed" if named and ratio >= RATIO else "label-only" if named else "values-only" if ratio >= RATIO else "below-threshold"
        yield head, named[0][0] if named else "", top, round(ratio, 6), score, verdict


def column_profiles(fields: DataFrame) -> DataFrame:
    """Column profiles of all tables in ``fields`` (session_id, message_id, field, text)."""
    schema = "session_id string, message_id string, field string, kind string, line int, column string, label string, entity_type string, ratio double, score double, verdict string"
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"line": pa.int32(), "ratio": pa.float64(), "score": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(s, m, f, t.kind, t.line, *p) for s, m, f, text in zip(*[c.to_pylist() for c in batch.columns]) for t in fragments(text or "") for p in profile(t)]
            columns = list(zip(*rows)) or [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), kinds.get(n, pa.string())) for c, n in zip(columns, names)], names=names)

    return fields.select(F.col("session_id").cast("string"), F.col("message_id").cast("string"), "field", "text").mapInArrow(run, schema)


def best_classes(profiles: DataFrame) -> DataFrame:
    """Columns that hold personal data, each with its best score over the tables of a message that have it, and what gave it."""
    told = profiles.where((F.col("verdict") != "below-threshold") & (F.coalesce("entity_type", F.lit("")) != "") | (F.col("verdict") == "label-only"))
    best = F.max_by(F.struct("kind", "line", "label", "entity_type", "ratio", "score", "verdict"), F.struct("score", "ratio", -F.col("line"))).alias("b")
    return told.groupBy("session_id", "message_id", "field", "column").agg(best).select("session_id", "message_id", "field", "column", "b.*")


def profile_report(profiles: DataFrame) -> DataFrame:
    return profiles.groupBy("verdict", "label", "entity_type").agg(F.count("*").alias("columns"), F.round(F.avg("score"), 6).alias("mean_score"))


__all__ = ["RECOGNIZERS", "Fragment", "best_classes", "column_profiles", "fragments", "labels", "profile", "profile_report"]
