"""One pass of all secret rules over message fields, then gates as plain columns.

The pass runs in Arrow batches. Most rules have literals of which every match
contains one, read off their parsed patterns; a text without them is never
given to the rule, so some two hundred rules cost a few substring searches each.
Raw secrets do not leave the pass: findings carry a fingerprint and a preview.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.detect import rules
from tracewright.detect.filters import excluded

try:
    import ahocorasick
except ImportError:  # literals are then looked for one by one
    ahocorasick = None

SEVERITIES = ("medium", "high", "critical")
CONFIDENCES = ("passive", "active")
PREVIEW_HEAD, PREVIEW_MAX = 4, 12
#: Literals this long are looked for together; shorter ones are found too often for that.
LONG_LITERAL = 4

# The assignment a context rule stands in.
ASSIGN_OP = r"(?:=|>|:{1,3}=|\|\||:|=>|\?=|,)"
VALUE_PAD = r"[\x60'\"\s=]{0,5}"
TAIL = r"(?:[\x60'\"\s;]|\\[nr]|\Z)"
# Keywords and candidate shapes of generic secrets.
KEYWORDS = (
    "api[-_]?key", "auth[-_]?key", "service[-_]?key", "account[-_]?key", "db[-_]?key", "database[-_]?key", "priv[-_]?key", "private[-_]?key", "client[-_]?key",
    "access[-_]?token", "auth[-_]?token", "api[-_]?token", "token", "db[-_]?pass", "database[-_]?pass", "key[-_]?pass", "password", "passwd", "pwd", "secret", "contrase[ñn]a",
)
VALUE = r"[^\s'\"`,;]{4,}"


@dataclass(frozen=True)
class Rule:
    family: str
    id: str
    label: str
    severity: str
    confidence: str
    pattern: str


def _generators() -> list[Rule]:
    word = "(?:" + "|".join(KEYWORDS) + ")"
    shapes = (
        ("keyword-assignment", "high", "active", rf"""(?i){word}\w*["'\])]{{0,2}}\s*(?::=|=>|[=!]{{1,3}}|:)\s*["'`]?({VALUE})"""),
        ("keyword-reverse-comparison", "high", "active", rf"""(?i)["']({VALUE})["']\s*[=!]{{2,3}}\s*\w*{word}"""),
        ("hex-high-entropy-string", "medium", "passive", r"""["']([0-9a-fA-F]{16,})["']"""),
        ("base64-high-entropy-string", "medium", "passive", r"""["']([A-Za-z0-9+/\-_]{16,}={0,2})["']"""),
    )
    return [Rule("detect-secrets", *(i, i, s, c, p)) for i, s, c, p in shapes]


def catalogue() -> list[Rule]:
    """All rules in family order; of rules with one id the first counts."""
    out = [Rule(family, *r) for family, listed in (("secret-leak", rules.PROVIDER_RULES), ("gitleaks", rules.PREFIX_RULES)) for r in listed]
    for i, label, severity, provider, value in rules.CONTEXT_RULES:
        out.append(Rule("gitleaks", i, label, severity, "passive", rf"""(?i)[\w.-]{{0,50}}?(?:{provider})(?:[ \t\w.-]{{0,20}})[\s'"]{{0,3}}{ASSIGN_OP}{VALUE_PAD}({value}){TAIL}"""))
    out += [Rule("nosey-parker", *r) for r in rules.STRUCTURE_RULES]
    out += _generators()
    out += [Rule("trufflehog", *r) for r in rules.VERIFIABLE_RULES]
    seen: set[str] = set()
    return [r for r in out if not (r.id in seen or seen.add(r.id))]


def _needed(parsed) -> frozenset[str]:
    """Literals of which every match of a parsed pattern contains one; empty if none can be told."""
    found, run = [], ""
    for op, arg in [*parsed, (None, None)]:
        if op is C.LITERAL:
            run += chr(arg).lower()
            continue
        if op is C.AT:
            continue
        if run:
            found.append(frozenset([run]))
            run = ""
        if op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] >= 1:
            found.append(_needed(arg[2]))
        elif op is C.SUBPATTERN:
            found.append(_needed(arg[3]))
        elif op is C.BRANCH:
            each = [_needed(b) for b in arg[1]]
            found.append(frozenset().union(*each) if all(each) else frozenset())
    return max(found, key=lambda x: (min(map(len, x), default=0), -len(x)), default=frozenset())


def required(pattern: str) -> tuple[str, ...]:
    """Lower-case literals of which every match contains one; empty if none can be told."""
    return tuple(sorted(_needed(_parser.parse(pattern)), key=len))


@lru_cache(maxsize=1)
def _compiled() -> list[tuple[Rule, tuple[str, ...], re.Pattern]]:
    return [(r, required(r.pattern), re.compile(r.pattern, re.ASCII)) for r in catalogue()]


def preview(secret: str) -> str:
    return (secret[:PREVIEW_HEAD] if len(secret) > 2 * PREVIEW_HEAD else "") + "…"


def fingerprint(secret: str) -> str:
    return hashlib.sha256(secret.encode()).hexdigest()[:16]


@lru_cache(maxsize=1)
def _literals() -> tuple[object, frozenset[int], dict[str, tuple[int, ...]]]:
    """(automaton of the longer literals, rules without any, shorter literals), each with the numbers of their rules."""
    by: dict[str, list[int]] = {}
    for k, (_, literals, _) in enumerate(_compiled()):
        for x in literals:
            by.setdefault(x, []).append(k)
    automaton = None
    if ahocorasick is not None:
        automaton = ahocorasick.Automaton()
        for x, rules_of in by.items():
            if len(x) >= LONG_LITERAL:
                automaton.add_word(x, tuple(rules_of))
        automaton.make_automaton()
    short = {x: tuple(ks) for x, ks in by.items() if automaton is None or len(x) < LONG_LITERAL}
    return automaton, frozenset(k for k, (_, literals, _) in enumerate(_compiled()) if not literals), short


def possible(text: str) -> set[int]:
    """Numbers of the rules of which a text has the literals: one pass for all the longer ones."""
    automaton, always, short = _literals()
    low, out = text.lower(), set(always)
    if automaton is not None:
        for _, ks in automaton.iter(low):
            out.update(ks)
    for x, ks in short.items():
        if x in low:
            out.update(ks)
    return out


def candidates(text: str) -> Iterator[tuple[Rule, int, str]]:
    """(rule, index, secret) of all matches of all rules; the first group, if any, is the secret."""
    for k in sorted(possible(text)):
        rule, _, pattern = _compiled()[k]
        for m in pattern.finditer(text):
            group = 1 if pattern.groups and m[1] is not None else 0
            yield rule, m.start(group), m[group]


FINDING = (
    "family string, rule_id string, rule_label string, severity string, confidence string, match_index int, match_length int, fingerprint string, redacted_preview string, excluded_by string"
)


def scan(fields: DataFrame) -> DataFrame:
    """Findings of ``fields`` (session_id, message_id, field, text): those columns less the text, and the finding's.

    ``excluded_by`` names the first exclusion filter that holds for a generic
    candidate (null: none). Null texts have no findings.
    """
    schema = f"session_id string, message_id string, field string, {FINDING}"
    names = ["session_id", "message_id", "field", *[c.split()[0] for c in FINDING.split(", ")]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for session, message, field, text in zip(*[c.to_pylist() for c in batch.columns]):
                for rule, at, secret in candidates(text or ""):
                    why = excluded(rule.id, secret, text, at) if rule.family == "detect-secrets" else None
                    rows.append((session, message, field, rule.family, rule.id, rule.label, rule.severity, rule.confidence, at, len(secret), fingerprint(secret), preview(secret), why))
            columns = list(zip(*rows)) or [[] for _ in names]
            kinds = [pa.int32() if n.startswith("match_") else pa.string() for n in names]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    picked = fields.select(F.col("session_id").cast("string"), F.col("message_id").cast("string"), "field", "text").where("text is not null and text <> ''")
    return picked.mapInArrow(run, schema)


def severity_rank(c: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c)


@dataclass(frozen=True)
class Gates:
    disabled: tuple[str, ...] = ()
    floor: str = "medium"
    confidence: str = "passive"
    allow: tuple[str, ...] = ()
    cap: int = 50


def gate(findings: DataFrame, gates: Gates = Gates()) -> DataFrame:
    """``findings`` with ``gate``: null if kept, else the first of disabled, floor, filtered, allowlisted, capped that stops it."""
    stop = (
        F.when(F.col("rule_id").isin(*gates.disabled), "disabled")
        .when((severity_rank(F.col("severity")) < SEVERITIES.index(gates.floor) + 1) | (F.array_position(F.array(*map(F.lit, CONFIDENCES)), F.col("confidence")) < CONFIDENCES.index(gates.confidence) + 1), "floor")
        .when(F.col("excluded_by").isNotNull(), "filtered")
        .when(F.col("fingerprint").isin(*gates.allow), "allowlisted")
    )
    nth = F.row_number().over(Window.partitionBy("message_id", "field", "family", F.col("_stop").isNull()).orderBy("match_index", "rule_id"))
    out = findings.withColumn("_stop", stop).withColumn("_nth", nth)
    return out.withColumn("gate", F.when(F.col("_stop").isNull() & (F.col("_nth") > gates.cap), "capped").otherwise(F.col("_stop"))).drop("_stop", "_nth")


def session_leaks(gated: DataFrame) -> DataFrame:
    """Per session and family: kept findings, those stopped by each gate, counts by rule, affected messages."""
    kept = F.col("gate").isNull()
    by_rule = gated.groupBy("session_id", "family", "rule_id").agg(
        F.count_if(kept).alias("n"), *[F.count_if(F.col("gate") == g).alias(g) for g in ("filtered", "allowlisted", "capped")], F.array_sort(F.collect_set(F.when(kept, F.col("message_id")))).alias("ids")
    )
    return by_rule.groupBy("session_id", "family").agg(
        F.sum("n").alias("leak_count"), *[F.sum(g).alias(g) for g in ("filtered", "allowlisted", "capped")],
        F.array_sort(F.collect_list(F.when(F.col("n") > 0, F.concat_ws(":", "rule_id", F.col("n").cast("string"))))).alias("rule_counts"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))).alias("message_ids"),
    )


def leak_report(gated: DataFrame, floor: str = "high") -> DataFrame:
    """Rules at or above ``floor``: findings, distinct secrets and sessions."""
    kept = gated.where(F.col("gate").isNull() & (severity_rank(F.col("severity")) >= SEVERITIES.index(floor) + 1))
    return kept.groupBy("family", "rule_id", "severity").agg(F.count("*").alias("findings"), F.countDistinct("fingerprint").alias("secrets"), F.countDistinct("session_id").alias("sessions"))


def listed(gated: DataFrame, limit: int) -> DataFrame:
    """The first ``limit`` kept findings by session and fingerprint, with how many are omitted."""
    kept = gated.where("gate is null")
    total = kept.count()
    return kept.orderBy("session_id", "fingerprint", "rule_id", "message_id", "match_index").limit(limit).withColumn("omitted", F.lit(max(0, total - limit)))


def verified(status: Column) -> Column:
    """What a provider's answer says of a credential: true at 200, false at 401 and 403, else unknown. No request is ever made here."""
    return F.when(status == 200, F.lit(True)).when(status.isin(401, 403), F.lit(False))
