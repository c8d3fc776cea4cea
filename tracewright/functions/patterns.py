"""Regular expressions with ASCII word boundaries, and the fixed pattern lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The ASCII boundary; the JVM's own also sees letters beyond ASCII.
BOUNDARY = r"(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

# Corrections in user text, strong, weak and leading ones.
STRONG = (
    r"\bno[,.\s]+(use|do|don'?t|that'?s|that is|it'?s|it is|use the)\b",
    r"\bnot\s+(that|this|like that|like this|what i)\b",
    r"\bdon'?t\s+(do|use|run|edit|add|remove|change|try|create)\b",
    r"\bstop\s+(doing|using|running|trying)\b",
    r"\bthat'?s\s+(wrong|incorrect|not right|not what)\b",
    r"\bthat\s+is\s+(wrong|incorrect|not what)\b",
    r"\binstead\s+of\s+(that|this)\b",
    r"\bi\s+(said|told you|already said|already told|meant)\b",
    r"\bactually[,.\s]",
    r"\brevert\b",
)
WEAK = (
    r"\bcould\s+you\s+(please\s+)?(try|use|do|change|switch)\b",
    r"\bmaybe\s+(we|you|try)\b",
    r"\bwhy\s+don'?t\s+you\b",
    r"\bprefer\s+to\s+(use|do)\b",
    r"\bplease\s+(use|do|try|don'?t)\b",
    r"\bshould\s+(use|do|be|have)\b",
)
LEADING = (r"^\s*no\b", r"^\s*not\b", r"^\s*never\b", r"^\s*don'?t\b", r"^\s*nope\b")


def jvm(pattern: str, flags: str = "i") -> str:
    """A pattern of these lists for the JVM: ASCII boundaries, and ``$`` only at the end of the text."""
    out = pattern.replace(r"\b", BOUNDARY)
    if "m" not in flags:
        out = out.replace(r"\$", "\0").replace("$", r"\z").replace("\0", r"\$")
    return (f"(?{flags})" if flags else "") + out


def matched(text: Column, patterns: tuple[str, ...], flags: str = "i") -> Column:
    """The patterns (as listed) found in ``text``, in their order."""
    hits = F.array(*[F.when(text.rlike(jvm(p, flags)), F.lit(p)) for p in patterns])
    return F.filter(hits, lambda p: p.isNotNull())


def any_of(patterns: tuple[str, ...]) -> str:
    """One RE2 pattern for all, for the SQL side."""
    return "(?i)(" + "|".join(patterns) + ")"
