"""Quality rules as a ledger of failure bits and measurements.

:func:`measure` reads each text once and stores integer measurements.
:func:`ledger` evaluates every rule once on them and stores bit ``k`` of
``fail_bits`` for a failure of rule ``k``. A policy is a named, versioned set of
rules, that is, a mask: a document is kept when ``fail_bits & mask`` is 0, so a
new policy needs no second look at the texts. :func:`ablation` gives what each
rule of a policy does alone and what its removal would bring back; it works on
the counts of each bit pattern, at most ``2 ** len(RULES)`` rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import held

WINDOW = 5
SPACES = (9, 10, 11, 12, 13, 32)
SYMBOLS = b"#*$%&|<>"

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_bare_words", "n_upper", "n_ellipsis_lines", "n_bullet_lines")

#: (name, SQL condition of failure) by bit; conditions are in whole numbers.
RULES = (
    ("few_words", "n_words < 10"),
    ("repeated_passages", "100 * n_repeat_words > 20 * n_words"),
    ("symbols", "10 * n_symbols > n_words"),
    ("short_words", "word_chars < 3 * n_words"),
    ("long_words", "word_chars > 12 * n_words"),
    ("duplicate_lines", "10 * n_dup_lines > 3 * n_lines"),
    ("words_without_letters", "10 * n_bare_words > 2 * n_words"),
    ("capitals", "10 * n_upper > 4 * word_chars"),
    ("ellipses", "10 * n_ellipsis_lines > 3 * n_lines"),
    ("bullets", "10 * n_bullet_lines > 9 * n_lines"),
)
BITS = {name: 1 << k for k, (name, _) in enumerate(RULES)}

#: Versioned policies: the rules whose failure rejects a document.
POLICIES = {
    "base-1": ("few_words", "repeated_passages"),
    "prose-1": ("few_words", "repeated_passages", "symbols", "short_words", "long_words", "duplicate_lines", "words_without_letters", "capitals", "ellipses", "bullets"),
}


def policy_mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more in the text."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter([seen.setdefault(w, len(seen)) for w in words], dtype=np.int64, count=len(words))
    if len(seen) == len(words):
        return 0
    key, top = ids[:n], len(seen)
    for k in range(1, size):
        if top * len(seen) >= 1 << 62:  # rank the windows so far, so that codes stay exact
            key = np.unique(key, return_inverse=True)[1]
            top = n
        key, top = key * len(seen) + ids[k : n + k], top * len(seen)
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    edge = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(twice)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + size, -1)
    return int((np.cumsum(edge) > 0).sum())


def measured(text: str | None) -> tuple[int, ...]:
    data = (text or "").encode()
    words = data.split()  # bytes split at exactly the six ASCII spaces
    hist = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    code_points = len(data) - int(hist[128:192].sum())
    lines = [x for x in data.split(b"\n") if x.strip()]
    letters = np.frombuffer(data, dtype=np.uint8)
    is_letter = (letters >= 128) | ((letters | 32) - 97 < 26).astype(bool)
    is_space = (letters == 32) | ((letters >= 9) & (letters <= 13))
    bare = 0
    if words:
        starts = np.flatnonzero(~is_space & np.concatenate(([True], is_space[:-1])))
        bare = int((np.add.reduceat(is_letter.astype(np.int32), starts) == 0).sum())
    return (
        len(words),
        code_points - int(hist[list(SPACES)].sum()),
        int(hist[list(SYMBOLS)].sum()),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        bare,
        int(hist[65:91].sum()),
        sum(x.rstrip().endswith((b"...", "…".encode())) for x in lines),
        sum(x.lstrip().startswith((b"-", b"*", "•".encode())) for x in lines),
    )


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns in ``carry`` and the measurements (long) of every text.

    A null text measures like an empty one: all 0. Repeated rows are measured
    each; other columns are ignored; an empty table gives no rows.
    """
    names = list(dict.fromkeys((id_col, *carry)))
    at = names.index(text_col) if text_col in names else len(names)  # a carried text is sent once
    slim = df.select(*names, *([F.col(text_col).alias("_text")] if at == len(names) else []))
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names], *[f"{m} bigint" for m in MEASURES]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("quality rules", object)
        for batch in batches:
            table = np.array([measured(x.as_py()) for x in batch.column(at)], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *[pa.array(table[:, k]) for k in range(len(MEASURES))]], names=[*names, *MEASURES])

    return slim.mapInArrow(run, schema)


def ledger(measurements: DataFrame) -> DataFrame:
    """``measurements`` with ``fail_bits`` (long)."""
    bits = sum((F.when(F.expr(condition), F.lit(BITS[name])).otherwise(F.lit(0)).cast("long") for name, condition in RULES), F.lit(0).cast("long"))
    return measurements.withColumn("fail_bits", bits)


def apply_policy(led: DataFrame, policy: str = "prose-1") -> DataFrame:
    """``led`` with ``kept``: no rule of the policy failed."""
    return led.withColumn("kept", F.col("fail_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablation(led: DataFrame, policy: str = "prose-1") -> DataFrame:
    """For each rule of the policy: documents it fails, fails alone, and that the policy would keep without it.

    Columns rule, failed, failed_alone, kept_without (long).
    """
    mask = policy_mask(policy)
    patterns = led.groupBy(F.col("fail_bits").bitwiseAND(F.lit(mask).cast("long")).alias("bits")).agg(F.count("*").alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(BITS[r]).cast("long").alias("bit")) for r in POLICIES[policy]])).alias("r")
    each = patterns.select("bits", "n", rules).select("bits", "n", "r.rule", "r.bit")
    hit, others = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits").bitwiseAND(F.bitwise_not(F.col("bit")))
    total = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0)).alias
    return each.groupBy("rule").agg(total(hit)("failed"), total(hit & (others == 0))("failed_alone"), total(others == 0)("kept_without"))
