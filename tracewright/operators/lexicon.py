"""Words of users' own prose, and what they say of frustration."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator
from itertools import pairwise

import pandas as pd
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.schema import TURN_WORD_ROLES

# What is not prose, and the shapes of words.
NOT_PROSE = (
    r"```[\s\S]*?```|~~~[\s\S]*?~~~",
    r"`[^`\n]*`",
    r"<([a-z][a-z0-9-]*)(?:\s[^>]*)?>[\s\S]*?</\1\s*>",
    r"<([a-z][a-z0-9-]*)(?:\s[^>]*)?>[\s\S]*?</\1\s*>",
    r"</?[a-z][a-z0-9-]*(?:\s[^>]*)?/?>",
    r"(?i)\b(?:https?://|www\.)\S+",
    r"\S*[/\\]\S*",
    r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)+",
    r"[@\p{L}\p{N}]*[_@][\p{L}\p{N}_@]*",
)
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+(?:['’\-][\p{L}\p{M}\p{N}]+)*")
EMOJI = regex.compile(r"\p{Extended_Pictographic}(?:[️\U0001F3FB-\U0001F3FF]|‍\p{Extended_Pictographic})*")
CASED = regex.compile(r"[\p{L}\p{M}']+")
PRESSED = regex.compile(r"\p{Lu}{3,}[^\p{L}]*[?!]")
ELONGATED = regex.compile(r"(\p{L})\1{2,}")
SHORTEST, LONGEST, SHOUT = 2, 32, 5
_NOT_PROSE = [regex.compile(p) for p in NOT_PROSE]


def prose(text: str) -> str:
    out = unicodedata.normalize("NFKC", text)
    for p in _NOT_PROSE:
        out = p.sub(" ", out)
    return out


def words_of(text: str | None) -> list[str]:
    """Lower-case words and emoji of a text's prose, in order of place."""
    body = prose(text or "")
    found = [(m.start(), w) for m in WORD.finditer(body) if SHORTEST <= len(w := m[0].lower()) <= LONGEST and not any(c.isdigit() for c in w)]
    return [w for _, w in sorted(found + [(m.start(), m[0]) for m in EMOJI.finditer(body)])]


def _capital(word: str) -> bool:
    return len(word) > 1 and word.isupper() and word == word.upper()


def shouts(body: str) -> bool:
    """Neighbouring words in capitals, one of the two at least ``SHOUT`` long, or capitals pressed against ? or !."""
    listed = CASED.findall(body)
    return any(len(max(two, key=len)) >= SHOUT and all(map(_capital, two)) for two in pairwise(listed)) or PRESSED.search(body) is not None


def markers_of(text: str | None) -> list[str]:
    body = prose(text or "")
    tests = (("shouting", shouts(body)), ("repeated_punctuation", regex.search("[?!]{2,}", body)), ("elongation", ELONGATED.search(body)))
    return [name for name, hit in tests if hit]


@F.pandas_udf(T.ArrayType(T.StringType()))
def words(texts: pd.Series) -> pd.Series:
    return texts.map(words_of)


@F.pandas_udf(T.ArrayType(T.StringType()))
def markers(texts: pd.Series) -> pd.Series:
    return texts.map(markers_of)


def term_counts(messages: DataFrame) -> DataFrame:
    """(session_id, term, n) over users' rows."""
    mine = messages.where(F.col("role").isin(*TURN_WORD_ROLES))
    return mine.select("session_id", F.explode(words("content_text")).alias("term")).groupBy("session_id", "term").agg(F.count("*").alias("n"))


def nominate(counts: DataFrame, k: int = 2000) -> DataFrame:
    """The ``k`` most frequent terms of each session, with its distinct and total words."""
    by = Window.partitionBy("session_id")
    rank = F.row_number().over(by.orderBy(F.desc("n"), "term"))
    return counts.withColumns({"rank": rank, "distinct_terms": F.count("*").over(by), "total_words": F.sum("n").over(by)}).where(F.col("rank") <= k)


def unjudged(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Terms of the corpus that no entry of the lexicon judges yet: each is judged once for all sessions."""
    return counts.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("sessions")).join(lexicon.select("term"), "term", "left_anti")


def judge(terms: DataFrame, caller: Callable[[list[str]], list[tuple[str, str, str, float]]], batch: int = 200) -> DataFrame:
    """Lexicon entries of ``terms`` by ``caller``, which maps terms to (polarity, category, language, confidence); calls run in the tasks."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for k in range(0, len(frame), batch):
                part = frame.iloc[k : k + batch]
                yield pd.DataFrame([(t, *v) for t, v in zip(part.term, caller(list(part.term)))], columns=["term", "polarity", "category", "language", "confidence"])

    return terms.select("term").mapInPandas(run, "term string, polarity string, category string, language string, confidence double")


def frustration(turns: DataFrame, lexicon: DataFrame, muted: DataFrame, min_confidence: float = 0.5, term_weight: float = 0.5, marker_weight: float = 0.3) -> DataFrame:
    """(session_id, turn_idx, signal, weight): negative terms of the lexicon that aren't muted, and markers, in users' texts.

    Joins on the term; the lexicon is one row per term of the corpus and joins by its size.
    """
    texts = turns.select("session_id", "turn_idx", "user_text")
    usable = lexicon.where((F.col("polarity") == "negative") & (F.col("confidence") >= min_confidence)).join(muted, "term", "left_anti").select("term")
    said = texts.select("session_id", "turn_idx", F.explode(F.array_distinct(words("user_text"))).alias("term"))
    hits = said.join(usable, "term").select("session_id", "turn_idx", F.concat(F.lit("term:"), "term").alias("signal"), F.lit(term_weight).alias("weight"))
    marks = texts.select("session_id", "turn_idx", F.explode(markers("user_text")).alias("m")).select("session_id", "turn_idx", F.concat(F.lit("marker:"), "m").alias("signal"), F.lit(marker_weight).alias("weight"))
    return hits.union(marks)


def select_for_enrichment(turns: DataFrame, signals: DataFrame, share: float = 0.2, ceiling: int = 40) -> DataFrame:
    """The turns of each session with the most friction and frustration: ``min(max(1, round(share * turns)), ceiling)`` of them."""
    weight = signals.groupBy("session_id", "turn_idx").agg(F.sum("weight").alias("_w"))
    scored = turns.join(weight, ["session_id", "turn_idx"], "left").withColumn("rank_score", F.round(F.col("friction_score") + F.coalesce("_w", F.lit(0.0)), 6))
    by = Window.partitionBy("session_id")
    cap = F.least(F.lit(ceiling), F.greatest(F.lit(1), F.round(share * F.count("*").over(by)).cast("int")))
    rank = F.row_number().over(by.orderBy(F.desc("rank_score"), "turn_idx"))
    return scored.withColumns({"rank": rank, "cap": cap}).where(F.col("rank") <= F.col("cap")).drop("_w")
