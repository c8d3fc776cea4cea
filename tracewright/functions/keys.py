"""Content addresses: 16 hex digits of SHA-256 over labelled, canonical text."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def address(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 16)


def labelled(label: str, *parts: Column) -> Column:
    return address(F.concat(F.lit(label + "("), F.concat_ws("|", *parts), F.lit(")")))


def source_set_hash(kind: Column, ident: Column) -> Column:
    """An aggregate: the address of a set of sources, whatever their order."""
    return address(F.concat(F.lit("sources("), F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", kind, ident))), "|"), F.lit(")")))


def config_fingerprint(config_hash: Column, models: Column, extras: Column) -> Column:
    return labelled("config", config_hash, F.array_join(F.array_sort(F.concat(models, extras)), "|"))


def input_key(analyzer: Column, version: Column, fingerprint: Column, source_set: Column) -> Column:
    return labelled("input", analyzer, version, fingerprint, source_set)


def output_key(key: Column, content: Column) -> Column:
    return labelled("output", key, content)


def proposal_key(key: Column, ordinal: Column) -> Column:
    return labelled("proposal", key, ordinal.cast("string"))


def assertion_id(kind: Column, key: Column, verdict: Column) -> Column:
    return address(F.concat_ws("|", kind, key, verdict))


def uuid7() -> Column:
    """A UUID of version 7: milliseconds since 1970, then random digits; new for each row, so store what it gives."""
    milliseconds = F.lpad(F.lower(F.hex(F.unix_millis(F.current_timestamp()))), 12, "0")
    rest = F.regexp_replace(F.uuid(), "-", "")
    return F.concat(F.substring(milliseconds, 1, 8), F.lit("-"), F.substring(milliseconds, 9, 4), F.lit("-7"), F.substring(rest, 14, 3), F.lit("-"), F.substring(rest, 17, 4), F.lit("-"), F.substring(rest, 21, 12))


def canonical(text: str | None) -> str | None:
    """JSON with keys sorted at every level, whole numbers without a fraction, no spaces; text that is not JSON stays."""
    if text is None:
        return None

    def plain(x: object) -> object:
        if isinstance(x, float) and x.is_integer() and abs(x) < 1e15:
            return int(x)
        if isinstance(x, dict):
            return {k: plain(v) for k, v in x.items()}
        return [plain(v) for v in x] if isinstance(x, list) else x

    try:
        return json.dumps(plain(json.loads(text)), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    except ValueError:
        return text


@F.pandas_udf(T.StringType())
def canonical_json(texts: pd.Series) -> pd.Series:
    return texts.map(canonical)
