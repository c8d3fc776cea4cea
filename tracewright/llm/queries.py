"""The opN queries: each operator over its whole table, with its production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewright.llm import bpe_fst, quality_rules
from tracewright.llm.feistel import feistel_shards
from tracewright.llm.importance import resample
from tracewright.llm.licenses import scan_licenses
from tracewright.llm.line_dedup import drop_site_boilerplate
from tracewright.llm.mixing import mix_to_weights
from tracewright.llm.secret_grammar import find_secrets
from tracewright.llm.simhash import near_classes
from tracewright.llm.topk import exact_topk

SHARDS = 40

#: The mixture of the documents table. Its sources end in a number, which stands for their domain here.
WEIGHTS = {"web": 50, "books": 30, "code": 20, "*/en": 50, "*/de": 20, "*/fr": 15, "*/es": 15, "*/*/src0": 2}
DOMAIN_SQL = "CASE WHEN try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int) < 10 THEN 'web' WHEN try_cast(regexp_extract(source, '([0-9]{1,9})$', 1) AS int) < 15 THEN 'books' ELSE 'code' END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mixed(docs: DataFrame) -> DataFrame:
    return mix_to_weights(docs, WEIGHTS, F.expr(DOMAIN_SQL), F.col("lang"), F.col("source"), max_epochs=3, budget_percent=100, seed=42)


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixed(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.expr(DOMAIN_SQL).alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("tokens"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_site_boilerplate(table(spark, sf_dir, "documents"), "source", "text", max_ratio=0.05)
    return out.select("doc_id", "source", "n_lines", "n_dropped", "text")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents")))
    base = F.col("fail_bits").bitwiseAND(F.lit(quality_rules.policy_mask("base-1")).cast("long")) != 0
    out = quality_rules.apply_policy(led, "prose-1").withColumn("base_failed", base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "fail_bits", F.lit("prose-1").alias("policy"))


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each rule of op3's policy does alone, and what its removal would bring back."""
    return quality_rules.ablation(quality_rules.ledger(quality_rules.measure(table(spark, sf_dir, "documents"))), "prose-1")


def op4_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_secrets(table(spark, sf_dir, "documents"))
    kind = lambda name: F.filter("found", lambda x: x["kind"] == name)
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["stop"].cast("string"))), ",")
    return out.select(
        "doc_id",
        *[F.size(kind(k)).cast("long").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.filter("found", lambda x: x["kind"] != "format")), 256).alias("base_sha256"),
        joined(F.col("found")).alias("spans"),
        F.size(kind("format")).cast("long").alias("n_format"),
    )


def op5_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return exact_topk(vectors, F.col("vec_id") % 20 == 0, k=20, scale=64)


def ids_sha256(ids: Column) -> Column:
    return F.sha2(F.concat_ws(" ", ids.cast("array<string>")), 256)


def op8_bpe_fst(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    out = bpe_fst.encode(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, decode_col="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), ids_sha256(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), seed=42)


def op7_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = feistel_shards(table(spark, sf_dir, "documents"), shards=SHARDS, seed=42)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_classes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id",
        "n_paragraphs",
        F.array_join(F.array_sort(F.array_distinct(F.transform("found", lambda x: x["family"]))), ",").alias("families"),
        F.array_join(F.transform("found", lambda x: F.concat_ws(":", x["family"], x["start"].cast("string"), x["stop"].cast("string"))), ",").alias("spans"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mixing": op1_mixing,
    "op2_line_dedup": op2_line_dedup,
    "op3_quality_rules": op3_quality_rules,
    "op4_secret_grammar": op4_secret_grammar,
    "op5_topk": op5_topk,
    "op6_importance": op6_importance,
    "op7_feistel": op7_feistel,
    "op8_bpe_fst": op8_bpe_fst,
    "op9_simhash": op9_simhash,
    "op10_licenses": op10_licenses,
    "quality_ablation": quality_ablation,
}

_DOMAIN = "CASE WHEN try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS int) < 10 THEN 'web' WHEN try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS int) < 15 THEN 'books' ELSE 'code' END"


def _share(nodes: str, parent: str, name: str) -> str:
    """SQL that shares ``budget`` among the rows of ``nodes`` (weight, cap) of each parent."""
    return f"""(SELECT * EXCLUDE (level, line), CASE WHEN line IS NULL OR cap / weight <= line THEN cap ELSE least(cap, floor(line * weight)::BIGINT) END AS alloc
    FROM (SELECT *, first(CASE WHEN cap / weight > level THEN level END IGNORE NULLS) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS line
      FROM (SELECT *, (budget - coalesce(sum(cap) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
          / sum(weight) OVER (PARTITION BY {parent} ORDER BY cap / weight, {name} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM {nodes})))"""


ORACLE_SQL: dict[str, str] = {
    "op3_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT id, unnest(words) AS word, unnest(range(len(words))) AS pos FROM w),
f5 AS (SELECT id, pos, word || ' ' || lead(word, 1) OVER x || ' ' || lead(word, 2) OVER x || ' ' || lead(word, 3) OVER x || ' ' || lead(word, 4) OVER x AS five FROM g WINDOW x AS (PARTITION BY id ORDER BY pos)),
h AS (SELECT id, pos, count(*) OVER (PARTITION BY id, five) AS n FROM f5 WHERE five IS NOT NULL),
r AS (SELECT id, count(DISTINCT pos + k) AS n_repeat_words FROM h, range(5) AS o(k) WHERE n > 1 GROUP BY 1),
m AS (SELECT w.id, doc_id, len(words) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
    len(list_filter(words, lambda x: NOT regexp_matches(x, '[A-Za-z]|[^\x00-\x7F]'))) AS n_bare_words, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper,
    len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipsis_lines, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) AS n_bullet_lines
  FROM w LEFT JOIN r ON w.id = r.id),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    (n_words < 10)::BIGINT + 2 * (100 * n_repeat_words > 20 * n_words)::BIGINT + 4 * (10 * n_symbols > n_words)::BIGINT + 8 * (word_chars < 3 * n_words)::BIGINT + 16 * (word_chars > 12 * n_words)::BIGINT
    + 32 * (10 * n_dup_lines > 3 * n_lines)::BIGINT + 64 * (10 * n_bare_words > 2 * n_words)::BIGINT + 128 * (10 * n_upper > 4 * word_chars)::BIGINT + 256 * (10 * n_ellipsis_lines > 3 * n_lines)::BIGINT + 512 * (10 * n_bullet_lines > 9 * n_lines)::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, fail_bits = 0 AS kept, fail_bits, 'prose-1' AS policy FROM f""",
    "op5_topk": r"""
WITH v AS (SELECT row_number() OVER () AS row, vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(x * 64)) AS q FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row, a.vec_id AS query_id, b.vec_id, coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: coalesce(z[1] * z[2], 0))), 0)::BIGINT AS score FROM v a JOIN v b ON a.row <> b.row WHERE a.vec_id % 20 = 0)
SELECT query_id, rank::INT AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY row ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 20""",
    "op1_mixing": rf"""
WITH slim AS (SELECT doc_id, {_DOMAIN} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source, lang AS lang0, source AS source0, coalesce(text, '') AS text,
    len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS tokens FROM documents),
leaves AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens, (sum(tokens) * 3)::BIGINT AS cap,
    CASE domain WHEN 'web' THEN 50 WHEN 'books' THEN 30 ELSE 20 END AS w1, CASE lang WHEN 'en' THEN 50 WHEN 'de' THEN 20 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 1 END AS w2,
    CASE WHEN source = 'src0' THEN 2 ELSE 1 END AS weight FROM slim GROUP BY 1, 2, 3),
d0 AS (SELECT domain, w1 AS weight, sum(cap)::BIGINT AS cap, 0 AS root FROM leaves GROUP BY 1, 2),
d1 AS (SELECT *, least((SELECT sum(tokens)::BIGINT FROM leaves), (SELECT sum(cap)::BIGINT FROM leaves)) AS budget FROM d0),
d2 AS (SELECT * FROM {_share("d1", "root", "domain")}),
l1 AS (SELECT l.domain, lang, w2 AS weight, sum(l.cap)::BIGINT AS cap, any_value(d2.alloc) AS budget FROM leaves l JOIN d2 ON l.domain = d2.domain GROUP BY 1, 2, 3),
l2 AS (SELECT * FROM {_share("l1", "domain", "lang")}),
s1 AS (SELECT l.domain, l.lang, l.source, l.tokens, l.weight, l.cap, l2.alloc AS budget FROM leaves l JOIN l2 ON l.domain = l2.domain AND l.lang = l2.lang),
s2 AS (SELECT domain, lang, source, (alloc // tokens)::INT AS full_epochs, alloc % tokens AS rest FROM {_share("s1", "domain, lang", "source")} WHERE tokens > 0),
r AS (SELECT s.*, full_epochs, rest, sum(tokens) OVER (PARTITION BY s.domain, s.lang, s.source ORDER BY md5('42:' || full_epochs || ':' || coalesce(doc_id::VARCHAR, 'null') || ':' || md5(text)) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run
    FROM slim s JOIN s2 ON s.domain = s2.domain AND s.lang = s2.lang AND s.source = s2.source)
SELECT doc_id, domain, lang0 AS lang, source0 AS source, epoch::INT AS epoch, tokens FROM (SELECT *, unnest(range(full_epochs)) AS epoch FROM r)
UNION ALL SELECT doc_id, domain, lang0, source0, full_epochs, tokens FROM r WHERE rest > 0 AND run <= rest""",
    "op2_line_dedup": r"""
WITH p AS (SELECT row_number() OVER () AS id, doc_id, source, coalesce(source, '') AS host, text, string_split(text, chr(10)) AS lines FROM documents),
l AS (SELECT DISTINCT id, host, unnest(lines) AS line FROM p),
b AS (SELECT host, line FROM (SELECT host, line, count(*) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1, 2) JOIN (SELECT host, count(*) AS total FROM p GROUP BY 1) USING (host) WHERE n / total > 0.05),
g AS (SELECT id, list(line) AS gone FROM l JOIN b USING (host, line) GROUP BY 1),
k AS (SELECT p.*, list_filter(lines, lambda x: NOT list_contains(coalesce(gone, []), x)) AS stay FROM p LEFT JOIN g USING (id))
SELECT doc_id, source, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(stay), 0) AS n_dropped, CASE WHEN text IS NOT NULL THEN array_to_string(stay, chr(10)) END AS text FROM k""",
}
ORACLE_SQL["quality_ablation"] = f"""WITH led AS ({ORACLE_SQL["op3_quality_rules"]}), r(rule, bit) AS (VALUES {", ".join(f"('{name}', {bit}::BIGINT)" for name, bit in quality_rules.BITS.items())})
SELECT rule, count(*) FILTER (fail_bits & bit <> 0) AS failed, count(*) FILTER (fail_bits = bit) AS failed_alone, count(*) FILTER (fail_bits & ~bit = 0) AS kept_without FROM led, r GROUP BY 1"""
