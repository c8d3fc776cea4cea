"""Quality selection by importance resampling over hashed n-grams.

Two generative models over ``BUCKETS`` hashed one- and two-word features, one
of the target (texts labelled good) and one of all texts, give each text the
log ratio of its likelihoods. Adding Gumbel noise to it and keeping the ``k``
largest draws ``k`` texts without replacement in proportion to their weights.

Counts run over every text in one pass; each task hands on one pair of count
arrays. The ``k``-th largest key is found exactly by radix selection: four
histograms of 16 bits each, so nothing is sorted or gathered.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import cut, held

BUCKETS = 1 << 14
SMOOTH = 1.0
#: Word hashes a worker keeps.
HASH_LIMIT = 300_000
#: Labelled texts that the target model is fitted on, at most: those with the least md5 of their id.
MAX_TARGETS = 20_000


def features(text: str | None) -> np.ndarray:
    """Buckets of the words and word pairs of a whole text, A-Z lower-cased."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    hashes = held("importance", dict)
    if len(hashes) > HASH_LIMIT:
        hashes.clear()
    get = hashes.get
    found = []
    for w in words:
        h = get(w)
        if h is None:
            h = hashes[w] = crc32(w)
        found.append(h)
    one = np.array(found, dtype=np.int64)
    two = (one[:-1] * 31 + one[1:]) * 2_654_435_761 >> 17
    return np.concatenate((one, two)) & (BUCKETS - 1)


def targets(labels: DataFrame, id_col: str, good: str, limit: int) -> DataFrame:
    """(_target) ids of the labelled good rows that the model is fitted on."""
    ids = labels.where(good).select(F.col(id_col).alias("_target")).where("_target is not null").distinct()
    return ids.orderBy(F.md5(F.col("_target").cast("string")), "_target").limit(limit)


def bucket_counts(df: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> tuple[np.ndarray, np.ndarray]:
    """Feature counts of all texts and of the target texts: two arrays of ``BUCKETS``."""
    # at most MAX_TARGETS ids: a proven bound
    marked = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_id") == F.col("_target"), "left").select("_text", F.col("_target").isNotNull().alias("_good"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for text, is_good in zip(batch.column(0), batch.column(1)):
                n = np.bincount(features(text.as_py()), minlength=BUCKETS)
                every += n
                if is_good.as_py():
                    good += n
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS)), pa.array(every), pa.array(good)], names=["bucket", "every", "good"])

    rows = marked.mapInArrow(run, "bucket bigint, every bigint, good bigint").groupBy("bucket").agg(F.sum("every").alias("every"), F.sum("good").alias("good")).collect()
    every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for r in rows:  # BUCKETS rows
        every[r.bucket], good[r.bucket] = r.every, r.good
    return every, good


def log_ratios(every: np.ndarray, good: np.ndarray) -> np.ndarray:
    model = lambda n: np.log((n + SMOOTH) / (n.sum() + SMOOTH * BUCKETS))
    return model(good) - model(every)


def gumbel(ident: object, seed: int) -> float:
    """Standard Gumbel noise that the id and the seed decide."""
    u = (xxhash.xxh64_intdigest(str(ident), seed) >> 11) + 0.5
    return -np.log(-np.log(u / (1 << 53)))


def sortable(values: np.ndarray) -> np.ndarray:
    """Longs in the order of the doubles."""
    bits = values.astype(np.float64).view(np.int64)
    return bits ^ ((bits >> 63) & np.int64(0x7FFF_FFFF_FFFF_FFFF))


def kth_largest(keys: DataFrame, col: str, k: int) -> int:
    """The exact ``k``-th largest of a column of longs, by four histograms of 16 bits."""
    rows, prefix = keys.select(F.col(col).alias("_k")), None
    for shift in (48, 32, 16, 0):
        digit = F.shiftright("_k", shift)
        part = rows if prefix is None else rows.where(F.shiftright("_k", shift + 16) == prefix)
        for value, n in sorted(part.groupBy(digit.alias("d")).agg(F.count("*").alias("n")).collect(), reverse=True):  # 65,536 rows at most
            if k <= n:
                prefix = value
                break
            k -= n
    return prefix


def resample(df: DataFrame, labels: DataFrame, k_share: float | None = None, id_col: str = "doc_id", text_col: str = "text", good: str = "quality = 1", known: str = "quality is not null", seed: int = 42, max_targets: int = MAX_TARGETS) -> DataFrame:
    """``id_col``, ``log_weight`` (double), ``gumbel_key`` (double) and ``kept`` of every row.

    ``k_share`` of the rows are drawn (rounded up); if None, the share of good ones among the
    labelled, so as many as the labels say are good. Rows that tie with the last
    one drawn are all kept. Texts are read whole; a null or empty one has weight 0. Repeated
    rows get equal keys; a null id has the noise of "None". Without a labelled good row
    all weights are those of an even target model; an empty table gives no rows. Other columns are ignored.
    """
    if k_share is None:
        n_known, n_good = labels.where(known).agg(F.count("*"), F.coalesce(F.count_if(F.expr(good)), F.lit(0))).first()
        k_share = n_good / n_known if n_known else 1.0
    chosen = cut(targets(labels, id_col, good, max_targets))
    ratios = df.sparkSession.sparkContext.broadcast(log_ratios(*bucket_counts(df, chosen, id_col, text_col)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights = ratios.value
        for batch in batches:
            log_weight = np.array([weights[features(x.as_py())].sum() for x in batch.column(1)], dtype=np.float64)
            key = log_weight + np.array([gumbel(x.as_py(), seed) for x in batch.column(0)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(log_weight), pa.array(key), pa.array(sortable(key))], names=[id_col, "log_weight", "gumbel_key", "_order"])

    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, log_weight double, gumbel_key double, _order bigint"
    scored = cut(df.select(id_col, F.col(text_col).alias("_text")).mapInArrow(run, schema))
    n = scored.count()
    k = min(n, -int(-n * k_share // 1))
    if k == 0:
        return scored.withColumn("kept", F.lit(False)).drop("_order")
    return scored.withColumn("kept", F.col("_order") >= kth_largest(scored, "_order", k)).drop("_order")
