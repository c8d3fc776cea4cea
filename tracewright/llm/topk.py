"""Exact top-k search by exhaustive term-at-a-time accumulation.

Vectors are sparse rows of whole numbers: a term is a component, its posting
list the candidates where it isn't 0, with their weights. Queries and
candidates are cut into blocks; each pair of blocks is one group, so a task
holds one block of each. In a group each query scatters its terms' weighted
postings into a dense array of scores, takes its k best by partition selection
and passes on only those; a window merges the blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import cut

QUERY_ROWS, CANDIDATE_ROWS = 2048, 8192
#: Postings that fill at least this share of a block are kept as a dense run.
DENSE = 0.25


def whole(vector: Column, scale: int) -> Column:
    """``floor(scale * x)`` of each component; null where a component is null or not finite."""
    doubles = vector.cast("array<double>")
    finite = F.forall(doubles, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return F.when(finite, F.transform(doubles, lambda x: F.floor(x * scale)))


def _dense(rows: pa.ListArray, width: int) -> np.ndarray:
    sizes = np.asarray(rows.value_lengths(), dtype=np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    at = np.repeat(np.arange(len(sizes)), sizes)
    out[at, np.arange(len(at)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = rows.flatten().to_numpy()
    return out


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, of equal ones the first; compares scores alone, so none is too large."""
    n = len(scores)
    if n <= k:
        return np.arange(n)
    last = np.partition(scores, n - k)[n - k]
    above = np.flatnonzero(scores > last)
    return np.concatenate((above, np.flatnonzero(scores == last)[: k - len(above)]))


def accumulate(queries: np.ndarray, candidates: np.ndarray, query_rows: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, candidate, score), as places, of the best ``k`` candidates of each query, ties to earlier candidates, without the query's own row."""
    n = len(rows)
    most = float(np.abs(queries.astype(np.float64)).sum(axis=1).max(initial=0)) * float(np.abs(candidates.astype(np.float64)).max(initial=0))
    kind = np.int32 if most < 2**31 else np.int64
    postings = []
    for term in candidates.T:
        at = np.flatnonzero(term)
        postings.append((slice(None), term.astype(kind)) if len(at) >= DENSE * n else (at, term[at].astype(kind)))
    scores, part = np.empty(n, dtype=kind), np.empty(n, dtype=kind)
    asked, found, sums = [], [], []
    for place, query in enumerate(queries):
        scores[:] = 0
        for term in np.flatnonzero(query):
            at, weights = postings[term]
            if isinstance(at, slice):
                scores += np.multiply(weights, kind(query[term]), out=part)
            else:
                scores[at] += weights * kind(query[term])
        take = best(scores, k + 1)  # the query's own row may be one of them
        take = take[rows[take] != query_rows[place]]
        asked.append(np.full(len(take), place))
        found.append(take)
        sums.append(scores[take].astype(np.int64))
    empty = [np.empty(0, np.int64)]
    return np.concatenate(asked or empty), np.concatenate(found or empty), np.concatenate(sums or empty)


def exact_topk(df: DataFrame, is_query: Column, id_col: str = "vec_id", vector_col: str = "embedding", k: int = 20, scale: int = 64) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` highest integer inner products of each query.

    Queries are the rows where ``is_query`` holds; candidates are all rows but the
    query's own row, so of rows that share an id each is a query and a candidate of its own. Rows with a null id, a null vector or a
    component that is null or not finite take no part. Ties go to the smaller id. A shorter vector is filled up with 0.
    Components and inner products must fit a long. Other columns are ignored; an empty table gives no rows.
    """
    vectors = df.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), is_query.alias("ask"), whole(F.col(vector_col), scale).alias("v"))
    vectors = cut(vectors.where("id is not null and v is not null"))  # row numbers are fixed from here on
    counts = vectors.agg(F.count("*"), F.coalesce(F.count_if("ask"), F.lit(0)), F.max(F.size("v"))).first()
    n, asked, width = counts[0], counts[1], counts[2] or 0
    across, down = max(1, -(-n // CANDIDATE_ROWS)), max(1, -(-asked // QUERY_ROWS))
    dealt = lambda m: F.pmod(F.xxhash64("row"), F.lit(m)).cast("int")
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    queries = vectors.where("ask").select(dealt(down).alias("i"), every(across).alias("j"), "row", "id", "v", F.lit(True).alias("ask"))
    candidates = vectors.select(every(down).alias("i"), dealt(across).alias("j"), "row", "id", "v", F.lit(False).alias("ask"))

    def search(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("row", "ascending")]).combine_chunks()
        ask = table.column("ask").to_numpy()
        ids, rows, vecs = table.column("id").to_numpy(), table.column("row").to_numpy(), _dense(table.column("v").combine_chunks(), width)
        query, found, score = accumulate(vecs[ask], vecs[~ask], rows[ask], rows[~ask], k)
        return pa.table({"query": rows[ask][query], "query_id": ids[ask][query], "vec_id": ids[~ask][found], "score": score})

    found = queries.union(candidates).groupBy("i", "j").applyInArrow(search, "query bigint, query_id bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
