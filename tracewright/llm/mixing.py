"""Mixing sources to target weights by hierarchical budgets.

A budget of tokens runs down a tree (domain, language, source). Each node's
budget is shared among its children in proportion to their weights, bounded by
what a child can give (its tokens times ``max_epochs``). What one child cannot
give goes to its siblings first; since a node is never asked for more than its
leaves hold together, only what all siblings lack reaches the ancestors' other
branches. The level is found in closed form with window sums over children
sorted by capacity per weight, so no loop runs on the driver.

A leaf with budget ``b`` and ``t`` tokens yields ``b // t`` whole epochs and the
prefix of the next epoch whose cumulative tokens fit the rest. The order within
an epoch is that of ``md5(seed:epoch:id:md5(text))``. Prefixes come from sums over
digest buckets, as many as hold some ``BUCKET_ROWS`` rows each; only the bucket at the
boundary is sorted, so neither a leaf with a third of all rows nor an id that many
rows share is gathered into one task.
"""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewright.llm.common import apart, back, bucket_digits, cut, hex_bucket, small_side, word_count

LEVELS = ("domain", "language", "origin")
ADDED = ("mix_tokens", "mix_epoch")


def _weight(weights: dict[str, int], *path: str) -> Column:
    """The weight of a node: of its full path, else of its name at that level ("*/name"), else 1."""
    full = F.concat_ws("/", *path)
    by_name = F.concat(F.lit("*/" * (len(path) - 1)), F.col(path[-1]))
    if not weights:
        return F.lit(1).cast("long")
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v).cast("long")) for k, v in weights.items()))
    return F.coalesce(table[full], table[by_name], F.lit(1).cast("long"))


def share(nodes: DataFrame, parent: list[str], name: str) -> DataFrame:
    """``nodes`` (with _budget, _weight, _cap) with ``_alloc``, their part of the budget of their parent."""
    w = Window.partitionBy(*parent).orderBy(F.col("_cap") / F.col("_weight"), name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    level = (F.col("_budget") - F.coalesce(F.sum("_cap").over(before), F.lit(0))) / F.sum("_weight").over(after)
    first = F.first(F.when(F.col("_cap") / F.col("_weight") > F.col("_level"), F.col("_level")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return (
        nodes.withColumn("_level", level)
        .withColumn("_line", first)
        .withColumn("_alloc", F.when(F.col("_line").isNull() | (F.col("_cap") / F.col("_weight") <= F.col("_line")), F.col("_cap")).otherwise(F.least("_cap", F.floor(F.col("_line") * F.col("_weight")))))
        .drop("_level", "_line")
    )


def leaf_budgets(leaves: DataFrame, weights: dict[str, int], max_epochs: int, budget_percent: int) -> DataFrame:
    """(domain, language, origin, tokens, _alloc) from (domain, language, origin, tokens)."""
    d, l, s = LEVELS
    tree = leaves.withColumns({"_w1": _weight(weights, d), "_w2": _weight(weights, d, l), "_w3": _weight(weights, d, l, s), "_cap": F.col("tokens") * max_epochs})
    tree = tree.where("_w1 > 0 and _w2 > 0 and _w3 > 0")
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0] * int(budget_percent) // 100
    # the tree above its leaves: a row for each domain and language
    langs = cut(tree.groupBy(d, l, "_w1", "_w2").agg(F.sum("_cap").alias("_cap")))
    domains = langs.groupBy(d, F.col("_w1").alias("_weight")).agg(F.sum("_cap").alias("_cap")).withColumn("_root", F.lit(0))
    budget = F.least(F.lit(total).cast("long"), F.sum("_cap").over(Window.partitionBy("_root")))
    domains = share(domains.withColumn("_budget", budget), ["_root"], d)
    langs = share(langs.withColumnRenamed("_w2", "_weight").join(domains.select(d, F.col("_alloc").alias("_budget")), d), [d], l)
    ask = langs.select(d, l, F.col("_alloc").alias("_budget"))
    return share(tree.withColumnRenamed("_w3", "_weight").join(ask, [d, l]), [d, l], s).select(*LEVELS, "tokens", "_alloc")


def mix_to_weights(
    df: DataFrame,
    weights: dict[str, int],
    domain: Column,
    language: Column,
    origin: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_epochs: int = 3,
    budget_percent: int = 100,
    seed: int = 42,
) -> DataFrame:
    """The rows of ``df`` that a mixture takes, one row for each epoch that takes them.

    ``weights`` maps "domain", "domain/language", "domain/language/source" (or
    "*/language", "*/*/source" for any parent) to whole weights; nodes that are not named
    weigh 1, and weight 0 leaves a branch out. The budget is ``budget_percent``
    of all tokens (words); with weights that no branch can meet it is used up as
    far as ``max_epochs`` allows. Adds ``mix_tokens`` and ``mix_epoch``
    (from 0). Budgets are rounded down to whole tokens, prefixes to whole rows.
    Null domain, language or source make a branch named "". A null or empty text
    has 0 tokens and comes with the whole epochs of its leaf and with a prefix that
    reaches it; a leaf without tokens gives no rows. Repeated rows are rows of their
    own; those equal in id and text stand side by side in the order. An empty table gives no rows.
    Texts are counted whole. Input columns named like the added ones are replaced, all others come back as they are.
    """
    name = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    marked = {"_d": name(domain), "_l": name(language), "_s": name(origin)}
    rows = apart(df, _id=key, _tokens=word_count(F.col(text_col)), **marked)
    slim = cut(rows.select("_id", "_tokens", *marked))
    digits = bucket_digits(slim.count())
    leaves = cut(slim.groupBy(*[F.col(k).alias(v) for k, v in zip(marked, LEVELS)]).agg(F.sum("_tokens").alias("tokens")))
    asked = small_side(
        leaf_budgets(leaves, weights, max_epochs, budget_percent)
        .where("tokens > 0")
        .select(*[F.col(v).alias(k + "x") for k, v in zip(marked, LEVELS)], F.expr("_alloc div tokens").cast("int").alias("_full"), F.expr("_alloc % tokens").alias("_rest"))
    )
    on = [F.col(k) == F.col(k + "x") for k in marked]
    digest = F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("_full").cast("string"), F.col("_id")))

    # tokens of each digest bucket of the epoch that is cut, then the bucket that holds the cut
    sums = slim.join(asked, on).groupBy("_dx", "_lx", "_sx", "_rest", hex_bucket(digest, digits).alias("_bucket")).agg(F.sum("_tokens").alias("_n"))
    run = Window.partitionBy("_dx", "_lx", "_sx").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    cuts = (
        sums.withColumn("_base", F.coalesce(F.sum("_n").over(run), F.lit(0)))
        .where("_rest > 0 and _base <= _rest and _base + _n > _rest")
        .select(*[F.col(k + "x").alias(k + "y") for k in marked], F.col("_bucket").alias("_cut"), F.col("_base").alias("_base"))
    )
    bounds = small_side(asked.join(cuts, [F.col(k + "x") == F.col(k + "y") for k in marked], "left").drop(*[k + "y" for k in marked]))
    rows = rows.join(bounds, on).withColumn("_digest", digest)
    rows = rows.withColumn("_bucket", hex_bucket(F.col("_digest"), digits))
    whole = rows.withColumn("_epoch", F.explode(F.filter(F.sequence(F.lit(0), F.col("_full")), lambda e: (e < F.col("_full")) | (F.col("_bucket") < F.col("_cut")))))
    upto = Window.partitionBy("_dx", "_lx", "_sx").orderBy("_digest").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = rows.where("_bucket = _cut").withColumn("_sum", F.sum("_tokens").over(upto)).where("_base + _sum <= _rest").withColumn("_epoch", F.col("_full"))
    out = [*back(df.columns, ADDED), F.col("_tokens").alias("mix_tokens"), F.col("_epoch").cast("int").alias("mix_epoch")]
    return whole.select(*out).union(edge.select(*out))
