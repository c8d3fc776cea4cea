"""What tokens cost: cache use, context carry, token units, model mix.

Billed rows are (session_id, seq, id, role, ts, input, output, cache_read,
cache_write, cost_usd, model, provider_message_id). Money and usage are null when not recorded, never 0.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _order() -> Window:
    return Window.partitionBy("session_id").orderBy("seq")


def _zero(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0))


@dataclass(frozen=True)
class CacheClasses:
    hit_ratio: float = 0.5
    cold_read: int = 100
    cold_input: int = 5000
    ttl_seconds: int = 300


def cache_classes(billed: DataFrame, config: CacheClasses = CacheClasses()) -> DataFrame:
    """Billed rows with gap_seconds, hit_ratio and cache_class, and ``churned``: its writes are never read later.

    One window order serves the gap, the first-billed flag and the reads that follow.
    """
    used = billed.where(_zero("input") + _zero("output") + _zero("cache_read") + _zero("cache_write") > 0)
    w = _order()
    total = _zero("cache_read") + _zero("cache_write") + _zero("input")
    later = w.rowsBetween(1, Window.unboundedFollowing)
    out = used.withColumns({
        "gap_seconds": F.unix_seconds(F.col("ts").cast("timestamp")) - F.unix_seconds(F.lag("ts").over(w).cast("timestamp")),
        "first_billed": F.row_number().over(w) == 1,
        "hit_ratio": F.try_divide(_zero("cache_read"), total),
        "churned": (_zero("cache_write") > 0) & ~F.coalesce(F.max(_zero("cache_read") > 0).over(later), F.lit(False)),
    })
    cold = (_zero("cache_read") < config.cold_read) & (_zero("input") >= config.cold_input)
    kind = (
        F.when(F.col("hit_ratio").isNull(), "unbilled")
        .when(F.col("hit_ratio") >= config.hit_ratio, "hit")
        .when(cold & F.col("first_billed"), "cold-start")
        .when(cold & (F.col("gap_seconds") > config.ttl_seconds), "cold-ttl")
        .when(cold, "cold-prefix")
        .otherwise("partial")
    )
    return out.withColumn("cache_class", kind)


def cache_economy(classed: DataFrame) -> DataFrame:
    """Per session: counts by class, aggregate hit ratio, churned write tokens, priced rows and the cost of cold ones."""
    kinds = ("hit", "partial", "cold-start", "cold-ttl", "cold-prefix", "unbilled")
    total = F.sum(_zero("cache_read") + _zero("cache_write") + _zero("input"))
    return classed.groupBy("session_id").agg(
        F.count("*").alias("billed_rows"),
        *[F.count_if(F.col("cache_class") == k).alias("n_" + k.replace("-", "_")) for k in kinds],
        F.round(F.try_divide(F.sum(_zero("cache_read")), total), 6).alias("hit_ratio"),
        F.coalesce(F.sum(F.when(F.col("churned"), F.col("cache_write"))), F.lit(0)).alias("churn_tokens"),
        F.count("cost_usd").alias("priced_rows"),
        F.round(F.sum(F.when(F.col("cache_class").startswith("cold"), F.col("cost_usd"))), 6).alias("cold_cost_usd"),
    )


CHARS_PER_TOKEN = 3.5


def carry(rows: DataFrame) -> DataFrame:
    """Result rows with tokens, turns_after and carry.

    ``rows`` are (session_id, seq, id, billed, compaction, text_length, tool): all rows of a
    session. turns_after counts billed rows after a result and before the next compaction or the end; it is a difference
    of prefix counts within compaction segments, so no result meets every later turn.
    """
    w = _order()
    marked = rows.withColumn("segment", F.coalesce(F.sum(F.col("compaction").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    inside = Window.partitionBy("session_id", "segment").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    out = marked.withColumn("turns_after", F.coalesce(F.sum(F.col("billed").cast("int")).over(inside), F.lit(0)))
    out = out.where("text_length is not null").withColumn("tokens", F.col("text_length") / CHARS_PER_TOKEN)
    return out.withColumn("carry", F.col("tokens") * F.col("turns_after"))


def context_economy(results: DataFrame, top: int = 8, high: float = 1e6, oversized: float = 4000) -> DataFrame:
    """Carry by session and tool: results, tokens, carry, flags, and whether it is among the ``top`` of the session."""
    by_tool = results.groupBy("session_id", F.coalesce("tool", F.lit("unknown")).alias("tool")).agg(
        F.count("*").alias("n_results"), F.round(F.sum("tokens"), 4).alias("tokens"), F.round(F.sum("carry"), 4).alias("carry"),
        F.count_if(F.col("carry") >= high).alias("n_high_carry"), F.count_if(F.col("tokens") >= oversized).alias("n_oversized"),
    )
    rank = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("carry"), "tool"))
    return by_tool.withColumn("rank", rank).where(F.col("rank") <= top)


def compaction_cycles(rows: DataFrame, results: DataFrame, late_turns: int = 5, late_carry: float = 1e6, often_rebuild: int = 50_000) -> DataFrame:
    """One row per compaction: billed turns spanned, peak carried tokens, carry an earlier flush would have avoided, rebuild tokens, and what that says of its timing.

    ``rows`` as for :func:`carry`, with cache_read, input and cache_write of billed rows.
    """
    w = _order()
    marked = rows.withColumn("segment", F.coalesce(F.sum(F.col("compaction").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rebuilt = F.when(F.col("billed"), _zero("input") + _zero("cache_write"))
    cycles = marked.groupBy("session_id", "segment").agg(
        F.max(F.when(F.col("compaction"), F.col("seq"))).alias("flush_seq"), F.count_if("billed").alias("turns_spanned"),
        F.coalesce(F.max(F.when(F.col("billed"), _zero("cache_read"))), F.lit(0)).alias("peak_carried"), F.min_by(rebuilt, F.when(F.col("billed"), F.col("seq"))).alias("_first"),
    )
    after = F.first("_first", ignorenulls=True).over(Window.partitionBy("session_id").orderBy("segment").rowsBetween(1, Window.unboundedFollowing))
    avoided = results.groupBy("session_id", "segment").agg(F.sum("carry").alias("_carry"))
    out = cycles.withColumn("rebuild_tokens", F.coalesce(after, F.lit(0))).where("flush_seq is not null").join(avoided, ["session_id", "segment"], "left").withColumn("carry_avoided", F.round(F.coalesce("_carry", F.lit(0.0))).cast("bigint"))
    return out.select(
        "session_id", "flush_seq", "turns_spanned", "peak_carried", "carry_avoided", "rebuild_tokens",
        ((F.col("turns_spanned") >= late_turns) & (F.col("carry_avoided") >= late_carry)).alias("fired_too_late"),
        ((F.col("rebuild_tokens") >= often_rebuild) & (F.col("peak_carried") <= F.col("rebuild_tokens"))).alias("fired_too_often"),
    )


@dataclass(frozen=True)
class UnitWeights:
    input: float = 1.0
    output: float = 15.0
    cache_read: float = 0.1
    cache_write: float = 1.25


def equivalents(w: UnitWeights = UnitWeights()) -> Column:
    return w.input * _zero("input") + w.output * _zero("output") + w.cache_read * _zero("cache_read") + w.cache_write * _zero("cache_write")


def distinct_calls(billed: DataFrame) -> DataFrame:
    """The first row of each provider call of a session; later rows of a call repeat its usage."""
    key = F.coalesce(F.col("provider_message_id").cast("string"), F.col("id").cast("string"))
    first = F.row_number().over(Window.partitionBy("session_id", "_call").orderBy("seq"))
    return billed.withColumn("_call", key).withColumn("_n", first).where("_n = 1").drop("_call", "_n")


def token_units(billed: DataFrame, weights: UnitWeights = UnitWeights(), by: tuple[str, ...] = ("session_id",)) -> DataFrame:
    """Calls, tokens and MITE (a million equivalents) of distinct calls, by ``by``."""
    return distinct_calls(billed).groupBy(*by).agg(
        F.count("*").alias("calls"),
        *[F.sum(_zero(c)).alias(c) for c in ("input", "output", "cache_read", "cache_write")],
        F.round(F.sum(equivalents(weights)) / 1e6, 9).alias("mite"),
    )


def request_segments(rows: DataFrame, weights: UnitWeights = UnitWeights()) -> DataFrame:
    """Distinct calls folded by request: a request starts at a user row; -1 holds the calls before the first.

    ``rows`` are all rows of the sessions, with ``role`` and usage; requests without calls are kept, the leading segment only with calls.
    Everything is partitioned by session, so the rows are shuffled once.
    """
    user, mine = F.col("role") == "user", F.col("role") == "assistant"
    call = F.coalesce(F.col("provider_message_id").cast("string"), F.col("id").cast("string"))
    first = F.row_number().over(Window.partitionBy("session_id", "_call").orderBy("seq")) == 1
    marked = rows.withColumn("ordinal", (F.sum(user.cast("int")).over(_order()) - 1).cast("int")).withColumn("_call", F.when(mine, call))
    marked = marked.withColumn("_counts", mine & first & (F.col("input").isNotNull() | F.col("output").isNotNull()))
    of_user = lambda c: F.max(F.when(user, F.col(c)))  # noqa: E731  a request has one user row
    of_calls = lambda c: F.when(F.col("_counts"), c)
    out = marked.groupBy("session_id", "ordinal").agg(
        of_user("id").alias("user_message_id"), F.coalesce(of_user("ts"), F.min(of_calls(F.col("ts")))).alias("started_at"), F.max(of_calls(F.col("ts"))).alias("ended_at"), F.count_if("_counts").alias("calls"),
        F.coalesce(F.round(F.sum(of_calls(equivalents(weights))) / 1e6, 9), F.lit(0.0)).alias("mite"), F.min_by("model", of_calls(F.col("seq"))).alias("model"),
    )
    return out.where("ordinal >= 0 or calls > 0")


def class_costs(segments: DataFrame, classes: DataFrame) -> DataFrame:
    """MITE and share by request class; a request in k classes gives each 1/k, one in none is "unclassified".

    ``classes`` are (user_message_id, class); names are trimmed, lower-cased, without closing punctuation. A request's classes are few.
    """
    name = F.regexp_replace(F.regexp_replace(F.lower(F.trim("class")), r"\s+", " "), r"[.:;]+$", "")
    named = classes.select("user_message_id", name.alias("class")).where("class <> ''").groupBy("user_message_id").agg(F.collect_set("class").alias("_classes"))
    given = F.coalesce("_classes", F.array(F.lit("unclassified")))
    joined = segments.where("calls > 0").join(named, "user_message_id", "left").select((F.col("mite") / F.size(given)).alias("mite"), F.explode(given).alias("class"))
    sums = joined.groupBy("class").agg(F.sum("mite").alias("mite"), F.count("*").alias("requests"))
    return sums.withColumns({"share": F.round(F.try_divide(F.col("mite"), F.sum("mite").over(Window.partitionBy())), 6), "mite": F.round("mite", 6)})


def model_mix(turns: DataFrame) -> DataFrame:
    """Rates by model of turns (model, cost_usd, corrected, friction, failures, stuck, route): per turn, or per priced turn for cost."""
    rate = lambda c: F.round(F.avg(c), 6)
    return turns.groupBy("model").agg(
        F.count("*").alias("turns"), F.count("cost_usd").alias("priced_turns"), F.round(F.avg("cost_usd"), 9).alias("cost_per_turn"),
        rate(F.col("corrected").cast("int")).alias("correction_rate"), rate("friction").alias("friction_rate"), rate("failures").alias("failure_rate"), rate(F.col("stuck").cast("int")).alias("stuck_rate"),
        F.count_if(F.col("route") == "downshift").alias("downshifts"), rate((F.col("route") == "escalate").cast("int")).alias("escalation_rate"),
    )


def dominated(mix: DataFrame, min_turns: int = 20) -> DataFrame:
    """(model, by): a cheaper model that is no worse on any rate. Models are few; the pairs are theirs, not the turns'."""
    eligible = mix.where((F.col("turns") >= min_turns) & (F.col("priced_turns") > 0))
    a, b = eligible.alias("a"), eligible.alias("b")
    worse = [F.col(f"b.{c}") <= F.col(f"a.{c}") for c in ("correction_rate", "friction_rate", "failure_rate", "stuck_rate")]
    cond = (F.col("b.cost_per_turn") < F.col("a.cost_per_turn"))
    for c in worse:
        cond = cond & c
    return a.join(b, cond).where("a.downshifts > 0").select(F.col("a.model").alias("model"), F.col("b.model").alias("by"))


def turn_costs(rows: DataFrame) -> DataFrame:
    """(session_id, user_id, cost_usd): what the assistant rows after each user row cost until the next one; null if none is priced."""
    marked = rows.withColumn("turn", F.sum((F.col("role") == "user").cast("int")).over(_order()))
    return marked.where("turn > 0").groupBy("session_id", "turn").agg(F.min_by(F.when(F.col("role") == "user", F.col("id")), "seq").alias("user_id"), F.round(F.sum(F.when(F.col("role") == "assistant", F.col("cost_usd"))), 8).alias("cost_usd")).drop("turn")
