"""Near-duplicates: SimHash shows the candidates, exact shingle similarity confirms them.

A node is a set of word shingles; texts with equal sets are one node. Two nodes
are linked if the Jaccard similarity of their sets is ``similarity`` at least.

A fingerprint bit is the majority of the votes that the shingles' hashes cast on it, so two sets differ in a bit with
probability acos(cosine) / pi, and the cosine of sets of Jaccard similarity s is 2s / (1 + s) at least. 64 bits are too few to
tell such a pair from others by; a fingerprint has ``WORDS`` words that are compared, by exclusive-or and bit counts, within a
radius that such a pair exceeds with probability ``MISS``, and bands of further bits. Nodes with an equal band meet in a
tile. Bands are as wide as leaves some ``BUCKET_ROWS`` nodes to a bucket, and as many as leave such a pair without a common
one with probability ``MISS``. So their number grows as the nodes to the power 0.24 (for a similarity of 0.8).

A tile returns the links that a union-find still needs. What these connect is a group, and only nodes of a group can be
similar. First every node of a group is held against the least by their whole sets, so a large group of near copies costs a
comparison for each member. Only where the other nodes of a group are still of several classes are they compared across classes,
in tiles of a bounded number of shingles: the nodes outside the group's main class, one at a time, scatter their shingles'
postings into counts of what they have in common with all others. A tile returns links, not pairs. No pair of a group is passed
over, every link is right, and no group is gathered: it is counted by partial aggregation, and a large one is dealt over many tiles.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import back, cut, ddl, held, quoted, small_side
from tracewright.llm.components import classes_of, connected

ADDED = ("fp", "component_id")
SHINGLE, SIMILARITY, SEED = 5, 0.8, 42
#: The chance that a pair of just the similarity has no band in common, and that it differs in more bits than the radius.
MISS = 1e-7
#: Votes of a shingle on each bit. With two, small sets differ in no more bits than large ones (with one, 4 of 5 shingles do).
VOTES = 2
#: Words of a fingerprint that are compared; nodes that a bucket of a band is meant to hold.
WORDS, BUCKET_ROWS = 3, 2048
#: Nodes of a tile of whole buckets, and of one of a larger bucket: own, and those they are compared with.
TILE_ROWS = 16_384
OWN_ROWS, OTHER_ROWS = 4096, 65_536
#: Shingles whose votes are counted at once (a count fits a byte), and comparisons made at once.
BLOCK, PAIRS = 255, 1 << 18
#: Shingles of a tile: of the nodes that are compared, of those they are compared with.
ASK_SHINGLES, TOLD_SHINGLES = 250_000, 500_000


def differing(similarity: float = SIMILARITY) -> float:
    """The probability that sets of this similarity differ in a bit of their fingerprints, at most."""
    return math.acos(min(1.0, 2 * max(similarity, 0.0) / (1 + max(similarity, 0.0)))) / math.pi


def radius(similarity: float = SIMILARITY) -> int:
    """The least number of compared bits in more than which sets of this similarity differ with probability ``MISS`` at most."""
    n, p, seen = 64 * WORDS, differing(similarity), 0.0
    for k in range(n):
        seen += math.comb(n, k) * p**k * (1 - p) ** (n - k)
        if seen >= 1 - MISS:
            return k
    return n


def layout(rows: int, similarity: float = SIMILARITY) -> tuple[int, int]:
    """(number of bands, bits of each) for so many rows."""
    width, p = max(0, math.ceil(math.log2(max(rows, 1) / BUCKET_ROWS))), differing(similarity)
    return (1, width) if not width or not p else (math.ceil(math.log(MISS) / math.log1p(-((1 - p) ** width))), width)


def shingles(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a whole text's word shingles; a shorter text is one shingle, one without a word has none."""
    words = (text or "").encode().lower().split()  # as in simhash
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(b" ".join(words[k : k + width]), SEED) for k in range(max(1, len(words) - width + 1))], dtype=np.uint64))


@lru_cache(maxsize=2)
def _offsets(n: int) -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 64, n, dtype=np.uint64)


def simhash_bits(found: np.ndarray, words: int) -> np.ndarray:
    """The ``64 * words`` bits of a set of shingles, as bytes of 0 and 1: 1 if over half the votes on it are."""
    ones = np.zeros((VOTES, 64 * words), dtype=np.int64)
    for k in range(0, len(found), BLOCK):
        mixed = found[k : k + BLOCK, None] ^ _offsets(VOTES * words)
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            mixed ^= mixed >> np.uint64(shift)
            mixed *= np.uint64(factor)
        mixed ^= mixed >> np.uint64(31)
        ones += np.unpackbits(mixed.view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint8).reshape(ones.shape)
    return (2 * ones.sum(axis=0) > VOTES * len(found)).view(np.uint8)


def fingerprint(found: np.ndarray, n: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of a set of shingles that are compared, and a key for each of its ``n`` bands of ``width`` bits."""
    if not len(found):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bits = simhash_bits(found, WORDS + -(-n * width // 64))
    values = bits[64 * WORDS : 64 * WORDS + n * width].reshape(n, width) @ (1 << np.arange(width, dtype=np.int64))
    return np.packbits(bits[: 64 * WORDS], bitorder="little").view("<i8"), values * n + np.arange(n)


def _name(found: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(found.tobytes(), SEED)


def _marked(rows: DataFrame, shingle: int, n: int, width: int) -> DataFrame:
    """``rows``, whose last column is the text, with ``fp``, ``size``, ``bits`` and ``keys`` in the text's place."""
    names = rows.columns[:-1]
    schema = ", ".join([*[f"{c} {ddl(rows, c)}" for c in names], "fp bigint, size int, bits array<bigint>, keys array<bigint>"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("similar", object)
        for batch in batches:
            marks, sizes, bits, keys = [], [], [], []
            for x in batch.column(len(names)):
                found = shingles(x.as_py(), shingle)
                marks.append(_name(found))
                sizes.append(len(found))
                for out, part in zip((bits, keys), fingerprint(found, n, width)):
                    out.append(part)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(np.array(marks, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in (bits, keys))], names=[*names, "fp", "size", "bits", "keys"])

    return rows.mapInArrow(run, schema)


def _close(own: np.ndarray, other: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``own`` and ``other`` (a row of each word) of fingerprints that differ in ``most`` bits at most."""
    far = np.zeros((own.shape[1], other.shape[1]), dtype=np.uint8 if WORDS < 4 else np.uint16)
    for a, b in zip(own, other):
        far += np.bitwise_count(a[:, None] ^ b[None, :])
    return np.nonzero(far <= most)


def _unite(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Join the classes of ``a`` and ``b`` in ``root``, which has the least place of each place's class."""
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            return
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root[root] != root).any():
            root[:] = root[root]


def _tree(fps: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(root != np.arange(len(root)))
    return fps[at], fps[root[at]]


def run_links(keys: np.ndarray, fps: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) that connect what nodes with equal keys within ``most`` bits of each other connect; each names the least of its class."""
    order = np.lexsort((fps, keys))
    keys, fps, words = keys[order], fps[order], words[:, order]
    us, vs = [np.empty(0, fps.dtype)], [np.empty(0, fps.dtype)]
    edges = np.flatnonzero(np.diff(keys, prepend=keys[:1] - 1, append=keys[-1:] + 1)) if len(keys) else []
    for start, end in zip(edges, edges[1:]):
        root = np.arange(end - start)
        step = max(1, PAIRS // (end - start))
        for k in range(start, end, step):
            a, b = _close(words[:, k : min(k + step, end)], words[:, k:end], most)
            later = b > a
            _unite(root, a[later] + k - start, b[later] + k - start)
        u, v = _tree(fps[start:end], root)
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def tile_links(own: np.ndarray, fps: np.ndarray, words: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """:func:`run_links` of nodes marked ``own`` and those that aren't."""
    every, at = np.unique(fps, return_inverse=True)
    mine, theirs, root = np.flatnonzero(own), np.flatnonzero(~own), np.arange(len(every))
    step = max(1, PAIRS // max(1, len(theirs)))
    for k in range(0, len(mine), step):
        a, b = _close(words[:, mine[k : k + step]], words[:, theirs], most)
        _unite(root, at[mine[k + a]], at[theirs[b]])
    return _tree(every, root)


def _near(nodes: DataFrame, n: int, most: int) -> DataFrame:
    """Links (u, v) that connect the nodes (fp, bits, keys) that share one of their ``n`` bands and differ in ``most`` compared bits at most."""
    names = [f"w{k}" for k in range(WORDS)]
    placed = nodes.select("fp", *[F.col("bits")[k].alias(c) for k, c in enumerate(names)], F.explode("keys").alias("key"))
    large = cut(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE_ROWS))
    n_large = large.count()
    column = lambda table, c: table.column(c).to_numpy()
    words = lambda table: np.stack([column(table, c).view(np.uint64) for c in names])

    def by_key(table: pa.Table) -> pa.Table:
        held("similar", object)
        return pa.table(dict(zip("uv", run_links(column(table, "key"), column(table, "fp"), words(table), most))))

    def by_tile(table: pa.Table) -> pa.Table:
        held("similar", object)
        return pa.table(dict(zip("uv", tile_links(column(table, "mine"), column(table, "fp"), words(table), most))))

    tiles = max(1, -(-nodes.count() * n // TILE_ROWS))
    rest = placed.join(small_side(large.select("key")), "key", "left_anti") if n_large else placed
    out = rest.groupBy(F.pmod(F.xxhash64("key"), F.lit(tiles)).alias("tile")).applyInArrow(by_key, "u bigint, v bigint")
    if not n_large:
        return out
    tiles_of = lambda rows: F.ceil(F.col("n") / rows).cast("int")
    rows = placed.join(small_side(large.select("key", tiles_of(OWN_ROWS).alias("own"), tiles_of(OTHER_ROWS).alias("others"))), "key")
    dealt = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = rows.select("key", dealt("own").alias("i"), every("others").alias("j"), "fp", *names, F.lit(True).alias("mine"))
    theirs = rows.select("key", every("own").alias("i"), dealt("others").alias("j"), "fp", *names, F.lit(False).alias("mine"))
    return out.union(mine.union(theirs).groupBy("key", "i", "j").applyInArrow(by_tile, "u bigint, v bigint"))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """(fp, found) of texts, each node once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("similar", object)
        for batch in batches:
            found = [shingles(x.as_py(), width) for x in batch.column(0)]
            marks = np.array([_name(s) for s in found], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(marks), pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))], names=["fp", "found"])

    return texts.mapInArrow(run, "fp bigint, found array<bigint>").groupBy("fp").agg(F.first("found").alias("found"))


def _sizes_fit(a: Column, b: Column, similarity: float) -> Column:
    return F.least(a, b) / F.greatest(a, b) >= similarity


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (u, v) whose sets are similar."""
    a, b = (sets.select(F.col("fp").alias(c), F.col("found").alias(f"_{c}")) for c in "uv")
    both = F.size(F.array_intersect("_u", "_v"))
    whole = F.size("_u") + F.size("_v")
    return pairs.join(a, "u").join(b, "v").where(_sizes_fit(F.size("_u"), F.size("_v"), similarity) & (both / (whole - both) >= similarity)).select("u", "v")


def similar_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, similarity: float = SIMILARITY, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, ``fp`` (the node) and ``component_id`` (the least id reachable over links) of every row.

    Texts are compared whole. Null texts and texts without a word are one node. Repeated rows are in one class. Null ids are
    passed over for ``component_id``, which is null where a class has no other. Columns named fp or component_id aren't
    carried, other columns are ignored; an empty table gives no rows.
    """
    names = list(dict.fromkeys((id_col, *(c for c in carry if c.lower() not in ADDED))))
    digest = F.md5(F.coalesce(F.col(text_col), F.lit("")))
    own = [f"in_{k}" for k in range(len(names))]
    n, width = layout(df.count(), similarity)
    marked = cut(_marked(df.select(*[quoted(c) for c in names], digest, F.col(text_col)).toDF(*own, "_md5", "_text"), shingle, n, width))
    same = [F.any_value(c).alias(c) for c in ("size", "bits", "keys")]
    nodes = cut(marked.groupBy("fp").agg(F.min("in_0").alias("least"), F.min("_md5").alias("_md5"), *same))
    members = cut(connected(_near(nodes.where("size > 0"), n, radius(similarity))).select(F.col("node").alias("fp"), F.col("root").alias("key")))
    stars = members.where("fp <> key").select(F.col("key").alias("u"), F.col("fp").alias("v"))
    wanted = small_side(members.join(nodes, "fp").select("_md5"))
    texts = df.select(digest.alias("_md5"), F.col(text_col).alias("_text")).join(wanted, "_md5", "left_semi").select("_text")
    sets = cut(_sets(texts, shingle))
    first = cut(_fitting(stars, nodes, sets, similarity))
    # what is left of a group without the node that all were held against
    parts = members.where("fp <> key").join(connected(first), F.col("fp") == F.col("node"), "left").select("key", "fp", F.coalesce("root", "fp").alias("part"))
    across = _links_across(cut(parts.join(nodes.select("fp", "size"), "fp")), sets, similarity)
    return classes_of(marked.select(*own, "fp"), nodes.select("fp", "least"), connected(first.union(across))).select(*back(names), "fp", "component_id")


def _links_across(parts: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (u, v) that connect what similar nodes of a group in different parts connect; ``parts`` has key (the group), fp, part and size."""
    sums = parts.groupBy("key", "part").agg(F.count("*").alias("n"), F.sum("size").alias("s"))
    most = F.struct("n", "part")
    keys = sums.groupBy("key").agg(F.max_by("part", most).alias("main"), F.sum("s").alias("told"), (F.sum("s") - F.max_by("s", most)).alias("ask"), F.count("*").alias("parts")).where("parts > 1")
    tiles_of = lambda c, n: F.greatest(F.ceil(F.col(c) / n), F.lit(1)).cast("int")
    keys = small_side(keys.select("key", "main", "told", tiles_of("ask", ASK_SHINGLES).alias("own"), tiles_of("told", TOLD_SHINGLES).alias("others")))
    alone = (F.col("own") == 1) & (F.col("others") == 1)
    lots = max(1, -(-(keys.where(alone).agg(F.sum("told")).first()[0] or 0) // TOLD_SHINGLES))
    rows = parts.join(keys, "key").withColumn("ask", F.col("part") != F.col("main"))
    dealt = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    zero, node = F.lit(0), ("key", "fp", "part")
    small = rows.where(alone).select(F.pmod(F.xxhash64("key"), F.lit(lots)).alias("lot"), zero.alias("i"), zero.alias("j"), *node, "ask", F.lit(True).alias("told"))
    large = rows.where(~alone).withColumn("lot", F.col("key"))
    asks = large.where("ask").select("lot", (dealt("own") + 1).alias("i"), every("others").alias("j"), *node, F.lit(True).alias("ask"), F.lit(False).alias("told"))
    told = large.select("lot", F.explode(F.sequence(F.lit(1), F.col("own"))).alias("i"), dealt("others").alias("j"), *node, F.lit(False).alias("ask"), F.lit(True).alias("told"))

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, fp, part, ask, told = (table.column(c).to_numpy() for c in ("key", "fp", "part", "ask", "told"))
        found = table.column("found").combine_chunks()
        found = found.chunk(0) if isinstance(found, pa.ChunkedArray) else found
        values, ends = found.values.to_numpy().view(np.uint64), found.offsets.to_numpy()
        order = np.argsort(key, kind="stable")
        out: list[tuple[int, int]] = []
        for at in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
            asking, others = at[ask[at]], at[told[at]]
            take = lambda k: values[ends[k] : ends[k + 1]]
            for a, b in similar_across([take(k) for k in asking], [take(k) for k in others], part[asking], part[others], similarity):
                out.append((fp[asking[a]], fp[others[b]]))
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return small.union(asks).union(told).join(sets, "fp").groupBy("lot", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def similar_across(asking: list[np.ndarray], others: list[np.ndarray], parts: np.ndarray, other_parts: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """(place in ``asking``, place in ``others``) of similar sets in different parts, one for each two parts that are still apart."""
    if not asking or not others:
        return []
    sizes = np.array([len(x) for x in others])
    shingle, who = np.concatenate(others), np.repeat(np.arange(len(others)), sizes)
    order = np.argsort(shingle, kind="stable")
    shingle, who = shingle[order], who[order]
    names, codes = np.unique(np.concatenate((parts, other_parts)), return_inverse=True)
    root, mine, theirs, out = np.arange(len(names)), codes[: len(parts)], codes[len(parts) :], []
    for a, x in enumerate(asking):
        apart = (root[theirs] != root[mine[a]]) & (np.minimum(sizes, len(x)) >= similarity * np.maximum(sizes, len(x)))
        if not apart.any():
            continue
        lo = np.searchsorted(shingle, x, "left")
        n = np.searchsorted(shingle, x, "right") - lo
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(who[at], minlength=len(others))
        for b in np.flatnonzero(apart & (both / (sizes + len(x) - both) >= similarity)):
            r, t = root[mine[a]], root[theirs[b]]
            if r != t:
                root[root == max(r, t)] = min(r, t)
                out.append((a, b))
    return out


def _fitting(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """:func:`confirmed`, after the sizes alone have had their say, so that no set travels for a pair that they rule out."""
    a, b = (nodes.select(F.col("fp").alias(c), F.col("size").alias(f"n{c}")) for c in "uv")
    return confirmed(pairs.join(a, "u").join(b, "v").where(_sizes_fit(F.col("nu"), F.col("nv"), similarity)).select("u", "v"), sets, similarity)
