"""SimHash near-duplicates by exact comparison in tiles.

Equal fingerprints are one node. Nodes are compared in full, by numpy's exclusive-or and bit
counts, in tiles. Two bounds that lose no link say which tiles meet at all:

* Fingerprints within ``radius`` bits are equal in one of ``radius + 1`` pieces, so a tile
  holds nodes with an equal piece (a key). A node is in ``radius + 1`` tiles, whatever the
  number of nodes: the shuffle is linear.
* Their population counts differ by ``radius`` at most. Within a key nodes stand in order of their counts, and a
  comparison ends where the counts are farther apart.

Small keys share a tile, so that a tile has some ``TILE_ROWS`` nodes. A key with more of them
(near copies in great number, or more than some 1e9 nodes in all) is cut into cells by population count, and
cells into tiles: a cell's own nodes against its nodes and those of the cells above it within the radius; no
task gathers a large key.

A tile returns the links that a union-find still needs, not all pairs, and
:func:`tracewright.llm.components.connected` joins them up.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import apart, back, cut, ddl, held, quoted, small_side
from tracewright.llm.components import classes_of, connected
from tracewright.llm.similar import similar_classes

SHINGLE, SEED, RADIUS = 3, 42, 3
ADDED = ("fp", "component_id")
#: Nodes of a tile of whole keys, and of one of a larger key: own, and those they are compared with.
TILE_ROWS = 16_384
OWN_ROWS, OTHER_ROWS = 4096, 65_536
#: Comparisons made at once.
BLOCK = 1 << 19


def fingerprint(text: str | None) -> int:
    """The 64-bit fingerprint of the word shingles of a whole text; 0 if it has no word."""
    words = (text or "").encode().lower().split()  # bytes: A-Z alone change, and the six ASCII spaces split
    if not words:
        return 0
    digest, ones, total = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64), max(1, len(words) - SHINGLE + 1)
    for k in range(0, total, 4096):  # a long text's shingles never stand side by side
        part = words[k : k + 4096 + SHINGLE - 1]
        shingles = [b" ".join(part)] if len(words) < SHINGLE else [b"%b %b %b" % t for t in zip(part, part[1:], part[2:])]
        hashes = np.array([digest(s, SEED) for s in shingles], dtype="<u8")
        ones += np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > total, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns in ``carry`` and ``fp`` (the fingerprint as a signed long; a column of that name isn't carried) of every row."""
    names = list(dict.fromkeys((id_col, *(c for c in carry if c.lower() not in ADDED))))
    rows = df.select(*[quoted(c) for c in names], F.col(text_col)).toDF(*[f"in_{k}" for k in range(len(names))], "_text")
    schema = ", ".join([*[f"in_{k} {ddl(df, c)}" for k, c in enumerate(names)], "_fp bigint"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held("simhash", object)
        for batch in batches:
            marks = np.array([fingerprint(x.as_py()) for x in batch.column(len(names))], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(marks)], names=[*[f"in_{k}" for k in range(len(names))], "_fp"])

    return rows.mapInArrow(run, schema).select(*back(names), F.col("_fp").alias("fp"))


def tile_links(own: np.ndarray, other: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what fingerprints of ``own`` within ``radius`` of ones of ``other`` connect: a spanning forest of (u, v)."""
    every, at = np.unique(np.concatenate((own, other)), return_inverse=True)
    mine, theirs = at[: len(own)], at[len(own) :]
    parent = np.arange(len(every))
    us, vs = [], []
    step = max(1, BLOCK // max(1, len(other)))
    for k in range(0, len(own), step):
        near = np.bitwise_count(own[k : k + step, None] ^ other[None, :]) <= radius
        for i in np.flatnonzero(near.any(axis=1)):
            roots = np.append(theirs[near[i]], mine[k + i])
            while True:
                up = parent[roots]
                if (up == roots).all():
                    break
                roots = parent[up]
            roots = np.unique(roots)
            if len(roots) > 1:
                parent[roots] = roots[0]
                us.append(roots[1:])
                vs.append(np.full(len(roots) - 1, roots[0]))
    if not us:
        return np.empty(0, own.dtype), np.empty(0, own.dtype)
    return every[np.concatenate(us)], every[np.concatenate(vs)]


def run_links(keys: np.ndarray, fps: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what fingerprints with equal keys within ``radius`` of each other connect."""
    order = np.lexsort((np.bitwise_count(fps), keys))
    keys, fps = keys[order], fps[order]
    ones, root, at = np.bitwise_count(fps).astype(np.int64), np.arange(len(fps)), np.arange(len(fps))
    us, vs = [np.empty(0, fps.dtype)], [np.empty(0, fps.dtype)]
    for step in range(1, len(fps)):
        at = at[at < len(fps) - step]
        at = at[(keys[at + step] == keys[at]) & (ones[at + step] - ones[at] <= radius)]
        if not len(at):
            break
        near = at[np.bitwise_count(fps[at] ^ fps[at + step]) <= radius]
        near = near[root[near] != root[near + step]]
        if len(near):
            us.append(fps[near])
            vs.append(fps[near + step])
            while (root[near] != root[near + step]).any():
                a, b = root[near], root[near + step]
                np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
                while (root[root] != root).any():
                    root = root[root]
    return np.concatenate(us), np.concatenate(vs)


def pieces(radius: int) -> list[tuple[int, int]]:
    """(first bit, bits) of ``radius + 1`` pieces of a fingerprint."""
    edges = [64 * k // (radius + 1) for k in range(radius + 2)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v) over distinct fingerprints ``fp``, enough to connect all within ``radius`` (below 64) of each other."""
    if radius < 1:  # distinct fingerprints
        return nodes.where(F.lit(False)).select(F.col("fp").alias("u"), F.col("fp").alias("v"))
    piece = lambda a, n: F.shiftrightunsigned("fp", a).bitwiseAND(F.lit((1 << n) - 1).cast("long"))
    keys = [piece(a, n) * (radius + 1) + k for k, (a, n) in enumerate(pieces(radius))]
    placed = nodes.select("fp", F.explode(F.array(*keys)).alias("key"))
    large = cut(placed.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > TILE_ROWS).select("key"))
    n_large = large.count()

    def by_key(table: pa.Table) -> pa.Table:
        u, v = run_links(table.column("key").to_numpy(), table.column("fp").to_numpy().view(np.uint64), radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    tiles = max(1, -(-nodes.count() * (radius + 1) // TILE_ROWS))
    rest = placed.join(small_side(large), "key", "left_anti") if n_large else placed
    out = rest.groupBy(F.pmod(F.xxhash64("key"), F.lit(tiles)).alias("tile")).applyInArrow(by_key, "u bigint, v bigint")
    return out.union(_large_links(placed.join(small_side(large), "key", "left_semi"), radius)) if n_large else out


def _large_links(placed: DataFrame, radius: int) -> DataFrame:
    """:func:`links` of the keys with more nodes than a tile."""
    placed = placed.withColumn("ones", F.bit_count("fp"))
    near = lambda: F.explode(F.sequence(F.greatest(F.col("ones") - radius, F.lit(0)), F.col("ones"))).alias("ones")
    # a row for each cell, with the tiles that its own nodes and those they meet fill
    cells = cut(placed.groupBy("key", "ones").agg(F.count("*").alias("n")))
    met = cells.select("key", "n", near()).groupBy("key", "ones").agg(F.sum("n").alias("met"))
    cells = small_side(cells.join(met, ["key", "ones"]).select("key", "ones", F.ceil(F.col("n") / OWN_ROWS).cast("int").alias("own"), F.ceil(F.col("met") / OTHER_ROWS).cast("int").alias("others")))
    dealt = lambda c: F.pmod(F.xxhash64("fp"), F.col(c)).cast("int")
    tiles = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    mine = placed.join(cells, ["key", "ones"]).select("key", "ones", dealt("own").alias("i"), tiles("others").alias("j"), "fp", F.lit(True).alias("mine"))
    theirs = placed.select("fp", "key", near()).join(cells, ["key", "ones"]).select("key", "ones", tiles("own").alias("i"), dealt("others").alias("j"), "fp", F.lit(False).alias("mine"))

    def compare(table: pa.Table) -> pa.Table:
        fps = table.column("fp").to_numpy().view(np.uint64)
        own = table.column("mine").to_numpy()
        u, v = tile_links(fps[own], fps[~own], radius)
        return pa.table({"u": u.view(np.int64), "v": v.view(np.int64)})

    return mine.union(theirs).groupBy("key", "ones", "i", "j").applyInArrow(compare, "u bigint, v bigint")


def near_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, ``carry``, ``fp`` and ``component_id`` (the least id reachable over links) of every row.

    Texts are compared whole. A null text counts as empty; texts without a word have
    fingerprint 0 and are linked like any other. Repeated rows are in one class. Null ids
    are passed over for ``component_id``, which is null where a class has no other. Columns named fp or
    component_id aren't carried, other columns are ignored; an empty table gives no rows.
    """
    names = list(dict.fromkeys((id_col, *(c for c in carry if c.lower() not in ADDED))))
    marked = cut(fingerprints(df, id_col, text_col, tuple(names)).toDF(*[f"in_{k}" for k in range(len(names))], "fp"))
    nodes = cut(marked.groupBy("fp").agg(F.min("in_0").alias("least")))
    return classes_of(marked, nodes, connected(links(nodes, radius))).select(*back(names), "fp", "component_id")


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int | None = None, similarity: float | None = None) -> DataFrame:
    """One row of each class, whole, with all columns of ``df``: that with the least id, and of repeated ids that with the least text digest.

    With ``shingle`` and ``similarity`` the classes are those of exact similarity of word shingles, with candidates by wider fingerprints, else those of fingerprints within ``radius``.
    Null texts count as empty, null ids come last, of equal rows one stays, an empty table gives no rows.

    Rows are told by (id, text digest). Only the keys that go, and those that several rows share, meet
    the table again; while they are few enough to broadcast, the texts aren't shuffled.
    """
    rows = apart(df, _id=F.col(id_col), _text=F.col(text_col), _digest=F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    if similarity is None:
        classes = near_classes(rows, "_id", "_text", radius, carry=("_digest",))
    else:
        classes = similar_classes(rows, "_id", "_text", shingle, similarity, carry=("_digest",))
    # a class is named by its least id, or, where all its ids are null, by its least fingerprint
    name = (F.col("component_id").alias("_c"), F.when(F.col("component_id").isNull(), F.col("fp")).alias("_f"))
    keys = cut(classes.groupBy(F.col("_id").alias("_i"), F.col("_digest").alias("_d"), *name).agg(F.count("*").alias("_n")))
    order = F.struct(F.col("_i").isNull(), F.col("_i").alias("id"), F.col("_d").alias("d"))
    best = keys.groupBy("_c", "_f").agg(F.min(order).alias("_best"))
    same = lambda a, b: F.col(a).eqNullSafe(F.col(b))
    chosen = same("_i", "_best.id") & same("_d", "_best.d")
    judged = keys.join(best.select(F.col("_c").alias("_c2"), F.col("_f").alias("_f2"), "_best"), same("_c", "_c2") & same("_f", "_f2"))
    marks = small_side(judged.where(~chosen | (F.col("_n") > 1)).select("_i", "_d", chosen.alias("_stays")))
    rows = rows.join(marks, same("_id", "_i") & same("_digest", "_d"), "left")
    return rows.where("_stays is null").select(*back(df.columns)).union(rows.where("_stays").dropDuplicates(["_id", "_digest"]).select(*back(df.columns)))
