import math
import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from edges import EXTRA, components, empty, frame, rows, strangers, words
from pyspark.sql import functions as F

from tracewright.llm import similar, simhash, topk
from tracewright.llm.components import connected


def python_fingerprint(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    ws = words(low)
    grams = [" ".join(ws[k : k + 3]) for k in range(len(ws) - 2)] or ([" ".join(ws)] if ws else [])
    hs = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def test_fingerprints(spark):
    got = simhash.fingerprints(frame(spark)).collect()
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r[0], python_fingerprint(r[1])) for r in rows())


def test_fingerprint_is_the_engines_hash(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c"))).first()[0] % 2**64 == xxhash.xxh64_intdigest(b"a b c", 42)


@pytest.mark.parametrize("tile, own, other", [(16_384, 4096, 65_536), (8, 3, 8), (0, 2, 3)])
def test_classes(spark, monkeypatch, tile, own, other):
    monkeypatch.setattr(simhash, "TILE_ROWS", max(tile, 1))
    monkeypatch.setattr(simhash, "OWN_ROWS", own)
    monkeypatch.setattr(simhash, "OTHER_ROWS", other)
    got = simhash.near_classes(frame(spark), carry=("slot",)).collect()
    fps = {r.fp % 2**64 for r in got}
    label = components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= 3)
    least = {}
    for r in got:
        k = label[r.fp % 2**64]
        if r.doc_id is not None:
            least[k] = min(least.get(k, r.doc_id), r.doc_id)
    assert len(got) == len(rows()) and all(r.component_id == least.get(label[r.fp % 2**64]) for r in got)
    by = {r.doc_id: r.component_id for r in got}
    assert {by[100 + k] for k in range(12)} == {100} and by[300] == by[301] == by[302] == 300


@pytest.mark.parametrize("tile, radius", [(16_384, 3), (64, 3), (4, 3), (64, 1), (64, 6)])
def test_links_of_random_fingerprints(spark, monkeypatch, tile, radius):
    monkeypatch.setattr(simhash, "TILE_ROWS", tile)
    monkeypatch.setattr(simhash, "OWN_ROWS", 16)
    monkeypatch.setattr(simhash, "OTHER_ROWS", 64)
    r = random.Random(8)
    fps = set()
    for _ in range(40):
        centre = r.getrandbits(64)
        fps.add(centre)
        for _ in range(6):
            centre ^= sum(1 << b for b in r.sample(range(64), r.randint(1, 4)))
            fps.add(centre)
    fps |= {0, 2**64 - 1, 7, 2**64 - 8}
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in fps], "fp bigint")
    edges = simhash.links(df, radius).collect()
    got = components(sorted(fps), lambda a, b, s={(e.u % 2**64, e.v % 2**64) for e in edges}: (a, b) in s or (b, a) in s)
    assert got == components(sorted(fps), lambda a, b: (a ^ b).bit_count() <= radius)


def test_runs_of_a_key_give_a_forest():
    r = np.random.default_rng(3)
    fps = np.unique(np.concatenate([r.integers(0, 1 << 48, 300, dtype=np.uint64), np.array([1 << k for k in range(48)], dtype=np.uint64), np.array([0], dtype=np.uint64)]))
    u, v = simhash.run_links(np.zeros(len(fps), np.int64), fps)
    pairs = set(zip(u.tolist(), v.tolist()))
    want = components(fps.tolist(), lambda a, b: (a ^ b).bit_count() <= 3)
    assert components(fps.tolist(), lambda a, b: (a, b) in pairs or (b, a) in pairs) == want and len(u) <= 2 * len(fps)


def test_a_tile_returns_a_forest():
    near = np.array([1 << k for k in range(60)] + [0], dtype=np.uint64)  # all within 2 bits
    u, v = simhash.tile_links(near, near)
    assert len(u) == 60 and len(v) == 60


def test_keep_one(spark):
    kept = simhash.keep_one(frame(spark))
    assert kept.columns == frame(spark).columns and all(x == EXTRA for x in strangers(kept))
    carried = simhash.near_classes(frame(spark), carry=tuple(frame(spark).columns))
    assert carried.columns == [*(c for c in frame(spark).columns if c not in ("fp", "component_id")), "fp", "component_id"]
    got = Counter(r.doc_id for r in kept.collect())
    classes = simhash.near_classes(frame(spark)).collect()
    assert len(list(got.elements())) == len({(r.component_id, None if r.component_id is not None else r.fp) for r in classes})
    assert got[100] == 1 and got[101] == 0 and got[306] == 1 and got[0] == 1
    assert simhash.keep_one(empty(spark)).count() == 0 and simhash.near_classes(empty(spark)).count() == 0


def test_components(spark):
    r = random.Random(9)
    pairs = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(1000 + k, 1001 + k) for k in range(60)] + [(5, 5)]
    got = {x.node: x.root for x in connected(spark.createDataFrame(pairs, "u bigint, v bigint")).collect()}
    nodes = sorted({x for a, b in pairs if a != b for x in (a, b)})
    want = components(nodes, lambda a, b, s=set(pairs): (a, b) in s or (b, a) in s)
    assert got == want


# --- top-k ---------------------------------------------------------------------------

VECTOR = "vec_id bigint, embedding array<float>, score string, rank string"


def python_topk(data, k, scale=64):
    """Every row is a candidate, whatever ids it shares; every row of a query's id is a query."""
    ok = []
    for i, v, *_ in data:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            ok.append((i, [math.floor(float(np.float32(x)) * scale) for x in v]))
    out = []
    for n, (q, v) in enumerate(ok):
        if q % 20 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), c) for m, (c, w) in enumerate(ok) if m != n)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("blocks", [(2048, 8192), (3, 10)])
@pytest.mark.parametrize("dense", [0.0, 0.25, 1.1])
def test_topk(spark, monkeypatch, blocks, dense):
    monkeypatch.setattr(topk, "QUERY_ROWS", blocks[0])
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", blocks[1])
    monkeypatch.setattr(topk, "DENSE", dense)
    r = random.Random(10)
    data = [(k, [r.choice((0.0, 0.0, r.uniform(-1, 1))) for _ in range(6)], "x", "y") for k in range(120)]
    data += [(200 + k, data[3][1], "x", "y") for k in range(30)]  # ties
    data += [(300, None, "x", "y"), (320, [1.0, None], "x", "y"), (340, [float("nan")] * 6, "x", "y"), (360, [float("inf")] * 6, "x", "y"), (None, [1.0] * 6, "x", "y"), (380, [], "x", "y"), (400, [0.5, 0.5], "x", "y"), (400, [0.5, 0.5], "x", "y"), (20, [0.9] * 6, "x", "y")]
    df = spark.createDataFrame(data, VECTOR).repartition(3)
    got = sorted((x.query_id, x.rank, x.vec_id, x.score) for x in topk.exact_topk(df, F.col("vec_id") % 20 == 0, k=7).collect())
    assert got == python_topk(data, 7)


def test_topk_small(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (1, [2.0], "", "")], VECTOR)
    assert [tuple(x) for x in topk.exact_topk(df, F.col("vec_id") % 20 == 0).collect()] == [(0, 1, 1, 64 * 128)]
    assert topk.exact_topk(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    big = spark.createDataFrame([(0, [3e4] * 3, "", ""), (1, [-3e4] * 3, "", "")], VECTOR)
    assert topk.exact_topk(big, F.col("vec_id") % 20 == 0).first().score == -3 * (30_000 * 64) ** 2


def test_topk_of_repeated_ids(spark):
    df = spark.createDataFrame([(0, [1.0], "", ""), (1, [2.0], "", ""), (1, [3.0], "", ""), (2, [0.5], "", "")], VECTOR)
    assert sorted(tuple(x) for x in topk.exact_topk(df, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 1, 64 * 192), (0, 2, 1, 64 * 128), (0, 3, 2, 64 * 32)]
    twice = spark.createDataFrame([(0, [1.0], "", ""), (0, [2.0], "", "")], VECTOR)
    assert sorted(tuple(x) for x in topk.exact_topk(twice, F.col("vec_id") % 20 == 0).collect()) == [(0, 1, 0, 64 * 128)] * 2


def test_topk_of_large_scores(spark):
    # products near the end of a long
    vectors = {0: [2.0**31], 1: [2.0**31], 2: [2.0**30], 3: [100.0], 4: [-(2.0**31)]}
    df = spark.createDataFrame([(k, v) for k, v in vectors.items()], "vec_id bigint, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.exact_topk(df, F.col("vec_id") == 0, k=3, scale=1).orderBy("rank").collect()]
    assert got == [(1, 2**62), (2, 2**61), (3, 100 * 2**31)]


# --- similarity of shingles ----------------------------------------------------------


def near_texts(seed=5):
    """Groups of copies with ever more words changed, so that some are similar to few others of their group only."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    texts = []
    for n, copies, most in ((60, 60, 8), (200, 30, 20), (30, 20, 3), (400, 3, 60)):
        body = [word() for _ in range(n)]
        for _ in range(copies):
            copy = list(body)
            for at in r.sample(range(n), r.randint(0, most)):
                copy[at] = word()
            texts.append(" ".join(copy))
    return texts + [" ".join(word() for _ in range(40)) for _ in range(30)] + ["", "one two", "one two", "One  two\n"]


@pytest.mark.parametrize("ask, told", [(250_000, 500_000), (300, 900)])
def test_similar_classes(spark, monkeypatch, ask, told):
    monkeypatch.setattr(similar, "ASK_SHINGLES", ask)
    monkeypatch.setattr(similar, "TOLD_SHINGLES", told)
    texts = near_texts()
    grams = [{tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set() for ws in (words(t.lower()) for t in texts)]
    like = lambda a, b: grams[a] == grams[b] or (bool(grams[a] | grams[b]) and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8)
    want = components(range(len(texts)), like)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in similar.similar_classes(df).collect()}
    assert got == want and len(set(want.values())) > 40
    kept = sorted(r.doc_id for r in simhash.keep_one(df, shingle=5, similarity=0.8).collect())
    assert kept == sorted(set(want.values()))


def test_similar_classes_edges(spark):
    out = similar.similar_classes(frame(spark), carry=tuple(frame(spark).columns))
    assert out.columns == [*(c for c in frame(spark).columns if c not in ("fp", "component_id")), "fp", "component_id"]
    by = {r.doc_id: r.component_id for r in out.collect()}
    assert {by[100 + k] for k in range(12)} == {100} and by[300] == by[301] == by[302] == 300 and by[306] == 306
    assert similar.similar_classes(empty(spark)).count() == 0 and simhash.keep_one(empty(spark), shingle=5, similarity=0.8).count() == 0


def python_votes(found, words):
    """Majorities of the votes, a shingle at a time."""
    mask, out = 2**64 - 1, []
    offsets = [int(x) for x in similar._offsets(similar.VOTES * words)]
    hashes = []
    for x in found:
        own = []
        for o in offsets:
            h = int(x) ^ o
            h = (h ^ h >> 30) * 0xBF58476D1CE4E5B9 & mask
            h = (h ^ h >> 27) * 0x94D049BB133111EB & mask
            own.append(h ^ h >> 31)
        hashes.append(own)
    for w in range(words):
        for b in range(64):
            votes = [h[v * words + w] >> b & 1 for h in hashes for v in range(similar.VOTES)]
            out.append(int(2 * sum(votes) > len(votes)))
    return out


@pytest.mark.parametrize("n", [1, 4, 300])
def test_simhash_of_shingles(n):
    found = np.random.default_rng(n).integers(0, 1 << 64, n, dtype=np.uint64)
    assert similar.simhash_bits(found, 2).tolist() == python_votes(found, 2)


@pytest.mark.parametrize("n, m, both", [(4, 5, 4), (9, 9, 8), (13, 14, 12), (90, 90, 80), (400, 500, 400)])
def test_sets_at_the_similarity_are_candidates(n, m, both):
    assert both / (n + m - both) >= 0.8
    r, far, met = np.random.default_rng(n), [], 0
    bands, width = similar.layout(200_000)
    for _ in range(300):
        every = r.integers(0, 1 << 64, n + m - both, dtype=np.uint64)
        a, b = (similar.fingerprint(x, bands, width) for x in (every[:n], every[n - both :]))
        far.append(int(np.bitwise_count((a[0] ^ b[0]).view(np.uint64)).sum()))
        met += bool(set(a[1].tolist()) & set(b[1].tolist()))
    assert met == 300 and max(far) <= similar.radius() and np.mean(far) / (64 * similar.WORDS) < similar.differing() + 0.01


@pytest.mark.parametrize("tile, own, other", [(16_384, 4096, 65_536), (6, 3, 5)])
def test_similar_classes_by_bands(spark, monkeypatch, tile, own, other):
    for name, value in (("BUCKET_ROWS", 8), ("TILE_ROWS", tile), ("OWN_ROWS", own), ("OTHER_ROWS", other)):
        monkeypatch.setattr(similar, name, value)
    texts = near_texts(6)
    assert similar.layout(len(texts))[0] > 10
    grams = [{tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set() for ws in (words(t.lower()) for t in texts)]
    like = lambda a, b: grams[a] == grams[b] or (bool(grams[a] | grams[b]) and len(grams[a] & grams[b]) / len(grams[a] | grams[b]) >= 0.8)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(4)
    assert {r.doc_id: r.component_id for r in similar.similar_classes(df).collect()} == components(range(len(texts)), like)


def test_candidates_come_from_simhash(spark, monkeypatch):
    df = spark.createDataFrame([(0, "a b c d e f g h i j k l"), (1, "a b c d e f g h i j k l m"), (2, "n o p q r s t")], "doc_id bigint, text string")
    assert {r.doc_id: r.component_id for r in similar.similar_classes(df).collect()} == {0: 0, 1: 0, 2: 2}
    monkeypatch.setattr(similar, "radius", lambda similarity: -1)
    assert {r.doc_id: r.component_id for r in similar.similar_classes(df).collect()} == {0: 0, 1: 1, 2: 2}
