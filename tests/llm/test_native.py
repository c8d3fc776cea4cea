import zlib
from collections import Counter, defaultdict

import pytest
from edges import EXTRA, LINE, empty, frame, rows, strangers, words
from pyspark.sql import functions as F

from tracewright.llm import feistel, line_dedup, mixing


# --- sharding ---------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 7, 40, 41, 100, 997])
def test_permutation(n):
    assert sorted(feistel.permute(x, n, 5) for x in range(n)) == list(range(n))


def test_permutation_depends_on_the_seed():
    assert [feistel.permute(x, 1000, 1) for x in range(20)] != [feistel.permute(x, 1000, 2) for x in range(20)]


def test_shards(spark):
    got = feistel.feistel_shards(frame(spark), shards=7).collect()
    assert len(got) == len(rows())
    want = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows())
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) == set(range(7)) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards_are_computable_and_stable(spark):
    import hashlib

    df = spark.range(500).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    got = {r.doc_id: (r.shard, r.slot) for r in feistel.feistel_shards(df, shards=40).collect()}
    order = sorted(range(500), key=lambda k: hashlib.md5(f"{k}:{zlib.crc32(b'x')}:17".encode()).hexdigest())
    assert got == {d: feistel.locate(k, 500) for k, d in enumerate(order)}
    assert got == {r.doc_id: (r.shard, r.slot) for r in feistel.feistel_shards(df.repartition(9), shards=40).collect()}


def test_shards_carry_any_column(spark):
    out = feistel.feistel_shards(frame(spark), shards=7, carry=tuple(frame(spark).columns))
    assert out.columns == ["doc_id", *(c for c in frame(spark).columns if c not in ("doc_id", "slot", "shard")), "size", "text_crc32", "shard", "slot"]
    left = {k: v for k, v in EXTRA.items() if k not in ("slot", "shard")}
    assert all({**x, "slot": 0, "shard": 0} == {**left, "slot": 0, "shard": 0} for x in strangers(out))
    # rows equal in id, size and checksum keep their places however the table is dealt
    df = spark.range(60).select(F.lit(1).alias("doc_id"), F.lit("x").alias("text"), F.col("id").alias("more"))
    place = lambda d: {r.more: (r.shard, r.slot) for r in feistel.feistel_shards(d, carry=("more",)).collect()}
    assert place(df) == place(df.repartition(7))


def test_shards_empty_and_single(spark):
    assert feistel.feistel_shards(empty(spark)).count() == 0
    one = feistel.feistel_shards(frame(spark).where("doc_id = 304")).collect()
    assert [(r.shard, r.slot) for r in one] == [(0, 0)]


def test_written_shards(spark, tmp_path):
    feistel.write_shards(frame(spark).select("doc_id", "text", "lang"), str(tmp_path / "s"), shards=4)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == len(rows()) and set(back.columns) == {"doc_id", "text", "lang", "size", "text_crc32", "shard", "slot"}


# --- line dedup ---------------------------------------------------------------


def python_line_dedup(data, ratio, least=1, one_per_text=False):
    """Straight from the definition: for each line of a page, the pages of its host that hold it over all pages of the host."""
    sites = defaultdict(list)
    for r in data:
        sites[r[3] or ""].append(r[1])
    out = []
    for r in data:
        pages = sites[r[3] or ""]
        pages = list(set(pages)) if one_per_text else pages
        lines = [] if r[1] is None else r[1].split("\n")
        stay = []
        for x in lines:
            holding = sum(p is not None and x in p.split("\n") for p in pages)
            if not words(x) or holding < least or holding / len(pages) <= ratio:
                stay.append(x)
        out.append((r[0], None if r[1] is None else "\n".join(stay), len(lines), len(lines) - len(stay)))
    return Counter(out)


@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
@pytest.mark.parametrize("ratio, least, once", [(0.3, 1, False), (0.0, 2, False), (0.05, 1, False), (0.05, 5, True), (0.1, 2, True)])
def test_line_dedup(spark, ratio, least, once, broadcast_rows):
    data = [r for r in rows() if r[0] != 305]
    got = line_dedup.drop_site_boilerplate(frame(spark).where("doc_id is null or doc_id <> 305"), max_ratio=ratio, min_pages=least, one_per_text=once, broadcast_rows=broadcast_rows)
    assert Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in got.collect()) == python_line_dedup(data, ratio, least, once)
    assert got.columns == [*frame(spark).columns, "n_lines", "n_dropped"] and all(x == EXTRA for x in strangers(got))


def test_copies_of_a_page_are_pages(spark):
    # 20 pages of a host with one line on all of them, in four distinct texts
    data = [(k, f"body {k % 4}\nfooter here", "en", "host") for k in range(20)]
    df = spark.createDataFrame(data, "doc_id bigint, text string, lang string, source string")
    got = line_dedup.drop_site_boilerplate(df, max_ratio=0.3).collect()
    assert {r.text for r in got} == {f"body {k}" for k in range(4)}
    once = line_dedup.drop_site_boilerplate(df, max_ratio=0.3, min_pages=5, one_per_text=True).collect()
    assert all(r.n_dropped == 0 for r in once)


def test_line_dedup_drops_the_line_alone(spark):
    got = {r.doc_id: r for r in line_dedup.drop_site_boilerplate(frame(spark), max_ratio=0.3).collect()}
    assert LINE not in got[1].text and got[1].n_dropped == 1 and got[0].n_dropped == 0
    assert line_dedup.drop_site_boilerplate(empty(spark)).count() == 0


# --- mixing -------------------------------------------------------------------


def water_fill(budget, children):
    """{name: tokens} for {name: (weight, capacity)}: raise the level until the budget is used."""
    out, open_ = {}, dict(children)
    left = min(budget, sum(c for _, c in children.values()))
    while open_:
        level = left / sum(w for w, _ in open_.values())
        full = {k: c for k, (w, c) in open_.items() if c <= level * w}
        if not full:
            return out | {k: int(level * w) for k, (w, _) in open_.items()}
        for k, c in full.items():
            out[k] = c
            left -= c
            del open_[k]
    return out


def python_budgets(leaves, weights, epochs, percent):
    weight = lambda *p: weights.get("/".join(p), weights.get("*/" * (len(p) - 1) + p[-1], 1))
    tree = {p: t * epochs for p, t in leaves.items() if all(weight(*p[: k + 1]) > 0 for k in range(3))}
    budget, out = sum(leaves.values()) * percent // 100, {}

    def down(prefix, budget):
        kids = sorted({p[len(prefix)] for p in tree if p[: len(prefix)] == prefix})
        for name, part in water_fill(budget, {k: (weight(*prefix, k), sum(c for p, c in tree.items() if p[: len(prefix) + 1] == (*prefix, k))) for k in kids}).items():
            if len(prefix) == 2:
                out[*prefix, name] = part
            else:
                down((*prefix, name), part)

    down((), budget)
    return out


@pytest.mark.parametrize("weights, epochs, percent", [({}, 3, 100), ({"src0": 9, "src1": 1, "*/de": 5, "*/*/a": 4}, 2, 80), ({"src0": 0, "src2": 100}, 2, 100), ({"src1": 7, "src1/de": 3}, 4, 300)])
def test_budgets(spark, weights, epochs, percent):
    leaves = {(s, lang, o): 10 + 7 * k for k, (s, lang, o) in enumerate((s, lang, o) for s in ("src0", "src1", "src2") for lang in ("de", "en") for o in "abc")}
    df = spark.createDataFrame([(*p, t) for p, t in leaves.items()], "domain string, language string, origin string, tokens bigint")
    got = {(r.domain, r.language, r.origin): r._alloc for r in mixing.leaf_budgets(df, weights, epochs, percent).collect()}
    want = python_budgets(leaves, weights, epochs, percent)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1 for k in want)


def mix(df, weights, **more):
    return mixing.mix_to_weights(df, weights, F.col("source"), F.col("lang"), F.lit("all"), **more)


def test_mix_takes_whole_epochs_then_a_prefix(spark):
    data = {r[0]: len(words(r[1])) for r in rows()}
    out = mix(frame(spark).where("source = 'src0'").dropDuplicates(["doc_id"]), {}, max_epochs=3, budget_percent=150).collect()
    again = mix(frame(spark).where("source = 'src0'").dropDuplicates(["doc_id"]).repartition(2), {}, max_epochs=3, budget_percent=150).collect()
    key = lambda rs: Counter((r.doc_id, r.mix_epoch) for r in rs)
    assert key(out) == key(again) and max(key(out).values()) == 1
    assert all(r.mix_tokens == data[r.doc_id] for r in out)
    total = sum(data[r[0]] for r in rows() if r[3] == "src0")
    taken = sum(r.mix_tokens for r in out)
    longest = max(data[r[0]] for r in rows() if r[3] == "src0")
    assert total * 1.5 - 2 * longest - 4 <= taken <= total * 1.5


def test_mix_meets_weights(spark):
    df = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a b c d e f g h i j").alias("text"), F.lit("en").alias("lang"), F.when(F.col("id") < 3000, "src0").otherwise("src1").alias("source"))
    out = {r.source: r.t for r in mix(df, {"src0": 1, "src1": 1}, budget_percent=50).groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect()}
    assert out == {"src0": 10_000, "src1": 10_000}
    out = {r.source: r.t for r in mix(df, {"src0": 1, "src1": 9}, max_epochs=2).groupBy("source").agg(F.sum("mix_tokens").alias("t")).collect()}
    assert out == {"src0": 20_000, "src1": 20_000}  # what src1 lacks goes to its sibling


def python_mix(data, weights, epochs, percent, seed=42, path=lambda r: (r[3] or "", r[2] or "", "all")):
    """Rows and epochs from the budgets of plain Python: whole epochs, then the prefix in the order of the digests."""
    import hashlib

    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    leaves = defaultdict(list)
    for r in data:
        leaves[path(r)].append((r[0], r[1] or "", len(words(r[1]))))
    tokens = {p: sum(t for *_, t in rs) for p, rs in leaves.items()}
    budgets, out = python_budgets(tokens, weights, epochs, percent), Counter()
    for p, rs in leaves.items():
        if not tokens[p] or p not in budgets:
            continue
        full, rest = divmod(budgets[p], tokens[p])
        out.update((d, e) for d, *_ in rs for e in range(full))
        total = 0
        for d, _, n in sorted(rs, key=lambda x: md5(f"{seed}:{full}:{'null' if x[0] is None else x[0]}:{md5(x[1])}")):
            total += n
            if rest and total <= rest:
                out[d, full] += 1
    return out


@pytest.mark.parametrize("weights, epochs, percent", [({"src0": 5, "src1": 2, "*/de": 3}, 2, 100), ({"src2": 10, "odd": 0}, 3, 60)])
def test_mix_against_python(spark, weights, epochs, percent):
    got = Counter((r.doc_id, r.mix_epoch) for r in mix(frame(spark), weights, max_epochs=epochs, budget_percent=percent).collect())
    assert got == python_mix(rows(), weights, epochs, percent)


def test_mix_edges(spark):
    assert mix(empty(spark), {}).count() == 0
    out = mix(frame(spark), {"src2": 0}, max_epochs=1, budget_percent=100)
    assert out.columns == [*(c for c in frame(spark).columns if c != "mix_epoch"), "mix_tokens", "mix_epoch"]
    assert all({**x, "mix_epoch": "o"} == EXTRA for x in strangers(out)) and {r.mix_tokens for r in out.where("doc_id = 0").collect()} == {30}
    assert Counter(r.doc_id for r in out.collect())[0] == 1 and out.where("source = 'src2'").count() == 0
