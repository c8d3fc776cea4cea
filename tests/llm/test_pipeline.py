"""Each stage of the pipeline against plain Python, on its own input."""

import re
from collections import Counter

import corpus_pipeline
import public_tokenizers as P
import pytest
from edges import empty, frame, rows, sha, words
from test_native import python_line_dedup, python_mix
from test_rules_and_scans import python_measures

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("sf")
    frame(spark).select(*COLUMNS).write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_stages_return_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "simhash_near_dedup", "mixing", "bpe"]


def test_quality_keeps_clean_documents(spark, folder):
    kept = {r.doc_id for r in corpus_pipeline.quality(spark, frame(spark).select(*COLUMNS), folder).collect()}
    assert set(range(60)) <= kept and not kept & {300, 301, 302, 304, 309}


def python_rejected(text):
    """The rules of the policy, straight from their definitions."""
    n, chars, symbols, dup, repeated, lines, bare, upper = python_measures(text)
    each = [x for x in (text or "").split("\n") if words(x)]
    ends = sum(x.rstrip(" \t\r\x0b\x0c").endswith(("...", "…")) for x in each)
    bullets = sum(x.lstrip(" \t\r\x0b\x0c").startswith(("-", "*", "•")) for x in each)
    tests = (n < 10, 100 * repeated > 20 * n, 10 * symbols > n, chars < 3 * n, chars > 12 * n, 10 * dup > 3 * lines, 10 * bare > 2 * n, 10 * upper > 4 * chars, 10 * ends > 3 * lines, 10 * bullets > 9 * lines)
    return any(tests)


def test_quality_against_python(spark, folder):
    more = [(400, "- a b c d e f g h i j k\n* l m n o p q r s t u", "en", "src0", 1), (401, "ONE TWO THREE FOUR FIVE SIX SEVEN EIGHT NINE TEN ELEVEN", "en", "src0", 1), (402, "word " * 12 + "...\nmore words follow here and here", "en", "src0", 1), (403, "so many #### $$$$ %%%% signs in a text of ten words", "en", "src0", 1)]
    docs = frame(spark).select(*COLUMNS).union(spark.createDataFrame(more, frame(spark).select(*COLUMNS).schema))
    want = Counter((r.doc_id, r.text) for r in docs.collect() if not python_rejected(r.text))
    assert Counter((r.doc_id, r.text) for r in corpus_pipeline.quality(spark, docs, folder).collect()) == want


def test_line_dedup_against_python(spark, folder):
    data = [r for r in rows() if r[0] != 305]
    docs = frame(spark).where("doc_id is null or doc_id <> 305").select(*COLUMNS)
    got = corpus_pipeline.line_dedup(spark, docs, folder).collect()
    assert Counter((r.doc_id, r.text) for r in got) == Counter({(d, t): n for (d, t, *_), n in python_line_dedup(data, 0.05, 2, True).items()})
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in got)


def test_mixing_against_python(spark, folder):
    def domain(source):
        tail = re.search(r"([0-9]{1,9})$", source or "")
        n = int(tail[1]) if tail else None
        return "web" if n is not None and n < 10 else "books" if n is not None and n < 15 else "code"

    weights = {"web": 50, "books": 30, "code": 20, "*/en": 50, "*/de": 20, "*/fr": 15, "*/es": 15, "*/*/src0": 2}
    got = Counter(r.doc_id for r in corpus_pipeline.mixing(spark, frame(spark).select(*COLUMNS), folder).collect())
    want = python_mix([(r[0], r[1], r[2], r[3], domain(r[3])) for r in rows()], weights, 3, 100, path=lambda r: (r[4], r[2] or "", r[3] or ""))
    total = Counter()
    for (d, _), n in want.items():
        total[d] += n
    assert got == +total


def test_near_dedup(spark, folder):
    kept = Counter(r.doc_id for r in corpus_pipeline.near_dedup(spark, frame(spark).select(*COLUMNS), folder).collect())
    assert kept[100] == 1 and not any(kept[100 + k] for k in range(1, 12)) and all(kept[k] == 1 for k in range(60))


def test_near_dedup_keeps_one_of_texts_at_similarity(spark, folder):
    import random

    from edges import components

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(6))
    grams = lambda ws: {tuple(ws[k : k + 5]) for k in range(len(ws) - 4)} or {tuple(ws)}
    texts = []
    for n, changes in [(100, 1), (100, 2), (100, 3), (300, 3), (300, 5), (300, 8), (1000, 10), (1000, 25)] * 6:
        body = [word() for _ in range(n)]
        texts.append(body)
        for _ in range(3):
            copy = list(body)
            for at in r.sample(range(n), changes):
                copy[at] = word()
            texts.append(copy)
    sets = [grams(t) for t in texts]
    label = components(range(len(texts)), lambda a, b: a // 4 == b // 4 and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    docs = spark.createDataFrame([(k, " ".join(t), "en", "src0", len(" ".join(t))) for k, t in enumerate(texts)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = sorted(x.doc_id for x in corpus_pipeline.near_dedup(spark, docs, folder).collect())
    assert kept == sorted(set(label.values())) and len(kept) < len(texts)


def test_run(spark, folder):
    import tiktoken

    from tracewright.llm.bpe_fst import load_ranks

    real = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=load_ranks(open(P.path("byte_bpe_50k.tiktoken"), "rb").read()), special_tokens={})
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, folder).collect(), docs.schema)
    want = Counter((r.doc_id, sha(" ".join(map(str, real.encode_ordinary(r.text or ""))))) for r in docs.collect())
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.ids_sha256) for r in got) == want and all(len(r.ids) == r.n_tokens for r in got)
    assert all(r.n_chars == len(r.text) for r in docs.collect())


def test_stages_on_an_empty_table(spark, folder):
    docs = empty(spark).select(*COLUMNS)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
