import hashlib
import random

import public_tokenizers as P
import pytest
import tiktoken
from edges import empty, frame, rows, sha
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import bpe_fst, queries

RAW = open(P.path("byte_bpe_50k.tiktoken"), "rb").read()
REAL = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe_fst.load_ranks(RAW), special_tokens={})


@pytest.fixture(scope="module")
def pair():
    return bpe_fst.machines(RAW, P.PATTERN)


@settings(max_examples=400, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    encoder, decoder = bpe_fst.machines(RAW, P.PATTERN)
    text = text.encode("utf8", "ignore").decode()
    ids = encoder.encode(text).tolist()
    assert ids == REAL.encode_ordinary(text) and decoder.decode(ids) == text


@settings(max_examples=400, deadline=None)
@given(st.text(st.sampled_from("aeiouthsn'’rvm 1٣½\n\t\r\x0b\x1c\x85 　-=#é👍字"), max_size=80))
def test_awkward_text(text):
    encoder, _ = bpe_fst.machines(RAW, P.PATTERN)
    assert encoder.encode(text).tolist() == REAL.encode_ordinary(text)


def test_tokens_in_a_row(pair):
    r, tokens = random.Random(2), list(pair[0].tokens.values())
    for _ in range(3000):
        text = b"".join(r.choice(tokens) for _ in range(r.randint(1, 6))).decode("utf8", "ignore")
        assert pair[0].encode(text).tolist() == REAL.encode_ordinary(text)


def test_pairs_by_definition(pair):
    r, t = random.Random(3), pair[0]
    for _ in range(3000):
        a, b = r.randrange(50_256), r.randrange(50_256)
        assert t.may_follow(a, b) == (t.merged(t.tokens[a] + t.tokens[b]) == [t.tokens[a], t.tokens[b]])


def test_long_pieces(pair):
    for text in ("a" * 50_000, "=" * 20_001, " " * 9999 + "x", "ab" * 10_000, "\n" * 5000, "é" * 5000):
        assert pair[0].encode(text).tolist() == REAL.encode_ordinary(text)


def test_tables_start_anew(monkeypatch):
    monkeypatch.setattr(bpe_fst, "MOVE_LIMIT", 50)
    monkeypatch.setattr(bpe_fst, "WORD_LIMIT", 5)
    t = bpe_fst.Transducer(bpe_fst.load_ranks(RAW), P.PATTERN)
    for r in rows():
        assert t.encode((r[1] or "")[:3000]).tolist() == REAL.encode_ordinary((r[1] or "")[:3000])
    assert t.n_moves < 200 and len(t.words) <= 5


def test_small_vocabulary_with_dead_ends():
    ranks = {bytes([k]): k for k in range(256)} | {b"ab": 256, b"bc": 257, b"abc": 258, b"cd": 259, b"abcd": 260, b"bcd": 261}
    ours, real = bpe_fst.Transducer(ranks, P.PATTERN), tiktoken.Encoding("s", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(4)
    for _ in range(2000):
        text = "".join(r.choice("abcd") for _ in range(r.randint(1, 12)))
        assert ours.encode(text).tolist() == real.encode_ordinary(text)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.integers(0, 50_255), max_size=12))
def test_decoding_any_ids(ids):
    t, d = bpe_fst.machines(RAW, P.PATTERN)
    assert d.decode(ids) == b"".join(t.tokens[i] for i in ids).decode("utf8", "replace")
    assert "".join(d.stream(iter(ids))) == d.decode(ids)


def test_decoding_bytes():
    d = bpe_fst.Decoder({k: bytes([k]) for k in range(256)})
    r = random.Random(6)
    for _ in range(3000):
        data = bytes(r.choice((0x41, 0x80, 0xBF, 0xC0, 0xC3, 0xE0, 0xE2, 0xED, 0xA0, 0x9F, 0x90, 0xF0, 0xF4, 0x8F, 0xF5, 0xFF)) for _ in range(r.randint(0, 7)))
        assert d.decode(data) == data.decode("utf8", "replace")


def test_query(spark, tmp_path):
    frame(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_bpe_fst(spark, str(tmp_path)).collect()
    assert len(got) == len(rows())
    want = {}
    for r in rows():
        ids = REAL.encode_ordinary(r[1] or "")
        want[r[0], len(ids)] = (sha(" ".join(map(str, ids))), hashlib.sha256((r[1] or "").encode()).hexdigest())
    assert all(want[r.doc_id, r.n_tokens] == (r.ids_sha256, r.decoded_sha256) for r in got)


def test_operators_round_trip(spark, monkeypatch):
    path = P.path("byte_bpe_50k.tiktoken")
    ids = bpe_fst.encode(frame(spark), path, P.PATTERN, keep=("doc_id", "slot"))
    assert ids.columns == ["doc_id", "slot", "ids"]
    back = {r.doc_id: r.text for r in bpe_fst.decode(ids, path, P.PATTERN).collect()}
    assert all(back[r[0]] == (r[1] or "") for r in rows() if r[0] is not None)
    assert bpe_fst.encode(empty(spark), path, P.PATTERN).count() == 0
