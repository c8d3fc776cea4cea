"""Byte-level BPE as a lazily determinised transducer, and its streaming decoder.

A token sequence is the BPE encoding of its bytes exactly when each neighbouring
pair is: merging the bytes of the two tokens alone gives the two tokens back.
That makes encoding a finite-state matter. The nondeterministic transducer's
states are (place in the trie of tokens, last token): a byte moves down the
trie, and where a token ends that may follow the last one, it may also be
emitted. :class:`Transducer` determinises this on demand: a state is the set of
live hypotheses with the tokens each has emitted beyond those all agree on; the
agreed tokens come out at once. A hypothesis lives no longer than the trie is
deep, which bounds the lookahead. A piece that is a token as a whole is that
token.

:class:`Decoder` is a transducer too: its states are the bytes of an unfinished
UTF-8 sequence, and a token moves from state to state and yields the text it
completes. Ill-formed input gives one U+FFFD for each maximal subpart.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import held

#: Moves kept of the determinised machine; beyond them it starts anew.
MOVE_LIMIT = 400_000
#: Encoded words kept in each of two generations; a word met again moves to the younger one.
WORD_LIMIT = 200_000
#: Places of the trie with so few tokens below are told apart by which of them are still open.
FEW = 40
#: Code points that a task holds in encoded form at once, beyond its input batch.
SLICE_CHARS = 1_000_000


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Tokens and ranks from the lines "base64 rank"."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines()) if a}


class Transducer:
    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pieces_of = ranks, regex.compile(pattern).findall
        self.tokens = {i: t for t, i in ranks.items()}
        self.child: dict[int, int] = {}
        self.token_at = [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.child:
                    self.child[key] = len(self.token_at)
                    self.token_at.append(-1)
                node = self.child[key]
            self.token_at[node] = rank
        self.below = self.few_below()
        self.code = "H" if max(ranks.values(), default=0) < 1 << 16 else "I"
        self.kind = np.dtype(self.code)
        self.spines: dict[int, tuple[list, list, bool]] = {}
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.forget()

    def few_below(self) -> dict[int, tuple[int, ...]]:
        """The tokens that end below a place of the trie, for places with ``FEW`` at most."""
        found: dict[int, tuple[int, ...]] = {}
        for key, node in reversed(self.child.items()):  # a place comes after those above it
            own = found.get(node, ())
            up = key >> 8
            if own is None or found.get(up, ()) is None:
                found[up] = None
                continue
            here = (self.token_at[node],) if self.token_at[node] >= 0 else ()
            joined = found.get(up, ()) + here + own
            found[up] = joined if len(joined) <= FEW else None
        return {k: v for k, v in found.items() if v is not None} | {k: () for k in self.child.values() if k not in found}

    def forget(self) -> None:
        """Start the determinised machine anew. A state is its row of moves; the start row has the start hypothesis."""
        self.index: dict[tuple, dict] = {}
        self.alike: dict[tuple, int] = {}
        self.n_moves = 0
        self.start = self.row((0, -1, 0))

    def row(self, hypotheses: tuple[int, ...]) -> dict:
        """The state of these hypotheses: for each its place in the trie (0: a token just ended), last token, and count and ids of tokens held back."""
        found = self.index.get(hypotheses)
        if found is None:
            found = self.index[hypotheses] = {-1: hypotheses}
        return found

    def merged(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merge the lowest-ranked neighbours until none can be, or ``down_to`` parts are left: the definition."""
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > down_to:
            rank, at = min((self.ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
            if rank == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def spine(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]], bool]:
        """The parts that stand at a token's left edge, and at its right edge, while it is merged, each with
        the rank of the merge that ends it; and whether the token is what its bytes merge to, in order of rank.
        """
        found = self.spines.get(token)
        if found is None:
            data = self.tokens[token]
            sides: tuple[list, list] = ([(data, 1 << 60)], [(data, 1 << 60)])
            sound = self.merged(data) == [data]
            for k, side in enumerate(sides):
                while sound and len(side[-1][0]) > 1:
                    whole = side[-1][0]
                    parts = self.merged(whole, 2)
                    sound = len(parts) == 2 and self.ranks[whole] < side[-1][1]
                    side.append((parts[0] if k == 0 else parts[-1], self.ranks[whole]))
            found = self.spines[token] = (sides[0][::-1], sides[1][::-1], sound)
        return found

    def may_follow(self, last: int, token: int) -> bool:
        """Whether the two tokens' bytes merge to the two tokens: no parts that meet at the border while both are merged merge first."""
        left, _, sound = self.spine(token)
        if not sound or last < 0:
            return sound
        _, right, _ = self.spine(last)
        get, i, j = self.ranks.get, 0, 0
        while True:
            (a, a_end), (b, b_end) = right[i], left[j]
            rank = get(a + b)
            if rank is not None and rank < a_end and rank <= b_end:
                return False
            if a_end <= b_end:
                if a_end == 1 << 60:
                    return True
                i += 1
            else:
                j += 1

    def build(self, row: dict, byte: int) -> tuple[dict, tuple[int, ...]]:
        """The determinised move from ``row`` on ``byte``: the next state and the tokens emitted."""
        live, child, token_at, below = [], self.child, self.token_at, self.below
        hypotheses, at = row[-1], 0
        while at < len(hypotheses):
            node, last, end = hypotheses[at], hypotheses[at + 1], at + 3 + hypotheses[at + 2]
            out = hypotheses[at + 3 : end]
            at = end
            down = child.get(node << 8 | byte)
            if down is not None:
                few = below.get(down)
                if few is None:
                    live.append((down, last, out))
                elif few:
                    # what matters of the last token is which tokens below may follow it; with none, the hypothesis is dead
                    open_ = tuple([t for t in few if self.may_follow(last, t)])
                    if open_:
                        live.append((down, self.alike.setdefault((down, open_), last), out))
                token = token_at[down]
                if token >= 0 and self.may_follow(last, token):
                    live.append((0, token, (*out, token)))
        first, agreed = live[0][2], 0
        shortest = min([len(x[2]) for x in live])
        while agreed < shortest and all([x[2][agreed] == first[agreed] for x in live]):
            agreed += 1
        flat: list[int] = []
        for node, last, out in live:
            flat += (node, last, len(out) - agreed, *out[agreed:])
        self.n_moves += 1
        move = row[byte] = (self.row(tuple(flat)), first[:agreed])
        return move

    def encode_piece(self, data: bytes) -> list[int]:
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        if self.n_moves >= MOVE_LIMIT:
            self.forget()
        row, ids, build = self.start, [], self.build
        for byte in data:
            row, emitted = row.get(byte) or build(row, byte)
            if emitted:
                ids += emitted
        hypotheses, at = row[-1], 0
        while hypotheses[at]:
            at += 3 + hypotheses[at + 2]
        ids += hypotheses[at + 3 : at + 3 + hypotheses[at + 2]]
        return ids

    def packed(self, ids: list[int]) -> bytes:
        return array(self.code, ids).tobytes()

    def encode_segment(self, text: str) -> bytes:
        found = self.pieces_of(text)
        if len(found) == 1:
            return self.packed(self.encode_piece(text.encode()))
        out = []
        for piece in found:
            word = piece[1:]
            if piece[0] == " " and word.isalpha():
                out.append(self.words.get(word) or self.encode_word(word))
            else:
                out.append(self.packed(self.encode_piece(piece.encode())))
        return b"".join(out)

    def encode_word(self, word: str) -> bytes:
        """The ids of " " + word, packed and remembered."""
        ids = self.older.get(word) or self.encode_segment(" " + word)
        if len(word) <= 64:
            if len(self.words) >= WORD_LIMIT:
                self.words, self.older = {}, self.words
            self.words[word] = ids
        return ids

    def encode(self, text: str) -> np.ndarray:
        """The ids of a whole text.

        Before a single space between two characters that aren't space every match of the
        pattern ends, whatever follows: no alternative runs over a space but the runs of space,
        and those need more than one or the end of the text. So such texts are encoded by word.
        """
        words = text.split(" ")
        found = list(map(self.words.get, words))
        found[0] = None
        for k, ids in enumerate(found):
            if ids is None:
                word = words[k]
                if not word or word[0].isspace() or word[-1].isspace():
                    found = list(map(self.encode_segment, segments(text)))
                    break
                found[k] = self.encode_word(word) if k else self.encode_segment(word)
        return np.frombuffer(b"".join(found), self.kind)


def segments(text: str) -> list[str]:
    """``text`` cut before each single space between two characters that aren't space."""
    out, safe = [], False
    for k, word in enumerate(text.split(" ")):
        if safe and word and not word[0].isspace():
            out.append(" " + word)
        elif k:
            out[-1] += " " + word
        else:
            out.append(word)
        safe = bool(word) and not word[-1].isspace()
    return out


class Decoder:
    def __init__(self, tokens: dict[int, bytes]):
        self.tokens = tokens
        self.rows: dict[bytes, dict] = {}

    @staticmethod
    def step(pending: bytes, byte: int) -> tuple[str, bytes]:
        """One byte of the UTF-8 state machine: the text it yields and the bytes now pending."""
        if pending:
            first = pending[0]
            low, high = 0x80, 0xBF
            if len(pending) == 1:  # no overlong forms, surrogates or code points beyond the last
                low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, low)
                high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, high)
            if low <= byte <= high:
                pending += bytes((byte,))
                need = 2 if first < 0xE0 else 3 if first < 0xF0 else 4
                return (pending.decode(), b"") if len(pending) == need else ("", pending)
            text, pending = Decoder.step(b"", byte)
            return "�" + text, pending
        if byte < 0x80:
            return chr(byte), b""
        return ("", bytes((byte,))) if 0xC2 <= byte <= 0xF4 else ("�", b"")

    def row(self, pending: bytes) -> dict:
        return self.rows.setdefault(pending, {"pending": pending})

    def build(self, row: dict, token: int) -> tuple[str, dict]:
        pending, out = row["pending"], []
        for byte in self.tokens[token]:
            text, pending = self.step(pending, byte)
            out.append(text)
        move = row[token] = ("".join(out), self.row(pending))
        return move

    def stream(self, ids: Iterable[int]) -> Iterator[str]:
        """The text, piece by piece as tokens arrive."""
        row = self.row(b"")
        for token in ids:
            text, row = row.get(token) or self.build(row, token)
            yield text
        if row["pending"]:
            yield "�"

    def decode(self, ids: Iterable[int]) -> str:
        return "".join(self.stream(ids))


def machines(data: bytes, pattern: str) -> tuple[Transducer, Decoder]:
    """The two machines of a vocabulary; a worker builds them once."""

    def make() -> tuple[Transducer, Decoder]:
        made = Transducer(load_ranks(data), pattern)
        return made, Decoder(made.tokens)

    return held(("bpe", hashlib.sha256(data).hexdigest(), pattern), make)


def _vocabulary(df: DataFrame, path: str):
    """The vocabulary file, read on the driver and sent to the executors: tens of thousands of tokens, whatever the table."""
    with open(path, "rb") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def _slices(column: pa.Array, size) -> Iterator[tuple[int, list]]:
    """(start, values) of runs of rows of about ``SLICE_CHARS``."""
    start, values, held = 0, [], 0
    for k, x in enumerate(column):
        value = x.as_py()
        values.append(value)
        held += size(value)
        if held >= SLICE_CHARS:
            yield start, values
            start, values, held = k + 1, [], 0
    if values:
        yield start, values


def encode(df: DataFrame, path: str, pattern: str, text_col: str = "text", decode_col: str | None = None, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep``, ``ids`` (array of int, the tokens of the whole text) and, where
    ``decode_col`` names it, the text that the stream decoder makes of the ids.

    Each match of ``pattern`` is encoded separately, without special tokens. A null
    or empty text has no ids and decodes to "". Repeated rows are encoded each; other
    columns are ignored; an empty table gives no rows.
    """
    data, names = _vocabulary(df, path), list(keep)
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names], "ids array<int>", *([f"`{decode_col}` string"] if decode_col else [])])
    out_names = [*names, "ids", *([decode_col] if decode_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, decoder = machines(data.value, pattern)
        for batch in batches:
            for start, texts in _slices(batch.column(len(names)), lambda x: len(x or "")):
                rows = [encoder.encode(t or "").astype(np.int32) for t in texts]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rows)))
                more = [pa.array([decoder.decode(r.tolist()) for r in rows], pa.string())] if decode_col else []
                kept = [batch.column(k).slice(start, len(texts)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, ids, *more], names=out_names)
            pa.default_memory_pool().release_unused()

    return df.select(*names, F.col(text_col).alias("_text")).mapInArrow(run, schema)


def decode(df: DataFrame, path: str, pattern: str, ids_col: str = "ids", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns in ``keep`` and ``text_col``, the text of the tokens in ``ids_col`` (null ids: "")."""
    data, names = _vocabulary(df, path), list(keep)
    schema = ", ".join([*[f"`{c}` {df.schema[c].dataType.simpleString()}" for c in names], f"`{text_col}` string"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = machines(data.value, pattern)[1]
        for batch in batches:
            for start, rows in _slices(batch.column(len(names)), lambda x: len(x or ())):
                kept = [batch.column(k).slice(start, len(rows)) for k in range(len(names))]
                yield pa.RecordBatch.from_arrays([*kept, pa.array([decoder.decode(r or ()) for r in rows], pa.string())], names=[*names, text_col])

    return df.select(*names, F.col(ids_col).alias("_ids")).mapInArrow(run, schema)
