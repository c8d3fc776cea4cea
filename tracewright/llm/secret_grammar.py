"""Secrets by inferred grammars.

:func:`infer` learns a probabilistic automaton from labelled credentials of one
format: it builds their prefix tree and merges states whose outgoing and
stopping frequencies are compatible by Hoeffding's bound, recursively (the
ALERGIA scheme). Symbols are the characters themselves while a credential
follows a prefix common to its format, then character classes. A background
automaton is learned the same way from ordinary tokens: words, names, addresses, paths, versions,
digests, UUIDs. Steps are smoothed: one never seen has the likelihood of its class.

Candidates are the runs of credential characters and their parts between separators, whatever
their place or length. A candidate is of a format if the format's automaton accepts it (its length, its end and all its steps, but
for ``ODD_STEPS`` after a prefix, were seen) and gives it a likelihood over the background's by a margin, which ordinary tokens of other words than the background's
set for each format; the value of an assignment to a secret's name needs no margin. What the fixed patterns find is scored by all automata too.

The labelled credentials are made by a seeded generator from the published
shapes of well-known tokens, so no secret is stored here and training needs no
data; any labelled list can be given instead.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import ddl, quoted

ALPHA = 0.05
SAMPLES = 600
MARK_SHARE, MARK_LENGTH = 0.15, 12
SIZES = 8  # a format with more lengths than these has a range of them
SYMBOLS = 11  # character classes: five kinds of letters and digits, six of punctuation
#: Weight of the even distribution over classes in each state, in observations; and its least share, which bounds what one odd step costs.
EVEN, EVEN_SHARE = 1.0, 0.02
SLACK = 8.0
#: Steps never seen that a candidate may take in a format with a prefix of its own.
ODD_STEPS = 1
SEPARATORS = "+/.=-_"

# --- labelled credentials -------------------------------------------------

ALNUM = string.ascii_letters + string.digits
URLSAFE = ALNUM + "-_"
HEX = "0123456789abcdef"


def _draw(rng: random.Random, letters: str, n: int) -> str:
    return "".join(rng.choices(letters, k=n))


#: Published shapes of credentials, by format.
FORMATS = {
    "aws_access": lambda r: r.choice(("AKIA", "ASIA")) + _draw(r, string.ascii_uppercase + "234567", 16),
    "github": lambda r: r.choice(("ghp_", "gho_", "ghs_", "ghu_", "ghr_")) + _draw(r, ALNUM, 36),
    "gitlab": lambda r: "glpat-" + _draw(r, URLSAFE, 20),
    "google_api": lambda r: "AIza" + _draw(r, URLSAFE, 35),
    "slack": lambda r: r.choice(("xoxb-", "xoxp-")) + "-".join((_draw(r, string.digits, r.randint(10, 13)), _draw(r, string.digits, r.randint(10, 13)), _draw(r, ALNUM, 24))),
    "stripe": lambda r: r.choice(("sk_live_", "rk_live_")) + _draw(r, ALNUM, 24),
    "sendgrid": lambda r: "SG." + _draw(r, URLSAFE, 22) + "." + _draw(r, URLSAFE, 43),
    "npm": lambda r: "npm_" + _draw(r, ALNUM, 36),
    "jwt": lambda r: "eyJ" + _draw(r, URLSAFE, r.randint(17, 60)) + ".eyJ" + _draw(r, URLSAFE, r.randint(17, 120)) + "." + _draw(r, URLSAFE, 43),
    "hex_key": lambda r: _draw(r, HEX, r.choice((32, 40, 48, 64))),
    "base64_key": lambda r: _draw(r, ALNUM + "+/", r.choice((40, 43, 44, 64))),
}

VOWELS, CONSONANTS = "aeiou", "bcdfghjklmnprstvwz"
TECHNICAL = "http https www com org net io html index src lib main test python java docs static images assets api user home local share bin release build alpha rc beta version json xml md txt tar gz img file data config sha md log archive story article title news".split()
#: Words that the margin is set on; the background doesn't know them.
OTHER = "through strength growth although schedule quickly jumping oxygen rhythm physics knowledge switch brought eighth crystal system workshop kubernetes nginx github stackoverflow wikipedia youtube spark hadoop postgres kafka abstract singleton proxy factory listener controller repository annotation serialization configuration".split()


def syllables(r: random.Random) -> str:
    if r.random() < 0.25:
        return r.choice(TECHNICAL)
    return "".join(r.choice(CONSONANTS) + r.choice(VOWELS) + r.choice(("", "", "n", "s", "r", "t", "ch")) for _ in range(r.randint(1, 5)))


def ordinary(r: random.Random, word: Callable[[random.Random], str] = syllables) -> str:
    """A token that is no credential: words, compounds, names, addresses, paths, versions, numbers, dates, digests, UUIDs."""
    some = lambda a, b: [word(r) for _ in range(r.randint(a, b))]
    digits = lambda a, b: _draw(r, string.digits, r.randint(a, b))
    kind = r.randrange(15)
    if kind <= 1:
        out = "".join(some(2, 6))
        return out.capitalize() if kind else out
    if kind == 2:
        return r.choice("-_./=+").join(some(3, 8))
    if kind == 3:
        return r.choice(("", "get", "is")) + "".join(w.capitalize() for w in some(3, 6)) + r.choice(("", "", digits(1, 4)))
    if kind == 4:
        return "_".join(w.upper() for w in some(3, 6))
    if kind == 5:
        return "/".join([*some(2, 5), digits(1, 5)])
    if kind == 6:
        return r.choice(("", "-", ".")).join(digits(4, 8) for _ in range(r.randint(3, 6)))
    if kind == 7:
        return r.choice(("-" * r.randint(16, 40), "=" * r.randint(16, 40), "_" * r.randint(16, 40), word(r) * r.randint(8, 12)))
    if kind == 8:  # address with a date and a title
        return "/".join([".".join([*some(1, 3), r.choice(("com", "org", "net", "io"))]), digits(4, 4), digits(2, 2), "-".join([*some(2, 7), *([digits(1, 6)] if r.random() < 0.5 else [])]) + r.choice(("", ".html", ".php"))])
    if kind == 9:
        return r.choice(("", "/")) + "/".join([*some(1, 3), word(r) + digits(1, 1) + "." + digits(1, 2), "-".join(some(1, 3)), word(r) + r.choice(("", ".py", ".js", ".so." + digits(1, 2)))])
    if kind == 10:
        return "-".join(_draw(r, HEX, n) for n in (8, 4, 4, 4, 12))
    if kind == 11:
        return r.choice(("", "sha256-", "md5-")) + _draw(r, HEX, r.choice((32, 40, 64)))
    if kind == 12:
        return "-".join([*some(1, 3), r.choice(("", "v")) + ".".join(digits(1, 3) for _ in range(3)), r.choice(("rc", "beta", "alpha", "post")) + digits(1, 2), *some(0, 2)])
    if kind == 13:
        return digits(4, 4) + "-" + digits(2, 2) + "-" + digits(2, 2) + r.choice(("T", "-", "_")) + digits(6, 9) + r.choice(("", "Z", "." + word(r)))
    return "=".join((word(r), r.choice(("", "/")).join(some(1, 4)) + digits(0, 3)))


def labelled(seed: int = 42, samples: int = SAMPLES) -> dict[str, list[str]]:
    r = random.Random(seed)
    return {name: [make(r) for _ in range(samples)] for name, make in FORMATS.items()}


# --- inference --------------------------------------------------------------


def kind_of(c: str) -> str:
    """The class of a character; punctuation stands for itself."""
    if c.isdigit():
        return "0"
    if "a" <= c <= "f":
        return "a"
    if "g" <= c <= "z":
        return "z"
    if "A" <= c <= "F":
        return "A"
    return "Z" if "G" <= c <= "Z" else c


@dataclass
class Automaton:
    """Log probabilities of steps and stops; symbols are characters along ``marks``, then classes."""

    marks: frozenset[str]
    steps: dict[tuple[int, str], tuple[int, float]]
    stops: dict[int, float]
    lengths: dict[int, float]
    odd: list[float]  # of a step that the state never saw
    longest: int = 0

    def score(self, token: str) -> float:
        """Log likelihood of a token. A step never seen goes on where the start would with the symbol."""
        state, total = 0, self.lengths.get(len(token), self.odd[0])
        for symbol in symbols(token, self.marks):
            step = self.steps.get((state, symbol))
            if step is None:
                total += self.odd[state]
                state = self.steps.get((0, symbol), (state, 0.0))[0]
            else:
                state, weight = step
                total += weight
        return total + self.stops.get(state, self.odd[state])

    def accepted(self, run: str, start: int, ends: frozenset[int] | set[int]) -> int:
        """The largest of ``ends`` at which the automaton accepts ``run[start:end]`` with the fewest odd steps, or -1."""
        state, best, left = 0, -1, ODD_STEPS if self.marks else 0
        spare = left
        if self.marks and run[start] not in self.marks:
            return best
        for k, symbol in enumerate(symbols(run[start : start + self.longest], self.marks), start + 1):
            step = self.steps.get((state, symbol))
            if step is None:
                left -= 1
                if left < 0 or symbol[0] == "'":
                    break
                step = self.steps.get((0, symbol), (state,))
            state = step[0]
            if k in ends and state in self.stops and k - start in self.lengths and (best < 0 or left == spare):
                best, spare = k, left
        return best


def symbols(token: str, marks: frozenset[str]) -> Iterator[str]:
    marked = True
    for k, c in enumerate(token):
        marked = marked and token[: k + 1] in marks
        yield "'" + c if marked else kind_of(c)


@dataclass
class _Node:
    seen: int = 0
    ends: int = 0
    next: dict[str, "_Node"] = field(default_factory=dict)
    count: Counter = field(default_factory=Counter)


def _differ(n1: int, f1: int, n2: int, f2: int) -> bool:
    if not n1 or not n2:
        return False
    bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))
    return abs(f1 / n1 - f2 / n2) > bound


def _compatible(a: _Node, b: _Node) -> bool:
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        if _differ(x.seen, x.ends, y.seen, y.ends):
            return False
        for s in x.count.keys() | y.count.keys():
            if _differ(x.seen, x.count[s], y.seen, y.count[s]):
                return False
            if s in x.next and s in y.next and x.next[s] is not y.next[s]:
                pairs.append((x.next[s], y.next[s]))
    return True


def _fold(a: _Node, b: _Node, moved: dict[int, _Node]) -> None:
    """Merge the tree ``b`` into ``a``."""
    pairs = [(a, b)]
    while pairs:
        x, y = pairs.pop()
        if x is y:
            continue
        moved[id(y)] = x
        x.seen += y.seen
        x.ends += y.ends
        x.count.update(y.count)
        for s, child in y.next.items():
            if s in x.next:
                pairs.append((x.next[s], child))
            else:
                x.next[s] = child


def infer(tokens: Iterable[str], use_marks: bool = True) -> Automaton:
    """The automaton of labelled ``tokens``."""
    tokens = list(tokens)
    heads = Counter(t[:k] for t in tokens for k in range(1, MARK_LENGTH + 1) if len(t) >= k)
    marks = frozenset(h for h, n in heads.items() if n >= MARK_SHARE * len(tokens)) if use_marks else frozenset()
    root = _Node()
    for t in tokens:
        node = root
        node.seen += 1
        for s in symbols(t, marks):
            node.count[s] += 1
            node = node.next.setdefault(s, _Node())
            node.seen += 1
        node.ends += 1
    red, blue = [root], [(root, s) for s in sorted(root.next)]
    while blue:
        parent, s = blue.pop(0)
        node = parent.next[s]
        if any(node is x for x in red):
            continue
        into = next((x for x in red if _compatible(x, node)), None)
        if into is None:
            red.append(node)
            blue += [(node, t) for t in sorted(node.next)]
        else:
            moved: dict[int, _Node] = {}
            parent.next[s] = into
            _fold(into, node, moved)
            # children that a red state has gained are the next to be looked at
            blue = [(moved.get(id(p), p), t) for p, t in blue]
            known = {(id(p), t) for p, t in blue}
            for x in red:
                for t in sorted(x.next):
                    if not any(x.next[t] is y for y in red) and (id(x), t) not in known:
                        blue.append((x, t))
                        known.add((id(x), t))
    number = {id(x): k for k, x in enumerate(red)}
    steps, stops, odd = {}, {}, []
    for x in red:
        share = max(EVEN / (x.seen + EVEN), EVEN_SHARE)
        for symbol, n in x.count.items():
            if id(x.next[symbol]) in number:
                steps[number[id(x)], symbol] = (number[id(x.next[symbol])], math.log((1 - share) * n / x.seen + share / SYMBOLS))
        if x.ends:
            stops[number[id(x)]] = math.log((1 - share) * x.ends / x.seen + share / SYMBOLS)
        odd.append(math.log(share / SYMBOLS))
    sizes = Counter(map(len, tokens))
    if len(sizes) > SIZES:  # no fixed lengths: those within the range are alike
        sizes = Counter(range(min(sizes), max(sizes) + 1))
    return Automaton(marks, steps, stops, {k: math.log(n / sizes.total()) for k, n in sizes.items()}, odd, max(sizes))


@dataclass
class Model:
    formats: dict[str, Automaton]
    background: Automaton
    margins: dict[str, float]

    @property
    def shortest(self) -> int:
        """Least length that any format has."""
        return min(min(a.lengths) for a in self.formats.values())

    def gain(self, token: str) -> tuple[float, str]:
        """(log likelihood over the background, format) of the best format."""
        base, best = self.background.score(token), (-math.inf, "")
        for name, automaton in self.formats.items():
            best = max(best, (automaton.score(token) - base, name))
        return best

    def found(self, run: str, margin: float | None = None) -> list[tuple[int, int, str, float]]:
        """(start, end, format, gain) of the parts of a run that are of a format, from the left, none in another.

        A part begins at the run's start or after a separator and ends at its end or before one. A format without
        a prefix of its own (keys of letters and digits alone) is sought in the run as a whole and in what follows a "=".
        """
        starts = [k for k, c in enumerate(run) if c not in SEPARATORS and (not k or run[k - 1] in SEPARATORS)]
        ends = {k for k in range(1, len(run) + 1) if k == len(run) or run[k] in SEPARATORS}
        whole = {len(run), len(run.rstrip(SEPARATORS))}
        out, free = [], 0
        for start in starts:
            if start < free:
                continue
            best = None
            for name, automaton in self.formats.items():
                if automaton.marks:
                    end = automaton.accepted(run, start, ends)
                elif start == starts[0] or run[start - 1] == "=":
                    end = automaton.accepted(run, start, whole)
                else:
                    continue
                if end > 0:
                    token = run[start:end]
                    gain = automaton.score(token) - self.background.score(token)
                    if gain > (self.margins[name] if margin is None else margin) and (best is None or gain > best[3]):
                        best = (start, end, name, gain)
            if best is not None:
                out.append(best)
                free = best[1]
        return out


@lru_cache(maxsize=4)
def train(seed: int = 42, samples: int = SAMPLES) -> Model:
    """Automata of the generated credentials and of ordinary tokens; a format's margin is the best gain in it of ordinary tokens made of other words, and ``SLACK`` more."""
    r = random.Random(seed + 1)
    model = Model({k: infer(v) for k, v in labelled(seed, samples).items()}, infer((ordinary(r) for _ in range(6 * samples)), use_marks=False), dict.fromkeys(FORMATS, SLACK))
    for _ in range(12 * samples):
        for *_, name, gain in model.found(ordinary(r, lambda r: r.choice(OTHER)), margin=0.0):
            model.margins[name] = max(model.margins[name], gain + SLACK)
    return model


# --- scanning -----------------------------------------------------------------

# The contract's base patterns. ASCII: no letter outside A-Z matches in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN_MIN = 8
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")  # maximal runs, so a least length changes no match that is long enough
HEX_RUN = re.compile(r"[0-9a-f]{32,}")
#: Every run of credential characters is a candidate, with its parts; access keys and hex runs lie inside one.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]+")
KINDS = {"assign": 0, "access": 1, "hex": 2, "format": 3}


@lru_cache(maxsize=4)
def _runs(least: int) -> re.Pattern:
    return re.compile(CANDIDATE.pattern[:-1] + f"{{{least},}}")


def scan(text: str | None, model: Model) -> list[tuple[int, int, str, str, float]]:
    """(start, end, kind, format, gain) of all spans, in code points, in order of start and kind.

    ``format`` is the likeliest format of the span (of an assignment, of its value), or "" if ordinary tokens are
    likelier; ``gain`` its log likelihood over the background's.
    """
    text = text or ""
    spans, parts = [], {}

    def base(start: int, end: int, kind: str, token: str) -> None:
        gain, name = model.gain(token)
        spans.append((start, end, kind, name if gain > 0 else "", gain))

    low = text.lower()
    if any(w in low for w in ASSIGN_WORDS):
        for m in ASSIGN.finditer(text):
            if m.end(2) - m.start(2) >= ASSIGN_MIN:
                base(m.start(), m.end(), "assign", m[2])
                # the name of a secret before it says enough: no margin
                parts |= {(m.start(2) + start, m.start(2) + end): more for start, end, *more in model.found(m[2], margin=0.0)}
    # a run shorter than the shortest credential of any format holds neither one nor an access key or hex run
    for run in _runs(min(model.shortest, 16)).finditer(text):
        token, at = run[0], run.start()
        if "AKIA" in token:
            for m in ACCESS.finditer(token):
                base(at + m.start(), at + m.end(), "access", m[0])
        for m in HEX_RUN.finditer(token):
            base(at + m.start(), at + m.end(), "hex", m[0])
        parts |= {(at + start, at + end): more for start, end, *more in model.found(token)}
    spans += [(start, end, "format", name, gain) for (start, end), (name, gain) in parts.items()]
    return sorted(spans, key=lambda s: (s[0], KINDS[s[2]], s[1]))


def joined(spans: Iterable[tuple]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, *_ in spans)


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``id_col`` and ``found``, an array of (start, stop, kind, format, gain) over each whole text.

    Kinds are assign, access, hex (fixed patterns) and format (accepted by an inferred grammar, and likelier under it
    than as an ordinary token). Every span has its likeliest format ("" if it is likelier an ordinary token) and that format's log likelihood over the
    background's. Offsets are code points, the end exclusive. A null or
    empty text has none; a very long text is scanned whole, run by run. Repeated rows are scanned each; other columns are ignored;
    an empty table gives no rows. Automata have some hundred states each and go to the executors by broadcast.
    """
    model = df.sparkSession.sparkContext.broadcast(train(seed))
    fields = ("start", "stop", "kind", "format", "gain")
    kind = pa.list_(pa.struct(list(zip(fields, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grammar = model.value
        for batch in batches:
            found = [[dict(zip(fields, s)) for s in scan(x.as_py(), grammar)] for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], names=["_id", "found"])

    schema = f"_id {ddl(df, id_col)}, found array<struct<start:bigint,stop:bigint,kind:string,format:string,gain:double>>"
    return df.select(quoted(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
