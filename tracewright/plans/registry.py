"""Analyzers: what they depend on, the order they run in, and how their results are addressed."""

from __future__ import annotations

import hashlib
import importlib.util
import inspect
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from datetime import UTC, datetime, timedelta
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Analyzer:
    """``compute`` maps the input frames (by name) to one frame over all sessions at once."""

    id: str
    version: str
    compute: Callable[[dict[str, DataFrame]], DataFrame]
    depends_on: tuple[str, ...] = ()
    outputs: tuple[str, ...] = ("rows",)
    config: dict = field(default_factory=dict)
    #: From the same frames, proposals as :mod:`tracewright.operators.advice` makes them.
    advise: Callable[[dict[str, DataFrame]], DataFrame] | None = None

    @property
    def code_hash(self) -> str:
        return hashlib.sha256(inspect.getsource(self.compute).encode()).hexdigest()[:16]


def ordered(analyzers: Iterable[Analyzer]) -> list[Analyzer]:
    """Dependencies first, else in the order given; a cycle or an unknown dependency is an error."""
    by_id = {a.id: a for a in analyzers}
    done: list[Analyzer] = []
    state: dict[str, int] = {}

    def visit(ident: str, path: tuple[str, ...]) -> None:
        if ident not in by_id:
            raise ValueError(f"{path[-1]} depends on {ident}, which is not registered")
        if state.get(ident) == 1:
            raise ValueError("cycle: " + " > ".join((*path, ident)))
        if ident not in state:
            state[ident] = 1
            for d in by_id[ident].depends_on:
                visit(d, (*path, ident))
            state[ident] = 2
            done.append(by_id[ident])

    for a in by_id.values():
        visit(a.id, (a.id,))
    return done


def run(analyzers: Iterable[Analyzer], inputs: dict[str, DataFrame], only: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Results by analyzer, lazily: each sees the inputs and the results it depends on."""
    every = ordered(analyzers)
    wanted = set(only) or {a.id for a in every}
    for a in reversed(every):
        if a.id in wanted:
            wanted |= set(a.depends_on)
    out: dict[str, DataFrame] = {}
    for a in every:
        if a.id in wanted:
            out[a.id] = a.compute(inputs | {d: out[d] for d in a.depends_on})
    return out


def load(path: str | Path) -> Analyzer:
    """The ``ANALYZER`` of a module on disk."""
    spec = importlib.util.spec_from_file_location(f"analyzer_{Path(path).stem}", path)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    found = getattr(module, "ANALYZER", None)
    if not isinstance(found, Analyzer):
        raise ValueError(f"{path} has no ANALYZER")
    if not re.fullmatch(r"[a-z0-9-]+", found.id) or not re.fullmatch(r"\d+\.\d+", found.version):
        raise ValueError(f"{path}: an id is of a-z, 0-9 and -, a version is major.minor")
    return found


def resolve(address: str, analyzers: Iterable[Analyzer]) -> tuple[Analyzer, str]:
    """(analyzer, output) of "analyzer" or "analyzer:output"; an analyzer with several outputs must be addressed by one."""
    by_id = {a.id: a for a in analyzers}
    ident, _, output = address.partition(":")
    if ident not in by_id:
        raise ValueError(f"unknown analyzer {ident}; known: {', '.join(sorted(by_id))}")
    known = by_id[ident].outputs
    if not output:
        if len(known) != 1:
            raise ValueError(f"{ident} has the outputs {', '.join(known)}; name one")
        return by_id[ident], known[0]
    if output not in known:
        raise ValueError(f"{ident} has no output {output}; known: {', '.join(known)}")
    return by_id[ident], output


def grade(new: str, old: str) -> str | None:
    """How a version moves on from another: major, minor or not at all."""
    a, b = (tuple(int(x) for x in v.split(".")[:2]) for v in (new, old))
    return "major" if a[0] > b[0] else "minor" if a[0] == b[0] and a[1] > b[1] else None


_UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86_400, "w": 7 * 86_400, "y": 365 * 86_400}


def moment(text: str, now: datetime | None = None) -> datetime:
    """A point in time: ISO 8601, or how long ago (30m, 2d)."""
    if m := re.fullmatch(r"(\d+)([smhdwy])", text):
        return (now or datetime.now(UTC)) - timedelta(seconds=int(m[1]) * _UNITS[m[2]])
    out = datetime.fromisoformat(text)
    return out if out.tzinfo else out.replace(tzinfo=UTC)
