"""The seam to a language model: a callable that tasks apply to batches of prompts.

The default gives a fixed answer to each prompt, so that plans can be run and
tested without a model. Retries and their waits belong to the task that calls.
"""

from __future__ import annotations

import hashlib
import random
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

Caller = Callable[[str], str]


class Unavailable(Exception):
    """A call that may succeed later; ``after`` seconds if the provider says so."""

    def __init__(self, message: str, after: float | None = None):
        super().__init__(message)
        self.after = after


def stub(prompt: str) -> str:
    return hashlib.sha256(prompt.encode()).hexdigest()[:8]


def refuse(prompt: str) -> str:
    raise RuntimeError("no model may be called here")


def waits(seed: str, attempts: int = 8, base: float = 1.0, most: float = 60.0, total: float = 300.0) -> Iterator[float]:
    """Growing waits with a quarter of jitter, within a total."""
    draw, spent = random.Random(seed), 0.0
    for k in range(attempts - 1):
        wait = min(most, base * 2**k) * draw.uniform(0.75, 1.25)
        if spent + wait > total:
            return
        spent += wait
        yield wait


def retried(caller: Caller, sleep: Callable[[float], None] = time.sleep, **limits: float) -> Caller:
    def call(prompt: str) -> str:
        pause = waits(prompt, **limits)
        while True:
            try:
                return caller(prompt)
            except Unavailable as e:
                wait = next(pause, None)
                if wait is None:
                    raise
                sleep(e.after if e.after is not None else wait)

    return call


def answers(prompts: DataFrame, caller: Caller = stub) -> DataFrame:
    """(key, answer, error) for (key, prompt): a failed call is a row with an error, not a failed job."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for key, prompt in zip(frame.key, frame.prompt):
                try:
                    rows.append((key, caller(prompt), None))
                except Exception as e:
                    rows.append((key, None, str(e)))
            yield pd.DataFrame(rows, columns=["key", "answer", "error"])

    return prompts.select("key", "prompt").mapInPandas(run, "key string, answer string, error string")
