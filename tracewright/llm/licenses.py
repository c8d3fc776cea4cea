"""License scans by a trained paragraph classifier.

A multinomial logistic regression on sparse one- and two-word features assigns
each paragraph to a licence family, to unknown or to none. A paragraph is a line, or, where a notice is wrapped,
the consecutive lines that each look like part of a licence; marks of comments aren't words. The classifier is trained here, on
the notices below with seeded variations, against seeded ordinary prose that
also talks of licences, versions and rights. Its probabilities are calibrated by a
temperature on held-out variations, and the unknown class by licences left out: a second classifier that never saw
the families in ``LEFT_OUT`` shows how sure it gets of a wrong family, and a family is given only above that. A predicted family is
confirmed when a notice of the family is found in the paragraph: at least
``CONFIRM`` of the notice's word pairs, where all version numbers are alike, and for a notice of a few words, in a
clause of its own; otherwise it becomes unknown too. What
the classifier itself calls unknown stays so; a family that is not confirmed
must share ``PARTLY`` of the word pairs of some notice, else the paragraph is none.
SPDX identifiers name their families themselves, other identifiers are unknown.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewright.llm.common import ddl, quoted

NONE, UNKNOWN = "none", "unknown"
CONFIRM = 0.8
PARTLY = 0.4
#: A line below this probability of being none can be part of a wrapped notice.
PART = 0.9
#: Words of a notice that has to be a clause of its own.
SHORT = 3
CLAUSE = re.compile(r"[^\w\s'-]+(?=\s|$)|\n")
#: Families that calibration leaves out of training, to stand for licences never seen; and the share of them that may still be given a family.
LEFT_OUT, LEFT_SHARE = ("cc0", "isc", "lgpl", "mpl"), 0.05
WORDS = re.compile(r"[^\W_]+(?:[.-][^\W_]+)*")

VERSION = re.compile(r"v?[0-9]+(?:\.[0-9]+)*")
SPDX = "spdx-license-identifier"
#: Families by the start of an SPDX identifier, longer ones first.
SPDX_FAMILIES = (("cc-by-nc", "cc-by-nc"), ("cc-by-sa", "cc-by-sa"), ("unlicense", "unlicense"), ("apache-", "apache"), ("cc-by-", "cc-by"), ("cc0-", "cc0"), ("agpl-", "agpl"), ("lgpl-", "lgpl"), ("gpl-", "gpl"), ("bsd-", "bsd"), ("mpl-", "mpl"), ("mit", "mit"), ("isc", "isc"))

#: Usual notices by licence family.
NOTICES = {
    "agpl": (
        "licensed under the gnu affero general public license version 3",
        "you can redistribute it and or modify it under the terms of the gnu affero general public license",
        "spdx-license-identifier agpl-3.0-only",
        "released under the agplv3 license",
    ),
    "apache": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at apache.org licenses license-2.0",
        "released under the apache 2.0 license",
        "spdx-license-identifier apache-2.0",
        "distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "released under the bsd 3-clause license",
        "licensed under the 2-clause bsd license",
        "spdx-license-identifier bsd-3-clause",
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products",
    ),
    "cc-by": (
        "licensed under cc by 4.0",
        "this work is licensed under a creative commons attribution 4.0 international license",
        "available under the creative commons attribution license",
    ),
    "cc-by-nc": (
        "licensed under cc by-nc 4.0",
        "this work is licensed under a creative commons attribution-noncommercial 4.0 international license",
        "licensed under cc by-nc-sa 4.0 for noncommercial use",
        "creative commons attribution-noncommercial license",
    ),
    "cc-by-sa": (
        "licensed under cc by-sa 4.0",
        "this work is licensed under a creative commons attribution-sharealike 4.0 international license",
        "text is available under the creative commons attribution-sharealike license",
    ),
    "cc0": (
        "to the extent possible under law the author has waived all copyright and related rights to this work",
        "released under cc0 1.0 universal public domain dedication",
        "this work has been dedicated to the public domain under cc0",
    ),
    "gpl": (
        "this work is licensed under the gnu general public license version 3",
        "licensed under the gnu general public license version 2",
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
        "spdx-license-identifier gpl-3.0-or-later",
        "released under the gplv3 license",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        "released under the isc license",
        "spdx-license-identifier isc",
    ),
    "lgpl": (
        "licensed under the gnu lesser general public license version 2.1",
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license",
        "spdx-license-identifier lgpl-2.1-only",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the software is provided as is without warranty of any kind express or implied",
        "spdx-license-identifier mit",
    ),
    "mpl": (
        "this source code form is subject to the terms of the mozilla public license v. 2.0",
        "licensed under the mozilla public license version 2.0",
        "spdx-license-identifier mpl-2.0",
    ),
    "proprietary": (
        "all rights reserved",
        "unauthorized copying of this file via any medium is strictly prohibited proprietary and confidential",
        "no part of this publication may be reproduced or transmitted without prior written permission of the publisher",
    ),
    "unlicense": (
        "this is free and unencumbered software released into the public domain",
        "released under the unlicense",
    ),
}
#: Licences that belong to no family: they teach the classifier doubt, never a family.
ODD = ("covered by the {} community terms", "use of this {} is subject to the {} license terms", "commercial use is forbidden without the consent of {}", "you may not sell or redistribute this {} without a license from {}", "the {} may be used for research purposes only", "you agree to the terms of the {} end user license agreement", "licensed under the {} license version {}", "released under the {} license", "this work is licensed under the {} public license", "spdx-license-identifier {}-{}", "distributed under the terms of the {} licence agreement")
PLAIN = (
    "she got her driving license in {} and drove on to {}",
    "the restaurant lost its liquor license under the new law of {}",
    "version {} of the plan was released under pressure from {}",
    "a licensed doctor may use this work for any purpose {}",
    "the public was free to copy the {} at the general store",
    "permission was granted by the {} to build without a fee",
    "the conditions of the road are {} and the software is new",
    "people have rights and the rights of {} are reserved by law",
    "the university of {} offers a common source of creative work",
    "read the terms and conditions of the {} before you sign",
    "she said all rights reserved seats were taken by {}",
    "commercial use of the {} grew and the consent of {} was needed",
    "she has a license to teach {} in schools",
    "a fishing license costs {} in this county",
    "license plates and {} were stolen in the night",
    "nobody has a license to drive {} in town",
    "the artist took license with {} and places",
    "a public place for general {} and common talk",
    "the mit campus and the apache river are in {}",
)
#: Words that make a pair of words a sign of a licence.
CORE = re.compile("licen|permi|copy|right|redistr|warrant|reserv|grant|gnu|gpl|agpl|lgpl|mit|apache|bsd|mozilla|isc|creative|commons|attribution|cc|spdx|unlicense|public|general|software|source|notice|prohibit|propriet|confid|consent|sell|terms|agree")
COMMON = "the of and to in a is that for it was on are as with his they at be this from have or by one had not but what all were when we there can an your which their if do will each about how up out them then she many some so these would other into has more her two like him see time could no make than first been its who now people my made over did down only way find use may water long little very after words called just where most know".split()
FOREIGN = "der die und in den von zu das mit sich des auf ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce el y los del las con una por para no su al lo como o pero sus le ha".split()
FEATURES_MIN = 2
EPOCHS, RATE, DECAY = 150, 1.5, 1e-4


def words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _noise(r: random.Random, n: int) -> list[str]:
    made = lambda: "".join(r.choice("bcdfghjklmnprstvw") + r.choice("aeiou") for _ in range(r.randint(1, 4)))
    return [r.choice(COMMON) if r.random() < 0.6 else made() for _ in range(n)]


def _varied(r: random.Random, notice: str) -> list[str]:
    """A notice with words lost and prose around it."""
    body = [w for w in notice.split() if r.random() > 0.04]
    return _noise(r, r.choice((0, 0, 3, 8, 20))) + body + _noise(r, r.choice((0, 0, 3, 8, 20)))


def samples(seed: int, each: int, families: Iterable[str] = tuple(NOTICES)) -> list[tuple[list[str], str]]:
    """Labelled paragraphs: varied notices, odd licences, ordinary prose."""
    r = random.Random(seed)
    out = [(_varied(r, n), family) for family in families for n in NOTICES[family] for _ in range(each)]
    out += [(_noise(r, r.randint(1, 60)), NONE) for _ in range(20 * each)]
    texts = [n for notices in NOTICES.values() for n in notices] + [t.replace("{}", "thing") for t in ODD]
    lone = [w for n in texts for w in n.split()]
    lone += [f"{a} {b}" for n in texts for a, b in zip(n.split(), n.split()[1:]) if not CORE.match(a) and not CORE.match(b)]
    for words_of in (COMMON, COMMON, FOREIGN, FOREIGN):  # prose in which a notice's words, and pairs of its commoner ones, stand alone
        for _ in range(20 * each):
            body = [r.choice(words_of) if r.random() < 0.5 else w for w in _noise(r, r.randint(2, 60))]
            for _ in range(r.randint(0, 3)):
                body.insert(r.randint(0, len(body)), r.choice(lone))
            out.append((body, NONE))
    out += [(_varied(r, t.format(*_noise(r, 2))), NONE) for t in PLAIN for _ in range(4 * each)]
    out += [(_varied(r, t.format(*_noise(r, 2))), UNKNOWN) for t in ODD for _ in range(2 * each)]
    return [(ws, family) for ws, family in ((words(" ".join(ws)), family) for ws, family in out) if ws]


@dataclass
class Classifier:
    families: list[str]  # the last two are none and unknown
    vocabulary: dict[str, int]  # word -> id from 1
    pairs: np.ndarray  # sorted codes of known word pairs
    weights: np.ndarray  # [words + 1 + pairs, families]
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def features(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(paragraph, row of ``weights``) of the distinct known words and pairs of each paragraph; each paragraph has row 0, which is all zeros."""
        where = np.zeros(len(ids), np.int64)
        where[starts[1:]] = 1
        where = np.cumsum(where)
        code = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
        at = np.minimum(np.searchsorted(self.pairs, code), len(self.pairs) - 1)
        pairs = np.where((self.pairs[at] == code) & (where[1:] == where[:-1]), at + len(self.vocabulary) + 1, 0)
        width = len(self.weights)
        found = np.unique(np.concatenate((where * width + ids, where[:-1] * width + pairs, np.arange(len(starts)) * width)))
        return found // width, found % width

    def probabilities(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Calibrated probabilities of the paragraphs that begin at ``starts`` among the words ``ids``."""
        which, rows = self.features(ids, starts)
        sums = np.add.reduceat(self.weights[rows], np.searchsorted(which, np.arange(len(starts))), axis=0)
        logits = (sums + self.bias) / self.temperature
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def _ids(vocabulary: dict[str, int], paragraph: list[str]) -> np.ndarray:
    return np.array([vocabulary.get(w, 0) for w in paragraph], dtype=np.int64)


def fit(labelled: list[tuple[list[str], str]], families: Iterable[str], epochs: int = EPOCHS) -> Classifier:
    """The regression of the labelled paragraphs."""
    families = [*families, NONE, UNKNOWN]
    known: dict[str, int] = {}
    for ws, _ in labelled:
        for w in set(ws):
            known[w] = known.get(w, 0) + 1
    vocabulary = {w: k + 1 for k, w in enumerate(sorted(w for w, n in known.items() if n >= FEATURES_MIN))}
    base = len(vocabulary) + 1
    codes: dict[int, int] = {}
    for ws, _ in labelled:
        ids = _ids(vocabulary, ws)
        for c in np.unique((ids[:-1] * base + ids[1:])[(ids[:-1] > 0) & (ids[1:] > 0)]).tolist():
            codes[c] = codes.get(c, 0) + 1
    pairs = np.array(sorted(c for c, n in codes.items() if n >= FEATURES_MIN), dtype=np.int64)
    model = Classifier(families, vocabulary, pairs, np.zeros((base + len(pairs), len(families)), np.float32), np.zeros(len(families), np.float32))
    every = [_ids(vocabulary, ws) for ws, _ in labelled]
    want = np.array([families.index(family) for _, family in labelled])
    rows, cols = model.features(np.concatenate(every), np.cumsum([0, *map(len, every[:-1])]))
    order = np.argsort(cols, kind="stable")
    starts = np.searchsorted(rows, np.arange(len(labelled)))
    used, first = np.unique(cols[order], return_index=True)
    velocity, step = np.zeros_like(model.weights), np.zeros_like(model.bias)
    for _ in range(epochs):  # full-batch descent with momentum
        logits = np.add.reduceat(model.weights[cols], starts, axis=0) + model.bias
        e = np.exp(logits - logits.max(axis=1, keepdims=True))
        error = e / e.sum(axis=1, keepdims=True)
        error[np.arange(len(labelled)), want] -= 1
        gradient = np.zeros_like(model.weights)
        gradient[used] = np.add.reduceat(error[rows[order]], first, axis=0) / len(labelled)
        velocity = 0.9 * velocity - RATE * (gradient + DECAY * model.weights)
        step = 0.9 * step - RATE * error.mean(axis=0)
        model.weights += velocity
        model.weights[0] = 0
        model.bias += step
    return model


def _scores(model: Classifier, paragraphs: list[tuple[list[str], str]]) -> np.ndarray:
    return np.concatenate([model.probabilities(_ids(model.vocabulary, ws), np.zeros(1, np.int64)) for ws, _ in paragraphs])


def _temper(model: Classifier, held: list[tuple[list[str], str]]) -> np.ndarray:
    """Set the temperature with the least loss on held-out paragraphs; their probabilities."""
    truth = np.array([model.families.index(f) for _, f in held])
    raw = np.log(_scores(model, held) + 1e-30)

    def loss(t: float) -> float:
        z = raw / t
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), truth]).mean())

    model.temperature = min((x / 20 for x in range(4, 61)), key=loss)
    return _scores(model, held)


@lru_cache(maxsize=2)
def train(seed: int = 42, each: int = 16) -> Classifier:
    """Fit on half of the samples' seeds, calibrate the temperature on the other and the threshold on families left out as well."""
    held = samples(seed + 1, each // 2)
    model = fit(samples(seed, each), NOTICES)
    p = _temper(model, held)
    best, top = p[:, :-2].argmax(axis=1), p[:, :-2].max(axis=1)
    truth = np.array([model.families.index(f) for _, f in held])
    # the least threshold at which 99 % of the families given are right
    right = next((x / 100 for x in range(30, 99) if (best == truth)[top >= x / 100].mean() >= 0.99), 0.99)
    # and at which licences never seen get a family no oftener than LEFT_SHARE
    rest = [f for f in NOTICES if f not in LEFT_OUT]
    half = fit(samples(seed, max(2, each // 2), rest), rest, EPOCHS // 2)
    _temper(half, samples(seed + 2, max(2, each // 4), rest))
    strange = [x for x in samples(seed + 3, max(2, each // 2), LEFT_OUT) if x[1] in LEFT_OUT]
    sure = _scores(half, strange)[:, :-2].max(axis=1)
    model.threshold = min(0.99, max(right, float(np.quantile(sure, 1 - LEFT_SHARE))))
    return model


@lru_cache(maxsize=1)
def _templates() -> dict[str, list[set]]:
    grams = lambda ws: set(zip(ws, ws[1:])) or {(w,) for w in ws}
    return {family: [grams(_plain(words(n))) for n in notices] for family, notices in NOTICES.items()}


def _plain(paragraph: list[str]) -> list[str]:
    return ["#" if VERSION.fullmatch(w) else w for w in paragraph]


def identified(paragraph: list[str]) -> list[str]:
    """The families of a paragraph's SPDX expression, unknown for identifiers of none."""
    if SPDX not in paragraph:
        return []
    ids, at = [], paragraph.index(SPDX) + 1
    while at < len(paragraph):
        ids.append(paragraph[at])
        at += 1
        if at < len(paragraph) and paragraph[at] == "with":
            at += 2
        if at >= len(paragraph) or paragraph[at] not in ("or", "and"):
            break
        at += 1
    return list(dict.fromkeys(next((f for start, f in SPDX_FAMILIES if (x == start if start in ("mit", "isc", "unlicense") else x.startswith(start))), UNKNOWN) for x in ids))


@lru_cache(maxsize=1)
def _short() -> dict[str, list[list[str]]]:
    return {family: [ws for ws in map(words, notices) if len(ws) <= SHORT] for family, notices in NOTICES.items()}


def likeness(paragraph: list[str], families: Iterable[str], text: str) -> float:
    """The largest share of the word pairs of a notice of the families that the paragraph holds; a notice of ``SHORT`` words or fewer counts where a clause ends with it or is hardly longer."""
    paragraph = _plain(paragraph)
    have = set(zip(paragraph, paragraph[1:])) | {(w,) for w in paragraph}
    best = max((len(t & have) / len(t) for family in families for t, n in zip(_templates()[family], NOTICES[family]) if len(words(n)) > SHORT), default=0.0)
    short = [n for family in families for n in _short()[family]]
    if best < 1 and short:
        clauses = [words(c) for c in CLAUSE.split(text)]
        if any(c[-len(n) :] == n or (c[: len(n)] == n and len(c) <= len(n) + 1) for c in clauses for n in short):
            return 1.0
    return best


def scan(text: str | None, model: Classifier) -> tuple[int, list[tuple[str, int, int, float]]]:
    """(lines with a word, [(family or unknown, start, end, probability)]) in code points.

    The probability of a family is its own, that of unknown the classifier's, or, where a family wasn't confirmed, that
    of a licence at all.
    """
    text = text or ""
    spans, at = [], 0
    ids, starts, lines, vocabulary = [], [], [], model.vocabulary
    for line in text.split("\n"):
        ws = words(line)
        if ws:
            starts.append(len(ids))
            lines.append((at, at + len(line), ws))
            ids += [vocabulary.get(w, 0) for w in ws]
        at += len(line) + 1
    if not starts:
        return 0, spans
    p = model.probabilities(np.array(ids, dtype=np.int64), np.array(starts, dtype=np.int64))
    none = len(model.families) - 2

    def judged(p: np.ndarray, ws: list[str], start: int, end: int) -> tuple[str, float] | None:
        if p[none] >= 0.5:
            return None
        second, best = p[:none].argsort()[-2:].tolist()
        if p[best] >= model.threshold:
            alike = {k: likeness(ws, (model.families[k],), text[start:end]) for k in (best, second)}
            if alike[second] > alike[best]:  # a notice that another's holds nearly whole, as the GPL's the LGPL's
                best = second
            if alike[best] >= CONFIRM:
                return model.families[best], float(p[best])
        if p.argmax() == none + 1:
            return UNKNOWN, float(p[none + 1])
        return (UNKNOWN, float(1 - p[none])) if likeness(ws, NOTICES, text[start:end]) >= PARTLY else None

    def joined(run: list[int]) -> None:
        """Lines that may make up one notice: what they are together, or else each."""
        if len(run) > 1:
            start, end, ws = lines[run[0]][0], lines[run[-1]][1], [w for k in run for w in lines[k][2]]
            found = judged(model.probabilities(_ids(vocabulary, ws), np.zeros(1, np.int64))[0], ws, start, end)
            if found is not None:
                spans.append((found[0], start, end, round(found[1], 4)))
                return
        for k in run:
            found = judged(p[k], lines[k][2], *lines[k][:2])
            if found is not None:
                spans.append((found[0], *lines[k][:2], round(found[1], 4)))

    run: list[int] = []
    for k, (start, end, ws) in enumerate(lines):
        named = identified(ws)
        alone = None if named else judged(p[k], ws, start, end)
        part = not named and p[k, none] < PART and (alone is None or alone[0] == UNKNOWN)
        if run and (not part or lines[run[-1]][1] + 1 != start):  # another line, or a blank one, lies between
            joined(run)
            run = []
        if part:
            run.append(k)
        elif named:
            spans += [(family, start, end, round(float(p[k, model.families.index(family)]), 4)) for family in named]
        elif alone is not None:
            spans.append((alone[0], start, end, round(alone[1], 4)))
    if run:
        joined(run)
    return len(starts), spans


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = 42) -> DataFrame:
    """``id_col``, ``n_paragraphs`` and ``found``, an array of (family, start, stop, probability), of every whole text.

    ``n_paragraphs`` counts lines with a word. A null or empty text, and one without a letter or digit, has none; a very long text
    is scanned whole. Repeated rows are scanned each; other columns are ignored; an empty
    table gives no rows. The classifier (some thousand features) goes to the executors by broadcast.
    """
    model = df.sparkSession.sparkContext.broadcast(train(seed))
    kind = pa.list_(pa.struct([("family", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, found = [], []
            for x in batch.column(1):
                n, spans = scan(x.as_py(), model.value)
                counts.append(n)
                found.append([dict(zip(("family", "start", "stop", "probability"), s)) for s in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(found, kind)], names=["_id", "n_paragraphs", "found"])

    schema = f"_id {ddl(df, id_col)}, n_paragraphs bigint, found array<struct<family:string,start:bigint,stop:bigint,probability:double>>"
    return df.select(quoted(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema).withColumnRenamed("_id", id_col)
