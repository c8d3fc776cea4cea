"""A small table with every awkward case, and plain-Python versions of the operators."""

import hashlib
import random

KINDS = "doc_id bigint, text string, lang string, source string, n_chars bigint, slot string, shard int, fp string, kept string, ids string, _text string, _ID string, _digest string, _host string, _size string, _tokens string, _on string, in_0 string, `a.b` string, component_id string, mix_epoch string"

LINE = "Subscribe to our newsletter for more news today"


def rows(seed=0):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    out = []
    for k in range(60):
        out.append([k, f"{prose(20)}\n{LINE}\n{prose(15)}" if k % 2 else prose(30), r.choice(["en", "de"]), f"src{k % 3}"])
    body = prose(120)
    out += [[100 + k, body, "en", "src0"] for k in range(12)]  # exact copies
    out += [[200 + k, body + f"\nx{k}", "en", "src0"] for k in range(4)]  # near copies
    out += [[300, None, "en", "src0"], [301, "", "en", "src1"], [302, " \t\n\x0b ", None, None], [303, "Ünïcödé ﬁ ½ 👍\u0085x  y\r\n" + prose(12), "fr", "src9"], [304, "One", "en", "odd"]]
    out.append([305, prose(20_000), "en", "src1"])
    out += [[306, "same row again and again it is the same one", "en", "src2"]] * 3
    out += [[None, prose(14), "en", "src2"], [None, None, None, None]]
    out.append([307, "token = \"" + "0f" * 20 + "\" and AKIA" + "A1" * 8 + " ghp_" + "aB3" * 12 + " x", "en", "src4"])
    out.append([308, "Released under the MIT License.\n" + prose(12) + "\nLicensed under the Apache License, Version 2.0.", "en", "src4"])
    out.append([309, " ".join(["again and again it goes"] * 10), "en", "src4"])
    return [tuple([*x, len(x[1]) if x[1] is not None else None, "a", 7, "b", "c", "d", "e", *"fghijklmno"[: len(KINDS.split(",")) - 11]]) for x in out]


def frame(spark, seed=0):
    return spark.createDataFrame(rows(seed), KINDS).repartition(5)


def empty(spark):
    return spark.createDataFrame([], KINDS)


def strangers(df):
    """The columns of ``df`` that no operator has to do with, for each row."""
    names = [c for c in df.columns if c in EXTRA]
    return [dict(zip(names, r)) for r in df.select(*[f"`{c}`" for c in names]).collect()]


#: Extra columns of :func:`frame` with their value in every row; some have the names of operators' own or added columns.
EXTRA = {"slot": "a", "shard": 7, "fp": "b", "kept": "c", "ids": "d", "_text": "e", "_ID": "f", "_digest": "g", "_host": "h", "_size": "i", "_tokens": "j", "_on": "k", "in_0": "l", "a.b": "m", "component_id": "n", "mix_epoch": "o"}


def words(text):
    out, now = [], ""
    for c in text or "":
        if c in " \t\n\x0b\x0c\r":
            if now:
                out.append(now)
            now = ""
        else:
            now += c
    return out + [now] if now else out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(items, linked):
    """label (least item) of each item."""
    label = {x: x for x in items}
    for x in items:
        todo, seen = [x], {x}
        while todo:
            a = todo.pop()
            for b in items:
                if b not in seen and linked(a, b):
                    seen.add(b)
                    todo.append(b)
        label[x] = min(seen)
    return label
