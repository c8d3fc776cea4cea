"""Full-text search: a positional index, boolean queries, BM25.

The index is a table (term, doc_id, field, positions, dl, total) to be written once and
kept; a query touches only the postings of its terms, which it takes out in one pass. Where no index
is kept, :func:`index` with a query gives the postings of that query's terms alone. Phrases and NEAR compare
positions of postings joined by document, so no text is read again.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewright.session import cut

K1, B = 1.2, 0.75
TOKEN = r"[\p{L}\p{N}]+"
SNIPPET, OPEN, CLOSE, MORE = 16, "⟦", "⟧", "…"


def tokens(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0)), F.lower)


def index(docs: DataFrame, doc_id: str, fields: tuple[str, ...], query: str | None = None) -> DataFrame:
    """Postings of every term of every field, or of a query's terms alone; ``dl`` counts the tokens of the field, ``total`` those of the document."""
    wanted = None if query is None else _wanted(parse(query))
    out = None
    cols = [tokens(F.col(f)).alias(f"_t{k}") for k, f in enumerate(fields)]
    rows = docs.select(F.col(doc_id).alias("doc_id"), *cols)
    total = sum((F.size(f"_t{k}") for k in range(1, len(fields))), F.size("_t0"))
    for k, field in enumerate(fields):
        placed = F.transform(f"_t{k}", lambda term, pos: F.struct(pos.alias("pos"), term.alias("term")))
        if wanted is not None:
            placed = F.filter(placed, lambda x: wanted(x["term"]))  # before a row is made of each
        part = rows.select("doc_id", F.lit(field).alias("field"), F.size(f"_t{k}").alias("dl"), total.alias("total"), F.explode(placed).alias("_x"))
        part = part.groupBy(F.col("_x.term").alias("term"), "doc_id", "field", "dl", "total").agg(F.array_sort(F.collect_list("_x.pos")).alias("positions"))
        out = part if out is None else out.unionByName(part)
    return out


def _wanted(tree: object) -> Callable[[Column], Column]:
    """A test of a term: whether a query's tree asks for it."""
    leaves = _every(tree)
    exact = sorted({t for leaf in leaves for k, t in enumerate(leaf.terms) if not (getattr(leaf, "prefix", False) and k == len(leaf.terms) - 1)})
    starts = sorted({leaf.terms[-1] for leaf in leaves if getattr(leaf, "prefix", False)})

    def test(term: Column) -> Column:
        out = term.isin(*exact) if exact else F.lit(False)
        for start in starts:
            out = out | term.startswith(start)
        return out

    return test


@dataclass(frozen=True)
class Leaf:
    terms: tuple[str, ...]  # one: a word; more: a phrase
    prefix: bool = False
    field: str | None = None


@dataclass(frozen=True)
class Near:
    terms: tuple[str, ...]
    within: int = 10
    field: str | None = None


@dataclass(frozen=True)
class Node:
    op: str  # and, or, not
    left: object
    right: object


_LEX = re.compile(r'\s*(?:(?P<near>NEAR)\s*\(|(?P<column>\w+)\s*:(?=\s*[\w"(])|(?P<quote>"[^"]*")(?P<star1>\*)?|(?P<op>AND|OR|NOT)\b|(?P<word>[^\s()":*,]+)(?P<star2>\*)?|(?P<sign>[(),]))')


def parse(text: str) -> object:
    """The tree of a query: words, "phrases", prefix*, AND (also by juxtaposition), OR, NOT, NEAR(a b, n), column:."""
    lexed, at = [], 0
    while at < len(text.rstrip()):
        m = _LEX.match(text, at)
        if m is None:
            raise ValueError(f"cannot read the query at {text[at:]!r}")
        lexed.append(m)
        at = m.end()
    place = 0

    def peek(group: str) -> str | None:
        return lexed[place][group] if place < len(lexed) else None

    def words(s: str) -> tuple[str, ...]:
        return tuple(re.findall(r"[^\W_]+", s.lower()))

    def primary(field: str | None) -> object:
        nonlocal place
        if place >= len(lexed):
            raise ValueError("the query ends early")
        m = lexed[place]
        place += 1
        if m["column"]:
            return primary(m["column"])
        if m["near"]:
            inside, within = [], 10
            while peek("sign") != ")":
                if place >= len(lexed):
                    raise ValueError("NEAR is not closed")
                if peek("sign") == ",":
                    place += 1
                    within = int(lexed[place]["word"])
                else:
                    inside += words((lexed[place]["word"] or lexed[place]["quote"] or ""))
                place += 1
            place += 1
            return Near(tuple(inside), within, field)
        if m["sign"] == "(":
            out = either(field)
            if peek("sign") != ")":
                raise ValueError("a parenthesis is not closed")
            place += 1
            return out
        if m["quote"] or m["word"]:
            return Leaf(words(m["quote"] or m["word"]), bool(m["star1"] or m["star2"]), field)
        raise ValueError(f"unexpected {m[0]!r}")

    def negated(field: str | None) -> object:
        nonlocal place
        out = primary(field)
        while peek("op") == "NOT":
            place += 1
            out = Node("not", out, primary(field))
        return out

    def both(field: str | None) -> object:
        nonlocal place
        out = negated(field)
        while place < len(lexed) and peek("op") != "OR" and peek("sign") not in (")", ","):
            if peek("op") == "AND":
                place += 1
            out = Node("and", out, negated(field))
        return out

    def either(field: str | None) -> object:
        nonlocal place
        out = both(field)
        while peek("op") == "OR":
            place += 1
            out = Node("or", out, both(field))
        return out

    tree = either(None)
    if place < len(lexed):
        raise ValueError("the query goes on after its end")
    return tree


def _postings(idx: DataFrame, term: str, prefix: bool, field: str | None) -> DataFrame:
    out = idx.where(F.col("term").startswith(term) if prefix else F.col("term") == term)
    if field is not None:
        out = out.where(F.col("field") == field)
    return out.select("doc_id", "field", "total", "positions")


def _hits(idx: DataFrame, leaf: Leaf | Near) -> DataFrame:
    """(doc_id, field, total, tf, first) of a word, phrase or NEAR group."""
    if isinstance(leaf, Leaf):
        out = _postings(idx, leaf.terms[0], leaf.prefix and len(leaf.terms) == 1, leaf.field)
        for k, term in enumerate(leaf.terms[1:], 1):
            last = leaf.prefix and k == len(leaf.terms) - 1
            other = _postings(idx, term, last, leaf.field).select("doc_id", "field", F.transform("positions", lambda p: p - k).alias("_p"))
            if last:
                other = other.groupBy("doc_id", "field").agg(F.flatten(F.collect_list("_p")).alias("_p"))
            out = out.join(other, ["doc_id", "field"]).withColumn("positions", F.array_intersect("positions", "_p")).drop("_p")
        if leaf.prefix and len(leaf.terms) == 1:
            out = out.groupBy("doc_id", "field", "total").agg(F.flatten(F.collect_list("positions")).alias("positions"))
    else:
        out = _postings(idx, leaf.terms[0], False, leaf.field)
        for term in leaf.terms[1:]:
            other = _postings(idx, term, False, leaf.field).select("doc_id", "field", F.col("positions").alias("_p"))
            close = lambda p: F.exists("_p", lambda q: F.abs(p - q) <= leaf.within + 1)
            out = out.join(other, ["doc_id", "field"]).withColumn("positions", F.filter("positions", close)).drop("_p")
    return out.where(F.size("positions") > 0).select("doc_id", "field", "total", F.size("positions").alias("tf"), F.array_min("positions").alias("first"))


def _leaves(tree: object) -> list:
    """The leaves that add to the rank: those not under a NOT's right side."""
    if isinstance(tree, Node):
        return _leaves(tree.left) + ([] if tree.op == "not" else _leaves(tree.right))
    return [tree]


def lengths(docs: DataFrame, doc_id: str, fields: tuple[str, ...]) -> DataFrame:
    """(doc_id, total): tokens of each document over all fields, without a row for each token."""
    return docs.select(F.col(doc_id).alias("doc_id"), sum((F.size(tokens(F.col(f))) for f in fields), F.lit(0)).alias("total")).where("total > 0")


def search(idx: DataFrame, query: str, n_docs: int, mean_length: float) -> DataFrame:
    """(doc_id, score, field, first): documents that match, BM25 score negated (lower is better), the field and place of their first hit.

    ``n_docs`` and ``mean_length`` (tokens of a document over all fields) describe the whole index: :func:`statistics`.
    """
    tree = parse(query)
    postings = cut(idx.where(_wanted(tree)(F.col("term"))))
    found = {leaf: _hits(postings, leaf) for leaf in dict.fromkeys(_every(tree))}

    def docs(node: object) -> DataFrame:
        if not isinstance(node, Node):
            return found[node].select("doc_id").distinct()
        a, b = docs(node.left), docs(node.right)
        if node.op == "and":
            return a.join(b, "doc_id")
        return a.union(b).distinct() if node.op == "or" else a.join(b, "doc_id", "left_anti")

    scored = None
    for k, leaf in enumerate(dict.fromkeys(_leaves(tree))):
        each = found[leaf].groupBy("doc_id").agg(F.sum("tf").alias("tf"), F.min(F.struct("field", "first")).alias("at"), F.max("total").alias("total")).withColumn("leaf", F.lit(k))
        scored = each if scored is None else scored.union(each)
    # a row for each leaf of the query
    n, many = F.col("n"), F.lit(n_docs)
    idf = F.greatest(F.lit(1e-6), F.log((many - n + 0.5) / (n + 0.5)))
    weights = scored.groupBy("leaf").agg(F.count("*").alias("n")).select("leaf", idf.alias("idf"))
    norm = K1 * (1 - B + B * F.col("total") / F.lit(mean_length))
    ranked = scored.join(docs(tree), "doc_id", "left_semi").join(F.broadcast(weights), "leaf").withColumn("part", F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + norm))
    return ranked.groupBy("doc_id").agg(F.round(-F.sum("part"), 6).alias("score"), F.min("at").alias("at")).select("doc_id", "score", "at.field", "at.first")


def _every(tree: object) -> list:
    return _every(tree.left) + _every(tree.right) if isinstance(tree, Node) else [tree]


def statistics(idx: DataFrame | None = None, sizes: DataFrame | None = None) -> tuple[int, float]:
    """(documents, mean tokens of a document) of a whole index, or of :func:`lengths`."""
    n, mean = (idx.groupBy("doc_id").agg(F.max("total").alias("total")) if sizes is None else sizes).agg(F.count("*"), F.avg("total")).first()
    return n, mean or 1.0


def snippet(text: Column, first: Column) -> Column:
    """The text of about ``SNIPPET`` tokens around the hit, as it stands there, with the hit marked."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(rf"[^\p{{L}}\p{{N}}]*{TOKEN}"), F.lit(0))
    start = F.greatest(F.lit(0), first - SNIPPET // 2)
    marked = F.transform(F.slice(pieces, start + 1, SNIPPET), lambda p, k: F.when(k + start == first, F.regexp_replace(p, rf"({TOKEN})$", f"{OPEN}$1{CLOSE}")).otherwise(p))
    body = F.regexp_replace(F.array_join(marked, ""), rf"^[^\p{{L}}\p{{N}}{OPEN}]+", "")
    return F.concat(F.when(start > 0, MORE).otherwise(""), body, F.when(start + SNIPPET < F.size(pieces), MORE).otherwise(""))


def merged(hits: dict[str, DataFrame], limit: int = 20, cap: int = 500) -> DataFrame:
    """The best ``limit`` hits of several kinds by score, kind, id, with how many of all are left out; each kind gives ``cap`` at most to the list."""
    out, total = None, 0
    for kind, frame in hits.items():
        frame = cut(frame)
        total += frame.count()
        part = frame.orderBy("score", "doc_id").limit(cap).select(F.lit(kind).alias("kind"), F.col("doc_id").cast("string").alias("id"), "score", "field", "first")
        out = part if out is None else out.unionByName(part)
    return out.orderBy("score", "kind", "id").limit(limit).withColumn("omitted", F.lit(max(0, total - limit)))


def extend(idx: DataFrame, docs: DataFrame, doc_id: str, fields: tuple[str, ...]) -> DataFrame:
    """The postings of documents that the index lacks: what an incremental step appends."""
    known = idx.select(F.col("doc_id").alias(doc_id)).distinct()
    return index(docs.join(known, doc_id, "left_anti"), doc_id, fields)


def without(idx: DataFrame, gone: DataFrame) -> DataFrame:
    """The index less the documents in ``gone`` (doc_id)."""
    return idx.join(gone.select("doc_id"), "doc_id", "left_anti")
