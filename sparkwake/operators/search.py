"""Full-text search: tokens, a query language with precedence and parentheses, and BM25 over one table."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache, reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
ALIASES = {"stream": "streams", "cred": "credentials", "creds": "credentials", "credential": "credentials", "artifact": "artifacts", "finding": "findings", "flow": "flows"}


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Letters with marks, and the letters without; behind these, marks of their own, which go."""
    pairs = []
    for k in range(0x80, 0x2000):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(k)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain != chr(k):
            pairs.append((chr(k), plain))
    marks = "".join(chr(k) for k in range(0x80, 0x2100) if unicodedata.combining(chr(k)))
    return "".join(a for a, _ in pairs) + marks, "".join(b for _, b in pairs)


def folded(text: Column) -> Column:
    """Text without the marks on its letters, in small letters."""
    given = F.coalesce(text, F.lit(""))
    return F.lower(F.when(given.rlike(r"[^\x00-\x7F]"), F.translate(given, *_folds())).otherwise(given))


def tokens(text: Column) -> Column:
    """Runs of letters and digits, in small letters and without marks."""
    return F.regexp_extract_all(folded(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def terms(raw: str, prefix: bool = False) -> list[str]:
    """The same of a query's text; with prefix the last one ends in `*`."""
    plain = "".join(c for c in unicodedata.normalize("NFD", raw) if not unicodedata.combining(c))
    found = re.findall(r"[^\W_]+", unicodedata.normalize("NFC", plain).lower())
    return [*found[:-1], found[-1] + "*"] if prefix and found else found


@dataclass(frozen=True)
class Phrase:
    """Terms that follow each other, or with `near` stand in any order with at most so many others between the outer ones."""

    terms: tuple[str, ...]
    column: str | None = None
    first: bool = False
    near: int | None = None


@dataclass(frozen=True)
class Node:
    """and, or: of all parts; not: of the first part without the second."""

    kind: str
    parts: tuple[Node | Phrase, ...]


@dataclass
class Query:
    table: str | None
    tree: Node | Phrase
    wanted: list[Phrase] = field(default_factory=list)  # phrases that count for the score
    unwanted: list[Phrase] = field(default_factory=list)

    @property
    def phrases(self) -> list[Phrase]:
        return [*self.wanted, *self.unwanted]

    def holds(self, has: Callable[[int], Column]) -> Column:
        """Whether the tree holds, given whether the k-th of phrases does."""
        known = {p: k for k, p in reversed(list(enumerate(self.phrases)))}

        def of(node: Node | Phrase) -> Column:
            if isinstance(node, Phrase):
                return has(known[node])
            parts = list(map(of, node.parts))
            if node.kind == "not":
                return parts[0] & ~parts[1]
            return reduce(Column.__and__ if node.kind == "and" else Column.__or__, parts)

        return of(self.tree)


_TOKEN = re.compile(r'\s*(?:(\()|(\))|NEAR\(([^),]*)(?:,\s*(\d+))?\)|(\^)?\s*(?:([A-Za-z_0-9]+)\s*:\s*)?(?:"([^"]*)"|([^\s"()]+)))')


def parse(text: str, tables: set[str] = frozenset(), columns: set[str] = frozenset()) -> Query:
    """`[table:] a b` (both), `a OR b`, `a AND b`, `a NOT b`, parentheses, "a phrase", prefix*, ^first, column:term, NEAR(a b, 5).

    Terms side by side bind most, then NOT, AND and OR. What isn't understood is a ValueError: an operator without a
    side, a parenthesis without its other, a query without terms or of unwanted ones alone.
    """
    rest, table = text.strip(), None
    head, colon, tail = rest.partition(":")
    name = head.strip().lower().removeprefix("fts_")
    name = ALIASES.get(name, name)
    if colon and " " not in head.strip() and name in tables:
        table, rest = name, tail.strip()
    found = list(_lexed(rest, columns))
    at = 0

    def peek() -> str | Phrase | None:
        return found[at] if at < len(found) else None

    def several(op: str | None, part: Callable, kind: str) -> Node | Phrase | None:
        """part, or parts with op between them (None: side by side)."""
        nonlocal at
        parts = [part()]
        while peek() == op if op else peek() == "(" or isinstance(peek(), Phrase):
            at += bool(op)
            parts.append(part())
        if op and len(parts) > 1 and None in parts:
            raise ValueError(f"{op} lacks a side")
        parts = [p for p in parts if p is not None]
        if kind == "not":
            return reduce(lambda a, b: Node("not", (a, b)), parts) if parts else None
        return None if not parts else parts[0] if len(parts) == 1 else Node(kind, tuple(parts))

    def one() -> Node | Phrase | None:
        nonlocal at
        now = peek()
        if now == "(":
            at += 1
            inner = either()
            if peek() != ")":
                raise ValueError("a parenthesis is not closed")
            at += 1
            return inner
        if isinstance(now, Phrase):
            at += 1
            return now if now.terms else None
        return None

    def either() -> Node | Phrase | None:
        return several("OR", lambda: several("AND", lambda: several("NOT", lambda: several(None, one, "and"), "not"), "and"), "or")

    tree = either()
    if at < len(found):
        raise ValueError("a parenthesis is not opened")
    if tree is None:
        raise ValueError("the query has no terms")
    q = Query(table, tree)

    def sort(node: Node | Phrase, wanted: bool) -> None:
        if isinstance(node, Phrase):
            (q.wanted if wanted else q.unwanted).append(node)
            return
        for k, p in enumerate(node.parts):
            sort(p, wanted and not (node.kind == "not" and k == 1))

    sort(tree, True)
    q.wanted = list(dict.fromkeys(q.wanted))
    q.unwanted = [p for p in dict.fromkeys(q.unwanted) if p not in q.wanted]
    return q


def _lexed(text: str, columns: set[str]) -> Iterator[str | Phrase]:
    at = 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if m is None or m.end() == at:
            if text[at:].strip():
                raise ValueError(f"not understood: {text[at:]}")
            return
        at = m.end()
        opened, closed, near, width, first, column, quoted, word = m.groups()
        if opened or closed:
            yield opened or closed
        elif near is not None:
            some = tuple(terms(near))
            yield Phrase(some, near=int(width or 10) if len(some) > 1 else None)
        elif word in ("AND", "OR", "NOT") and not first and not column:
            yield word
        else:
            if column and column.lower() not in columns:
                word, column = (f"{column}:{word}", None) if quoted is None else (word, None)
            raw = word if quoted is None else quoted
            yield Phrase(tuple(terms(raw, quoted is None and raw.endswith("*"))), column and column.lower(), bool(first))


def _frequency(words: Column, phrase: Phrase) -> Column:
    if len(phrase.terms) == 1:
        t = phrase.terms[0]
        return F.size(F.filter(words, lambda w: w.startswith(t[:-1]) if t.endswith("*") else w == t))
    # Words with a space of their own on either side; a phrase that overlaps itself counts once.
    whole = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    ending = "[^ ]* " if phrase.terms[-1].endswith("*") else " "
    return F.regexp_count(whole, F.lit(" " + "  ".join(phrase.terms).rstrip("*") + ending))


def search(docs: DataFrame, query: str | Query, key: str, text: str = "text", limit: int | None = 50) -> DataFrame:
    """key and score of the rows of docs that match, best first: BM25 summed over the phrases that the query wants.

    Phrases with a column, `^` or NEAR need an index. Figures of the corpus are one row, from the same counts.
    """
    q = parse(query) if isinstance(query, str) else query
    if any(p.column or p.first or p.near for p in q.phrases):
        raise ValueError("columns, ^ and NEAR need an index")
    counts = [_frequency(F.col("words"), p).alias(f"f{i}") for i, p in enumerate(q.phrases)]
    rows = docs.select(key, tokens(F.col(text)).alias("words")).select(key, F.size("words").alias("len"), *counts)
    figures = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(q.wanted))])
    score = F.lit(0.0)
    for i in range(len(q.wanted)):
        tf, df = F.col(f"f{i}"), F.col(f"n{i}")
        idf = F.greatest(F.log((F.col("n") - df + 0.5) / (df + 0.5)), F.lit(1e-6))
        score = score + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * F.try_divide("len", "avg")))
    hit = rows.where(q.holds(lambda k: F.col(f"f{k}") > 0))
    found = hit.crossJoin(F.broadcast(figures)).select(key, score.alias("score"))
    return found.orderBy(F.col("score").desc(), key).limit(limit) if limit else found
