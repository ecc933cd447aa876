"""License scan: Aho-Corasick over words for notice phrases and tags; a shunting-yard parser for the expressions behind tags, which are
evaluated against an allow-list."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

from pyspark.sql import DataFrame

from tessera.llm.common import WORD_BYTES, map_rows, struct

# Base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: The method's own phrases, with their labels and how much each says.
NOTICES = {
    "bsd license": ("bsd", 0.9), "mozilla public license": ("mpl", 0.9), "creative commons": ("cc", 0.8), "gnu lesser general public": ("lgpl", 0.9),
    "gnu affero general public": ("agpl", 0.9), "isc license": ("isc", 0.9), "unlicense": ("unlicense", 0.6), "public domain": ("public-domain", 0.5),
    "permission is hereby granted free of charge": ("mit", 0.9), "redistribution and use in source and binary forms": ("bsd", 0.9),
    "licensed under": ("notice", 0.4), "all rights reserved": ("proprietary", 0.4), "copyright": ("copyright", 0.2),
}
TAG = "spdx license identifier"
BASE_WEIGHT, TAG_WEIGHT = 0.9, 0.95
EXPRESSION = re.compile(r"spdx-license-identifier[ \t]*:[ \t]*([^\r\n]*)", re.IGNORECASE | re.ASCII)
TERM = re.compile(r"\s*(\(|\)|[A-Za-z0-9][A-Za-z0-9.+-]*)|\s*(\S)")
#: Identifiers (lower case) that an expression's terms are held against by default, and the labels that tell of the outcome.
ALLOWED = frozenset(["mit", "mit-0", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "0bsd", "isc", "zlib", "unlicense", "cc0-1.0", "cc-by-4.0", "python-2.0"])
PERMITTED, RESTRICTED = "expression-permitted", "expression-restricted"
PRECEDENCE = {"OR": 1, "AND": 2, "WITH": 3}


class ExpressionError(ValueError):
    """Not a license expression."""


def parse_expression(text: str) -> list[str]:
    """Postfix of the longest valid expression at the start of text; operators in either case, with binds tightest, then and, then or.
    One pass finds where it ends: behind the last term or bracket at which no operand is due and no bracket open."""
    tokens: list[str] = []
    end = depth = 0
    operand = True  # whether one is due
    for m in TERM.finditer(text):
        t = m[1]
        if t is None or operand != (t == "(" or t != ")" and t.upper() not in PRECEDENCE):
            break
        depth += (t == "(") - (t == ")")
        if depth < 0:
            break
        tokens.append(t)
        operand = t == "(" or t.upper() in PRECEDENCE
        if not operand and not depth:
            end = len(tokens)
    if not end:
        raise ExpressionError(text[:80])
    return _postfix(tokens[:end])


def _postfix(tokens: list[str]) -> list[str]:
    out: list[str] = []
    ops: list[str] = []
    operand = True  # whether one is due
    for t in tokens:
        up = t.upper()
        if t == "(":
            if not operand:
                raise ExpressionError(t)
            ops.append(t)
        elif t == ")":
            if operand:
                raise ExpressionError(t)
            while ops and ops[-1] != "(":
                out.append(ops.pop())
            if not ops:
                raise ExpressionError(t)
            ops.pop()
        elif up in PRECEDENCE:
            if operand:
                raise ExpressionError(t)
            while ops and ops[-1] != "(" and PRECEDENCE[ops[-1]] >= PRECEDENCE[up]:
                out.append(ops.pop())
            ops.append(up)
            operand = True
        else:
            if not operand:
                raise ExpressionError(t)
            out.append(t)
            operand = False
    if operand or "(" in ops:
        raise ExpressionError("unfinished")
    return out + ops[::-1]


def evaluate(postfix: list[str], allowed: Callable[[str], bool]) -> bool:
    """Whether the terms can be met: or needs one side, and both; with narrows its license and never widens it."""
    stack: list[bool] = []
    for t in postfix:
        if t in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a or b if t == "OR" else a and b if t == "AND" else a)
        else:
            stack.append(allowed(t))
    return stack[0]


def identifiers(postfix: list[str]) -> list[str]:
    """License identifiers of an expression, without the exceptions behind with."""
    stack: list[list[str]] = []
    for t in postfix:
        if t in PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            stack.append(a if t == "WITH" else a + b)
        else:
            stack.append([t])
    return stack[0]


def family(identifier: str) -> str:
    """mit of MIT, apache of Apache-2.0: the part before a version."""
    return re.match(r"[A-Za-z]*", identifier)[0].lower() or identifier.lower()


@lru_cache(1)
def automaton():  # noqa: ANN201
    import ahocorasick

    a = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        a.add_word(f" {phrase} ", phrase)
    a.make_automaton()
    return a


def scan_text(text: str, allowed: frozenset[str] = ALLOWED) -> tuple:
    """(n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted) of one text. permitted: whether each of
    its expressions can be met with allowed identifiers; null without any. An outcome is a label too, and a restricted expression is
    no less sure a sign of a license than a permitted one."""
    words = text.encode().translate(WORD_BYTES).split()
    flat = f" {b' '.join(words).decode(errors='surrogateescape')} "
    places, base, labels, doubt, tag = [], set(), set(), 1.0, False
    seen: set[str] = set()
    at = before = 0  # the words before a place in flat
    for end, phrase in automaton().iter(flat):
        if phrase == TAG:
            tag = True
            continue
        if phrase in BASE:
            start = end - len(phrase) - 1
            before += flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)
            at = start
            places.append(before)
            base.add(BASE[phrase])
        else:
            labels.add(NOTICES[phrase][0])
        if phrase not in seen:
            seen.add(phrase)
            doubt *= 1 - (BASE_WEIGHT if phrase in BASE else NOTICES[phrase][1])
    expressions, permitted = [], None
    if tag:
        for m in EXPRESSION.finditer(text):
            try:
                postfix = parse_expression(m[1])
            except ExpressionError:
                continue
            expressions.append(" ".join(postfix))
            labels |= {family(x) for x in identifiers(postfix)}
            permitted = permitted is not False and evaluate(postfix, lambda x: x.lower() in allowed)
            doubt *= 1 - TAG_WEIGHT
    if permitted is not None:
        labels.add(PERMITTED if permitted else RESTRICTED)
    join = lambda s: ",".join(sorted(s))
    return len(words), len(places), min(places, default=None), max(places, default=None), join(base), join(base | labels), 1 - doubt, "; ".join(expressions), permitted


RESULT = struct("n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions string, permitted boolean")


def scan_licenses(df: DataFrame, text: str = "text", allowed: frozenset[str] = ALLOWED) -> DataFrame:
    """df's columns without the text (and without those that the result has, in any case of letters) and RESULT's. One row for each row,
    repeated ones too; a null text is an empty one, which has no words, no labels and a score of 0; texts of any length take time in
    proportion to it; an empty table gives none."""
    taken = {c.lower() for c in RESULT.fieldNames()}
    keep = [c for c in df.columns if c != text and c.lower() not in taken]
    schema = type(RESULT)([*(df.schema[c] for c in keep), *RESULT])

    def make() -> Callable[[dict], Iterator[tuple]]:
        def one(row: dict) -> Iterator[tuple]:
            yield (*(row[c] for c in keep), *scan_text(row[text] or "", allowed))

        return one

    return map_rows(df.select(*keep, text), make, schema)


def op7_licenses(documents: DataFrame) -> DataFrame:
    """scan_licenses of doc_id and text with the default allow-list, in the cases that it states."""
    return scan_licenses(documents.select("doc_id", "text"))
