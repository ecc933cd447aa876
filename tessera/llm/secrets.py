"""Secret scan: three patterns, and a token-efficiency test for random strings without a telling neighbour."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.bpe import DEFAULT_RANKS, load_encoding
from tessera.llm.common import map_rows, struct

# Kinds in the order in which equal starts are listed, with their patterns and least lengths.
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of hex digits matches whole or not at all, so the least length may stand in the pattern
ASSIGN_VALUE, ACCESS_SIZE = 6, 20

#: Strings that may be random, whatever kinds of characters they have; UUIDs and digests are known identifiers and no secrets by themselves.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})$", re.IGNORECASE)
UUID = re.compile(r"[0-9a-f]{8}-(?:[0-9a-f]{4}-){3}[0-9a-f]{12}$", re.IGNORECASE)
MAX_RATIO = 2.2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the three patterns: leftmost and non-overlapping for each kind; end exclusive, in code points."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_SIZE]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def random_spans(text: str, n_tokens: Callable[[str], int], taken: list[tuple[int, int, str]], max_ratio: float = MAX_RATIO) -> list[tuple[int, int, str]]:
    """Candidates of few characters a token that no other span overlaps: text that a vocabulary has learned takes three and more."""
    out, taken, at, reach = [], sorted(taken), 0, 0
    for m in CANDIDATE.finditer(text):
        s = m[0]
        while at < len(taken) and taken[at][0] < m.end():  # spans that begin before the candidate ends, and how far they go
            reach, at = max(reach, taken[at][1]), at + 1
        if DIGEST.match(s) or UUID.match(s) or reach > m.start():
            continue
        if len(s) / n_tokens(s) < max_ratio:
            out.append((m.start(), m.end(), "random"))
    return out


def find_spans(text: str, n_tokens: Callable[[str], int]) -> list[tuple[int, int, str]]:
    base = base_spans(text)
    return sorted(base + random_spans(text, n_tokens, base), key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """Each span, overlapping ones together, becomes [SECRET]."""
    out, at = [], 0
    for a, b, _ in spans:
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join(out) + text[at:]


RESULT = struct("n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string, redacted string")


def scan_secrets(df: DataFrame, text: str = "text", redacted: bool = True, ranks: str = DEFAULT_RANKS) -> DataFrame:
    """df's columns (those that the result has, in any case of letters, give way) and n_assign, n_access, n_hex, n_random, base_sha256, spans,
    and with redacted the text without its secrets. Every row gives one row, repeated ones too; a null text has no span and stays null, an
    empty one has none; texts of any length are scanned whole in time in proportion to them; an empty table gives none."""
    taken = {c.lower() for c in RESULT.fieldNames()}
    keep = [c for c in df.columns if c.lower() not in taken]
    cols = [f for f in RESULT if redacted or f.name != "redacted"]
    schema = type(RESULT)([*(df.schema[c] for c in keep), *cols])

    def make() -> Callable[[dict], Iterator[tuple]]:
        enc = load_encoding(ranks)
        count = lambda s: len(enc.encode_ordinary(s))

        def one(row: dict) -> Iterator[tuple]:
            t = row[text] or ""
            spans = find_spans(t, count)
            n = [sum(k == kind for _, _, k in spans) for kind in KINDS]
            digest = hashlib.sha256(render([s for s in spans if s[2] != "random"]).encode()).hexdigest()
            out = (*(row[c] for c in keep), *n, digest, render(spans))
            yield (*out, redact(t, spans) if row[text] is not None else None) if redacted else out

        return one

    return map_rows(df.select(*keep), make, schema)


def op2_secrets(documents: DataFrame) -> DataFrame:
    """The digest columns of the scan for each document, in the cases that scan_secrets states; a null text counts as empty."""
    found = scan_secrets(documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), redacted=False)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans")
