"""Byte-level BPE by prefix dynamic programming: each byte prefix has one valid last token.

A sequence of tokens is the encoding of its bytes exactly if each token and each pair of neighbours is. So the last token of a prefix
is the one that ends there and goes with the last token of what stands before it; appending never changes what is stored, and an edit
only touches the prefixes behind it, up to where old and new agree again for as many bytes as the longest token has.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame

from tessera.llm.common import map_batches, struct

DEFAULT_RANKS = "byte_bpe_50k.tiktoken"
CHUNKS, PIECES = 60_000, 50_000  # entries of a worker's caches
SHORT = 100  # letters up to which a chunk or piece is kept in them, so that entries bound bytes


@lru_cache(2)
def load_ranks(name: str = DEFAULT_RANKS) -> dict[bytes, int]:
    with open(public_tokenizers.path(name), "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@lru_cache(2)
def load_encoding(name: str = DEFAULT_RANKS):  # noqa: ANN201
    """The tiktoken library's encoder of the same ranks."""
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(name), special_tokens={})


class PrefixBPE:
    """The encoder of one piece of bytes, which no other piece influences."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.longest = ranks, max(map(len, ranks))
        self.tokens = {v: k for k, v in ranks.items()}
        self.parts: dict[int, list[int]] = {}
        self.edges: dict[tuple[int, bool], tuple[list[bytes], list[int]]] = {}

    def merge(self, data: bytes, whole: bool = True) -> list[int]:
        """Plain merging by rank, as the vocabulary was learned; not whole: the last merge, of all of data, is left out."""
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1 + (not whole):
            best, at = min(((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1)), default=(1 << 60, 0))
            if best == 1 << 60:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return [ranks[p] for p in parts]

    def is_token(self, t: int) -> bool:
        return len(self.tokens[t]) == 1 or len(self.halves(t)) == 2

    def halves(self, t: int) -> list[int]:
        """What a token is merged from at last; more than two parts if merging its bytes does not lead to it."""
        if (known := self.parts.get(t)) is None:
            known = self.parts[t] = self.merge(self.tokens[t], whole=False)
        return known

    def edge(self, t: int, right: bool) -> tuple[list[bytes], list[int]]:
        """What stands at a token's right (or left) end while it is merged, from a byte to the token itself, and the rank of the merge that
        ends each; the token's own has no end."""
        if (known := self.edges.get((t, right))) is None:
            parts = self.halves(t)
            if len(parts) == 2:
                at, ends = self.edge(parts[right], right)
                known = [*at, self.tokens[t]], [*ends[:-1], t, 1 << 60]
            else:
                known = [self.tokens[t]], [1 << 60]
            self.edges[t, right] = known
        return known

    def is_pair(self, a: int, b: int) -> bool:
        """Whether no merge crosses from a to b while both are merged from bytes. Merges go by rank and then from the left, so those within a
        go before the crossing one of equal rank, and that goes before those within b."""
        (x, dx), (y, dy), get = self.edge(a, True), self.edge(b, False), self.ranks.get
        i = j = 0
        while True:
            cross = get(x[i] + y[j], 1 << 60)
            if cross < dx[i] and cross <= dy[j]:
                return False
            if i == len(x) - 1 and j == len(y) - 1:
                return True
            if dx[i] <= dy[j]:
                i += 1
            else:
                j += 1

    def extend(self, data: bytes, last: list[int], upto: int | None = None) -> None:
        """Appends the last tokens of data's prefixes beyond those that last has already."""
        get, longest = self.ranks.get, self.longest
        for end in range(len(last) + 1, (len(data) if upto is None else upto) + 1):
            for start in range(max(0, end - longest), end):
                t = get(data[start:end])
                if t is not None and self.is_token(t) and (not start or self.is_pair(last[start - 1], t)):
                    last.append(t)
                    break
            else:
                raise ValueError("the vocabulary lacks a byte")

    def read(self, last: list[int]) -> list[int]:
        """The tokens, from the end of the prefixes to their start."""
        out, at = [], len(last)
        while at:
            out.append(last[at - 1])
            at -= len(self.tokens[last[at - 1]])
        return out[::-1]

    def encode(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        last: list[int] = []
        self.extend(piece, last)
        return self.read(last)


class Buffer:
    """An editable piece: append and replace keep its prefix table, and only what an edit can reach is worked out again."""

    def __init__(self, bpe: PrefixBPE, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, data, []
        bpe.extend(data, self.last)

    def append(self, more: bytes) -> None:
        self.data += more
        self.bpe.extend(self.data, self.last)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """data[start:end] becomes new; returns how many prefixes were worked out."""
        old, tail = self.last, self.last[end:]
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old[:start]
        same, edge, at = 0, start + len(new), start
        while at < len(self.data):
            self.bpe.extend(self.data, self.last, at + 1)
            at += 1
            # From here on the tokens only look back on bytes and last tokens that are as before.
            same = same + 1 if at > edge and self.last[-1] == tail[at - edge - 1] else 0
            if same >= self.bpe.longest:
                self.last += tail[at - edge :]
                break
        return at - start

    def ids(self) -> list[int]:
        return self.bpe.read(self.last)


class BatchBPE:
    """The same prefix tables for many short pieces at once: numpy walks a trie of the tokens from each start in all pieces."""

    LONGEST = 48  # pieces beyond go one by one
    SLOTS = 1 << 19  # of a direct-mapped memory of pairs, behind which stands PrefixBPE

    def __init__(self, ranks: dict[bytes, int]):
        self.bpe = bpe = PrefixBPE(ranks)
        valid = [(k, v) for k, v in ranks.items() if bpe.is_token(v)]
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        self.size[[v for _, v in valid]] = [len(k) for k, _ in valid]
        states: dict[bytes, int] = {b"": 1}
        for k, _ in valid:
            for i in range(1, len(k) + 1):
                states.setdefault(k[:i], len(states) + 1)
        above = np.array([0, 0, *(states[k[:-1]] for k in states if k)])  # of each state; most that lead on lead to one other alone
        leads = np.bincount(above, minlength=len(states) + 1)
        wide = np.flatnonzero(leads[1:] > 1) + 1
        self.row = np.zeros(len(states) + 1, np.int32)
        self.row[wide] = np.arange(1, len(wide) + 1)
        self.next = np.zeros((len(wide) + 1, 256), np.int32)
        self.only, self.then = np.full(len(states) + 1, -1, np.int16), np.zeros(len(states) + 1, np.int32)
        self.token = np.full(len(states) + 1, -1, np.int32)
        for k, s in states.items():
            if k and leads[up := above[s]] > 1:
                self.next[self.row[up], k[-1]] = s
            elif k:
                self.only[up], self.then[up] = k[-1], s
        self.token[[states[k] for k, _ in valid]] = [v for _, v in valid]
        self.known, self.verdict = np.full(self.SLOTS, -1, np.int64), np.zeros(self.SLOTS, bool)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether each pair of neighbours is valid."""
        key = a.astype(np.int64) << 32 | b
        slot = (key * 0x1E3779B97F4A7C15 >> 40) & (self.SLOTS - 1)
        miss = self.known[slot] != key
        out = self.verdict[slot]
        if miss.any():
            new, back = np.unique(key[miss], return_inverse=True)
            ok = np.fromiter((self.bpe.is_pair(k >> 32, k & 0xFFFFFFFF) for k in new.tolist()), bool, len(new))
            out[miss] = ok[back]
            at = (new * 0x1E3779B97F4A7C15 >> 40) & (self.SLOTS - 1)
            self.known[at], self.verdict[at] = new, ok
            clash = self.known[at] != new  # of several pairs with one slot the last stays; its verdict must be its own
            if clash.any():
                last = {s: o for s, o in zip(at.tolist(), ok.tolist(), strict=True)}
                self.verdict[list(last)] = list(last.values())
                keys = {s: k for s, k in zip(at.tolist(), new.tolist(), strict=True)}
                self.known[list(keys)] = list(keys.values())
        return out

    def encode(self, pieces: list[bytes]) -> list[list[int]]:
        out: list = [None] * len(pieces)
        order = []
        for i, p in enumerate(pieces):
            if (whole := self.bpe.ranks.get(p)) is not None:
                out[i] = [whole]
            elif len(p) > self.LONGEST:
                out[i] = self.bpe.encode(p)
            else:
                order.append(i)
        order.sort(key=lambda i: -len(pieces[i]))
        for at in range(0, len(order), 1 << 15):
            some = order[at : at + (1 << 15)]
            for i, ids in zip(some, self._encode([pieces[i] for i in some]), strict=True):
                out[i] = ids
        return out

    def _encode(self, pieces: list[bytes]) -> list[list[int]]:
        """pieces: the longest first."""
        n, width = len(pieces), len(pieces[0])
        text = np.array(pieces, f"S{width}").view(np.uint8).reshape(n, width)
        size = np.array([len(p) for p in pieces])
        reach = [int((size > d).sum()) for d in range(width)]  # rows that have a byte d: the first ones
        last = np.full((n, width + 1), -1, np.int32)
        for start in range(width):
            rows = np.arange(reach[start])
            state = np.ones(len(rows), np.int32)
            for d in range(start, width):
                if len(rows) and rows[-1] >= reach[d]:
                    stay = rows < reach[d]
                    rows, state = rows[stay], state[stay]
                byte = text[rows, d]
                state = np.where(self.only[state] == byte, self.then[state], self.next[self.row[state], byte])
                live = state > 0
                rows, state = rows[live], state[live]
                if not len(rows):
                    break
                t = self.token[state]
                open_ = np.flatnonzero((t >= 0) & (last[rows, d + 1] < 0))
                if start and len(open_):
                    open_ = open_[self.pairs(last[rows[open_], start], t[open_])]
                last[rows[open_], d + 1] = t[open_]
        back, at, rows = [], size.copy(), np.arange(n)
        ids = np.full((n, width), -1, np.int32)
        k = width
        while len(rows):
            k -= 1
            t = last[rows, at[rows]]
            ids[rows, k] = t
            at[rows] -= self.size[t]
            rows = rows[at[rows] > 0]
        counts = (ids >= 0).sum(1)
        flat, ends = ids[ids >= 0].tolist(), np.cumsum(counts).tolist()  # each row's tokens stand from its left to the right end
        back, begin = [], 0
        for end in ends:
            back.append(flat[begin:end])
            begin = end
        return back


@lru_cache(1)
def batch_bpe(ranks: str) -> BatchBPE:
    """One for each Python worker: Spark reuses workers, so the trie is built once."""
    return BatchBPE(load_ranks(ranks))


class TextEncoder:
    """From texts to their ids, joined by spaces.

    A text is cut before each space. What stands between two cuts gives the pattern the same pieces by itself as in the text, unless
    white space meets white space at a cut; such texts go through the pattern whole. Chunks and pieces are worked out once while
    their caches hold them, all that a batch lacks together.
    """

    def __init__(self, ranks: str = DEFAULT_RANKS):
        import regex

        self.bpe = batch_bpe(ranks)
        self.find = regex.compile(public_tokenizers.PATTERN).findall
        self.chunks: dict[str, str | None] = {}
        self.pieces: dict[str, str] = {}
        self.long: list[str] = []

    def _learn(self, pieces: set[str]) -> None:
        new = [p for p in pieces if p not in self.pieces]
        if len(self.pieces) + len(new) > PIECES:  # what this batch has stays
            self.pieces = {p: self.pieces[p] for p in pieces - set(new)}
        for p, ids in zip(new, self.bpe.encode([p.encode() for p in new]), strict=True):
            self.pieces[p] = " ".join(map(str, ids))
        self.long += [p for p in new if len(p) > SHORT]

    def split(self, chunk: str) -> list[str]:
        """The pattern's pieces; letters behind a space, with a mark behind them or not, need no search."""
        if chunk[:1] == " ":
            if chunk[1:].isalpha():
                return [chunk]
            if chunk[-1] in ".,;:!?" and chunk[1:-1].isalpha():
                return [chunk[:-1], chunk[-1]]
        return self.find(chunk)

    def __call__(self, texts: list[str]) -> list[str]:
        cut = [t.replace(" ", "\0 ").split("\0") if "\0" not in t else None for t in texts]
        used = set().union(*(c for c in cut if c))
        need = used - self.chunks.keys()
        if len(self.chunks) + len(need) > CHUNKS:
            self.chunks = {c: self.chunks[c] for c in used - need}
        spoilt = {c for c in need if c[:1] == " " and (c[1:2].isspace() or len(c) == 1)}
        of = {c: self.split(c) for c in need - spoilt}
        self._learn({p for ps in of.values() for p in ps})
        get = self.pieces.__getitem__
        for c, ps in of.items():
            self.chunks[c] = get(ps[0]) if len(ps) == 1 else " ".join(map(get, ps))
        self.chunks |= dict.fromkeys(spoilt)
        out = []
        for t, c in zip(texts, cut, strict=True):
            try:
                out.append(" ".join(map(self.chunks.__getitem__, c)) if t else "")
            except TypeError:  # a spoilt chunk, or no cuts at all
                ps = self.find(t)
                self._learn(set(ps))
                out.append(" ".join(map(self.pieces.__getitem__, ps)))
                self._forget()
        for c in [c for c in need if len(c) > SHORT]:
            del self.chunks[c]
        self._forget()
        return out

    def _forget(self) -> None:
        for p in self.long:
            self.pieces.pop(p, None)
        self.long.clear()


RESULT = struct("n_tokens long, ids string, decoded binary")


def encode_texts(df: DataFrame, text: str = "text", ranks: str = DEFAULT_RANKS, digests: bool = False) -> DataFrame:
    """df's columns (those that the result has, in any case of letters, give way) and n_tokens, ids (decimal, joined by spaces) and decoded
    (their bytes); with digests their sha256 in place of the last two. One row for each row, repeated ones too; a null or empty text has no
    ids; texts of any length are encoded whole, and what is long is not kept; an empty table gives none."""
    result = struct("n_tokens long, ids_sha256 string, decoded_sha256 string") if digests else RESULT
    taken = {c.lower() for c in result.fieldNames()}
    keep = [c for c in df.columns if c.lower() not in taken]
    out_cols = [c for c in keep if not (digests and c == text)]
    schema = type(RESULT)([*(df.schema[c] for c in out_cols), *result])

    def make() -> Callable[[list[dict]], list[tuple]]:
        encode = TextEncoder(ranks)
        token = {str(v): k for k, v in load_ranks(ranks).items()}.__getitem__

        def some(rows: list[dict]) -> list[tuple]:
            out = []
            for row, ids in zip(rows, encode([row[text] or "" for row in rows]), strict=True):
                each = ids.split(" ") if ids else []
                data = b"".join(map(token, each))
                tail = (hashlib.sha256(ids.encode()).hexdigest(), hashlib.sha256(data).hexdigest()) if digests else (ids, data)
                out.append((*(row[c] for c in out_cols), len(each), *tail))
            return out

        return some

    return map_batches(df.select(*keep), make, schema, mb=1.5)


def op3_bpe(documents: DataFrame) -> DataFrame:
    """encode_texts of doc_id and text with digests, in the cases that it states."""
    return encode_texts(documents.select("doc_id", "text"), digests=True)
