"""Ids of the word-BPE vocabulary by the tokenizers library, with each distinct chunk of text encoded once while a cache holds it.

Chunks end at spaces and line feeds, which the vocabulary drops and across which nothing is normalised or merged. A chunk of letters, with
a mark behind them or not, runs through the library's normaliser and model alone; every other one through the whole tokenizer.
"""

from __future__ import annotations

import os
from unicodedata import normalize

import numpy as np
import public_tokenizers

WORD_BPE = "word_bpe_49k.json"
CHUNKS = 400_000  # entries of a worker's cache
MARKS = ".,;:!?"

# The byte-level alphabet, in which printable bytes stand for themselves and the rest follow from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
ALPHABET = {b: b for b in _PLAIN} | {b: 256 + i for i, b in enumerate(x for x in range(256) if x not in _PLAIN)}


class WordEncoder:
    """From texts to their ids as little-endian unsigned 32-bit bytes. special: whether strings of special tokens give their ids."""

    def __init__(self, name: str = WORD_BPE, special: bool = True):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
        self.tokenizer.encode_special_tokens = not special
        self.vocab_size = self.tokenizer.get_vocab_size()
        self.bytes_of = [i.to_bytes(4, "little") for i in range(self.vocab_size)]
        self.chunks: dict[str, bytes] = {}

    def _whole(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def _letters(self, words: list[str]) -> list[bytes]:
        """Words of letters only; they are one piece each unless normalising takes a letter apart."""
        plain = self.tokenizer.normalizer.normalize_str(" ".join(words)).split(" ")
        if len(plain) != len(words):
            return self._whole(words)
        tokenize, of, out = self.tokenizer.model.tokenize, self.bytes_of, []
        for w, p in zip(words, plain, strict=True):
            if not p.isalpha():
                out += self._whole([w])
                continue
            s = p if p.isascii() else p.encode().decode("latin-1").translate(ALPHABET)
            out.append(b"".join([of[t.id] for t in tokenize(s)]))
        return out

    def _learn(self, need: set[str]) -> None:
        known = self.chunks
        plain = set(filter(str.isalpha, need))
        other = need - plain
        marked = {c: c[:-1] for c in other if c and c[-1] in MARKS and c[:-1].isalpha() and (c.isascii() or normalize("NFC", c[:-1]).lower().isalpha())}
        words = list(plain.union(marked.values()) - known.keys())
        known.update(zip(words, self._letters(words), strict=True) if words else ())
        rest = list((other - marked.keys()).union({c[-1] for c in marked} - known.keys()))
        known.update(zip(rest, self._whole(rest), strict=True) if rest else ())
        known.update((c, known[w] + known[c[-1]]) for c, w in marked.items())

    def __call__(self, texts: list[str]) -> list[bytes]:
        cut = [t.replace("\n", " ").split(" ") for t in texts]
        used = set().union(*cut)
        need = used - self.chunks.keys()
        if len(self.chunks) + len(need) > CHUNKS:
            self.chunks = {c: self.chunks[c] for c in used - need}
        if need:
            self._learn(need)
        get = self.chunks.__getitem__
        return [b"".join(map(get, c)) for c in cut]


_ENCODERS: dict[tuple, WordEncoder] = {}


def word_encoder(name: str = WORD_BPE, special: bool = True) -> WordEncoder:
    """One for each Python worker."""
    if (name, special) not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[name, special] = WordEncoder(name, special)
    return _ENCODERS[name, special]
