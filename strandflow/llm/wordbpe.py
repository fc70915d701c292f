"""Whole-text encoding with a BPE tokenizer whose pieces never cross white space.

Texts are cut at white space and each distinct word is encoded once per worker, which gives the
library's ids because normaliser and pre-tokenizer of such a tokenizer look at nothing beyond a
run of white space. Words of Latin letters are encoded by ranks, after a proof that this gives
what the merge list gives (TrieBPE.by_rank); other words, texts holding an added token, and texts
with a separator on which the two notions of white space differ, go to the tokenizers library.
"""

from __future__ import annotations

import gc
import itertools
import json
import os
import unicodedata
from array import array

import numpy as np
import regex

from .trie import END, load

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Words longer than this are encoded each time, so that the cache's memory stays bounded.
LONG_WORD = 64
#: Letters below this are classed and lower-cased alike everywhere.
LATIN = "\u0250"
_CODECS: dict[tuple[int, int], WordCodec] = {}


class WordCodec:
    def __init__(self, source: str, cap: int = 250_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(source)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.cap = cap
        self.known: dict[str, bytes] = {}
        self.odd = ["\x1c", "\x1d", "\x1e", "\x1f", *(t.content for t in self.tokenizer.get_added_tokens_decoder().values())]
        spec = json.loads(source)
        steps = spec["pre_tokenizer"]["pretokenizers"]
        self.pieces = regex.compile(steps[0]["pattern"]["Regex"])
        self.piece = load(source, lambda i: [i]).by_rank()

    def _raw(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _learn(self, words: list[str]) -> None:
        known, piece, split, plain = self.known, self.piece, self.pieces.findall, unicodedata.is_normalized
        kind = self.dtype.char
        marks = {c: piece(c.encode() + END) for c in ",.;:!?"}
        for w in words:
            low = w.lower()
            if low.isalpha() and (w.isascii() or max(w) < LATIN and plain("NFC", w)):
                ids = piece(low.encode() + END)
            elif w.isascii():
                mark = marks.get(low[-1])
                if mark and low[:-1].isalpha():
                    ids = piece(low[:-1].encode() + END) + mark
                else:
                    ids = [i for p in split(low) for i in piece(p.encode() + END)]
            elif max(w) < LATIN:
                ids = [i for p in split(unicodedata.normalize("NFC", w).lower()) for i in piece(p.encode() + END)]
            else:
                known[w] = self._raw(w)
                continue
            known[w] = array(kind, ids).tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian ids of each text (null: empty)."""
        odd = self.odd
        words = [None if t is None or any(x in t for x in odd) else t.split() for t in texts]
        known = self.known
        need = set(itertools.chain.from_iterable(w for w in words if w)).difference(known)
        self._learn(list(need))
        get = known.__getitem__
        out = [b"".join(map(get, w)) if w is not None else self._raw(t or "") for w, t in zip(words, texts)]
        for w in need:
            if len(w) > LONG_WORD:
                del known[w]
        if len(known) > self.cap:  # the first words learned are the frequent ones
            self.known = dict(itertools.islice(known.items(), self.cap // 2))
        return out


def codec(source: str, cap: int = 250_000) -> WordCodec:
    """The worker's codec; it outlives a task, so later tasks find its words known."""
    key = (hash(source), cap)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = WordCodec(source, cap)
        gc.freeze()  # the tables stay: no need to go through them again and again
    return _CODECS[key]
