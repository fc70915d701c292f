"""Byte-level BPE by prefix-sharing trie traversal.

For a merge list whose ids rise with merge order, the encoding of every prefix of a word ends in
one token, and the encoding is that of the prefix before that token, plus the token. So a word's
encodings are a path of last-token states. Distinct words are put in byte order, which is a
depth-first walk of their trie: the states of the prefix shared with the word before stay on the
stack and only the nodes below it are computed. A state is a token and where it begins, so a word's tokens are
read by walking back from its end, and memory grows with the longest word and not with its square. A token may follow another if the merges, applied
to their joined bytes, give back exactly these two; this is decided by taking both apart in the
reverse of merge order and is remembered for each pair.
"""

from __future__ import annotations

import itertools
import json
from array import array
from collections.abc import Iterable

#: Stands for the end of a word in vocabularies that mark it; UTF-8 has no such byte.
END = b"\xff"


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies (character to byte), in vocabulary order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class TrieBPE:
    def __init__(self, model: dict, render):
        """model: the "model" of a tokenizer file; render: token id to the bytes stored for it."""
        alphabet = byte_alphabet()
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]

        def raw(token: str) -> bytes:
            if suffix and token.endswith(suffix) and len(token) > len(suffix):
                return bytes(alphabet[c] for c in token[: -len(suffix)]) + END
            return bytes(alphabet[c] for c in token)

        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.suffix = bool(suffix)
        self.split: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        self.ids: dict[bytes, int] = {}
        for c, b in alphabet.items():
            self.ids[bytes([b])] = vocab[c]
        if suffix:
            end = self.ids[END]
            for c, b in alphabet.items():
                if b != END[0]:
                    self._merge(vocab[c], end, vocab[c + suffix], bytes([b]) + END)
        before = -1
        for left, right in merges:
            made = vocab[left + right]
            if made <= before:
                raise ValueError("merge order and ids disagree")
            before = made
            self._merge(vocab[left], vocab[right], made, raw(left + right))
        self.bytes_of = {i: b for b, i in self.ids.items()}
        self.render = {i: render(i) for i in self.bytes_of}
        self.nothing = next(iter(self.render.values()))[:0]
        self.pairs: dict[int, bool] = {}
        # a token that its own bytes don't lead to never occurs
        for b, i in list(self.ids.items()):
            if i in self.split and not self._stable(*self.split[i], made=i):
                del self.ids[b]

        self.step: dict[int, int] = {}

    def _automaton(self) -> None:
        """For each string that begins a token: the next by byte, and the tokens that end it, longest first."""
        ends: list[list[tuple[int, int]]] = [[]]
        step = self.step
        tree: list[list[tuple[int, int]]] = [[]]
        for raw, token in self.ids.items():
            at = 0
            for b in raw:
                to = step.get(at << 8 | b)
                if to is None:
                    to = step[at << 8 | b] = len(tree)
                    tree[at].append((b, to))
                    tree.append([])
                    ends.append([])
                at = to
            ends[at] = [(len(raw), token)]
        self.back = [0] * len(tree)
        level = [(0, b, to) for b, to in tree[0]]
        while level:
            below = []
            for parent, b, at in level:
                if parent:
                    up = self.back[parent]
                    while up and up << 8 | b not in step:
                        up = self.back[up]
                    self.back[at] = step.get(up << 8 | b, 0)
                ends[at] = ends[at] + ends[self.back[at]]
                below += [(at, c, to) for c, to in tree[at]]
            level = below
        self.ends = [tuple(x) for x in ends]

    def _merge(self, left: int, right: int, made: int, raw: bytes) -> None:
        self.joined[left, right] = made
        self.split[made] = (left, right)
        self.ids[raw] = made

    def _stable(self, a: int, b: int, made: int | None = None) -> bool:
        """Do the merges leave the border between tokens a and b alone (or, for ``made``, until they join to it)?

        Walk back through the merges that built a and b: at each moment the two tokens that touch
        the border would have been joined if that merge came before the one that ended the moment.
        """
        none = 1 << 60
        until = none if made is None else made
        left, right = a, b
        while True:
            join = self.joined.get((left, right), none)
            if join < until:
                return False
            left_split, right_split = self.split.get(left), self.split.get(right)
            if left_split is None and right_split is None:
                return True
            # of the two, the one merged later is taken apart; in a tie of the same token the left one was merged first
            if right_split is None or left_split is not None and left > right:
                until, left = left, left_split[1]
            else:
                until, right = right + 1, right_split[0]

    def by_rank(self):
        """A function from a word's bytes to its token ids, by ranks where these can't differ from the merges.

        Joining neighbours whenever their bytes are a token differs from the merge list only where a
        token can be cut into two tokens other than its own parts and these two stand side by side
        when its turn comes. If no token has such a cut, the two agree on every input.
        """
        for raw, made in self.ids.items():
            for k in range(1, len(raw)):
                pair = self.ids.get(raw[:k]), self.ids.get(raw[k:])
                if None not in pair and pair != self.split[made] and self._stable(*pair, made=made):
                    return lambda word: list(self.encode([word])[word])
        import tiktoken

        return tiktoken.Encoding("ranks", pat_str=".", mergeable_ranks=dict(self.ids), special_tokens={})._core_bpe.encode_single_piece

    def encode(self, words: Iterable[bytes]) -> dict:
        """What ``render`` gives for the tokens of each distinct word, joined."""
        if not self.step:
            self._automaton()
        pairs, render, stable, step, back, ends = self.pairs, self.render, self._stable, self.step.get, self.back, self.ends
        join = b"".join if isinstance(self.nothing, bytes) else lambda parts: tuple(itertools.chain.from_iterable(parts))
        out: dict[bytes, bytes] = {}
        # after each prefix of the word: the automaton's state, the last token, and where that begins
        state, last, begin = array("i", [0]), array("i", [-1]), array("i", [0])
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del state[shared + 1 :], last[shared + 1 :], begin[shared + 1 :]
            at = state[shared]
            for end in range(shared + 1, len(word) + 1):
                b = word[end - 1]
                to = step(at << 8 | b)
                while to is None:
                    at = back[at]
                    to = step(at << 8 | b)
                at = to
                for length, token in ends[at]:
                    start = end - length
                    if start:
                        key = last[start] << 32 | token
                        fits = pairs.get(key)
                        if fits is None:
                            fits = pairs[key] = stable(last[start], token)
                        if not fits:
                            continue
                    state.append(at)
                    last.append(token)
                    begin.append(start)
                    break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            parts, at = [], len(word)
            while at:
                parts.append(render[last[at]])
                at = begin[at]
            parts.reverse()
            out[word] = join(parts)
            before = word
        if len(pairs) > 2_000_000:
            pairs.clear()
        return out


def load(source: str, render) -> TrieBPE:
    return TrieBPE(json.loads(source)["model"], render)
