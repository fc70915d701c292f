"""Encode whole texts with a byte-level BPE and decode them again.

Texts are cut into the tokenizer's pieces; each distinct piece is encoded once per worker by the
prefix-sharing trie traversal of trie.py and decoded from the bytes of its tokens. A null text is
empty; every row gives one row, repeated rows and null doc_ids too; an empty table gives an empty result. A text
without any border is one piece, whose memory grows with its length. Of other columns none is read.
"""

from __future__ import annotations

import gc
import hashlib
import itertools
import json
import re

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import ddl, read_tokenizer, ship, slices
from .trie import load

#: The piece pattern of byte-level tokenizers, with white space spelt out as Unicode has it. Fixed value.
SPACE = r"\t-\r \x85\xa0  -     　"
PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: Longer pieces are not remembered, so that the cache's memory stays bounded.
LONG_PIECE = 64
_CODECS: dict[int, PieceCodec] = {}


class PieceCodec:
    def __init__(self, source: str, cap: int = 250_000):
        spec = json.loads(source)
        pre = spec["pre_tokenizer"]
        if pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("not a plain byte-level tokenizer")
        self.trie = load(source, lambda i: (i,))
        self.findall = regex.compile(PIECES).findall
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")")
        self.cap = cap
        self.known: dict[str, tuple[bytes, bytes]] = {}

    def _learn(self, need: set[str]) -> None:
        raw = {p.encode(): p for p in need}
        bytes_of = self.trie.bytes_of
        for b, ids in self.trie.encode(raw).items():
            self.known[raw[b]] = (b"".join([b"%d," % i for i in ids]), b"".join([bytes_of[i] for i in ids]))

    def _cut(self, text: str) -> list:
        if not any(a in text for a in self.added):
            return self.findall(text)
        out: list = []
        for k, part in enumerate(self.special.split(text)):
            out += [(part,)] if k % 2 else self.findall(part)  # an added token, as itself
        return out

    def run(self, texts: list[str | None]) -> list[tuple[int, str, str]]:
        """For each text: number of ids, digest of the ids as text, digest of the decoded text."""
        cut = [self._cut(t or "") for t in texts]
        need = {p for p in set(itertools.chain.from_iterable(cut)).difference(self.known) if isinstance(p, str)}
        self._learn(need)
        self.known.update({(a,): (b"%d," % i, a.encode()) for a, i in self.added.items()})
        get = self.known.__getitem__
        out = []
        for pieces in cut:
            found = [*map(get, pieces)]
            ids = b"".join([x for x, _ in found])
            text = b"".join([x for _, x in found]).decode("utf-8", "replace").encode()
            out.append((ids.count(b","), hashlib.sha256(ids[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()))
        for p in need:
            if len(p) > LONG_PIECE:
                del self.known[p]
        if len(self.known) > self.cap:  # the first pieces learned are the frequent ones
            self.known = dict(itertools.islice(self.known.items(), self.cap // 2))
        return out


def _codec(source: str) -> PieceCodec:
    if hash(source) not in _CODECS:
        _CODECS.clear()
        _CODECS[hash(source)] = PieceCodec(source)
        gc.freeze()  # the tables stay: no need to go through them again and again
    return _CODECS[hash(source)]


def _digests(batches, source):
    codec = _codec(source.value)
    for whole in batches:
        for batch in slices(whole):
            n, ids, text = zip(*codec.run(batch.column("text").to_pylist()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids), pa.array(text)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode_decode(spark: SparkSession, docs: DataFrame, tokenizer: str) -> DataFrame:
    """Per document: n_tokens, ids_sha256, decoded_sha256."""
    ship(spark)
    source = spark.sparkContext.broadcast(read_tokenizer(tokenizer))
    docs = docs.select("doc_id", "text")
    return docs.mapInArrow(lambda b: _digests(b, source), ddl(docs, "doc_id") + ", n_tokens long, ids_sha256 string, decoded_sha256 string")
