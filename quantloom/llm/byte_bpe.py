"""Byte-level BPE encoding and decoding with a two-tier lookup.

A text is cut by the vocabulary's pattern into pre-tokens. Tier one: a minimal perfect hash over the vocabulary's byte
strings gives the id of a pre-token that is itself in the vocabulary with one probe. Tier two: a miss is merged from
single bytes, kept as a linked list, by a heap of the adjacent pairs' ranks. The packed ids of frequent stretches of text
are kept in one bounded cache per Python worker.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from itertools import pairwise
from struct import pack

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quantloom.llm.shared import read

#: Stretches remembered in each of two generations (about 200 bytes each), and the characters of one at most.
CACHE_ENTRIES, CACHED_CHARACTERS = 350_000, 64
_BLANK_RUN = re.compile(r"\s |^ | \s| $").search
_SINGLE_BLANK = re.compile(r"(?<=\S) (?=\S)").split


class PerfectHash:
    """Minimal perfect hash of byte strings.

    A first hash picks a bucket; the bucket's seed sends each of its keys to a slot of its own, or names the slot where the
    bucket has one key only (as -1 - slot), which keeps the search for free slots short.
    """

    def __init__(self, keys: list[bytes], values: list[int], load: int = 3):
        self.n = n = len(keys)
        self.m = m = max(1, n // load)
        hashed = [self._hash(k) for k in keys]
        buckets: list[list[int]] = [[] for _ in range(m)]
        for i, (first, _) in enumerate(hashed):
            buckets[first % m].append(i)
        self.seeds, slots = [0] * m, [-1] * n
        for b in sorted(range(m), key=lambda b: -len(buckets[b])):
            members = [hashed[i] for i in buckets[b]]
            if len(members) < 2:
                break
            seed = 1
            while True:
                to = [(first + seed * second) % n for first, second in members]
                if len({*to}) == len(to) and all(slots[t] < 0 for t in to):
                    break
                seed += 1
            self.seeds[b] = seed
            for i, t in zip(buckets[b], to, strict=True):
                slots[t] = i
        free = (t for t in range(n) if slots[t] < 0)
        for b in range(m):
            if len(buckets[b]) == 1:
                t = next(free)
                slots[t], self.seeds[b] = buckets[b][0], -1 - t
        self.keys = [keys[i] for i in slots]
        self.values = [values[i] for i in slots]

    @staticmethod
    def _hash(key: bytes) -> tuple[int, int]:
        both = xxhash.xxh3_128_intdigest(key)
        return both & 0xFFFFFFFFFFFFFFFF, both >> 64 | 1

    def get(self, key: bytes) -> int | None:
        if not self.n:
            return None
        first, second = self._hash(key)
        seed = self.seeds[first % self.m]
        slot = -1 - seed if seed < 0 else (first + seed * second) % self.n
        return self.values[slot] if self.keys[slot] == key else None


class ByteBPE:
    """Encoder and decoder of one vocabulary, given as (bytes, rank). Packed ids are unsigned little-endian 32-bit numbers."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.vocabulary = PerfectHash(list(ranks), list(ranks.values()))
        self.bytes_of = {r: b for b, r in ranks.items()}
        self.text_of = {r: str(r) for r in ranks.values()}
        self.packed = {r: pack("<I", r) for r in ranks.values()}
        self.of_byte = [ranks.get(bytes([i]), -1) for i in range(256)]
        self.of_pair = [-1] * (1 << 16)
        for b, r in ranks.items():
            if len(b) == 2:
                self.of_pair[b[0] << 8 | b[1]] = r
        self.pieces = regex.compile(pattern).findall
        self.stretches = _Stretches(self)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of a pre-token that is not in the vocabulary: lowest rank first, leftmost first among equals.

        ``after`` and ``before`` link the starts of the parts; ``ids[i]`` is the part at i and ``pair[i]`` the rank of it
        joined with the next one. A heap entry is a rank and a start in one number; it is stale unless pair[start] still
        has that rank.
        """
        n, rank, of_pair, push, pop = len(piece), self.ranks.get, self.of_pair, heapq.heappush, heapq.heappop
        bits = n.bit_length()
        starts = (1 << bits) - 1
        ids = [self.of_byte[x] for x in piece]
        pair = [of_pair[x << 8 | y] for x, y in pairwise(piece)]
        heap = [r << bits | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pair.append(-1)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while heap:
            entry = pop(heap)
            i, r = entry & starts, entry >> bits
            if pair[i] != r:
                continue
            j = after[i]
            k = after[i] = after[j]
            ids[i], ids[j], pair[i], pair[j] = r, -1, -1, -1
            if k < n:
                before[k] = i
                pair[i] = r = rank(piece[i : after[k]], -1)
                if r >= 0:
                    push(heap, r << bits | i)
            h = before[i]
            if h >= 0:
                pair[h] = r = rank(piece[h:k], -1)
                if r >= 0:
                    push(heap, r << bits | h)
        return [r for r in ids if r >= 0]

    def encode_piece(self, piece: str) -> bytes:
        raw = piece.encode("utf-8")
        whole = self.vocabulary.get(raw)
        return b"".join([self.packed[r] for r in self.merge(raw)]) if whole is None else self.packed[whole]

    def encode(self, text: str) -> np.ndarray:
        """A single blank between two other characters starts a pre-token whatever surrounds it, so a text is cut there and
        equal stretches are encoded once."""
        first, *rest = _SINGLE_BLANK(text) if _BLANK_RUN(text) else text.split(" ")
        return np.frombuffer(b"".join([*map(self.encode_piece, self.pieces(first)), *map(self.stretches.__getitem__, rest)]), dtype="<u4")

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


class _Stretches(dict):
    """Packed ids of stretches (with the blank before them, which is not in the key) seen lately: two generations of
    CACHE_ENTRIES at most, so frequent ones stay."""

    def __init__(self, bpe: ByteBPE):
        super().__init__()
        self.bpe, self.older = bpe, {}

    def __missing__(self, stretch: str) -> bytes:
        ids = self.older.get(stretch)
        if ids is None:
            first, *rest = self.bpe.pieces(" " + stretch)
            one = self.bpe.encode_piece
            ids = b"".join([self[first[1:]] if len(first) > 1 else one(first), *map(one, rest)]) if rest else one(first)
        if len(stretch) <= CACHED_CHARACTERS:
            if len(self) >= CACHE_ENTRIES:
                self.older = dict(self)
                self.clear()
            self[stretch] = ids
        return ids


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def encode_documents(docs: DataFrame, ranks: dict[bytes, int], pattern: str, keep: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """``docs`` with n_tokens, ids (array<int>, unless ``with_ids`` is false), ids_sha256, decoded_sha256, decoded_equal.

    Null texts count as empty and give no ids. Repeated rows are encoded row by row; an empty table stays empty. Columns of
    ``docs`` with the names of the added ones give way to them. The vocabulary (one entry a rank, about 1 MB) is broadcast; the perfect hash is built once in each Python worker.
    """
    sent = docs.sparkSession.sparkContext.broadcast(ranks)
    keep = docs.columns if keep is None else keep
    added = {"n_tokens": "long", "ids": "array<int>", "ids_sha256": "string", "decoded_sha256": "string", "decoded_equal": "boolean"}
    if not with_ids:
        added.pop("ids")
    keep = [c for c in keep if c not in added]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(sent, pattern)
        text_of = bpe.text_of.__getitem__
        for batch in batches:
            columns: dict[str, list] = {c: [] for c in added}
            for text in batch["text"]:
                text = text or ""
                packed = bpe.encode(text)
                ids = packed.tolist()
                decoded = bpe.decode(ids)
                columns["n_tokens"].append(len(ids))
                if with_ids:
                    columns["ids"].append(packed.astype(np.int32))
                columns["ids_sha256"].append(hashlib.sha256(" ".join(map(text_of, ids)).encode()).hexdigest())
                columns["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                columns["decoded_equal"].append(decoded == text.encode("utf-8"))
            out = batch[keep].copy()
            for c, values in columns.items():
                out[c] = pd.Series(values, index=out.index, dtype=None if values else object)
            yield out

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep)
    return docs.mapInPandas(run, ", ".join([fields, *(f"{c} {t}" for c, t in added.items())]).lstrip(", "))


_encoders: dict[tuple[int, str], ByteBPE] = {}


def _encoder(sent, pattern: str) -> ByteBPE:
    """One encoder per worker process and vocabulary."""
    key = (hash(frozenset(sent.value.items())), pattern)
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = ByteBPE(sent.value, pattern)
    return _encoders[key]


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return encode_documents(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id"], with_ids=False)
