"""Byte-level BPE encoding and decoding with forced-boundary splitting.

A pair of bytes that occurs inside no token of the vocabulary can never be joined by a merge, so between two such bytes there is
certainly a cut. Each pre-token (the vocabulary's own splitting pattern) falls into fragments at these cuts; fragments are encoded
independently, remembered, and concatenated.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from array import array
from functools import lru_cache
from itertools import chain

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import as_bytes, map_batches

#: Fixed value: the pre-token pattern that byte-level BPE vocabularies of this kind are made with.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens that a worker remembers, twice: when the young half is full it becomes the old half, from which what is met again moves back.
REMEMBERED = 300_000
#: Bytes under which plain lists are faster than a heap and arrays.
SHORT = 64
_NONE = 1 << 40


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: printable bytes for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (JSON of a byte-level BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters, model = byte_letters(), spec["model"]
        plain = lambda s: bytes(letters[c] for c in s)
        self.ids = {plain(t): i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.rank = {}
        for k, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[plain(a), plain(b)] = k
        self.token = [b""] * (max([*self.ids.values(), *self.special.values()]) + 1)
        for t, i in self.ids.items():
            self.token[i] = t
        for t, i in self.special.items():
            self.token[i] = t.encode()
        self.byte = [self.ids[bytes([b])] for b in range(256)]
        self.pair = {(self.ids[a], self.ids[b]): k for (a, b), k in self.rank.items()}
        self.joined = [self.ids[a + b] for a, b in self.rank]
        inside = np.zeros((256, 256), bool)
        for t in self.ids:
            for a, b in zip(t, t[1:]):
                inside[a, b] = True
        self.forced = ~inside
        self.cut = {(a, b) for a, b in np.argwhere(self.forced).tolist()}
        self.words = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def fragments(self, data: bytes) -> list[bytes]:
        """``data`` cut wherever a pair of bytes forces it."""
        if len(data) < SHORT:
            if self.cut.isdisjoint(zip(data, data[1:])):
                return [data] if data else []
            cuts = [k for k, p in enumerate(zip(data, data[1:]), 1) if p in self.cut]
            return [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])]
        a = np.frombuffer(data, np.uint8)
        cuts = (np.flatnonzero(self.forced[a[:-1], a[1:]]) + 1).tolist()
        return [data[i:j] for i, j in zip([0, *cuts], [*cuts, len(data)])]

    def merged(self, data: bytes) -> list[int]:
        """Ids of one fragment: the lowest-ranked pair first, leftmost among equals; a heap keeps long fragments near linear."""
        if len(data) < SHORT:
            ids, rank = [self.byte[b] for b in data], self.pair.get
            ranks = [rank(p, _NONE) for p in zip(ids, ids[1:])]
            while ranks and (least := min(ranks)) != _NONE:
                at = ranks.index(least)
                ids[at] = self.joined[least]
                del ids[at + 1], ranks[at]
                if at:
                    ranks[at - 1] = rank((ids[at - 1], ids[at]), _NONE)
                if at < len(ranks):
                    ranks[at] = rank((ids[at], ids[at + 1]), _NONE)
            return ids
        part = [data[i : i + 1] for i in range(len(data))]
        after, before = list(range(1, len(part) + 1)), list(range(-1, len(part) - 1))
        rank, end = self.rank, len(part)
        heap = [(r, i, part[i], part[i + 1]) for i in range(end - 1) if (r := rank.get((part[i], part[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if part[i] is None or j >= end or part[i] != a or part[j] != b:
                continue
            part[i], part[j] = a + b, None
            after[i] = k = after[j]
            if k < end:
                before[k] = i
                if (r := rank.get((part[i], part[k]))) is not None:
                    heapq.heappush(heap, (r, i, part[i], part[k]))
            h = before[i]
            if h >= 0 and (r := rank.get((part[h], part[i]))) is not None:
                heapq.heappush(heap, (r, h, part[h], part[i]))
        return [self.ids[p] for p in part if p is not None]

    def word(self, word: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit numbers."""
        out = self.old.get(word)
        if out is None:
            out = array("I", chain.from_iterable(map(self.merged, self.fragments(word.encode())))).tobytes()
        if len(word) <= SHORT:
            if len(self.known) >= REMEMBERED:
                self.old, self.known = self.known, {}
            self.known[word] = out
        return out

    def encoded(self, text: str) -> bytes:
        """Ids of a text as little-endian 32-bit numbers; names of special tokens in the text are those tokens."""
        if self.specials is not None and any(s in text for s in self.special):
            parts = self.specials.split(text)
            return b"".join(np.array([self.special[p]], "<u4").tobytes() if k % 2 else self.encoded_plain(p) for k, p in enumerate(parts))
        return self.encoded_plain(text)

    def encoded_plain(self, text: str) -> bytes:
        out = []
        for k in range(0, len(words := self.words.findall(text)), 4096):
            known = self.known
            out += [known.get(w) or self.word(w) for w in words[k : k + 4096]]
        return b"".join(out)

    def decoded(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(2)
def codec_of(path: str) -> Codec:
    """The codec of a vocabulary, kept as long as the Python process: later tasks find most pre-tokens in its memory."""
    return Codec(path)


def encoded_documents(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids: the general form, for those who want the ids themselves."""

    def make():
        codec = codec_of(path)
        return lambda doc_id, text: (doc_id, [np.frombuffer(codec.encoded(x.decode("utf-8", "replace")), "<u4").astype(np.int32) for x in as_bytes(text)])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, ids array<int>", make)


def encode_decode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; the text comes back byte for byte.

    A null text is an empty one (no ids). Repeated rows give repeated rows, a null doc_id stays null, other columns are not looked at.
    """

    def make():
        codec = codec_of(path)

        def f(doc_id, text):
            ids = [codec.encoded(x.decode("utf-8", "replace")) for x in as_bytes(text)]
            back = [codec.decoded(x).decode("utf-8", "replace").encode() for x in ids]
            sha = lambda x: hashlib.sha256(x).hexdigest()
            return doc_id, [len(x) // 4 for x in ids], [sha(x) for x in ids], [sha(x) for x in back]

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)
