"""Hierarchical multi-length packing of token ids.

Documents are routed to tiers of context sizes (``TIERS``): whole windows of the longest tier are cut off first, the rest goes to
the shortest tier that holds it. Each tier is packed best-fit, longest first. Gaps of longer windows are then filled from shorter
tiers: whole pieces while they fit, then a piece cut to the gap. What no window is filled with (less than one window) goes into the
task's next batch; at the task's end it is laid out in windows of powers of two, so no window is padded.

Documents are packed within an Arrow batch (some hundred documents), so no text is shuffled, a lost task is simply run again, and
memory is bounded by the batch. Then the windows of the whole table are dealt to step groups of nearly equal tokens: a group holds
windows of one tier, or windows shorter than all tiers. Each window knows the tokens before it within its partition; prefix sums of
the partitions' totals (a row a partition and tier) give its place among all, so groups span batches and partitions.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string
from tokenizers import Tokenizer

from notelake.llm.text import as_bytes, small_batches, written

TIERS = (256, 512, 1024, 2048)
#: Tokens at most of a step group, which holds windows of one tier (or of the sizes below the shortest).
STEP_TOKENS = 16_384
#: The id that ends each document.
END = 1
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, context int, part int, tier int, before long"
#: Rows of partition totals (one a partition and tier) up to which they are broadcast; beyond, they are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words that a worker remembers, twice: when the young half is full it becomes the old half, from which what is met again moves back.
REMEMBERED = 300_000
#: How the vocabulary parts words that hold Latin-1 letters, digits and marks only, and its mark of a word's end.
PLAIN = regex.compile(r"[\x21-\x7e\xa1-\xff]+")
PARTS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
WORD_END = "</w>"


class Words:
    """Ids by the tokenizers library, remembered by word. ASCII blanks part words for the vocabulary's pattern too, so the ids of a text
    are those of its words in order; names of special tokens hold no blank."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(WORD_END)]] = True
        self.known: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def looked_up(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words. Plain ones go to the library as one line, whose ids are parted where the words' parts end."""
        texts = [w.decode("utf-8", "replace") for w in words]
        plain = [k for k, t in enumerate(texts) if PLAIN.fullmatch(t) and "<|" not in t]
        out = {}
        for at in range(0, len(plain), 2000):
            own = plain[at : at + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join([texts[k] for k in own])], add_special_tokens=False)[0].ids, "<u4")
            ends = np.flatnonzero(self.ends[ids]) + 1
            parts = np.cumsum([len(PARTS.findall(texts[k].lower())) for k in own])
            if len(ends) != parts[-1]:
                raise ValueError("words and ids don't fall together")
            data, bounds = ids.tobytes(), [0, *(4 * ends[parts - 1]).tolist()]
            out |= {words[k]: data[a:b] for k, a, b in zip(own, bounds, bounds[1:])}
        rest = sorted(set(range(len(words))) - set(plain))
        found = self.tokenizer.encode_batch_fast([texts[k] for k in rest], add_special_tokens=False) if rest else []
        return out | {words[k]: np.array(e.ids, "<u4").tobytes() for k, e in zip(rest, found)}

    def encoded(self, texts: list[bytes]) -> list[bytes]:
        """Ids of each text, with the end id, as little-endian 32-bit numbers."""
        split = [x.split() for x in texts]  # of bytes: at the six ASCII blanks only
        known, old, new = self.known, self.old, []
        for w in set(chain.from_iterable(split)) - known.keys():
            if w in old:
                known[w] = old[w]
            else:
                new.append(w)
        known.update(self.looked_up(new))
        end = np.array([END], "<u4").tobytes()
        out = [b"".join([known[w] for w in words]) + end for words in split]
        if len(known) >= REMEMBERED:
            self.old, self.known = known, {}
        return out


@lru_cache(2)
def words_of(path: str) -> Words:
    """The word memory of a vocabulary, kept as long as the Python process: later tasks find most words there."""
    return Words(path)


def routed(lengths: list[int], tiers=TIERS):
    """Full windows of the longest tier, and by tier the remaining pieces (document, start, length)."""
    longest = tiers[-1]
    full, waiting = [], {t: [] for t in tiers}
    for d, n in enumerate(lengths):
        whole = n // longest * longest
        full += [(longest, [(d, s, longest)]) for s in range(0, whole, longest)]
        if n > whole:
            waiting[tiers[bisect_left(tiers, n - whole)]].append((d, whole, n - whole))
    return full, waiting


def filled(lengths: list[int], tiers=TIERS) -> tuple[list[tuple[int, list[tuple[int, int, int]]]], list[tuple[int, int, int]]]:
    """(full windows of the tiers: (size, pieces (document, start, length)); what is left, less than a window of the longest tier)."""
    windows, waiting = routed(lengths, tiers)
    below: list[tuple[int, int, int]] = []  # (length, document, start) of shorter tiers, ascending
    partly: list[tuple[int, int, list]] = []
    for tier in tiers:
        room: list[tuple[int, int]] = []  # (free tokens, window), ascending
        opened: list[list] = []
        for d, s, n in sorted(waiting[tier], key=lambda p: (-p[2], p[0], p[1])):
            k = bisect_left(room, (n, -1))
            if k < len(room):
                free, w = room.pop(k)
            else:
                free, w = tier, len(opened)
                opened.append([])
            opened[w].append((d, s, n))
            if free > n:
                insort(room, (free - n, w))
        gaps = dict((w, free) for free, w in room)
        for w, pieces in enumerate(opened):
            if gaps.get(w, 0):
                partly.append((tier, gaps[w], pieces))
            else:
                windows.append((tier, pieces))
    # Longest windows first; a gap takes the shorter tiers' windows apart, shortest tier last in line to be kept.
    partly.sort(key=lambda x: (-x[0], x[1]))
    low = len(partly)
    k = 0
    while k < low:
        tier, gap, pieces = partly[k]
        while gap:
            if not below:
                if low - 1 <= k:
                    break
                low -= 1
                below = sorted((n, d, s) for d, s, n in partly[low][2])
            at = bisect_left(below, (gap + 1, -1, -1)) - 1
            if at >= 0:
                n, d, s = below.pop(at)
            else:
                n, d, s = below.pop(0)
                insort(below, (n - gap, d, s + gap))
                n = gap
            pieces.append((d, s, n))
            gap -= n
        if gap:
            below = sorted([*below, *((n, d, s) for d, s, n in pieces)])
        else:
            windows.append((tier, pieces))
        k += 1
    return windows, sorted((d, s, n) for n, d, s in below)


def laid_out(rest: list[tuple[int, int, int]], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows of powers of two for the pieces in ``rest``."""
    windows, rest = [], list(rest)
    left = sum(n for _, _, n in rest)
    while left:
        size = gap = min(tiers[-1], 1 << (left.bit_length() - 1))
        pieces = []
        while gap:
            d, s, n = rest.pop(0)
            take = min(n, gap)
            pieces.append((d, s, take))
            if n > take:
                rest.insert(0, (d, s + take, n - take))
            gap -= take
        windows.append((size, pieces))
        left -= size
    return windows


def pack(lengths: list[int], tiers=TIERS) -> list[tuple[int, list[tuple[int, int, int]]]]:
    """Windows (size, pieces (document, start, length)); each is full, and every token lies in exactly one piece."""
    windows, rest = filled(lengths, tiers)
    return windows + laid_out(rest, tiers)


def tier_of(size: int, tiers=TIERS) -> int:
    """The tier of a window; 0 for those shorter than all tiers, which are dealt together."""
    return size if size >= tiers[0] else 0


def room(tier: int, tokens: int = STEP_TOKENS, tiers=TIERS) -> int:
    """Tokens for which one group is made. A group takes the windows that begin in its equal share, so of mixed sizes it may hold up to
    half the shortest tier more than its share."""
    return max(1, tokens if tier else tokens - tiers[0] // 2)


def step_groups(windows, tokens: int = STEP_TOKENS, tiers=TIERS) -> list[int]:
    """A group for each window: each tier's windows are dealt to as few groups as hold them, with nearly equal tokens a group."""
    total, before, first = {}, {}, {}
    for size, _ in windows:
        total[tier_of(size, tiers)] = total.get(tier_of(size, tiers), 0) + size
    groups = {t: -(-n // room(t, tokens, tiers)) for t, n in sorted(total.items())}
    for t, g in groups.items():
        first[t], before[t] = sum(n for x, n in groups.items() if x < t), 0
    out = []
    for size, _ in windows:
        t = tier_of(size, tiers)
        out.append(first[t] + before[t] * groups[t] // total[t])
        before[t] += size
    return out


def dealt(pieces: DataFrame, step_tokens: int = STEP_TOKENS, tiers=TIERS) -> DataFrame:
    """The pieces with the step group of their window among all windows: ``step_groups`` over the windows in order of partition. Columns
    part, tier and before (tokens of the tier's earlier windows in the partition) are used up."""
    own = pieces.groupBy("tier", "part").agg(F.max(F.col("before") + F.col("context")).alias("n"))
    own = own.withColumn("at", F.sum("n").over(W.partitionBy("tier").orderBy("part")) - F.col("n"))  # a row a partition
    least = F.when(F.col("tier") > 0, room(tiers[0], step_tokens, tiers)).otherwise(room(0, step_tokens, tiers))
    totals = own.groupBy("tier").agg(F.sum("n").alias("total")).withColumn("groups", F.ceil(F.col("total") / least))
    totals = totals.withColumn("first", F.sum("groups").over(W.orderBy("tier")) - F.col("groups"))  # a row a tier
    places = own.join(F.broadcast(totals), "tier").select("tier", "part", "at", "total", "groups", "first")  # totals: five rows
    places = F.broadcast(places) if pieces.select("tier", "part").distinct().count() <= BROADCAST_ROWS else places
    big = lambda c: F.col(c).cast("decimal(18,0)")
    placed = pieces.join(places, ["tier", "part"]).withColumn("at", F.col("at") + F.col("before"))
    placed = placed.select(*pieces.columns, "first", big("at").alias("x"), big("groups").alias("g"), big("total").alias("t"))
    return placed.withColumn("step_group", F.expr("first + (x * g) div t")).drop("part", "tier", "before", "first", "x", "g", "t")


def packed(docs: DataFrame, path: str, tiers=TIERS, step_tokens: int = STEP_TOKENS) -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and context, step_group.

    A null or empty text is the end id alone. A repeated row is a document of its own; a null doc_id stays null; other columns are not
    looked at; an empty table gives no rows. A sequence_id holds the partition, the batch and the window. Step groups count from 0.
    """

    struct = _parse_datatype_string(PIECES)

    def run(batches):
        words, part, seen, arrow = words_of(path), TaskContext.get().partitionId(), {}, to_arrow_schema(struct)

        def rows(windows, docs, first):
            """``docs``: (doc_id, ids before, ids as bytes, tokens of the document)."""
            if len(windows) >= 1 << 24:
                raise ValueError("a batch has more windows than a sequence_id can name")
            for k, (size, pieces) in enumerate(windows):
                offset, tier = 0, tier_of(size, tiers)
                before = seen.get(tier, 0)
                seen[tier] = before + size
                for d, s, n in pieces:
                    doc_id, start, ids, total = docs[d]
                    yield doc_id, start + s, n, zlib.crc32(ids[4 * s : 4 * (s + n)]), total, first + k, offset, size, part, tier, before
                    offset += n

        def batch_of(found):
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), arrow)], schema=arrow)

        left, number = [], 0
        for batch in batches:
            docs = left + [(d, 0, ids, len(ids) // 4) for d, ids in zip(batch.column(0).to_pylist(), words.encoded(as_bytes(batch.column(1))))]
            windows, rest = filled([len(x[2]) // 4 for x in docs], tiers)
            if found := list(rows(windows, docs, (part << 40) + (number << 24))):
                yield batch_of(found)
            left = [(docs[d][0], docs[d][1] + s, docs[d][2][4 * s : 4 * (s + n)], docs[d][3]) for d, s, n in rest]
            number += 1
        if left:
            windows = laid_out([(d, 0, len(x[2]) // 4) for d, x in enumerate(left)], tiers)
            yield batch_of(rows(windows, left, (part << 40) + (number << 24)))

    small_batches(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return dealt(written(own.mapInArrow(run, struct)), step_tokens, tiers)
