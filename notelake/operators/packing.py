"""Messages of one key packed into chunks, where one key may hold most of the table.

A chunk's end follows from its start: the first message that no longer fits. Within a segment of messages these pointers give, from its end
back, where a chunk that starts at any message leaves the segment, and with how many characters in its last, open chunk. How full the open
chunk is that enters a segment decides which message overflows it, so a segment is a small map from fillings to fillings. The maps are
chained along the key, and then every segment numbers its own messages.
"""

from __future__ import annotations

import bisect
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions.helpers import chunk_text
from notelake.operators.ranks import ranked
from notelake.sources.scratch import written

#: Messages of a segment; more than fit in one chunk, so that a chunk lies in two segments at most, or all of a short segment.
SEGMENT = 8192


class Segment:
    """The messages of a segment: lengths, and the number of pieces of an oversized one (0: it fits a chunk)."""

    def __init__(self, lengths: list[int], pieces: list[int], most: int):
        self.pieces, self.most, self.n = pieces, most, len(lengths)
        self.sums = [0, *accumulate(x + 2 for x in lengths)]  # each message with the two line ends before it

    def over(self, start: int, held: int) -> int:
        """The first message from ``start`` on that doesn't fit with ``held`` characters (0: an empty chunk); an oversized one never fits."""
        room = self.most - held if held else self.most + 2  # the first message of a chunk has no line ends before it
        return bisect.bisect_right(self.sums, self.sums[start] + room) - 1

    def tails(self) -> tuple[list[int], list[int]]:
        """For each message that begins a chunk: the filling that leaves the segment, and the chunks closed from there on."""
        left, closed = [0] * (self.n + 1), [0] * (self.n + 1)
        for k in range(self.n - 1, -1, -1):
            end = k + 1 if self.pieces[k] else self.over(k, 0)
            if self.pieces[k]:
                left[k], closed[k] = left[end], closed[end] + self.pieces[k]
            elif end == self.n:
                left[k] = self.sums[end] - self.sums[k] - 2
            else:
                left[k], closed[k] = left[end], closed[end] + 1
        return left, closed

    def map(self) -> tuple[list[int], list[int], list[int]]:
        """(room, left, closed) by the message k that overflows the open chunk, which is the last whose room isn't below its filling."""
        left, closed = self.tails()
        reach = self.over(0, 1) + 1  # an open chunk holds a character at least
        return [self.most - x for x in self.sums[:reach]], left[:reach], closed[:reach]

    def parts(self, held: int, part: int) -> list[tuple[int, bool]]:
        """(number of the chunk, whether it is cut on its own) of each message, where ``part`` chunks are closed and one of ``held`` is open."""
        out, k = [], 0
        while k < self.n:
            end = self.over(k, held)
            out.extend([(part + 1, False)] * (end - k))
            if end == self.n:
                break
            part += bool(held or end > k)
            held, k = 0, end
            if self.pieces[k]:
                out.append((part + 1, True))
                part, k = part + self.pieces[k], k + 1
        return out


def step(held: int, part: int, room, left, closed, total: int, n: int) -> tuple[int, int]:
    """(filling, closed chunks) after a segment."""
    if not held:
        return int(left[0]), part + int(closed[0])
    k = sum(1 for x in room if x >= held) - 1
    return (held + total, part) if k == n else (int(left[k]), part + 1 + int(closed[k]))


def pack_long(messages: DataFrame, keys: list[str], most: int, whole: bool = False) -> DataFrame:
    """keys, part, content of (keys, pos, text): whole messages packed up to ``most`` characters, an oversized one cut on its own, or left ``whole``."""
    own = F.array("text") if whole else chunk_text(F.col("text"), most)
    cut = F.when(F.length("text") > most, F.size(own)).otherwise(0)
    placed = written(ranked(messages, keys, [F.asc("pos"), F.asc(F.substring("text", 1, 256)), F.asc(F.xxhash64("text"))], "_n").withColumn("_pieces", cut).withColumn("_key", F.xxhash64(*keys)))
    seg = F.floor((F.col("_n") - 1) / SEGMENT).alias("_seg")
    lists = placed.select(*keys, "_n", F.length("text").alias("l"), F.col("_pieces").alias("p"), seg).groupBy(*keys, "_seg").agg(F.array_sort(F.collect_list(F.struct("_n", "l", "p"))).alias("m"))
    lists = written(lists.select(*keys, "_seg", F.transform("m", lambda x: x["l"]).alias("lengths"), F.transform("m", lambda x: x["p"]).alias("pieces")))
    kinds = dict(messages.dtypes)
    named = ", ".join(f"`{k}` {kinds[k]}" for k in keys)

    def maps(frames):
        for f in frames:
            rows = []
            for own, lengths, pieces in zip(f[[*keys, "_seg"]].itertuples(index=False, name=None), f["lengths"], f["pieces"]):
                s = Segment(list(map(int, lengths)), list(map(int, pieces)), most)
                rows.append((*own, *s.map(), s.sums[-1], s.n))
            yield pd.DataFrame(rows, columns=[*keys, "_seg", "room", "left", "closed", "total", "n"])

    def chain(frame):
        held, part, out = 0, 0, []
        for *own, seg, room, left, closed, total, n in frame.sort_values("_seg")[[*keys, "_seg", "room", "left", "closed", "total", "n"]].itertuples(index=False, name=None):
            out.append((*own, seg, held, part))
            held, part = step(held, part, room, left, closed, int(total), int(n))
        return pd.DataFrame(out, columns=[*keys, "_seg", "held", "part"])

    def numbered(frames):
        for f in frames:
            rows = []
            for own, lengths, pieces, held, part in zip(f[[*keys, "_seg"]].itertuples(index=False, name=None), f["lengths"], f["pieces"], f["held"], f["part"]):
                got = Segment(list(map(int, lengths)), list(map(int, pieces)), most).parts(int(held), int(part))
                rows.append((*own, [p for p, _ in got], [b for _, b in got]))
            yield pd.DataFrame(rows, columns=[*keys, "_seg", "parts", "alone"])

    segment_maps = lists.mapInPandas(maps, f"{named}, _seg long, room array<long>, left array<long>, closed array<long>, total long, n int")
    begun = segment_maps.groupBy(*keys).applyInPandas(chain, f"{named}, _seg long, held long, part long")
    same = [lists[k].eqNullSafe(begun[k]) for k in keys] + [lists["_seg"] == begun["_seg"]]
    both = lists.join(begun, same).select(*(lists[k] for k in keys), lists["_seg"], "lengths", "pieces", "held", "part")
    numbers = both.mapInPandas(numbered, f"{named}, _seg long, parts array<long>, alone array<boolean>")
    each = numbers.select(F.xxhash64(*keys).alias("_key"), *(F.col(k).alias(f"_k_{k}") for k in keys), (F.col("_seg") * SEGMENT + 1).alias("_base"), F.posexplode(F.arrays_zip("parts", "alone")).alias("_i", "x"))
    each = each.select("_key", *(f"_k_{k}" for k in keys), (F.col("_base") + F.col("_i")).alias("_n"), F.col("x.parts").alias("part"), "x.alone")
    met = placed.join(each, ["_key", "_n"])
    for k in keys:
        met = met.filter(F.col(k).eqNullSafe(F.col(f"_k_{k}")))
    whole = met.filter("NOT alone").groupBy(*keys, "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "text"))), lambda x: x["text"]), "\n\n").alias("content"))
    alone = met.filter("alone").select(*keys, "part", F.posexplode(own).alias("_i", "content"))
    return whole.select(*keys, F.col("part").cast("int").alias("part"), "content").unionByName(alone.select(*keys, (F.col("part") + F.col("_i")).cast("int").alias("part"), "content"))
