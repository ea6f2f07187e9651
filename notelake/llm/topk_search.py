"""Exact top-k search by aggregation without random access.

Fagin, Lotem and Naor, "Optimal Aggregation Algorithms for Middleware" (2001), NRA: each dimension of a block of rows is a list sorted by
value. A query reads the lists in turn, from the end at which its own component gives most. A row has a lower bound (what was read of it,
and the least that each unread list can give) and an upper bound (what was read, and the list's frontier for each unread one). When no
more than a few rows can still reach the k-th best lower bound, all others are out, and the scores of the few are resolved. The k-th best
score of earlier blocks is a floor for later ones. Which piece of which list is read next follows the fall of the upper bounds that it
brings, so lists of small components are read late or never.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm import vectors as V

#: Pieces that a list is read in; rows that may be left to be resolved, as a share of the block.
PIECES, RESOLVED = 16, 8
#: Share of the pieces read before bounds are looked at; rows of a first short block, which gives a floor to the others.
FIRST, HEAD = 0.5, 512
FOUND = "query_id long, key long, vec_id long, score long"


class Lists:
    """The sorted lists of a block of rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        self.ids, self.rows, (self.n, self.width) = ids, rows, rows.shape
        step = -(-self.n // PIECES)
        pad = step * PIECES - self.n
        order = np.argsort(-rows, axis=0, kind="stable").T
        values = np.take_along_axis(rows.T, order, 1)
        shape = (self.width * PIECES, step)
        self.places = np.pad(order, ((0, 0), (0, pad)), constant_values=self.n).reshape(shape)  # the place after the last row is nobody's
        self.values = np.pad(values, ((0, 0), (0, pad)), mode="edge").reshape(shape)
        self.ends = self.values.reshape(self.width, PIECES, step)[:, :, [0, -1]]
        self.piece = np.empty((self.width, self.n), np.int16)  # of each row in each list: marks it as read once the piece is
        np.put_along_axis(self.piece, order, np.broadcast_to(np.arange(self.n, dtype=np.int16) // np.int16(step), order.shape), 1)

    def top(self, query: np.ndarray, own: int, floor: float, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(ids, scores, entries read) of the k best rows that are not of id ``own``; those below ``floor`` may be left out."""
        up = query >= 0
        first = np.where(up[:, None], self.ends[:, :, 0], self.ends[:, ::-1, 1]) * query[:, None]  # most that a piece can give, in the order of reading
        least = np.where(up, self.ends[:, -1, 1], self.ends[:, 0, 0]) * query
        front = np.concatenate([first, least[:, None]], axis=1)
        fall = np.minimum.accumulate((front[:, :-1] - front[:, 1:]) * np.arange(PIECES, 0, -1), axis=1)
        plan = np.argsort(-fall, axis=None, kind="stable")
        lists, pieces = np.divmod(plan, PIECES)
        pieces = np.where(up[lists], pieces, PIECES - 1 - pieces) + lists * PIECES
        sums, others = np.zeros(self.n + 1), self.ids != own
        loose = V.slack(self.rows, query) + 1e-6 * float(np.abs(front[:, [0, -1]]).max(axis=1).sum())  # open bounds are summed in short floats
        at, left = 0, others
        while at < len(plan):
            to = min(len(plan), at + (int(len(plan) * FIRST) if not at else len(plan) // 8) or len(plan))
            new = pieces[at:to]
            weights = self.values[new]
            weights *= query[lists[at:to], None]
            sums += np.bincount(self.places[new].ravel(), weights.ravel(), self.n + 1)
            at = to
            depth = np.bincount(lists[:at], minlength=self.width)
            frontier = front[np.arange(self.width), depth]
            low, high = np.where(up, depth, 0).astype(np.int16), np.where(up, PIECES, PIECES - depth).astype(np.int16)
            unread = (self.piece >= low[:, None]) & (self.piece < high[:, None])
            open_ = np.stack([frontier, least]).astype(np.float32) @ unread.astype(np.float32)
            upper, lower = sums[:-1] + open_[0] + loose, sums[:-1] + open_[1] - loose
            safe = lower[others]
            least_best = max(floor, np.partition(safe, -k)[-k]) if len(safe) >= k else floor
            left = others & (upper >= least_best)  # equal scores may win by their id
            if left.sum() <= max(4 * k, self.n // RESOLVED):
                break
        where = np.flatnonzero(left)
        found = V.scores(self.rows[where], query)
        return *V.best(self.ids[where], found, k), at * self.places.shape[1]


class Search:
    """The k best rows of each query of a cell."""

    def __init__(self, queries: pa.Table, k: int):
        self.ids, self.keys, self.vectors, self.k = queries["id"].to_numpy(), queries["key"].to_numpy(), V.numbers(queries["v"]), k
        self.kept = [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def add(self, table: pa.Table) -> None:
        rows = V.numbers(table["v"])
        if not rows.shape[1]:
            rows = np.zeros((len(rows), 1))
        ids, asked = table["id"].to_numpy(), V.fitted(self.vectors, rows.shape[1])
        first = 0 if any(len(x) for x, _ in self.kept) else HEAD
        for a, b in ((0, first), (first, len(ids))):
            if a < min(b, len(ids)):
                self.read(Lists(ids[a:b], rows[a:b]), asked)

    def read(self, lists: Lists, asked: np.ndarray) -> None:
        for j, (ids, found) in enumerate(self.kept):
            floor = float(found[-1]) if len(found) == self.k else -np.inf
            more, new, _ = lists.top(asked[j], self.ids[j], floor, self.k)
            self.kept[j] = V.best(np.concatenate([ids, more]), np.concatenate([found, new]), self.k)

    def found(self):
        sizes = [len(ids) for ids, _ in self.kept]
        if sum(sizes):
            columns = [np.repeat(self.ids, sizes), np.repeat(self.keys, sizes), *(np.concatenate([x[i] for x in self.kept]) for i in (0, 1))]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["query_id", "key", "vec_id", "score"])


def top_scores(rows: DataFrame, is_query: Column, vec_id: str = "vec_id", vector: str = "embedding", k: int = 5) -> DataFrame:
    """query_id, rank (int, from 1), vec_id, score: of each row of ``is_query`` the k rows of highest inner product of floor(256 * x).

    All rows but those of the query's own vec_id are candidates; ties go to the smaller vec_id. Rows without a vec_id, and vectors that are null
    or hold null or non-finite components, take no part. A repeated row stands as often as it is there; a repeated query row answers once,
    query rows of one vec_id with different vectors each on their own. A shorter vector counts as one that ends in zeros; an empty table
    gives no rows. Other columns aren't looked at.
    """
    df = rows.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v"), is_query.alias("_is"))
    all_rows = V.scaled(df, F.col("_id"), F.col("_v"))
    asked = V.scaled(df.filter("_is"), F.col("_id"), F.col("_v")).dropDuplicates(["id", "v"])
    local = V.meet(asked, all_rows, lambda: lambda queries: Search(queries, k), FOUND)
    rank = F.row_number().over(W.partitionBy("query_id", "key").orderBy(F.desc("score"), "vec_id"))
    return local.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
