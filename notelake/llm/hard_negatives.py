"""Hard negatives from an inverted multi-index.

Babenko and Lempitsky, "The Inverted Multi-Index" (2012): each half of the vectors has a codebook; a row lies in the cell of its two
codewords. For an anchor each codeword bounds the scores of its half from both sides, by the score of the codeword, plus or minus the
anchor's length times the codeword's radius; a heap gives the cells by the summed upper bounds of their halves (the multi-sequence algorithm). Rows of visited cells are scored
exactly. A search ends when the next bound can't reach what is kept; cells that lie above all windows aren't scored. Codebooks are fitted on a bounded
sample; every row is indexed, and results don't depend on the codebooks.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm import vectors as V
from notelake.llm.text import written

#: Codewords of a half, rows that codebooks are fitted on (those of least hash), rounds of fitting, and rows scored at once.
CODEWORDS, SAMPLE, ROUNDS, SCORED = 8, 8192, 8, 1024
POSITIVE = "anchor_id long, key long, positive_id long, positive_score long"
NEGATIVE = "anchor_id long, key long, positive_id long, positive_score long, negative_id long, negative_score long"


def fitted(sample: np.ndarray) -> np.ndarray:
    """A codebook by Lloyd's rounds from evenly spread rows."""
    rows = np.unique(sample, axis=0)
    words = rows[np.linspace(0, len(rows) - 1, min(CODEWORDS, len(rows))).astype(int)].astype(float) if len(rows) else np.zeros((1, sample.shape[1]))
    for _ in range(ROUNDS if len(rows) else 0):
        own = nearest(rows, words)
        for k in range(len(words)):
            if (own == k).any():
                words[k] = rows[own == k].mean(axis=0)
    return words


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    return np.argmin((words**2).sum(axis=1) - 2 * rows @ words.T, axis=1)


class MultiIndex:
    """The cells of a block of rows; radii are those of the block's own rows."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, labels: np.ndarray, books: list[np.ndarray]):
        half = books[0].shape[1]
        own = [nearest(part, book) for part, book in zip((rows[:, :half], rows[:, half:]), books)]
        self.radii = []
        for part, book, code in zip((rows[:, :half], rows[:, half:]), books, own):
            far = np.zeros(len(book))
            np.maximum.at(far, code, np.sqrt(((part - book[code]) ** 2).sum(axis=1)))
            self.radii.append(far)
        self.books, self.half = books, half
        cell = own[0] * len(books[1]) + own[1]
        order = np.lexsort((ids, cell))
        self.ids, self.rows, self.labels = ids[order], rows[order], labels[order]
        shape = (len(books[0]), len(books[1]))
        self.starts = np.searchsorted(cell[order], np.arange(shape[0] * shape[1] + 1)).tolist()
        self.shape, self.present = shape, [np.unique(x) for x in own]

    def visit(self, query: np.ndarray, keep, floor, ceiling=np.inf) -> None:
        """``keep(ids, labels, scores)`` for rows of cells by descending bound, until ``floor()`` is above the next one; cells wholly above
        ``ceiling`` aren't scored."""
        sides = []
        for part, book, radii, there in zip((query[: self.half], query[self.half :]), self.books, self.radii, self.present):
            middle, reach = book[there] @ part, np.sqrt(part @ part) * radii[there]
            order = np.argsort(-(middle + reach), kind="stable")
            sides.append((there[order].tolist(), (middle + reach)[order].tolist(), (middle - reach)[order].tolist()))
        (us, u_most, u_least), (vs, v_most, v_least) = sides
        loose = 1e-9 * (1 + float(np.abs(query).sum()) * float(np.abs(self.rows).max(initial=0)))  # rounding of the bounds
        heap, seen, spans, n = ([(-(u_most[0] + v_most[0]), 0, 0)] if us and vs else []), {(0, 0)}, [], 0

        def score():
            places = np.concatenate([np.arange(a, b) for a, b in spans])
            keep(self.ids[places], self.labels[places], V.scores(self.rows[places], query))
            spans.clear()

        limit = floor()
        while heap:
            bound, i, j = heapq.heappop(heap)
            if -bound + loose < limit:
                break
            cell = us[i] * self.shape[1] + vs[j]
            a, b = self.starts[cell], self.starts[cell + 1]
            if b > a and u_least[i] + v_least[j] - loose <= ceiling:
                spans.append((a, b))
                n += b - a
                if n >= SCORED:
                    score()
                    n, limit = 0, floor()
            for x, y in ((i + 1, j), (i, j + 1)):  # a cell enters once one of its two forerunners has left
                if x < len(us) and y < len(vs) and (x, y) not in seen:
                    seen.add((x, y))
                    heapq.heappush(heap, (-(u_most[x] + v_most[y]), x, y))
        if spans:
            score()


class Anchors:
    """The anchors of a cell, and what was found for them."""

    def __init__(self, table: pa.Table, books, names: list[str]):
        self.ids, self.keys, self.labels, self.vectors = (table["id"].to_numpy(), table["key"].to_numpy(), table["label"].to_numpy(), V.numbers(table["v"]))
        self.books, self.names = books, names

    def blocks(self, table: pa.Table):
        width = sum(b.shape[1] for b in self.books)
        rows = V.fitted(V.numbers(table["v"]), width)
        return table["id"].to_numpy(), rows, table["label"].to_numpy(), V.fitted(self.vectors, width)

    def batch(self, columns):
        if columns and len(columns[0]):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=self.names)


class Positives(Anchors):
    """The k best other rows of each anchor's label; a block is indexed label by label."""

    def __init__(self, table, books, k):
        super().__init__(table, books, [x.split(" ")[0] for x in POSITIVE.split(", ")])
        self.k, self.kept = k, [(np.empty(0, np.int64), np.empty(0, np.int64))] * len(self.ids)

    def add(self, table):
        ids, rows, labels, asked = self.blocks(table)
        for label in np.unique(self.labels):
            own = labels == label
            if own.any():
                index = MultiIndex(ids[own], rows[own], labels[own], self.books)
                for j in np.flatnonzero(self.labels == label):
                    self.search(index, j, asked[j])

    def search(self, index, j, query):
        def keep(ids, _, found):
            other = ids != self.ids[j]
            self.kept[j] = V.best(np.concatenate([self.kept[j][0], ids[other]]), np.concatenate([self.kept[j][1], found[other]]), self.k)

        index.visit(query, keep, lambda: self.kept[j][1][-1] if len(self.kept[j][1]) == self.k else -np.inf)

    def found(self):
        sizes = [len(x) for x, _ in self.kept]
        yield from self.batch([np.repeat(self.ids, sizes), np.repeat(self.keys, sizes), *(np.concatenate([x[i] for x in self.kept]) for i in (0, 1))] if sizes else [])


class Negatives(Anchors):
    """The k best rows of other labels within each positive's window of scores."""

    def __init__(self, table, books, k, least, most):
        super().__init__(table, books, [x.split(" ")[0] for x in NEGATIVE.split(", ")])
        self.k, self.windows = k, [[(p["score"], p["id"], -(-least * p["score"] // 100), most * p["score"] // 100) for p in own] for own in table["positives"].to_pylist()]
        self.kept = [[(np.empty(0, np.int64), np.empty(0, np.int64))] * len(w) for w in self.windows]

    def add(self, table):
        ids, rows, labels, asked = self.blocks(table)
        index = MultiIndex(ids, rows, labels, self.books)
        for j, windows in enumerate(self.windows):
            if any(low <= high for *_, low, high in windows):
                self.search(index, j, asked[j], windows)

    def search(self, index, j, query, windows):
        kept = self.kept[j]

        def keep(ids, labels, found):
            other = labels != self.labels[j]
            ids, found = ids[other], found[other]
            for w, (*_, low, high) in enumerate(windows):
                fits = (found >= low) & (found <= high)
                if len(kept[w][1]) == self.k:
                    fits &= found >= kept[w][1][-1]
                if fits.any():
                    kept[w] = V.best(np.concatenate([kept[w][0], ids[fits]]), np.concatenate([kept[w][1], found[fits]]), self.k)

        # A window is certified once its k-th score is above all bounds that are left.
        floor = lambda: min((max(low, kept[w][1][-1]) if len(kept[w][1]) == self.k else low) for w, (*_, low, high) in enumerate(windows) if low <= high)
        index.visit(query, keep, floor, max(high for *_, high in windows))

    def found(self):
        rows = [(self.ids[j], self.keys[j], p, s, i, n) for j, own in enumerate(self.windows) for (s, p, *_), got in zip(own, self.kept[j]) for i, n in zip(*got)]
        yield from self.batch([np.array(c, np.int64) for c in zip(*rows)])


def codebooks(rows: DataFrame) -> list[np.ndarray]:
    """Two codebooks for the halves of all vectors, fitted on SAMPLE rows of least hash."""
    width = rows.agg(F.max(F.size("v"))).first()[0] or 1
    sample = rows.orderBy(F.xxhash64("id", "key"), "id").select("v").limit(SAMPLE).toArrow()
    own = V.fitted(V.numbers(sample["v"]), width) if sample.num_rows else np.zeros((0, width))
    return [fitted(own[:, : width // 2]), fitted(own[:, width // 2 :])]


def hard_negatives(rows: DataFrame, label: Column, is_anchor: Column, vec_id: str = "vec_id", vector: str = "embedding", positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90) -> DataFrame:
    """anchor_id, positive_id, rank (int, from 1), negative_id, positive_score, negative_score: for each anchor and each of its best
    ``positives`` other rows of the same label, the best ``negatives`` rows of other labels whose score lies between ``least`` and ``most`` per
    cent of the positive's. Scores are inner products of floor(256 * x); ties go to the smaller vec_id.

    Rows without vec_id or label, and vectors that are null or hold null or non-finite components, take no part. Rows of an anchor's own
    vec_id aren't its positives; a repeated row stands as often as it is there, but a repeated anchor answers once, and a positive that is
    there twice, with the same score, gives its negatives once. A positive score of 0 or less leaves a window of at most one score. A shorter vector counts as
    one that ends in zeros; an empty table gives no rows. Other columns aren't looked at.
    """
    df = rows.select(F.col(vec_id).alias("_id"), F.col(vector).alias("_v"), label.alias("_label"), is_anchor.alias("_is"))
    scaled = lambda part: V.scaled(part, F.col("_id"), F.col("_v"), F.col("_label")).filter("label IS NOT NULL")
    all_rows = scaled(df)
    anchors = scaled(df.filter("_is")).dropDuplicates(["id", "label", "v"])
    books = codebooks(all_rows)
    near = V.meet(anchors, all_rows, lambda: lambda table: Positives(table, books, positives), POSITIVE)
    rank = lambda by, score, other: F.row_number().over(W.partitionBy("anchor_id", "key", *by).orderBy(F.desc(score), other))
    near = near.withColumn("_r", rank([], "positive_score", "positive_id")).filter(F.col("_r") <= positives)
    own = near.groupBy(F.col("anchor_id").alias("id"), "key").agg(F.array_sort(F.collect_set(F.struct(F.col("positive_score").alias("score"), F.col("positive_id").alias("id")))).alias("positives"))
    asked = written(anchors.join(own, ["id", "key"]))
    found = V.meet(asked, all_rows, lambda: lambda table: Negatives(table, books, negatives, least, most), NEGATIVE)
    found = found.withColumn("rank", rank(["positive_id", "positive_score"], "negative_score", "negative_id")).filter(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
