"""Quality rules with an isolation forest over rule statistics.

Liu, Ting and Zhou, "Isolation Forest" (2008): random splits isolate odd rows early, so a short mean path marks an anomaly.
The forest is fitted on a bounded sample of labelled rows (``SAMPLE``): each tree on good rows and CONTAMINATION of bad ones. The
threshold is the score that GOOD_LOSS of the sample's good rows exceed; bad rows only say whether there is anything to reject. Statistics, scores and verdicts cover every row and whole texts.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import _BLANK, as_bytes, code_points, map_batches, window_hashes, word_hashes

#: Labelled rows at most that the forest and its threshold are fitted on (those of the smallest hash).
SAMPLE = 20_000
TREES, ROWS_PER_TREE = 100, 256
#: Share of rows labelled bad among those a tree is grown on; rare rows of another kind are what splits isolate.
CONTAMINATION = 0.012
#: Share of labelled good rows that the threshold may reject.
GOOD_LOSS = 0.002
_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_MARK = np.zeros(256, bool)
_MARK[list(b"!?~^")] = True
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(words: np.ndarray, width: int = 8) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the text."""
    windows = window_hashes(words, width)
    if not len(windows):
        return 0
    _, back, counts = np.unique(windows, return_inverse=True, return_counts=True)
    steps = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(counts[back] > 1)
    steps[at] += 1
    np.subtract.at(steps, at + width, 1)
    return int(np.count_nonzero(np.cumsum(steps)[:-1]))


def duplicate_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip(b" \t\r\v\f")]
    return len(lines) - len(set(lines))


def statistics(text: bytes) -> tuple[tuple[int, ...], list[float]]:
    """The five counted statistics, and the ratios that the forest sees (repeats have a rule of their own, so they are not among them)."""
    data = np.frombuffer(text, np.uint8)
    words = word_hashes(text, lower=False)
    n = len(words)
    chars = code_points(data) - int(np.count_nonzero(_BLANK[data]))
    symbols, dup = int(np.count_nonzero(_SYMBOL[data])), duplicate_lines(text)
    repeat = repeated_words(words)
    size, each = max(1, chars), max(1, n)
    seen = [
        min(chars / each, 20.0), math.sqrt(symbols / size), int(np.count_nonzero(_UPPER[data])) / size, math.sqrt(int(np.count_nonzero(_MARK[data])) / size), len(np.unique(words)) / each ** 0.85,
    ]
    return (n, chars, symbols, dup, repeat), seen


def base_failed(n_words: int, n_repeat: int) -> bool:
    return n_words < 20 or 100 * n_repeat > 30 * n_words


@dataclass
class Forest:
    """Trees as arrays: split feature (-1 at a leaf), split value, left child (right is left + 1), path length at a leaf."""

    feature: np.ndarray
    value: np.ndarray
    left: np.ndarray
    path: np.ndarray
    usual: float
    threshold: float = 1.0

    def score(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (-mean path / usual path): near 1 is odd, under 0.5 is normal."""
        total = np.zeros(len(rows))
        each = np.arange(len(rows))
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            while True:
                feature = self.feature[t][at]
                inner = feature >= 0
                if not inner.any():
                    break
                right = rows[each, np.maximum(feature, 0)] >= self.value[t][at]
                at = np.where(inner, self.left[t][at] + right, at)
            total += self.path[t][at]
        return 2.0 ** (-total / len(self.feature) / self.usual)


def average_path(n: int) -> float:
    """Mean path of an unsuccessful search in a binary search tree of n keys."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n


def grow(good: np.ndarray, bad: np.ndarray, seed: int = 7) -> Forest:
    """A forest of random trees, each over good rows and a few bad ones; a split's value is drawn between a feature's least and greatest value."""
    rng = np.random.default_rng(seed)
    few = min(len(bad), int(CONTAMINATION * ROWS_PER_TREE))
    most = min(ROWS_PER_TREE - few, len(good))
    m = few + most
    deepest = math.ceil(math.log2(max(2, m)))
    width = 4 * ROWS_PER_TREE
    feature, left = np.full((TREES, width), -1), np.zeros((TREES, width), np.int64)
    value, path = np.zeros((TREES, width)), np.zeros((TREES, width))
    for t in range(TREES):
        own = np.concatenate([good[rng.choice(len(good), most, replace=False)], bad[rng.choice(len(bad), few, replace=False)] if few else bad])
        free, todo = 1, [(0, own, 0)]
        while todo:
            node, own, depth = todo.pop()
            low, high = own.min(0), own.max(0)
            split = np.flatnonzero(high > low)
            if depth >= deepest or len(own) < 2 or not len(split):
                path[t, node] = depth + average_path(len(own))
                continue
            f = rng.choice(split)
            cut = rng.uniform(low[f], high[f])
            right = own[:, f] >= cut
            if right.all():
                path[t, node] = depth + average_path(len(own))
                continue
            feature[t, node], value[t, node], left[t, node] = f, cut, free
            todo += [(free, own[~right], depth + 1), (free + 1, own[right], depth + 1)]
            free += 2
    return Forest(feature, value, left, path, average_path(m))


def fit(rows: np.ndarray, good: np.ndarray) -> Forest | None:
    """Grow the forest. The threshold is the quantile of the good rows' scores that loses GOOD_LOSS of them; where no bad row is above it, it
    is the greatest score, so that nothing is rejected."""
    if good.sum() < 2:
        return None
    forest = grow(rows[good], rows[~good])
    scores = forest.score(rows)
    floor = float(np.quantile(scores[good], 1 - GOOD_LOSS, method="higher"))
    bad = scores[~good]
    forest.threshold = floor if len(bad) and (bad > floor).any() else float(scores.max())
    return forest


def fitted(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Forest | None:
    """Collects the statistics of ``sample`` labelled rows at most: the only rows that reach the driver."""
    own = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_quality")).dropna().dropDuplicates(["_id"])
    own = own.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(own), F.col("doc_id") == F.col("_id")).select("_quality", "text")

    def make():
        def f(quality, text):
            seen = [statistics(x) for x in as_bytes(text)]
            return quality, [base_failed(s[0], s[4]) for s, _ in seen], [v for _, v in seen]

        return f

    got = map_batches(rows, "quality int, failed boolean, seen array<double>", make).toPandas()
    got = got[~got.failed.astype(bool)].sort_values("seen", key=lambda c: c.map(tuple))
    return fit(np.array(got.seen.tolist()), got.quality.to_numpy() == 1) if len(got) else None


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the five statistics, base_failed, kept, score.

    A null text is an empty one and fails. Without two good labelled rows there is no forest and the rules alone decide. Repeated
    rows give repeated rows; a null doc_id stays null; other columns of the inputs are not looked at.
    """
    forest = fitted(docs, labels, sample)
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def make():
        model = shared.value

        def f(doc_id, text):
            seen = [statistics(x) for x in as_bytes(text)]
            counts = list(zip(*(s for s, _ in seen)))
            failed = [base_failed(s[0], s[4]) for s, _ in seen]
            score = model.score(np.array([v for _, v in seen])) if model else np.zeros(len(seen))
            odd = score > (model.threshold if model else 1.0)
            return doc_id, *counts, failed, [not b and not o for b, o in zip(failed, odd.tolist())], score

        return f

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), f"doc_id long, {STATS}, base_failed boolean, kept boolean, score double", make)


def kept_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs`` that the rules and the forest keep, with all their columns; texts are judged where they lie."""
    shared, columns = docs.sparkSession.sparkContext.broadcast(fitted(docs, labels, sample)), docs.columns

    def make():
        model, at = shared.value, columns.index("text")

        def f(*own):
            seen = [statistics(x) for x in as_bytes(own[at])]
            good = np.array([not base_failed(s[0], s[4]) for s, _ in seen])
            if model:
                good &= model.score(np.array([v for _, v in seen])) <= model.threshold
            keep = pa.array(good)
            return [c.filter(keep) for c in own]

        return f

    return map_batches(docs, ", ".join(f"`{n}` {t}" for n, t in docs.dtypes), make)
