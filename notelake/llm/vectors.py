"""A stated set of query vectors against all vectors of a table, in cells of bounded groups.

Components become whole numbers, floor(256 * x). A table's rows lie in groups by a hash of their id, and so do the queries; each pair of
groups is one cell, which a task works through with its queries in memory and the rows streaming by in blocks. A hot vector or label is
no group: only the hash of the id decides.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a block, of the smallest and of the greatest group, queries of a group, and groups that a table is cut into between those.
BLOCK, LEAST_GROUP, MOST_GROUP, QUERY_GROUP, GROUPS = 4096, 4096, 1 << 18, 4096, 256
#: Whole numbers that doubles hold exactly.
EXACT = float(1 << 53)


def scaled(df: DataFrame, vec_id: Column, vector: Column, label: Column | None = None) -> DataFrame:
    """(id, key, label, v) of the rows that take part: an id, and a vector without null or non-finite components. ``key`` tells rows of one id
    apart by what they hold. A component past the ends of a long counts as that end."""
    x = vector.cast("array<double>")
    rows = df.select(vec_id.cast("long").alias("id"), (F.lit(None) if label is None else label).cast("long").alias("label"), x.alias("_x"))
    fine = F.forall("_x", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = rows.filter(F.col("id").isNotNull() & F.col("_x").isNotNull() & fine)
    v = F.transform("_x", lambda c: F.floor(c * F.lit(256.0)))
    return rows.select("id", "label", v.alias("v")).withColumn("key", F.xxhash64("label", "v"))


def numbers(column) -> np.ndarray:
    """Vectors as rows of a matrix of doubles; shorter ones end in zeros."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = lists.offsets.to_numpy()
    flat = lists.values.to_numpy()[ends[0] : ends[-1]].astype(float)
    sizes = np.diff(ends)
    width = int(sizes.max(initial=0))
    if (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1] - ends[0], sizes)] = flat
    return out


def fitted(vectors: np.ndarray, width: int) -> np.ndarray:
    """The same vectors with ``width`` components; what is cut meets zeros only."""
    n = vectors.shape[-1]
    return vectors[..., :width] if n >= width else np.concatenate([vectors, np.zeros((*vectors.shape[:-1], width - n))], axis=-1)


def scores(rows: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products as whole numbers; past the ends of a long they count as that end."""
    if np.abs(rows).max(initial=0) * np.abs(query).sum() < EXACT:
        return (rows @ query).astype(np.int64)
    whole = [sum(int(a) * int(b) for a, b in zip(r, query)) for r in rows]
    return np.array([min(max(x, -(1 << 63)), (1 << 63) - 1) for x in whole], np.int64)


def slack(rows: np.ndarray, query: np.ndarray) -> float:
    """How far a sum of rounded products may be from the true one; 0 where doubles are exact."""
    most = float(np.abs(rows).max(initial=0)) * float(np.abs(query).sum())
    return 0.0 if most < EXACT else most * 1e-12


def best(ids: np.ndarray, found: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties to the smaller id."""
    order = np.lexsort((ids, -found.astype(object) if (found == -(1 << 63)).any() else -found))[:k]
    return ids[order], found[order]


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.Table]]:
    """(cell, kind, rows) of sorted batches; the queries (kind 0) of a cell come whole, its rows (kind 1) in blocks."""
    now, held, n = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
        cuts = [0, *(np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            own = (int(cell[a]), int(kind[a]))
            if own != now and held:
                yield (*now, pa.Table.from_batches(held))
                held, n = [], 0
            now = own
            while a < b:
                take = min(b - a, BLOCK - n) if own[1] else b - a
                held.append(batch.slice(a, take))
                a, n = a + take, n + take
                if own[1] and n == BLOCK:
                    yield (*now, pa.Table.from_batches(held))
                    held, n = [], 0
    if held:
        yield (*now, pa.Table.from_batches(held))


def meet(queries: DataFrame, rows: DataFrame, make: Callable, schema: str) -> DataFrame:
    """``make()`` runs once a task; ``make()(query table)`` gives a search with ``add(row table)`` and ``found() -> record batch``. Queries
    are (id, key, label, v) and may have more columns of their own; a search of a cell is made of its queries, gets its rows in blocks, and
    is asked at the end of the cell."""
    n = max(1, rows.count())
    n_rows, n_queries = -(-n // min(MOST_GROUP, max(LEAST_GROUP, n // GROUPS))), -(-max(1, queries.count()) // QUERY_GROUP)
    group = lambda n, seed: F.pmod(F.xxhash64("id", "key", F.lit(seed)), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.select("*", group(n_queries, 1).alias("_q"), F.lit(0).alias("kind")).select("*", each(n_rows).alias("_r"))
    held = rows.select("*", group(n_rows, 2).alias("_r"), F.lit(1).alias("kind")).select("*", each(n_queries).alias("_q"))
    both = asked.unionByName(held, allowMissingColumns=True).withColumn("cell", F.col("_q") * n_rows + F.col("_r")).drop("_q", "_r")
    n_parts = min(n_rows * n_queries, max(n_rows, 200_000))
    dealt = both.repartitionById(n_parts, (F.col("cell") % n_parts).cast("int")).sortWithinPartitions("cell", "kind", "id", "key")

    def run(batches):
        build, now, search = make(), None, None
        for cell, kind, table in _stretches(batches):
            if cell != now:
                if search is not None:
                    yield from search.found()
                now, search = cell, None
            if kind == 0:
                search = build(table)
            elif search is not None:  # a cell without queries has nothing to do
                search.add(table)
        if search is not None:
            yield from search.found()

    return dealt.mapInArrow(run, schema)
