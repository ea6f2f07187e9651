"""A uniform shuffle into shards of exact sizes by a communication matrix of hypergeometric counts.

Sanders, "Random Permutations on Distributed, External and Hierarchical Memory" (1998), and Gustedt's communication matrices: rows
lie in source buckets; how many rows of each bucket go to each shard is drawn exactly (multivariate hypergeometric), each bucket is
permuted locally, its rows are exchanged by the matrix, and each shard is permuted again. Only the bucket counts, a row of n_shards
numbers for each BUCKET_ROWS rows, reach the driver and go back as a small table, never rows. Buckets and permutations follow from hashes of the rows, so a lost task gives the same rows again.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.llm.text import written

#: Rows that a bucket holds about; buckets grow in number with the table.
BUCKET_ROWS = 1 << 17
LEAST_BUCKETS = 64
#: How many times larger than BUCKET_ROWS a bucket is let become.
SPLIT = 2


def hypergeometric(rng: np.random.Generator, good: int, bad: int, draws: int) -> int:
    """Good ones among ``draws`` without replacement, also where numpy's 10**9 limit is passed (by a ratio of uniforms)."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, draws)) if draws and good else 0
    low, high = max(0, draws - bad), min(good, draws)
    if low == high:
        return low
    n = good + bad
    mean = draws * good / n
    spread = math.sqrt(mean * bad / n * (n - draws) / (n - 1) + 0.5)
    log = lambda k: -sum(math.lgamma(x + 1) for x in (k, good - k, draws - k, bad - draws + k))
    mode = min(high, max(low, (draws + 1) * (good + 1) // (n + 2)))
    top, width = log(mode), 2 * math.sqrt(2 / math.e) * spread + 3 - 2 * math.sqrt(3 / math.e)
    while True:
        u, v = rng.random(), rng.random()
        k = math.floor(mean + 0.5 + width * (v - 0.5) / u) if u else -1
        if low <= k <= high and 2 * math.log(u) <= log(k) - top:
            return k


def communication_matrix(counts: list[int], sizes: list[int], seed: int) -> np.ndarray:
    """Exact counts from bucket to shard: row sums are ``counts``, column sums are ``sizes``."""
    rng, left = np.random.default_rng(seed), list(sizes)
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, draws in enumerate(counts):
        rest = sum(left)
        for s, have in enumerate(left):
            rest -= have
            out[p, s] = k = hypergeometric(rng, have, rest, draws)
            left[s] -= k
            draws -= k
    return out


def bucketed(rows: DataFrame, identity: list[str], seed: int, bucket_rows: int) -> tuple[DataFrame, list[int]]:
    """(rows with _bucket and _copy, the number of rows of each bucket). Buckets are told by a hash of the identity; one that a row repeated very often makes
    larger than SPLIT times ``bucket_rows`` is split into buckets of that size by _copy, a number that is stored with each row and null elsewhere."""
    kept = written(rows.withColumn("_copy", F.monotonically_increasing_id()))  # read several times, with the same numbers
    total = kept.count()
    n = max(LEAST_BUCKETS, math.ceil(total / bucket_rows))
    first = kept.withColumn("_bucket", F.pmod(F.xxhash64(F.lit(seed), *identity), F.lit(n)).cast("int"))
    count = lambda df: dict(df.groupBy("_bucket").count().collect())  # noqa: E731  one number a bucket
    found, split, upto = count(first), [], n
    for b, size in sorted(found.items()):
        if size > SPLIT * bucket_rows:
            split.append((b, upto, math.ceil(size / bucket_rows)))
            upto += split[-1][2]
    if not split:
        return first.withColumn("_copy", F.lit(None).cast("long")), [found.get(b, 0) for b in range(n)]
    parts = kept.sparkSession.createDataFrame(split, "_bucket int, _from int, _k int")  # one row for SPLIT * bucket_rows rows at least
    at = F.col("_from") + F.pmod(F.xxhash64(F.lit(seed), "_copy"), F.col("_k")).cast("int")
    dealt = first.join(F.broadcast(parts), "_bucket", "left").withColumn("_copy", F.when(F.col("_k").isNotNull(), F.col("_copy"))).withColumn("_bucket", F.coalesce(at, "_bucket")).drop("_from", "_k")
    found = count(dealt)
    return dealt, [found.get(b, 0) for b in range(upto)]


def shards(rows: DataFrame, identity: list[str], n_shards: int = 16, seed: int = 11, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``rows`` and their shard and slot; counts of shards differ by one at most, slots run from 0 without a gap.

    ``identity``: columns that tell rows apart. Rows equal in all of them are alike and may change places; nulls count as values.
    Columns named _bucket, _at, _part, _order or _copy aren't allowed in ``rows``. An empty table stays empty.
    """
    held, found = bucketed(rows, identity, seed, bucket_rows)
    keyed: list[Column] = [*(F.col(c) for c in identity), F.col("_copy")]
    total = sum(found)
    n_parts = max(LEAST_BUCKETS // n_shards, math.ceil(total / n_shards / bucket_rows))
    sizes = [total // n_shards + (s < total % n_shards) for s in range(n_shards)]
    upto = communication_matrix(found, sizes, seed).cumsum(axis=1).tolist()
    matrix = held.sparkSession.createDataFrame([(b, row) for b, row in enumerate(upto)], "_bucket int, _upto array<long>")
    local = W.partitionBy("_bucket").orderBy(F.xxhash64(F.lit(seed + 1), *keyed), *keyed)
    dealt = (
        held.withColumn("_at", F.row_number().over(local).cast("long"))
        .join(matrix, "_bucket")
        .withColumn("shard", F.size(F.filter("_upto", lambda c: c < F.col("_at"))))
        .withColumn("_order", F.xxhash64(F.lit(seed + 2), *keyed))
        .withColumn("_part", F.floor((F.shiftrightunsigned("_order", 1) / F.lit(float(1 << 63))) * n_parts).cast("int"))
        .drop("_bucket", "_at", "_upto")
    )
    before = W.partitionBy("shard").orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    starts = dealt.groupBy("shard", "_part").count().withColumn("_first", F.coalesce(F.sum("count").over(before), F.lit(0))).drop("count")
    again = W.partitionBy("shard", "_part").orderBy("_order", *keyed)
    return (
        dealt.withColumn("_at", F.row_number().over(again))
        .join(starts, ["shard", "_part"])
        .withColumn("slot", (F.col("_first") + F.col("_at") - 1).cast("long"))
        .drop("_part", "_order", "_at", "_first", "_copy")
    )


def shuffled_documents(docs: DataFrame, n_shards: int = 16, seed: int = 11) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard under the law ``rows``.

    A null text has size 1 and the check sum of an empty one; repeated rows are dealt one by one; a null doc_id stays null; other
    columns are not looked at. Texts are read once and not shuffled.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shards(rows, ["doc_id", "text_crc32", "size"], n_shards, seed)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int"), "slot", F.lit(None).cast("int").alias("grown_shard"))
