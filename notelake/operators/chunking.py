"""Chunks of texts and conversations, and their titles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.helpers import chunk_text, packed, small_batches
from notelake.operators.packing import pack_long
from notelake.operators.ranks import ranked
from notelake.sources.scratch import written

#: Messages of a key that one task packs.
LONG = 100_000


def chunked(items: DataFrame, most: int = 4000) -> DataFrame:
    """Items (with doc, title, content) as parts: part from 1, n_parts, content; blank items vanish."""
    parts = items.withColumn("_parts", chunk_text(F.col("content"), most))
    out = parts.select(*[c for c in items.columns if c != "content"], F.size("_parts").alias("n_parts"), F.posexplode("_parts").alias("_pos", "content"))
    return out.withColumn("part", F.col("_pos") + 1).drop("_pos")


def part_title(title: Column, part: Column, n: Column) -> Column:
    return F.when(n > 1, F.concat(title, F.lit(" (part "), part.cast("string"), F.lit("/"), n.cast("string"), F.lit(")"))).otherwise(title)


def chunk_conversation(messages: DataFrame, keys: list[str], most: int = 8000, whole: bool = False) -> DataFrame:
    """keys, part, n_parts, content of (keys, pos, text): whole messages are packed, an oversized one is cut on its own, or stays ``whole``. A key's messages
    stream through one task in order, which holds only the current chunk; a key of more than LONG is packed in segments over many tasks."""
    small_batches()
    rows = written(messages.filter("trim(text) <> ''").select(*keys, "pos", "text"))
    kinds = dict(messages.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", part int, content string"
    ordinary = lambda own: own.repartition(*keys).sortWithinPartitions(*keys, "pos", "text").select(*keys, "text").mapInPandas(packed(keys, most, whole), schema)
    long = rows.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > LONG).drop("_n")
    if rows.count() <= LONG or long.isEmpty():
        parts = written(ordinary(rows))
    else:
        long = written(long.select(*(F.col(k).alias(f"_l_{k}") for k in keys)))
        same = [F.col(k).eqNullSafe(F.col(f"_l_{k}")) for k in keys]
        parts = written(ordinary(rows.join(long, same, "left_anti")).unionByName(pack_long(rows.join(long, same, "left_semi"), keys, most, whole)))
    return parts.join(parts.groupBy(*keys).agg(F.count("*").alias("n_parts")), keys)


def dedupe_titles(df: DataFrame, export: list[str], order: list[Column], blank: str = "Untitled conversation") -> DataFrame:
    """Within an export the n-th equal title gets `` (n)``; blank ones get a name."""
    base = F.when(F.trim(F.coalesce("title", F.lit(""))) == "", blank).otherwise(F.trim("title"))
    out, n = ranked(df.withColumn("_base", base), [*export, "_base"], order, "_k"), F.col("_k")
    return out.withColumn("title", F.when(n > 1, F.concat("_base", F.lit(" ("), n.cast("string"), F.lit(")"))).otherwise(F.col("_base"))).drop("_base", "_k")
