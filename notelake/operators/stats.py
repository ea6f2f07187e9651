"""Counts and health of the record tables; ``as_of`` stands for now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions.columns import decay_score
from notelake.operators.filters import scope

TYPES = ("fact", "pattern", "insight", "lesson", "reference")


#: The collections that are counted.
COUNTED = ("knowledge", "decisions", "sessions", "goals", "tasks", "contacts")


def brain_counts(tables: dict[str, DataFrame], owner: str | None = None, shared: str | None = None) -> DataFrame:
    """collection, n: each of the six collections counted within one job, 0 where there is no table; with ``owner`` only what the owner may
    read."""
    out = None
    for name in dict.fromkeys([*COUNTED, *tables]):
        if name in tables:
            df = scope(tables[name], name, owner, shared) if owner and "owner_id" in tables[name].columns else tables[name]
            own = df.agg(F.lit(name).alias("collection"), F.count("*").alias("n"))
            out = own if out is None else out.unionByName(own)
    missing = [name for name in COUNTED if name not in tables]
    if out is not None and missing:
        none = out.limit(1).select(F.explode(F.array(*map(F.lit, missing))).alias("collection"), F.lit(0).cast("long").alias("n"))
        out = out.unionByName(none)
    return out


def knowledge_by_type(df: DataFrame) -> DataFrame:
    """All five types, zeros kept; one row, five conditional counts, unpivoted."""
    one = df.agg(*(F.count(F.when(F.col("type") == t, 1)).alias(t) for t in TYPES))
    return one.unpivot([], list(TYPES), "type", "n")


def stale_count(df: DataFrame, as_of: Column, days: int = 90) -> DataFrame:
    return df.agg(F.count(F.when(F.col("last_validated_at") < as_of - F.make_dt_interval(F.lit(days)), 1)).alias("stale"), F.count("*").alias("total"))


def decay_report(df: DataFrame, as_of: Column, threshold: float = 0.5, limit: int | None = 20) -> DataFrame:
    """Records whose score has sunk under the threshold, oldest first, and their total before the limit."""
    days = int((1 - threshold) * 180)
    old = df.filter(F.col("last_validated_at") < as_of - F.make_dt_interval(F.lit(days)))
    total = old.agg(F.count("*").alias("total"))  # one row
    out = old.select("id", "title", "type", "last_validated_at", F.round(decay_score(F.col("last_validated_at"), as_of), 6).alias("score")).orderBy("last_validated_at", "id")
    return (out.limit(limit) if limit else out).join(F.broadcast(total))
