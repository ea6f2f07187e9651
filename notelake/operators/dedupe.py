"""Duplicates within a batch and against the store, reports of files and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.functions import columns as C

MAIL = ("eml", "mbox")


def clip_records(items: DataFrame, as_of: Column) -> DataFrame:
    """Items within the store's limits; the hash is that of the whole content."""
    return items.withColumns({
        "content_hash": C.content_hash(F.col("content")),
        "title": F.substring(C.ws_trim(F.col("title")), 1, 500),
        "content": F.substring("content", 1, 10_000),
        "tags": C.clipped_tags(F.col("tags")),
        "source": F.concat(F.lit("ingest:"), F.col("format")),
        "confidence": F.lit(0.8),
        "created_at": as_of,
    }).withColumn("summary", C.summary(F.col("content")))


def dedupe_batch(items: DataFrame) -> DataFrame:
    """``is_first``: of a (type, title) the first item wins; mail comes last, then shallower folders, names, positions. Only narrow
    columns are ranked; a title met very often is thinned out per partition first by the aggregate."""
    order = F.struct(F.col("format").isin(*MAIL).alias("m"), F.size(F.split("path", "/")).alias("d"), "path", "pos")
    key = F.xxhash64("type", "title")
    first = items.groupBy(key.alias("_k"), "type", "title").agg(F.min(order).alias("_first"))
    met = items.withColumn("_k", key).withColumn("_own", order).join(first, ["_k", "type", "title"])
    return met.withColumn("is_first", F.col("_own") == F.col("_first")).drop("_k", "_own", "_first")


def classify(items: DataFrame, existing: DataFrame) -> DataFrame:
    """``status`` created or duplicate, and ``changed``: a stored duplicate has metadata whose hash differs or is missing."""
    key = ["type", "title", "owner_id"]
    known = existing.groupBy(*key).agg(F.lit(True).alias("_known"), F.min("metadata_hash").alias("_hash"), F.max("has_metadata").alias("_meta"))
    met = items.join(known, key, "left")
    new = F.col("is_first") & F.col("_known").isNull()
    changed = F.col("_known").isNotNull() & F.coalesce("_meta", F.lit(False)) & ~F.col("content_hash").eqNullSafe(F.col("_hash"))
    return met.withColumn("status", F.when(new, "created").otherwise("duplicate")).withColumn("changed", changed).drop("_known", "_hash", "_meta")


def file_reports(files: DataFrame, items: DataFrame, dry_run: bool = False) -> DataFrame:
    """path, format, status, records, duplicates, changed, error: one row a file."""
    made = items.groupBy("path").agg(
        F.count(F.when(F.col("status") == "created", 1)).alias("records"), F.count(F.when(F.col("status") == "duplicate", 1)).alias("duplicates"), F.count(F.when(F.col("changed"), 1)).alias("changed")
    )
    out = files.select("path", "format", F.col("status").alias("_gate"), "error").join(made, "path", "left").fillna(0, ["records", "duplicates", "changed"])
    status = (
        F.when(F.col("_gate").isNotNull(), F.col("_gate"))
        .when(F.col("records") > 0, "dry_run" if dry_run else "created")
        .when(F.col("duplicates") > 0, "skipped_duplicate")
        .otherwise("skipped_empty")
    )
    return out.withColumn("status", status).drop("_gate")


def ingest_summary(reports: DataFrame) -> DataFrame:
    count = lambda cond: F.count(F.when(cond, 1))
    s = F.col("status")
    return reports.agg(F.count("*").alias("files_scanned"), count(s.isin("created", "dry_run")).alias("files_ingested"), count(s.startswith("skipped")).alias("files_skipped"), count(s == "error").alias("files_errored"), F.coalesce(F.sum("records"), F.lit(0)).alias("records_created"), F.coalesce(F.sum("duplicates"), F.lit(0)).alias("records_deduplicated"))

