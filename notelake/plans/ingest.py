"""Bulk ingest: a tree of files becomes new records, a report a file, and seven totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.functions import columns as C
from notelake.operators import chat, parsers, threads
from notelake.operators.chunking import dedupe_titles
from notelake.operators.dedupe import classify, clip_records, dedupe_batch, file_reports, ingest_summary
from notelake.operators.filters import drop_bulk, owners_of
from notelake.sources import files as S
from notelake.sources.scratch import written

#: Mail archives that one read names.
MAIL_BLOCK = 10_000
ITEM = "path string, pos int, title string, content string, type string, tags array<string>, source_meta map<string,string>, format string"


def export_kind(files: DataFrame, *by: str) -> DataFrame:
    """``kind``: slack, notion or none, from the relative paths (DET-4); one row, or one for each value of ``by`` where several exports are listed."""
    has = lambda p: F.coalesce(F.max(F.col("rel_path").rlike(p).cast("int")), F.lit(0)) == 1
    slack = has(r"^users\.json$") & has(r"^channels\.json$") & has(r"^[^/]+/\d{4}-\d{2}-\d{2}\.json$")
    kind = F.when(slack, "slack").when(has(r"(?i) [0-9a-f]{32}\.(md|csv)$"), "notion").otherwise("none").alias("kind")
    return files.groupBy(*by).agg(kind)


def gated(files: DataFrame) -> DataFrame:
    """Files with format, text, status and error; content is only decoded where a parser will read it."""
    fmt = C.detect_format(F.col("path"))
    named = C.refine_path(F.element_at(F.split("rel_path", "/"), -1))
    binary = F.coalesce(C.looks_binary(F.col("content")), F.lit(False)) & ~fmt.isin(*C.CONVERTED)
    text = C.decode_text(F.col("content"))
    df = files.withColumn("_f", fmt).withColumn("text", F.when(F.col("_f").isNotNull() & (F.col("_f") != "mbox") & ~binary, text))
    refined = F.when(F.col("_f") == "json", C.refine_json(F.col("text"))).when(F.col("_f").isin("markdown", "csv") & named.isNotNull(), named).otherwise(F.col("_f"))
    df = df.withColumn("format", refined)
    broken = F.col("format").isin("json", "chatgpt", "claude", "keep") & F.expr("try_parse_json(text)").isNull()
    status = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("format").isNull() | (F.col("format") == "skip") | binary, "skipped_unsupported")
        .when((F.col("format") != "mbox") & (C.ws_trim(F.coalesce("text", F.lit(""))) == ""), "skipped_empty")
        .when(broken, "error")
    )
    return df.withColumn("status", status).withColumn("error", F.when(F.col("status") == "error", "the file is not valid JSON")).drop("_f", "content")


def chat_items(files: DataFrame) -> DataFrame:
    """Items of both chat export shapes."""
    out = None
    for vendor in ("chatgpt", "claude"):
        own = files.filter(F.col("format") == vendor)
        if vendor == "chatgpt":
            facts, nodes, heads = S.chatgpt_conversations(own)
            path = chat.canonical_path(nodes.select("conv", "node", "parent"), heads)
            messages = path.join(nodes.drop("parent"), ["conv", "node"]).select("conv", "pos", "role", "type", "text")
        else:
            facts, messages = S.claude_conversations(own)
        talk = chat.collapse_tool_runs(messages)
        named = dedupe_titles(facts.join(talk.select("conv").distinct(), "conv", "left_semi"), ["path"], [F.asc_nulls_last("created"), F.asc("conv")])
        items = chat.conversation_items(talk, named, vendor).join(named.select("conv", "path", "created"), "conv")
        pos = F.row_number().over(W.partitionBy("path").orderBy("conv", "part"))
        date = C.iso_time(F.col("created"))
        meta = F.when(date.isNotNull(), F.create_map(F.lit("conversation_date"), date))
        items = items.select("path", pos.alias("pos"), "title", "content", "type", "tags", meta.alias("source_meta"), F.lit(vendor).alias("format"))
        out = items if out is None else out.unionByName(items)
    return out


def slack_items(files: DataFrame) -> DataFrame:
    each, users = S.slack_tables(files)
    items = chat.slack_channel_days(each.drop("path"), chat.slack_user_map(users))
    tags, meta = F.array(F.lit("slack"), F.concat(F.lit("#"), F.col("channel"))), F.create_map(F.lit("date"), F.col("day"), F.lit("channel"), F.col("channel"))
    return items.join(each.select("path", "channel", "day").distinct(), ["channel", "day"]).select("path", F.col("part").alias("pos"), "title", "content", F.lit("reference").alias("type"), tags.alias("tags"), meta.alias("source_meta"), F.lit("slack").alias("format"))


def raw_mail(spark: SparkSession, files: DataFrame, root: str = "") -> DataFrame:
    """path, pos, raw of all mail files. Archives below ``root`` are read as a tree; without a root, those of a batch by name in blocks."""
    raw, block = files.filter("format = 'eml' AND status IS NULL").select("path", F.lit(1).cast("long").alias("pos"), F.col("text").alias("raw")), []
    boxes = files.filter("format = 'mbox' AND status IS NULL").select("path")
    if root:
        return raw.unionByName(S.read_mbox(spark, root, tree=True).join(boxes, "path", "left_semi"))
    for row in boxes.toLocalIterator():
        block.append(row["path"])
        if len(block) == MAIL_BLOCK:
            raw, block = raw.unionByName(S.read_mbox(spark, block)), []
    return raw.unionByName(S.read_mbox(spark, block)) if block else raw


def mail_messages(raw: DataFrame, include_bulk: bool) -> DataFrame:
    """Parsed messages, each once; ``pos`` orders them by file and place."""
    unique = threads.dedupe_messages(drop_bulk(S.parse_messages(raw), include_bulk)[0].filter("error IS NULL"))
    return unique.withColumn("pos", F.concat("path", F.lit("\x00"), F.lpad(F.col("pos").cast("string"), 12, "0")))  # files in order of path


def thread_records(placed: DataFrame) -> DataFrame:
    """Items of messages with their thread_id."""
    items, facts = threads.thread_items(placed), threads.thread_facts(placed)
    meta = F.create_map(F.lit("message_count"), F.col("message_count").cast("string"), F.lit("participants"), F.array_join("participants", ", "))
    pos = F.row_number().over(W.partitionBy("origin").orderBy("first_date", "thread_id", "part"))
    return items.join(facts, "thread_id").select("thread_id", F.col("origin").alias("path"), pos.alias("pos"), "title", "content", F.lit("reference").alias("type"), F.array(F.lit("email")).alias("tags"), meta.alias("source_meta"), F.lit("eml").alias("format"))


def mail_items(spark: SparkSession, files: DataFrame, root: str, include_bulk: bool) -> DataFrame:
    """Thread records of all mail files together; an item belongs to the file of its oldest message."""
    placed = written(threads.assign_threads(mail_messages(raw_mail(spark, files, root), include_bulk)))
    return thread_records(placed).drop("thread_id")


def parse_files(spark: SparkSession, files: DataFrame, root: str = "", include_bulk: bool = False, kind: str = "none") -> DataFrame:
    """Items of all gated files without a status: one branch for each format that is there."""
    good = files.filter("status IS NULL")
    there = {r[0] for r in good.select("format").distinct().collect()}  # the registered formats bound this
    out = spark.createDataFrame([], ITEM)
    if kind == "slack":
        return out.unionByName(slack_items(good))
    for name in sorted(there & set(parsers.PARSERS)):
        out = out.unionByName(parsers.PARSERS[name](good.filter(F.col("format") == name)))
    if there & {"chatgpt", "claude"}:
        out = out.unionByName(chat_items(good))
    if there & {"eml", "mbox"}:
        out = out.unionByName(mail_items(spark, good, root, include_bulk))
    return out


def ingest(spark: SparkSession, root: str, existing: DataFrame, owner: str, shared: str, as_of: Column, dry_run: bool = True, owner_scope: str = "private", include_bulk: bool = False, store: str | None = None):
    """(new records, reports, summary). ``existing`` has type, title, owner_id, metadata_hash, has_metadata. A run that isn't dry appends
    the new records to ``store``, which may not overlap the root."""
    if store and (store.rstrip("/") + "/").startswith(root.rstrip("/") + "/"):
        raise ValueError("the store lies inside the root")
    out = ingest_files(spark, S.scan_files(spark, root), existing, owner, shared, as_of, dry_run, owner_scope, include_bulk, root)
    if store and not dry_run:
        S.write_collection(out[0], store, scoped=True)
    return out


def ingest_files(spark: SparkSession, files: DataFrame, existing: DataFrame, owner: str, shared: str, as_of: Column, dry_run: bool = True, owner_scope: str = "private", include_bulk: bool = False, root: str = ""):
    """``ingest`` of file rows (path, rel_path, base_name, length, content, status); nothing is stored."""
    files = written(gated(files))
    kind = export_kind(files).first()["kind"]
    if kind == "slack":
        files = files.withColumn("status", F.coalesce("status", F.when(~F.col("rel_path").contains("/"), "skipped_unsupported")))
        items = slack_items(files.filter("status IS NULL OR rel_path = 'users.json'"))
    else:
        items = parse_files(spark, files, root, include_bulk, kind)
    clipped = clip_records(items, as_of).withColumn("owner_id", F.lit(owners_of(owner, shared, owner_scope)[0]))
    rows = written(classify(dedupe_batch(clipped), existing))
    new = rows.filter("status = 'created'").select("type", "title", "content", "summary", "tags", "source", "confidence", "source_meta", "content_hash", "owner_id", "created_at")
    reports = file_reports(files, rows, dry_run)
    return new, reports, ingest_summary(reports)
