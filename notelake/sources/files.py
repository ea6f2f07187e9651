"""Sources and sinks: file trees, mail archives, chat and Slack exports, Markdown stores, record tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.functions import columns as C
from notelake.functions import helpers as H
from notelake.sources.scratch import written

#: Folders that are never looked into.
SKIPPED_FOLDERS = ("node_modules", "__pycache__", "dist", ".git")
MESSAGE_MOST = 4 << 20


def relative_path(root: str) -> Column:
    """The column ``path`` from the root on."""
    base = F.regexp_replace(F.lit(root.rstrip("/")), "^[a-z]+:/*(?=/)", "")
    plain = F.regexp_replace("path", "^[a-z]+:/*(?=/)", "")
    return F.regexp_replace(F.substring(plain, F.length(base) + 2, F.lit(1 << 30)), "%20", " ")


def is_hidden(rel_path: Column) -> Column:
    """Whether a file's name or one of its folders begins with a dot or is never looked into."""
    names = "|".join(x.replace(".", r"\.") for x in SKIPPED_FOLDERS)
    return rel_path.rlike(rf"(^|/)(\.[^/]*|{names})(/|$)")


def scan_files(spark: SparkSession, root: str, limit: int | None = None, content: bool = True) -> DataFrame:
    """path, rel_path, base_name, length, content, status (skipped_too_large or null). Files over their limit aren't carried along."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    df = df.withColumn("rel_path", relative_path(root)).filter(~is_hidden(F.col("rel_path")))
    file = F.element_at(F.split("rel_path", "/"), -1)
    size_ok = F.col("length") <= C.size_limit(F.col("path"))
    out = df.select("path", "rel_path", F.regexp_replace(file, r"(?<=.)\.[^.]*$", "").alias("base_name"), "length", F.when(size_ok, F.col("content")).alias("content"), F.when(~size_ok, "skipped_too_large").alias("status"))
    out = out if content else out.drop("content")
    return out.orderBy("path").limit(limit) if limit else out


def size_gate(files: DataFrame) -> DataFrame:
    return files.withColumn("status", F.when(F.col("length") > C.size_limit(F.col("path")), "skipped_too_large"))


def read_mbox(spark: SparkSession, path: str | list[str], tree: bool = False) -> DataFrame:
    """path, pos, raw: one row a message of some files, or of all archives below a folder (``tree``). A file is read in splits at lines that begin with ``From ``; a piece that is no envelope is
    glued to the one before. A message's place is that within its split plus the counts of earlier splits of the file."""
    reader = spark.read.option("lineSep", "\nFrom ")
    reader = reader.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[mM][bB][oO][xX]") if tree else reader
    rows = reader.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    first = F.row_number().over(W.partitionBy("path", "block").orderBy("id"))
    rows = rows.select("path", "block", first.alias("n"), F.regexp_replace("value", "\r", "").alias("v"))
    body = F.when((F.col("block") == 0) & (F.col("n") == 1) & F.col("v").startswith("From "), F.substring("v", F.lit(6), F.lit(1 << 30))).otherwise(F.col("v"))
    rows = written(rows.withColumn("v", body).withColumn("env", F.col("v").rlike(r"^\S+ +\S").cast("int")))
    counts = rows.groupBy("path", "block").agg(F.sum("env").alias("_n"))  # a row a split
    before = counts.withColumn("_before", F.sum("_n").over(W.partitionBy("path").orderBy("block")) - F.col("_n")).drop("_n")
    within = F.sum("env").over(W.partitionBy("path", "block").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    placed = rows.withColumn("_own", within).join(before, ["path", "block"]).withColumn("pos", F.col("_own") + F.col("_before"))
    glued = placed.groupBy("path", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "n", "v"))), lambda x: x["v"]), "\nFrom ").alias("raw"))
    raw = F.regexp_replace(F.regexp_replace("raw", r"^[^\n]*\n?", ""), r"^\n+", "")
    raw = F.regexp_replace(F.substring(raw, 1, MESSAGE_MOST), r"(?m)^>(>*From )", "$1")
    return glued.filter("pos > 0").select("path", F.col("pos").cast("long"), raw.alias("raw")).filter("trim(raw) <> ''")


def parse_messages(raw: DataFrame) -> DataFrame:
    """Parsed mail fields of (path, pos, raw)."""
    H.small_batches()
    return raw.select("path", "pos", "raw").mapInPandas(H.parse_messages, H.MESSAGE)


CHATGPT = "array<struct<title:string,create_time:double,current_node:string,mapping:map<string,struct<id:string,parent:string,children:array<string>,message:struct<author:struct<role:string>,content:struct<content_type:string,parts:array<variant>,text:string>,create_time:double>>>>>"
CLAUDE = "array<struct<uuid:string,name:string,created_at:string,chat_messages:array<struct<sender:string,text:string,created_at:string,content:array<struct<type:string,text:string>>>>>>"


def chatgpt_conversations(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(facts: conv, path, title, created; nodes: conv, node, parent, role, type, text; heads: conv, current) of (path, text)."""
    each = files.select("path", F.posexplode(F.from_json("text", CHATGPT)).alias("k", "c"))
    conv = F.concat("path", F.lit("#"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("conv")
    facts = each.select(conv, "path", F.col("c.title").alias("title"), C.to_iso(F.col("c.create_time")).alias("created"))
    parts = F.transform(F.filter("m.message.content.parts", lambda p: F.schema_of_variant(p) == "STRING"), lambda p: F.variant_get(p, "$", "string"))
    text = F.coalesce(F.nullif(F.array_join(parts, "\n"), F.lit("")), "m.message.content.text")
    nodes = each.select(conv, F.explode("c.mapping").alias("node", "m")).select("conv", "node", F.col("m.parent").alias("parent"), F.coalesce("m.message.author.role", F.lit("system")).alias("role"), F.col("m.message.content.content_type").alias("type"), text.alias("text"))
    return facts, nodes, each.select(conv, F.col("c.current_node").alias("current"))


def claude_conversations(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(facts, messages: conv, pos, role, type, text) of (path, text)."""
    each = files.select("path", F.posexplode(F.from_json("text", CLAUDE)).alias("k", "c"))
    conv = F.concat("path", F.lit("#"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("conv")
    facts = each.select(conv, "path", F.col("c.name").alias("title"), C.to_iso(F.col("c.created_at")).alias("created"))
    blocks = F.array_join(F.transform(F.filter("m.content", lambda x: x["type"] == "text"), lambda x: x["text"]), "\n")
    own = F.coalesce(F.nullif(C.ws_trim(F.col("m.text")), F.lit("")), blocks)
    return facts, each.select(conv, F.posexplode("c.chat_messages").alias("pos", "m")).select("conv", "pos", F.col("m.sender").alias("role"), F.lit(None).cast("string").alias("type"), own.alias("text"))


def _texts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_chatgpt(spark: SparkSession, path: str):
    return chatgpt_conversations(_texts(spark, path))


def read_claude(spark: SparkSession, path: str):
    return claude_conversations(_texts(spark, path))


SLACK = "type string, subtype string, user string, text string, ts string, thread_ts string"
USERS = "id string, name string, profile struct<display_name:string,real_name:string>"


def slack_tables(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages with path, channel and day; users) of (path, rel_path, text): day files ``<channel>/<yyyy-MM-dd>.json`` and users.json; other
    files are metadata."""
    day = r"^(?:.*/)?([^/]+)/(\d{4}-\d{2}-\d{2})\.json$"
    listed = lambda schema: F.explode(F.from_json("text", f"array<struct<{schema.replace(' string', ':string').replace(' struct', ':struct')}>>")).alias("r")
    days = files.filter(F.col("rel_path").rlike(day)).select("path", F.regexp_extract("rel_path", day, 1).alias("channel"), F.regexp_extract("rel_path", day, 2).alias("day"), listed(SLACK))
    return days.select("path", "channel", "day", "r.*"), files.filter("rel_path = 'users.json'").select(listed(USERS)).select("r.*")


def read_slack(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """``slack_tables`` of an export's folder."""
    texts = spark.read.option("recursiveFileLookup", "true").text(root, wholetext=True)
    return slack_tables(texts.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")).withColumn("rel_path", relative_path(root)))


def read_markdown_store(spark: SparkSession, root: str, collection: str, schema: str) -> DataFrame:
    """Records of ``<root>/<collection>/<id>.md``; archives are left out."""
    return markdown_records(_texts(spark, f"{root}/{collection}/*.md"), schema)


def markdown_records(texts: DataFrame, schema: str) -> DataFrame:
    """Records of (path, text): front matter fields by ``schema``, the rest as content, the file's name as id."""
    rows = texts.withColumn("id", F.regexp_extract("path", r"([^/]+)\.md$", 1)).withColumn("r", H.read_front_matter(F.col("text")))
    return rows.select("id", F.from_json("r.fields", schema).alias("f"), F.col("r.body").alias("content")).select("id", "f.*", "content")


def render_markdown(df: DataFrame, body: str = "content") -> DataFrame:
    """(path, text) of records with an id; reading them back gives the same fields."""
    fields = F.to_json(F.struct(*(c for c in df.columns if c not in ("id", body))), {"ignoreNullFields": "false"})
    return df.select(F.concat("id", F.lit(".md")).alias("path"), H.render_front_matter(fields, F.coalesce(body, F.lit(""))).alias("text"))


def write_collection(df: DataFrame, path: str, mode: str = "append", scoped: bool = False) -> None:
    """Plain files, by owner where ``scoped``. Tables that are patched or merged are ``buckets.Buckets``."""
    writer = df.write.mode(mode)
    (writer.partitionBy("owner_id") if scoped else writer).parquet(path)
