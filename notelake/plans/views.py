"""The driver's tables as collections; ``SQL`` holds the same views for another engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OWNER, SHARED = "alice", "firma"


def as_of() -> Column:
    """The time that stands for now."""
    return F.lit("2024-12-31 00:00:00").cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(values: list[str], k) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (k + 1).cast("int"))


def knowledge(spark, sf_dir) -> DataFrame:
    d = F.col("doc_id")
    start = F.lit("2024-01-01 00:00:00").cast("timestamp")
    return table(spark, sf_dir, "documents").select(
        d.cast("string").alias("id"), _pick(["fact", "pattern", "insight", "lesson", "reference"], d % 5).alias("type"), F.substring(F.substring_index("text", "\n", 1), 1, 500).alias("title"),
        F.col("text").alias("content"), F.lit(None).cast("string").alias("summary"), F.array("lang", "source").alias("tags"), _pick(["alice", "bob", "carol", "firma"], d % 4).alias("owner_id"),
        (start + F.make_dt_interval(mins=d.cast("int"))).alias("created_at"), F.when(d % 50 != 0, start + F.make_dt_interval((d % 365).cast("int"))).alias("last_validated_at"), d.alias("doc_id"),
    )


def decisions(spark, sf_dir) -> DataFrame:
    """``context`` is the whole text, so that a search meets all of it and no slice breaks a match."""
    t = F.col("text")
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.substring(t, 1, 60).alias("title"), t.alias("context"), F.substring(t, F.lit(261), F.length(t)).alias("chosen_option"), (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(F.col("item_id").cast("int"))).alias("created_at"))


def links(spark, sf_dir) -> DataFrame:
    kinds = ["supports", "contradicts", "derived_from", "example_of", "related", "supersedes", "depends_on"]
    return table(spark, sf_dir, "lineitem").select(
        F.lit("knowledge").alias("source_type"), F.col("l_partkey").cast("string").alias("source_id"), F.lit("knowledge").alias("target_type"), F.col("l_suppkey").cast("string").alias("target_id"), _pick(kinds, F.col("l_linenumber") % 7).alias("relation_type"),
        F.lit("alice").alias("owner_id"), F.lit(None).cast("double").alias("confidence"), F.lit(None).cast("boolean").alias("auto_suggested"), F.col("l_shipdate").alias("created_at"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
    )


def tasks(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit(" Order "), F.col("o_orderkey").cast("string")).alias("title"), F.when(F.col("o_orderpriority").startswith("1"), "urgent").when(F.col("o_orderpriority").startswith("2"), "high").when(F.col("o_orderpriority").startswith("5"), "lowest").alias("priority"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("due_date"),
    )


def contacts(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"), "left")  # nation: 25 rows at every size
    return c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.col("n_name").alias("company"), F.col("c_mktsegment").alias("role"), F.lit(None).cast("string").alias("notes"), F.col("c_custkey").alias("key"))


def mail(spark, sf_dir) -> DataFrame:
    """A mail for each turn, answering the one before; every fifth turn knows no ids and begins with one of several prefixes. Senders come in
    three forms."""
    c, t = F.col("conv_id"), F.col("turn")
    mid = lambda k: F.concat(F.lit("c"), c.cast("string"), F.lit("-t"), k.cast("string"))
    prefix = F.when(t == 0, "").when(t % 5 != 0, "Re: ").otherwise(_pick(["Re: ", "Fwd: ", "fw[2]: re : "], c % 3))
    address = F.concat("role", F.lit("@example.org"))
    sender = F.when(t % 3 == 0, F.concat("role", F.lit(" <"), address, F.lit(">"))).when(t % 3 == 1, F.concat(F.lit('"The '), "role", F.lit('" <'), address, F.lit(">"))).otherwise(address)
    return table(spark, sf_dir, "conversations").select(
        (c * 100_000 + t).alias("pos"), F.lit("mail.mbox").alias("path"), mid(t).alias("message_id"), F.when((t > 0) & (t % 5 != 0), mid(t - 1)).alias("in_reply_to"), F.lit(None).cast("array<string>").alias("references"),
        F.concat(prefix, F.lit("Topic "), F.floor(c / 2).cast("string")).alias("subject"), sender.alias("sender"), F.lit("all@example.org, root@localhost, a%b").alias("recipient"),
        (F.lit("2024-01-01 00:00:00").cast("timestamp") + F.make_dt_interval(mins=(c * 100 + t).cast("int"))).alias("date"), F.col("text").alias("body"), F.array().cast("array<string>").alias("attachments"), F.lit(False).alias("is_bulk"),
    )


def chat(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").alias("pos"), "role", F.lit(None).cast("string").alias("type"), "text")


def chat_with_tools(spark, sf_dir) -> DataFrame:
    """Chat in which every fourth turn is a tool's, and the ones before and after it are code in every third conversation."""
    c, t = F.col("conv_id"), F.col("turn")
    role = F.when(t % 4 == 3, "tool").when(t % 7 == 6, "critic").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").select(c.cast("string").alias("conv"), t.alias("pos"), role.alias("role"), F.when((c % 3 == 0) & (t % 4 != 1), "code").alias("type"), "text")


def nodes(spark, sf_dir) -> DataFrame:
    """A node for each turn, and in every seventh conversation one off the path."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("conv"), F.col("turn").cast("string").alias("node"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"))
    return t.unionByName(t.filter("conv % 7 = 0 AND node = '1'").withColumn("node", F.lit("1b")))


def slack(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("channel"), F.date_format("ts", "yyyy-MM-dd").alias("day"), F.lit("message").alias("type"), F.lit(None).cast("string").alias("subtype"), F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("user"), F.concat(F.lit("event "), F.col("event_id").cast("string"), F.lit(" by <@U"), F.col("user_id").cast("string"), F.lit(">")).alias("text"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("ts"), F.when(F.col("event_id") % 3 == 0, F.lpad((F.col("event_id") - 1).cast("string"), 12, "0")).alias("thread_ts"))


SQL = {
    "knowledge": """select cast(doc_id as varchar) as id, (['fact','pattern','insight','lesson','reference'])[doc_id % 5 + 1] as type, substring(split_part(text, chr(10), 1), 1, 500) as title,
 text as content, [lang, source] as tags, (['alice','bob','carol','firma'])[doc_id % 4 + 1] as owner_id, timestamp '2024-01-01' + to_minutes(doc_id) as created_at,
 case when doc_id % 50 <> 0 then timestamp '2024-01-01' + to_days(cast(doc_id % 365 as integer)) end as last_validated_at, doc_id from documents""",
    "links": """select cast(l_partkey as varchar) as source_id, cast(l_suppkey as varchar) as target_id,
 (['supports','contradicts','derived_from','example_of','related','supersedes','depends_on'])[l_linenumber % 7 + 1] as relation_type, l_shipdate as created_at, l_orderkey * 10 + l_linenumber as id from lineitem""",
}
