"""Mail threads: duplicates, components by ids and subjects, records and facts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.functions.helpers import trim_quotes
from notelake.operators.chunking import chunk_conversation, dedupe_titles, part_title
from notelake.operators.search import top
from notelake.sources.scratch import written

#: Edges beyond which a node is a hub, and hubs whose table is broadcast.
HUB, MOST_HUBS = 100_000, 500_000


def dedupe_messages(messages: DataFrame) -> DataFrame:
    """The first row of each message id; messages without any stay; blank body and subject together go."""
    full = messages.filter("trim(coalesce(body, '')) <> '' OR trim(coalesce(subject, '')) <> ''")
    named = top(full.filter("message_id IS NOT NULL"), ["message_id"], [F.asc("path"), F.asc("pos")], 1).drop("rank")
    return named.unionByName(full.filter("message_id IS NULL"))


def beside(rows: DataFrame, facts: DataFrame, key: str, n: int) -> DataFrame:
    """``rows`` (n at most) joined with one row of ``facts`` a key, whose ``n`` is the number of rows of that key. Rows of a hub (over HUB of
    them) get theirs from a small table and stay where they are; hubs are no more than n / HUB."""
    if n <= HUB:
        return rows.join(facts.drop("n"), key)
    facts = written(facts)
    hubs = facts.filter(F.col("n") > HUB).drop("n")
    if not 0 < hubs.count() <= MOST_HUBS:
        return rows.join(facts.drop("n"), key)
    others = rows.join(F.broadcast(hubs.select(key)), key, "left_anti").join(facts.filter(F.col("n") <= HUB).drop("n"), key)
    return rows.join(F.broadcast(hubs), key).unionByName(others)


def with_least(edges: DataFrame, n: int) -> DataFrame:
    """(u, v, m) of n edges (u, v): each with the least of u and its neighbours."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
    return beside(edges, least, "u", n)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp: the least node that edges (a, b) reach.

    Kiveris et al., "Connected Components in MapReduce and Beyond" (2014): a large-star round links each node's greater neighbours to the
    least one near it, a small-star round its smaller ones, until only stars are left."""
    star = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        both = star.select(F.col("a").alias("u"), F.col("b").alias("v")).union(star.select("b", "a"))
        large = with_least(both, 2 * star.count()).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = written(large)
        near = with_least(large, large.count())
        star = written(near.select(F.col("v").alias("a"), F.col("m").alias("b")).filter("a <> b").union(near.select("u", "m")).distinct())
        twice = star.groupBy("a").count().filter("count > 1").isEmpty()
        if twice and star.join(star.select(F.col("b").alias("a")).distinct(), "a", "left_semi").isEmpty():
            return nodes.join(star.select(F.col("a").alias("node"), F.col("b").alias("comp")), "node", "left").select("node", F.coalesce("comp", "node").alias("comp"))


def assign_threads(messages: DataFrame) -> DataFrame:
    """messages and thread_id (the least position of the thread). Messages (pos unique) are joined by own, parent and reference ids; then
    a thread whose first message has no ids or a reply prefix joins the earliest message of its subject."""
    ids = F.array_distinct(F.array_compact(F.concat(F.array("message_id", "in_reply_to"), F.coalesce("references", F.array().cast("array<string>")))))
    own = messages.select(F.col("pos").alias("node"), ids.alias("ids"), C.normalize_subject(F.coalesce("subject", F.lit(""))).alias("subject"), C.is_reply(F.col("subject")).alias("reply"))
    own = written(own)
    each = own.select("node", F.explode("ids").alias("name"))
    hubs = each.groupBy("name").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    by_id = written(components(own.select("node"), beside(each, hubs, "name", each.count()).filter("a <> node").select("a", F.col("node").alias("b"))))
    first = own.join(by_id.select(F.col("comp").alias("node")).distinct(), "node", "left_semi")
    attach = first.filter("(size(ids) = 0 OR reply) AND subject <> ''").select("node", "subject")
    # The earliest message of the subject is found for every thread that looks for one.
    earliest = own.filter("subject <> ''").groupBy("subject").agg(F.min("node").alias("a"), F.count("*").alias("n"))
    more = beside(attach, earliest, "subject", own.count()).filter("a < node").select("a", F.col("node").alias("b"))
    joined = components(own.select("node"), by_id.select(F.col("node").alias("a"), F.col("comp").alias("b")).union(more))
    return messages.join(joined.select(F.col("node").alias("pos"), F.col("comp").alias("thread_id")), "pos")


def thread_items(messages: DataFrame, most: int = 8000) -> DataFrame:
    """thread_id, title, part, n_parts, content: messages by date (undated first); quotes go in threads of several, but never a whole body;
    blank bodies are left out, and threads of nothing else."""
    size = messages.groupBy("thread_id").agg(F.count("*").alias("_size"), F.min_by("subject", F.struct("date", "pos")).alias("_subject"))
    own, trimmed = C.ws_trim(F.coalesce("body", F.lit(""))), trim_quotes(F.coalesce("body", F.lit("")))
    when = F.when(F.col("date").isNotNull(), F.concat(F.lit(" ("), F.date_format("date", "yyyy-MM-dd"), F.lit(")"))).otherwise("")
    rows = messages.withColumn("_body", own).filter("_body <> ''").join(size.select("thread_id", "_size"), "thread_id")
    body = F.when((F.col("_size") > 1) & (trimmed != ""), trimmed).otherwise(F.col("_body"))
    text = F.concat(F.lit("From "), C.display_name(F.coalesce("sender", F.lit(""))), when, F.lit(": "), body)
    rows = rows.select("thread_id", F.struct("date", F.col("pos").alias("at")).alias("pos"), text.alias("text"))
    first = size.join(rows.select("thread_id").distinct(), "thread_id", "left_semi").select("thread_id", C.bare_subject(F.col("_subject")).alias("title"))
    titles = dedupe_titles(first, [], [F.asc("thread_id")], "Untitled email thread")
    parts = chunk_conversation(rows, ["thread_id"], most).join(titles, "thread_id")
    return parts.withColumn("title", part_title(F.col("title"), F.col("part"), F.col("n_parts"))).select("thread_id", "part", "content", "n_parts", "title")


def thread_facts(messages: DataFrame) -> DataFrame:
    """thread_id, participants, message_count, first_date, last_date, attachments, origin (path of the oldest message)."""
    people = messages.select("thread_id", F.explode(C.addresses(F.col("sender"), F.col("recipient"))).alias("p")).groupBy("thread_id").agg(F.array_sort(F.collect_set("p")).alias("participants"))
    facts = messages.groupBy("thread_id").agg(
        F.count("*").alias("message_count"), F.min("date").alias("first_date"), F.max("date").alias("last_date"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("attachments") > 0, F.struct("date", "pos", "attachments")))), lambda x: x["attachments"])).alias("attachments"),
        F.min_by("path", F.struct("date", "pos")).alias("origin"),
    )
    return facts.join(people, "thread_id", "left").withColumn("participants", F.coalesce("participants", F.array().cast("array<string>")))
