"""Chat exports: canonical paths, tool runs, transcripts; Slack channel-days."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.functions import columns as C
from notelake.operators.chunking import chunk_conversation, part_title
from notelake.sources.scratch import written

#: Types of messages that only say what a tool did.
TOOL_TYPES = ("code", "execution_output", "tether_quote", "tether_browsing_display")
#: Messages that only say what happened to a channel.
NOISE = ("channel_join", "channel_leave", "group_join", "group_leave", "channel_topic", "channel_purpose", "channel_name")


def canonical_path(nodes: DataFrame, heads: DataFrame) -> DataFrame:
    """conv, node, pos (0 at the root) from (conv, node, parent) and (conv, current). Pointers jump: after k rounds each node knows its
    2**k-th ancestor, so long conversations take few joins. A dangling pointer drops the conversation; a cycle ends at what repeats."""
    edges = nodes.select("conv", "node", "parent")
    known = edges.select("conv", F.col("node").alias("parent"), F.lit(True).alias("_is"))
    dangling = edges.filter("parent IS NOT NULL").join(known, ["conv", "parent"], "left_anti").select("conv", F.col("node").alias("bad"))
    path = written(heads.join(nodes.select("conv", F.col("node").alias("current")), ["conv", "current"]).select("conv", F.col("current").alias("node"), F.lit(0).cast("long").alias("up")))
    jump = written(edges.select("conv", "node", F.col("parent").alias("to")))
    step = 1
    while True:  # the path doubles: the nodes met so far, and each one's 2**k-th ancestor
        far = path.join(jump, ["conv", "node"]).filter("to IS NOT NULL").select("conv", F.col("to").alias("node"), (F.col("up") + step).alias("up"))
        grown = written(path.unionByName(far).groupBy("conv", "node").agg(F.min("up").alias("up")))
        if grown.count() == path.count():
            break
        path, step = grown, step * 2
        second = jump.select("conv", F.col("node").alias("to"), F.col("to").alias("next"))
        jump = written(jump.join(second, ["conv", "to"], "left").select("conv", "node", F.col("next").alias("to")))
    broken = path.join(dangling.withColumnRenamed("bad", "node"), ["conv", "node"]).select("conv").distinct()
    top = F.max("up").over(W.partitionBy("conv"))
    return path.join(broken, "conv", "left_anti").withColumn("pos", top - F.col("up")).drop("up")


def collapse_tool_runs(messages: DataFrame) -> DataFrame:
    """(conv, pos, role, type, text) of users, assistants and tools, without empty messages; each run of tool messages becomes one ``[tool use]``, and a
    conversation of nothing else goes."""
    is_tool = F.coalesce(F.col("role") == "tool", F.lit(False)) | F.coalesce(F.col("type").isin(*TOOL_TYPES), F.lit(False))
    rows = messages.withColumn("_tool", is_tool).filter("coalesce(role, '') <> 'system' AND (_tool OR (role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> ''))")
    w = W.partitionBy("conv").orderBy("pos")
    rows = rows.withColumn("_again", F.coalesce(F.lag("_tool").over(w), F.lit(False)) & F.col("_tool")).filter("NOT _again")
    talk = rows.filter("NOT _tool").select("conv").distinct()
    return rows.join(talk, "conv", "left_semi").withColumn("text", F.when(F.col("_tool"), "[tool use]").otherwise(F.col("text"))).drop("_tool", "_again")


def conversation_items(messages: DataFrame, facts: DataFrame, vendor: str, most: int = 8000, whole: bool = False) -> DataFrame:
    """conv, title, part, n_parts, content, type, tags of (conv, pos, role, text) and (conv, title). Messages of over ``most`` characters are cut, or stay ``whole``."""
    who = F.when(F.col("role").isin("user", "human"), "User").otherwise("Assistant")
    text = messages.filter("trim(coalesce(text, '')) <> ''").select("conv", "pos", F.concat(who, F.lit(": "), C.ws_trim(F.col("text"))).alias("text"))
    parts = chunk_conversation(text, ["conv"], most, whole).join(facts.select("conv", "title"), "conv")
    tags = F.array(F.lit(vendor), F.lit("conversation"))
    return parts.select("conv", part_title(F.col("title"), F.col("part"), F.col("n_parts")).alias("title"), "part", "n_parts", "content", F.lit("reference").alias("type"), tags.alias("tags"))


def slack_user_map(users: DataFrame) -> DataFrame:
    named = F.coalesce(*(F.nullif(C.ws_trim(c), F.lit("")) for c in (F.col("profile.display_name"), F.col("profile.real_name"), F.col("name"))))
    return users.select("id", named.alias("name")).filter("name IS NOT NULL")


def slack_channel_days(messages: DataFrame, users: DataFrame, most: int = 8000) -> DataFrame:
    """channel, day, title, part, n_parts, content: parents in time order with their replies below, orphan replies last. ``users`` (id,
    name) is a workspace's member list; names are joined by id, mentions inside texts take the map of the mentioned users."""
    kept = messages.filter((F.col("type") == "message") & ~F.coalesce(F.col("subtype").isin(*NOISE), F.lit(False)) & (F.trim(F.coalesce("text", F.lit(""))) != ""))
    kept = kept.withColumn("_id", F.xxhash64("channel", "day", "ts", "user", "text"))
    asked = kept.select("_id", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(r"<@([A-Z0-9]+)"), 1))).alias("id")).join(users, "id")
    maps = asked.distinct().groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("id", "name"))).alias("_users"))
    named = kept.join(maps, "_id", "left").join(users.select(F.col("id").alias("user"), F.col("name").alias("_name")), "user", "left")
    none = F.create_map().cast("map<string,string>")
    text = C.render_slack_text(F.col("text"), F.coalesce("_users", none))
    reply = F.coalesce(F.col("thread_ts") != F.col("ts"), F.lit(False))
    roots = kept.filter("thread_ts IS NULL OR thread_ts = ts").select("channel", "day", F.col("ts").alias("thread_ts"), F.lit(True).alias("_root")).distinct()
    rows = named.withColumn("_reply", reply).join(roots, ["channel", "day", "thread_ts"], "left")
    orphan = F.col("_reply") & F.col("_root").isNull()
    line = F.concat(F.when(F.col("_reply") & ~orphan, "  ↳ ").otherwise(""), F.coalesce("_name", "user", F.lit("unknown")), F.lit(": "), text)
    key = F.struct(orphan.cast("int"), F.when(F.col("_reply"), F.col("thread_ts")).otherwise(F.col("ts")), F.col("_reply").cast("int"), "ts")
    ordered = rows.select("channel", "day", line.alias("text"), F.struct(key.alias("k"), "_id").alias("pos"))
    parts = chunk_conversation(ordered, ["channel", "day"], most)
    base = F.concat(F.lit("#"), F.col("channel"), F.lit(" "), F.col("day").cast("string"))
    return parts.withColumn("title", part_title(base, F.col("part"), F.col("n_parts")))
