"""The link graph: loads, neighbourhoods, counts, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notelake.functions import columns as C
from notelake.operators.postings import newest_holding, record_terms
from notelake.operators.search import top
from notelake.sources.scratch import spread, written

KEY = ["source_type", "source_id", "target_type", "target_id", "relation_type", "owner_id"]


def load_links(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new links, rejected self links); one row a key, defaults filled in."""
    loop = (F.col("source_type") == F.col("target_type")) & (F.col("source_id") == F.col("target_id"))
    rows = incoming.withColumn("confidence", F.coalesce("confidence", F.lit(0.8))).withColumn("auto_suggested", F.coalesce("auto_suggested", F.lit(False)))
    first = top(rows.filter(~loop), KEY, [F.asc("created_at"), F.asc("id")], 1).drop("rank")
    return first.join(existing.select(*KEY), KEY, "left_anti"), incoming.filter(loop)


def related(links: DataFrame, entities: DataFrame, targets: DataFrame, direction: str = "both", relation: str | None = None, limit: int = 50) -> DataFrame:
    """type, id, direction, other_type, other_id, relation_type, title, rank: the newest ``limit`` links a direction of each entity."""
    links = links.filter(F.col("relation_type") == relation) if relation else links
    out = None
    for name, own, other in (("outgoing", "source", "target"), ("incoming", "target", "source")):
        if direction in ("both", name):
            rows = links.select(F.col(f"{own}_type").alias("type"), F.col(f"{own}_id").alias("id"), F.lit(name).alias("direction"), F.col(f"{other}_type").alias("other_type"), F.col(f"{other}_id").alias("other_id"), "relation_type", "created_at", F.col("id").alias("link_id"))
            rows = top(rows.join(entities, ["type", "id"], "left_semi"), ["type", "id"], [F.desc("created_at"), F.asc("link_id")], limit)
            out = rows if out is None else out.unionByName(rows)
    named = targets.select(F.col("type").alias("other_type"), F.col("id").alias("other_id"), "title")
    return out.join(named, ["other_type", "other_id"], "left").drop("created_at", "link_id")


def link_counts(links: DataFrame) -> DataFrame:
    """type, id, total, outgoing, incoming."""
    ends = links.select(F.col("source_type").alias("type"), F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).union(links.select("target_type", "target_id", F.lit(0), F.lit(1)))
    return ends.groupBy("type", "id").agg(F.count("*").alias("total"), F.sum("o").alias("outgoing"), F.sum("i").alias("incoming"))


def suggest_links(knowledge: DataFrame, links: DataFrame, items: DataFrame, limit: int = 5, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """item_id, id, relation, preview, rank: the newest records that hold all key terms of an item, without itself and those linked with it.

    Items of the same terms are one set, whose newest records are found once, from terms (``index``, as ``read_index`` gives them; else made here). An item looks no further down its set's list than ``limit``, itself and its own links together
    take, so a set that many items share isn't expanded into all pairs."""
    need = F.array_sort(F.array_distinct(F.transform(C.key_terms(F.col("title"), F.col("content")), C.stem)))
    own = spread(knowledge.select("id", "type", "title", F.substring("content", 1, 200).alias("content"))).join(items.select("id"), "id", "left_semi")
    keyed = written(own.select(F.col("id").alias("item_id"), F.col("type").alias("item_type"), need.alias("terms")))  # so that terms are made once
    asked = keyed.filter("size(terms) > 0").withColumn("set_id", F.array_join("terms", " "))
    forward = index[0] if index else written(record_terms(knowledge, F.concat_ws(" ", "title", "content")))
    ends = links.filter("source_type = 'knowledge' AND target_type = 'knowledge'")
    linked = ends.select(F.col("source_id").alias("item_id"), F.col("target_id").alias("id")).union(ends.select("target_id", "source_id"))
    known = written(linked.distinct().join(asked.select("item_id"), "item_id", "left_semi").join(knowledge.select("id"), "id", "left_semi").select("item_id", "id"))
    reach = asked.select("item_id", "item_type", "set_id").join(known.groupBy("item_id").agg(F.count("*").alias("n")), "item_id", "left")
    reach = written(reach.withColumn("reach", limit + 1 + F.coalesce("n", F.lit(0))).drop("n"))
    most = reach.groupBy("set_id").agg(F.max("reach").alias("most"))
    sets = asked.select("set_id", "terms").distinct().join(most, "set_id")
    hits = written(newest_holding(sets, forward, knowledge.select("id", "created_at")))
    order = [F.desc("created_at"), F.asc("id")]
    dated = hits.join(knowledge.select("id", "type", "created_at"), "id").join(most, "set_id").withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(64)))
    thinned = dated.withColumn("place", F.row_number().over(W.partitionBy("set_id", "_salt").orderBy(*order))).filter("place <= most")  # before a long list meets in one task
    placed = thinned.withColumn("place", F.row_number().over(W.partitionBy("set_id").orderBy(*order))).filter("place <= most")
    wanted = reach.select("item_id", "item_type", "set_id", F.explode(F.sequence(F.lit(1), F.col("reach").cast("int"))).alias("place"))
    met = wanted.join(placed.select("set_id", "place", "id", "type", "created_at"), ["set_id", "place"]).filter("id <> item_id").join(known, ["item_id", "id"], "left_anti")
    best = top(met, ["item_id"], order, limit)
    preview = F.coalesce("summary", F.when(F.length("content") > 100, F.concat(F.substring("content", 1, 100), F.lit("..."))).otherwise(F.col("content")))
    return best.select("item_id", "id", C.relation_hint(F.col("item_type"), F.col("type")).alias("relation"), "rank").join(knowledge.select("id", preview.alias("preview")), "id")
