"""Posting lists: the terms of records, and the records that hold all terms of a set, from the rarest list on."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions.helpers import holding_sets, record_stems, small_batches, term_blocks
from notelake.sources.scratch import spread, written

#: Records of a block (a multiple of 64, at most 65,536) and terms of records in it; blocks of a range.
BLOCK, ENTRIES, BLOCKS = 4_096, 1 << 21, 8
#: Sets, and terms of sets, that a task holds against blocks at most; sets for which a task is worth while; words that a task holds as bits.
SETS, TERMS, FEWEST, WORDS = 1 << 19, 1 << 21, 1 << 14, 1 << 16
#: Tasks that share the ranges of a round for the same sets; how much wider each round is.
TASKS, WIDER = 16, 3


def record_terms(records: DataFrame, text: Column) -> DataFrame:
    """(id, terms: the distinct stemmed words of each record)."""
    small_batches()
    return spread(records.select("id", text.alias("text"))).mapInArrow(record_stems, f"id {dict(records.dtypes)['id']}, terms array<string>")


def posting_rows(forward: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """(term, id) of (id, terms), or of those among ``terms`` (term)."""
    each = forward.select(F.explode("terms").alias("term"), "id")
    return each.join(terms.select("term").distinct(), "term", "left_semi") if terms is not None else each


def write_index(records: DataFrame, text: Column, path: str) -> None:
    """Store terms by record (``forward``: id, terms) and records by term (``postings``: term, id, df: the number of records), the postings sorted
    within files, so that readers skip what they don't ask for. Terms are computed once for both."""
    spark = records.sparkSession
    record_terms(records, text).write.mode("overwrite").parquet(f"{path}/forward")
    each = posting_rows(spark.read.parquet(f"{path}/forward"))
    df = each.groupBy("term").agg(F.count("*").alias("df"))
    each.join(df, "term").repartitionByRange("term", "id").sortWithinPartitions("term", "id").select("term", "id", "df").write.mode("overwrite").parquet(f"{path}/postings")


def read_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(forward, postings) as ``write_index`` stores them."""
    return spark.read.parquet(f"{path}/forward"), spark.read.parquet(f"{path}/postings")


def intersect(sets: DataFrame, forward: DataFrame, postings: DataFrame | None = None) -> DataFrame:
    """(set_id, id): the records that hold all terms of a set (set_id, terms: distinct), a row each, from a written table (id, terms) and, where
    it is stored, the same by term (term, id, df). A set's rarest list gives candidates, which meet the records once and are held against the
    set's other terms, the rarer ones first; that is part of the join, so only records that hold the whole set leave it."""
    each = sets.select("set_id", F.explode("terms").alias("term"))
    asked = each.select("term").distinct()
    df = postings.join(asked, "term", "left_semi").groupBy("term").agg(F.first("df").alias("df")) if postings is not None else posting_rows(forward, asked).groupBy("term").agg(F.count("*").alias("df"))
    rare = each.join(df, "term", "left").groupBy("set_id").agg(F.array_sort(F.collect_list(F.struct("df", "term"))).alias("r"))  # an unknown term comes first, with null
    known = written(rare.filter("r[0].df IS NOT NULL").select("set_id", F.transform("r", lambda x: x["term"]).alias("r")).withColumn("term", F.col("r")[0]))
    ends = known.select("term").distinct()
    lists = postings.select("term", "id").join(ends, "term", "left_semi") if postings is not None else posting_rows(forward, ends)
    one = written(known.join(lists, "term").select("set_id", "id", F.slice("r", 2, 1 << 20).alias("rest")))
    holds = (F.col("_id") == F.col("id")) & F.forall("rest", lambda t: F.array_contains("have", t))
    met = one.filter("size(rest) > 0").withColumnRenamed("id", "_id").join(forward.withColumnRenamed("terms", "have"), holds)
    return one.filter("size(rest) = 0").select("set_id", "id").unionByName(met.select("set_id", "id"))


def newest_holding(sets: DataFrame, forward: DataFrame, dated: DataFrame) -> DataFrame:
    """(set_id, id): of each set (set_id, terms: distinct and some, most) at least its ``most`` newest records (fewer where fewer hold all its terms), from
    (id, terms) and (id, created_at). Records are cut into blocks by time. Rounds go from the newest blocks to older and more of them, and sets that
    have their records leave. A task holds a group of sets against one block after another, where a set costs some bits of each record and leaves
    no more than ``most`` rows."""
    small_batches()
    sets = written(sets.select("set_id", "terms", F.col("most").cast("long").alias("most"), F.monotonically_increasing_id().alias("set_no")))
    ranges, cores = max(1, -(-dated.count() // (BLOCK * BLOCKS))), sets.sparkSession.sparkContext.defaultParallelism
    order = [F.desc("created_at"), F.asc("id")]
    kind = dict(forward.dtypes)["id"]
    ordered = forward.join(dated, "id").repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("id", "terms")
    blocks = written(ordered.mapInArrow(term_blocks(BLOCK, ENTRIES), f"part int, at int, ids array<{kind}>, words binary, word_ends binary, ends binary, rows binary"), few=True)
    every = lambda k, name: F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias(name)
    left, hits, low, wide = sets.drop("set_id"), [], 0, 1
    while low < ranges:
        size = left.agg(F.count("*").alias("n"), F.sum(F.size("terms")).alias("terms")).first()
        if hits and not size["n"]:
            break
        high = min(ranges, low + wide)
        span = -(-(high - low) // TASKS)
        groups = -(-(high - low) // span)
        parts = max(1, -(-size["n"] // SETS), -(-(size["terms"] or 0) // TERMS), min(-(-cores // groups), size["n"] // FEWEST))  # each gets the blocks of its own
        own = left.select("*", F.pmod(F.xxhash64("set_no"), F.lit(parts)).cast("int").alias("_sets")).select("*", every(groups, "_group"), F.lit(0).alias("kind"))
        held = blocks.filter((F.col("part") >= low) & (F.col("part") < high)).withColumn("_group", F.floor((F.col("part") - low) / span).cast("int")).select("*", every(parts, "_sets"), F.lit(1).alias("kind"))
        rows = own.unionByName(held, allowMissingColumns=True).withColumn("key", F.col("_sets") * groups + F.col("_group")).drop("_sets", "_group")
        rows = rows.repartition(parts * groups, "key").sortWithinPartitions("key", "kind", "part", "at")
        hits.append(written(rows.mapInArrow(holding_sets(BLOCK, WORDS), f"set_no long, id {kind}")))
        low, wide = high, wide * WIDER
        if low < ranges:
            n = hits[-1].groupBy("set_no").agg(F.count("*").alias("n"))
            left = written(left.join(n, "set_no", "left").withColumn("most", F.col("most") - F.coalesce("n", F.lit(0))).filter("most > 0").drop("n"))
    return reduce(DataFrame.union, hits).join(sets.select("set_no", "set_id"), "set_no").select("set_id", "id")
