"""Incremental ingest of a growing folder: each micro-batch adds what the store doesn't have yet.

State lies beside the store, in bucketed tables, of which a batch reads the buckets of its own keys: titles that are known, names of mails
(ids and subjects) with their group, the messages of each group, and the records of its threads. A group is all that ids and subjects join, so
a batch works on its own messages and the groups that they meet, and a reply finds its thread however many batches ago that began.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.functions.helpers import MESSAGE
from notelake.operators import threads
from notelake.operators.dedupe import classify, clip_records, dedupe_batch
from notelake.plans.ingest import gated, mail_messages, parse_files, raw_mail, slack_items, thread_records
from notelake.sources import files as S
from notelake.sources.buckets import Buckets
from notelake.sources.scratch import written

FILE = "path string, modificationTime timestamp, length long, content binary"
STORE = "type string, title string, content string, summary string, tags array<string>, source string, content_hash string, owner_id string, created_at timestamp"
TITLES = "type string, title string, owner_id string, metadata_hash string, batch long"
NAMES, MESSAGES = "name string, grp string", MESSAGE.replace("pos long", "pos string") + ", grp string"
COLUMNS = [x.split(" ")[0] for x in STORE.split(", ")]


def state(spark: SparkSession, store: str) -> dict[str, Buckets]:
    """The tables beside a store."""
    base = f"{store.rstrip('/')}_state"
    return {
        "titles": Buckets(spark, f"{base}/titles", TITLES, ["type", "title", "owner_id"]), "names": Buckets(spark, f"{base}/names", NAMES, ["name"]),
        "messages": Buckets(spark, f"{base}/messages", MESSAGES, ["grp"]), "threads": Buckets(spark, f"{base}/threads", f"{STORE}, grp string", ["grp"]),
    }


def read_store(spark: SparkSession, store: str) -> DataFrame:
    """All records: those of the store, and those of mail threads as they are now."""
    return spark.read.schema(STORE).parquet(store).select(*COLUMNS).unionByName(state(spark, store)["threads"].read().select(*COLUMNS))


def _names(messages: DataFrame) -> DataFrame:
    """(pos, name): the ids that a message knows, and its subject."""
    ids = F.array_compact(F.concat(F.array("message_id", "in_reply_to"), F.coalesce("references", F.array().cast("array<string>"))))
    subject = C.normalize_subject(F.coalesce("subject", F.lit("")))
    own = F.concat(F.transform(ids, lambda x: F.concat(F.lit("i:"), x)), F.when(subject != "", F.array(F.concat(F.lit("s:"), subject))).otherwise(F.array().cast("array<string>")))
    return messages.select("pos", F.explode(F.array_distinct(F.array_append(own, F.concat(F.lit("p:"), "pos")))).alias("name"))


def add_mail(tables: dict[str, Buckets], messages: DataFrame, finish) -> None:
    """Put messages into their groups and make the records of these groups anew. A batch that runs again meets its own messages and changes nothing."""
    messages = written(messages)
    known = written(tables["names"].of(_names(messages)))
    groups = known.select("grp").distinct()
    old = written(tables["messages"].of(groups))
    fresh = messages.join(old.select("pos"), "pos", "left_anti")
    again = old.filter("message_id IS NOT NULL").select("message_id").distinct()
    fresh = fresh.join(again, "message_id", "left_anti")  # the first of an id stays; messages without one are kept
    both = written(old.drop("grp").unionByName(fresh))
    names = written(_names(both))
    first = names.groupBy("name").agg(F.min("pos").alias("a"), F.count("*").alias("n"))
    edges = threads.beside(names, first, "name", names.count()).filter("a <> pos").select("a", F.col("pos").alias("b"))
    grouped = written(threads.components(both.select(F.col("pos").alias("node")), edges).select(F.col("node").alias("pos"), F.col("comp").alias("grp")))
    placed = written(threads.assign_threads(both))
    of_thread = placed.select("thread_id", "pos").join(grouped, "pos").select("thread_id", "grp").distinct()  # a thread lies in one group
    records = finish(thread_records(placed)).join(of_thread, "thread_id")
    groups = groups.unionByName(grouped.select("grp")).distinct()
    tables["threads"].replace(groups, records)
    tables["messages"].replace(groups, both.join(grouped, "pos"))
    named = names.join(grouped, "pos").select("name", "grp").distinct()
    tables["names"].replace(named.select("name"), named)  # names come last: until then the old group finds all that it had


def ingest_stream(spark: SparkSession, root: str, store: str, checkpoint: str, owner: str, as_of: Column, include_bulk: bool = False, **options):
    """A started query. Files over their size limit are left out. Records of a batch lie in a folder of their own, which a batch that runs again
    writes again; the titles that it added are known by its number. Mail threads are read by ``read_store``."""
    stream = spark.readStream.format("binaryFile").schema(FILE).option("recursiveFileLookup", "true").load(root)

    def of_root(session: SparkSession, name: str) -> DataFrame | None:
        """A file right below the root, if it is there."""
        try:
            return session.read.format("binaryFile").load(f"{root.rstrip('/')}/{name}")
        except AnalysisException:
            return None

    def rows_of(files: DataFrame) -> DataFrame:
        name = F.element_at(F.split("path", "/"), -1)
        sized = S.size_gate(files.select("path", S.relative_path(root).alias("rel_path"), F.regexp_replace(name, r"(?<=.)\.[^.]*$", "").alias("base_name"), "length", "content"))
        return gated(sized.withColumn("content", F.when(F.col("status").isNull(), F.col("content"))).filter(~S.is_hidden(F.col("rel_path"))))

    def add(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        tables, files = state(session, store), written(rows_of(batch))
        users, channels = of_root(session, "users.json"), of_root(session, "channels.json")
        if users is not None and channels is not None:
            items = slack_items(files.filter("status IS NULL AND rel_path <> 'users.json'").unionByName(rows_of(users)))
        else:
            items = parse_files(session, files.filter("format NOT IN ('eml', 'mbox')"))
        clipped = lambda rows: clip_records(rows, as_of).withColumn("owner_id", F.lit(owner))
        items = written(clipped(items))
        known = tables["titles"].of(items).filter(F.col("batch") != number)
        have = known.select("type", "title", "owner_id", "metadata_hash", F.lit(True).alias("has_metadata"))
        new = written(classify(dedupe_batch(items), have).filter("status = 'created'"))
        new.select(*COLUMNS).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch={number}")
        tables["titles"].replace(new, new.select("type", "title", "owner_id", F.col("content_hash").alias("metadata_hash"), F.lit(number).cast("long").alias("batch")))
        mail = files.filter("status IS NULL AND format IN ('eml', 'mbox')")
        if not mail.isEmpty():
            add_mail(tables, mail_messages(raw_mail(session, mail), include_bulk), clipped)

    spark.createDataFrame([], STORE).write.mode("overwrite").parquet(f"{store.rstrip('/')}/batch=-1")
    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(**options)
