"""Registered queries of scalar functions, scopes and record maintenance that the other modules leave out, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.operators import dedupe, filters, records
from notelake.plans import views as V
from notelake.queries import _FIRST, _STEM, _TOKENS, K

QUERIES, SQL = {}, {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


_ALL = f"list_transform(list_concat({_TOKENS.format('title')}, list_concat({_TOKENS.format('lang')}, {_TOKENS.format(chr(39) + 'Running studies' + chr(39))})), lambda w: {_STEM})"


@query("fn6_fallback_terms", f"with k as ({K}), d as (select k.id, k.title, tags[1] as lang from k) select id, array_to_string({_FIRST.format('list_filter(' + _ALL + ', lambda z: length(z) >= 3)')}[1:8], ' ') as terms from d")
def _(spark, sf_dir):
    k = V.knowledge(spark, sf_dir)
    return k.select("id", F.array_join(C.fallback_terms(F.col("title"), F.array(F.col("tags")[0], F.lit("Running studies"))), " ").alias("terms"))


@query("fn13_to_iso", "select doc_id, case doc_id % 5 when 0 then strftime(timestamp '1970-01-01' + to_seconds(doc_id * 1000 + 1), '%Y-%m-%d %H:%M:%S') when 1 then '2024-05-06 07:08:09' when 2 then '2024-05-06 00:00:00' end as t from documents")
def _(spark, sf_dir):
    d = F.col("doc_id")
    value = F.when(d % 5 == 0, (d * 1000 + 1).cast("string")).when(d % 5 == 1, "2024-05-06T07:08:09Z").when(d % 5 == 2, "2024-05-06").when(d % 5 == 3, "0").otherwise(F.col("lang"))
    return V.table(spark, sf_dir, "documents").select("doc_id", F.date_format(C.to_iso(value), "yyyy-MM-dd HH:mm:ss").alias("t"))


@query("fn15_clip", f"with k as ({K}) select id, substring(regexp_replace(repeat(title, 9), '^\\s+|\\s+$', '', 'g'), 1, 500) as title, length(substring(content, 1, 10000)) as chars, sha256(regexp_replace(content, '^\\s+|\\s+$', '', 'g')) as content_hash, 20 as n_tags, 100 as tag_chars, 'ingest:text' as source, 0.8::double as confidence from k")
def _(spark, sf_dir):
    k = V.knowledge(spark, sf_dir).select("id", F.concat(F.lit(" "), F.repeat("title", 9), F.lit("\n")).alias("title"), "content", F.array_repeat(F.repeat(F.lit("t"), 150), 25).alias("tags"), F.lit("text").alias("format"))
    out = dedupe.clip_records(k, V.as_of())
    return out.select("id", "title", F.length("content").alias("chars"), "content_hash", F.size("tags").alias("n_tags"), F.length(F.col("tags")[0]).alias("tag_chars"), "source", "confidence")


@query("flt4_stamp", "select doc_id, case when doc_id % 6 = 3 or doc_id % 6 = 5 then 'rejected' when doc_id % 6 in (1, 4) then 'firma' else 'alice' end as owner from documents")
def _(spark, sf_dir):
    d = F.col("doc_id") % 6
    rows = V.table(spark, sf_dir, "documents").select("doc_id", F.when(d == 1, "shared").when(d == 2, "private").when(d == 3, "everybody").alias("owner_scope"), F.when(d == 4, "firma").when(d == 5, "bob").alias("owner_id"))
    good, bad = filters.stamp_owner(rows, "knowledge", V.OWNER, V.SHARED)
    return good.select("doc_id", F.col("owner_id").alias("owner")).unionByName(bad.select("doc_id", F.lit("rejected").alias("owner")))


def _handoffs(spark, sf_dir) -> DataFrame:
    k = F.col("o_orderkey")
    return V.table(spark, sf_dir, "orders").select(
        k.cast("string").alias("id"), F.concat(F.lit("Handoff "), k.cast("string")).alias("title"), V._pick(["alice", "bob", "carol"], k % 3).alias("to_member"), V._pick(["open", "accepted"], k % 2).alias("status"),
        V._pick(["alice", "firma", "bob"], k % 5 % 3).alias("owner_id"), F.col("o_orderdate").alias("created_at"), F.lit(None).cast("timestamp").alias("accepted_at"), F.when(k % 7 == 0, V.as_of()).alias("completed_at"),
    )


_H = "select cast(o_orderkey as varchar) as id, (['alice', 'bob', 'carol'])[o_orderkey % 3 + 1] as to_member, (['open', 'accepted'])[o_orderkey % 2 + 1] as status, (['alice', 'firma', 'bob'])[o_orderkey % 5 % 3 + 1] as owner_id, o_orderdate as created_at, o_orderkey as k from orders"


@query("flt6_inbox", f"with h as ({_H}) select id from h where owner_id in ('alice', 'firma') and to_member = 'alice' and status = 'open' order by created_at desc, id limit 20 offset 5")
def _(spark, sf_dir):
    return filters.handoff_inbox(_handoffs(spark, sf_dir), V.OWNER, V.SHARED, "me", "open", offset=5).select("id")


@query("flt8_get", f"with k as ({K}) select id, true as found from k where doc_id % 4 = 1 and owner_id in ('alice', 'firma') or doc_id % 4 <> 1 and doc_id % 3 = 0 and owner_id in ('alice', 'firma') union all select id, false from k where doc_id % 3 = 0 and owner_id not in ('alice', 'firma') or doc_id % 4 = 1 and doc_id % 3 <> 0 and owner_id not in ('alice', 'firma') union all select 'none-' || id, false from k where doc_id % 10 = 0")
def _(spark, sf_dir):
    k = V.knowledge(spark, sf_dir)
    ids = k.filter("doc_id % 3 = 0 OR doc_id % 4 = 1").select("id").union(k.filter("doc_id % 10 = 0").select(F.concat(F.lit("none-"), "id")))
    found, missing = filters.get_records(k, ids, "knowledge", V.OWNER, V.SHARED)
    return found.select("id", F.lit(True).alias("found")).unionByName(missing.select("id", F.lit(False).alias("found")))


@query("srt3_recent", f"with k as ({K}) select id from k where owner_id = 'firma' and type = 'lesson' order by created_at desc, id limit 10")
def _(spark, sf_dir):
    return filters.recent(V.knowledge(spark, sf_dir), V.OWNER, V.SHARED, "lesson", "shared").select("id")


@query("srt1_sort", f"with k as ({K}) select id, row_number() over (order by last_validated_at desc nulls last, type asc nulls first, id) as place from k")
def _(spark, sf_dir):
    """The whole order; a place is counted within ranges of rows."""
    from notelake.operators.chunking import ranked

    k = V.knowledge(spark, sf_dir).select("id", "last_validated_at", "type").withColumn("_all", F.lit(1))
    return ranked(k, ["_all"], [F.desc_nulls_last("last_validated_at"), F.asc_nulls_first("type"), F.asc("id")], "place").select("id", F.col("place").cast("long").alias("place"))


@query("mnt1_goals", "select o_orderkey as n, case when o_orderkey % 4 = 0 then 'timeframe: not an allowed value' when o_orderkey % 4 = 1 then 'title: required' when o_orderkey % 4 = 2 then '' else 'title: length out of range' end as issues, case when o_orderkey % 4 = 2 then 'active' end as status, case when o_orderkey % 4 = 2 then 1 end as key_results from orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey") % 4
    goals = V.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("_n"), F.when(k == 1, F.lit(None)).when(k == 3, F.repeat(F.lit("g"), 501)).otherwise(F.concat(F.lit(" Goal "), F.col("o_orderkey").cast("string"))).alias("title"), F.when(k == 0, "hourly").otherwise("weekly").alias("timeframe"), F.array(F.struct(F.lit("d").alias("description"), F.lit(5).alias("target"), F.lit(0).alias("current"))).alias("key_results"))
    good, bad = records.load_records("goals", goals, V.as_of())
    out = good.select(F.col("_n").alias("n"), F.lit("").alias("issues"), "status", F.size("key_results").alias("key_results"))
    return out.unionByName(bad.select(F.col("_n").alias("n"), F.array_join("issues", "; ").alias("issues"), F.lit(None).cast("string").alias("status"), F.lit(None).cast("int").alias("key_results")))


@query("mnt3_handoffs", f"with h as ({_H}) select id, case when k % 2 = 0 and k % 4 = 0 then 'completed' when k % 2 = 0 then 'accepted' else status end as status, k % 2 = 0 and k % 4 <> 0 as accepted, k % 7 = 0 or (k % 2 = 0 and k % 4 = 0) as completed from h")
def _(spark, sf_dir):
    """Even ones are accepted, and every fourth is completed by a later change of the same batch."""
    h = _handoffs(spark, sf_dir)
    k = F.col("id").cast("long")
    changes = h.filter(k % 2 == 0).select("id", F.lit("accepted").alias("status"), F.lit(1).alias("n")).unionByName(h.filter(k % 4 == 0).select("id", F.lit("completed").alias("status"), F.lit(2).alias("n")))
    out = records.advance_handoffs(h, changes, V.as_of(), [F.col("n")])
    return out.select("id", "status", F.col("accepted_at").isNotNull().alias("accepted"), F.col("completed_at").isNotNull().alias("completed"))


@query("mnt4_visibility", "select o_orderkey as n, o_orderkey % 3 <> 0 and o_orderkey % 2 = 0 as rejected from orders")
def _(spark, sf_dir):
    k = F.col("o_orderkey")
    rows = V.table(spark, sf_dir, "orders").select(k.alias("_n"), F.lit("Handoff").alias("title"), F.lit("text").alias("what_changed"), V._pick(["me", "bob", "carol"], k % 3).alias("to_member"), F.when(k % 2 == 0, "private").alias("owner_scope"), F.lit("alice").alias("owner_id"))
    good, bad = records.load_records("handoffs", rows, V.as_of())
    return good.select(F.col("_n").alias("n"), F.lit(False).alias("rejected")).unionByName(bad.select(F.col("_n").alias("n"), F.lit(True).alias("rejected")))


@query("mnt7_seed", "select n_name as key, case when n_nationkey % 2 = 0 then 'kept' else 'default' end as value from nation union all select r_name, 'default' from region")
def _(spark, sf_dir):
    n = V.table(spark, sf_dir, "nation")
    have = n.filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("key"), F.lit("kept").alias("value"))
    names = n.select(F.col("n_name").alias("key")).union(V.table(spark, sf_dir, "region").select("r_name"))
    return records.seed_missing(have, names.withColumn("value", F.lit("default")), ["key"])
