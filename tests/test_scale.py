"""Hot keys, indexes and incremental state on small inputs of their own."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from notelake.functions import columns as C
from notelake.functions import helpers as H
from notelake.operators import chunking, links, packing, pages, postings, records, search, threads
from notelake.sources import buckets, scratch
from notelake.sources.buckets import Buckets
from notelake.streaming.ingest import ingest_stream, read_store, state


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def greedy(texts, most):
    """Chunks by the plain rule, one message after another."""
    out, held = [], ""
    for t in texts:
        if held and len(held) + 2 + len(t) > most:
            out.append(held)
            held = ""
        if len(t) > most:
            out.extend(H.chunks(t, most))
        else:
            held = f"{held}\n\n{t}" if held else t
    return [*out, held] if held else out


@pytest.mark.parametrize("seed", range(4))
def test_long_keys_are_packed_as_short_ones(spark, monkeypatch, seed):
    rng = random.Random(seed)
    most = 60
    monkeypatch.setattr(chunking, "LONG", 5)
    monkeypatch.setattr(packing, "SEGMENT", rng.choice([3, 7, 40]))
    rows = [(key, k, "x" * rng.choice([1, 2, 10, 29, 58, 60, 61, 150]) + " y" * (key == "b")) for key in ("a", "b", None, "short") for k in range(4 if key == "short" else 90)]
    df = spark.createDataFrame(rows, "conv string, pos int, text string").repartition(3)
    got = {}
    for r in chunking.chunk_conversation(df, ["conv"], most).collect() if seed else packing.pack_long(df, ["conv"], most).collect():
        got.setdefault(r.conv, {})[r.part] = r.content
    for key in ("a", "b", "short") + ((None,) if not seed else ()):
        assert got[key] == dict(enumerate(greedy([t for k, _, t in rows if k == key], most), 1))


def test_a_key_of_a_million_messages_is_packed_by_many_tasks(spark):
    n = 10**6
    df = spark.range(n).select(F.lit("hot").alias("conv"), F.col("id").alias("pos"), F.repeat(F.lit("m"), (F.col("id") % 37 + 1).cast("int")).alias("text"))
    parts = chunking.chunk_conversation(df, ["conv"], 8000)
    want = greedy(["m" * (k % 37 + 1) for k in range(n)], 8000)
    rows = parts.select("part", "n_parts", F.sha2("content", 256).alias("h")).collect()
    assert {r.part: r.h for r in rows} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(want, 1)} and rows[0].n_parts == len(want)


def test_hubs_keep_their_edges_apart(spark, monkeypatch):
    monkeypatch.setattr(threads, "HUB", 50)
    rng = random.Random(2)
    edges = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(500, 620)] + [(rng.randrange(700, 900), rng.randrange(700, 900)) for _ in range(150)]
    nodes = spark.range(1000).select(F.col("id").alias("node"))
    got = {r.node: r.comp for r in threads.components(nodes, spark.createDataFrame(edges, "a long, b long")).collect()}
    root = list(range(1000))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert got == {k: find(k) for k in range(1000)}
    assert threads.components(nodes, spark.createDataFrame([], "a long, b long")).filter("node <> comp").count() == 0


def test_a_hub_of_a_million_messages(spark):
    n = 10**6
    rows = spark.range(n).select(F.col("id").alias("v"), F.lit(-1).cast("long").alias("u"))
    met = threads.beside(rows, rows.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "u", n)
    sizes = [r["count"] for r in met.withColumn("p", F.spark_partition_id()).groupBy("p").count().collect()]
    assert sum(sizes) == n and max(sizes) <= n / len(sizes) * 1.5 and len(sizes) >= 4


def test_index_gives_the_records_of_all_terms(spark, tmp_path):
    rng = np.random.default_rng(4)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}o" for k in range(60)]
    rows = [(str(k), " ".join(words[int(x)] for x in rng.zipf(1.5, 12) % 60)) for k in range(200)]
    df = spark.createDataFrame(rows, "id string, text string")
    postings.write_index(df, F.col("text"), f"{tmp_path}/index")
    forward, lists = postings.read_index(spark, f"{tmp_path}/index")
    held = {r.id: set(r.terms) for r in forward.collect()}
    assert all(held[i] == {H.stem(w) for w in t.split()} for i, t in rows)
    assert {(r.term, r.df) for r in lists.select("term", "df").distinct().collect()} == {(t, sum(t in h for h in held.values())) for t in set().union(*held.values())}
    sets = [(k, [H.stem(words[int(x)]) for x in rng.choice(20, n, False)]) for k, n in enumerate([1, 2, 3, 4] * 10)] + [(99, ["zzz", H.stem(words[1])])]
    asked = spark.createDataFrame([(k, list(dict.fromkeys(t))) for k, t in sets], "set_id int, terms array<string>")
    want = {(k, i) for k, t in sets for i, h in held.items() if set(t) <= h}
    for own in (None, lists):
        found = postings.intersect(asked, forward, own).collect()
        assert {tuple(r) for r in found} == want and len(found) == len(want)


def test_stems_of_words_are_those_of_columns(spark):
    words = "studies dies ties running king bring planned bed used passes bus class process glass pricing added ees ss the with boxes axes agreed rrred".split()
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {r.w: r.s for r in df.select("w", C.stem(F.col("w")).alias("s")).collect()}
    assert {w: H.stem(w) for w in words if w not in C.STOP_WORDS and len(w) > 2} == {w: s for w, s in got.items() if w not in C.STOP_WORDS and len(w) > 2}


@pytest.mark.parametrize("few", [0, 32])
def test_substring_search_has_no_nested_loops(spark, monkeypatch, few):
    monkeypatch.setattr(search, "FEW", few)
    rows = [(str(k), f"Title {k} über", "text é" * (k % 3) + f" needle{k % 10} straße\nend") for k in range(300)]
    recs = spark.createDataFrame(rows, "id string, title string, content string")
    asked = [(1, "NEEDLE7"), (2, "über"), (3, "é"), (4, "e"), (5, "title 12"), (6, "nowhere"), (7, "straße\nend"), (8, "needle7")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    want = set()
    for q, needle in asked:
        hits = sorted((-(2 if needle.lower() in t.lower() else 1), i) for i, t, c in rows if needle.lower() in t.lower() or needle.lower() in c.lower())
        want |= {(q, i, -s, n) for n, (s, i) in enumerate(hits[:50], 1)}
    assert {tuple(r) for r in search.text_search(recs, queries).collect()} == want
    long = search.text_search(recs, queries.filter("octet_length(query) > 2"))
    assert "NestedLoop" not in plan(long) and "Cartesian" not in plan(long)


def test_fallback_reads_records_once(spark, monkeypatch):
    recs = spark.createDataFrame([(str(k), f"pricing page {k}", "experiments" if k % 2 else "results") for k in range(40)], "id string, title string, content string")
    asked = spark.createDataFrame([(1, "pricing experiment zzz"), (2, "page 7"), (3, " "), (4, None), (5, "zzz yyy")], "query_id int, query string").withColumn("terms", C.fallback_terms(F.coalesce("query", F.lit("")), F.array().cast("array<string>")))
    reads, before = [], search.automaton_hits
    monkeypatch.setattr(search, "automaton_hits", lambda *a: reads.append(len(a[0])) or before(*a))
    whole = sorted(map(tuple, search.search_with_fallback(recs, asked, ["title", "content"], 5).collect()))
    assert len(reads) == 1 and {r[0] for r in whole} == {1, 2} and all(r[3] == (r[0] == 1) for r in whole)
    monkeypatch.setattr(search, "AUTOMATON_CHARS", 20)  # several automata find the same
    assert sorted(map(tuple, search.search_with_fallback(recs, asked, ["title", "content"], 5).collect())) == whole and len(reads) > 3


def test_items_of_the_same_terms_are_not_paired(spark):
    rows = [(str(k), "fact", "alpha beta" if k % 2 else "gamma delta", "gamma" if k == 3 else "", None, k) for k in range(60)]
    k = spark.createDataFrame(rows, "id string, type string, title string, content string, summary string, created_at int")
    ends = spark.createDataFrame([("knowledge", "1", "knowledge", str(x)) for x in (59, 57, 55, 2)] + [("knowledge", "53", "knowledge", "1")], "source_type string, source_id string, target_type string, target_id string")
    got = {}
    for r in links.suggest_links(k, ends, k.select("id"), 3).collect():
        got.setdefault(r.item_id, {})[r["rank"]] = r.id
    assert got["1"] == {1: "51", 2: "49", 3: "47"} and got["59"] == {1: "57", 2: "55", 3: "53"} and got["0"] == {1: "58", 2: "56", 3: "54"} and "3" not in got


RECORD = "id string, title string, status string, updated_at timestamp"


def test_a_merge_rewrites_touched_buckets_and_switches_at_once(spark, tmp_path, monkeypatch):
    table = Buckets(spark, f"{tmp_path}/t", RECORD, ["id"], 8)
    assert table.read().count() == 0
    rows = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("t"), "id").alias("title"), F.lit("todo").alias("status"), F.lit(None).cast("timestamp").alias("updated_at"))
    table.replace(None, rows)
    patches = spark.createDataFrame([("3", "new three"), ("5", "new five"), ("999", "unknown")], "id string, title string")
    change = lambda near: records.patch_records(near, patches, "tasks", F.lit("2024-01-01").cast("timestamp"))[0]
    before, commit = table.manifest(), Buckets._commit
    monkeypatch.setattr(Buckets, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        table.merge(patches, change)
    assert table.manifest() == before and table.read().filter("title LIKE 'new%'").count() == 0  # the old version is readable
    monkeypatch.setattr(Buckets, "_commit", commit)
    touched = table.merge(patches, change)
    after = table.manifest()[3]
    assert len(touched) <= 3 and all(after[b] == own for b, own in before[3].items() if b not in touched)
    got = {r.id: r.title for r in table.read().collect()}
    assert len(got) == 200 and got["3"] == "new three" and got["4"] == "t4" and "999" not in got
    people = spark.createDataFrame([("7", "T7", "done"), ("x", "added", "todo")], "id string, title string, status string").withColumn("updated_at", F.lit(None).cast("timestamp"))
    table.merge(people, lambda near: records.upsert(near, people, "notes", ["id"]))
    got = {r.id: (r.title, r.status) for r in table.read().collect()}
    assert len(got) == 201 and got["7"] == ("T7", "done") and got["x"] == ("added", "todo")


def test_buckets_grow_and_are_rewritten_after_many_additions(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(buckets, "BUCKET_ROWS", 20)
    monkeypatch.setattr(buckets, "MOST_PARTS", 2)
    table = Buckets(spark, f"{tmp_path}/t", "k long, v string", ["k"], 2)
    for n in range(4):
        table.add(spark.range(n * 20, n * 20 + 20).select(F.col("id").alias("k"), F.lit("v").alias("v")))
    version, _, n, parts = table.manifest()
    assert n == 4 and sorted(r.k for r in table.read().collect()) == list(range(80)) and all(len(x) <= 2 for x in parts.values())
    table.replace(spark.range(10).select(F.col("id").alias("k")), spark.createDataFrame([(500, "w")], "k long, v string"))
    assert sorted(r.k for r in table.read().collect()) == [*range(10, 80), 500]
    assert [r.v for r in table.of(spark.createDataFrame([(500,), (11111,)], "k long")).collect()] == ["w"]


def eml(n, subject, text, reply=None):
    return f"From: Ana <a@x.org>\nTo: b@x.org\nSubject: {subject}\nMessage-ID: <{n}@x>\n" + (f"In-Reply-To: <{reply}@x>\n" if reply else "") + f"Date: Mon, 0{n} Jan 2024 10:00:00 +0000\n\n{text}\n"


def test_a_reply_joins_the_thread_of_an_earlier_batch(spark, tmp_path):
    root, store = tmp_path / "in", f"file://{tmp_path}/store"
    root.mkdir()

    def run():
        ingest_stream(spark, f"file://{root}", store, f"file://{tmp_path}/ck", "alice", F.lit("2024-12-31").cast("timestamp")).awaitTermination(300)
        return {r.title: r.content for r in read_store(spark, store).collect()}

    (root / "1.eml").write_text(eml(1, "Plan", "first"))
    (root / "2.eml").write_text(eml(2, "Other", "apart"))
    (root / "big.txt").write_bytes(b"x" * ((10 << 20) + 1))
    assert {t: c.count("From Ana") for t, c in run().items()} == {"Plan": 1, "Other": 1}  # a file over the limit isn't read
    before = state(spark, store)["messages"].manifest()[3]
    (root / "3.eml").write_text(eml(3, "Re: Plan", "second", 1))
    (root / "a.txt").write_text("note")
    got = run()
    assert set(got) == {"Plan", "Other", "a"} and "first" in got["Plan"] and "second" in got["Plan"]
    after = state(spark, store)["messages"].manifest()[3]
    assert sum(after.get(b) == own for b, own in before.items()) >= len(before) - 1  # the other thread's bucket stays as it was, unless they share it
    (root / "4.eml").write_text(eml(4, "Re: Plan", "third", 3))
    (root / "5.eml").write_text(eml(5, "New", "both", 2).replace("Date", "References: <1@x>\nDate"))  # joins two threads
    got = run()
    assert len(got) == 2 and any(all(x in c for x in ("first", "second", "third", "apart", "both")) for c in got.values())
    assert run() == got


def test_a_batch_reads_the_buckets_of_its_titles_only(spark, tmp_path):
    root, store = tmp_path / "in", f"file://{tmp_path}/store"
    root.mkdir()
    for k in range(40):
        (root / f"n{k}.txt").write_text(f"text {k}")
    run = lambda: ingest_stream(spark, f"file://{root}", store, f"file://{tmp_path}/ck", "alice", F.lit("2024-12-31").cast("timestamp")).awaitTermination(300)
    run()
    before = state(spark, store)["titles"].manifest()[3]
    (root / "late.txt").write_text("late")
    run()
    after = state(spark, store)["titles"].manifest()[3]
    assert sum(after[b] != own for b, own in before.items()) <= 1 and read_store(spark, store).count() == 41
    rows = read_store(spark, store).groupBy("owner_id").count().collect()
    assert [(r.owner_id, r["count"]) for r in rows] == [("alice", 41)]


def test_deep_pages_read_one_range(spark, tmp_path):
    n = 1_200_000
    df = spark.range(n).select(F.col("id"), F.when(F.col("id") % 1000 == 0, None).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).alias("created_at"))
    pages.write_pages(df, f"{tmp_path}/p", rows=100_000)
    got = pages.read_page(spark, f"{tmp_path}/p", 20, 10**6)
    assert len({f.split("_range=")[1].split("/")[0] for f in got.inputFiles()}) == 1
    want = sorted(((r.created_at is None, -(r.created_at or 0), r.id) for r in df.toLocalIterator()))[10**6 : 10**6 + 20]
    assert [r.id for r in got.collect()] == [x[2] for x in want]
    last = {"created_at": None if want[0][0] else -want[0][1], "id": want[0][2]}
    assert [r.id for r in pages.page_after(df, last, 19).collect()] == [x[2] for x in want[1:]]
    assert pages.read_page(spark, f"{tmp_path}/p", 20, n + 5).count() == 0 and pages.read_page(spark, f"{tmp_path}/p", 20, n - 3).count() == 3
    small = spark.createDataFrame([("a", None), ("b", 1), ("c", None), ("d", 2)], "id string, k int")
    for d, order in (("asc", "acbd"), ("desc", "dbac")):
        rows = [small.filter(F.col("id") == x).first().asDict() for x in order]
        assert ["".join(r.id for r in pages.page_after(small, x, 9, (("k", d),)).collect()) for x in [None, *rows]] == [order[k:] for k in range(5)]


def test_far_blocks_are_skipped_and_neighbours_stay_the_same(spark, monkeypatch):
    monkeypatch.setattr(search, "VECTOR_BLOCK", 32)
    rng = np.random.default_rng(7)
    middle = rng.normal(0, 1, (12, 16))
    own = np.concatenate([middle[k % 12] + rng.normal(0, 0.05, 16) for k in range(900)]).reshape(900, 16)
    own[5], own[10] = 0, own[22]
    vectors = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(own)], "id long, vector array<double>").repartition(3)
    asked = vectors.filter("id % 20 = 0")
    got = {}
    for r in search.cosine_neighbours(vectors, asked, 4).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = r.id
    unit = own / np.maximum(np.linalg.norm(own, axis=1, keepdims=True), 1e-12)
    assert got == {q: dict(enumerate(sorted(range(900), key=lambda k: (-round(float(unit[k] @ unit[q]), 9), k))[:4], 1)) for q in range(0, 900, 20)}
    pivots = H.far_apart(own.tolist(), 24)
    pairs = search.neighbour_pairs(search._blocks(asked, pivots), search._blocks(vectors, pivots), 4)
    n = {r.skipped: r["count"] for r in pairs.groupBy("skipped").count().collect()}
    assert n[True] > 5 * n[False]


@pytest.mark.parametrize("piece", [64, 1 << 18])
def test_windows_find_what_a_scan_finds(monkeypatch, piece):
    """Needles of all lengths, shared prefixes, letters of several bytes, and pieces that cut texts; the hits of a task stay within ``limit`` a needle."""
    monkeypatch.setattr(H, "PIECE", piece)
    rng = np.random.default_rng(7)
    texts = ["".join("abé "[int(x)] for x in rng.integers(0, 4, n)) for n in (0, 1, 2, 5, 40, 300, 900)] + ["customer#0000000%d" % (k % 30) + " of the same long beginning that many needles share, %d" % k for k in range(40)]
    needles = sorted({t[a : a + n] for t in texts for n in (1, 2, 3, 4, 5, 7, 8, 9, 15, 16, 17, 33, 70, 200) for a in (0, 3, len(t) - n) if 0 <= a and n <= len(t)} - {""} | {"zzz", texts[-1] + "x"})
    batch = pa.RecordBatch.from_arrays([pa.array([str(k) for k in range(len(texts))]), pa.array(["é" if k % 3 == 0 else "" for k in range(len(texts))]), pa.array(texts)], names=["id", "_t0", "_t1"])
    got = {}
    for out in H.automaton_hits(needles, list(range(len(needles))), [2, 1], 5)(iter([batch])):
        for n, score, i in zip(*(c.to_pylist() for c in out.columns)):
            got.setdefault(needles[n], []).append((-score, i))
    want = {n: sorted((-(2 if n == "é" and k % 3 == 0 else 1), str(k)) for k, t in enumerate(texts) if n in t or (n == "é" and k % 3 == 0))[:5] for n in needles}
    assert {n: sorted(x) for n, x in got.items()} == {n: x for n, x in want.items() if x}


@pytest.mark.parametrize("long", [100_000, 2])
def test_transcripts_of_long_messages_equal_the_sql(spark, tmp_path, monkeypatch, long):
    import duckdb

    import __spark_entry__ as entry

    monkeypatch.setattr(chunking, "LONG", long)
    sizes = [[10, 2500, 20, 30], [1994, 5, 1995], [4100], [900, 1200, 2001, 7, 1980]]
    rows = [(c, t, "assistant" if t % 2 else "user", f"{c}-{t} " + "x y" * (n // 3) + "z" * (n % 3)) for c, own in enumerate(sizes) for t, n in enumerate(own)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    got = sorted(map(tuple, entry.queries()["par16_transcripts"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    assert got == sorted(con.execute(entry.oracle_sql()["par16_transcripts"]).fetchall())


def test_workers_get_small_batches(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    size = H.vectorized("int")(lambda s: s.map(lambda _: len(s)))
    large = spark.range(0, 3000, 1, 1).select(size(F.repeat(F.lit("x"), 100)).alias("n")).agg(F.max("n")).first()[0]
    assert large <= 512
    few = spark.range(0, 60, 1, 1).select(size(F.repeat(F.lit("x"), 1 << 20)).alias("n")).agg(F.max("n")).first()[0]
    assert few <= 16


def test_newest_records_of_all_terms_leave_few_rows(spark, monkeypatch):
    """Blocks and groups of sets of any size find the same, and a set leaves no more rows than asked in a group of blocks."""
    monkeypatch.setattr(postings, "BLOCK", 64)
    monkeypatch.setattr(postings, "BLOCKS", 2)
    monkeypatch.setattr(postings, "SETS", 5)
    rng = np.random.default_rng(3)
    held = {str(k): sorted({f"w{int(x)}" for x in rng.zipf(1.4, 12) % 40}) for k in range(300)} | {"none": []}
    when = {i: int(rng.integers(0, 50)) for i in held}
    forward = spark.createDataFrame(list(held.items()), "id string, terms array<string>")
    dated = spark.createDataFrame(list(when.items()), "id string, created_at int")
    sets = [(k, [f"w{int(x)}" for x in rng.choice(8, 1 + k % 4, False)], 1 + k % 7) for k in range(20)] + [(20, ["w1", "unknown"], 5)]
    got = {}
    for k, i in postings.newest_holding(spark.createDataFrame(sets, "set_id int, terms array<string>, most int"), forward, dated).collect():
        got.setdefault(k, []).append(i)
    for k, terms, most in sets:
        want = sorted((i for i, h in held.items() if set(terms) <= set(h)), key=lambda i: (-when[i], i))
        assert sorted(got.get(k, []), key=lambda i: (-when[i], i))[:most] == want[:most] and len(got.get(k, [])) <= 3 * most and len(set(got.get(k, []))) == len(got.get(k, []))


def test_sets_leave_with_their_newest_records(spark, monkeypatch):
    """A set that has its records in the newest blocks isn't held against older ones, one that hasn't is found in the oldest."""
    monkeypatch.setattr(postings, "BLOCK", 64)
    monkeypatch.setattr(postings, "BLOCKS", 1)
    forward = spark.createDataFrame([(k, ["a", "old"] if k == 0 else ["a"]) for k in range(640)], "id long, terms array<string>")
    sets = spark.createDataFrame([(0, ["a"], 2), (1, ["a", "old"], 2), (2, ["a", "none"], 2)], "set_id int, terms array<string>, most int")
    got = postings.newest_holding(sets, forward, forward.select("id", F.col("id").alias("created_at"))).collect()
    assert sorted(map(tuple, got)) == [(0, 638), (0, 639), (1, 0)]


def test_tasks_hold_one_block_at_a_time(spark):
    """What is found in a block leaves before the next one is read; blocks end at many terms, and few words are bits at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    held = [(k, ["a", f"w{k}", *(["b"] if k % 3 else [])]) for k in range(200)]
    kinds = "part int, at int, ids array<long>, words binary, word_ends binary, ends binary, rows binary"
    blocks = spark.createDataFrame(held, "id long, terms array<string>").coalesce(1).mapInArrow(H.term_blocks(64, 100), kinds).toArrow().sort_by("at")
    H.small_batches()
    assert [len(x) for x in blocks["ids"].to_pylist()] == [32] * 6 + [8]
    many = [[f"w{k}", "a"] for k in range(200)]
    sets = pa.table({"key": [0] * 203, "kind": [0] * 203, "set_no": range(203), "terms": [["a", "b"], ["a"], ["none"], *many], "most": [150, 5, 5] + [9] * 200})
    rest = blocks.append_column("key", pa.array([0] * 7)).append_column("kind", pa.array([1] * 7))
    batches = [*sets.to_batches(), *rest.to_batches(max_chunksize=1)]
    read, found, when = [], {}, []
    for x in H.holding_sets(64, 8)(read.append(1) or b for b in batches):
        when.append(len(read))
        for s, i in zip(x["set_no"].to_pylist(), x["id"].to_pylist()):
            found.setdefault(s, []).append(i)
    assert when[0] == 2 and when[-1] == len(batches)
    assert found[0] == [k for k in range(200) if k % 3][:150] and found[1] == list(range(5)) and 2 not in found and all(found[3 + k] == [k] for k in range(200))


def test_few_large_rows_are_written_in_small_groups(spark):
    import pyarrow.parquet as pq

    large = spark.range(0, 24, 1, 1).select("id", F.array_join(F.transform(F.sequence(F.lit(1), F.lit(40_000)), lambda k: F.sha2(F.concat(k, F.lit("-"), "id"), 256)), "").alias("x"))
    table = scratch.written(large, few=True)
    meta = pq.ParquetFile(table.inputFiles()[0].removeprefix("file://")).metadata
    assert table.count() == 24 and max(meta.row_group(k).num_rows for k in range(meta.num_row_groups)) <= 8


def test_all_terms_are_found_by_any_groups(spark, monkeypatch):
    """Sets of many terms are cut by their terms, ranges are shared by few tasks, and no set loses or repeats a record."""
    words = lambda k: " ".join(f"word{x}" for x in range(1, 40) if k % x == 0)
    rows = spark.range(400).select(F.col("id").cast("string").alias("id"), F.col("id").alias("created_at"), F.lit("").alias("title")).collect()
    recs = spark.createDataFrame([(r.id, r.created_at, words(r.created_at)) for r in rows], "id string, created_at long, content string")
    asked = spark.createDataFrame([(x, words(x)) for x in (6, 12, 36, 60, 97, 210)] + [(0, words(0)), (1, "the of")], "query_id int, query string")
    for name, value in {"BLOCK": 64, "BLOCKS": 1, "TERMS": 9, "TASKS": 2, "FEWEST": 1, "ENTRIES": 300}.items():
        monkeypatch.setattr(postings, name, value)
    got = sorted(map(tuple, search.match_all_terms(recs, asked, ["content"], 5).collect()))
    want = []
    for q in (6, 12, 36, 60, 97, 210, 0):
        need = {x for x in range(1, 40) if q % x == 0}
        hits = [k for k in range(399, -1, -1) if all(k % x == 0 for x in need)]
        want += [(q, str(k), n) for n, k in enumerate(hits[:5], 1)]
    assert got == sorted(want)
