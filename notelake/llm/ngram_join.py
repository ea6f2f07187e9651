"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets.

Deng, Tao and Li, "Overlap Set Similarity Joins with Theoretical Guarantees" (2018), carried over to Jaccard similarity 0.8: two sets
of n and m shingles link when they share at least ceil(4 (n + m) / 9). Under one global order (shingles that a sample shows to be
frequent come last, the others by hash) such sets share c shingles within short prefixes, so

* light sets (n <= boundary) enumerate the subsets of c = 2 of their prefix, and meet where they share a subset;
* heavy sets meet every set of matching size in the inverted lists of single prefix shingles (c = 1).

The boundary is the largest n for which enumerating subsets costs less than scanning lists of the measured mean length. The order and
the boundary decide about cost only; every linked pair is found for any of them, and every candidate is verified on whole sets.

Equal sets count as one, and of lists with the same members one is kept. Lists aren't expanded into pairs: each member is verified
against its lists' first members, and components are formed; then members of one list that lie in different components are compared by
their sketches, block by block, and what may link is verified. Every link lies within a component, so the links of each document are
counted there, again block by block on whole sets: no pair of a dense group becomes a row. Lists of shingles known to be frequent are
shuffled as joins whose hot keys can be split; the others, short by selection, are shuffled once.
Shingles are 64-bit hashes; sets are told apart by a 128-bit digest, and by its first half while pairs are sought.
"""

from __future__ import annotations

import gc
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import as_bytes, map_batches, window_hashes, word_hashes, written

WIDTH = 5
#: One in so many documents is looked at to find frequent shingles, in how many of them one is frequent, and how many are kept at most.
ORDER_SAMPLE, FREQUENT_IN, FREQUENT = 6, 3, 500_000
#: Ids of documents whose whole sets are wanted are broadcast up to this many; beyond, they are joined by a shuffle.
WANTED = 1_000_000
#: Members and shingles in a chunk of a component or list, about; two chunks make a block.
CHUNK, CHUNK_SHINGLES = 192, 500_000
#: Columns of a slab of a block's incidence matrix.
SLAB = 4096
#: Bits of a set's odd sketch (Mitzenmacher, Pagh and Pham, "Efficient Estimation for High Similarities using Odd Sketches", 2014).
SKETCH = 512
#: Rounds in which list members are compared with first members: how many different first members lists of the same sets can have.
STARS = (8, 64)
#: One in so many prefix shingles measures the mean length of the lists.
LIST_SAMPLE = 64


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles in ascending order; a shorter text is one shingle, a text without words none."""
    words = word_hashes(text)
    if not len(words):
        return words
    return np.unique(window_hashes(words, WIDTH if len(words) >= WIDTH else len(words)) + np.uint64(WIDTH - min(len(words), WIDTH)))


def least_overlap(n: int, m: int) -> int:
    return -(-4 * (n + m) // 9)


def prefix(n: int, c: int) -> int:
    """Length of the prefix in which a set shares c shingles with every linked set that is smaller or equal."""
    return n - least_overlap(n, -(-4 * n // 5)) + c


def short_prefix(n: int, c: int) -> int:
    """The same for linked sets that are larger or equal."""
    return n - least_overlap(n, n) + c


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Shingles of many sampled documents, ascending: a hint for the order, bounded by FREQUENT."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(ORDER_SAMPLE)) == 0)

    def f(text):
        sets = [shingles(x) for x in as_bytes(text)]
        value, count = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.empty(0, np.uint64), np.empty(0, int))
        return value.view(np.int64), count

    counts = map_batches(some.select("text"), "shingle long, n long", lambda: f).groupBy("shingle").agg(F.sum("n").alias("n"))
    top = counts.filter(F.col("n") >= FREQUENT_IN).orderBy(F.desc("n"), "shingle").limit(FREQUENT).select("shingle").toPandas()
    return np.sort(top["shingle"].to_numpy(np.int64).view(np.uint64))


def digest(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def shingle_sets(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """doc_id, n_shingles, set_key, set_id (its first half), prefix (the longest that is needed, in the global order), how many of
    its shingles aren't frequent, and bits (SKETCH bits; one is set when an odd number of the set's shingles fall on it)."""
    known = docs.sparkSession.sparkContext.broadcast(frequent)

    def make():
        common = known.value

        def f(doc_id, text):
            sizes, keys, prefixes, rare, bits = [], [], [], [], []
            for x in as_bytes(text):
                own = shingles(x)
                sizes.append(len(own))
                keys.append(digest(own))
                marks = np.bincount((own >> np.uint64(20)).astype(np.int64) % SKETCH, minlength=SKETCH) & 1
                bits.append(np.packbits(marks.astype(np.uint8)).view(np.int64))
                k = prefix(len(own), 2) if len(own) > 1 else 0
                few = k
                if len(common) and k:
                    late = common[np.minimum(np.searchsorted(common, own), len(common) - 1)] == own
                    first = own[~late]
                    few = min(k, len(first))
                    own = first if len(first) >= k else np.concatenate([first, own[late]])
                prefixes.append(own[:k].view(np.int64))
                rare.append(few)
            ends = np.cumsum([0, *map(len, prefixes)])
            flat = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes), pa.int64()))
            return doc_id, sizes, keys, [int.from_bytes(k[:8], "little", signed=True) for k in keys], flat, rare, bits

        return f

    own = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return map_batches(own, "doc_id long, n_shingles long, set_key binary, set_id long, prefix array<long>, rare int, bits array<long>", make)


def cheapest_boundary(mean_list: float, most: int = 2000) -> int:
    """The largest size at which the subsets of two in a prefix are fewer than the postings that single shingles have scanned."""
    fits = [n for n in range(2, most) if prefix(n, 2) * (prefix(n, 2) - 1) // 2 <= prefix(n, 1) * (1 + mean_list)]
    return max(fits, default=1)


def postings(sets: DataFrame, boundary: int) -> DataFrame:
    """key, id and meta of each set (set_id, n_shingles, prefix, rare). meta is 16 n + bits: 1 the key lies in the short prefix, 2 the set
    is light, 4 the key is a subset, 8 the key is made of frequent shingles."""

    def f(ident, size, rows, rare):
        keys, ids, metas = [], [], []
        flat, ends = rows.flatten().to_numpy().view(np.uint64), rows.offsets.to_numpy() - rows.offsets[0].as_py()
        for k, (i, n, few) in enumerate(zip(ident.to_pylist(), size.to_pylist(), rare.to_pylist())):
            own, light, made = flat[ends[k] : ends[k + 1]], n <= boundary, 0
            if light:
                a, b = np.triu_indices(len(own), 1)
                low, high = np.minimum(own[a], own[b]), np.maximum(own[a], own[b])
                keys.append(low * np.uint64(0x9E3779B97F4A7C15) ^ (high + np.uint64(0x7F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F))
                metas.append(16 * n + 6 + (b < short_prefix(n, 2)) + 8 * (a >= few))
                made += len(a)
            if not light or n >= -(-4 * (boundary + 1) // 5):  # a light set that a heavy one may link to
                single = own[: prefix(n, 1)]
                place = np.arange(len(single))
                keys.append(single)
                metas.append(16 * n + 2 * light + (place < short_prefix(n, 1)) + 8 * (place >= few))
                made += len(single)
            ids.append(np.full(made, i, np.int64))
        if not keys:
            return [], [], []
        return np.concatenate(keys).view(np.int64), np.concatenate(ids), np.concatenate(metas).astype(np.int64)

    return map_batches(sets.select("set_id", "n_shingles", "prefix", "rare"), "key long, id long, meta long", lambda: f)


def met_in_lists(posted: DataFrame) -> DataFrame:
    """key, id and meta of lists of at least two sets; of lists with the same members only the one of the least key."""
    parts, found = [], None
    for hot in (False, True):
        own = posted.filter(F.col("meta").bitwiseAND(8) == 8 * hot)
        own = own if hot else own.repartition("key")  # one exchange serves the aggregate and the join
        h = F.xxhash64("id").cast("decimal(20,0)")
        lists = own.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high"), F.sum(h).alias("sum"), F.bit_xor("id").alias("xor"), F.count("*").alias("n")).filter("low <> high")
        parts.append(own)
        found = lists if found is None else found.unionByName(lists)
    kept = written(found.groupBy("low", "high", "sum", "xor", "n").agg(F.min("key").alias("key")).select("key"))
    return parts[0].join(kept.hint("merge"), "key").unionByName(parts[1].join(kept, "key"))


def whole_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """id, own: the whole sets of the documents in ``wanted`` (doc_id)."""
    ids = written(wanted.select(F.col("doc_id").alias("_id")).distinct())
    ids = F.broadcast(ids) if ids.count() <= WANTED else ids
    some = docs.join(ids, F.col("doc_id") == F.col("_id"), "left_semi").select("text")

    def f(text):
        sets = [shingles(x) for x in as_bytes(text)]
        return [int.from_bytes(digest(x)[:8], "little", signed=True) for x in sets], [x.view(np.int64) for x in sets]

    return map_batches(some, "id long, own array<long>", lambda: f)


def linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    one = sets.select(F.col("id").alias("b"), F.col("own").alias("_b"))
    two = sets.select(F.col("id").alias("a"), F.col("own").alias("_a"))
    both = pairs.select("a", "b").join(one, "b").join(two, "a")
    return both.filter(9 * F.size(F.array_intersect("_a", "_b")) >= 4 * (F.size("_a") + F.size("_b"))).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """id, comp: the smallest id that is reachable; least labels spread along edges and jump along themselves until none changes."""
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.min("b").alias("m")).select("id", F.least("id", "m").alias("comp")))
    while True:
        seen = both.join(labels, F.col("b") == F.col("id")).groupBy("a").agg(F.min("comp").alias("m"))
        nearer = labels.join(seen, F.col("id") == F.col("a"), "left").select("id", F.col("comp").alias("old"), F.least("comp", "m").alias("comp"))
        root = nearer.select(F.col("id").alias("r"), F.col("comp").alias("up"))
        jumped = written(nearer.join(root, F.col("comp") == F.col("r"), "left").select("id", "old", F.least("comp", "up").alias("comp")))
        labels = jumped.select("id", "comp")
        if jumped.filter("old <> comp").isEmpty():
            return labels


def star_pairs(met: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(a, b): each list's first member, by one of ``most`` hashes, and its members of other components."""
    placed = met.join(labels, "id", "left").select("key", "id", "meta", F.coalesce("comp", "id").alias("comp"))
    order = F.xxhash64("id", F.pmod("key", F.lit(most)))
    lists = placed.groupBy("key").agg(F.min(F.struct(order.alias("o"), F.col("id").alias("i"), F.col("meta").alias("m"), F.col("comp").alias("c"))).alias("f"), F.min("comp").alias("low"), F.max("comp").alias("high"))
    rows = placed.join(lists.filter("low <> high").select("key", "f"), "key").filter("comp <> f.c")
    n, m = F.shiftright("meta", 4), F.shiftright("f.m", 4)
    return rows.filter(5 * F.least(n, m) >= 4 * F.greatest(n, m)).select(F.least("f.i", "id").alias("a"), F.greatest("f.i", "id").alias("b")).distinct()


def in_blocks(members: DataFrame, columns: str) -> DataFrame:
    """``members`` (g, id, n, weight and the columns) dealt to the blocks of their group: a group of several chunks (by a hash of the id) has a
    block for each two of them, i <= j, and ``side`` says which of them a row is of. Rows of a block lie together in a partition."""
    size = members.groupBy("g").agg(F.greatest(F.ceil(F.count("*") / CHUNK), F.ceil(F.sum("n") / CHUNK_SHINGLES)).cast("int").alias("_k"))
    own = members.join(size, "g").withColumn("_c", F.pmod(F.xxhash64("id", F.lit(5)), F.col("_k")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("_k") - 1)).alias("_d")
    dealt = own.select("*", other).select("g", F.least("_c", "_d").alias("i"), F.greatest("_c", "_d").alias("j"), (F.col("_c") > F.col("_d")).alias("side"), *columns.split())
    return dealt.repartition("g", "i", "j").sortWithinPartitions("g", "i", "j")


def blocks_of(batches):
    """Of sorted rows (g, i, j, side, …): ((g, i, j), whether each row is of the second chunk, the other columns) of each block."""
    key, held = None, []
    for batch in batches:
        columns = [c.to_pylist() if not pa.types.is_list(c.type) else list(_arrays(c)) for c in batch.columns]
        for row in zip(*columns):
            if row[:3] != key:
                if held:
                    yield key, np.array([r[3] for r in held]), list(zip(*(r[4:] for r in held)))
                key, held = row[:3], []
            held.append(row)
    if held:
        yield key, np.array([r[3] for r in held]), list(zip(*(r[4:] for r in held)))


def _arrays(column: pa.Array):
    """The lists of a list column as numpy arrays."""
    flat, ends = column.flatten().to_numpy(), column.offsets.to_numpy() - column.offsets[0].as_py()
    return (flat[a:b].view(np.uint64) for a, b in zip(ends, ends[1:]))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, by products of incidence slabs; shingles that only one set has are left out."""
    value, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows = np.repeat(np.arange(len(sets)), [len(x) for x in sets])
    shared = count[code] > 1
    rows, code = rows[shared], (np.cumsum(count > 1) - 1)[code[shared]]
    order = np.argsort(code, kind="stable")
    rows, code = rows[order], code[order]
    out = np.zeros((len(sets), len(sets)), np.float32)
    for at in range(0, int(code[-1]) + 1 if len(code) else 0, SLAB):
        a, b = np.searchsorted(code, [at, at + SLAB])
        slab = np.zeros((len(sets), min(SLAB, int(code[-1]) + 1 - at)), np.float32)
        slab[rows[a:b], code[a:b] - at] = 1
        out += slab @ slab.T
    return out


def links_of(same: bool, side: np.ndarray, sets) -> np.ndarray:
    """Which two members of a block link; within one chunk each two, else only those of different chunks."""
    n = np.array([len(x) for x in sets], np.float64)
    hit = 9 * overlaps(list(sets)).astype(np.float64) >= 4 * (n[:, None] + n[None])
    np.fill_diagonal(hit, False)
    return hit if same else hit & (side[:, None] != side[None])


def component_members(labels: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """g (component), id, n, weight (copies) and own (the whole set) of every set that links with another."""
    members = labels.join(classes.select(F.col("set_id").alias("id"), "doc_id", F.col("n_shingles").alias("n"), F.col("n_copies").alias("weight")), "id")
    sets = whole_sets(docs, members).dropDuplicates(["id"])
    return members.select(F.col("comp").alias("g"), "id", "n", "weight").join(sets, "id")


def link_counts(members: DataFrame) -> DataFrame:
    """id, far: the documents of other sets that each set links with. A row a member and block leaves a task, not one a pair."""

    def run(batches):
        for (_, i, j), side, (ids, weights, sets) in blocks_of(batches):
            far = links_of(i == j, side, sets) @ np.array(weights, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(far, pa.int64())], names=["id", "far"])

    return in_blocks(members, "id weight own").mapInArrow(run, "id long, far long").groupBy("id").agg(F.sum("far").alias("far"))


def link_pairs(members: DataFrame) -> DataFrame:
    """(a, b): every two sets that link, once. For those who want the pairs themselves."""

    def run(batches):
        for (_, i, j), side, (ids, sets) in blocks_of(batches):
            x, y = np.nonzero(np.triu(links_of(i == j, side, sets)))
            ids = np.array(ids, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y])], names=["a", "b"])

    return in_blocks(members, "id own").mapInArrow(run, "a long, b long")


def doc_ids(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The documents that stand for the sets of the pairs."""
    ids = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    return ids.join(classes, "set_id").select("doc_id")


def _left(x: str, y: str) -> Column:
    """What the overlap can have beyond the prefixes: common shingles up to the earlier one of the prefixes' ends lie in both prefixes, so
    the rest of the set whose prefix ends earlier."""
    return F.when(F.col(f"{x}.end") <= F.col(f"{y}.end"), F.col(f"{x}.n") - F.col(f"{x}.p")).otherwise(F.col(f"{y}.n") - F.col(f"{y}.p"))


def may_share(x: str, y: str, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles may link by their odd sketches: no more bits differ than the shingles that only one has, and of
    those linked sets have at most (n + m) / 9."""
    differ = [F.bit_count(F.col(x)[k].bitwiseXOR(F.col(y)[k])) for k in range(SKETCH // 64)]
    return 9 * sum(differ[1:], differ[0]) <= n + m


def plausible(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that may link by their sketches and prefixes."""
    wanted = pairs.select(F.col("a").alias("set_id")).union(pairs.select("b")).distinct()
    end = F.struct(F.size("prefix") > F.col("rare"), F.element_at("prefix", -1).bitwiseXOR(F.lit(-(1 << 63))))
    own = written(sets.join(wanted, "set_id", "left_semi"))
    own = own.select("set_id", F.struct(F.col("n_shingles").alias("n"), F.size("prefix").alias("p"), end.alias("end"), "prefix", "bits").alias("h"))
    both = pairs.join(own.select(F.col("set_id").alias("b"), F.col("h").alias("y")), "b").join(own.select(F.col("set_id").alias("a"), F.col("h").alias("x")), "a")
    both = both.filter(may_share("x.bits", "y.bits", F.col("x.n"), F.col("y.n")))
    return both.filter(9 * (F.size(F.array_intersect("x.prefix", "y.prefix")) + _left("x", "y")) >= 4 * (F.col("x.n") + F.col("y.n"))).select("a", "b")


def apart_pairs(placed: DataFrame, classes: DataFrame) -> DataFrame:
    """(a, b): members of one list (key, id, meta, comp) of different components that may link by size and sketch, compared block by block.
    Sets that meet in several lists leave a task once, from the list of the least key that both are in."""
    more = placed.groupBy("id").agg(F.array_sort(F.collect_list("key")).alias("keys"))  # no more than the set's postings
    rows = placed.join(more, "id").join(classes.select(F.col("set_id").alias("id"), "bits"), "id")
    members = rows.select(F.col("key").alias("g"), "id", F.shiftright("meta", 4).alias("size"), F.lit(SKETCH // 64).alias("n"), "comp", "bits", "keys")

    def run(batches):
        for (key, i, j), side, (ids, sizes, comps, sketches, keys) in blocks_of(batches):
            ids, n, comp, x = np.array(ids, np.int64), np.array(sizes, np.int64), np.array(comps, np.int64), np.stack(sketches)
            differ = np.zeros((len(ids), len(ids)), np.int64)
            for w in range(x.shape[1]):
                differ += np.bitwise_count(x[:, None, w] ^ x[None, :, w])
            both = n[:, None] + n[None]
            hit = np.triu((comp[:, None] != comp[None]) & (5 * np.minimum(n[:, None], n[None]) >= 4 * np.maximum(n[:, None], n[None])) & (9 * differ <= both), 1)
            hit = hit if i == j else hit & (side[:, None] != side[None])
            own = [frozenset(k.view(np.int64).tolist()) for k in keys]
            here = [(a, b) for a, b in np.argwhere(hit).tolist() if min(own[a] & own[b]) == key]
            a, b = np.array(here, np.int64).reshape(-1, 2).T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(ids[a], ids[b])), pa.array(np.maximum(ids[a], ids[b]))], names=["a", "b"])

    return in_blocks(members, "id size comp bits keys").mapInArrow(run, "a long, b long").distinct()


def met_sets(classes: DataFrame) -> DataFrame:
    """The lists of at least two different sets: key, id, meta."""
    some = F.filter("prefix", lambda k: F.pmod(k, F.lit(LIST_SAMPLE)) == 0)
    sampled = classes.select(F.explode(some).alias("key")).groupBy("key").count()
    mean = sampled.agg((F.sum(F.col("count") * F.col("count")) / F.sum("count")).alias("m")).first()["m"] or 1.0
    return written(met_in_lists(postings(classes, cheapest_boundary(mean))))


def let_go(docs: DataFrame) -> None:
    """Spark deletes the shuffle files of plans that are no longer referred to when the driver collects garbage: have it do so now."""
    gc.collect()
    docs.sparkSession.sparkContext._jvm.System.gc()


def set_components(classes: DataFrame, docs: DataFrame) -> DataFrame:
    """id, comp (both set_ids) of the sets that link with another."""
    many = classes.filter("n_shingles > 1")
    met = met_sets(many)
    let_go(docs)
    labels = met.select("id").distinct().withColumn("comp", F.col("id"))
    found = compared = None
    for most in STARS:
        tried = written(plausible(star_pairs(met, labels, most), many))
        links = written(linked(tried, whole_sets(docs, doc_ids(tried, classes))))
        found, compared = (links, tried) if found is None else (found.union(links), compared.union(tried))
        labels = components(found)
        let_go(docs)
    # What is left: members of one list that lie in different components and were not compared.
    placed = met.join(labels, "id", "left").select("key", "id", "meta", F.coalesce("comp", "id").alias("comp"))
    open_lists = placed.groupBy("key").agg(F.min("comp").alias("_low"), F.max("comp").alias("_high")).filter("_low <> _high").select("key")
    rest = apart_pairs(written(placed.join(open_lists, "key", "left_semi")), many)
    rest = written(plausible(written(rest.join(compared, ["a", "b"], "left_anti")), many))
    more = written(linked(rest, whole_sets(docs, doc_ids(rest, classes))))
    let_go(docs)
    return labels if more.isEmpty() else components(found.union(more).union(labels.select(F.col("comp").alias("a"), F.col("id").alias("b"))))


def set_rows(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(docs, a row of each document's set, those that can link, classes of equal sets with their first doc_id and n_copies)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(shingle_sets(docs, frequent_shingles(docs)))
    filled = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = filled.groupBy("set_key", "set_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("n_copies"), *(F.first(c).alias(c) for c in ("n_shingles", "prefix", "rare", "bits")))
    return docs, rows, filled, written(classes)


def placed_documents(rows: DataFrame, classes: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies, set_id (null where a document has no set) by the components of sets."""
    named = labels.join(classes.select(F.col("set_id").alias("id"), "doc_id"), "id")
    first = named.groupBy("comp").agg(F.min("doc_id").alias("_first"))
    place = named.select(F.col("id").alias("set_id"), "comp").distinct().join(first, "comp").select("set_id", "_first")
    place = classes.join(place, "set_id", "left").select("set_key", "set_id", "n_copies", F.coalesce("_first", "doc_id").alias("component_id"))
    keyed = rows.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("set_key")).alias("set_key"))
    joined = keyed.filter("set_key IS NOT NULL").join(place, "set_key").select("doc_id", "n_shingles", "component_id", "n_copies", "set_id")
    alone = keyed.filter("set_key IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("n_copies"), F.lit(None).cast("long").alias("set_id"))
    return joined.unionByName(alone)


def class_links(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs: a, b, every two classes of equal sets that link; members: doc_id, class). A class is named by its smallest doc_id; its
    members link with each other and with all members of the linked classes."""
    docs, rows, filled, classes = set_rows(docs)
    name = classes.select("set_id", F.col("doc_id").alias("class"))
    pairs = written(link_pairs(component_members(set_components(classes, docs), classes, docs)))
    pairs = pairs.join(name.select(F.col("set_id").alias("a"), F.col("class").alias("_a")), "a").join(name.select(F.col("set_id").alias("b"), F.col("class").alias("_b")), "b")
    return pairs.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")), filled.select("doc_id", "set_id").join(name, "set_id").select("doc_id", "class")


def ngram_join(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, n_copies (documents of the same set, itself included), n_links (other documents it links with,
    those of the same set included).

    A null or blank text has no shingles and stays alone. Rows that share a doc_id are looked at one by one. A null doc_id links with
    nothing and has a null component. Other columns of ``docs`` are not looked at; an empty table gives no rows.
    """
    docs, rows, filled, classes = set_rows(docs)
    labels = set_components(classes, docs)
    far = written(link_counts(component_members(labels, classes, docs))).withColumnRenamed("id", "set_id")
    let_go(docs)
    placed = placed_documents(rows, classes, labels).join(far, "set_id", "left")
    return placed.select("doc_id", "n_shingles", "component_id", "n_copies", (F.col("n_copies") - 1 + F.coalesce("far", F.lit(0))).alias("n_links"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near copies: of each component the row of the smallest doc_id stays. Only components are sought."""
    narrow, rows, filled, classes = set_rows(docs)
    placed = placed_documents(rows, classes, set_components(classes, narrow))
    kept = placed.filter("doc_id = component_id OR doc_id IS NULL").select(F.col("doc_id").alias("_id")).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col("_id")), "left_semi")
