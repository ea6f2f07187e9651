"""URL filters: host and path rules, then a list of canonical URLs behind a blocked Bloom filter.

Putze, Sanders and Singler, "Cache-, Hash- and Space-Efficient Bloom Filters" (2007): all bits of a key lie in one block, here 256
bits in four longs of one row. The filter is built by ``bit_or`` and probed by an equi-join on the block number; possible hits go to
an exact join with the list, which removes false positives. Built-in functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notelake.llm.text import written

#: (verdict, host, path prefix).
RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
#: Bits set a key, and bits of filter a key.
BITS, BITS_PER_KEY = 8, 16
#: The filter is broadcast up to this many bytes; beyond, its blocks are joined by a shuffle.
BROADCAST_BYTES = 32 << 20
#: Keys of the exact list up to which it is broadcast too; beyond, possible hits are shuffled to it.
BROADCAST_KEYS = 200_000
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(host: Column, path: Column) -> Column:
    """Host without ``www.`` or ``m.``, path without a last ``.html`` or slash; scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"(\.html|/)$", ""))


def rule_fits(rule, host: Column, path: Column) -> Column:
    _, name, prefix = rule
    return ((host == name) | host.endswith("." + name)) & path.startswith(prefix)


def ruled(host: Column, path: Column, rules, value) -> Column:
    """``value(rule)`` of the longest rule that fits, else null."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r[1] + r[2])):
        out = F.when(rule_fits(rule, host, path), F.lit(value(rule))).otherwise(out)
    return out


def _masks(key: Column) -> list[Column]:
    """The four longs of a key's bits within its block."""
    h = F.xxhash64(key, F.lit(17))
    places = [F.shiftrightunsigned(h, 8 * k).bitwiseAND(255) for k in range(BITS)]
    out = []
    for word in range(4):
        bits = F.lit(0).cast("long")
        for p in places:
            bits = bits.bitwiseOR(F.when(F.shiftrightunsigned(p, 6) == word, F.call_function("shiftleft", F.lit(1).cast("long"), p.bitwiseAND(63).cast("int"))).otherwise(F.lit(0).cast("long")))
        out.append(bits)
    return out


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """(block, w0…w3) of the column ``url``; blocks without a key are absent."""
    block = F.pmod(F.xxhash64("url"), F.lit(n_blocks)).alias("_block")
    words = [m.alias(f"_w{k}") for k, m in enumerate(_masks(F.col("url")))]
    return listed.select(block, *words).groupBy("_block").agg(*(F.bit_or(f"_w{k}").alias(f"_w{k}") for k in range(4)))


def listed_urls(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """``rows`` (with a column ``_url``) and ``_listed``: whether it is one of ``listed.url``. Null URLs are not listed. The list is written
    once; rows are read once where it is small enough to be broadcast, else possible hits and the rest take two branches."""
    listed = written(listed.select(F.col("url").cast("string").alias("url")).dropna().distinct())
    n = listed.count()
    n_blocks = max(1, -(-n * BITS_PER_KEY // 256))
    blocks = bloom_blocks(listed, n_blocks)
    blocks = F.broadcast(blocks) if n_blocks * 64 <= BROADCAST_BYTES else blocks
    hit = F.col("_url").isNotNull()
    for k, m in enumerate(_masks(F.col("_url"))):
        hit = hit & (F.col(f"_w{k}").bitwiseAND(m) == m)
    probed = rows.withColumn("_block", F.pmod(F.xxhash64("_url"), F.lit(n_blocks))).join(blocks, "_block", "left")
    probed = probed.withColumn("_hit", F.coalesce(hit, F.lit(False))).drop("_block", "_w0", "_w1", "_w2", "_w3")
    found = listed.withColumn("_found", F.lit(True))
    if n <= BROADCAST_KEYS:
        exact = probed.join(F.broadcast(found), F.when(F.col("_hit"), F.col("_url")) == F.col("url"), "left")
        return exact.withColumn("_listed", F.coalesce("_found", F.lit(False))).drop("url", "_found", "_hit")
    no = probed.filter(~F.col("_hit")).withColumn("_listed", F.lit(False))
    yes = probed.filter("_hit").join(found, F.col("_url") == F.col("url"), "left").withColumn("_listed", F.coalesce("_found", F.lit(False)))
    return no.unionByName(yes.drop("url", "_found")).drop("_hit")


def url_verdicts(pages: DataFrame, listed: DataFrame, rules=tuple(RULES)) -> DataFrame:
    """page_id, host, path, rule, verdict, listed.

    A rule decides where one fits; elsewhere a listed canonical URL is blocked and any other allowed. A null URL, or one without
    ``://``, has an empty host and path, no rule, and is allowed. Repeated rows give repeated rows; other columns aren't looked at.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"))
    host, path = F.col("host"), F.col("path")
    rows = rows.withColumn("rule", ruled(host, path, rules, lambda r: r[1] + r[2])).withColumn("_verdict", ruled(host, path, rules, lambda r: r[0]))
    rows = rows.withColumn("_url", F.when(host != "", canonical(host, path)))
    out = listed_urls(rows, listed)
    verdict = F.coalesce("_verdict", F.when(F.col("_listed"), F.lit("block")).otherwise(F.lit("allow")))
    return out.select("page_id", "host", "path", "rule", verdict.alias("verdict"), F.col("_listed").alias("listed"))


def urls_beside_marks(pages: DataFrame, title: str) -> DataFrame:
    """A list of canonical URLs: those of hosts (without ``www.`` or ``m.``) on which some page under another canonical URL has a title that matches
    ``title``. What a page says itself never lists it."""
    url = F.col("url").cast("string")
    marked = F.coalesce(F.regexp_extract(F.col("html").cast("string"), "(?is)<title>(.*?)</title>", 1).rlike(title), F.lit(False)).cast("int")
    rows = pages.select(host_of(url).alias("_h"), path_of(url).alias("_p"), marked.alias("_m")).filter("_h <> ''")
    rows = rows.select(canonical(F.col("_h"), F.lit("")).alias("host"), canonical(F.col("_h"), F.col("_p")).alias("url"), "_m")
    each = rows.groupBy("host", "url").agg(F.max("_m").alias("_m"))
    hosts = each.groupBy("host").agg(F.sum("_m").alias("n")).filter("n > 0")
    return each.join(hosts, "host").filter("n > _m").select("url").distinct()
