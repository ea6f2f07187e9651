"""A table in buckets of its keys, with a manifest: a change rewrites the buckets that it touches and then names them, all at once.

Rows lie under ``data/<name>/bucket=<k>``; a manifest row names the parts of each bucket. The manifest is written as one file, into the older
of two slots, after the data; until it is there, readers see the version before, and a change that was broken off leaves nothing but files
that nobody names. One change runs at a time; of two, one finds the other's manifest and fails. Files that were replaced aren't deleted.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notelake.sources.scratch import written

#: Rows of a bucket beyond which their number is doubled, and parts of a bucket before additions rewrite it.
BUCKET_ROWS, MOST_PARTS = 1 << 20, 16
MANIFEST = "version long, writer string, n int, bucket int, part string, rows long"


class Buckets:
    """``schema`` holds ``keys``, which aren't null; rows of one key lie in one bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: list[str], n: int = 16):
        self.spark, self.path, self.schema, self.keys, self.least = spark, path.rstrip("/"), schema, keys, n
        self.columns = spark.createDataFrame([], schema).columns

    def manifest(self) -> tuple[int, str, int, dict[int, list[tuple[str, int]]]]:
        """(version, writer, number of buckets, parts by bucket) of the newest whole manifest."""
        found = []
        for slot in (0, 1):
            try:
                found += self.spark.read.schema(MANIFEST).parquet(f"{self.path}/manifest/slot={slot}").collect()  # MOST_PARTS rows a bucket at most
            except AnalysisException:  # no such slot yet
                continue
        if not found:
            return 0, "", self.least, {}
        version, writer = max((r.version, r.writer) for r in found)
        own = [r for r in found if (r.version, r.writer) == (version, writer)]
        parts: dict[int, list[tuple[str, int]]] = {}
        for r in own:
            if r.part is not None:
                parts.setdefault(r.bucket, []).append((r.part, r.rows))
        return version, writer, own[0].n, parts

    def _commit(self, version: int, writer: str, n: int, parts: dict[int, list[tuple[str, int]]]) -> None:
        rows = [(version, writer, n, b, p, c) for b, own in parts.items() for p, c in own] or [(version, writer, n, None, None, 0)]
        self.spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/slot={version % 2}")
        if self.manifest()[:2] != (version, writer):
            raise RuntimeError(f"{self.path}: another change was made at the same time")

    def _bucket(self, n: int):
        return F.pmod(F.xxhash64(*self.keys), F.lit(n)).cast("int")

    def _rows(self, parts: dict[int, list[tuple[str, int]]], buckets=None) -> DataFrame:
        paths = [f"{self.path}/data/{p}/bucket={b}" for b, own in parts.items() if buckets is None or b in buckets for p, _ in own]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)

    def _write(self, rows: DataFrame, n: int) -> tuple[str, dict[int, int]]:
        """(name, rows by bucket) of new data."""
        name = uuid.uuid4().hex
        rows.select(*self.columns, self._bucket(n).alias("bucket")).repartition(min(n, 200), "bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{name}")
        made = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.path}/data/{name}")
        return name, {r.bucket: r["count"] for r in made.groupBy("bucket").count().collect()}

    def read(self) -> DataFrame:
        return self._rows(self.manifest()[3])

    def touched(self, keys: DataFrame) -> set[int]:
        """The buckets of some keys: no more than there are buckets."""
        return {r.b for r in keys.select(self._bucket(self.manifest()[2]).alias("b")).distinct().collect()}

    def near(self, keys: DataFrame) -> DataFrame:
        """The rows of the buckets in which ``keys`` lie; other buckets aren't read."""
        return self._rows(self.manifest()[3], self.touched(keys))

    def of(self, keys: DataFrame) -> DataFrame:
        """The rows of ``keys``."""
        return self.near(keys).join(keys.select(*self.keys).distinct(), self.keys, "left_semi")

    def replace(self, keys: DataFrame | None, rows: DataFrame) -> set[int]:
        """Rows of ``keys`` (all where null) go and ``rows`` come; gives the buckets that were rewritten."""
        version, _, n, parts = self.manifest()
        rows = written(rows.select(*self.columns))
        have = 0 if keys is None else sum(c for own in parts.values() for _, c in own)
        size = n
        while have + rows.count() > size * BUCKET_ROWS:
            size *= 2
        if size > n and keys is not None:  # everything moves; as their number doubles, a row moves a bounded number of times on average
            rows, keys = written(self._rows(parts).join(keys.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(rows)), None
        if keys is None:
            name, made = self._write(rows, size)
            self._commit(version + 1, uuid.uuid4().hex, size, {b: [(name, c)] for b, c in made.items()})
            return set(made)
        keys = written(keys.select(*self.keys).distinct())
        touched = self.touched(keys) | self.touched(rows)
        if touched:
            kept = self._rows(parts, touched).join(keys, self.keys, "left_anti")
            name, made = self._write(kept.unionByName(rows), n)
            self._commit(version + 1, uuid.uuid4().hex, n, {b: own for b, own in parts.items() if b not in touched} | {b: [(name, c)] for b, c in made.items()})
        return touched

    def add(self, rows: DataFrame) -> set[int]:
        """``rows`` come beside those that are there; buckets of many parts, and tables that outgrow their buckets, are rewritten."""
        version, _, n, parts = self.manifest()
        rows = written(rows.select(*self.columns))
        touched = self.touched(rows)
        if sum(c for own in parts.values() for _, c in own) + rows.count() > n * BUCKET_ROWS or any(len(parts.get(b, [])) >= MOST_PARTS for b in touched):
            return self.replace(rows.select(*self.keys).limit(0), rows)
        if touched:
            name, made = self._write(rows, n)
            self._commit(version + 1, uuid.uuid4().hex, n, {b: parts.get(b, []) + ([(name, made[b])] if b in made else []) for b in parts.keys() | made.keys()})
        return touched

    def merge(self, changes: DataFrame, change) -> set[int]:
        """``change(rows) -> rows`` is applied to the rows of the buckets in which ``changes`` (with the keys) lie, and those are switched at once."""
        near = written(self.near(changes))
        new = written(change(near))
        return self.replace(near.select(*self.keys).unionByName(changes.select(*self.keys)), new)
