"""Catalogue tables in versions, cut into buckets by URL, so that a batch rewrites only its part.

A table is a folder with ``data``, whose sub-folders hold the buckets that one write made, and
``manifest``, which has for each version the folder of every bucket. A write reads the buckets its URLs
fall into, writes their next state beside the old one, and then names it in the next manifest: until that is there
nothing has changed, and a failed write leaves files that no version names. Readers keep the version they began with.
One writer at a time: of two that start from the same version the second fails, as its manifest is taken.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from playbill.functions import urls
from playbill.operators import upsert as operators
from playbill.operators.grouping import keep_last
from playbill.session import computed, discard, written

_MANIFEST = "kind string, name string, value bigint"


@dataclass(frozen=True)
class Version:
    """What a manifest says: at most one entry a bucket and one a stream."""

    number: int
    buckets: int
    folders: dict[int, str] = field(default_factory=dict)
    commits: dict[str, int] = field(default_factory=dict)
    rows: dict[int, int] = field(default_factory=dict)

    def has(self, commit: tuple[str, int] | None) -> bool:
        """Whether a batch of a stream has been written already."""
        return commit is not None and self.commits.get(commit[0], -1) >= commit[1]


@dataclass(frozen=True)
class VersionedTable:
    """The table of records at ``path``, keyed by ``url``; ``schema`` is its layout as DDL."""

    spark: SparkSession
    path: str
    schema: str

    @classmethod
    def create(cls, spark: SparkSession, path: str, schema: str, buckets: int = 256) -> VersionedTable:
        """An empty table. A bucket is read and written as a whole, so take as many as keep each within a task's reach."""
        table = cls(spark, path, schema)
        table._name(Version(0, buckets))
        return table

    def _name(self, version: Version) -> None:
        rows = [("buckets", None, version.buckets)]
        rows += [("bucket", folder, bucket) for bucket, folder in version.folders.items()]
        rows += [("rows", str(bucket), n) for bucket, n in version.rows.items()]
        rows += [("commit", stream, batch) for stream, batch in version.commits.items()]
        table = self.spark.createDataFrame(rows, _MANIFEST).coalesce(1)
        table.write.mode("errorifexists").parquet(f"{self.path}/manifest/version={version.number}")

    def manifests(self) -> DataFrame:
        """All versions still kept: ``kind``, ``name``, ``value``, ``version``."""
        return self.spark.read.schema(f"{_MANIFEST}, version bigint").parquet(f"{self.path}/manifest")

    def version(self, number: int | None = None) -> Version:
        """A version, by default the newest."""
        rows = self.manifests()
        if number is None:
            number = rows.agg(F.max("version")).first()[0]
        held = rows.where(F.col("version") == number).collect()
        if not held:
            raise ValueError(f"no version {number} of {self.path}")
        return Version(
            number,
            next(r["value"] for r in held if r["kind"] == "buckets"),
            {r["value"]: r["name"] for r in held if r["kind"] == "bucket"},
            {r["name"]: r["value"] for r in held if r["kind"] == "commit"},
            {int(r["name"]): r["value"] for r in held if r["kind"] == "rows"},
        )

    def read(self, version: int | Version | None = None, buckets: list[int] | None = None) -> DataFrame:
        """The rows of a version, or of some of its buckets alone."""
        at = version if isinstance(version, Version) else self.version(version)
        wanted = at.folders if buckets is None else {b: at.folders[b] for b in buckets if b in at.folders}
        if not wanted:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(wanted.items())])

    @staticmethod
    def bucket_of(url: Column, buckets: int) -> Column:
        return F.pmod(F.xxhash64(urls.strip_slash(url)), F.lit(buckets)).cast("int")

    def rewrite(
        self, keys: DataFrame, change: Callable[[DataFrame], DataFrame], commit: tuple[str, int] | None = None, now: Version | None = None
    ) -> Version:
        """The next version: ``change`` gives the new rows of the buckets that the ``url`` of ``keys`` fall into from their old ones;
        all other buckets stay the files they are.

        ``commit`` names a stream and a batch of it. A batch that is not behind the last one named for its stream has been
        written before, and nothing happens; so a batch may be repeated after a failure. ``now`` is the newest version, if known.
        """
        now = now or self.version()
        if now.has(commit):
            return now
        bucket = self.bucket_of(F.col("url"), now.buckets)
        # As many integers as there are buckets at most.
        touched = sorted(r[0] for r in keys.select(bucket.alias("b")).distinct().collect())
        folders, sizes = dict(now.folders), dict(now.rows)
        if touched:
            folder = uuid.uuid4().hex
            rows = change(self.read(now, touched)).select(*self.spark.createDataFrame([], self.schema).columns)
            parts = rows.withColumn("bucket", bucket).repartition(len(touched), "bucket")
            parts.write.partitionBy("bucket").parquet(f"{self.path}/data/{folder}")
            # The bucket is in the path: the files' footers tell the rows.
            made = self.spark.read.schema("bucket int").parquet(f"{self.path}/data/{folder}").groupBy("bucket").count()
            counts = {r["bucket"]: r["count"] for r in made.collect()}
            for b in touched:
                folders.pop(b, None), sizes.pop(b, None)
                if b in counts:
                    folders[b], sizes[b] = folder, counts[b]
        commits = now.commits | ({commit[0]: commit[1]} if commit else {})
        after = Version(now.number + 1, now.buckets, folders, commits, sizes)
        self._name(after)
        return after

    def upsert(
        self, incoming: DataFrame, scraped_at: Column, pos: str = "pos", commit: tuple[str, int] | None = None, now: Version | None = None
    ) -> Version:
        """Merge a batch with change tracking (``operators.upsert``). The batch is spelled, made unique by URL and written
        once; its URLs choose the buckets."""
        now = now or self.version()
        if now.has(commit):
            return now
        # The last of each spelling first, so that of repeated ones a single row is spelled anew.
        batch = computed(keep_last(incoming, ["url"], pos), {"url": urls.normalize_url(F.col("url"), nfkc=True)}).filter("url <> ''")
        batch = written(keep_last(batch, ["url"], pos), "batch")
        return self.rewrite(batch, lambda old: operators.upsert(old, batch, scraped_at, pos), commit, now)

    def mark(self, ids: DataFrame, flag: str, value: int) -> Version:
        """Set an integer flag on the listed URLs."""
        listed = written(ids.select(urls.normalize_url(F.col("url"), nfkc=True).alias("url")).distinct(), "marked")
        return self.rewrite(listed, lambda old: operators.set_flag(old, listed, flag, value))

    def count(self) -> int:
        """Rows of the newest version, from its manifest."""
        return sum(self.version().rows.values())

    def forget(self, keep: int = 2) -> list[str]:
        """Delete what none of the newest ``keep`` versions names, and the manifests before them; gives the folders deleted."""
        rows = self.manifests()
        numbers = sorted(r[0] for r in rows.select("version").distinct().collect())
        gone = numbers[:-keep] if keep else []
        named = F.concat(F.col("name"), F.lit("/bucket="), F.col("value").cast("string"))
        listed = rows.where("kind = 'bucket'").groupBy(named.alias("folder")).agg(F.max("version").alias("last"))
        old = [r["folder"] for r in listed.where(F.col("last").isin(gone)).collect()] if gone else []
        for number in gone:
            discard(self.spark, f"{self.path}/manifest/version={number}")
        for folder in old:
            discard(self.spark, f"{self.path}/data/{folder}")
        return old
