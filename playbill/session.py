"""Session settings and the shared folder used for written intermediate tables."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Runtime settings the operators rely on; all can be changed on a live session.
OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    # Split a hot key's partition in every shuffled join, even where that costs one more exchange.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Batches handed to Python hold whole pages: bound them by size, not only by row count.
    "spark.sql.execution.arrow.maxBytesPerBatch": str(8 * 1024 * 1024),
    # The JVM does not compile methods beyond this size: a stage with such a one runs faster operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def configure(spark: SparkSession) -> SparkSession:
    for key, value in OPTIONS.items():
        spark.conf.set(key, value)
    return spark


@cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="playbill-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only in local mode."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        path = _local_dir()
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other run writes to."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def computed(df: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """Add or replace columns, each computed once per row. They are generator output, so a later
    filter reads their value; on a projected column the optimizer would move the filter below
    the projection and compute the expression again at every mention."""
    rest = [c for c in df.columns if c not in columns]
    return df.select(*rest, F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, computed once: a cut of the lineage that outlives lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of files that no table names any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)
