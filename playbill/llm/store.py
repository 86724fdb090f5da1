"""Tables written between the jobs of an operator."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession

from playbill.session import fresh_path


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once, tightly packed, to the shared folder and read it back: a lineage cut that survives
    the loss of executors."""
    return scratch(df, name)[0]


def scratch(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """``written``, and where, for ``discard``. Once the table is there nobody needs the shuffles that it was made with; Spark deletes their
    files when the driver has collected what refers to them, which it may not do for long by itself."""
    spark, path = df.sparkSession, fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that ``scratch`` wrote, when what was made of it is written too."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores in front as it takes to be no column's."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
        taken.add(name.lower())
    return out
