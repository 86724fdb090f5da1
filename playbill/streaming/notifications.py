"""New content is announced once, also when a micro-batch is run again."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from playbill.streaming.feeds import unseen_items

_KEYS = ["content_type", "url"]


def announce_new(content: DataFrame, path: str, checkpoint: str, processed: DataFrame | None = None) -> StreamingQuery:
    """Write unannounced ``(content_type, url, ...)`` rows to ``path/content``, their counts to
    ``path/summary`` and their keys, for marking them as handled, to ``path/processed``.

    Keys seen by the stream are streaming state, so a batch costs what it holds, not what was
    announced before; ``processed`` are keys handled before the stream began. Every batch
    replaces its own folders: run again from the same checkpoint it leaves the same files.
    """
    new = content.filter(F.coalesce(F.col("url"), F.lit("")) != "")
    if processed is not None:
        new = new.join(processed.select(*_KEYS), _KEYS, "left_anti")
    new = unseen_items(new, _KEYS)

    def one_batch(df: DataFrame, batch_id: int) -> None:
        out = f"{path}/content/batch={batch_id}"
        df.write.mode("overwrite").parquet(out)
        told = df.sparkSession.read.schema(df.schema).parquet(out)
        counts = told.groupBy("content_type").agg(F.count("*").alias("n"))
        counts.write.mode("overwrite").parquet(f"{path}/summary/batch={batch_id}")
        told.select(*_KEYS).write.mode("overwrite").parquet(f"{path}/processed/batch={batch_id}")

    return (
        new.writeStream.foreachBatch(one_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
