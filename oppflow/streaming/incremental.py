"""Structured Streaming forms: new posts once, incremental scans, arrival counts by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from oppflow.functions.keys import content_fingerprint
from oppflow.operators.history import except_by


def new_posts(stream: DataFrame, source_col: str = "source_url", text_col: str = "post_text", time_col: str | None = None, horizon: str | None = None) -> DataFrame:
    """Posts whose fingerprint has not come before.

    Without ``horizon`` nothing is forgotten and the state grows with the
    distinct posts; with one, a post that returns after it counts as new again.
    """
    keyed = stream.withColumn("fingerprint", content_fingerprint(F.col(source_col), F.col(text_col)))
    if time_col and horizon:
        return keyed.withWatermark(time_col, horizon).dropDuplicatesWithinWatermark(["fingerprint"])
    return keyed.dropDuplicates(["fingerprint"])


def stream_new_posts(spark: SparkSession, path: str, schema: StructType, out: str, checkpoint: str, **kw) -> StreamingQuery:
    """Run :func:`new_posts` over the files that are there and append the new ones to Parquet."""
    posts = spark.readStream.schema(schema).parquet(path)
    return new_posts(posts, **kw).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def stream_scan(spark: SparkSession, path: str, schema: StructType, root: str, process: Callable[[DataFrame], DataFrame], key: str = "id") -> StreamingQuery:
    """Micro-batches: rows that no earlier batch had, through ``process``, to ``root/records/batch=N``; their keys to ``root/seen/batch=N``.

    A batch that is run again writes the same folders anew and does not count
    its own keys as seen, so the result is the same.
    """
    fs = spark._jvm.org.apache.hadoop.fs

    def run(batch: DataFrame, n: int) -> None:
        seen_path = fs.Path(f"{root}/seen")
        fresh = batch.dropDuplicates([key])
        if seen_path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(seen_path):
            seen = batch.sparkSession.read.schema(StructType([schema[key]]).add("batch", "long")).parquet(f"{root}/seen").filter(F.col("batch") < n)
            fresh = except_by(fresh, seen, [key])
        process(fresh).write.mode("overwrite").parquet(f"{root}/records/batch={n}")
        fresh.select(key).write.mode("overwrite").parquet(f"{root}/seen/batch={n}")

    return spark.readStream.schema(schema).parquet(path).writeStream.foreachBatch(run).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()


def source_arrivals(events: DataFrame, time_col: str, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Rows and values of each source and time window; on a stream, windows close when the watermark has passed."""
    kept = events.withWatermark(time_col, late) if events.isStreaming else events
    w = F.window(time_col, window)
    return kept.groupBy(w.alias("w"), by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), by, "n")
