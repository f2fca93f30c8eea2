"""Streams: files as they arrive, expiry of entries, update timelines, windows over events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sparkkb.operators import chunking


def arriving(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """Rows of Parquet files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def windowed_counts(events: DataFrame, ts: str = "ts", late: str = "10 minutes", width: str = "1 hour", by: str = "event_type") -> DataFrame:
    """Events and values by window and kind; events later than the watermark are dropped."""
    stamped = events.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)
    return stamped.groupBy(F.window(ts, width).alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")


def expiring(entries: DataFrame, key: str, ts: str, ttl_seconds: int, state: str = "READY") -> DataFrame:
    """(key, state): entries turn from READY to EVICTING once the event time passes their last touch by ttl_seconds.

    State is kept per key and times out by event time, so memory holds live keys only.
    """
    import pandas as pd

    def run(key_, frames, group):
        if group.hasTimedOut:
            group.remove()
            yield pd.DataFrame({key: [key_[0]], "state": ["EVICTING"]})
            return
        last = group.get[0] if group.exists else 0
        for f in frames:
            last = max(last, int(f["__ms"].max()))
        fresh = not group.exists
        group.update((last,))
        group.setTimeoutTimestamp(max(last + ttl_seconds * 1000, group.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({key: [key_[0]] if fresh else [], "state": [state] if fresh else []})

    kind = dict(entries.dtypes)[key]
    stamped = entries.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, "0 seconds").withColumn("__ms", (F.col(ts).cast("double") * 1000).cast("long"))
    return stamped.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, state string", "last long", "append", "EventTimeTimeout")


def build_stream(documents: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Chunk documents as they arrive; each batch replaces nothing and is written once, by batch number."""

    def write(batch: DataFrame, number: int) -> None:
        chunking.chunks(batch, "doc_id", "text").write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_to_end(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", sink: Callable[[DataFrame, int], None] | None = None) -> None:
    """Run a stream over all that is there, then stop."""
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True)
    query = writer.foreachBatch(sink).start() if sink else writer.format("parquet").option("path", out).start()
    query.awaitTermination()


def periodic(stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, interval: str = "600 seconds") -> StreamingQuery:
    """Run the sink on what has arrived, then wait for the interval, until the query is stopped."""
    return stream.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()
