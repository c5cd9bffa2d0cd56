"""Private counts over a stream: contingency counts of windows, and their noisy release as each window closes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from privloom.operators.privacy import SecureNoise


def windowed_counts(events: DataFrame, time: str, by: str, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """(start, by, n): counts of each window and level; works on a stream (late rows are dropped after the watermark) and on a table."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, window).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), by, "n")


def release(counts: DataFrame, by: str, levels: list[str], path: str, epsilon: float, checkpoint: str, noise: SecureNoise | None = None):
    """Starts a query that appends each closed window's counts of all declared levels with Laplace noise of scale 1 / epsilon.

    A row is in one window and one level, so each window's release costs epsilon once for each row.
    """
    source = noise or SecureNoise()

    def publish(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        dense = batch.select("start").distinct().crossJoin(F.broadcast(spark.createDataFrame([(x,) for x in levels], f"{by} string")))
        cells = dense.join(batch, ["start", by], "left").select("start", by, F.coalesce("n", F.lit(0)).cast("double").alias("n")).toPandas()  # windows x levels
        if len(cells):
            cells["n"] = np.maximum(cells["n"] + source.laplace(1 / epsilon, len(cells)), 0)
            spark.createDataFrame(cells).withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(path)

    return counts.writeStream.outputMode("append").foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
