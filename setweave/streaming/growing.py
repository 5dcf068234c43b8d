"""Collections that arrive as a stream of (id, token) rows, and queries against a fixed collection as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from setweave.operators import knn


def running_frequency(stream: DataFrame, time_col: str, delay: str = "1 hour") -> DataFrame:
    """(token, freq) so far of a stream (id, token, time); a row that comes again within the delay counts once."""
    rows = stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["id", "token"])
    return rows.groupBy("token").agg(F.count("*").alias("freq"))


def answer_batches(stream: DataFrame, elems: DataFrame, k: int, path: str, checkpoint: str):
    """Starts a query that writes, for each micro-batch of query ids, their k nearest sets in elems as Parquet. A batch that
    is run again after a failure replaces its own folder."""

    def answer(batch: DataFrame, number: int) -> None:
        knn.token_join(elems, k, batch.select("id")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).start()
