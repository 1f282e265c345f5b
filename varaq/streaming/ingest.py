"""Documents as they arrive: new span files run through the batch plan, one micro-batch after the other."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.pipeline import built_blocks
from ..sources.schemas import SPANS


def stream_blocks(spark: SparkSession, folder: str, pages: DataFrame, out: str, checkpoint: str, done: Callable[[int, int], None] | None = None) -> StreamingQuery:
    """Blocks of every document whose spans arrive in `folder`, written to `out`/batch=N.

    Body size, tiers and running heads need the whole document, so a document must come whole in one file; a batch that is
    run again overwrites its own folder, so each batch counts once. `done` hears of each batch: its number and its rows.
    """

    def work(batch: DataFrame, number: int) -> None:
        made = built_blocks(batch, pages).drop("runs")
        path = f"{out}/batch={number}"
        made.write.mode("overwrite").parquet(path)
        if done:
            done(number, batch.sparkSession.read.parquet(path).count())

    return spark.readStream.schema(SPANS).parquet(folder).writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
