"""New image files of a folder, processed batch by batch with the same plan as a whole folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from hueweave import api
from hueweave.settings import Settings
from hueweave.sources.raster import decoded, rgba_pixels

IMAGE = "image struct<origin: string, height: int, width: int, nChannels: int, mode: int, data: binary>"


def watch(spark: SparkSession, folder: str, checkpoint: str, sink: Callable[[api.Output, int], None], s: Settings | None = None, files: int = 100) -> StreamingQuery:
    """Starts a query that gives sink each micro-batch's Output and number, and ends when all files that are there are done.

    The checkpoint remembers which files were done, so a restart goes on; a batch may come again after a failure, with its number."""
    raw = spark.readStream.format("image").schema(IMAGE).option("maxFilesPerTrigger", files).load(folder)

    def batch(df: DataFrame, number: int) -> None:
        out = api.process(rgba_pixels(decoded(df)), s)
        try:
            sink(out, number)
        finally:
            out.release()

    return raw.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
