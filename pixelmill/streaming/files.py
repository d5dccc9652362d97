"""Row-local operators on streams: new image files become rows of pixels as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pixelmill.functions.args import ID
from pixelmill.sources.files import decode_pixels, load_images, path_id


def watch_images(spark: SparkSession, path: str, most: int = 1000) -> DataFrame:
    """image_id and path of image files, as a stream over a directory, at most ``most`` files a micro-batch."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    found = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", most).schema(schema).load(path)
    return found.select(path_id(F.col("path")).alias(ID), "path", F.col("length").alias("byte_len"))


def process_images(files: DataFrame, tool: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Decode each micro-batch's files, apply a pixel operator and hand the rows to an idempotent sink."""

    def step(batch: DataFrame, epoch: int) -> None:
        paths = [r["path"] for r in batch.select("path").collect()]  # names of one micro-batch, bounded by ``most``
        if paths:
            sink(tool(decode_pixels(load_images(batch.sparkSession, paths))), epoch)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).start()
