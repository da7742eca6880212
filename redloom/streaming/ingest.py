"""Packages as they arrive: a file stream around the batch ingest.

Each micro-batch goes through the same keyed ingest as a batch run, so a repeated batch or file adds nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from redloom.sources import docx
from redloom.sources.store import Store, ingest

_FILES = "path string, modificationTime timestamp, length long, content binary"


def package_stream(spark: SparkSession, folder: str, per_batch: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(_FILES).option("pathGlobFilter", "*.docx").option("maxFilesPerTrigger", per_batch).load(folder)


def ingest_stream(spark: SparkSession, folder: str, store_root: str, checkpoint: str, once: bool = True):
    """Start a query that ingests what arrives in ``folder``; with ``once`` it ends when all present files are done."""
    store = Store(spark, store_root)

    def batch(files: DataFrame, _: int) -> None:
        ingest(store, files, docx.parse_files)

    writer = package_stream(spark, folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()


def latest_by_key(events: DataFrame, key: str, time: str, delay: str = "1 day") -> DataFrame:
    """First sighting of each key within the watermark; later copies of a key are dropped."""
    return events.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def windowed_counts(events: DataFrame, time: str, by: str, width: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark(time, delay).groupBy(F.window(time, width), by).agg(F.count(F.lit(1)).alias("n"))
