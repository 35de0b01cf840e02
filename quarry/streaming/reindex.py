"""Index files as they arrive: each batch is stored once, and the current files are the last version of each path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["path", "sha1", "language", "size_bytes", "text"]


def run(files: DataFrame, store: str, checkpoint: str) -> None:
    """Store all that the stream ``files`` (COLUMNS, streaming) holds at present, then stop.

    A batch is one folder, written over if it is run again, so a restart neither loses nor repeats files. Work and
    space follow the new files, not the index.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.select(*COLUMNS).write.mode("overwrite").parquet(f"{store}/batch={number}")

    files.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def current(spark: SparkSession, store: str) -> DataFrame:
    """The newest version of each path; of versions in one batch, the one with the greatest sha1."""
    rest = [c for c in COLUMNS if c != "path"]
    last = spark.read.parquet(store).groupBy("path").agg(F.max_by(F.struct(*rest), F.struct("batch", "sha1")).alias("f"))
    return last.select("path", *[F.col(f"f.{c}") for c in rest])
