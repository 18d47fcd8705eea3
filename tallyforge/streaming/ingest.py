"""File-arrival ingest with Structured Streaming: every batch is loaded once, by content key, and replaces nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize as N
from ..sources import ledger as L


def loader(target: str, key: list[str], part: str | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that appends the rows whose key is not in ``target`` yet: a replayed batch adds nothing.

    ``part`` is an SQL expression of key columns (a date, a range of ids). The target is then partitioned by it, and a batch is held
    against the partitions that it touches only, so its cost does not grow with history.
    """

    def load(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        rows = batch.dropDuplicates(key)
        if part:
            rows = rows.withColumn("part", F.expr(f"cast({part} as string)"))
        if L.exists(spark, target):
            known = spark.read.parquet(target)
            if part:
                touched = [r["part"] for r in rows.select("part").distinct().collect()]
                known = known.where(F.col("part").cast("string").isin(touched))
            rows = N.new_only(rows, known.select(*key), key)
        writer = rows.write.mode("append")
        (writer.partitionBy("part") if part else writer).parquet(target)

    return load


def catch_up(spark: SparkSession, source: str, schema: T.StructType, target: str, state: str, key: list[str], glob: str = "*", kind: str = "parquet", per_batch: int = 64, part: str | None = None) -> None:
    """Read all files that have arrived in ``source`` and were not read before, then stop. State is the stream's checkpoint."""
    run(spark, source, schema, target, state, key, glob, kind, per_batch, available_now=True, part=part).awaitTermination()


def run(spark: SparkSession, source: str, schema: T.StructType, target: str, state: str, key: list[str], glob: str = "*", kind: str = "parquet", per_batch: int = 64, available_now: bool = False, part: str | None = None) -> StreamingQuery:
    """The running ingest of arriving files; ``per_batch`` bounds the files of one batch."""
    rows = spark.readStream.schema(schema).option("pathGlobFilter", glob).option("maxFilesPerTrigger", per_batch).format(kind).load(source)
    writer = rows.writeStream.option("checkpointLocation", state).foreachBatch(loader(target, key, part))
    return (writer.trigger(availableNow=True) if available_now else writer).start()
