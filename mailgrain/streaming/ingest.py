"""Incremental ingest: raw mail to the messages table, batch by batch, without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..schema import RAW
from ..sources import shards
from ..sources.mail import parse_messages
from ..sources.store import write_messages


def ingest(spark: SparkSession, raw_path: str, table_path: str, state_path: str, now_ns: int, files_per_trigger: int = 1000) -> StreamingQuery:
    """Parses new raw files and appends them, then ends. The checkpoint remembers files, each batch is tagged with its number,
    and readers take the latest run of a key: a batch that is replayed adds nothing, and one without rows no generation."""
    return ingest_stream(spark.readStream.schema(RAW).option("maxFilesPerTrigger", files_per_trigger).parquet(raw_path), table_path, state_path, now_ns)


def ingest_shards(spark: SparkSession, root: str, table_path: str, state_path: str, now_ns: int) -> StreamingQuery:
    """As :func:`ingest`, from repositories; the checkpoint remembers the head of each shard."""
    shards.register(spark)
    return ingest_stream(spark.readStream.format("mail_shards").load(root), table_path, state_path, now_ns)


def ingest_stream(stream: DataFrame, table_path: str, state_path: str, now_ns: int) -> StreamingQuery:
    def write(batch: DataFrame, number: int) -> None:
        rows = parse_messages(batch, now_ns)
        if batch.isEmpty():
            return
        write_messages(rows, table_path, run=number)
        generation = batch.sparkSession.createDataFrame([(number, now_ns)], "generation bigint, as_of_ns bigint")
        generation.write.mode("append").parquet(f"{state_path}/generations")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{state_path}/checkpoint").trigger(availableNow=True).start()


def generations(spark: SparkSession, state_path: str) -> DataFrame:
    rows = spark.read.schema("generation bigint, as_of_ns bigint").parquet(f"{state_path}/generations")
    return rows.groupBy("generation").agg(F.max("as_of_ns").alias("as_of_ns"))
