"""Reading and writing the messages table: partitioned by list, zstd, sorted for pruning; generations; upserts on read."""

from __future__ import annotations

from collections import deque
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..lineage import checkpointed
from ..operators.derive import freshest, involvement, path_vocabulary, touched, trailer_refs
from ..operators.predicates import top
from ..operators.search import trigram_table
from ..schema import MESSAGES


SEQUENCE = "run"


def write_messages(m: DataFrame, path: str, run: int | None, mode: str = "append") -> None:
    """One run's rows, tagged with its number (rows keep theirs if it is None). Dealt out by ranges of list and date, so a
    list with very many rows is written by many tasks, and date bounds skip files and row groups; message ids get a Bloom
    filter for point lookups."""
    (
        (m if run is None else m.withColumn(SEQUENCE, F.lit(run).cast("bigint")))
        .repartitionByRange("list", F.desc("date_unix_ns"))
        .sortWithinPartitions("list", F.desc("date_unix_ns"))
        .write.mode(mode)
        .option("compression", "zstd")
        .option("parquet.bloom.filter.enabled#message_id", "true")
        .partitionBy("list")
        .parquet(path)
    )


def read_messages(spark: SparkSession, path: str) -> DataFrame:
    """The row of the greatest run of each (message_id, list), with its run. Whether a key has another row of its run or a
    later one is found on the key columns and the row's place (file and row number) alone, and only what has is anti-joined:
    filters on other columns reach the scan, and bodies go through no shuffle unless the superseded rows are very many. A
    run that was written twice counts once, as its first file has it."""
    m = spark.read.schema(T.StructType([*MESSAGES.fields, T.StructField(SEQUENCE, T.LongType())])).parquet(path)
    earlier = (-F.unix_micros("_metadata.file_modification_time")).alias("earlier")
    at = F.struct(F.col(SEQUENCE), earlier, F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    m = m.withColumn("_at", at)
    older = m.groupBy("message_id", "list").agg(F.max("_at").alias("_last"), F.count("*").alias("_n")).filter("_n > 1")
    found = m.join(older.drop("_n"), ["message_id", "list"], "left").filter("_last IS NULL OR _at = _last")
    return found.select(*[f.name for f in MESSAGES.fields], SEQUENCE)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Rewrite with one row per key, which keeps its run, into another folder; the caller swaps the paths."""
    write_messages(read_messages(spark, path), to, run=None, mode="overwrite")


def visit(m: DataFrame, visitor, columns: list[str] | None = None) -> int:
    """Calls ``visitor`` with each Arrow batch, in the tasks that hold it, and returns the number of rows."""

    def run(batches):
        for b in batches:
            visitor(b)
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows], pa.int64())], ["n"])

    return (m.select(*columns) if columns else m).mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0] or 0


def batches(m: DataFrame, columns: list[str] | None = None, rows: int = 10_000, ahead: int = 1):
    """Arrow batches of at most ``rows`` rows to the caller, partition by partition in the table's order. ``ahead``
    partitions are fetched before they are asked for, so that many are in memory; a caller that stops early ends the rest."""
    t = m.select(*columns) if columns else m
    names, numbered = t.columns, t.withColumn("_part", F.spark_partition_id())
    kept = checkpointed(numbered)  # each pull reads what is written, and computes nothing anew
    parts = [r[0] for r in kept.select("_part").distinct().orderBy("_part").collect()]  # partitions, not rows

    def fetch(part: int) -> pa.Table:
        return kept.filter(F.col("_part") == part).select(*names).toArrow()

    with ThreadPoolExecutor(max_workers=max(ahead, 1)) as pool:
        waiting = deque()
        at = iter(parts)
        try:
            for part in at:
                waiting.append(pool.submit(fetch, part))
                if len(waiting) > ahead:
                    yield from waiting.popleft().result().to_batches(max_chunksize=rows)
            while waiting:
                yield from waiting.popleft().result().to_batches(max_chunksize=rows)
        finally:
            for f in waiting:
                f.cancel()


def fetch_body(m: DataFrame, message_id: str) -> DataFrame:
    """message_id, body, body_sha256 of the freshest copy, as it was parsed."""
    return fetch_message(m, message_id).select("message_id", "body", "body_sha256")


def hydrate(m: DataFrame, ids: DataFrame) -> DataFrame:
    """Messages of a table of ids (message_id and more), the freshest copy of each; an id that isn't there has nulls."""
    found = freshest(m.join(ids.select("message_id").distinct(), "message_id", "left_semi"))
    return ids.join(found, "message_id", "left")


SIDE_TABLES = {
    "touched_file": (lambda m: touched(m), "path"),
    "touched_function": (lambda m: touched(m, "touched_functions", "function"), "function"),
    "involvement": (lambda m: involvement(m), "email"),
    "trailer_ref": (lambda m: trailer_refs(m), "ref_value"),
    "path_vocabulary": (lambda m: path_vocabulary(m), "path"),
    "trigram": (lambda m: trigram_table(m), "gram"),
}


def write_side_tables(m: DataFrame, path: str, names: tuple[str, ...] = tuple(SIDE_TABLES), parts: int | None = None) -> None:
    """The derived tables, each dealt out and sorted by its key, so a lookup reads few row groups. Written anew from the
    messages as they are read now: rows of replaced messages leave nothing behind. ``parts``: how many tasks sort a table."""
    for name in names:
        make, key = SIDE_TABLES[name]
        rows = make(m)
        ranged = rows.repartitionByRange(parts, key) if parts else rows.repartitionByRange(key)
        ranged.sortWithinPartitions(key).write.mode("overwrite").parquet(f"{path}/{name}", compression="zstd")


def side_table(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/{name}")


def fetch_message(m: DataFrame, message_id: str) -> DataFrame:
    """The freshest cross-post."""
    return top(m.filter(F.col("message_id") == message_id.strip().strip("<>")), 1)


def get_many(m: DataFrame, ids: list[str]) -> DataFrame:
    """Rows of a caller's list of ids; the list is a literal, so its size is the caller's."""
    return m.filter(F.col("message_id").isin(ids))


def all_rows(m: DataFrame, list_name: str | None = None, since_ns: int | None = None, until_ns: int | None = None) -> DataFrame:
    """A scan in which undated rows pass the bounds."""
    if since_ns is not None:
        m = m.filter(F.col("date_unix_ns").isNull() | (F.col("date_unix_ns") >= since_ns))
    if until_ns is not None:
        m = m.filter(F.col("date_unix_ns").isNull() | (F.col("date_unix_ns") < until_ns))
    return m.filter(F.col("list") == list_name) if list_name else m


def manifest_rows(spark: SparkSession, manifest: dict) -> DataFrame:
    """path and fingerprint of each shard of a parsed manifest."""
    rows = [(k, v.get("fingerprint"), v.get("modified")) for k, v in manifest.items()]
    return spark.createDataFrame(rows, "path string, fingerprint string, modified bigint")


def read_manifest(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """path, fingerprint, modified of all shards in manifest files: JSON objects by path, gzip or not, a file each (or a line
    each). Keys that the engine doesn't know are left alone."""
    files = spark.read.text(path, wholetext=not lines).select(F.parse_json("value").alias("v"))
    each = files.lateralJoin(spark.tvf.variant_explode(F.col("v").outer()))
    get = lambda name, kind: F.try_variant_get("value", f"$.{name}", kind).alias(name)
    return each.select(F.col("key").alias("path"), get("fingerprint", "string"), get("modified", "bigint"))


def manifest_diff(now: DataFrame, before: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """Shards that are new or whose fingerprint changed; ``include`` and ``exclude`` are patterns on the path."""
    if include:
        now = now.filter(F.col("path").rlike(include))
    if exclude:
        now = now.filter(~F.col("path").rlike(exclude))
    old = before.select("path", F.col("fingerprint").alias("was"))
    return now.join(old, "path", "left").filter(~F.col("fingerprint").eqNullSafe(F.col("was"))).select(*now.columns)


def embedding_text(m: DataFrame, most: int = 4000) -> DataFrame:
    """message_id and what is embedded: subject and prose without patch, cut to ``most`` characters."""
    return m.select("message_id", F.substring(F.concat_ws("\n", "subject_normalized", F.trim("prose")), 1, most).alias("text"))
