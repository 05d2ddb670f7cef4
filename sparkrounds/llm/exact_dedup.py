"""Exact deduplication by a stream with keyed state that never expires.

A streaming aggregate keeps, for every digest of a normalised text, the stable
identifier that stays, the content locator of its row and the number of rows.
The state lives in RocksDB on the executors' disks and is committed to the
shared checkpoint folder with every batch, so a lost executor only reloads it.
There is no watermark: a digest is remembered for as long as the checkpoint.

A digest that more than one row has is a hit.  Hits are compared byte for byte
with the text at the state's locator; rows that only share a digest are grouped
by the text itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.llm.common import ascii_lower
from sparkrounds.plans.lineage import materialize, scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STATE = "spark.sql.streaming.stateStore."
# Each batch reads at most so many files; state carries over from batch to batch.
FILES_PER_BATCH = 10_000


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _rows(df: DataFrame, text: str, key: str, digest: Callable[[Column], Column]) -> DataFrame:
    norm = ascii_lower(F.col(f"`{text}`"))
    return df.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        norm.alias("norm"),
        digest(norm).alias("digest"),
        # Where the row lies: its file and its number there.
        F.struct(
            F.xxhash64("_metadata.file_path").alias("file"),
            F.col("_metadata.row_index").alias("row"),
        ).alias("locator"),
    )


def fill_state(
    spark: SparkSession,
    path: str,
    checkpoint: str,
    *,
    text: str = "text",
    key: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Run the stream over all files of ``path`` that the checkpoint has not seen.

    Returns the keyed state (digest, keep_id, locator, n).  Called again after
    files were added, it continues from the stored state.
    """
    confs = {
        STATE + "providerClass": ROCKSDB,
        STATE + "rocksdb.boundedMemoryUsage": "true",
        STATE + "rocksdb.maxMemoryUsageMB": "256",
        STATE + "rocksdb.writeBufferSizeMB": "8",
        STATE + "rocksdb.changelogCheckpointing.enabled": "true",
        # Many small stores: files as large as what they hold, none allocated ahead.
        STATE + "rocksdb.allowFAllocate": "false",
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    before = {c: spark.conf.get(c, None) for c in confs}
    schema = spark.read.parquet(path).select(f"`{key}`", f"`{text}`").schema
    try:
        for name, value in confs.items():
            spark.conf.set(name, value)
        stream = (
            spark.readStream.schema(schema)
            .option("maxFilesPerTrigger", files_per_batch)
            # As a pattern, so that a table of one file can be streamed like a folder.
            .parquet(f"{path[:-1]}[{path[-1]}]")
        )
        kept = (
            _rows(stream, text, key, digest)
            .groupBy("digest")
            .agg(F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n"))
        )
        run = (
            kept.writeStream.outputMode("update")
            .format("noop")
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
        run.awaitTermination()
        state = spark.read.format("statestore").load(checkpoint).select("key.*", "value.*")
        # The state's value columns are the aggregate's buffers, in the order above.
        keep, n = state.columns[1:]
        state = materialize(
            state.select(
                "digest",
                F.col(f"`{keep}`.doc_id").alias("keep_id"),
                F.col(f"`{keep}`.locator").alias("keep_at"),
                F.col(f"`{n}`").alias("n"),
            ),
            "digest-state",
        )
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return state


def exact_dedup(
    spark: SparkSession,
    path: str,
    *,
    text: str = "text",
    key: str = "doc_id",
    digest: Callable[[Column], Column] = sha256,
    checkpoint: str | None = None,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """Per row of the Parquet table at ``path``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z; null is empty.  The
    row with the largest key stays; of rows that repeat that key and text, the
    last by locator.  A null key is smaller than any other.  An empty table
    gives no rows.  Other columns are not read, so their names cannot clash.
    """
    checkpoint = checkpoint or scratch_path(spark, "dedup-stream")
    state = fill_state(
        spark, path, checkpoint, text=text, key=key, digest=digest, files_per_batch=files_per_batch
    )
    rows = _rows(spark.read.parquet(path), text, key, digest)
    joined = rows.join(state, "digest").select(
        "doc_id", "digest", "keep_id", "n", "locator", "keep_at",
        F.sha2("norm", 256).alias("text_sha256"),
        F.when(F.col("n") > 1, F.col("norm")).alias("norm"),
    )
    seen = materialize(joined, "dedup-rows")
    hits = seen.filter("n > 1")
    first = hits.filter("locator = keep_at").select("digest", F.col("norm").alias("keep_norm"))
    checked = hits.join(first, "digest").withColumn("same", F.expr("norm = keep_norm"))
    kept = F.expr("locator = keep_at").alias("kept")
    columns = ["doc_id", "keep_id", F.col("n").alias("group_size"), kept, "text_sha256"]
    alone = seen.filter("n = 1").select(*columns)
    odd = checked.filter("NOT same").select("digest").distinct()
    if odd.isEmpty():
        # Only rows whose bytes were found equal count as copies.
        return alone.unionByName(checked.filter("same").select(*columns))
    # Different texts under one digest: group these few by the whole text.
    fair = checked.join(odd, "digest", "left_anti").select(*columns)
    mixed = hits.join(odd, "digest", "left_semi").drop("keep_id", "keep_at", "n")
    groups = mixed.groupBy("digest", "norm").agg(
        F.max(F.struct("doc_id", "locator")).alias("keep"), F.count(F.lit(1)).alias("n")
    )
    again = mixed.join(groups, ["digest", "norm"]).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        (F.col("locator") == F.col("keep.locator")).alias("kept"),
        "text_sha256",
    )
    return alone.unionByName(fair).unionByName(again)
