"""Cutting lineage between rounds.

Each round's result is written as a table in the folder that
``spark.checkpoint.dir`` names and read back.  That folder is shared by all
executors, so a lost executor costs a re-read, never a replay of old rounds.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def scratch_root(spark: SparkSession) -> str:
    """The session's shared checkpoint folder, or a folder of the warehouse when none is set.

    Both are places that every executor and the driver can read.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    return (folder or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    app = spark.sparkContext.applicationId
    return f"{scratch_root(spark)}/sparkrounds/{app}/{tag}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, tag: str, **options: str) -> DataFrame:
    """Write ``df`` once, with the writer's ``options``, and return it read back: a plan with no history."""
    spark = df.sparkSession
    path = scratch_path(spark, tag)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def materialize_counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """:func:`materialize` plus the row count, taken from the Parquet footers."""
    table = materialize(df, tag)
    return table, table.count()


def materialize_measured(
    df: DataFrame, tag: str, options: dict[str, str] | None = None, **measures: Column
) -> tuple[DataFrame, dict[str, int]]:
    """:func:`materialize` plus aggregates of the rows, taken while they are written: no further job.

    ``rows`` is always among them; a measure over no rows is 0.
    """
    seen = Observation()
    total = F.count(F.lit(1)).alias("rows")
    table = materialize(df.observe(seen, total, *[m.alias(name) for name, m in measures.items()]), tag, **options or {})
    return table, {name: value or 0 for name, value in seen.get.items()}


def round_folder(tag: str) -> str:
    """A tag prefix of its own: tables named ``<folder>/<tag>`` can be deleted at once."""
    return f"{tag}-{uuid.uuid4().hex}"


def discard_folder(spark: SparkSession, folder: str) -> None:
    """Delete all tables that were materialized under a :func:`round_folder`."""
    _delete(spark, f"{scratch_root(spark)}/sparkrounds/{spark.sparkContext.applicationId}/{folder}")


def _delete(spark: SparkSession, name: str) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def discard(*tables: DataFrame) -> None:
    """Delete the files of materialized tables that nothing will read again."""
    for table in tables:
        for name in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            _delete(table.sparkSession, name)
