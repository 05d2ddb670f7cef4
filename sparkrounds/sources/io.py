"""Readers and writers of run logs and point matrices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkrounds.schemas import CORESET_RUNLOG, GRAPH_RUNLOG


def read_runlog(
    spark: SparkSession, path: str, *, sep: str = ",", schema: T.StructType = GRAPH_RUNLOG
) -> DataFrame:
    """Run log in CSV with a header; columns are found by name, others are ignored.

    A missing column or a cell that is not of its column's type fails, whatever
    the session's ANSI setting; empty cells are null.  List columns hold JSON text.
    """
    reader = spark.read.option("header", True).option("sep", sep).option("escape", '"')
    # The header alone gives the names; unnamed columns get names that match nothing.
    names = [n.strip() for n in reader.csv(path).columns]
    missing = [n for n in schema.names if names.count(n) != 1]
    if missing:
        raise ValueError(f"run log needs exactly one column of each of {missing}; it has {names}")
    flat = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(names))])
    cells = reader.schema(flat).option("enforceSchema", True).csv(path)
    return cells.select(*[_parsed(f"c{names.index(f.name)}", f).alias(f.name) for f in schema])


def _parsed(cell: str, field: T.StructField) -> Column:
    """The cell in the field's type; a filled cell that does not parse fails the job."""
    text = F.nullif(F.trim(cell), F.lit(""))
    if isinstance(field.dataType, T.StringType):
        return F.nullif(F.col(cell), F.lit(""))
    if isinstance(field.dataType, T.ArrayType):
        value = F.from_json(text, field.dataType)
    else:
        value = text.try_cast(field.dataType)
    wrong = F.raise_error(F.concat(F.lit(f"{field.name}: bad cell "), text)).cast(field.dataType)
    return F.when(text.isNotNull() & value.isNull(), wrong).otherwise(value)


def write_runlog(df: DataFrame, path: str, *, mode: str = "append") -> None:
    """Append runs to a Parquet run log."""
    df.write.mode(mode).parquet(path)


def export_runlog_csv(df: DataFrame, path: str, *, sep: str = ",", mode: str = "overwrite") -> None:
    """Run log as CSV with a header and no index; list columns become JSON text."""
    flat = df
    for f in df.schema:
        if isinstance(f.dataType, T.ArrayType):
            flat = flat.withColumn(f.name, F.to_json(f.name))
    flat.write.mode(mode).option("header", True).option("sep", sep).option("escape", '"').csv(path)


def append_run(log: DataFrame, *rows: tuple) -> DataFrame:
    """The log with one more row per tuple, checked against the log's schema."""
    more = log.sparkSession.createDataFrame([tuple(r) for r in rows], log.schema)
    return log.unionByName(more)


def empty_coreset_log(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], CORESET_RUNLOG)


def read_points_text(
    spark: SparkSession, path: str, columns: tuple[str, ...] = ("x", "y")
) -> DataFrame:
    """Whitespace-separated float matrix, one row per line, as DOUBLE ``columns``.

    Blank lines and ``#`` comments are skipped.  A line of another width, or a
    cell that is no number, fails the job that meets it.
    """
    text = F.trim(F.regexp_replace(F.regexp_replace("value", "#.*$", ""), r"\s+", " "))
    lines = spark.read.text(path).select(text.alias("line")).filter(F.length("line") > 0)
    cells = lines.select("line", F.split("line", " ").alias("cells"))
    width = F.lit(len(columns))
    checked = F.when(F.size("cells") == width, F.col("cells")).otherwise(
        F.raise_error(F.concat(F.lit("wrong number of columns in line: "), F.col("line")))
    )
    rows = cells.select(checked.alias("cells"))
    def number(i: int) -> Column:
        cell = F.get("cells", F.lit(i))
        value = cell.try_cast("double")
        wrong = F.raise_error(F.concat(F.lit("not a number: "), cell)).cast("double")
        return F.when(value.isNull(), wrong).otherwise(value)

    return rows.select(*[number(i).alias(name) for i, name in enumerate(columns)])


def write_points_text(df: DataFrame, path: str, *, mode: str = "overwrite") -> None:
    """Numeric columns as whitespace-separated text, one row per line."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in df.columns])
    df.select(line.alias("value")).write.mode(mode).text(path)
