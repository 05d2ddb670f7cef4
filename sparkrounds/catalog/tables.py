"""Run-log queries: readers, writers, filters, labels, means, pivots, transposes.

The test tables stand in for run logs: a category, a few numeric parameters and
measured values per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkrounds.catalog.bindings import event_points, table
from sparkrounds.catalog.registry import query
from sparkrounds.operators import runlog
from sparkrounds.plans.lineage import scratch_path
from sparkrounds.schemas import CORESET_RUNLOG, GRAPH_RUNLOG
from sparkrounds.sources import io

STATUSES = ["F", "O", "P"]
FLAGS = ["A", "N", "R"]


def _rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# Readers and writers ------------------------------------------------------------


def _order_log(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in the shape of a graph run log; the third round is missing for some."""
    orders = table(spark, sf, "orders")
    price = F.col("o_totalprice")
    return orders.select(
        F.col("o_orderpriority").alias("WeightingMethod"),
        F.col("o_custkey").cast("int").alias("Seed"),
        F.col("o_orderkey").cast("int").alias("Vertices"),
        F.round(F.col("o_custkey") / 10, 1).alias("Sparsity"),
        F.lit(1).alias("WeightMin"),
        F.lit(100).alias("WeightMax"),
        F.lit(0).alias("NrOfCliques"),
        F.lit(0).alias("SizeOfClique"),
        F.when(price > 100000, 3).otherwise(2).alias("NrOfCommRounds"),
        price.alias("TotalTime"),
        price.alias("RoundTimes1"),
        (price * 2).alias("RoundTimes2"),
        F.when(price > 100000, price).alias("RoundTimes3"),
    ).select(*GRAPH_RUNLOG.names)


_ORDER_LOG = """SELECT o_orderpriority AS WeightingMethod, o_custkey::INTEGER AS Seed,
  o_orderkey::INTEGER AS Vertices, round(o_custkey / 10.0::DOUBLE, 1) AS Sparsity, 1 AS WeightMin,
  100 AS WeightMax, 0 AS NrOfCliques, 0 AS SizeOfClique,
  CASE WHEN o_totalprice > 100000 THEN 3 ELSE 2 END AS NrOfCommRounds,
  o_totalprice AS TotalTime, o_totalprice AS RoundTimes1, o_totalprice * 2 AS RoundTimes2,
  CASE WHEN o_totalprice > 100000 THEN o_totalprice END AS RoundTimes3 FROM orders"""
@query("read_runlog", _ORDER_LOG)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runlog-csv")
    io.export_runlog_csv(_order_log(spark, sf), path)
    return io.read_runlog(spark, path)


@query("read_runlog_semicolon", _ORDER_LOG)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runlog-csv")
    io.export_runlog_csv(_order_log(spark, sf), path, sep=";")
    return io.read_runlog(spark, path, sep=";")


def _event_log(spark: SparkSession, sf: str) -> DataFrame:
    """Events in the shape of a coreset run log, with a list column."""
    return table(spark, sf, "events").select(
        F.when(F.col("event_type") == "click", "Grid").otherwise("Ball").alias("SamplingMethod"),
        F.col("event_type").alias("DatasetType"),
        F.col("event_id").cast("int").alias("NrOfPoints"),
        F.col("user_id").cast("int").alias("Seed"),
        F.col("value").alias("SampleSize"),
        F.col("value").alias("TotalTime"),
        F.array("value", F.hour("ts").cast("double")).alias("RoundTimes"),
        F.hour("ts").alias("CoresetSize"),
        F.col("value").alias("AvgQuality"),
        F.col("value").alias("NormQuality"),
    ).select(*CORESET_RUNLOG.names)


_EVENT_LOG = """SELECT CASE WHEN event_type = 'click' THEN 'Grid' ELSE 'Ball' END AS SamplingMethod,
    event_type AS DatasetType, event_id::INTEGER AS NrOfPoints, user_id::INTEGER AS Seed, value AS SampleSize,
    value AS TotalTime, value AS RoundTime1, hour(ts)::DOUBLE AS RoundTime2, hour(ts)::INTEGER AS CoresetSize,
    value AS AvgQuality, value AS NormQuality FROM events"""


def _unlisted(log: DataFrame) -> DataFrame:
    """The log with its list of two round times as two columns."""
    times = [F.get("RoundTimes", F.lit(i)).alias(f"RoundTime{i + 1}") for i in (0, 1)]
    return log.select(*[c for c in log.columns if c != "RoundTimes"], *times)


@query("read_coreset_runlog", _EVENT_LOG)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runlog-csv")
    io.export_runlog_csv(_event_log(spark, sf), path)
    return _unlisted(io.read_runlog(spark, path, schema=CORESET_RUNLOG))


@query("write_runlog", _EVENT_LOG)
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "runlog")
    log = _event_log(spark, sf)
    io.write_runlog(log.filter("SamplingMethod = 'Grid'"), path)
    io.write_runlog(log.filter("SamplingMethod <> 'Grid'"), path)
    return _unlisted(spark.read.schema(CORESET_RUNLOG).parquet(path))


@query("read_points_text", "SELECT hour(ts)::DOUBLE AS x, value AS y FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    path = scratch_path(spark, "points-text")
    io.write_points_text(event_points(spark, sf).select("x", "y"), path)
    return io.read_points_text(spark, path)


@query(
    "runlog_head",
    "SELECT event_id, event_type, user_id, value FROM events ORDER BY event_id LIMIT 5",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select("event_id", "event_type", "user_id", "value")
    return rows.orderBy("event_id").limit(5)


@query(
    "literal_table",
    """SELECT o_orderpriority, rank, round(sum(o_totalprice), 2) AS total FROM orders
    JOIN (VALUES ('1-URGENT', 10), ('2-HIGH', 8), ('3-MEDIUM', 5), ('5-LOW', 1))
      AS ranks(priority, rank) ON o_orderpriority = priority GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    ranks = spark.createDataFrame(
        [("1-URGENT", 10), ("2-HIGH", 8), ("3-MEDIUM", 5), ("5-LOW", 1)], "priority string, rank int"
    )
    orders = table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )
    joined = orders.join(F.broadcast(ranks), F.col("o_orderpriority") == F.col("priority"))
    return joined.select("o_orderpriority", "rank", "total")


@query(
    "append_run",
    """SELECT event_type AS name, count(*) AS runs, round(avg(value), 4) AS mean FROM events GROUP BY 1
    UNION ALL SELECT 'all', count(*), round(avg(value), 4) FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    def summary(df: DataFrame, name: Column) -> DataFrame:
        return df.agg(
            F.count(F.lit(1)).alias("runs"), F.round(F.avg("value"), 4).alias("mean")
        ).select(name.alias("name"), "runs", "mean")

    events = table(spark, sf, "events")
    log = summary(events.groupBy("event_type"), F.col("event_type"))
    overall = summary(events, F.lit("all")).first()
    return io.append_run(log, tuple(overall))


# Filters and labels ---------------------------------------------------------------


@query(
    "filter_eq",
    "SELECT event_id, user_id, value FROM events WHERE event_type = 'click' AND user_id <> 7",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events")
    kept = events.filter((F.col("event_type") == "click") & (F.col("user_id") != 7))
    return kept.select("event_id", "user_id", "value")


@query("filter_range", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 250000")
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    return orders.filter(F.col("o_totalprice") > 250000).select("o_orderkey", "o_totalprice")


@query(
    "filter_and",
    """SELECT l_orderkey, l_quantity, l_discount FROM lineitem
    WHERE l_returnflag = 'R' AND l_quantity > 20 AND l_discount <> 0.05""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem")
    kept = item.filter(
        (F.col("l_returnflag") == "R") & (F.col("l_quantity") > 20) & (F.col("l_discount") != 0.05)
    )
    return kept.select("l_orderkey", "l_quantity", "l_discount")


@query(
    "filter_isin",
    """SELECT o_orderkey, o_orderpriority FROM orders
    WHERE o_orderpriority IN ('1-URGENT', '5-LOW')""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders")
    kept = orders.filter(F.col("o_orderpriority").isin("1-URGENT", "5-LOW"))
    return kept.select("o_orderkey", "o_orderpriority")


_BANDS = """CASE WHEN o_totalprice >= 0 AND o_totalprice < 100000 THEN '[0, 100000)'
  WHEN o_totalprice >= 100000 AND o_totalprice < 250000 THEN '[100000, 250000)'
  WHEN o_totalprice >= 250000 AND o_totalprice < 400000 THEN '[250000, 400000)' END"""


def _banded(spark: SparkSession, sf: str) -> DataFrame:
    price = F.col("o_totalprice")
    cases = [
        ((price >= low) & (price < high), f"[{low}, {high})")
        for low, high in ((0, 100000), (100000, 250000), (250000, 400000))
    ]
    return runlog.case_label(table(spark, sf, "orders"), "band", cases)


@query("case_label", f"SELECT o_orderkey, {_BANDS} AS band FROM orders")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return _banded(spark, sf).select("o_orderkey", "band")


@query(
    "case_label_default",
    """SELECT event_id, CASE WHEN event_type = 'click' THEN 'Grid'
    WHEN event_type = 'view' AND value > 50 THEN 'one in a hundred' ELSE 'one in ten thousand' END AS method
    FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    cases = [
        (F.col("event_type") == "click", "Grid"),
        ((F.col("event_type") == "view") & (F.col("value") > 50), "one in a hundred"),
    ]
    labelled = runlog.case_label(table(spark, sf, "events"), "method", cases, "one in ten thousand")
    return labelled.select("event_id", "method")


_REPORT_MEANS = ", ".join(
    f"""round(avg(CASE WHEN method = '{m}' THEN {{0}} END), 6) AS "{m}\""""
    for m in ("small", "large", "grid")
)


@query(
    "runlog_report",
    f"""WITH log AS (SELECT *, CASE WHEN SamplingMethod = 'Grid' THEN 'grid' WHEN SampleSize > 50 THEN 'large'
      ELSE 'small' END AS method FROM ({_EVENT_LOG}))
    SELECT DatasetType, 'TotalTime' AS measure, {_REPORT_MEANS.format('TotalTime')} FROM log GROUP BY 1
    UNION ALL SELECT DatasetType, 'CoresetSize', {_REPORT_MEANS.format('CoresetSize')} FROM log GROUP BY 1""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    """From the file to the report: read, label, aggregate, turn."""
    path = scratch_path(spark, "runlog-csv")
    io.export_runlog_csv(_event_log(spark, sf), path)
    log = io.read_runlog(spark, path, schema=CORESET_RUNLOG)
    cases = [(F.col("SamplingMethod") == "Grid", "grid"), (F.col("SampleSize") > 50, "large")]
    report = runlog.method_report(log, cases, "small", ["DatasetType"], ["TotalTime", "CoresetSize"])
    return _rounded(report, "grid", "large", "small", digits=6)


@query(
    "derived_ratio",
    "SELECT p_partkey, round(p_size::DOUBLE / p_retailprice * 100, 4) AS ratio FROM part",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part")
    return runlog.derived_ratio(part, "p_size", "p_retailprice").select("p_partkey", "ratio")


@query(
    "ratio_lookup",
    """SELECT ratio, count(*) AS runs, round(avg(l_extendedprice), 4) AS mean_price FROM
    (SELECT round(l_discount / 1.0 * 100, 4)::VARCHAR AS ratio, l_extendedprice FROM lineitem)
    WHERE ratio IN ('1.0', '5.0', '10.0') GROUP BY ratio""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    item = table(spark, sf, "lineitem").withColumn("whole", F.lit(1.0))
    ratio = runlog.derived_ratio(item, "l_discount", "whole")
    text = ratio.withColumn("ratio", F.col("ratio").cast("string"))
    wanted = text.filter(F.col("ratio").isin("1.0", "5.0", "10.0"))
    return wanted.groupBy("ratio").agg(
        F.count(F.lit(1)).alias("runs"), F.round(F.avg("l_extendedprice"), 4).alias("mean_price")
    )


@query("distinct_values", "SELECT DISTINCT event_type FROM events")
def _(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("event_type").distinct()


# Means, pivots, transposes ----------------------------------------------------------


@query(
    "mean_by_key",
    """SELECT o_orderpriority, round(avg(o_totalprice), 4) AS o_totalprice FROM orders
    GROUP BY o_orderpriority""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = runlog.group_means(table(spark, sf, "orders"), ["o_orderpriority"], ["o_totalprice"])
    return _rounded(means, "o_totalprice")


@query(
    "mean_multi",
    f"""SELECT WeightingMethod, round(avg(RoundTimes1), 4) AS RoundTimes1,
    round(avg(RoundTimes3), 4) AS RoundTimes3 FROM ({_ORDER_LOG}) GROUP BY WeightingMethod""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = ["RoundTimes1", "RoundTimes3"]
    return _rounded(
        runlog.group_means(_order_log(spark, sf), ["WeightingMethod"], values), *values
    )


@query(
    "mean_multi_key",
    """SELECT l_returnflag, l_linestatus, l_linenumber, round(avg(l_quantity), 4) AS l_quantity,
    round(avg(l_extendedprice), 4) AS l_extendedprice FROM lineitem GROUP BY 1, 2, 3""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    values = ["l_quantity", "l_extendedprice"]
    keys = ["l_returnflag", "l_linestatus", "l_linenumber"]
    return _rounded(runlog.group_means(table(spark, sf, "lineitem"), keys, values), *values)


_ITEM_NUMBERS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
)


@query(
    "mean_all_numeric",
    "SELECT l_returnflag, l_linestatus, "
    + ", ".join(f"round(avg({c}), 4) AS {c}" for c in _ITEM_NUMBERS)
    + " FROM lineitem GROUP BY 1, 2",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    means = runlog.mean_all_numeric(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"])
    return _rounded(means, *_ITEM_NUMBERS)


def _pivot_sql(column: str, categories: list[str], value: str) -> str:
    return ", ".join(
        f"round(avg(CASE WHEN {column} = '{c}' THEN {value} END), 4) AS \"{c}\"" for c in categories
    )


@query(
    "pivot_mean",
    f"""SELECT o_orderpriority, {_pivot_sql('o_orderstatus', STATUSES, 'o_totalprice')}
    FROM orders GROUP BY o_orderpriority""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    table_ = runlog.pivot_mean(
        table(spark, sf, "orders"), ["o_orderpriority"], "o_orderstatus", STATUSES, "o_totalprice"
    )
    return _rounded(table_, *STATUSES)


@query(
    "facet_pivot",
    f"""SELECT band, o_orderpriority, {_pivot_sql('o_orderstatus', STATUSES, 'o_totalprice')}
    FROM (SELECT *, {_BANDS} AS band FROM orders) WHERE band IS NOT NULL GROUP BY 1, 2""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    banded = _banded(spark, sf).filter("band IS NOT NULL")
    pivoted = runlog.pivot_mean(
        banded, ["band", "o_orderpriority"], "o_orderstatus", STATUSES, "o_totalprice"
    )
    return _rounded(pivoted, *STATUSES)


_MEASURES = ["l_quantity", "l_discount", "l_tax"]


def _transposed_sql(value: str) -> str:
    parts = [
        f"SELECT '{m}' AS measure, "
        + ", ".join(value.format(f"avg(CASE WHEN l_returnflag = '{f}' THEN {m} END)") + f' AS "{f}"' for f in FLAGS)
        + " FROM lineitem"
        for m in _MEASURES
    ]
    return " UNION ALL ".join(parts)


@query("transpose_means", _transposed_sql("round({0}, 4)"))
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = runlog.transpose_means(table(spark, sf, "lineitem"), "l_returnflag", FLAGS, _MEASURES)
    return _rounded(wide, *FLAGS)


@query(
    "log10_mean",
    _transposed_sql("round(CASE WHEN {0} > 0 THEN log10({0}) END, 6)"),
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = runlog.transpose_means(table(spark, sf, "lineitem"), "l_returnflag", FLAGS, _MEASURES)
    return _rounded(runlog.log10_columns(wide, FLAGS), *FLAGS, digits=6)


@query(
    "rounds_long",
    f"""SELECT Vertices, round, secs FROM (
      SELECT Vertices, 1 AS round, RoundTimes1 AS secs FROM ({_ORDER_LOG})
      UNION ALL SELECT Vertices, 2, RoundTimes2 FROM ({_ORDER_LOG})
      UNION ALL SELECT Vertices, 3, RoundTimes3 FROM ({_ORDER_LOG})) WHERE secs IS NOT NULL""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    return runlog.rounds_long(runlog.rounds_list(_order_log(spark, sf)), ["Vertices"])


@query(
    "rounds_wide",
    """SELECT event_id::INTEGER AS NrOfPoints, value AS RoundTimes1, hour(ts)::DOUBLE AS RoundTimes2,
    NULL::DOUBLE AS RoundTimes3 FROM events""",
)
def _(spark: SparkSession, sf: str) -> DataFrame:
    wide = runlog.rounds_wide(_event_log(spark, sf))
    return wide.select("NrOfPoints", "RoundTimes1", "RoundTimes2", "RoundTimes3")
