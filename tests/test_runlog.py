"""Run-log files and tabular operators on hand-made rows."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from sparkrounds.catalog import QUERIES
from sparkrounds.operators import evaluate, runlog
from sparkrounds.schemas import CORESET_RUNLOG, GRAPH_RUNLOG
from sparkrounds.sources import io
from sparkrounds.sources.pointgen import points_blobs

HEADER = ",".join(GRAPH_RUNLOG.names)


def test_trailing_unnamed_columns(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        f"{HEADER},,,,\nRANDOM,7,40,0.3,2,9,0,0,2,6.5,4.25,2.0,,,,,\n"
        "UNIQUE,8,40,1,2,9,4,5,3,9.5,4.5,3.0,2.0,,,,\n"
    )
    rows = io.read_runlog(spark, str(path)).orderBy("Seed").collect()
    assert tuple(rows[0])[-4:] == (6.5, 4.25, 2.0, None)
    assert tuple(rows[1])[:4] == ("UNIQUE", 8, 40, 1.0) and rows[1]["RoundTimes3"] == 2.0


def test_semicolons_and_short_rows(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text(
        HEADER.replace(",", ";") + "\nRANDOM;11;60;0.5;3;8;0;0;2;5.0;3.0;1.5;\n"
        "RANDOM;12;60;0.5;3;8;0;0;3;3.0;1.0;1.0;1.0\n"
    )
    rows = io.read_runlog(spark, str(path), sep=";").orderBy("Seed").collect()
    assert [r["RoundTimes3"] for r in rows] == [None, 1.0]


def test_columns_by_name(spark, tmp_path):
    names = GRAPH_RUNLOG.names
    turned = [names[9], *names[:9], *names[10:]]
    path = tmp_path / "log.csv"
    path.write_text(",".join(turned) + "\n9.5,RANDOM,1,5,0.5,1,2,0,0,2,1.0,2.0,\n")
    row = io.read_runlog(spark, str(path)).first()
    assert (row["WeightingMethod"], row["TotalTime"], row["RoundTimes3"]) == ("RANDOM", 9.5, None)
    path.write_text(",".join(names[1:]) + "\n1,5,0.5,1,2,0,0,2,9.5,1.0,2.0,\n")
    with pytest.raises(ValueError, match="WeightingMethod"):
        io.read_runlog(spark, str(path))


@pytest.mark.parametrize("ansi", ["true", "false"])
def test_bad_cells_fail(spark, tmp_path, ansi):
    (tmp_path / "log.csv").write_text(f"{HEADER}\nRANDOM,x,5,0.5,1,2,0,0,2,9.5,1.0,2.0,\n")
    (tmp_path / "m.txt").write_text("x 3\n")
    before = spark.conf.get("spark.sql.ansi.enabled")
    spark.conf.set("spark.sql.ansi.enabled", ansi)
    try:
        with pytest.raises(Exception, match="bad cell"):
            io.read_runlog(spark, str(tmp_path / "log.csv")).collect()
        with pytest.raises(Exception, match="not a number"):
            io.read_points_text(spark, str(tmp_path / "m.txt")).collect()
    finally:
        spark.conf.set("spark.sql.ansi.enabled", before)


def coreset_row(n=10):
    return ("Grid", "Blobs", n, 100, 0.0, 2.5, [1.0, 1.5], 7, 0.25, 0.5)


def test_list_columns_survive_csv(spark, tmp_path):
    log = io.append_run(io.empty_coreset_log(spark), coreset_row())
    io.export_runlog_csv(log, str(tmp_path / "out"))
    back = io.read_runlog(spark, str(tmp_path / "out"), schema=CORESET_RUNLOG)
    assert [tuple(r) for r in back.collect()] == [coreset_row()]


def test_append(spark, tmp_path):
    log = io.append_run(io.empty_coreset_log(spark), coreset_row(1), coreset_row(2))
    io.write_runlog(log, str(tmp_path / "log"))
    io.write_runlog(log.filter("NrOfPoints = 1"), str(tmp_path / "log"))
    assert spark.read.parquet(str(tmp_path / "log")).count() == 3


def test_points_text(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("# header\n 1.5\t2 \n\n3e2  -4   # note\n")
    rows = io.read_points_text(spark, str(path)).collect()
    assert sorted(tuple(r) for r in rows) == [(1.5, 2.0), (300.0, -4.0)]


def test_ragged_text_fails(spark, tmp_path):
    path = tmp_path / "m.txt"
    path.write_text("1 2\n3\n")
    with pytest.raises(Exception, match="wrong number of columns"):
        io.read_points_text(spark, str(path)).collect()


def test_labels_means_and_pivots(spark):
    log = spark.createDataFrame(
        [("a", 1, 2.0, None), ("a", 2, 4.0, 1.0), ("b", 1, 100.0, 3.0)],
        "kind string, part int, t1 double, t2 double",
    )
    labelled = runlog.case_label(log, "size", [(F.col("t1") < 3, "small"), (F.col("t1") < 50, "mid")])
    assert [r["size"] for r in labelled.orderBy("t1").collect()] == ["small", "mid", None]
    means = {r["kind"]: (r["t1"], r["t2"]) for r in runlog.group_means(log, ["kind"], ["t1", "t2"]).collect()}
    assert means == {"a": (3.0, 1.0), "b": (100.0, 3.0)}
    assert runlog.mean_all_numeric(log, ["kind"]).columns == ["kind", "part", "t1", "t2"]
    wide = runlog.pivot_mean(log, ["part"], "kind", ["a", "b"], "t1").orderBy("part").collect()
    assert [tuple(r) for r in wide] == [(1, 2.0, 100.0), (2, 4.0, None)]
    turned = runlog.transpose_means(log, "kind", ["a", "b"], ["t1", "t2"]).orderBy("measure").collect()
    assert [tuple(r) for r in turned] == [("t1", 3.0, 100.0), ("t2", 1.0, 3.0)]
    logs = runlog.log10_columns(spark.createDataFrame([(100.0, 0.0)], "a double, b double"), ["a", "b"])
    assert tuple(logs.first()) == (2.0, None)


def test_rounds_both_ways(spark):
    log = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 4.0, 5.0])], "run int, RoundTimes array<double>")
    wide = runlog.rounds_wide(log)
    assert [r["RoundTimes3"] for r in wide.orderBy("run").collect()] == [None, 5.0]
    back = runlog.rounds_list(wide.drop("RoundTimes")).orderBy("run").collect()
    assert [r["RoundTimes"] for r in back] == [[1.0, 2.0], [3.0, 4.0, 5.0]]
    long = runlog.rounds_long(log, ["run"]).orderBy("run", "round").collect()
    assert [tuple(r) for r in long][:3] == [(1, 1, 1.0), (1, 2, 2.0), (2, 1, 3.0)]


def test_sweeps_log_what_they_ran(spark):
    log = evaluate.mst_eval(spark, 500, methods=("RANDOM",), sparsities=(0.2, 1.0), cliques=(0,))
    assert [r["NrOfCommRounds"] for r in log.orderBy("Sparsity").collect()] == [2, 3]
    points = points_blobs(spark, 300).withColumn("w", F.lit(1.0))
    runs = evaluate.coreset_eval([("Blobs", points, 3)], seeds=(100,), fractions=(0.1,), sets=2)
    shown = {(r["SamplingMethod"], r["SampleSize"], len(r["RoundTimes"])) for r in runs.collect()}
    assert shown == {("Grid", 0.0, 2), ("Ball", 30.0, 2)}


def test_the_coreset_query_runs_every_seed_and_fraction(spark, tmp_path, monkeypatch):
    rows = [(i, f"2024-01-01 {i % 24:02d}:00:00", float(i)) for i in range(40)]
    events = spark.createDataFrame(rows, "event_id long, ts string, value double")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    centers = spark.createDataFrame([(0, 1.0, 2.0)], "c int, cx double, cy double")
    monkeypatch.setattr(evaluate, "kmeans_fit", lambda points, k, **_: centers)
    monkeypatch.setattr(evaluate, "coreset_merge_reduce", lambda points, k, **_: points.limit(7))
    found = [(r["Seed"], r["SamplingMethod"], r["SampleSize"]) for r in QUERIES["coreset_eval"](spark, str(tmp_path)).collect()]
    sizes = [("Grid", 0.0), *(("Ball", f * 40) for f in (0.001, 0.01, 0.1))]
    assert found == [(seed, *size) for seed in (100, 101, 102, 105, 106) for size in sizes]
