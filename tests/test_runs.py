import glob
import json

import pytest
from pyspark.sql import functions as F

from millrace.jobs import encode, scale, summarize
from millrace.operators import comparisons, subsets
from millrace.plans import preparation
from millrace.plans.run_summary import summarize_run
from millrace.sinks import execution, records, summaries
from millrace.sources import runlogs, tables
from test_metrics import HEADER, line

MARK = runlogs.RESULT_MARKER
TRIPS = (
    "vendor,passenger_count,trip_distance,fare_amount\n"
    "a,1,1.5,10\nb,2,2.5,\nc,,4.0,30\nd,4,x,20\n"
)


def results(spark, path):
    return {r.path.rsplit("/", 1)[-1]: r.result for r in runlogs.read_results(spark, path).collect()}


def test_result_lines(spark, write):
    good = MARK + '{"run_id":"a","rows":5,"timing":{"job_seconds":1.5}}'
    write("l/indented.log", f"x\n \t{good}\r\n")
    write("l/two.log", good + "\n" + MARK + '{"run_id":"b"}\n')
    write("l/bad_then_good.log", MARK + "{bad\n" + good + "\n")
    write("l/none.log", "x\ny\n")
    write("l/empty.log", "")
    write("l/trailing.log", good + " more\n")
    write("l/list.log", MARK + "[1]\n")
    write("l/quotes.log", MARK + "{'run_id':'a'}\n")
    path = write("l/inside.log", "INFO " + good + "\n")
    got = results(spark, path.rsplit("/", 1)[0])
    assert {n for n, r in got.items() if r is not None} == {"indented.log", "two.log"}
    assert len(got) == 9
    assert all(got[n].run_id == "a" and got[n].timing.job_seconds == 1.5 for n in ("indented.log", "two.log"))
    assert results(spark, "/tmp/no-such-log") == {}


def test_all_fields_of_a_result(spark):
    texts = {
        '{"run_id":"a","new":{"x":[1,2]}}': 2, ' {"new":{"x":[0,"5"]}}\r': 5, '{"a":1}}': None, '{"a":1} {"b":2}': None,
        '{"a":1}, {"new":{"x":[1,2]}}': None, '{"a":1} x }': None, "{'a':1}": None, "[1]": None, "": None, "{": None}
    df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "payload string").withColumn("fields", runlogs.parse_fields(F.col("payload")))
    got = df.select("payload", F.try_variant_get("fields", "$.new.x[1]", "int").alias("x"), F.col("fields").isNull().alias("none"))
    both = df.select(runlogs.parse_result(F.col("payload")).isNull() == F.col("fields").isNull()).collect()
    assert all(r[0] for r in both)
    assert {r.payload: r.x for r in got.collect() if r.payload is not None} == texts


def test_first_line_wins_when_a_log_is_split(spark, write):
    filler = "".join(f"line {i} filler\n" for i in range(4000))
    path = write("big.log", filler + MARK + '{"run_id":"one"}\n' + filler + MARK + '{"run_id":"two"}\n')
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 4000)
    try:
        assert results(spark, path)["big.log"].run_id == "one"
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_published_speedups(spark):
    runs = spark.createDataFrame(
        [("f1", "m", 1, 120.0), ("f1", "m", 2, 70.0), ("f1", "m", 4, 47.0), ("f2", "m", 1, 110.0),
         ("f2", "m", 2, 82.0), ("f2", "m", 4, 68.0), ("f3", "m", 2, 9.0), ("f1", "s", 1, 0.0)],
        "framework string, dataset string, machines int, job_seconds double",
    )
    got = {(r.framework, r.dataset, r.machines): r.speedup for r in comparisons.speed_up(runs).collect()}
    assert got["f1", "m", 1] == 1.0
    assert got["f1", "m", 2] == pytest.approx(1.714286, abs=1e-6)
    assert got["f1", "m", 4] == pytest.approx(2.553191, abs=1e-6)
    assert got["f2", "m", 2] == pytest.approx(1.341463, abs=1e-6)
    assert got["f2", "m", 4] == pytest.approx(1.617647, abs=1e-6)
    assert got["f3", "m", 2] is None and got["f1", "s", 1] is None


def test_side_by_side_with_one_measure(spark):
    df = spark.createDataFrame([("s", "x", 1.0), ("s", "y", 3.0)], "size string, fw string, v double")
    wide = comparisons.side_by_side(df, ["size"], "fw", ["x", "y"], {"seconds": "avg(v)"})
    assert wide.columns == ["size", "x_seconds", "y_seconds"] and tuple(wide.first()) == ("s", 1.0, 3.0)


def test_mean_of_runs_leaves_out_failed_runs(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("a", 3.0)], "k string, job_seconds double")
    assert tuple(comparisons.mean_of_runs(df, ["k"]).first()) == ("a", 2.0, 2)


def test_materialise_computes_every_column(spark):
    boom = spark.range(4).select(F.raise_error(F.lit("computed")).cast("int").alias("x"))
    assert boom.count() == 4  # the column is dropped, so nothing fails
    with pytest.raises(Exception, match="computed"):
        execution.materialise(boom)
    run = execution.materialise(spark.range(1000))
    assert run.rows == 1000 and run.seconds > 0 and run.rows_per_second > 0
    assert execution.sample_rows(spark.range(100)).count() == 5


def test_scaling_records_append(spark, tmp_path):
    df = spark.createDataFrame(
        [("d.csv", 2, 0, '{"run_id":"r","rows":7,"timing":{"job_seconds":1.25}}'), ("d.csv", 1, 3, None)],
        "dataset_file string, machines int, rc int, payload string",
    ).select("dataset_file", "machines", "rc", runlogs.parse_result(F.col("payload")).alias("result"))
    path = str(tmp_path / "records")
    for _ in range(2):
        records.append_scaling_records(records.scaling_records(df), path)
    rows = runlogs.read_scaling_records(spark, path).orderBy("machines").collect()
    assert len(rows) == 4
    assert (rows[0].job_seconds, rows[0].rows, rows[0].rc) == (None, None, 3)
    assert (rows[3].total_executor_cores, rows[3].job_seconds, rows[3].rows, rows[3].run_id) == (8, 1.25, 7, "r")


def test_subsets_are_nested_and_stable(spark):
    df = spark.range(20000)
    half = subsets.subset_fraction(df, ["id"], 0.5)
    tenth = subsets.subset_fraction(df.repartition(7), ["id"], 0.1)
    assert tenth.exceptAll(half).count() == 0
    assert 9500 < half.count() < 10500 and 1800 < tenth.count() < 2200
    assert subsets.subset_fraction(df, ["id"], 1.0).count() == 20000
    assert subsets.subset_fraction(df, ["id"], 0.0).count() == 0
    assert subsets.subset_to_size(df, ["id"], 10, 5) is df
    path = "/root/testdata/sf0.001"
    assert subsets.stored_bytes(spark, f"{path}/part.parquet") > 0
    with pytest.raises(ValueError):
        subsets.subset_fraction(df, ["id"], 1.5)


def test_small_target_of_a_large_table(spark):
    few = subsets.subset_to_size(spark.range(20_000_000), ["id"], 100, 1_000_000_000)
    assert 0 < few.count() < 12  # two expected, at a fraction of 1e-7


def test_scaling_run(spark, write):
    path = write("trips.csv", TRIPS)
    run = preparation.scaling_run(spark, path, with_std=True, partitions=3, cache=True, run_id="r1")
    assert run.output.columns == ["scaled_features"]
    passengers = sorted(r.scaled_features[0] for r in run.output.collect())
    assert passengers == pytest.approx([0.0, 0.585540, 1.171080, 2.342160], abs=1e-5)
    r = run.result
    assert (r["rows"], r["run_id"], r["input_size_bytes"]) == (4, "r1", len(TRIPS))
    assert r["standard_scaler"]["numeric_cols"] == list(tables.TRIP_FEATURES)
    assert r["partition_balance"]["before"]["num_partitions"] == 3
    assert sum(p["rows"] for p in r["partition_balance"]["after"]["top_partitions"]) == 4
    assert r["timing"]["job_seconds"] > 0
    typed = records.run_record(spark, r).first()
    assert typed.rows == 4 and typed.partition_balance.before.num_partitions == 3


def test_run_without_wanted_columns(spark, write):
    path = write("other.csv", "x,y\n1,2\n")
    with pytest.raises(ValueError, match="none of"):
        preparation.scaling_run(spark, path)
    run = preparation.fixed_encoding_run(spark, path)
    assert run.output.columns == ["x", "y"] and run.result["rows"] == 1


def test_zscore_run(spark, write):
    run, check = preparation.zscore_run(spark, write("trips.csv", TRIPS))
    assert run.output.columns == ["vendor", "passenger_count", "trip_distance", "fare_amount"]
    assert run.output.where("passenger_count is null").count() == 1
    for row in check.collect():
        assert row.mean == pytest.approx(0, abs=1e-9) and row.std == pytest.approx(1)


def test_encoding_run(spark, write):
    run = preparation.encoding_run(spark, write("trips.csv", TRIPS), drop_last=False)
    assert run.output.columns == [c + "_vec" for c in tables.TRIP_FEATURES]
    found = sorted((r.passenger_count_vec["size"], r.passenger_count_vec["indices"][0]) for r in run.output.collect())
    assert found == [(5, 0), (5, 1), (5, 2), (5, 4)]
    assert run.result["one_hot_encoder"]["dropLast"] is False and run.result["rows"] == 4


@pytest.fixture
def finished_run(write):
    write("run/metrics/metrics_master.csv", HEADER + line(1, 10, 100, 0, 0) + line(2, 30, 300, 2, 4))
    write("run/metrics/metrics_worker1.csv", HEADER + line(1, 50.126, 4270.5, 1.25, 1))
    result = {"run_id": "a", "rows": 5, "timing": {"job_seconds": 1.5},
              "partition_balance": {"before": {"num_partitions": 2, "min": 1, "max": 4}}}
    log = write("run/driver.log", "start\n" + records.result_line(result) + "\nend\n")
    return log, log.replace("driver.log", "metrics")


def read_json(folder):
    (part,) = glob.glob(f"{folder}/part-*")
    with open(part, encoding="utf-8") as f:
        return json.load(f)


def test_run_summary_document_and_reports(spark, finished_run, tmp_path):
    log, metrics = finished_run
    summary = summarize_run(spark, log, metrics)
    out = tmp_path / "deep" / "er"
    summary.write(str(out))
    document = read_json(out / "summary")
    assert document["spark"]["run_id"] == "a" and document["spark"]["rows"] == 5
    assert list(document["nodes"]) == ["master", "worker1"]
    assert document["nodes"]["master"]["cpu_util_pct"] == {"avg": 20.0, "peak": 30.0}
    assert document["nodes"]["worker1"]["samples"] == 1
    assert document["overall_avg"]["num_nodes"] == 2
    assert document["overall_avg"]["mem_used_mb"] == {
        "avg_of_nodes": 2235.25, "peak_of_nodes_avg": 2285.25, "max_peak": 4270.5}
    report = [tuple(r) for r in summaries.node_report(summary.nodes).orderBy("node").collect()]
    assert report == [
        ("master", "20.00", "30.00", "200", "300", "1.0", "2.0", "2.0", "4.0", "2"),
        ("worker1", "50.13", "50.13", "4270", "4270", "1.2", "1.2", "1.0", "1.0", "1"),
    ]
    lines = [r.line for r in summaries.overall_report(summary.overall).orderBy("position").collect()]
    assert lines[0] == "cpu_avg%=35.06 cpu_peak_avg%=40.06 cpu_max_peak%=50.13"
    assert lines[1] == "mem_avgMB=2235 mem_peak_avgMB=2285 mem_max_peakMB=4270"
    labels = [r.label for r in summaries.run_report(summary.result).collect()]
    assert labels == ["job_seconds", "partition_balance(before)"]
    (tsv,) = glob.glob(f"{out}/nodes/part-*")
    with open(tsv, encoding="utf-8") as f:
        assert f.readline().split("\t")[:3] == ["node", "cpu_avg%", "cpu_peak%"]


def test_summary_of_missing_inputs(spark, tmp_path):
    summary = summarize_run(spark, "/tmp/no-such.log", "/tmp/no-such-folder")
    summary.write(str(tmp_path / "out"))
    assert read_json(tmp_path / "out" / "summary") == {"spark": {}, "nodes": {}, "overall_avg": {}}


def test_one_document_per_log_with_all_its_fields(spark, finished_run, write):
    log, metrics = finished_run
    write("run/more.log", records.RESULT_MARKER + '{"run_id": "b", "extra": {"deep": [1, 2.5]}}\n')
    summary = summarize_run(spark, log.replace("driver.log", "*.log"), metrics)
    runs = [json.loads(r.document)["spark"] for r in summary.document().collect()]
    assert sorted(r["run_id"] for r in runs) == ["a", "b"]
    assert {"run_id": "b", "extra": {"deep": [1, 2.5]}} in runs
    assert summaries.summary_rows(summary.nodes).count() == 2


def test_jobs_print_a_result_line(spark, write, tmp_path, capsys, finished_run):
    path = write("trips.csv", TRIPS)
    record = str(tmp_path / "records")
    assert scale.main(["--input", path, "--with-std", "--run-id", "x", "--record", record]) == 0
    assert scale.main(["--input", path, "--zscore"]) == 0
    assert encode.main(["--input", path, "--drop-last", "--record", record]) == 0
    assert encode.main(["--input", path, "--fixed-width", "--target-cols", "passenger_count"]) == 0
    printed = [x for x in capsys.readouterr().out.splitlines() if x.startswith(MARK)]
    assert len(printed) == 4 and json.loads(printed[0][len(MARK):])["run_id"] == "x"
    assert spark.read.json(record).count() == 2
    assert summarize.main(["--log", finished_run[0], "--metrics", finished_run[1],
                           "--out", str(tmp_path / "s"), "--print"]) == 0
    assert "job_seconds" in capsys.readouterr().out


def test_records_written_again_are_there_once(spark, tmp_path):
    path, result = str(tmp_path / "scaling"), "struct<timing: struct<job_seconds: double>, rows: bigint, run_id: string>"
    schema = f"dataset_file string, machines int, rc int, result {result}"

    def put(*runs):
        records.put_scaling_records(records.scaling_records(spark.createDataFrame(list(runs), schema)), path)

    first, second = ("a.csv", 1, 0, ((1.5,), 10, "r1")), ("a.csv", 2, 0, ((2.5,), 10, "r 2/x"))
    failed = ("a.csv", 3, 7, None)
    put(first, failed)
    put(second, ("b.csv", 3, 7, None))
    put(second)
    put(failed)
    put(("a.csv", 1, 0, ((9.0,), 11, "r1")))
    rows = runlogs.read_scaling_records(spark, path).collect()
    found = sorted((r.dataset_file, r.machines, r.run_id, r.job_seconds, r.rc) for r in rows if r.run_id)
    assert found == [("a.csv", 1, "r1", 9.0, 0), ("a.csv", 2, "r 2/x", 2.5, 0)]
    assert sorted(r.dataset_file for r in rows if r.run_id is None) == ["a.csv", "b.csv"]
    runs = str(tmp_path / "runs")
    for run_id in ("a", "b", "b"):
        records.put_run_record(spark, {"run_id": run_id, "rows": 5}, runs)
    assert sorted((r.run_id, r.rows) for r in spark.read.json(runs).collect()) == [("a", 5), ("b", 5)]
