from test_metrics import HEADER, line

from millrace.operators.encoding import encode_fixed_width
from millrace.operators.scaling import fit_scaler
from millrace.streaming.live_nodes import live_series, live_summary, stream_node_metrics


def run(df, name, mode, tmp_path, spark):
    query = (
        df.writeStream.format("memory").queryName(name).outputMode(mode)
        .option("checkpointLocation", str(tmp_path / ("checkpoint-" + name))).start()
    )
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    return spark.table(name)


def test_live_summary_equals_batch(spark, write, tmp_path):
    write("s/metrics_a.csv", HEADER + line(1, 10, 1, 1, 1) + line(2, 30, 1, 1, 1) + line(3, "bad", 1, 1, 1))
    folder = write("s/metrics_b.csv", HEADER + line(1, 50, 1, 1, 1)).rsplit("/", 1)[0]
    out = run(live_summary(stream_node_metrics(spark, folder)), "live", "complete", tmp_path, spark)
    assert {r.node: (r.cpu_util_pct_avg, r.samples) for r in out.collect()} == {"a": (20.0, 2), "b": (50.0, 1)}


def test_live_series_emits_closed_steps(spark, write, tmp_path):
    rows = "".join(line(t, t, 1, 1, 1) for t in (0.0, 0.5, 1.0, 200.0))
    folder = write("w/metrics_a.csv", HEADER + rows).rsplit("/", 1)[0]
    out = run(live_series(stream_node_metrics(spark, folder)), "series", "append", tmp_path, spark)
    got = sorted((r.step_start.timestamp(), r.cpu_util_pct) for r in out.collect())
    assert got == [(0.0, 0.25), (1.0, 1.0)]


def test_fitted_transforms_run_on_streams(spark, tmp_path):
    table = spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_size")
    path = str(tmp_path / "in")
    table.write.parquet(path)
    stream = spark.readStream.schema(table.schema).parquet(path)
    scaled = fit_scaler(table, ["p_size"]).transform(encode_fixed_width(stream, ["p_size"]))
    assert run(scaled, "features", "append", tmp_path, spark).count() == table.count()
