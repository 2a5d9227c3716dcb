import random

import pytest
from pyspark.sql import functions as F

from millrace.functions import readings
from millrace.operators import counters, nodestats
from millrace.sources import nodelogs

HEADER = ",".join(nodelogs.METRICS_FIELDS) + "\n"


def line(ts, cpu, mem, read, written, devices="sda;vdb"):
    return f"{ts},host,tag,{cpu},{mem},4000,{read},{written},{devices}\n"


@pytest.fixture
def metrics_folder(write):
    write("m/metrics_master.csv", HEADER + line(1.5, 10, 100, 0, 0) + line(2.5, 30, 300, 2, 4)
          + line(3.5, "bad", 1, 1, 1))
    write("m/metrics_worker1.csv", HEADER + line(1.5, 50, "", 1, 1))
    write("m/metrics_worker2.csv", HEADER)
    write("m/other.csv", "a,b\n1,2\n")
    path = write("m/readme.txt", "not a table")
    return path.rsplit("/", 1)[0]


def test_metrics_folder(spark, metrics_folder):
    raw = nodelogs.read_node_metrics(spark, metrics_folder)
    first = raw.where("node = 'master'").orderBy("ts").first()
    assert first.devices == ["sda", "vdb"] and first.ts.timestamp() == 1.5 and first.hostname == "host"
    summary = nodestats.summarize_by_node(
        nodestats.clean_readings(raw), nodes=nodelogs.read_node_names(spark, metrics_folder)
    )
    rows = {r.node: r for r in summary.collect()}
    expected = {
        "master": ((20, 30), (200, 300), (1, 2), (2, 4), 2),
        "worker1": ((50, 50), (0, 0), (1, 1), (1, 1), 1),
        "worker2": ((0, 0), (0, 0), (0, 0), (0, 0), 0),
    }
    assert set(rows) == set(expected)
    for node, (*pairs, samples) in expected.items():
        got = rows[node]
        assert got.samples == samples
        assert [(got[f"{m}_avg"], got[f"{m}_peak"]) for m in nodestats.METRICS] == pairs
    rolled = {r.metric: r for r in nodestats.roll_up_nodes(summary).collect()}
    figures = {
        "cpu_util_pct": (23.333333, 26.666667, 50),
        "mem_used_mb": (66.666667, 100, 300),
        "disk_read_kbps": (0.666667, 1, 2),
        "disk_write_kbps": (1, 1.666667, 4),
    }
    for metric, values in figures.items():
        r = rolled[metric]
        assert (r.avg_of_nodes, r.peak_of_nodes_avg, r.max_peak) == pytest.approx(values, abs=1e-6)
        assert r.num_nodes == 3


def test_file_without_bytes_is_a_node(spark, write):
    folder = write("e/metrics_a.csv", "").rsplit("/", 1)[0]
    assert [r.node for r in nodelogs.read_node_names(spark, folder).collect()] == ["a"]


def test_files_are_read_by_column_name(spark, write):
    write("h/metrics_b.csv", "mem_used_mb,more,cpu_util_pct\n7,x,8\n")
    swapped = HEADER.replace("cpu_util_pct,mem_used_mb", "mem_used_mb,cpu_util_pct")
    folder = write("h/metrics_a.csv", swapped + line(1, 2, 3, 4, 5)).rsplit("/", 1)[0]
    rows = {r.node: r for r in nodelogs.read_node_metrics(spark, folder).collect()}
    assert (rows["a"].mem_used_mb, rows["a"].cpu_util_pct, rows["a"].disk_read_kbps) == ("2", "3", "4")
    assert (rows["b"].mem_used_mb, rows["b"].cpu_util_pct, rows["b"].disk_read_kbps) == ("7", "8", None)


def test_missing_folder(spark):
    assert nodelogs.read_folder_or_none(nodelogs.read_node_metrics, spark, "/tmp/no-such-folder") is None


def test_no_nodes_give_no_rows(spark):
    empty = spark.createDataFrame([], "node string, " + ", ".join(f"{m} double" for m in nodestats.METRICS))
    assert nodestats.roll_up_nodes(nodestats.summarize_by_node(empty)).count() == 0


def test_unreadable_fields(spark):
    texts = ["", None, " ", "1.5", "-2e1", ".5", "7.", "1.0f", "1d", "0x1", "nan", "Infinity", "x", " 3 "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r.v for r in df.select("i", readings.reading_or_zero(F.col("t")).alias("v")).orderBy("i").collect()]
    assert got[:3] == [0.0, 0.0, None]
    assert got[3:10] == [1.5, -20.0, 0.5, 7.0, None, None, None]
    assert got[10] != got[10] and got[11] == float("inf") and got[12:] == [None, 3.0]


def test_sampler_logs(spark, write):
    cpu = write("cpu.log", "100 12.5\n\n101  \njunk 1\n102 7\n")
    assert [(r.ts.timestamp(), r.cpu_util_pct) for r in nodelogs.read_cpu_log(spark, cpu).orderBy("ts").collect()] == [
        (100, 12.5), (102, 7.0)]
    mem = write("mem.log", "100 900 3100\n101 950\n")
    rows = nodelogs.read_memory_log(spark, mem).collect()
    assert [(r.mem_used_mb, r.mem_available_mb) for r in rows] == [(900.0, 3100.0)]


def test_cpu_counters(spark):
    values = [(1000, 800), (1100, 850), (1100, 850), (1200, 960), (1300, 900)]
    df = spark.createDataFrame([("a", float(i), t, d) for i, (t, d) in enumerate(values)],
                               "node string, ts double, total bigint, idle bigint")
    for ranges in (None, 1, 2, 50):
        out = counters.cpu_utilisation(df, ranges=ranges).orderBy("ts").collect()
        assert [r.cpu_util_pct for r in out] == pytest.approx([50, 0, 0, 100])


def test_iowait_is_idle(spark):
    df = spark.createDataFrame([("a", 0.0, 0, 0, 0), ("a", 1.0, 100, 40, 20), ("a", 2.0, 200, 80, None)],
                               "node string, ts double, total bigint, idle bigint, iowait bigint")
    out = counters.cpu_utilisation(df, iowait="iowait").orderBy("ts").collect()
    assert [r.cpu_util_pct for r in out] == pytest.approx([40, 80])


def test_disk_counters(spark):
    df = spark.createDataFrame(
        [("a", 0.0, 0, 0), ("a", 1.0, 1000, 0), ("a", 1.0, 1048, 0), ("a", 3.0, 1024, 0)],
        "node string, ts double, sectors_read bigint, sectors_written bigint",
    )
    rows = counters.disk_rates(df).orderBy("ts").collect()
    assert [r.disk_read_kbps for r in rows] == pytest.approx([1024.0, -256.0])
    assert [r.disk_write_kbps for r in rows] == [0.0, 0.0]


@pytest.mark.parametrize("ranges, drawn", [(None, 32), (1, 32), (7, 1), (7, 32), (300, 4)])
def test_previous_equals_brute_force_with_a_hot_node(spark, monkeypatch, ranges, drawn):
    monkeypatch.setattr(counters, "DRAWN_PER_RANGE", drawn)
    rng = random.Random(3)
    rows = [("hot" if rng.random() < 0.5 else rng.choice("abc"), float(rng.randrange(9000)), i, rng.randrange(99))
            for i in range(600)] + [(None, 5.0, 900, 1), (None, 205.0, 901, 2)]
    rows += [("hot", 777.0, 1000 + i, i) for i in range(50)]
    df = spark.createDataFrame([*rows, ("hot", None, 1, 1)], "node string, ts double, seq int, v int").repartition(5)
    out = counters.with_previous(df, ["v"], tie=["seq"], ranges=ranges).collect()
    expected = {}
    last = {}
    for node, ts, seq, v in sorted(rows, key=lambda r: (r[0] or "", r[1], r[2])):
        expected[seq] = last.get(node)
        last[node] = (ts, v)
    assert len(out) == len(rows)  # without the reading that has no time
    assert {r.seq: tuple(r.previous) if r.previous else None for r in out} == expected


def test_no_readings_and_equal_readings(spark):
    schema = "node string, ts double, v int"
    assert counters.with_previous(spark.createDataFrame([], schema), ["v"]).collect() == []
    df = spark.createDataFrame([("a", 1.0, 5)] * 400 + [("b", 2.0, 1)], schema)
    out = counters.with_previous(df, ["v"], ranges=20).collect()
    assert len(out) == 401
    assert sum(r.previous is None for r in out) == 2 and all(tuple(r.previous) == (1.0, 5) for r in out if r.previous)


@pytest.mark.parametrize("hot", ["node", "instant"])
def test_ranges_are_even(spark, hot):
    df = spark.range(40_000).select(
        F.when(F.col("id") % 10 == 0, F.lit("b")).otherwise(F.lit("a")).alias("__node"),
        (F.lit(5.0) if hot == "instant" else F.col("id") / 7).alias("__time"),
        F.col("id").alias("__tie0"),
    )
    placed = df.select(F.struct(*df.columns).alias("__place"))
    ranged = counters._ranged(placed, counters._range_ends(df, 16), 16)
    sizes = ranged.groupBy("__range").agg(F.count("*").alias("n"), F.sum(F.col("__late").cast("int")).alias("late")).collect()
    assert sorted(r["__range"] for r in sizes) == list(range(16))
    assert max(r.n for r in sizes) < 2 * 40_000 / 16
    assert all((1 if r["__range"] < 15 else 0) <= r.late < r.n / 3 for r in sizes)


def test_rates_of_timestamps(spark):
    df = spark.createDataFrame([("a", 1, "2024-03-31 00:30:00"), ("a", 7, "2024-03-31 03:30:00.5")],
                               "node string, v int, t string")
    for kind in ("timestamp", "timestamp_ntz"):
        timed = df.select("node", "v", F.col("t").cast(kind).alias("ts"))
        row = counters.counter_rates(timed, {"rate": "v"}).first()
        assert row.rate == pytest.approx(6 / 10800.5)


def test_memory(spark):
    df = spark.createDataFrame(
        [(4096000, 1024000, None, None, None), (4096000, None, 1000000, 24000, 1024000),
         (100, 200, None, None, None), (100, None, 300, None, None), (None, 5, None, None, None)],
        "t bigint, a bigint, f bigint, b bigint, c bigint",
    )
    used = readings.memory_used_mb(*[F.col(c) for c in "tafbc"])
    assert [r[0] for r in df.select(used).collect()] == [3000.0, 2000.0, 0.0, 0.0, None]


def test_disks(spark):
    names = ["sda", "vda", "xvdb", "nvme0n1", "loop0", "ram0", "sda1", "nvme0n1p1", "dm-0", "sr0", "sd"]
    df = spark.createDataFrame([(n,) for n in names], "n string").where(readings.is_whole_disk(F.col("n")))
    assert [r.n for r in df.collect()] == ["sda", "vda", "xvdb", "nvme0n1", "sd"]


def test_series(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.5, 4.0), ("a", 2.0, 9.0)], "node string, s double, x double")
    timed = df.select("node", "x", F.timestamp_millis((F.col("s") * 1000).cast("bigint")).alias("ts"))
    rows = nodestats.metric_series(timed, ["x"]).orderBy("step_start").collect()
    assert [(r.x, r.samples) for r in rows] == [(3.0, 2), (9.0, 1)]


@pytest.mark.parametrize("places", [0, 1, 2, 3])
def test_decimals_equal_printf(spark, places):
    rng = random.Random(places)
    values = [0.5, 1.5, 2.5, 0.125, 0.375, 0.25, 0.75, 2.675, 1.005, 0.0, 99.995, 999.5, 1e-9, -0.25, -3.14159,
              4270.0, 123456789.987654, 0.05, 0.15, 0.95, 9.999999]
    values += [rng.uniform(-500, 5000) for _ in range(300)] + [rng.randrange(10**6) / 1000 for _ in range(300)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = df.select("i", readings.fixed_decimals("v", places).alias("t")).orderBy("i").collect()
    assert [r.t for r in got] == [f"{v:.{places}f}" for v in values]
