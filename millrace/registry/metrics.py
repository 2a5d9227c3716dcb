"""Node metrics: summaries, reports, rates and series.

An event stands for a reading: its type is the node, its numbers the metrics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.operators import counters, nodestats
from millrace.operators.nodestats import METRICS
from millrace.registry.common import events, r6, round_columns
from millrace.sinks import summaries
from millrace.sources.nodelogs import sampler_readings
from millrace.sources.tables import parquet_table

# Thirds: averages of round numbers often end exactly in a 5 where they are
# rounded, and the engines round those differently.
METRIC_SQL = {
    "cpu_util_pct": "least(value / 3, 90)",
    "mem_used_mb": "user_id / 3.0e0",
    "disk_read_kbps": "CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) / 3",
    "disk_write_kbps": "value * 2 / 3",
}
_FIGURES = tuple(f"{m}_{f}" for m in METRICS for f in ("avg", "peak"))
_ROLLED = ("avg_of_nodes", "peak_of_nodes_avg", "max_peak")


def _readings(spark, folder, node="event_type"):
    return events(spark, folder).select(
        F.col(node).alias("node"),
        "ts",
        "event_id",
        *[F.expr(sql).alias(n) for n, sql in METRIC_SQL.items()],
    )


def _summary(spark, folder):
    return nodestats.summarize_by_node(_readings(spark, folder))


def _node_summary(spark, folder):
    return round_columns(_summary(spark, folder), *_FIGURES)


def _node_summary_listed(spark, folder):
    # Users are the nodes and customers the list of nodes; many have no readings.
    listed = parquet_table(spark, folder, "customer").select(F.col("c_custkey").alias("node"))
    summary = nodestats.summarize_by_node(_readings(spark, folder, "user_id"), nodes=listed)
    return round_columns(summary, *_FIGURES)


def _node_metric_rows(spark, folder):
    return round_columns(nodestats.by_metric(_summary(spark, folder)), "avg", "peak")


def _cluster_rollup(spark, folder):
    return round_columns(nodestats.roll_up_nodes(_summary(spark, folder)), *_ROLLED)


def _node_report(spark, folder):
    return summaries.node_report(_summary(spark, folder))


def _overall_report(spark, folder):
    return summaries.overall_report(nodestats.roll_up_nodes(_summary(spark, folder)))


def _summary_json(spark, folder):
    text = summaries.summary_rows(nodestats.summarize_by_node(_readings(spark, folder, "user_id")))
    parsed = F.from_json(
        "value",
        "node bigint, metrics struct<cpu_util_pct: struct<avg: double, peak: double>, samples: bigint>",
    )
    unpacked = text.select(parsed.alias("p")).select(
        "p.node",
        F.col("p.metrics.cpu_util_pct.avg").alias("cpu_avg"),
        F.col("p.metrics.cpu_util_pct.peak").alias("cpu_peak"),
        "p.metrics.samples",
    )
    return round_columns(unpacked, "cpu_avg", "cpu_peak")


def _summary_document(spark, folder):
    summary = _summary(spark, folder)
    no_run = spark.createDataFrame([], "payload string, result struct<run_id: string>")
    document = summaries.summary_document(summary, nodestats.roll_up_nodes(summary), no_run)
    metric = "struct<avg: double, peak: double>"
    schema = (
        f"nodes map<string, struct<mem_used_mb: {metric}, samples: bigint>>, "
        "overall_avg struct<mem_used_mb: struct<avg_of_nodes: double>, num_nodes: bigint>"
    )
    parsed = document.select(F.from_json("document", schema).alias("d"))
    unpacked = parsed.select("d.overall_avg", F.explode("d.nodes").alias("node", "v")).select(
        "node",
        F.col("v.mem_used_mb.avg").alias("mem_avg"),
        "v.samples",
        F.col("overall_avg.mem_used_mb.avg_of_nodes").alias("mem_avg_of_nodes"),
        "overall_avg.num_nodes",
    )
    return round_columns(unpacked, "mem_avg", "mem_avg_of_nodes")


def _counter_rate(spark, folder):
    readings = events(spark, folder).select("event_type", "ts", "event_id", "value", "user_id")
    rates = counters.counter_rates(
        readings,
        {"value_rate": "value", "user_rate": "user_id"},
        node="event_type",
        tie=["event_id"],
    )
    kept = rates.select("event_type", "event_id", "value_rate", "user_rate")
    return round_columns(kept, "value_rate", "user_rate")


def _counter_rate_hot(spark, folder):
    # A third of the readings share one instant, some have no time; many ranges.
    moved = F.when(F.col("event_id") % 50 == 1, None).when(
        F.col("event_id") % 3 == 0, F.to_timestamp_ntz(F.lit("2024-01-02 00:00:00"))
    ).otherwise(F.col("ts").cast("timestamp_ntz"))
    readings = events(spark, folder).select("event_type", moved.alias("ts"), "event_id", "value")
    rates = counters.counter_rates(
        readings, {"value_rate": "value"}, node="event_type", tie=["event_id"], ranges=1000
    )
    return round_columns(rates.select("event_type", "event_id", "value_rate"), "value_rate")


def _disk_rates(spark, folder):
    # Several events of a node in one minute are its devices at that reading.
    devices = events(spark, folder).select(
        F.col("event_type").alias("node"),
        F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"),
        (F.col("event_id") * 8).alias("sectors_read"),
        F.col("user_id").alias("sectors_written"),
    )
    rates = counters.disk_rates(devices)
    kept = rates.select("node", "ts", "disk_read_kbps", "disk_write_kbps")
    return round_columns(kept, "disk_read_kbps", "disk_write_kbps")


_CPU_SQL = {
    "total": "event_id + user_id * 3",
    "idle": "CAST(value AS BIGINT) * 3",
    "iowait": "nullif(event_id % 5, 0)",
}


def _cpu_util(spark, folder):
    readings = events(spark, folder).select(
        F.col("event_type").alias("node"),
        "ts",
        "event_id",
        F.expr(_CPU_SQL["total"]).alias("total"),
        (F.floor("value") * 3).alias("idle"),
        F.expr(_CPU_SQL["iowait"]).alias("iowait"),
    )
    used = counters.cpu_utilisation(readings, iowait="iowait", tie=["event_id"])
    return round_columns(used.select("node", "event_id", "cpu_util_pct"), "cpu_util_pct")


def _series(spark, folder):
    series = nodestats.metric_series(_readings(spark, folder), every="1 hour")
    return round_columns(series, *METRICS)


_SAMPLER_SQL = (
    "CASE WHEN event_id % 9 = 0 THEN 'Average:' "
    "WHEN event_id % 10 = 0 THEN CAST(1700000000 + event_id AS {text}) "
    "ELSE ' ' || CAST(1700000000 + event_id AS {text}) || '  ' || "
    "CAST(CAST(value AS DECIMAL(12,2)) AS {text}) END"
)


def _sampler_lines(spark, folder):
    log = events(spark, folder).select(
        F.col("event_type").alias("path"), F.expr(_SAMPLER_SQL.format(text="STRING")).alias("value")
    )
    used = sampler_readings(log, ["cpu_util_pct"])
    return used.select(
        "path", F.unix_seconds("ts").alias("epoch"), "cpu_util_pct"
    )


QUERIES = {
    "node_summary": _node_summary,
    "node_summary_listed": _node_summary_listed,
    "node_metric_rows": _node_metric_rows,
    "cluster_rollup": _cluster_rollup,
    "node_report": _node_report,
    "overall_report": _overall_report,
    "summary_json": _summary_json,
    "summary_document": _summary_document,
    "counter_rate": _counter_rate,
    "counter_rate_hot": _counter_rate_hot,
    "disk_rates": _disk_rates,
    "cpu_util": _cpu_util,
    "series_buckets": _series,
    "sampler_lines": _sampler_lines,
}

_READINGS_SQL = (
    f"SELECT {{node}} AS node, ts, event_id, {', '.join(f'{s} AS {n}' for n, s in METRIC_SQL.items())} "
    "FROM events"
)
_AGGREGATES = ", ".join(f"avg({m}) AS {m}_avg, max({m}) AS {m}_peak" for m in METRICS)


def summary_sql(node="event_type"):
    return (
        f"SELECT node, {_AGGREGATES}, count(*) AS samples "
        f"FROM ({_READINGS_SQL.format(node=node)}) GROUP BY node"
    )


_ROUNDED = ", ".join(f"{r6(c)} AS {c}" for c in _FIGURES)


def node_summary_sql(node="event_type"):
    return f"SELECT node, {_ROUNDED}, samples FROM ({summary_sql(node)})"


_REPORT_SQL = ", ".join(
    f"printf('%.{places}f', {column}) AS \"{name}\"" for name, column, places in summaries.REPORT_COLUMNS
)
_ROLL_SQL = {
    m: (f"avg({m}_avg)", f"avg({m}_peak)", f"max({m}_peak)") for m in METRICS
}
_LAG = "lag({0}) OVER (PARTITION BY event_type ORDER BY ts, event_id)"
_SECONDS = f"greatest(1e-6, (epoch_us(ts) - {_LAG.format('epoch_us(ts)')}) / 1e6)"

ORACLE = {
    "node_summary": node_summary_sql(),
    "node_summary_listed": f"""
        WITH s AS ({summary_sql('user_id')})
        SELECT c_custkey AS node, {', '.join(f'coalesce({r6(c)}, 0.0) AS {c}' for c in _FIGURES)},
               coalesce(samples, 0) AS samples
        FROM customer LEFT JOIN s ON s.node = c_custkey""",
    "node_metric_rows": " UNION ALL ".join(
        f"SELECT node, '{m}' AS metric, {r6(f'{m}_avg')} AS avg, {r6(f'{m}_peak')} AS peak, samples "
        f"FROM ({summary_sql()})"
        for m in METRICS
    ),
    "cluster_rollup": " UNION ALL ".join(
        f"SELECT '{m}' AS metric, {', '.join(f'{r6(e)} AS {n}' for e, n in zip(_ROLL_SQL[m], _ROLLED))}, "
        f"count(*) AS num_nodes FROM ({summary_sql()})"
        for m in METRICS
    ),
    "node_report": (
        f"SELECT node, {_REPORT_SQL}, CAST(samples AS VARCHAR) AS samples FROM ({summary_sql()})"
    ),
    "overall_report": " UNION ALL ".join(
        f"SELECT {order} AS position, "
        + f"printf('{s}_avg{u.replace('%', '%%')}=%.{p}f {s}_peak_avg{u.replace('%', '%%')}=%.{p}f "
        f"{s}_max_peak{u.replace('%', '%%')}=%.{p}f', {', '.join(_ROLL_SQL[m])}) AS line "
        f"FROM ({summary_sql()})"
        for order, (m, s, u, p) in enumerate(summaries.OVERALL_LABELS)
    ),
    "summary_json": f"""
        SELECT node, {r6('cpu_util_pct_avg')} AS cpu_avg, {r6('cpu_util_pct_peak')} AS cpu_peak, samples
        FROM ({summary_sql('user_id')})""",
    "summary_document": f"""
        WITH s AS ({summary_sql()})
        SELECT node, {r6('mem_used_mb_avg')} AS mem_avg, samples,
               (SELECT {r6('avg(mem_used_mb_avg)')} FROM s) AS mem_avg_of_nodes,
               (SELECT count(*) FROM s) AS num_nodes
        FROM s""",
    "counter_rate": f"""
        SELECT event_type, event_id, {r6('dv / dt')} AS value_rate, {r6('du / dt')} AS user_rate
        FROM (SELECT event_type, event_id, value - {_LAG.format('value')} AS dv,
                     user_id - {_LAG.format('user_id')} AS du, {_SECONDS} AS dt,
                     {_LAG.format('event_id')} AS before
              FROM events)
        WHERE before IS NOT NULL""",
    "counter_rate_hot": f"""
        WITH e AS (SELECT event_type, event_id, value, CASE WHEN event_id % 3 = 0 THEN TIMESTAMP '2024-01-02 00:00:00'
                                                            ELSE ts END AS ts
                   FROM events WHERE event_id % 50 <> 1)
        SELECT event_type, event_id, {r6('dv / dt')} AS value_rate
        FROM (SELECT event_type, event_id, value - {_LAG.format('value')} AS dv, {_SECONDS} AS dt,
                     {_LAG.format('event_id')} AS before
              FROM e)
        WHERE before IS NOT NULL""",
    "disk_rates": f"""
        WITH t AS (SELECT event_type AS node, date_trunc('minute', ts)::TIMESTAMP AS ts,
                          sum(event_id * 8)::BIGINT AS rd, sum(user_id)::BIGINT AS wr
                   FROM events GROUP BY ALL),
             d AS (SELECT node, ts, rd - lag(rd) OVER w AS drd, wr - lag(wr) OVER w AS dwr,
                          greatest(1e-6, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6) AS dt
                   FROM t WINDOW w AS (PARTITION BY node ORDER BY ts))
        SELECT node, ts, {r6('drd * 512 / 1024.0::DOUBLE / dt')} AS disk_read_kbps,
               {r6('dwr * 512 / 1024.0::DOUBLE / dt')} AS disk_write_kbps
        FROM d WHERE drd IS NOT NULL""",
    "cpu_util": f"""
        WITH t AS (SELECT event_type, ts, event_id, {_CPU_SQL['total']} AS total,
                          CAST(floor(value) AS BIGINT) * 3 + coalesce({_CPU_SQL['iowait']}, 0) AS rest
                   FROM events),
             d AS (SELECT event_type AS node, event_id, total - {_LAG.format('total')} AS dt,
                          rest - {_LAG.format('rest')} AS di FROM t)
        SELECT node, event_id,
               CASE WHEN dt <= 0 THEN 0.0::DOUBLE
                    ELSE {r6('greatest(0.0, least(100.0, 100.0 * (1.0 - di::DOUBLE / dt)))')}
               END AS cpu_util_pct
        FROM d WHERE dt IS NOT NULL""",
    "series_buckets": f"""
        SELECT node, date_trunc('hour', ts)::TIMESTAMP AS step_start,
               {', '.join(f"{r6(f'avg({m})')} AS {m}" for m in METRICS)}, count(*) AS samples
        FROM ({_READINGS_SQL.format(node='event_type')}) GROUP BY ALL""",
    "sampler_lines": f"""
        WITH t AS (SELECT event_type AS path,
                          regexp_split_to_array(trim({_SAMPLER_SQL.format(text='VARCHAR')}), '\\s+') AS w
                   FROM events)
        SELECT path, CAST(w[1] AS BIGINT) AS epoch, CAST(w[2] AS DOUBLE) AS cpu_util_pct
        FROM t WHERE len(w) = 2""",
}
