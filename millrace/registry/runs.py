"""Run results, speed-up and comparison tables.

A line item stands for a measured run: its status names the framework, its
return flag the dataset, its line number the machines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions.readings import rows_per_second
from millrace.operators import comparisons
from millrace.registry.common import KEYS_SQL, LINE_KEYS, events, lines, r6, round_columns
from millrace.sinks.records import scaling_records
from millrace.sources.runlogs import RESULT_MARKER, first_marked_line, parse_result

_FRAMEWORKS = ("F", "O")


def _runs(spark, folder):
    return lines(spark, folder).select(
        F.col("l_linestatus").alias("framework"),
        F.col("l_returnflag").alias("dataset"),
        F.col("l_linenumber").alias("machines"),
        F.when(F.col("l_quantity") > 5, F.col("l_extendedprice") / 1000).alias("job_seconds"),
    )


_CONFIGURATION = ("framework", "dataset", "machines")


def _repeat_mean(spark, folder):
    return round_columns(
        comparisons.mean_of_runs(_runs(spark, folder), _CONFIGURATION), "job_seconds"
    )


def _speedup(spark, folder):
    means = comparisons.mean_of_runs(_runs(spark, folder), _CONFIGURATION)
    return round_columns(comparisons.speed_up(means), "job_seconds", "speedup")


def _speedup_of_runs(spark, folder):
    # Single runs against their series' one-machine mean: every row is kept.
    runs = lines(spark, folder).select(
        *LINE_KEYS,
        F.col("l_returnflag").alias("dataset"),
        F.col("l_extendedprice").alias("job_seconds"),
    )
    rated = comparisons.speed_up(runs, ["dataset"], machines="l_linenumber")
    return round_columns(rated, "speedup")


def _compare_pivot(spark, folder):
    figures = lines(spark, folder)
    return round_columns(
        comparisons.side_by_side(
            figures,
            ["l_returnflag", "l_linenumber"],
            "l_linestatus",
            _FRAMEWORKS,
            {"cpu_avg": "avg(l_quantity)", "cpu_peak": "max(l_quantity)",
             "seconds": "avg(l_extendedprice)"},
        ),
        *[f"{f}_{m}" for f in _FRAMEWORKS for m in ("cpu_avg", "cpu_peak", "seconds")],
    )


def _throughput(spark, folder):
    seconds = F.col("l_discount") - 0.03
    rate = rows_per_second(F.col("l_quantity"), seconds)
    return round_columns(
        lines(spark, folder).select(*LINE_KEYS, rate.alias("rows_per_second")), "rows_per_second"
    )


# Result payloads, by line number: good, cut off, with text after it, two objects,
# not an object, wrongly quoted, absent.
_PAYLOAD_SQL = """
    CASE l_linenumber
        WHEN 1 THEN '{{"run_id": "r' || l_orderkey || '", "rows": ' || l_partkey
                    || ', "timing": {{"job_seconds": ' || CAST(CAST(l_quantity AS DECIMAL(12,1)) AS {text}) || '}}}}'
        WHEN 2 THEN '{{"run_id": "r' || l_orderkey || '", "rows": '
        WHEN 3 THEN '{{"run_id": "r' || l_orderkey || '"}} rest'
        WHEN 4 THEN '{{"run_id": "r' || l_orderkey || '"}}, {{"rows": 1}}'
        WHEN 5 THEN '[' || l_orderkey || ']'
        WHEN 6 THEN '{{' || chr(39) || 'run_id' || chr(39) || ': ' || l_orderkey || '}}'
    END"""


_TAKEN = "struct<run_id: string, rows: bigint, timing: struct<job_seconds: double>>"


def _payloads(spark, folder):
    text = _PAYLOAD_SQL.format(text="STRING")
    return lines(spark, folder).select(
        *LINE_KEYS, parse_result(F.expr(text), _TAKEN).alias("result")
    )


def _result_payloads(spark, folder):
    return _payloads(spark, folder).select(
        *LINE_KEYS, "result.run_id", "result.rows", "result.timing.job_seconds"
    )


def _scaling_records(spark, folder):
    results = _payloads(spark, folder).select(
        F.concat(F.col("l_suppkey").cast("string"), F.lit(".csv")).alias("dataset_file"),
        (F.col("l_partkey") % 4 + 1).alias("machines"),
        F.when(F.col("result").isNull(), 1).otherwise(0).alias("rc"),
        "result",
    )
    return scaling_records(results)


# Log lines: some marked and indented, some marked further in, the rest plain.
_LINE_SQL = (
    "CASE WHEN event_id % 7 = 3 THEN '  {marker}' || props "
    "WHEN event_id % 7 = 5 THEN 'INFO {marker}' || props ELSE props END"
).replace("{marker}", RESULT_MARKER)


def _first_marked(spark, folder):
    log = events(spark, folder).select(
        F.concat_ws("/", "event_type", F.date_format("ts", "yyyy-MM-dd")).alias("path"),
        F.struct("ts", "event_id").alias("at"),
        F.expr(_LINE_SQL).alias("value"),
    )
    return first_marked_line(log)


QUERIES = {
    "repeat_mean": _repeat_mean,
    "speedup": _speedup,
    "speedup_of_runs": _speedup_of_runs,
    "compare_pivot": _compare_pivot,
    "throughput": _throughput,
    "result_payloads": _result_payloads,
    "scaling_records": _scaling_records,
    "result_lines": _first_marked,
}

_RUNS_SQL = """
    SELECT l_linestatus AS framework, l_returnflag AS dataset, l_linenumber AS machines,
           avg(l_extendedprice / 1000) AS job_seconds, count(*) AS runs
    FROM lineitem WHERE l_quantity > 5 GROUP BY ALL"""
_PIVOT_SQL = ", ".join(
    f"{r6(f'''{e} FILTER (l_linestatus = '{f}')''')} AS \"{f}_{n}\""
    for f in _FRAMEWORKS
    for n, e in (("cpu_avg", "avg(l_quantity)"), ("cpu_peak", "max(l_quantity)"),
                 ("seconds", "avg(l_extendedprice)"))
)

ORACLE = {
    "repeat_mean": f"SELECT framework, dataset, machines, {r6('job_seconds')} AS job_seconds, runs FROM ({_RUNS_SQL})",
    "speedup": f"""
        WITH m AS ({_RUNS_SQL})
        SELECT framework, dataset, machines, {r6('job_seconds')} AS job_seconds, runs,
               {r6('max(CASE WHEN machines = 1 THEN job_seconds END) OVER (PARTITION BY framework, dataset) / job_seconds')}
                   AS speedup
        FROM m""",
    "speedup_of_runs": f"""
        WITH b AS (SELECT l_returnflag, avg(l_extendedprice) AS one FROM lineitem
                   WHERE l_linenumber = 1 GROUP BY l_returnflag)
        SELECT {KEYS_SQL}, l_returnflag AS dataset, l_extendedprice AS job_seconds,
               {r6('one / l_extendedprice')} AS speedup
        FROM lineitem LEFT JOIN b USING (l_returnflag)""",
    "compare_pivot": f"SELECT l_returnflag, l_linenumber, {_PIVOT_SQL} FROM lineitem GROUP BY ALL",
    "throughput": f"""
        SELECT {KEYS_SQL}, CASE WHEN l_discount - 0.03::DOUBLE > 0
               THEN {r6('l_quantity / (l_discount - 0.03::DOUBLE)')} ELSE 0.0 END AS rows_per_second
        FROM lineitem""",
    "result_payloads": f"""
        SELECT {KEYS_SQL}, CASE WHEN l_linenumber = 1 THEN 'r' || l_orderkey END AS run_id,
               CASE WHEN l_linenumber = 1 THEN l_partkey END AS rows,
               CASE WHEN l_linenumber = 1 THEN l_quantity END AS job_seconds
        FROM lineitem""",
    "scaling_records": """
        SELECT l_suppkey || '.csv' AS dataset_file, CAST(l_partkey % 4 + 1 AS INTEGER) AS machines,
               CAST(l_partkey % 4 + 1 AS INTEGER) AS executor_instances, 4 AS executor_cores,
               CAST((l_partkey % 4 + 1) * 4 AS INTEGER) AS total_executor_cores,
               CASE WHEN l_linenumber = 1 THEN l_quantity END AS job_seconds,
               CASE WHEN l_linenumber = 1 THEN l_partkey END AS rows,
               CASE WHEN l_linenumber = 1 THEN 'r' || l_orderkey END AS run_id,
               CASE WHEN l_linenumber = 1 THEN 0 ELSE 1 END AS rc
        FROM lineitem""",
    "result_lines": """
        SELECT event_type || '/' || strftime(ts, '%Y-%m-%d') AS path,
               arg_min(props, (ts, event_id)) AS payload
        FROM events WHERE event_id % 7 = 3 GROUP BY ALL""",
}
