"""Choosing, typing and cleaning columns; metric rows, devices and memory."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.functions import fields, readings
from millrace.operators.nodestats import METRICS, clean_readings
from millrace.registry.common import (
    KEYS_SQL,
    LINE_FEATURES,
    LINE_KEYS,
    events,
    line_features,
    lines,
    r6,
    round_columns,
    scratch_folder,
)
from millrace.sinks.execution import sample_rows
from millrace.sources.tables import csv_text, csv_typed, parquet_table


def _select_strict(spark, folder):
    return fields.pick_columns(lines(spark, folder), [" l_discount", "absent", "l_quantity "])


def _select_lenient(spark, folder):
    table = lines(spark, folder)
    found = fields.present_columns(table, ["absent", "l_tax"], on_missing="skip")
    return table.select(*LINE_KEYS, *found)


# Text as dirty files hold it, made from the line number and the price.
_DIRTY_SQL = """
    CASE l_linenumber
        WHEN 1 THEN NULL
        WHEN 2 THEN 'x' || l_suppkey
        WHEN 3 THEN 'NaN'
        WHEN 4 THEN '-' || CAST(CAST(l_extendedprice AS DECIMAL(12,2)) AS {text})
        WHEN 5 THEN '99999' || l_orderkey || '99999'
        WHEN 6 THEN CAST(CAST(l_quantity AS DECIMAL(12,2)) AS {text})
        ELSE '1e' || CAST(l_discount * 100 AS INT)
    END"""


def _dirty(spark, folder):
    text = F.expr(_DIRTY_SQL.format(text="STRING"))
    return lines(spark, folder).select(*LINE_KEYS, text.alias("dirty"))


def _cast_clean(spark, folder):
    dirty = F.col("dirty")
    return _dirty(spark, folder).select(
        *LINE_KEYS,
        fields.double_or_zero(dirty).alias("as_double"),
        fields.category_index(dirty).alias("as_index"),
        fields.clipped_category_index(dirty).alias("as_clipped"),
    )


def _clip_index(spark, folder):
    part = parquet_table(spark, folder, "part").select(
        "p_partkey", (F.col("p_size") - 5.5).alias("p_size")
    )
    return fields.clean_categories(part, ["p_size"], top=fields.TOP_CATEGORY)


def _assemble(spark, folder):
    table = line_features(spark, folder)
    packed = table.select(*LINE_KEYS, fields.feature_array(LINE_FEATURES).alias("f"))
    return packed.select(*LINE_KEYS, F.posexplode("f").alias("slot", "value"))


def _csv(reader):
    def query(spark, folder):
        path = scratch_folder(spark, folder, f"lines-{reader.__name__}")
        line_features(spark, folder).write.mode("overwrite").option("header", True).csv(path)
        table = fields.clean_features(reader(spark, path), LINE_FEATURES)
        return table.withColumns({n: F.col(n).cast("bigint") for n in LINE_KEYS})

    return query


def _csv_by_name(spark, folder):
    # Two folders with the columns in different order, read together.
    base = scratch_folder(spark, folder, "lines-two-orders")
    table = line_features(spark, folder)
    odd = F.col("l_orderkey") % 2 == 1
    paths = [f"{base}/a", f"{base}/b"]
    for path, part in zip(paths, (table.where(odd), table.where(~odd).select(*reversed(table.columns)))):
        part.write.mode("overwrite").option("header", True).csv(path)
    read = fields.clean_features(csv_text(spark, paths), LINE_FEATURES)
    return read.withColumns({n: F.col(n).cast("bigint") for n in LINE_KEYS})


def _csv_declared(spark, path):
    return csv_typed(
        spark,
        path,
        ", ".join([f"{n} bigint" for n in LINE_KEYS] + [f"{n} double" for n in LINE_FEATURES]),
    )


# Metric fields as text, with the gaps and junk the cleaning rule is about.
_METRIC_TEXT_SQL = {
    "cpu_util_pct": "CASE WHEN event_id % 11 = 0 THEN '' WHEN event_id % 13 = 0 THEN 'n/a' "
    "ELSE CAST(CAST(value AS DECIMAL(12,2)) AS {text}) END",
    "mem_used_mb": "CASE WHEN event_id % 7 = 0 THEN NULL ELSE CAST(user_id AS {text}) END",
    "disk_read_kbps": "CASE WHEN event_id % 17 = 0 THEN ' ' ELSE regexp_extract(props, '[0-9]+', 0) END",
    "disk_write_kbps": "CASE WHEN event_id % 19 = 0 THEN '1.5kB' WHEN event_id % 5 = 0 THEN '-3.25e1' "
    "ELSE '.5' END",
}


def _metric_text(spark, folder):
    return events(spark, folder).select(
        "event_id",
        *[F.expr(sql.format(text="STRING")).alias(n) for n, sql in _METRIC_TEXT_SQL.items()],
    )


def _metric_row_clean(spark, folder):
    return clean_readings(_metric_text(spark, folder))


_DEVICE_SQL = """
    CASE l_linenumber
        WHEN 1 THEN 'sd' || chr(CAST(97 + l_suppkey % 26 AS INT))
        WHEN 2 THEN 'sda' || l_suppkey
        WHEN 3 THEN 'nvme' || l_suppkey || 'n1'
        WHEN 4 THEN 'nvme' || l_suppkey || 'n1p1'
        WHEN 5 THEN 'loop' || l_suppkey
        WHEN 6 THEN 'xvd' || chr(CAST(97 + l_suppkey % 26 AS INT))
        ELSE 'dm-' || l_suppkey
    END"""


def _disk_filter(spark, folder):
    names = lines(spark, folder).select(F.expr(_DEVICE_SQL).alias("device"))
    return names.where(readings.is_whole_disk(F.col("device"))).distinct()


_MEMORY_SQL = {
    "total_kb": "CAST(floor(l_extendedprice * 100) AS BIGINT)",
    "available_kb": "CASE WHEN l_linenumber <= 3 THEN l_partkey * 1000 END",
    "free_kb": "CASE WHEN l_linenumber <> 4 THEN l_suppkey * 1000 END",
    "buffers_kb": "l_orderkey",
    "cached_kb": "CASE WHEN l_linenumber <> 5 THEN CAST(l_quantity * 50000 AS BIGINT) END",
}


def _memory_used(spark, folder):
    table = lines(spark, folder).select(
        *LINE_KEYS, *[F.expr(sql).alias(n) for n, sql in _MEMORY_SQL.items()]
    )
    used = readings.memory_used_mb(*[F.col(n) for n in _MEMORY_SQL])
    return round_columns(table.select(*LINE_KEYS, used.alias("mem_used_mb")), "mem_used_mb")


def _sample_rows(spark, folder):
    # How many rows come, and how many of them the table has.
    table = line_features(spark, folder)
    sample = sample_rows(table)
    sampled = sample.agg(F.count("*")).scalar()
    known = sample.join(table, table.columns, "left_semi").agg(F.count("*")).scalar()
    return spark.range(1).select(sampled.alias("sampled"), known.alias("in_table"))


QUERIES = {
    "select_strict": _select_strict,
    "select_lenient": _select_lenient,
    "cast_clean": _cast_clean,
    "clip_index": _clip_index,
    "assemble_features": _assemble,
    "csv_text_features": _csv(csv_text),
    "csv_typed_features": _csv(_csv_declared),
    "csv_inferred_features": _csv(csv_typed),
    "csv_two_orders": _csv_by_name,
    "metric_row_clean": _metric_row_clean,
    "disk_filter": _disk_filter,
    "memory_used": _memory_used,
    "sample_rows": _sample_rows,
}

_DIRTY_DUCK = _DIRTY_SQL.format(text="VARCHAR")
_TYPED_DUCK = (
    "CASE WHEN n IS NULL OR isnan(n) THEN 0.0::DOUBLE ELSE n END"
)
_CSV_DUCK = (
    "SELECT "
    + ", ".join(f"CAST({n} AS BIGINT) AS {n}" for n in LINE_KEYS)
    + f", {', '.join(LINE_FEATURES)} FROM lineitem"
)
_METRIC_DUCK = ", ".join(
    f"{sql.format(text='VARCHAR')} AS {n}" for n, sql in _METRIC_TEXT_SQL.items()
)

ORACLE = {
    "select_strict": "SELECT l_discount, l_quantity FROM lineitem",
    "select_lenient": f"SELECT {KEYS_SQL}, l_tax FROM lineitem",
    "cast_clean": f"""
        WITH t AS (SELECT {KEYS_SQL}, try_cast({_DIRTY_DUCK} AS DOUBLE) AS n FROM lineitem),
             f AS (SELECT {KEYS_SQL}, {_TYPED_DUCK} AS n FROM t)
        SELECT {KEYS_SQL}, n + 0.0 AS as_double,
               CASE WHEN abs(trunc(n)) <= 2147483647 THEN CAST(trunc(n) AS INTEGER) ELSE 0 END AS as_index,
               CAST(trunc(greatest(0.0, least(20.0, n))) AS INTEGER) AS as_clipped
        FROM f""",
    "clip_index": """
        SELECT p_partkey, CAST(trunc(greatest(0.0, least(20.0, p_size - 5.5))) AS INTEGER) AS p_size
        FROM part""",
    "assemble_features": " UNION ALL ".join(
        f"SELECT {KEYS_SQL}, {i} AS slot, {n} AS value FROM lineitem"
        for i, n in enumerate(LINE_FEATURES)
    ),
    "csv_text_features": _CSV_DUCK,
    "csv_typed_features": _CSV_DUCK,
    "csv_inferred_features": _CSV_DUCK,
    "csv_two_orders": _CSV_DUCK,
    "sample_rows": "SELECT least(5, count(*)) AS sampled, least(5, count(*)) AS in_table FROM lineitem",
    "metric_row_clean": f"""
        WITH t AS (SELECT event_id, {_METRIC_DUCK} FROM events),
             c AS (SELECT event_id, {', '.join(
                 f"CASE WHEN coalesce({n}, '') = '' THEN 0.0::DOUBLE WHEN trim({n}) = '' THEN NULL "
                 f"ELSE try_cast({n} AS DOUBLE) END AS {n}" for n in METRICS)} FROM t)
        SELECT * FROM c WHERE {' AND '.join(f'{n} IS NOT NULL' for n in METRICS)}""",
    "disk_filter": f"""
        WITH t AS (SELECT DISTINCT {_DEVICE_SQL} AS device FROM lineitem)
        SELECT device FROM t
        WHERE NOT (device LIKE 'loop%' OR device LIKE 'ram%')
          AND ((regexp_matches(device, '^(sd|vd|xvd)') AND regexp_matches(device, '[a-z]$'))
               OR (device LIKE 'nvme%' AND device NOT LIKE '%p%'))""",
    "memory_used": f"""
        WITH t AS (SELECT {KEYS_SQL}, {', '.join(f'{sql} AS {n}' for n, sql in _MEMORY_SQL.items())}
                   FROM lineitem)
        SELECT {KEYS_SQL}, {r6("""greatest(0, CASE WHEN available_kb IS NOT NULL THEN total_kb - available_kb
                   ELSE total_kb - coalesce(free_kb, 0) - coalesce(buffers_kb, 0) - coalesce(cached_kb, 0)
                   END) / 1024.0::DOUBLE""")} AS mem_used_mb
        FROM t""",
}
