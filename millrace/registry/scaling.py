"""Scaling queries."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.operators import scaling as ops
from millrace.operators.layout import held, repartitioned
from millrace.functions.fields import clean_features
from millrace.registry.common import (
    KEYS_SQL,
    LINE_FEATURES,
    LINE_KEYS,
    line_features,
    r6,
    round_columns,
    scratch_folder,
)
from millrace.sinks.execution import materialise
from millrace.sources.tables import parquet_table


def _column_stats(spark, folder):
    stats = ops.moments_by_column(line_features(spark, folder), LINE_FEATURES)
    return round_columns(stats, "mean", "std")


def _zscore(spark, folder):
    return round_columns(ops.zscore_columns(line_features(spark, folder), LINE_FEATURES), *LINE_FEATURES)


def _zscore_nulls(spark, folder):
    table = line_features(spark, folder).withColumn(
        "l_discount", F.nullif(F.col("l_discount"), F.lit(0.05))
    )
    return round_columns(ops.zscore_columns(table, LINE_FEATURES), *LINE_FEATURES)


def _scale(with_mean, with_std):
    def query(spark, folder):
        scaled = ops.scale_columns(line_features(spark, folder), LINE_FEATURES, with_mean, with_std)
        return round_columns(scaled, *LINE_FEATURES)

    return query


def _scale_fitted(spark, folder):
    table = line_features(spark, folder)
    model = ops.fit_scaler(table, LINE_FEATURES)
    return round_columns(model.transform(table, with_mean=True, with_std=True), *LINE_FEATURES)


def _scale_merged(spark, folder):
    # The states of three parts, kept as a table and merged.
    path = scratch_folder(spark, folder, "scaler-states")
    table = line_features(spark, folder)
    for part in range(3):
        own = ops.scaler_state(table.where(F.col("l_orderkey") % 3 == part), LINE_FEATURES)
        own.write.mode("overwrite" if part == 0 else "append").parquet(path)
    model = ops.scaler_of_state(ops.merge_states(spark.read.parquet(path)), LINE_FEATURES)
    return round_columns(model.transform(table, with_mean=True, with_std=True), *LINE_FEATURES)


def _scale_mllib(spark, folder):
    table = line_features(spark, folder)
    scaled = ops.mllib_scaler(LINE_FEATURES, with_mean=True).fit(table).transform(table)
    slots = scaled.select(*LINE_KEYS, vector_to_array("scaledFeatures").alias("s"))
    unpacked = slots.select(*LINE_KEYS, *[F.get("s", i).alias(n) for i, n in enumerate(LINE_FEATURES)])
    return round_columns(unpacked, *LINE_FEATURES)


def _scale_constant(spark, folder):
    table = line_features(spark, folder).select(
        *LINE_KEYS, "l_quantity", (F.col("l_quantity") * 0 + 5).alias("five")
    )
    return round_columns(ops.scale_columns(table, ["l_quantity", "five"], True, True), "l_quantity", "five")


def _scaled_check(spark, folder):
    scaled = ops.zscore_columns(line_features(spark, folder), LINE_FEATURES)
    return round_columns(ops.scaled_check(scaled, LINE_FEATURES), "mean", "std")


def _null_fill_scale(spark, folder):
    table = line_features(spark, folder).select(
        *LINE_KEYS, F.nullif(F.col("l_discount"), F.lit(0.05)).alias("l_discount")
    )
    filled = clean_features(table, ["l_discount"])
    return round_columns(ops.scale_columns(filled, ["l_discount"]), "l_discount")


def _vector_stats(spark, folder):
    table = parquet_table(spark, folder, "embeddings")
    return round_columns(ops.slot_moments(table, "embedding"), "mean", "std")


def _vector_scale(spark, folder):
    return _scaled_slots(parquet_table(spark, folder, "embeddings").select("vec_id", "embedding"))


def _vector_scale_ragged(spark, folder):
    # Arrays of 60 to 64 slots, every third with one slot more than the others have.
    table = parquet_table(spark, folder, "embeddings")
    cut = F.slice("embedding", 1, (60 + F.col("vec_id") % 5).cast("int"))
    more = F.concat("embedding", F.array((F.col("vec_id") % 7).cast("float")))
    return _scaled_slots(table.select("vec_id", F.when(F.col("vec_id") % 3 == 0, more).otherwise(cut).alias("embedding")))


def _scaled_slots(table):
    scaled = ops.scale_array(table, "embedding", with_mean=True)
    # The outer form: the inner one adds a filter that scales every vector again.
    slots = scaled.select("vec_id", F.posexplode_outer("embedding").alias("slot", "value"))
    return round_columns(slots, "value")


def _repartitioned_scale(spark, folder):
    # Fitted on the table as it lies: only the rows to scale are shuffled.
    table = line_features(spark, folder)
    scaled = ops.scale_columns(repartitioned(table, 16), LINE_FEATURES, True, True, fitted_on=table)
    return round_columns(scaled, *LINE_FEATURES)


_stored: list = []  # by the last call of the query below, whose result is read after it returns


def _cached_scale(spark, folder):
    # The fit fills the store, the transform reads it; what an earlier call stored is released.
    while _stored:
        _stored.pop().unpersist()
    stored = held(line_features(spark, folder), warm=False)
    _stored.append(stored)
    model = ops.fit_scaler(stored, LINE_FEATURES)
    return round_columns(model.transform(stored, True, True), *LINE_FEATURES)


def _zscore_constant(spark, folder):
    # A constant column, with nulls: nothing over nothing is NaN, null stays null.
    five = F.when(F.col("l_linenumber") != 3, F.lit(5.0))
    table = line_features(spark, folder).select(*LINE_KEYS, five.alias("five"))
    return ops.zscore_columns(table, ["five"])


def _materialised_rows(spark, folder):
    run = materialise(ops.zscore_columns(line_features(spark, folder), LINE_FEATURES))
    return spark.createDataFrame([(run.rows,)], "rows bigint")



def _scaled_sql(with_mean, with_std, source="lineitem"):
    columns = []
    for name in LINE_FEATURES:
        top = f"{name} - s.mean_{name}" if with_mean else name
        value = f"CASE WHEN s.std_{name} = 0 THEN 0 ELSE ({top}) / s.std_{name} END" if with_std else top
        columns.append(f"{r6(value)} AS {name}")
    stats = ", ".join(
        f"avg({n}) AS mean_{n}, stddev_samp({n}) AS std_{n}" for n in LINE_FEATURES
    )
    return f"WITH s AS (SELECT {stats} FROM {source}) SELECT {KEYS_SQL}, {', '.join(columns)} FROM {source}, s"


_NULLED = (
    "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, "
    "nullif(l_discount, 0.05) AS l_discount FROM lineitem)"
)
_STATS_SQL = " UNION ALL ".join(
    f"SELECT '{n}' AS \"column\", {r6(f'avg({n})')} AS mean, {r6(f'stddev_samp({n})')} AS std, "
    f"count({n}) AS rows FROM {{source}}"
    for n in LINE_FEATURES
)
_BOTH = _scaled_sql(True, True)

QUERIES = {
    "column_stats": _column_stats,
    "zscore_scale": _zscore,
    "zscore_scale_nulls": _zscore_nulls,
    "scale_std_only": _scale(False, True),
    "scale_mean_only": _scale(True, False),
    "scale_both": _scale(True, True),
    "scale_none": _scale(False, False),
    "scale_fitted": _scale_fitted,
    "scale_merged": _scale_merged,
    "scale_mllib": _scale_mllib,
    "scale_constant_column": _scale_constant,
    "scaled_check": _scaled_check,
    "null_fill_scale": _null_fill_scale,
    "vector_stats": _vector_stats,
    "vector_scale": _vector_scale,
    "vector_scale_ragged": _vector_scale_ragged,
    "zscore_constant_column": _zscore_constant,
    "repartitioned_scale": _repartitioned_scale,
    "cached_scale": _cached_scale,
    "materialised_rows": _materialised_rows,
}

ORACLE = {
    "column_stats": _STATS_SQL.format(source="lineitem"),
    "zscore_scale": _BOTH,
    "zscore_scale_nulls": _scaled_sql(True, True, _NULLED),
    "scale_std_only": _scaled_sql(False, True),
    "scale_mean_only": _scaled_sql(True, False),
    "scale_both": _BOTH,
    "scale_none": _scaled_sql(False, False),
    "scale_fitted": _BOTH,
    "scale_merged": _BOTH,
    "scale_mllib": _BOTH,
    "scale_constant_column": f"""
        WITH t AS (SELECT *, l_quantity * 0 + 5 AS five FROM lineitem),
             s AS (SELECT avg(l_quantity) AS mq, stddev_samp(l_quantity) AS sq, avg(five) AS mf,
                          stddev_samp(five) AS sf FROM t)
        SELECT {KEYS_SQL}, {r6('(l_quantity - mq) / sq')} AS l_quantity,
               CASE WHEN sf = 0 THEN 0.0::DOUBLE ELSE {r6('(five - mf) / sf')} END AS five
        FROM t, s""",
    "scaled_check": f"""
        WITH s AS (SELECT {', '.join(f'avg({n}) AS m_{n}, stddev_samp({n}) AS d_{n}' for n in LINE_FEATURES)}
                   FROM lineitem),
             z AS (SELECT {', '.join(f'({n} - m_{n}) / d_{n} AS {n}' for n in LINE_FEATURES)}
                   FROM lineitem, s)
        {_STATS_SQL.format(source='z')}""",
    "null_fill_scale": f"""
        WITH t AS (SELECT {KEYS_SQL}, coalesce(nullif(l_discount, 0.05), 0.0) AS d FROM lineitem),
             s AS (SELECT stddev_samp(d) AS sd FROM t)
        SELECT {KEYS_SQL}, {r6('d / sd')} AS l_discount FROM t, s""",
    "vector_stats": f"""
        WITH v AS (SELECT unnest(embedding)::DOUBLE AS value,
                          generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings)
        SELECT slot::INTEGER AS slot, {r6('avg(value)')} AS mean, {r6('stddev_samp(value)')} AS std,
               count(*) AS rows
        FROM v GROUP BY slot""",
    "vector_scale": f"""
        WITH v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value,
                          generate_subscripts(embedding, 1) - 1 AS slot FROM embeddings),
             s AS (SELECT slot, avg(value) AS m, stddev_samp(value) AS d FROM v GROUP BY slot)
        SELECT vec_id, slot::INTEGER AS slot, {r6('(value - m) / d')} AS value
        FROM v JOIN s USING (slot)""",
    "vector_scale_ragged": f"""
        WITH e AS (SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN list_append(embedding, (vec_id % 7)::FLOAT)
                                       ELSE embedding[1:60 + vec_id % 5] END AS embedding FROM embeddings),
             v AS (SELECT vec_id, unnest(embedding)::DOUBLE AS value,
                          generate_subscripts(embedding, 1) - 1 AS slot FROM e),
             s AS (SELECT slot, avg(value) AS m, stddev_samp(value) AS d FROM v GROUP BY slot)
        SELECT vec_id, slot::INTEGER AS slot, {r6('(value - m) / d')} AS value
        FROM v JOIN s USING (slot)""",
    "zscore_constant_column": f"""
        SELECT {KEYS_SQL}, CASE WHEN l_linenumber <> 3 THEN 'NaN'::DOUBLE END AS five FROM lineitem""",
    "repartitioned_scale": _BOTH,
    "cached_scale": _BOTH,
    "materialised_rows": "SELECT count(*) AS rows FROM lineitem",
}
