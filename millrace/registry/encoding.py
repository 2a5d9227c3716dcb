"""One-hot encoding, binning and subsets."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace.functions.fields import TOP_CATEGORY
from millrace.operators import encoding as ops
from millrace.operators.binning import fit_bins, merge_sketches, sketch_columns
from millrace.operators.subsets import subset_fraction, subset_of_rows, subset_of_weight
from millrace.registry.common import KEYS_SQL, LINE_FEATURES, LINE_KEYS, line_features, lines, scratch_folder
from millrace.sources.tables import parquet_table

# Line numbers are 1..7: index 0 is unused, so a fitted encoding has 8 slots.
_LINE_SLOTS = 8
_UNSEEN_ABOVE = 5
_BINS = 10
_SUBSET = 0.25


def _line_numbers(spark, folder):
    return lines(spark, folder).select(*LINE_KEYS)


def _onehot(drop_last):
    def query(spark, folder):
        table = _line_numbers(spark, folder)
        return ops.fit_one_hot(table, ["l_linenumber"], drop_last).slots(table)

    return query


def _onehot_keep(spark, folder):
    table = _line_numbers(spark, folder)
    seen = table.where(F.col("l_linenumber") <= _UNSEEN_ABOVE)
    return ops.fit_one_hot(seen, ["l_linenumber"], handle_invalid="keep").slots(table)


def _onehot_sparse(spark, folder):
    table = _line_numbers(spark, folder)
    encoded = ops.fit_one_hot(table, ["l_linenumber"], drop_last=True).sparse(table)
    vec = F.col("l_linenumber_vec")
    return encoded.select(
        *LINE_KEYS,
        vec["size"].alias("size"),
        F.get(vec["indices"], 0).alias("slot"),
        F.get(vec["values"], 0).alias("value"),
    )


def _onehot_mllib(spark, folder):
    table = _line_numbers(spark, folder)
    model = ops.mllib_one_hot(["l_linenumber"], drop_last=False).fit(table)
    encoded = model.transform(table)
    dense = encoded.select(*LINE_KEYS, vector_to_array("l_linenumber_vec").alias("v"))
    return dense.select(
        *LINE_KEYS, *[F.get("v", i).alias(f"l_linenumber_is_{i}") for i in range(model.stages[0].categorySizes[0])]
    )


def _part_sizes(spark, folder):
    return parquet_table(spark, folder, "part").select("p_partkey", "p_size")


def _fixed_slots(encoded):
    return encoded.select(
        "p_partkey",
        *[F.get("p_size_vec", i).alias(f"p_size_is_{i}") for i in range(TOP_CATEGORY + 1)],
    )


def _onehot_fixed(spark, folder):
    return _fixed_slots(ops.encode_fixed_width(_part_sizes(spark, folder), ["p_size", "absent"]))


def _batch_onehot(spark, folder):
    return _fixed_slots(ops.encode_batches(_part_sizes(spark, folder), ["p_size", "absent"]))


def _quantile_splits(spark, folder):
    model = fit_bins(line_features(spark, folder), LINE_FEATURES, _BINS)
    found = [
        (name, split) for name, splits in zip(model.columns, model.splits) for split in splits
    ]
    return spark.createDataFrame(found, "column string, split double")


def _quantile_splits_stored(spark, folder):
    # Sketches of three parts, kept as a table; the exact passes start from their brackets.
    path = scratch_folder(spark, folder, "sketches")
    table = line_features(spark, folder)
    for part in range(3):
        own = sketch_columns(table.where(F.col("l_orderkey") % 3 == part), LINE_FEATURES)
        own.write.mode("overwrite" if part == 0 else "append").parquet(path)
    model = fit_bins(table, LINE_FEATURES, _BINS, sketches=merge_sketches(spark.read.parquet(path)))
    found = [(name, split) for name, splits in zip(model.columns, model.splits) for split in splits]
    return spark.createDataFrame(found, "column string, split double")


def _subset_of_rows(spark, folder):
    return subset_of_rows(line_features(spark, folder), ["l_orderkey", "l_linenumber"], _SUBSET_ROWS)


def _subset_of_weight(spark, folder):
    return subset_of_weight(line_features(spark, folder), ["l_orderkey", "l_linenumber"], _SUBSET_WEIGHT, F.col("l_quantity"))


def _quantile_bins(spark, folder):
    table = line_features(spark, folder)
    binned = fit_bins(table, LINE_FEATURES, _BINS).transform(table)
    return binned.select(*LINE_KEYS, *[n + "_bin" for n in LINE_FEATURES])


def _bin_then_onehot(spark, folder):
    table = line_features(spark, folder).select(*LINE_KEYS, "l_extendedprice")
    binned = fit_bins(table, ["l_extendedprice"], _BINS).transform(table)
    bins = binned.select(*LINE_KEYS, F.col("l_extendedprice_bin").alias("bin"))
    return ops.fit_one_hot(bins, ["bin"]).slots(bins).drop("bin")


def _subset_hash(spark, folder):
    return subset_fraction(line_features(spark, folder), LINE_KEYS, _SUBSET, portable=True)


def _subset_nested(spark, folder):
    # A quarter of the table out of its half: the quarter of the table.
    half = subset_fraction(line_features(spark, folder), LINE_KEYS, 0.5, portable=True)
    return subset_fraction(half, LINE_KEYS, _SUBSET, portable=True)


QUERIES = {
    "onehot_fitted": _onehot(False),
    "onehot_drop_last": _onehot(True),
    "onehot_keep_unseen": _onehot_keep,
    "onehot_sparse": _onehot_sparse,
    "onehot_mllib": _onehot_mllib,
    "onehot_fixed": _onehot_fixed,
    "batch_onehot": _batch_onehot,
    "quantile_splits": _quantile_splits,
    "quantile_splits_stored": _quantile_splits_stored,
    "quantile_bins": _quantile_bins,
    "bin_then_onehot": _bin_then_onehot,
    "subset_of_rows": _subset_of_rows,
    "subset_of_weight": _subset_of_weight,
    "subset_hash": _subset_hash,
    "subset_nested": _subset_nested,
}


def _slots_sql(width, index="l_linenumber", prefix="l_linenumber_is_"):
    return ", ".join(f"CAST({index} = {i} AS INTEGER)::DOUBLE AS {prefix}{i}" for i in range(width))


_LINE_SLOTS_SQL = f"SELECT {KEYS_SQL}, {_slots_sql(_LINE_SLOTS)} FROM lineitem"
_FIXED_SQL = (
    f"SELECT p_partkey, {_slots_sql(TOP_CATEGORY + 1, f'greatest(0, least({TOP_CATEGORY}, p_size))', 'p_size_is_')} "
    "FROM part"
)


def _splits_sql(name):
    return f"""
        SELECT DISTINCT '{name}' AS "column", v AS split
        FROM (SELECT {name} AS v, row_number() OVER (ORDER BY {name}) AS rn, count(*) OVER () AS n
              FROM lineitem) AS ranked, range(1, {_BINS}) AS r(i)
        WHERE rn = greatest(1, (i * n + {_BINS - 1}) // {_BINS})"""


_SUBSET_ROWS = 2500
_SUBSET_WEIGHT = 60_000
_POSITION_SQL = "CAST('0x' || substr(md5(l_orderkey || '|' || l_linenumber), 1, 15) AS BIGINT)"
_SPLITS_SQL = " UNION ALL ".join(_splits_sql(n) for n in LINE_FEATURES)


def _bin_sql(name):
    inner = f"(SELECT list(split) FROM s WHERE \"column\" = '{name}')"
    return f"CAST(1 + len(list_filter({inner}, lambda x: x <= {name})) AS INTEGER)"


ORACLE = {
    "onehot_fitted": _LINE_SLOTS_SQL,
    "onehot_drop_last": f"SELECT {KEYS_SQL}, {_slots_sql(_LINE_SLOTS - 1)} FROM lineitem",
    "onehot_keep_unseen": f"""
        SELECT {KEYS_SQL}, {_slots_sql(
            _UNSEEN_ABOVE + 2,
            f'CASE WHEN l_linenumber <= {_UNSEEN_ABOVE} THEN l_linenumber ELSE {_UNSEEN_ABOVE + 1} END',
        )} FROM lineitem""",
    "onehot_sparse": f"""
        SELECT {KEYS_SQL}, {_LINE_SLOTS - 1} AS size,
               CASE WHEN l_linenumber < {_LINE_SLOTS - 1} THEN l_linenumber END AS slot,
               CASE WHEN l_linenumber < {_LINE_SLOTS - 1} THEN 1.0::DOUBLE END AS value
        FROM lineitem""",
    "onehot_mllib": _LINE_SLOTS_SQL,
    "onehot_fixed": _FIXED_SQL,
    "batch_onehot": _FIXED_SQL,
    "quantile_splits": _SPLITS_SQL,
    "quantile_splits_stored": _SPLITS_SQL,
    "subset_of_rows": f"""
        SELECT {KEYS_SQL}, {', '.join(LINE_FEATURES)}
        FROM (SELECT *, row_number() OVER (ORDER BY {_POSITION_SQL}) AS n FROM lineitem) WHERE n <= {_SUBSET_ROWS}""",
    "subset_of_weight": f"""
        SELECT {KEYS_SQL}, {', '.join(LINE_FEATURES)}
        FROM (SELECT *, sum(CAST(floor(l_quantity) AS BIGINT)) OVER (ORDER BY {_POSITION_SQL}) AS w FROM lineitem)
        WHERE w <= {_SUBSET_WEIGHT}""",
    "quantile_bins": f"""
        WITH s AS ({_SPLITS_SQL})
        SELECT {KEYS_SQL}, {', '.join(f'{_bin_sql(n)} AS {n}_bin' for n in LINE_FEATURES)}
        FROM lineitem""",
    "bin_then_onehot": f"""
        WITH s AS ({_splits_sql('l_extendedprice')}),
             b AS (SELECT {KEYS_SQL}, {_bin_sql('l_extendedprice')} AS bin FROM lineitem)
        SELECT {KEYS_SQL}, {_slots_sql(_BINS + 1, 'bin', 'bin_is_')} FROM b""",
    "subset_hash": f"""
        SELECT {KEYS_SQL}, {', '.join(LINE_FEATURES)} FROM lineitem
        WHERE CAST('0x' || md5(concat_ws('|', {KEYS_SQL}))[1:15] AS BIGINT)
              < {int(_SUBSET * (1 << 60))}""",
}
ORACLE["subset_nested"] = ORACLE["subset_hash"]
