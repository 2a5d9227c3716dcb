"""Rates from running counters.

A rate needs the reading before. One node may hold a large share of all readings, so a window
over whole nodes could end in one task. Readings are therefore cut into ranges of one order,
by node and time, wherever that falls: places drawn from all readings by a hash say where a
range ends. Each range is windowed on its own; its readings after the last place drawn in it,
the last one among them, also stand at the head of the next range, which adds a few per cent.
The result is the same as over whole nodes, in one shuffle.

Where ties are told apart an instant is cut as well. Readings without a time have no place in
the order and are left out. Nothing is run while the plan is built.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges per shuffle partition, so that partitions come out even, and places drawn per range.
RANGES_PER_PARTITION = 16
DRAWN_PER_RANGE = 32

# Disk counters count 512-byte sectors; rates are in KB of 1024.
SECTOR_BYTES = 512
KB = 1024.0
SHORTEST_STEP = 1e-6


def _clock(column: Column, data_type: str) -> tuple[Column, float]:
    """A time as a number, and how many of its units make a second.

    Timestamps count whole microseconds, so differences are exact; a number is
    taken as seconds.
    """
    if data_type == "timestamp":
        return F.unix_micros(column), 1e6
    if data_type == "timestamp_ntz":
        # Not through a zoned timestamp: a clock change would bend the rates.
        start = F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00"))
        return F.timestamp_diff("MICROSECOND", start, column), 1e6
    return column.cast("double"), 1.0


def _range_ends(places: DataFrame, ranges: int) -> Column:
    """Where ranges end, as one value: an array of ``(cut, before)`` in order, fewer than ``ranges``.

    ``cut`` is the first place of the next range, ``before`` a place of the range itself with
    few others between. Places are drawn by a hash, about ``DRAWN_PER_RANGE`` per range; equal
    ones count once.
    """
    names = places.columns
    count = places.agg(F.count(F.lit(1)).cast("double")).scalar()
    share = F.lit(float(ranges * DRAWN_PER_RANGE)) / F.greatest(F.lit(1.0), count)
    drawn = places.where(F.pmod(F.xxhash64(*names), F.lit(1 << 32)) < share * F.lit(float(1 << 32)))
    ordered = drawn.agg(F.array_sort(F.collect_set(F.struct(*names))).alias("p"))
    at = F.transform(F.sequence(F.lit(1), F.lit(max(1, ranges - 1))), lambda i: F.floor(i * F.size("p") / F.lit(ranges)))
    inner = F.array_distinct(F.filter(at, lambda k: k >= 1))
    return ordered.select(
        F.transform(inner, lambda k: F.struct(F.get("p", k.cast("int")).alias("cut"), F.get("p", (k - 1).cast("int")).alias("before")))
    ).scalar()


def _ranged(df: DataFrame, ends: Column, ranges: int) -> DataFrame:
    """``df`` with ``__range``, the number of the range of ``__place``, and ``__late``, by binary search.

    Late places, the last of their range among them, are not before ``before``. A column per step,
    as one expression would repeat all steps before it.
    """
    df = df.withColumns({"__ends": ends, "__range": F.lit(0)})
    for power in reversed(range(max(1, ranges).bit_length())):
        further = F.col("__range") + F.lit(1 << power)
        beyond = F.coalesce(F.get("__ends", further - 1)["cut"] <= F.col("__place"), F.lit(False))
        df = df.withColumn("__range", F.when(beyond, further).otherwise(F.col("__range")))
    before = F.get("__ends", F.col("__range"))["before"]
    return df.withColumn("__late", F.coalesce(F.col("__place") >= before, F.lit(False))).drop("__ends")


def with_previous(
    df: DataFrame,
    values: Sequence[str],
    node: str = "node",
    ts: str = "ts",
    tie: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """Append ``previous``: a struct of ``ts`` and ``values`` of the node's reading before.

    ``ts`` is a timestamp or a number of seconds. ``tie`` orders readings with the same time,
    then ``values`` do. A node's first reading has a null ``previous``. ``ranges`` is how many
    ranges the readings are cut into, by default some per shuffle partition.
    """
    if ranges is None:
        ranges = RANGES_PER_PARTITION * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    df = df.where(F.col(ts).isNotNull())
    time, _ = _clock(F.col(ts), dict(df.dtypes)[ts])
    kept = [F.col(f"`{name}`") for name in df.columns]
    place = [c.alias(f"__{i}") for i, c in enumerate((F.col(node), time, *map(F.col, tie)))]
    ranged = _ranged(df.select(*kept, F.struct(*place).alias("__place")), _range_ends(df.select(*place), ranges), ranges)
    # late readings also stand at the head of the next range
    own, head = (F.struct((F.col("__range") + n).alias("range"), F.lit(n)) for n in (0, 1))
    dealt = ranged.withColumn("__in", F.explode(F.when(F.col("__late"), F.array(own, head)).otherwise(F.array(own))))
    order = Window.partitionBy("__in.range").orderBy("__place", *values)
    before = F.lag(F.struct(F.col(node).alias("node"), F.struct(ts, *values).alias("reading"))).over(order)
    return (
        dealt.withColumn("__before", before)
        .where(F.col("__in.range") == F.col("__range"))
        .select(*kept, F.when(F.col("__before.node").eqNullSafe(F.col(node)), F.col("__before.reading")).alias("previous"))
    )


def _step(ts: str, data_type: str) -> Column:
    now, per_second = _clock(F.col(ts), data_type)
    before, _ = _clock(F.col(f"previous.{ts}"), data_type)
    return F.greatest(F.lit(SHORTEST_STEP), (now - before) / F.lit(per_second))


def counter_rates(
    readings: DataFrame,
    counters: dict[str, str],
    node: str = "node",
    ts: str = "ts",
    tie: Sequence[str] = (),
    unit: float = 1.0,
    ranges: int | None = None,
) -> DataFrame:
    """Change per second of each counter ``{output: counter}``, in ``unit``s.

    A counter that was reset gives a negative rate. A node's first reading gives
    no row.
    """
    data_type = dict(readings.dtypes)[ts]
    names = list(dict.fromkeys(counters.values()))
    paired = with_previous(readings, names, node, ts, tie, ranges).where(F.col("previous").isNotNull())
    return paired.withColumns(
        {
            output: (F.col(name) - F.col(f"previous.{name}")) / F.lit(unit) / _step(ts, data_type)
            for output, name in counters.items()
        }
    ).drop("previous")


def disk_rates(
    device_readings: DataFrame,
    node: str = "node",
    ts: str = "ts",
    ranges: int | None = None,
) -> DataFrame:
    """KB/s read and written per node, from sector counters per device.

    Expects ``(node, ts, device, sectors_read, sectors_written)``, already limited
    to the devices to count.
    """
    totals = device_readings.groupBy(node, ts).agg(
        F.sum("sectors_read").alias("sectors_read"),
        F.sum("sectors_written").alias("sectors_written"),
    )
    return counter_rates(
        totals,
        {"disk_read_kbps": "sectors_read", "disk_write_kbps": "sectors_written"},
        node,
        ts,
        unit=KB / SECTOR_BYTES,
        ranges=ranges,
    )


def busy_percent(total_delta: Column, idle_delta: Column) -> Column:
    """100 * (1 - idle/total), within 0..100; 0 when the total did not grow."""
    share = F.lit(100.0) * (F.lit(1.0) - idle_delta / F.when(total_delta > 0, total_delta))
    return F.when(total_delta > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), share))).when(
        total_delta.isNotNull(), F.lit(0.0)
    )


def cpu_utilisation(
    readings: DataFrame,
    total: str = "total",
    idle: str = "idle",
    iowait: str | None = None,
    node: str = "node",
    ts: str = "ts",
    tie: Sequence[str] = (),
    ranges: int | None = None,
) -> DataFrame:
    """``cpu_util_pct`` from running CPU time counters; waiting for I/O counts as idle.

    A node's first reading gives no row, since nothing comes before it.
    """
    rest = F.col(idle)
    if iowait is not None:
        rest = rest + F.coalesce(F.col(iowait), F.lit(0))
    staged = readings.withColumn("__rest", rest)
    paired = with_previous(staged, [total, "__rest"], node, ts, tie, ranges).where(F.col("previous").isNotNull())
    return paired.withColumn(
        "cpu_util_pct",
        busy_percent(
            F.col(total) - F.col(f"previous.{total}"), F.col("__rest") - F.col("previous.__rest")
        ),
    ).drop("previous", "__rest")
