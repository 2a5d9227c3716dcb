"""Expressions over machine readings and report numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a number in a metrics file, and which block
# devices are whole disks.
NUMBER_PATTERN = r"^\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:inf|infinity|nan))\s*$"
PSEUDO_DISK_PATTERN = r"^(loop|ram)"
LETTERED_DISK_PATTERN = r"^(sd|vd|xvd)(.*[A-Za-z])?$"
NVME_DISK_PATTERN = r"^nvme[^p]*$"

_FRACTION_BITS = 53


def reading_or_zero(column: Column) -> Column:
    """A metric field: absent or empty counts as 0.0, anything unreadable is null."""
    return F.when(column.isNull() | (column == ""), F.lit(0.0)).when(
        column.rlike(NUMBER_PATTERN), column.try_cast("double")
    )


def is_whole_disk(name: Column) -> Column:
    """True for a disk, false for loop and RAM devices, partitions and anything else."""
    return (~name.rlike(PSEUDO_DISK_PATTERN)) & (
        name.rlike(LETTERED_DISK_PATTERN) | name.rlike(NVME_DISK_PATTERN)
    )


def memory_used_mb(
    total_kb: Column, available_kb: Column, free_kb: Column, buffers_kb: Column, cached_kb: Column
) -> Column:
    """Used memory in MB, never negative; without ``available`` the older formula applies."""
    zero = F.lit(0)
    older = (
        total_kb
        - F.coalesce(free_kb, zero)
        - F.coalesce(buffers_kb, zero)
        - F.coalesce(cached_kb, zero)
    )
    used = F.coalesce(total_kb - available_kb, older)
    # greatest() would turn a null total into 0, so guard it.
    return F.when(total_kb.isNotNull(), F.greatest(zero, used) / F.lit(1024.0))


def rows_per_second(rows: Column, seconds: Column) -> Column:
    """Throughput; 0 when no time has passed."""
    return F.when(seconds > 0, rows / seconds).otherwise(F.lit(0.0))


def ratio_or(numerator: Column, denominator: Column, fallback: Column) -> Column:
    """``numerator / denominator`` where the denominator is above zero."""
    return F.when(denominator > 0, numerator / denominator).otherwise(fallback)


def fixed_decimals(name: str, places: int) -> Column:
    """Column ``name`` as text with ``places`` decimals, rounded like C ``printf``; for reports.

    The JVM formatter rounds the shortest decimal text half up; report readers
    expect the binary value rounded half to even (0.125 gives 0.12). The
    fraction is taken apart as an integer count of 2**-53, where that is exact.
    Below 1 a double is finer than that; what the count misses is added back.

    Written as SQL text with one-element arrays to name intermediate values:
    built from Columns, each use of a value would repeat how it is made.
    """
    if not 0 <= places <= 3:
        raise ValueError("places must be 0 to 3: more would overflow the integer fraction")
    scale = 10**places
    one, half = 1 << _FRACTION_BITS, 1 << (_FRACTION_BITS - 1)
    # With no decimals the digit that decides a tie is the whole number itself.
    deciding = "p.down" if places else "p.whole"
    fraction = f"|| '.' || lpad(string(d.digits % {scale}), {places}, '0')" if places else ""
    stages = [
        f"named_struct('whole', floor(x), 'steps', (x - floor(x)) * double('{one}'))",
        f"named_struct('whole', s.whole, 'steps', floor(s.steps), "
        f"'missed', (s.steps - floor(s.steps)) * double('{scale}'))",
        f"named_struct('whole', m.whole, 'inexact', m.missed > floor(m.missed), "
        f"'parts', m.steps * {scale} + floor(m.missed))",
        f"named_struct('whole', c.whole, 'inexact', c.inexact, "
        f"'down', shiftright(c.parts, {_FRACTION_BITS}), 'rest', c.parts & {one - 1})",
        f"named_struct('whole', p.whole, 'digits', p.down + int(p.rest > {half} "
        f"OR (p.rest = {half} AND (p.inexact OR {deciding} % 2 = 1))))",
        f"string(d.whole + int(d.digits >= {scale})) {fraction}",
    ]
    text = f"array(abs(`{name}`))"
    for variable, stage in zip(("x", "s", "m", "c", "p", "d"), stages):
        text = f"transform({text}, {variable} -> {stage})"
    value = f"double(`{name}`)"
    return F.expr(
        f"CASE WHEN isnan({value}) THEN 'nan' "
        f"WHEN abs({value}) = double('Infinity') THEN IF({value} < 0, '-inf', 'inf') "
        f"ELSE IF({value} < 0, '-', '') || get({text}, 0) END"
    )
