"""Equal-frequency binning of numeric columns into 1..n.

Splits are exact order statistics: split ``i`` of ``n`` is the value at rank
``ceil(i * rows / n)``. They are found by narrowing instead of sorting the table, by the same
passes at every size:

1. A first pass makes a KLL sketch, a count and the range of every column. These merge, so they
   can be kept per file or per day and the pass then reads new files only. A sketch gives a
   bracket of values around each wanted rank, for any number of bins.
2. Each further pass counts exactly the rows below and inside each bracket and sketches the
   inside. A sketch of at most ``SKETCH_SIZE`` values holds them all, and the value at the rank
   is read off it; a larger inside gives a bracket of some 0.3 % of it. Two passes do for
   3 million rows, three for 10^9, five for 10^14.

Passes notice a rank outside its bracket and go on where it must lie. A value that fills a third
of the table ends up as the end of a bracket, where rows are only counted. Sketches are merged
within ``_SALTS`` groups first, so no single task receives one per input task. Only bracket
ends, counts and splits reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.feature import QuantileDiscretizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_SALTS = 256
#: Values a sketch holds before it starts to forget some.
SKETCH_SIZE = 8192
# Twice the rank error of a sketch, 2.296 / k^0.9021, on either side of a rank.
_MARGIN = 2 * 2.296 / SKETCH_SIZE**0.9021


@dataclass(frozen=True)
class BinModel:
    """Ascending distinct splits per column."""

    columns: tuple[str, ...]
    splits: tuple[tuple[float, ...], ...]

    def bin_of(self, name: str) -> Column:
        """1 + the number of splits at or below the value; null and NaN give null."""
        value = F.col(name).cast("double")
        above = [f"int(v >= {_double(s)})" for s in self.splits[self.columns.index(name)]]
        quoted = f"double(`{name}`)"
        count = " + ".join(["1", *above]).replace("(v ", f"({quoted} ")
        return F.when(~F.isnan(value), F.expr(count))

    def transform(self, df: DataFrame, suffix: str = "_bin") -> DataFrame:
        return df.withColumns({name + suffix: self.bin_of(name) for name in self.columns})


@dataclass(frozen=True)
class _Bracket:
    """Values in which one split lies, ends included."""

    column: str
    number: int
    low: float
    high: float

    @property
    def key(self) -> tuple[str, int]:
        return self.column, self.number

    @property
    def span(self) -> tuple[str, float, float]:
        return self.column, self.low, self.high

    def between(self, low: float, high: float) -> _Bracket:
        return _Bracket(self.column, self.number, low, high)

    def closer(self, share: float, values: Sequence[float]) -> _Bracket:
        """Between the values a margin below and above a share of the rows inside."""
        return self.between(
            values[0] if share > _MARGIN else self.low, values[2] if share < 1 - _MARGIN else self.high
        )


@dataclass(frozen=True)
class _Sizes:
    """Filled rows and value range per column, and the rank of every split."""

    bins: int
    rows: dict[str, int]
    low: dict[str, float]
    high: dict[str, float]

    def rank(self, bracket: _Bracket) -> int:
        return max(1, -(-bracket.number * self.rows[bracket.column] // self.bins))


def _double(number: float) -> str:
    return f"double('{number!r}')"


def _values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as doubles; NaN is null."""
    doubles = {name: F.col(f"`{name}`").cast("double") for name in columns}
    return df.select(*[F.when(~F.isnan(value), value).alias(name) for name, value in doubles.items()])


def _by_salt(values: DataFrame, cells: list[Column]) -> DataFrame:
    return (
        values.groupBy(F.pmod(F.spark_partition_id(), F.lit(_SALTS)).alias("salt"))
        .agg(F.array(*cells).alias("cells"))
        .select(F.inline("cells"))
    )


def sketch_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One pass: ``(column, rows, low, high, sketch)`` per column, to keep and to merge.

    Nulls and NaN do not count as rows; a column without values has no row.
    """
    values = _values(df, columns)
    cells = [
        F.struct(
            F.lit(name).alias("column"),
            F.count(f"`{name}`").alias("rows"),
            F.min(f"`{name}`").alias("low"),
            F.max(f"`{name}`").alias("high"),
            F.kll_sketch_agg_double(f"`{name}`", F.lit(SKETCH_SIZE)).alias("sketch"),
        )
        for name in columns
    ]
    return merge_sketches(_by_salt(values, cells))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    """Sketches of several files or days as those of all of them."""
    return (
        sketches.where("rows > 0")
        .groupBy("column")
        .agg(
            F.sum("rows").alias("rows"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.kll_merge_agg_double("sketch").alias("sketch"),
        )
    )


def _at_shares(sketches: DataFrame, key: str, shares: dict[object, list[float]]) -> dict[object, list[float]]:
    """Values at shares of the rows of some sketches."""
    at = None
    for name, wanted in shares.items():
        within = F.lit([min(1.0, max(0.0, share)) for share in wanted])
        found = F.kll_sketch_get_quantile_double("sketch", within)
        at = F.when(F.col(key) == F.lit(name), found) if at is None else at.when(F.col(key) == F.lit(name), found)
    if at is None:
        return {}
    return {row[key]: row["at"] for row in sketches.select(key, at.alias("at")).collect() if row[key] in shares}


def _around(share: float) -> list[float]:
    return [share - _MARGIN, share, share + _MARGIN]


def _first_look(sketches: DataFrame, bins: int) -> tuple[_Sizes, dict[tuple[str, int], float], list[_Bracket]]:
    """Rows and range of every column, the splits of columns whose sketch holds all values, brackets for the others."""
    sketches = sketches.persist()  # a row per column
    try:
        rows = sketches.select("column", "rows", "low", "high").collect()
        sizes = _Sizes(bins, *({r["column"]: r[f] for r in rows} for f in ("rows", "low", "high")))
        whole = [_Bracket(n, number, sizes.low[n], sizes.high[n]) for n in sizes.rows for number in range(1, bins)]
        shares = {b.key: (sizes.rank(b) - 0.5) / sizes.rows[b.column] for b in whole}
        at = _at_shares(
            sketches, "column", {n: [s for k in range(1, bins) for s in _around(shares[n, k])] for n in sizes.rows} if bins > 1 else {}
        )
    finally:
        sketches.unpersist()
    known, brackets = {}, []
    for bracket in whole:
        values = at[bracket.column][3 * bracket.number - 3 : 3 * bracket.number]
        if sizes.rows[bracket.column] <= SKETCH_SIZE:
            known[bracket.key] = values[1]
        else:
            brackets.append(bracket.closer(shares[bracket.key], values))
    return sizes, known, brackets


def _narrow(values: DataFrame, sizes: _Sizes, brackets: list[_Bracket]) -> tuple[dict[tuple[str, int], float], list[_Bracket]]:
    """One pass over the table: the splits now known, and narrower brackets for the rest."""
    spans = sorted({b.span for b in brackets})
    cells = []
    for number, (name, low, high) in enumerate(spans):
        value = F.col(f"`{name}`")
        strictly_inside = F.when((value > F.lit(low)) & (value < F.lit(high)), value)
        cells.append(
            F.struct(
                F.lit(number).alias("span"),
                F.count_if(value < F.lit(low)).alias("under_low"),
                F.count_if(value <= F.lit(low)).alias("upto_low"),
                F.count(strictly_inside).alias("inside"),
                F.kll_sketch_agg_double(strictly_inside, F.lit(SKETCH_SIZE)).alias("sketch"),
                F.count_if(value <= F.lit(high)).alias("upto_high"),
            )
        )
    counted = ("under_low", "upto_low", "inside", "upto_high")
    salted = _by_salt(values, cells).groupBy("span")
    merged = salted.agg(*[F.sum(n).alias(n) for n in counted], F.kll_merge_agg_double("sketch").alias("sketch"))
    merged = merged.persist()  # a row per span; kept so that the table is not read again for the second look
    try:
        counts = {row["span"]: row for row in merged.select("span", *counted).collect()}
        known: dict[tuple[str, int], float] = {}
        narrower: list[_Bracket] = []
        asked: dict[int, list[tuple[_Bracket, float]]] = {}
        for bracket in brackets:
            number = spans.index(bracket.span)
            count, rank = counts[number], sizes.rank(bracket)
            if rank <= count["under_low"]:
                narrower.append(bracket.between(sizes.low[bracket.column], bracket.low))
            elif rank > count["upto_high"]:
                narrower.append(bracket.between(bracket.high, sizes.high[bracket.column]))
            elif rank <= count["upto_low"]:
                known[bracket.key] = bracket.low
            elif rank > count["upto_low"] + count["inside"]:
                known[bracket.key] = bracket.high
            else:
                share = (rank - count["upto_low"] - 0.5) / count["inside"]
                asked.setdefault(number, []).append((bracket, share))
        at = _at_shares(merged, "span", {n: [s for _, share in own for s in _around(share)] for n, own in asked.items()})
        for number, own in asked.items():
            for i, (bracket, share) in enumerate(own):
                values_at = at[number][3 * i : 3 * i + 3]
                if counts[number]["inside"] <= SKETCH_SIZE:
                    known[bracket.key] = values_at[1]
                else:
                    narrower.append(bracket.closer(share, values_at))
    finally:
        merged.unpersist()
    return known, narrower


def fit_bins(df: DataFrame, columns: Sequence[str], bins: int = 10, sketches: DataFrame | None = None) -> BinModel:
    """Exact equal-frequency splits. Nulls and NaN do not count as rows.

    ``sketches`` are those of all rows of ``df``, merged; without them a first pass makes them.
    """
    values = _values(df, columns)
    sizes, splits, brackets = _first_look(sketch_columns(df, columns) if sketches is None else sketches, bins)
    while brackets:
        known, brackets = _narrow(values, sizes, brackets)
        splits |= known
    return BinModel(
        tuple(columns),
        tuple(
            tuple(sorted({splits[n, number] for number in range(1, bins)})) if n in sizes.rows else ()
            for n in columns
        ),
    )


def sketched_bins(sketches: DataFrame, columns: Sequence[str], bins: int = 10) -> BinModel:
    """Splits from sketches alone: no row is read, ranks are off by 0.07 % at most 99 times in 100.

    Exact for columns of up to ``SKETCH_SIZE`` values.
    """
    found = _at_shares(sketches, "column", {n: [i / bins for i in range(1, bins)] for n in columns} if bins > 1 else {})
    return BinModel(tuple(columns), tuple(tuple(sorted(set(found.get(n, ())))) for n in columns))


def bin_columns(df: DataFrame, columns: Sequence[str], bins: int = 10, suffix: str = "_bin") -> DataFrame:
    """Append the bin number 1..bins of every column."""
    return fit_bins(df, columns, bins).transform(df, suffix)


def mllib_bins(columns: Sequence[str], bins: int = 10, suffix: str = "_bin", relative_error: float = 0.001):
    """The approximate MLlib form; its bins start at 0."""
    return QuantileDiscretizer(
        numBucketsArray=[bins] * len(columns),
        inputCols=list(columns),
        outputCols=[name + suffix for name in columns],
        relativeError=relative_error,
    )
