"""Windows over one long series, side by side: rows are numbered in two passes, dealt to ranges with a halo, or given what earlier days carry over."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

#: Rows of a range, without its halo.
RANGE = 8192


DAY = "halo_day_"


def by_day(rows: DataFrame) -> DataFrame:
    """rows with the day they are dealt by. Operators that find that column leave it and its partitions as they are, so that a chain of them deals rows by day only once."""
    return rows if DAY in rows.columns else rows.withColumn(DAY, F.to_date("timestamp"))


def _handed_on(rows: DataFrame, by: tuple[str, ...], at: list, values: dict[str, Callable[[WindowSpec], Column]]) -> DataFrame:
    """rows, which have their day and in the last row of each day, in order of at, the day's own results, with the values given to all rows of the day.

    A value is worked out in a window over the days' last rows, one row a day; all other rows stay with their day. The rows go
    through in one line of exchanges, none is read twice.
    """
    inside = Window.partitionBy(*by, DAY).orderBy(*at)
    rows = rows.withColumn("end_", F.lead(F.lit(1)).over(inside).isNull())
    ends = Window.partitionBy(*by, "end_", F.when(~F.col("end_"), F.col(DAY)))
    rows = rows.withColumns({c: F.when(F.col("end_"), make(ends)) for c, make in values.items()})
    return rows.withColumns({c: F.first(c, True).over(Window.partitionBy(*by, DAY)) for c in values}).drop("end_")


def running(rows: DataFrame, values: dict[str, Column], by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """rows with the running sum of each named value in order of timestamp: days' sums are added up over one row a day, rows inside their day."""
    inside = Window.partitionBy(*by, DAY).orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    spare = [] if DAY in rows.columns else [DAY]
    rows = by_day(rows).withColumns({f"{c}_l_": F.coalesce(F.sum(v).over(inside), F.lit(0)) for c, v in values.items()})
    before = lambda c: lambda ends: F.coalesce(F.sum(f"{c}_l_").over(ends.orderBy(DAY).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = _handed_on(rows, by, ["timestamp"], {f"{c}_c_": before(c) for c in values})
    return rows.withColumns({c: F.col(f"{c}_l_") + F.col(f"{c}_c_") for c in values}).drop(*spare, *(f"{c}_{x}_" for c in values for x in "lc"))


def numbered(bars: DataFrame, name: str, by: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """bars with their place in order of timestamp among those of the same key, from 0."""
    return running(bars, {name: F.lit(1).cast("long")}, by).withColumn(name, F.col(name) - 1)


def carried(rows: DataFrame, values: dict[str, Column], at: Column, by: tuple[str, ...], ahead: bool = False) -> DataFrame:
    """rows with, for each named value, the last known one before the row in order of `at` among those of the same key; the first one after it if ahead.

    Inside its day a row looks by itself; the last known value of each day is handed on over one row a day.
    """
    turn = (lambda c: F.col(c).desc()) if ahead else F.col
    inside = Window.partitionBy(*by, DAY).orderBy(turn("at_"))
    near, far = (inside.rowsBetween(Window.unboundedPreceding, to) for to in (-1, 0))
    spare = [] if DAY in rows.columns else [DAY]
    rows = by_day(rows).withColumn("at_", at)
    rows = rows.withColumns({f"{c}_l_": F.last(v, True).over(near) for c, v in values.items()} | {f"{c}_d_": F.last(v, True).over(far) for c, v in values.items()})
    before = lambda c: lambda ends: F.last(f"{c}_d_", True).over(ends.orderBy(turn(DAY)).rowsBetween(Window.unboundedPreceding, -1))
    rows = _handed_on(rows, by, [turn("at_")], {f"{c}_c_": before(c) for c in values})
    return rows.withColumns({c: F.coalesce(f"{c}_l_", f"{c}_c_") for c in values}).drop(*spare, "at_", *(f"{c}_{x}_" for c in values for x in "ldc"))


def bounded(bars: DataFrame, before: int, after: int, *steps: Callable[[WindowSpec], dict[str, Column]], place: str = "", by: tuple[str, ...] = ("symbol",), size: int = RANGE) -> DataFrame:
    """bars with the columns of the steps, whose frames reach at most `before` rows back and `after` rows ahead, all steps together.

    Rows are dealt to ranges of `size` places; the rows that a range's frames reach over its ends are copied in, and the
    copies dropped afterwards. So a series of any length is as many tasks as it has ranges. A step is a function from the
    ordered window to new columns and sees those of the steps before it. place: a column with the rows' places, if there is one.
    """
    rows = bars if place else numbered(bars, "place_", by)
    at = F.col(place or "place_")
    home, n = F.floor(at / size), F.lit(size)
    first, last = F.greatest(F.floor((at - after) / n), F.lit(0)), F.floor((at + before) / n)
    dealt = rows.withColumn("home_", home).withColumn("range_", F.explode(F.sequence(first, last)))
    order = Window.partitionBy(*by, "range_").orderBy(at)
    for step in steps:
        dealt = dealt.withColumns(step(order))
    return dealt.filter("range_ = home_").drop("range_", "home_", *([] if place else ["place_"]))
