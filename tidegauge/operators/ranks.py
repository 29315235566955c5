"""Exact places and percentiles of a group of any size: ranges of the order side by side, counts added up over one row a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.session import cut


def ranked(rows: DataFrame, by: list[str], order: list[str], name: str, weight: Column | None = None) -> DataFrame:
    """rows with how many rows come before in order among those of the same key (their weights' sum, if given). Keys aren't null.

    Rows are dealt to ranges of key and order, whose bounds Spark samples, and written; weights are summed by range and added
    up over one row a range; inside its range a row is numbered. So no task has all rows of a key.
    """
    dealt = cut(rows.withColumn("weight_", F.lit(1) if weight is None else weight).repartitionByRange(*by, *order).withColumn("range_", F.spark_partition_id()))
    ends = dealt.groupBy(*by, "range_").agg(F.sum("weight_").alias("w_"))
    ends = ends.withColumn("before_", F.sum("w_").over(Window.partitionBy(*by).orderBy("range_")) - F.col("w_")).drop("w_")
    inside = Window.partitionBy(*by, "range_").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = F.coalesce(F.sum("weight_").over(inside), F.lit(0))
    return dealt.join(ends, [*by, "range_"]).withColumn(name, (F.col("before_") + own).cast("long")).drop("weight_", "range_", "before_")


def percentiles(rows: DataFrame, by: list[str], value: str, shares: list[float]) -> DataFrame:
    """by, n, mean and q, an array with the percentile of each share, between neighbours in proportion; unknown values are left out.

    Equal values are counted before they are ranked. Only those that hold a place that some share needs are looked at in the end.
    """
    known = rows.filter(F.col(value).isNotNull())
    counts = known.groupBy(*by, value).agg(F.count("*").alias("n_"))
    placed = ranked(counts, by, [value], "at_", F.col("n_"))
    totals = known.groupBy(*by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"))
    wanted = F.array(*((F.col("n") - 1) * F.lit(float(s)) for s in shares))
    held = placed.join(totals, by).withColumn("wanted_", wanted)
    here = lambda x: (x >= F.col("at_")) & (x < F.col("at_") + F.col("n_"))
    held = held.filter(F.exists("wanted_", lambda x: here(F.floor(x)) | here(F.ceil(x))))
    pick = lambda x: F.max(F.when(here(x), F.col(value)))
    ends = [F.struct(pick(F.floor(F.get("wanted_", F.lit(i)))).alias("low"), pick(F.ceil(F.get("wanted_", F.lit(i)))).alias("high"), F.first(F.get("wanted_", F.lit(i))).alias("at")) for i in range(len(shares))]
    out = held.groupBy(*by, "n", "mean").agg(F.array(*ends).alias("e_"))
    between = lambda e: F.when(F.floor(e["at"]) == F.ceil(e["at"]), e["low"]).otherwise((F.ceil(e["at"]) - e["at"]) * e["low"] + (e["at"] - F.floor(e["at"])) * e["high"])
    return out.select(*by, "n", "mean", F.transform("e_", between).alias("q"))
