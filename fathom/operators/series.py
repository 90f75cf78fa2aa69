"""Time-series helpers over windows: by series, in the order of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def moving(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, before: int, after: int = 0, how: str = "avg", name: str = "moved") -> DataFrame:
    """df with the mean, median, min, max or sum of value over the rows around each row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(-before, after)
    fn = {"avg": F.avg, "median": F.median, "min": F.min, "max": F.max, "sum": F.sum}[how]
    if how == "median":  # percentiles don't run over frames
        return df.withColumn(name, F.transform(F.array_sort(F.collect_list(value).over(w)), lambda x: x.cast("double"))).withColumn(name, (F.expr(f"{name}[(size({name}) - 1) div 2]") + F.expr(f"{name}[size({name}) div 2]")) / 2)
    return df.withColumn(name, fn(value).over(w))


def difference(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, name: str = "difference") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(Window.partitionBy(*by).orderBy(*order)))


def summary(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """n, mean, standard deviation (of the sample), least and most."""
    return df.groupBy(*by).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("deviation"), F.min(value).alias("least"), F.max(value).alias("most"))


def resample(df: DataFrame, by: Sequence[str], time: str, value: str, width: str) -> DataFrame:
    """The mean of each window of time."""
    return df.groupBy(*by, F.window(time, width).alias("w")).agg(F.avg(value).alias("mean")).select(*by, F.col("w.start").alias("start"), "mean")


def smooth(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, reach: int = 1, name: str = "smooth") -> DataFrame:
    return moving(df, by, order, value, reach, reach, "avg", name)


def peaks(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str) -> DataFrame:
    """Rows higher than the row before and not lower than the row after."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns({"fx_before": F.lag(value).over(w), "fx_after": F.lead(value).over(w)}).where((F.col(value) > F.col("fx_before")) & (F.col(value) >= F.col("fx_after"))).drop("fx_before", "fx_after")
