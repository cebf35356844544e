"""Each cell's seasonal climatology: robust statistics of a feature over a calendar month's years."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import calendar_month, robust_z
from ..schemas import CORE


def long_features(panel: DataFrame, ids: tuple[str, ...], features: tuple[str, ...] = tuple(CORE)) -> DataFrame:
    """One row per feature, missing values included."""
    return panel.select(*ids, *features).unpivot(list(ids), list(features), "feature", "value")


def seasonal_climatology(panel: DataFrame, features: tuple[str, ...] = tuple(CORE), mad_round: int = 4, zero: float = 1e-9) -> DataFrame:
    """Per cell, calendar month and feature: count, mean, median, sample deviation (0 for one value), MAD, quartiles, range.

    The zero-MAD flag is set before rounding; profiles without a value are kept, with nulls. The median over the
    window and the MAD over the group share one exchange."""
    x = long_features(panel.withColumn("calendar_month", calendar_month(F.col("month"))), ("cell_id", "calendar_month"), features)
    x = x.withColumn("_m", F.median("value").over(Window.partitionBy("cell_id", "calendar_month", "feature")))
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)))
    p = x.groupBy("cell_id", "calendar_month", "feature").agg(
        F.count("value").alias("n_observations"), F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"),
        F.median(F.abs(F.col("value") - F.col("_m"))).alias("mad"), q.alias("q"), F.min("value").alias("min"), F.max("value").alias("max"),
    )
    r = lambda c, n=4: F.round(c, n)
    std = F.when(F.col("n_observations") == 1, F.lit(0.0)).otherwise(F.col("std"))
    return p.select(
        "cell_id", "calendar_month", "feature", "n_observations", r(F.col("mean")).alias("mean"), r(F.col("median")).alias("median"), r(std).alias("std"), r(F.col("mad"), mad_round).alias("mad"),
        r(F.col("q")[0]).alias("q1"), r(F.col("q")[1]).alias("q3"), r(F.col("q")[1] - F.col("q")[0]).alias("iqr"), r(F.col("min")).alias("min"), r(F.col("max")).alias("max"), F.coalesce(F.col("mad") < zero, F.lit(False)).alias("zero_mad_flag"),
    )


def profile_state(panel: DataFrame, features: tuple[str, ...] = tuple(CORE)) -> DataFrame:
    """What a climatology is kept up to date from: per profile, its values in order, each with its month. Missing values have an entry as well."""
    x = long_features(panel.withColumn("calendar_month", calendar_month(F.col("month"))), ("cell_id", "calendar_month", "month"), features)
    return x.groupBy("cell_id", "calendar_month", "feature").agg(F.array_sort(F.collect_list(F.struct("value", "month"))).alias("entries"))  # one a year


def merged_state(state: DataFrame, new: DataFrame) -> DataFrame:
    """``state`` with the entries of ``new``, another state: months that both have are those of ``new``, so a month may come again, corrected or not.

    One join of the two states; the panel behind the old one isn't needed any more."""
    keys = ["cell_id", "calendar_month", "feature"]
    j = state.join(new.withColumnRenamed("entries", "later"), keys, "full_outer")
    months = F.transform("later", lambda e: e["month"])
    kept = F.filter("entries", lambda e: ~F.coalesce(F.array_contains(months, e["month"]), F.lit(False)))
    none = F.array().cast(state.schema["entries"].dataType)
    return j.select(*keys, F.array_sort(F.concat(F.coalesce(kept, none), F.coalesce("later", none))).alias("entries"))


def climatology_of(state: DataFrame, mad_round: int = 4, zero: float = 1e-9) -> DataFrame:
    """The climatology of a state: exact medians, MAD and quartiles from the ordered values, as seasonal_climatology's. No exchange."""
    values = F.transform(F.filter("entries", lambda e: e["value"].isNotNull()), lambda e: e["value"])
    p = state.withColumn("v", values).withColumns({"n": F.size("v"), "total": F.aggregate("v", F.lit(0.0), lambda t, x: t + x)})

    def quantile(v, share: float):
        at = (F.size(v) - 1) * F.lit(share)
        low, high = F.get(v, F.floor(at).cast("int")), F.get(v, F.ceil(at).cast("int"))
        between = F.when(F.floor(at) == F.ceil(at), low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high)
        return F.when(F.size(v) > 0, between)

    p = p.withColumns({"mean": F.try_divide("total", "n"), "median": quantile(F.col("v"), 0.5)})
    p = p.withColumns({"far": F.array_sort(F.transform("v", lambda x: F.abs(x - F.col("median")))), "dev": F.aggregate("v", F.lit(0.0), lambda t, x: t + (x - F.col("mean")) * (x - F.col("mean")))})
    p = p.withColumns({"mad": quantile(F.col("far"), 0.5), "q1": quantile(F.col("v"), 0.25), "q3": quantile(F.col("v"), 0.75)})
    r = lambda c, n=4: F.round(c, n)
    std = F.when(F.col("n") == 1, F.lit(0.0)).when(F.col("n") > 1, F.sqrt(F.try_divide(F.col("dev"), F.col("n") - 1)))
    return p.select(
        "cell_id", "calendar_month", "feature", F.col("n").cast("long").alias("n_observations"), r("mean").alias("mean"), r("median").alias("median"), r(std).alias("std"), r("mad", mad_round).alias("mad"),
        r("q1").alias("q1"), r("q3").alias("q3"), r(F.col("q3") - F.col("q1")).alias("iqr"), r(F.get("v", F.lit(0))).alias("min"), r(F.get("v", F.col("n") - 1)).alias("max"), F.coalesce(F.col("mad") < zero, F.lit(False)).alias("zero_mad_flag"),
    )


def month_diagnostic(panel: DataFrame, climatology: DataFrame, month: str, tau: float = 3.0) -> DataFrame:
    """One month's values against the same calendar month's profiles; a missing profile counts as n = 0."""
    x = long_features(panel.filter(F.col("month") == month), ("cell_id",)).withColumn("calendar_month", F.lit(int(month[5:7])))
    j = x.join(climatology.select("cell_id", "calendar_month", "feature", "n_observations", "median", "mad"), ["cell_id", "calendar_month", "feature"], "left")
    z = robust_z(F.col("value") - F.col("median"), F.col("mad"))
    return j.select("cell_id", "feature", F.round("value", 4).alias("value"), "median", F.coalesce("n_observations", F.lit(0)).cast("long").alias("n_observations"), F.round(z, 4).alias("robust_z"), F.coalesce(F.abs(z) >= tau, F.lit(False)).alias("beyond"))


def climatology_band(climatology: DataFrame, cells: tuple[str, ...], feature: str) -> DataFrame:
    """Median and median +- 1.4826 MAD by calendar month of chosen cells."""
    half = F.col("mad") * 1.4826
    return climatology.filter(F.col("cell_id").isin(*cells) & (F.col("feature") == feature)).select("cell_id", "calendar_month", "median", F.round(F.col("median") - half, 4).alias("low"), F.round(F.col("median") + half, 4).alias("high"))
