"""Panel profiling: quality, moments, missingness, correlation, variance, baselines, and the rows behind charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import CORE, OPTICAL, PRIMARY, QUALITY
from ..session import written
from .climatology import long_features
from .moments import correlations
from .ranks import average_ranks, quantiles, with_quantiles

_MODALITIES = {"s2": "ndvi_mean", "viirs": "viirs_avg_rad_mean", "era5": "era5_temperature_mean"}


def r4(c: Column) -> Column:
    return F.round(c, 4)


def quality_profile(df: DataFrame) -> DataFrame:
    """One row per column: type, rows, missing, infinite and distinct values, constancy, range and category.

    Distinct values are counted over (column, value) pairs in one group-by, everything else in one pass."""
    exprs, values = [], []
    for f in df.schema:
        c, number = F.col(f.name), isinstance(f.dataType, (T.NumericType,))
        x = c.cast("double") if number else F.lit(None).cast("double")
        category = "primary" if f.name in PRIMARY else "quality" if f.name in QUALITY else "identifier"
        exprs.append(F.struct(
            F.lit(f.name).alias("column_name"), F.lit(category).alias("category"), F.lit(f.dataType.simpleString()).alias("dtype"), F.count("*").alias("total_rows"), F.count_if(c.isNull()).alias("missing_count"),
            F.count_if(F.abs(x) == float("inf")).alias("infinite_count"), F.lit(number).alias("numeric"), r4(F.min(x)).alias("min_value"), r4(F.max(x)).alias("max_value"),
        ).alias(f.name))
        values.append((c + F.lit(0) if number else c).cast("string").alias(f.name))  # -0.0 and 0.0 are one value
    rows = df.agg(*exprs).select(F.explode(F.array(*df.columns)).alias("p")).select("p.*")
    distinct = df.select(*values).unpivot([], df.columns, "column_name", "value").filter("value IS NOT NULL").distinct().groupBy("column_name").agg(F.count("*").alias("unique_values"))
    rows = rows.join(distinct, "column_name", "left").withColumn("unique_values", F.coalesce("unique_values", F.lit(0)).cast("long"))
    u = F.col("unique_values")
    return rows.select("column_name", "category", "dtype", "total_rows", "missing_count", F.round(F.col("missing_count") * 100 / F.col("total_rows"), 2).alias("missing_percentage"), "infinite_count", "unique_values", (u <= 1).alias("is_constant"), (F.col("numeric") & (u > 1) & (u < 5)).alias("is_near_constant"), "min_value", "max_value")


def feature_statistics(panel: DataFrame, features: tuple[str, ...] = (*PRIMARY, *QUALITY)) -> DataFrame:
    """Per feature: counts, mean, median, deviation, quartiles, population skewness and excess kurtosis (0 for a deviation under 1e-6)."""
    x = written(panel.select(*[F.col(f).cast("double").alias(f) for f in features]), "features").unpivot([], list(features), "feature", "value")
    s = x.groupBy("feature").agg(F.count("value").alias("n"), F.count("*").alias("rows"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"), F.skewness("value").alias("sk"), F.kurtosis("value").alias("ku"))
    s = with_quantiles(s, x, ("feature",), "value", (0.25, 0.5, 0.75)).withColumn("median", F.col("q")[1])
    flat = F.col("std") < 1e-6
    shape = lambda c: r4(F.when(flat, F.lit(0.0)).otherwise(F.col(c)))
    return s.select("feature", F.col("n").alias("count"), (F.col("rows") - F.col("n")).alias("missing_count"), F.round((F.col("rows") - F.col("n")) * 100 / F.col("rows"), 2).alias("missing_pct"), *[r4(F.col(c)).alias(c) for c in ("mean", "median", "std", "min", "max")], r4(F.col("q")[0]).alias("q1"), r4(F.col("q")[2]).alias("q3"), r4(F.col("q")[2] - F.col("q")[0]).alias("iqr"), shape("sk").alias("skewness"), shape("ku").alias("kurtosis"))


def missingness_by_month(panel: DataFrame) -> DataFrame:
    n = F.count("*")
    gone = {k: F.count_if(F.col(c).isNull()) for k, c in _MODALITIES.items()}
    return panel.groupBy("month").agg(n.alias("total_cells"), *[e.alias(f"{k}_missing_cells") for k, e in gone.items()], *[F.round(e * 100 / n, 2).alias(f"{k}_missing_pct") for k, e in gone.items()])


def missingness_by_cell(panel: DataFrame) -> DataFrame:
    c = F.col("ndvi_mean")
    return panel.groupBy("cell_id").agg(F.count(c).alias("s2_valid_months"), F.count_if(c.isNull()).alias("s2_missing_months"), F.count("viirs_avg_rad_mean").alias("viirs_valid_months"), F.count("era5_temperature_mean").alias("era5_valid_months"))


def co_missing(panel: DataFrame) -> DataFrame:
    """Whether all optical columns are missing together, and missing goes with a count and a fraction of 0."""
    gone = F.col("ndvi_mean").isNull()
    together = F.lit(True)
    for c in OPTICAL:
        together = together & (F.col(c).isNull() == gone)
    zero = ~gone | ((F.col("valid_pixel_count") == 0) & (F.col("valid_pixel_fraction") == 0.0))
    return panel.agg(F.bool_and(together).alias("optical_together"), F.bool_and(F.coalesce(zero, F.lit(False))).alias("missing_means_zero"), F.count_if(gone).alias("missing_rows"))


def monthly_summary(panel: DataFrame) -> DataFrame:
    x = written(long_features(panel, ("month",)), "monthly")
    s = x.groupBy("month", "feature").agg(r4(F.avg("value")).alias("mean"), r4(F.stddev_samp("value")).alias("std"), r4(F.min("value")).alias("min"), r4(F.max("value")).alias("max"), F.count("value").alias("valid_count"))
    s = with_quantiles(s, x, ("month", "feature"), "value", (0.5,))
    return s.select("month", "feature", "mean", r4(F.col("q")[0]).alias("median"), "std", "min", "max", "valid_count")


def cell_temporal_stats(panel: DataFrame) -> DataFrame:
    """One wide row per cell: mean, median, std, mad, min, max and count of each core feature, and radiance's coefficient of variation (mean over 1e-4 only)."""
    x = long_features(panel, ("cell_id",)).withColumn("_m", F.median("value").over(Window.partitionBy("cell_id", "feature")))
    aggs = [r4(F.avg("value")).alias("mean"), r4(F.median("value")).alias("median"), r4(F.stddev_samp("value")).alias("std"), r4(F.median(F.abs(F.col("value") - F.col("_m")))).alias("mad"), r4(F.min("value")).alias("min"), r4(F.max("value")).alias("max"), F.count("value").alias("count"), F.when(F.avg("value") > 1e-4, r4(F.stddev_samp("value") / F.avg("value"))).alias("cv")]
    wide = x.groupBy("cell_id").pivot("feature", list(CORE)).agg(*aggs)
    return wide.drop(*[f"{f}_cv" for f in CORE if f != "viirs_avg_rad_mean"])


def pearson(panel: DataFrame, features: tuple[str, ...] = PRIMARY) -> DataFrame:
    """All ordered pairs over the rows that have every feature."""
    return correlations(panel.select(*features).dropna(), features)


def pearson_pairwise(panel: DataFrame, features: tuple[str, ...] = PRIMARY, against: tuple[str, ...] = ("valid_pixel_fraction", "viirs_cf_cvg_mean", "era5_observation_count")) -> DataFrame:
    """Each feature against each quality column, over the rows that have both."""
    return correlations(panel, tuple(dict.fromkeys((*features, *against))), features, against)


def matrix(pairs: DataFrame, features: tuple[str, ...]) -> DataFrame:
    """Pair rows (feature_x, feature_y, r) as a matrix: a row per feature_x, a column per feature."""
    return pairs.groupBy("feature_x").agg(*[F.max(F.when(F.col("feature_y") == f, F.col("r"))).alias(f) for f in features])


def spearman(panel: DataFrame, features: tuple[str, ...] = tuple(CORE)) -> DataFrame:
    return correlations(average_ranks(panel.select(*features).dropna(), features), features)


def variance_decomposition(panel: DataFrame) -> DataFrame:
    """Per feature: total variance, that of cell means, the mean of cell variances (two values or more), shares of the total, values per cell."""
    x = long_features(panel, ("cell_id",)).filter("value IS NOT NULL")
    total = x.groupBy("feature").agg(F.var_samp("value").alias("total"))
    cells = x.groupBy("feature", "cell_id").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    parts = cells.groupBy("feature").agg(F.var_samp("m").alias("between"), F.avg("v").alias("within"), F.min("n").alias("min_obs_per_cell"), F.max("n").alias("max_obs_per_cell"))
    share = lambda c: F.round(F.try_divide(F.col(c) * 100, F.col("total")), 2)
    return total.join(parts, "feature").select("feature", r4(F.col("total")).alias("total_variance"), r4(F.col("between")).alias("between_variance"), r4(F.col("within")).alias("within_variance"), share("between").alias("pct_between_cell"), share("within").alias("pct_within_cell"), "min_obs_per_cell", "max_obs_per_cell", (F.col("min_obs_per_cell") == F.col("max_obs_per_cell")).alias("balanced_panel"))


def baseline_comparison(panel: DataFrame) -> DataFrame:
    """Errors of four baselines of a cell's feature: its mean, its median, the mean of up to three rows before, and the median again as the robust one."""
    x = long_features(panel, ("cell_id", "month"))
    whole = Window.partitionBy("cell_id", "feature")
    before = whole.orderBy("month").rowsBetween(-3, -1)
    x = x.withColumns({"A_mean": F.avg("value").over(whole), "B_median": F.median("value").over(whole), "C_lagged_mean": F.avg("value").over(before)}).withColumn("D_robust", F.col("B_median"))
    names = ["A_mean", "B_median", "C_lagged_mean", "D_robust"]
    long = x.unpivot(["feature", "value"], names, "baseline_name", "expected").withColumn("res", F.col("value") - F.col("expected"))
    long = written(long.select("feature", "baseline_name", "res", F.abs("res").alias("size")), "residuals")
    r = F.col("res")
    s = long.groupBy("feature", "baseline_name").agg(F.count(r).alias("n_eval_obs"), r4(F.avg("size")).alias("mae"), r4(F.sqrt(F.avg(r * r))).alias("rmse"), r4(F.stddev_pop(r)).alias("residual_std"))
    s = with_quantiles(s, long, ("feature", "baseline_name"), "size", (0.5,))
    return s.select("feature", "baseline_name", "n_eval_obs", "mae", "rmse", r4(F.col("q")[0]).alias("median_ae"), "residual_std")


def representative_cells(panel: DataFrame) -> DataFrame:
    """Five cells, none twice, in this order: least and most NDVI deviation, nearest to its median, highest mean radiance, nearest to its median; ties to the smaller cell_id."""
    stats = panel.groupBy("cell_id").agg(r4(F.stddev_samp("ndvi_mean")).alias("s"), r4(F.avg("viirs_avg_rad_mean")).alias("r"))
    stats = written(stats, "cell-stats")
    q = quantiles(stats.unpivot(["cell_id"], ["s", "r"], "what", "value"), ("what",), "value", (0.5,))
    of = lambda what: r4(F.max(F.when(F.col("what") == what, F.col("q")[0])))
    s = stats.crossJoin(F.broadcast(q.agg(of("s").alias("ms"), of("r").alias("mr"))))
    rules = [("stable_ndvi", F.col("s")), ("variable_ndvi", -F.col("s")), ("typical_ndvi", r4(F.abs(F.col("s") - F.col("ms")))), ("bright", -F.col("r")), ("typical_light", r4(F.abs(F.col("r") - F.col("mr"))))]
    picked = None
    for i, (role, by) in enumerate(rules):
        left = s if picked is None else s.join(picked, "cell_id", "left_anti")
        one = left.orderBy(by.asc_nulls_last(), "cell_id").limit(1).select(F.lit(i + 1).alias("pick"), F.lit(role).alias("role"), "cell_id")
        picked = one if picked is None else picked.unionByName(one)
    return picked


def histogram(panel: DataFrame, feature: str, bins: int) -> DataFrame:
    """Equal-width bins over the feature's range; the largest value is in the last one. Density sums to one over the range."""
    x = panel.select(F.col(feature).alias("v")).dropna()
    lim = x.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    step = (F.col("hi") - F.col("lo")) / bins
    j = x.crossJoin(F.broadcast(lim)).filter("hi > lo")
    b = F.least(F.floor((F.col("v") - F.col("lo")) / step), F.lit(bins - 1)).cast("int")
    return j.groupBy(b.alias("bin"), "lo", "hi", "n").agg(F.count("*").alias("frequency")).select("bin", r4(F.col("lo") + F.col("bin") * step).alias("bin_start"), "frequency", F.round(F.col("frequency") / (F.col("n") * step), 4).alias("density"))


def box_data(panel: DataFrame) -> DataFrame:
    """Five-number summary per core feature."""
    x = written(long_features(panel, ("cell_id",)).select("feature", "value"), "box")
    s = with_quantiles(x.select("feature").distinct(), x, ("feature",), "value", (0.0, 0.25, 0.5, 0.75, 1.0))
    return s.select("feature", *[r4(F.col("q")[i]).alias(n) for i, n in enumerate(("low", "q1", "median", "q3", "high"))])


def percentile_clip(panel: DataFrame, feature: str, low: float, high: float) -> DataFrame:
    """Colour limits: the 1st and 99th percentile within [low, high]; half a unit around the value where all are equal."""
    s = quantiles(panel.select(F.lit(feature).alias("feature"), F.col(feature).cast("double").alias("value")), ("feature",), "value", (0.01, 0.99))
    a, b = F.greatest(F.lit(low), F.col("q")[0]), F.least(F.lit(high), F.col("q")[1])
    same = F.col("q")[0] == F.col("q")[1]
    return s.select(F.lit(feature).alias("feature"), r4(F.when(same, F.col("q")[0] - 0.5).otherwise(a)).alias("vmin"), r4(F.when(same, F.col("q")[1] + 0.5).otherwise(b)).alias("vmax"))


def log1p_skew(panel: DataFrame, feature: str = "viirs_avg_rad_mean") -> DataFrame:
    """Skewness before and after log1p."""
    return panel.agg(r4(F.skewness(feature)).alias("skew_raw"), r4(F.skewness(F.log1p(feature))).alias("skew_log1p"))
