"""Scalar column functions; null stands for missing throughout, and no guard ever divides by zero."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import CORE

MAD_TO_SIGMA = 1.4826


def missing(c: Column) -> Column:
    """NaN as null."""
    return F.when(~F.isnan(c), c)


def reflectance(dn: Column) -> Column:
    return dn / F.lit(10000.0)


def normalized_difference(a: Column, b: Column, least: float = 1e-5) -> Column:
    """(a - b) / (a + b), null unless the sum's size is over ``least``."""
    return F.when(F.abs(a + b) > least, (a - b) / (a + b))


def celsius(kelvin: Column) -> Column:
    return kelvin - 273.15


def millimetres(metres: Column) -> Column:
    return metres * 1000.0


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def valid_fraction(count: Column, expected: int) -> Column:
    return F.round(F.least(F.lit(1.0), F.coalesce(count, F.lit(0)) / F.lit(float(expected))), 4)


def clipped_fraction(mask_mean: Column) -> Column:
    """A mask's mean between 0 and 1; 1 where there is no mask."""
    return F.coalesce(F.round(F.when(mask_mean.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), mask_mean))), 4), F.lit(1.0))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(a, b), 4), F.lit(0.0))


def calendar_month(month: Column) -> Column:
    return F.split(month, "-")[1].cast("int")


def robust_scale(mad: Column) -> Column:
    return mad * MAD_TO_SIGMA


def robust_z(residual: Column, mad: Column, zero: float = 1e-9) -> Column:
    return F.when(mad > zero, residual / robust_scale(mad))


def modality(feature: Column) -> Column:
    return reduce(lambda c, f: c.when(feature == f, CORE[f]), list(CORE)[1:], F.when(feature == next(iter(CORE)), next(iter(CORE.values()))))


def ordinal(feature: Column) -> Column:
    return F.array_position(F.array(*map(F.lit, CORE)), feature).cast("int") - 1


def is_anomalous(abs_z: Column, zero_mad_deviation: Column, tau: Column) -> Column:
    return F.coalesce(abs_z >= tau, F.lit(False)) | F.coalesce(zero_mad_deviation, F.lit(False))


def direction(residual: Column) -> Column:
    return F.when(residual > 0, "positive").otherwise("negative")


def event_id(month: Column, number: Column) -> Column:
    return F.format_string("EVT_%s_%03d", F.replace(month, F.lit("-"), F.lit("")), number)


def string_list(c: Column, sep: str = ";") -> Column:
    return F.array_join(F.array_sort(F.collect_list(c)), sep)


def plain_label(c: Column) -> Column:
    """A feature's name without source prefix and statistic suffix, with spaces."""
    return F.regexp_replace(F.regexp_replace(c, "^(viirs|era5)_|_(mean|total)$", ""), "_", " ")
