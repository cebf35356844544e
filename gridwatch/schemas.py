"""Feature sets, table schemas and settings of the grid engine."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from pyspark.sql import types as T

KEYS = ("cell_id", "month", "start_date", "end_date")
#: The seven features that are scored, in the order that breaks ties, and what each measures.
CORE = {
    "ndvi_mean": "optical",
    "ndbi_mean": "optical",
    "ndwi_mean": "optical",
    "viirs_avg_rad_mean": "activity",
    "era5_temperature_mean": "weather",
    "era5_precipitation_total": "weather",
    "era5_wind_speed_mean": "weather",
}
OPTICAL = ("ndvi_mean", "ndbi_mean", "ndwi_mean", "ndvi_std", "ndbi_std", "ndwi_std")
PRIMARY = (*OPTICAL, "viirs_avg_rad_mean", "viirs_avg_rad_std", "era5_temperature_mean", "era5_temperature_min", "era5_temperature_max", "era5_precipitation_total", "era5_wind_speed_mean", "era5_wind_speed_max")
QUALITY = ("valid_pixel_count", "valid_pixel_fraction", "viirs_cf_cvg_mean", "viirs_cf_cvg_min", "viirs_cf_cvg_max", "viirs_valid_pixel_count", "viirs_valid_pixel_fraction", "era5_observation_count", "era5_source_lat", "era5_source_lon")
_TYPES = {"string": T.StringType, "double": T.DoubleType, "long": T.LongType, "int": T.IntegerType, "boolean": T.BooleanType}


def _schema(columns: str) -> T.StructType:
    """A schema from "name type, ..." without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]()) for name, kind in (c.split() for c in columns.split(", "))])


_DOUBLES = "ndvi_mean ndbi_mean ndwi_mean ndvi_std ndbi_std ndwi_std"
PANEL = _schema(
    "cell_id string, month string, start_date string, end_date string, "
    + ", ".join(f"{c} double" for c in _DOUBLES.split())
    + ", valid_pixel_count long, valid_pixel_fraction double, viirs_avg_rad_mean double, viirs_avg_rad_std double, viirs_cf_cvg_mean double, viirs_cf_cvg_min long, viirs_cf_cvg_max long, viirs_valid_pixel_count long, viirs_valid_pixel_fraction double, "
    "era5_temperature_mean double, era5_temperature_min double, era5_temperature_max double, era5_precipitation_total double, era5_wind_speed_mean double, era5_wind_speed_max double, era5_observation_count long, era5_source_lat double, era5_source_lon double"
)
CLIMATOLOGY = _schema("cell_id string, calendar_month int, feature string, n_observations long, mean double, median double, std double, mad double, q1 double, q3 double, iqr double, min double, max double, zero_mad_flag boolean")


@dataclass(frozen=True)
class EngineConfig:
    """Thresholds and horizons; the defaults are the engine's documented ones."""

    cloud_pct: float = 20.0
    fallback_cloud_pct: float = 40.0
    inclusive: bool = True
    clear_classes: tuple[int, ...] = (2, 4, 5, 6, 7)
    expected_pixels: int = 625
    zero_mad: float = 1e-9
    tau: float = 3.0
    min_baseline: int = 2
    candidate_score: float = 0.5
    coherent_cells: int = 2
    baseline: tuple[str, str] = ("2022-04", "2025-04")
    operational: tuple[str, str] = ("2026-01", "2026-07")

    @classmethod
    def from_environment(cls, environ: Mapping[str, str] = os.environ, prefix: str = "GRIDWATCH_") -> EngineConfig:
        """The defaults with overrides: a variable is the prefix and a field's name in capitals; lists are comma-separated."""
        found = {}
        for f in fields(cls):
            if (text := environ.get(prefix + f.name.upper())) is None:
                continue
            if isinstance(f.default, bool):
                found[f.name] = text.strip().lower() in ("1", "true", "yes")
            elif isinstance(f.default, tuple):
                found[f.name] = tuple(type(f.default[0])(x.strip()) for x in text.split(","))
            else:
                found[f.name] = type(f.default)(text)
        return cls(**found)
