"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest
from gridwatch.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
SAMPLE = ["scene_fallback", "grid_generate", "median_composite_zonal", "panel_full_outer", "seasonal_climatology", "score_robust_z", "streamed_scores", "spatial_events", "threshold_sweep", "feature_statistics", "spearman_pairs", "representative_cells", "csv_round_trip", "geojson_round_trip", "regression_gate", "ingestion_completeness", "input_shapes", "repeated_keys", "polygon_zonal", "polygon_weighted", "transverse_mercator", "resampled_pixels", "nearest_of_many", "collection_scan", "updated_climatology", "refreshed_months", "streamed_events", "pearson_pairwise"]


def shown(v):
    if v is None or v != v:
        return None
    return round(float(v), 6) + 0.0 if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", SAMPLE)
def test_query_matches_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    result = con.execute(ORACLE_SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted((tuple(shown(v) for v in r) for r in result.fetchall()), key=str)
    assert sorted(got.columns) == sorted(columns)
    assert sorted((tuple(shown(v) for v in r) for r in got.select(*[f"`{c}`" for c in columns]).collect()), key=str) == want


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE_SQL)
