"""Typed readers and writers with missing values as null at every boundary."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import missing


def nan_to_null(df: DataFrame) -> DataFrame:
    floats = {f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))}
    return df.select(*[missing(F.col(f"`{c}`")).alias(c) if c in floats else F.col(f"`{c}`") for c in df.columns])


def read_parquet(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    return nan_to_null((spark.read.schema(schema) if schema else spark.read).parquet(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return nan_to_null(spark.read.schema(schema).option("header", True).csv(path))


def read_geojson_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid cells from the properties of a FeatureCollection."""
    props = "cell_id string, row int, col int, index int, centroid_lon double, centroid_lat double, min_lon double, max_lon double, min_lat double, max_lat double, approx_width_m double, approx_height_m double"
    schema = T.StructType.fromDDL("features array<struct<type: string, properties: struct<" + ", ".join(p.replace(" ", ": ", 1) for p in props.split(", ")) + ">>>")
    return spark.read.schema(schema).option("multiLine", True).json(path).select(F.explode("features").alias("f")).select("f.properties.*")


#: The order in which tables are written.
CANONICAL = ("cell_id", "month")


def canonical(df: DataFrame, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` in canonical order over all files: by those of CANONICAL that it has; within partition folders, by what is left."""
    order = [c for c in CANONICAL if c in df.columns and c not in partition_by]
    if partition_by:
        return df.repartitionByRange(*partition_by, *order).sortWithinPartitions(*partition_by, *order)
    return df.orderBy(*order) if order else df


def write_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = (), mode: str = "errorifexists") -> None:
    canonical(df, partition_by).write.mode(mode).partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One header a part; missing values are empty; in canonical order."""
    canonical(df).write.mode(mode).option("header", True).csv(path)


#: Features in one file.
COLLECTION = 10_000


def ring() -> Column:
    """A cell's outline as a closed ring of (lon, lat)."""
    return F.array(*[F.array(F.col(x), F.col(y)) for x, y in (("min_lon", "min_lat"), ("max_lon", "min_lat"), ("max_lon", "max_lat"), ("min_lon", "max_lat"), ("min_lon", "min_lat"))])


def write_geojson_grid(grid: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """FeatureCollections of up to COLLECTION cells, one a file, each cell with its ring and properties, in order of cell_id; read_geojson_grid reads the folder."""
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring()).alias("coordinates")).alias("geometry"), F.struct(*grid.columns).alias("properties"))
    cells = grid.orderBy("cell_id").select(F.floor(F.monotonically_increasing_id() / COLLECTION).alias("file"), F.struct("cell_id", feature.alias("feature")).alias("cell"))
    whole = cells.groupBy("file").agg(F.transform(F.array_sort(F.collect_list("cell")), lambda c: c["feature"]).alias("features"))
    text = whole.select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    text.write.mode(mode).option("maxRecordsPerFile", 1).text(path)


def reuse_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The table at ``path`` if it was written whole, else ``build()``'s rows, written there first."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def probe(df: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """A row per required column: whether it is there, rows, non-null values, min, mean and max; one pass over the table."""
    exprs = []
    for c in required:
        x = F.col(c).cast("double") if c in df.columns else F.lit(None).cast("double")
        exprs.append(F.struct(F.lit(c).alias("column_name"), F.lit(c in df.columns).alias("present"), F.count("*").alias("n_rows"), F.count(x).alias("n_values"), F.min(x).alias("min_value"), F.round(F.avg(x), 4).alias("mean_value"), F.max(x).alias("max_value")))
    one = df.agg(*[e.alias(f"c{i}") for i, e in enumerate(exprs)])
    return one.select(F.explode(F.array(*[f"c{i}" for i in range(len(exprs))])).alias("p")).select("p.*")


def duplicate_keys(df: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    return df.groupBy(*keys).count().filter("count > 1")


def shape_check(df: DataFrame, keys: tuple[str, ...], counts: dict[str, str]) -> DataFrame:
    """One row: rows, distinct keys, duplicated keys, and the distinct count of each of ``counts``' columns."""
    exprs = [F.count("*").alias("n_rows"), F.count_distinct(F.struct(*keys)).alias("n_keys"), *[F.count_distinct(c).alias(a) for a, c in counts.items()]]
    return df.agg(*exprs).withColumn("n_repeated", F.col("n_rows") - F.col("n_keys"))
