"""Tables by month that rebuild only what changed.

A manifest has, for each month, the fingerprint of all that its rows are made from and the build that made them. A refresh builds stale
and missing months into a folder of their own, and commits them by the next manifest: one folder that is there as a whole or not at
all. Readers see the old months until then; a failed build leaves nothing that is read."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "month string, fingerprint string, build string"


def _entries(spark: SparkSession, path: str) -> list[str]:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []


def latest_version(spark: SparkSession, path: str) -> int:
    """The number of the last committed manifest; 0 before the first."""
    names = [n for n in _entries(spark, f"{path}/manifest") if n.startswith("version=")]
    whole = [int(n.split("=")[1]) for n in names if "_SUCCESS" in _entries(spark, f"{path}/manifest/{n}")]
    return max(whole, default=0)


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    version = latest_version(spark, path) if version is None else version
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={version}") if version else spark.createDataFrame([], MANIFEST)


def fingerprints(inputs: dict[str, DataFrame], settings: object = None) -> DataFrame:
    """month and fingerprint: of the month's rows in every input (whatever their order), the inputs' columns, and the settings."""
    parts = None
    for name, df in sorted(inputs.items()):
        row = F.xxhash64(F.lit(name), *[F.coalesce(F.to_json(F.struct(f"`{c}`")), F.lit("")) for c in sorted(df.columns)])
        one = df.groupBy("month").agg(F.count("*").alias("n"), F.bit_xor(row).alias("x"), F.sum(F.shiftright(row, 20).cast("decimal(38,0)")).alias("s")).select("month", F.concat_ws(":", F.lit(name), "n", "x", "s").alias("part"))
        parts = one if parts is None else parts.unionByName(one)
    of = F.concat_ws("|", F.lit(json.dumps(settings, sort_keys=True, default=str)), F.array_sort(F.collect_list("part")))  # one a table
    return parts.filter("month IS NOT NULL").groupBy("month").agg(F.sha2(of.cast("binary"), 256).alias("fingerprint"))


def refresh(spark: SparkSession, path: str, inputs: dict[str, DataFrame], build: Callable[[dict[str, DataFrame]], DataFrame], settings: object = None) -> list[str]:
    """Builds the months whose inputs or settings changed, drops those that no input has any more, and commits. Gives the months that were built.

    ``build`` gets the inputs with only these months' rows; its result must have ``month``. A calendar's months are few: the manifest
    fits on the driver."""
    version = latest_version(spark, path)
    old = {r.month: r for r in manifest(spark, path, version).collect()}
    now = {r.month: r.fingerprint for r in fingerprints(inputs, settings).collect()}
    stale = sorted(m for m, f in now.items() if m not in old or old[m].fingerprint != f)
    if not stale and set(now) == set(old):
        return []
    name = uuid.uuid4().hex
    if stale:
        rows = build({k: df.filter(F.col("month").isin(stale)) for k, df in inputs.items()}).filter(F.col("month").isin(stale))
        rows.repartition("month").write.partitionBy("month").parquet(f"{path}/data/build={name}")
    entries = [(m, f, name if m in stale else old[m].build) for m, f in sorted(now.items())]
    spark.createDataFrame(entries, MANIFEST).coalesce(1).write.mode("errorifexists").parquet(f"{path}/manifest/version={version + 1}")
    return stale


def read_months(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The table as of the last commit, or of an earlier version. A month whose build gave no row has none."""
    entries = manifest(spark, path, version).collect()
    folders = {b: set(_entries(spark, f"{path}/data/build={b}")) for b in {r.build for r in entries}}
    paths = [f"{path}/data/build={r.build}/month={r.month}" for r in entries if f"month={r.month}" in folders[r.build]]
    if not paths:
        raise ValueError(f"no month of {path} has rows")
    schema = spark.read.option("basePath", f"{path}/data").parquet(paths[0]).schema
    return spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*paths).withColumn("month", F.col("month").cast("string")).drop("build")
