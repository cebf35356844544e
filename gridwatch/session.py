"""Session settings that the library is written for."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(master: str = "local[*]", app: str = "gridwatch", **conf: str) -> SparkSession:
    """A session with DEFAULTS and ``conf`` (keys with ``__`` for dots)."""
    builder = SparkSession.builder.master(master).appName(app)
    for k, v in (DEFAULTS | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir. Only a local session without that setting gets a temporary folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="gridwatch-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


_scopes: ContextVar[tuple[list[str], ...]] = ContextVar("scopes", default=())


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Owns the intermediate tables that are made within the block: they go when it ends, also by an error.

    What a lazy result still reads goes as well, so results are written or collected inside. Scopes nest; each owns its own."""
    own: list[str] = []
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield
    finally:
        _scopes.reset(token)
        for path in own:
            delete(spark, path)


def own(spark: SparkSession, path: str) -> None:
    """Leaves a folder to the innermost scope, or to the driver's JVM, which deletes it at its end."""
    if scopes := _scopes.get():
        scopes[-1].append(path)
    else:
        fs, p = _fs(spark, path)
        fs.deleteOnExit(p)


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read again: what several later steps read is made once.

    The files go with the innermost scope, or when the driver's JVM ends."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    own(spark, path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
