"""New months as a stream: each micro-batch of panel rows is scored against the frozen climatology.

Rows of a month may arrive in several batches: scores need nothing but a row and its profile. Events need
whole months and are formed from the written scores once a month is complete.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import scoring
from ..schemas import PANEL, EngineConfig


def panel_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Panel files as they appear in a folder."""
    reader = spark.readStream.schema(PANEL)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def score_stream(panel: DataFrame, climatology: DataFrame, out: str, checkpoint: str, cfg: EngineConfig = EngineConfig()) -> StreamingQuery:
    """Scores all that is there and ends. A batch that is run again replaces its own rows, so each row is scored exactly once."""

    def each(batch: DataFrame, batch_id: int) -> None:
        scoring.score(batch, climatology, cfg).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return panel.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def complete_months(scores: DataFrame, n_cells: int) -> DataFrame:
    """Months whose cells have all been scored."""
    return scores.groupBy("month").agg(F.count_distinct("cell_id").alias("cells")).filter(F.col("cells") == n_cells).select("month")
