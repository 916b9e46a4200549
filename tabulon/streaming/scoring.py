"""Scoring a stream of records with a stored model."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.models import Model
from ..operators.scoring import score
from ..sources.sinks import prediction_log_entry


def score_stream(
    stream: DataFrame, model: Model, out: str, log: str, checkpoint: str, model_id: str = "model",
    mapping: Mapping[str, str] | None = None, available_now: bool = True,
) -> StreamingQuery:
    """Write every scored record to ``out`` and one entry per micro-batch to ``log``.

    Both go into a folder named after the batch and replace it, so a batch that is
    run again after a failure does not count twice.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        scored = score(batch, model, mapping).persist()
        try:
            scored.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")
            prediction_log_entry(scored, model_id, batch_id).drop("batch_id").write.mode("overwrite").parquet(f"{log}/batch={batch_id}")
        finally:
            scored.unpersist()

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def read_scored(spark, out: str) -> DataFrame:
    return spark.read.parquet(out).withColumn("batch", F.col("batch").cast("long"))
