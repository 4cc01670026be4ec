"""Predict notes as their files arrive, with the same steps as a batch run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from staycoder.sources.sinks import prediction_output


def read_stream(spark: SparkSession, path: str, schema: StructType, max_files: int = 1000) -> DataFrame:
    """Stream of parquet note files; the columns must include doc_key and text."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def start_predictions(
    notes: DataFrame, step: Callable[[DataFrame], DataFrame], output_path: str, checkpoint: str
) -> StreamingQuery:
    """Run `step` (see plans.predict.build) on every micro-batch.

    A micro-batch replaces its own output folder, so one that is run again after a failure leaves
    no duplicate. Pooling stays within a note, and a note arrives in one row, so no state is kept.
    """

    def predict_batch(batch: DataFrame, batch_id: int) -> None:
        predicted = prediction_output(batch.transform(step))
        predicted.write.mode("overwrite").parquet(f"{output_path}/batch={batch_id}")

    query = notes.writeStream.foreachBatch(predict_batch).option("checkpointLocation", checkpoint)
    return query.trigger(availableNow=True).start()
