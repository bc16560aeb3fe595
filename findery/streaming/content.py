"""Body text for documents as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from findery.operators.extract import extracted_content


def extract_batch(docs: DataFrame, structured: bool = True) -> DataFrame:
    """Extracted texts of a batch; a document that gives none stays, with a null text."""
    return extracted_content(docs, structured=structured, keep_empty=True)


def stream_extract_content(
    src: DataFrame, path: str, checkpoint: str, *, structured: bool = True, available_now: bool = False
) -> StreamingQuery:
    """Runs the batch operator on every micro-batch.

    A batch writes its own folder, so a batch repeated after a failure replaces itself.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        extract_batch(batch, structured).write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")

    trigger = {"availableNow": True} if available_now else {"processingTime": "5 seconds"}
    writer = src.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(**trigger).start()
