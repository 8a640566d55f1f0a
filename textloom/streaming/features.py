"""A fitted model over a stream of documents: cleaned and weighted as they come, a batch at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from textloom.operators.features import TfidfModel


def stream_features(docs: DataFrame, model: TfidfModel, path: str, checkpoint: str, doc_id: str = "doc_id", text: str = "text") -> StreamingQuery:
    """Appends the features of every document of the stream to Parquet, with the batch's number; a batch that is repeated replaces its files.

    The model's tables are static, so the only state is the stream's own progress.
    """

    def write(batch: DataFrame, number: int) -> None:
        model.transform(batch, doc_id, text).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).start()
