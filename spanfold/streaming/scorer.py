"""Structured Streaming scorer: weight new documents with a fitted model.

Every step up to the term weights is per document, so each micro-batch is
scored with the batch ``transform`` of the model (stream-static: the fitted
vocabulary is a static, checkpointed table) inside ``foreachBatch``, and the
result is appended to a Parquet sink.  No streaming state is kept; the
stream's own checkpoint makes the sink exactly-once per batch id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.vectorizer import VectorizerModel
from ..session import discard, write_table


def score_stream(spark: SparkSession, model: VectorizerModel, source_dir: str, schema,
                 sink_dir: str, checkpoint_dir: str, max_files_per_trigger: int = 1) -> None:
    """Run the scorer until the source folder is drained (``availableNow``)."""
    stream = (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
              .parquet(source_dir))

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        counted = model.counted(batch.select("doc_id", "text"))
        out = model.weights(counted)
        # one folder per batch id, overwritten on a retry: the sink stays exactly-once
        write_table(out, f"{sink_dir}/batch_id={batch_id}", "overwrite")
        discard(counted)

    q = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_dir)
         .trigger(availableNow=True).start())
    q.awaitTermination()


def read_scores(spark: SparkSession, sink_dir: str) -> DataFrame:
    return spark.read.parquet(sink_dir).select("doc_id", "term", "weight")
