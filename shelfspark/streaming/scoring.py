"""K3: score request rows as they arrive (the reference's prediction endpoints).

Stateless: conform -> score -> decide per micro-batch, so no watermark or state
store is needed; the checkpoint folder gives exactly-once file output.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from shelfspark.operators.engineer import conform
from shelfspark.operators.scoring import DECISION_CUT, decide, score


def score_stream(model: PipelineModel, requests: DataFrame, contract="post",
                 keep: Sequence[str] = ("product_id",), cut: float = DECISION_CUT) -> DataFrame:
    """Streaming (or batch) frame of decisions; rows failing the contract are kept with
    ``success = false``, their error text and no prediction."""
    checked = conform(requests, contract, keep)
    # one pass: rows that fail are scored like the others (missing features count as 0), then emptied
    filled = checked.fillna(0).fillna("")
    scored = decide(score(model, filled, keep=[*keep, "success", "error"]), cut)
    result = [c for c in scored.columns if c not in (*keep, "success", "error")]
    return scored.select(*keep, *[F.when(F.col("success"), F.col(c)).alias(c) for c in result], "success",
                         F.when(~F.col("success"), F.col("error")).alias("error"))


def start_scoring(spark: SparkSession, model: PipelineModel, source: str, schema, sink: str, checkpoint: str,
                  contract="post", keep: Sequence[str] = ("product_id",), available_now: bool = True,
                  processing_time: str | None = None, max_files_per_trigger: int | None = None) -> StreamingQuery:
    """Read Parquet request files from ``source`` as a stream and append decisions to ``sink``.

    ``max_files_per_trigger`` bounds each micro-batch (backlogs are worked off in
    several batches rather than one huge one).
    """
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", int(max_files_per_trigger))
    requests = reader.parquet(source)
    out = score_stream(model, requests, contract, keep)
    w = (out.writeStream.format("parquet").option("path", sink)
         .option("checkpointLocation", checkpoint).outputMode("append"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime=processing_time or "10 seconds")
    return w.start()
