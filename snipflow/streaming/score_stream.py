"""H3: streaming analysis. Submissions arrive as JSON files; each micro-batch
runs the batch job (H1) and is written under its batch id: that folder is the batch's
commit. A batch that is tried again, after a failure or a restart from the checkpoint,
overwrites its own folder instead of duplicating it. ``max_files`` bounds a batch, and
the steps that a batch writes on the way are deleted when it ends, also when it fails.

foreachBatch is used because the features aggregate per snippet after an
explode and several joins, which a single streaming plan cannot express.
"""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from snipflow.operators.scoring import analyse
from snipflow.session import scratch_scope
from snipflow.sources.io import read_submissions


def start(spark: SparkSession, in_dir: str, out_dir: str, checkpoint: str, fitted: PipelineModel,
          available_now: bool = True, max_files: int = 1000):
    """Start the stream, or go on with it; returns the StreamingQuery."""
    subs = read_submissions(spark, in_dir, stream=True, max_files=max_files)

    def run_batch(batch: DataFrame, batch_id: int) -> None:
        with scratch_scope(spark):
            res = analyse(batch, fitted)
            (res.select("sub_id", "status", "detail", "algorithm", "confidence",
                        F.to_json("complexity").alias("complexity"), F.to_json("features").alias("features"))
             .write.mode("overwrite").parquet(f"{out_dir}/batch_id={batch_id}"))

    w = subs.writeStream.foreachBatch(run_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
