"""Model files and the run table (name, start time, params, metrics, model path)."""

from __future__ import annotations

import datetime as _dt
import re
import uuid
from collections.abc import Mapping

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shelfspark.schemas import RUNS
from shelfspark.sources.batches import append_batch, compact, read_batches


def save_model(model: PipelineModel, path: str) -> str:
    """A5: write a fitted pipeline (overwrite)."""
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> PipelineModel:
    """A5: read a fitted pipeline."""
    return PipelineModel.load(path)


def new_run_id() -> str:
    return uuid.uuid4().hex


def log_run(spark: SparkSession, runs_path: str, experiment: str, name: str, params: Mapping,
            metrics: Mapping[str, float], model_path: str | None = None, run_id: str | None = None) -> str:
    """Append one run record to the run table as a committed batch named by its run id;
    concurrent runs keep both records, a repeated run id is ignored. Returns the run id."""
    run_id = run_id or new_run_id()
    row = (run_id, experiment, name, model_path, _dt.datetime.now(_dt.timezone.utc),
           {str(k): str(v) for k, v in params.items()}, {str(k): float(v) for k, v in metrics.items()})
    append_batch(spark.createDataFrame([row], RUNS).coalesce(1), runs_path, "parquet", re.sub(r"\W", "_", run_id))
    return run_id


def read_runs(spark: SparkSession, runs_path: str) -> DataFrame:
    """All committed runs: the newest snapshot and the batches after it."""
    return read_batches(spark, runs_path, "parquet", RUNS).drop("batch")


def compact_runs(spark: SparkSession, runs_path: str) -> bool:
    """Merge the one-row batches into a snapshot."""
    return compact(spark, runs_path, "parquet", RUNS)


def latest_run(runs: DataFrame, experiment: str, name: str | None = None) -> DataFrame:
    """The newest run of an experiment, of one model name if given (ties to the larger
    run id); empty if none."""
    own = F.col("experiment") == experiment
    if name is not None:
        own = own & (F.col("name") == name)
    return runs.where(own).orderBy(F.col("start_time").desc(), F.col("run_id").desc()).limit(1)


def require_latest_model(spark: SparkSession, runs_path: str, experiment: str, name: str | None = None) -> PipelineModel:
    """Load the model of the newest run, with a clear error when there is none."""
    row = latest_run(read_runs(spark, runs_path), experiment, name).select("model_path").first()
    if row is None or row[0] is None:
        raise LookupError(f"no run with a model for experiment {experiment!r}, name {name!r}")
    return load_model(row[0])
