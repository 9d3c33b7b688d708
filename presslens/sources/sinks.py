"""Files written: predictions, metrics, models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame


def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8") -> None:
    """CSV with a header and doubled quotes, one file per task."""
    if not encoding.upper().startswith("UTF-"):
        df.sparkSession.conf.set("spark.sql.legacy.javaCharsets", "true")
    writer = df.write.mode("overwrite").option("header", True).option("escape", '"').option("encoding", encoding)
    # Spark trims fields on writing unless told not to.
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def write_metrics(metrics: DataFrame, path: str) -> None:
    """The one-row metrics table as a JSON line."""
    metrics.write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_train(path: str, train: Callable[[], PipelineModel]) -> PipelineModel:
    """The model saved at ``path``; if there is none, train one and save it."""
    try:
        return PipelineModel.load(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    model = train()
    save_model(model, path)
    return model
