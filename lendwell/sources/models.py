"""Saving, loading and checking fitted models."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lendwell.plans.training import model_inputs, with_probability


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def validate_model(path: str, sample: DataFrame) -> bool:
    """Load a saved model and score ``sample``: every probability must lie in 0 to 1."""
    model = load_model(path)
    p = F.col("default_probability")
    scored = with_probability(model, model_inputs(sample))
    counted = scored.agg(F.count(F.lit(1)).alias("rows"), F.count_if(p.between(0, 1)).alias("good")).first()
    if counted["rows"] == 0 or counted["rows"] != counted["good"]:
        raise ValueError(f"model at {path} gives no probability for some rows")
    return True
