"""Stored models and live scoring: one JSON file of formulas, weights and the features they read."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ridgeline.functions.formula import columns_of, explain_nodes, parse, score
from ridgeline.operators.features import live_latest
from ridgeline.operators.selection import both_sides


@dataclass
class StoredModel:
    formulas: list[str]
    weights: list[float]
    features: list[str]
    dialect: str = "plain"

    def check(self) -> StoredModel:
        """An error unless there is one weight per formula and no formula reads a feature that isn't listed."""
        if len(self.formulas) != len(self.weights):
            raise ValueError(f"mismatched model: {len(self.formulas)} formulas, {len(self.weights)} weights; they must come from one mining and combination pass")
        if unlisted := sorted(set().union(*(columns_of(parse(t)) for t in self.formulas)) - set(self.features)):
            raise ValueError(f"formulas read features that the model doesn't list: {unlisted}")
        return self


def save_model(spark: SparkSession, path: str, model: StoredModel) -> None:
    """Write one JSON document; formulas are kept as text."""
    spark.createDataFrame([(json.dumps(asdict(model.check())),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> StoredModel:
    try:
        (row,) = spark.read.text(path, wholetext=True).collect()  # one document
    except Exception as error:
        raise ValueError(f"no model at {path}: run a mining and a combination pass first") from error
    return StoredModel(**json.loads(row.value)).check()


def check_columns(rows: DataFrame, wanted: list[str]) -> None:
    if missing := sorted(set(wanted) - set(rows.columns)):
        raise ValueError(f"the live feature set lacks columns that the model reads: {missing}")


def score_live(operands: DataFrame, model: StoredModel) -> DataFrame:
    """The last date's rows with ``alpha``."""
    check_columns(operands, model.features)
    return score(live_latest(operands), model.formulas, model.weights, model.dialect)


def candidates(operands: DataFrame, model: StoredModel, n: int = 15, per_sector: int | None = None) -> DataFrame:
    """``ticker, sector, alpha, side``: the longest and shortest lists of the last date."""
    return both_sides(score_live(operands, model).select("ticker", "sector", "alpha"), n, per_sector)


def explain_ticker(operands: DataFrame, model: StoredModel, ticker: str) -> DataFrame:
    """``formula, weight`` and the explanation tree of each formula with a weight, for one ticker on the last date."""
    row, out = live_latest(operands).where(F.col("ticker") == ticker), None
    for text, w in zip(model.formulas, model.weights, strict=True):
        if abs(w) > 1e-10:
            one = explain_nodes(row, text, model.dialect).select(F.lit(text).alias("formula"), F.lit(float(w)).alias("weight"), "*")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no formula of the model has a weight")
    return out
