"""Every query of the engine and, where SQL can express it, its SQL."""

from __future__ import annotations

import importlib

from pyspark.sql import DataFrame, SparkSession

from ..session import ship
from .registry import QUERIES, SQL, Query

for _name in ("set_queries", "window_queries", "calibration_queries", "text_queries", "gate_queries", "case_queries", "source_queries", "more_queries", "review_queries"):
    importlib.import_module(f"{__package__}.{_name}")


def _shipped(f: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def queries() -> dict[str, Query]:
    return {name: _shipped(f) for name, f in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
