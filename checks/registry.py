"""Registry of queries and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from checks.views import oracle_text, spark_view
from vaultlens import configure

View = Callable[[str], DataFrame]

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    """Register a function of the views; ``oracle`` names views with ``@``."""

    def register(build: Callable[[View], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            configure(spark)
            return build(lambda view: spark_view(spark, sf_dir, view))

        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle_text(oracle)
        return build

    return register
