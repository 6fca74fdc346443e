"""Registry of named queries with the SQL that checks them."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from threadloom.plans.flow import Flow
from threadloom.session import SETTINGS, ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register ``fn(flow)`` under its own name, with its checking SQL if any."""

    def register(fn: Callable[[Flow], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            for key, value in SETTINGS.items():
                spark.conf.set(key, value)
            ship_package(spark)
            return fn(Flow(spark, sf_dir))

        run.__name__, run.__doc__ = fn.__name__, fn.__doc__
        QUERIES[fn.__name__] = run
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn

    return register
