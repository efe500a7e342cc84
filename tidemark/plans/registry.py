"""All queries of the engine by name, with the SQL that gives the same rows where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import backtest, panel
from ..sources.tables import table
from . import files, inferences, kernels, relational, reports  # noqa: F401  files, inferences and reports add to the relational queries


def _six(f):
    return lambda spark, folder: relational.rounded(f(spark, folder), 6)


#: Kernels that SQL can draw along with give six digits, as the SQL does.
QUERIES = relational.QUERIES | {k: _six(f) if k in relational.SQL else f for k, f in kernels.QUERIES.items()}
SQL: dict[str, str] = relational.SQL | kernels.SQL


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    """Weekly prices, fill, log returns, synchronous filter, and the monthly rebalanced equal-weight path."""
    px = panel.price_panel(table(spark, folder, "lineitem"), "week")
    return backtest.static_backtest(panel.synchronous(panel.log_returns(panel.ffill(px))))
