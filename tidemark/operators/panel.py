"""Panels: clean prices, fill, resample, take log returns, and keep synchronous days.

A panel is long: (dt DATE, asset STRING, px or r DOUBLE). Windows run within one asset; what a day needs from all
assets is an aggregation by day. Both keep partial results on the map side, so a panel of any number of days costs
one shuffle by asset and one by day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CASH_LIKE = ("cash",)


def by_asset(*order: str) -> Window:
    return Window.partitionBy("asset").orderBy(*(order or ("dt",)))


def clean_wide(raw: DataFrame, master: DataFrame | None = None, date_col: str = "date") -> DataFrame:
    """A wide price table (a date column and one column per ticker) as a long panel (dt, asset, px).

    Dates and numbers that cannot be read become null; rows without a date go; columns named ``Unnamed...`` go;
    with ``master`` (bbg_ticker, name) only its tickers stay, under their names.
    """
    if date_col not in raw.columns:
        raise ValueError(f"a price table needs a column {date_col!r}")
    tickers = [c for c in raw.columns if c != date_col and not c.startswith("Unnamed")]
    dated = raw.select(F.expr(f"CAST(try_to_timestamp(CAST(`{date_col}` AS STRING)) AS DATE)").alias("dt"), *(F.col(f"`{c}`").cast("string").try_cast("double").alias(c) for c in tickers)).filter("dt IS NOT NULL")
    long = dated.unpivot(["dt"], tickers, "ticker", "px").withColumn("px", F.when(~F.isnan("px"), F.col("px")))
    if master is None:
        return long.withColumnRenamed("ticker", "asset")
    if not {"bbg_ticker", "name"} <= set(master.columns):
        raise ValueError("a master needs the columns bbg_ticker and name")
    names = master.select(F.col("bbg_ticker").alias("ticker"), F.col("name").alias("asset"))
    return long.join(names, "ticker").select("dt", "asset", "px")


def price_panel(lines: DataFrame, bucket: str | None = None) -> DataFrame:
    """Volume-weighted price by day (or by ``bucket``: week, month, quarter) and (returnflag, linestatus)."""
    day = F.to_date("l_shipdate") if bucket is None else F.to_date(F.date_trunc(bucket, "l_shipdate"))
    asset = F.concat_ws("_", "l_returnflag", "l_linestatus")
    value, volume = F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), F.sum("l_quantity")
    return lines.filter(F.col("l_shipdate").isNotNull()).groupBy(day.alias("dt"), asset.alias("asset")).agg(F.try_divide(value, volume).alias("px"))


def date_range(prices: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive. Applied before filling, so that no value is carried in from before ``start``."""
    if start is not None:
        prices = prices.filter(F.col("dt") >= F.lit(start).cast("date"))
    return prices if end is None else prices.filter(F.col("dt") <= F.lit(end).cast("date"))


def assets_of(panel: DataFrame) -> list[str]:
    """The assets of a panel: as many as a wide table has columns."""
    return [r["asset"] for r in panel.select("asset").distinct().orderBy("asset").collect()]


def complete(prices: DataFrame, assets: Sequence[str] | None = None) -> DataFrame:
    """A row for every day and asset; px is null where there is none."""
    names = list(assets) if assets is not None else assets_of(prices)
    spine = prices.select("dt").distinct().select("dt", F.explode(F.array(*map(F.lit, names))).alias("asset"))
    return spine.join(prices, ["dt", "asset"], "left")


def ffill(prices: DataFrame, assets: Sequence[str] | None = None) -> DataFrame:
    """Complete panel with the last known price of each asset; null before its first."""
    w = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    return complete(prices, assets).withColumn("px", F.last("px", ignorenulls=True).over(w))


def resample(prices: DataFrame, frequency: str, assets: Sequence[str] | None = None) -> DataFrame:
    """``daily``; ``weekly`` to Fridays and ``monthly`` to month ends: the last price of each bucket, then filled.

    Buckets without any price between the first and the last are rows too, filled from the bucket before.
    """
    kind = frequency.lower()
    if kind not in ("weekly", "monthly"):
        return ffill(prices, assets)
    bucket = F.next_day(F.date_sub("dt", 1), "FRI") if kind == "weekly" else F.last_day("dt")
    last = prices.filter("px IS NOT NULL").groupBy(bucket.alias("dt"), "asset").agg(F.max_by("px", "dt").alias("px"))
    names = list(assets) if assets is not None else assets_of(prices)
    ends = prices.agg(F.min(bucket).alias("lo"), F.max(bucket).alias("hi")).filter("lo IS NOT NULL")
    days = F.sequence("lo", "hi", F.expr("interval 7 days")) if kind == "weekly" else F.transform(F.sequence(F.trunc("lo", "month"), F.trunc("hi", "month"), F.expr("interval 1 month")), F.last_day)
    spine = ends.select(F.explode(days).alias("dt")).select("dt", F.explode(F.array(*map(F.lit, names))).alias("asset"))
    w = by_asset().rowsBetween(Window.unboundedPreceding, 0)
    return spine.join(last, ["dt", "asset"], "left").withColumn("px", F.last("px", ignorenulls=True).over(w))


def log_returns(prices: DataFrame) -> DataFrame:
    """(dt, asset, r) of a filled panel; a price that is not positive has no logarithm. Days without any return go."""
    log = F.when(F.col("px") > 0, F.ln("px"))
    r = prices.withColumn("l", log).withColumn("r", F.col("l") - F.lag("l").over(by_asset()))
    day = Window.partitionBy("dt")
    return r.withColumn("n", F.count("r").over(day)).filter("n > 0").select("dt", "asset", "r")


def complete_cases(returns: DataFrame, n_assets: int) -> DataFrame:
    """Only days on which all assets have a return."""
    days = returns.groupBy("dt").agg(F.count("r").alias("n")).filter(F.col("n") == n_assets).select("dt")
    return returns.join(days, "dt", "left_semi")


def synchronous(returns: DataFrame, exempt: Sequence[str] = CASH_LIKE) -> DataFrame:
    """Days on which every asset that is not exempt moved, and all returns are finite.

    Exempt names that the panel lacks do not matter; a panel in which all assets are exempt is an error.
    """
    moved = F.bool_and((F.col("r") != 0) | F.col("asset").isin(*exempt) if exempt else F.col("r") != 0)
    finite = F.bool_and(F.coalesce(F.abs("r") < float("inf"), F.lit(False)))
    days = returns.groupBy("dt").agg(moved.alias("moved"), finite.alias("finite"), F.count_if(~F.col("asset").isin(*exempt) if exempt else F.lit(True)).alias("tested"))
    days = days.withColumn("ok", F.when(F.col("tested") == 0, F.raise_error(F.lit("every asset is exempt from the test"))).otherwise(F.col("moved") & F.col("finite")))
    return returns.join(days.filter("ok").select("dt"), "dt", "left_semi")


def wide(panel: DataFrame, value: str, assets: Sequence[str]) -> DataFrame:
    return panel.groupBy("dt").pivot("asset", list(assets)).agg(F.first(value))


def vectors(returns: DataFrame, assets: Sequence[str] | None = None) -> DataFrame:
    """(t, dt, x): one row per day with its returns in order of ``assets``, and its place from 0."""
    rows = returns.groupBy("dt").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "r"))), lambda s: s["r"]).alias("x"))
    return rows.select((F.row_number().over(Window.orderBy("dt")) - 1).cast("long").alias("t"), "dt", "x")


def summarise(returns: DataFrame) -> DataFrame:
    """Per asset: first and last day (of the whole panel), observations, mean, volatility, least and greatest."""
    whole = Window.partitionBy()  # over one row per asset
    by = returns.groupBy("asset").agg(F.min("dt").alias("a"), F.max("dt").alias("b"), F.count("r").alias("n_obs"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("vol"), F.min("r").alias("min"), F.max("r").alias("max"))
    return by.select("asset", F.min("a").over(whole).alias("start_date"), F.max("b").over(whole).alias("end_date"), "n_obs", "mean", "vol", "min", "max")


def bucket_of(frequency: str, day: Column) -> Column:
    """Calendar bucket of rebalancing: M month, W week from Monday, Q quarter, D day."""
    return {"M": F.date_trunc("month", day), "W": F.date_trunc("week", day), "Q": F.date_trunc("quarter", day), "D": day.cast("timestamp")}[frequency]


def rebalance_dates(days: DataFrame, frequency: str = "M") -> DataFrame:
    """The last day of the panel in each bucket."""
    return days.groupBy(bucket_of(frequency, F.col("dt")).alias("b")).agg(F.max("dt").alias("dt")).select("dt")


PANEL_SCHEMA = T.StructType([T.StructField("dt", T.DateType()), T.StructField("asset", T.StringType()), T.StructField("px", T.DoubleType())])
