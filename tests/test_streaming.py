"""The stateful stream over files against the batch operators on the whole panel."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import mixture, panel
from tidemark.streaming import scoring

ASSETS = ("a", "b", "cash")
DAY = "dt date, px array<double>"


@pytest.fixture(scope="module")
def prices():
    """Days of three series with gaps before and after the first price, days on which one stands still, a bad price, idle cash."""
    rng = np.random.default_rng(3)
    px = 100 * np.exp(np.cumsum(rng.normal(0, 0.01, (90, 3)), 0))
    px[:, 2] = 1.0
    out = [[None if rng.random() < 0.1 else float(v) for v in row] for row in px]
    out[0][1] = None
    out[40][0] = out[39][0] = 50.0
    out[60][1] = -1.0
    start = dt.date(2024, 1, 1)
    return [(start + dt.timedelta(i), row) for i, row in enumerate(out)]


def models(spark, ends):
    rng = np.random.default_rng(5)
    rows = []
    for config in ("x", "y"):
        for w, e in enumerate(ends):
            k = 2 + w % 2
            rows.append((config, w, e, rng.normal(0, 0.01, (k, 3)).tolist(), [(np.eye(3) * s).tolist() for s in rng.uniform(1e-4, 1e-3, k)], [1 / k] * k))
    return spark.createDataFrame(rows, f"config_id string, {scoring.MODEL}")


def batch(spark, prices, fits):
    long = spark.createDataFrame([(d, a, v) for d, row in prices for a, v in zip(ASSETS, row)], "dt date, asset string, px double")
    days = panel.vectors(panel.synchronous(panel.log_returns(panel.ffill(long, ASSETS)))).persist()
    # the place of each window's end among the days that are left: those up to its date
    ends = fits.join(days.select("t", F.col("dt").alias("day")), F.col("day") <= F.col("end_dt"), "left").groupBy("config_id", "w").agg(F.coalesce(F.max("t"), F.lit(-1)).alias("e"))
    full = fits.join(ends, ["config_id", "w"]).withColumn("K", F.size("weights"))
    return {(r.config_id, r.dt, r.w, r.k): r.p for r in mixture.filtered_probabilities(days, full).collect()}


def put(spark, rows, schema, folder, n):
    """One file whose time of change is its number, so that the stream takes it in that order."""
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    for f in os.listdir(folder):
        at = os.path.join(folder, f)
        if f.endswith(".parquet") and os.path.getmtime(at) > 1e9 + 1e6:
            os.utime(at, (1e9 + n, 1e9 + n))


def served(spark, path):
    return {(r.config_id, r.dt, r.w, r.k): r.p for r in spark.read.schema(scoring.SERVED).parquet(path).collect()}


def same(got, want):
    assert got.keys() == want.keys() and len(want) > 100
    assert all(got[k] == pytest.approx(p, abs=1e-12) for k, p in want.items())


def test_stream_gives_the_rows_of_the_batch(spark, prices, tmp_path):
    days, out, state = (str(tmp_path / n) for n in ("days", "out", "state"))
    fits = models(spark, [prices[i][0] for i in (9, 29, 49, 69)])
    shuffled = np.random.default_rng(0).permutation(15).tolist()
    for n, a in enumerate(range(0, 60, 15)):
        put(spark, [prices[a + i] for i in shuffled] + prices[a : a + 2], DAY, days, n)  # any order inside a batch, repeated days

    def stream():
        flow = spark.readStream.schema(DAY).option("maxFilesPerTrigger", 1).parquet(days)
        scoring.start(scoring.one_sided_stream(flow, fits, ("x", "y"), ASSETS), out, state, once=True).awaitTermination()

    stream()
    same(served(spark, out), batch(spark, prices[:60], fits))
    put(spark, prices[60:75], DAY, days, 10)  # the stream goes on from its state, then takes no day twice
    put(spark, prices[50:75] + prices[75:], DAY, days, 11)
    stream()
    same(served(spark, out), batch(spark, prices, fits))


def test_models_arrive_by_stream(spark, prices, tmp_path):
    days, fresh, out, state = (str(tmp_path / n) for n in ("days", "fresh", "out", "state"))
    ends = [prices[i][0] for i in (9, 49)]
    fits = models(spark, ends)
    put(spark, prices[:45], DAY, days, 0)
    put(spark, [r for r in fits.filter("w < 0").collect()], fits.schema, fresh, 0)

    def stream():
        flow, new = spark.readStream.schema(DAY).parquet(days), spark.readStream.schema(fits.schema).parquet(fresh)
        scoring.start(scoring.one_sided_stream(flow, fits.filter("w = 0"), ("x", "y"), ASSETS, new), out, state, once=True).awaitTermination()

    stream()
    put(spark, fits.filter("w = 1").collect(), fits.schema, fresh, 5)
    put(spark, prices[45:], DAY, days, 5)
    stream()
    same(served(spark, out), batch(spark, prices, fits))


def test_all_exempt(spark, prices):
    with pytest.raises(ValueError, match="exempt"):
        scoring.one_sided_stream(spark.createDataFrame(prices, DAY), models(spark, [prices[9][0]]), ("x",), ("cash",))
