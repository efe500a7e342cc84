"""Queries through readers, writers and the stateful stream: what comes back has to be what SQL says of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drift, panel, regimes
from ..sources import tables, workbook
from ..streaming import scoring
from .inferences import _GIVEN, _density
from .kernels import _days
from .relational import _WIN, SQL, _log, prices, query, returns


@query("workbook_prices", SQL["weekly_resample"])
def _(s, d):
    """Weekly prices as a wide sheet beside a sheet that names its columns, written to a workbook, read back and cleaned."""
    px = panel.resample(prices(s, d), "weekly").persist()
    assets = panel.assets_of(px)
    tickers = [f"{a} Index" for a in assets]
    wide = panel.wide(px, "px", assets).orderBy("dt").toDF("date", *tickers)
    master = px.select(F.concat("asset", F.lit(" Index")).alias("bbg_ticker"), F.col("asset").alias("name"), F.lit("all").alias("asset_block")).distinct()
    path = workbook.local(tables.scratch(s, "prices")) + ".xlsx"
    workbook.write_workbook({"Prices": wide, "Master": master}, path)
    px.unpersist()
    return _log(panel.clean_wide(tables.prices(s, path, "workbook"), workbook.read_workbook(s, path, "Master")))


@query("annotated_export", SQL["asset_summary"])
def _(s, d):
    """The summary of the series as a tab-separated file below lines of provenance, read back past them."""
    path = tables.scratch(s, "summary")
    summary = panel.summarise(returns(s, d))
    tables.write_csv(summary, path, "\t", ["source: lineitem", "columns follow"])
    return s.read.option("header", True).option("comment", "#").option("sep", "\t").schema(summary.schema).csv(path)


@query("provenance_tables", SQL["asset_summary"])
def _(s, d):
    """The same as Parquet with its notes as a table beside it."""
    path = tables.scratch(s, "annotated")
    tables.write_annotated(panel.summarise(returns(s, d)), path, ["source: lineitem", "seed: none"])
    notes = s.read.parquet(f"{path}/notes").agg(F.count(F.lit(1)).alias("n"))
    return s.read.parquet(f"{path}/data").join(F.broadcast(notes.filter("n = 2")), F.lit(True)).drop("n")


@query("scaling_drift", f"""WITH {_WIN}, run AS (SELECT dt, asset, avg(r) OVER v AS mean, stddev_samp(r) OVER v AS sd FROM ret WINDOW v AS (PARTITION BY asset ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT w, days.dt AS end_dt, asset, round(mean, 9) AS mean, round(CASE WHEN sd = 0 THEN 1 ELSE sd END, 9) AS sd FROM win JOIN days ON days.t = win.e JOIN run ON run.dt = days.dt""")
def _(s, d):
    r = returns(s, d)
    return drift.scaling_drift(r, regimes.estimation_windows(panel.vectors(r).select("t", "dt"), 250, 63))


#: Even windows have the given mixture, odd ones the same with its states in the other order.
@query("streamed_scores", f"""WITH {_WIN}, x AS (SELECT dt, r, row_number() OVER (PARTITION BY dt ORDER BY asset) AS i FROM ret), l AS (SELECT dt, {_density(0)} AS l0, {_density(1)} AS l1 FROM x GROUP BY 1),
sv AS (SELECT days.t, days.dt, max(w) AS w FROM days JOIN win ON win.e < days.t GROUP BY 1, 2), p AS (SELECT sv.dt, w, 1 / (1 + exp(l1 - l0)) AS p FROM sv JOIN l ON l.dt = sv.dt)
SELECT 'given' AS config_id, dt, w, k, round(CASE WHEN (w + k) % 2 = 0 THEN p ELSE 1 - p END, 6) AS p FROM p, (SELECT unnest([0, 1]) AS k)""", 6)
def _(s, d):
    """Prices by day as a stream of files, a year each, through the stateful scorer: fill, returns, synchrony and model switch."""
    px = panel.complete(prices(s, d)).persist()
    assets = panel.assets_of(px)
    by_day = px.groupBy("dt").agg(F.transform(F.array_sort(F.collect_list(F.struct("asset", "px"))), lambda v: v["px"]).alias("px"))
    base = tables.scratch(s, "stream")
    by_day.persist()
    for year in (r[0] for r in by_day.select(F.year("dt").alias("y")).distinct().orderBy("y").collect()):  # as many as years
        by_day.filter(F.year("dt") == year).coalesce(1).write.mode("append").parquet(f"{base}/days")
    by_day.unpersist()
    px.unpersist()
    windows = regimes.estimation_windows(_days(s, d).select("t", "dt"), 250, 63)
    models = windows.select(F.lit("given").alias("config_id"), "w", "end_dt", *(F.when(F.col("w") % 2 == 0, _literal(v)).otherwise(_literal(v[::-1])).alias(c) for c, v in (("means", _GIVEN.means), ("covs", _GIVEN.covs), ("weights", _GIVEN.weights))))
    flow = s.readStream.schema("dt date, px array<double>").option("maxFilesPerTrigger", 1).parquet(f"{base}/days")
    scoring.start(scoring.one_sided_stream(flow, models, ["given"], assets), f"{base}/out", f"{base}/state", once=True).awaitTermination()
    return s.read.schema(scoring.SERVED).parquet(f"{base}/out")


def _literal(v):
    return F.array(*map(_literal, v)) if getattr(v, "ndim", 0) else F.lit(float(v))
