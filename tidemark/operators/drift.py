"""How fitted parameters and the scaling of the series drift from window to window (F21)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.assignment import match


def neighbour_links(fits: DataFrame) -> DataFrame:
    """(config_id, w, parents, gaps): for each state of a window the state of the window before that it continues, and how
    far its mean has moved; null for states that continue none.

    Windows meet their predecessors in a join, so all pairs are matched side by side.
    """
    own = fits.select("config_id", "w", "means")
    before = own.select("config_id", "w", F.lag("means").over(Window.partitionBy("config_id").orderBy("w")).alias("old"), "means")

    def run(batches):
        for pdf in batches:
            rows = []
            for config, w, old, new in zip(pdf["config_id"], pdf["w"], pdf["old"], pdf["means"]):
                parents, gaps = [None] * len(new), [None] * len(new)
                if old is not None:
                    d = np.linalg.norm(np.array(new.tolist(), float)[:, None] - np.array(old.tolist(), float)[None], axis=2)
                    for a, b in match(d):
                        if a < len(new) and b < len(old):
                            parents[a], gaps[a] = int(b), float(d[a, b])
                rows.append((config, w, parents, gaps))
            yield pd.DataFrame(rows, columns=["config_id", "w", "parents", "gaps"])

    return before.mapInPandas(run, "config_id string, w int, parents array<int>, gaps array<double>")


def state_tracks(fits: DataFrame) -> DataFrame:
    """(config_id, w, regime, track, gap): a name for each state that it keeps while windows continue it, whatever K is.

    Links of neighbouring windows are composed in order of windows. A state that continues none gets a new name; names of
    states that ended are not used again, so a name is one unbroken run of windows. Only a few whole numbers a window
    come together for that.
    """
    per = neighbour_links(fits).groupBy("config_id").agg(F.array_sort(F.collect_list(F.struct("w", "parents", "gaps"))).alias("links"))
    start = F.expr("named_struct('fresh', 0, 'last', CAST(array() AS array<int>), 'out', CAST(array() AS array<array<int>>))")

    def compose(acc, link):
        parents = link["parents"]

        def name(p, i):
            return F.when(p.isNotNull(), F.get(acc["last"], p)).otherwise(acc["fresh"] + F.size(F.filter(F.slice(parents, 1, i), lambda x: x.isNull())))

        names = F.transform(parents, name)
        fresh = acc["fresh"] + F.size(F.filter(parents, lambda x: x.isNull()))
        return F.struct(fresh.alias("fresh"), names.alias("last"), F.concat(acc["out"], F.array(names)).alias("out"))

    named = per.select("config_id", F.explode(F.arrays_zip("links", F.aggregate("links", start, compose)["out"].alias("names"))).alias("x"))
    zipped = F.arrays_zip(F.col("x.names").alias("track"), F.col("x.links.gaps").alias("gap"))
    return named.select("config_id", F.col("x.links.w").alias("w"), F.posexplode(zipped).alias("regime", "y")).select("config_id", "w", "regime", "y.track", "y.gap")


def parameter_drift(fits: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(config_id, w, end_dt, regime, track, asset, mean, variance, weight) of every window, state and series.

    A configuration has as many states in each window as in its richest one; those that a window lacks are null.
    """
    names = F.array(*map(F.lit, assets))
    most = F.max("K").over(Window.partitionBy("config_id"))
    slots = fits.withColumn("most", most).select("config_id", "w", "end_dt", "means", "covs", "weights", F.explode(F.sequence(F.lit(0), F.col("most") - 1)).alias("regime"))
    state = slots.select("config_id", "w", "end_dt", "regime", F.get("means", F.col("regime")).alias("m"), F.get("covs", F.col("regime")).alias("c"), F.get("weights", F.col("regime")).alias("weight"))
    each = state.select("*", F.posexplode(names).alias("i", "asset"))
    cells = each.select("config_id", "w", "end_dt", "regime", "asset", F.get("m", F.col("i")).alias("mean"), F.get(F.get("c", F.col("i")), F.col("i")).alias("variance"), "weight")
    tracks = state_tracks(fits).select("config_id", "w", "regime", "track")
    return cells.join(tracks, ["config_id", "w", "regime"], "left").select("config_id", "w", "end_dt", "regime", "track", "asset", "mean", "variance", "weight")


def track_summary(fits: DataFrame) -> DataFrame:
    """(config_id, track, first_w, last_w, windows, mean_gap, max_gap): how long each state lives and how far it moves."""
    return state_tracks(fits).groupBy("config_id", "track").agg(F.min("w").alias("first_w"), F.max("w").alias("last_w"), F.count(F.lit(1)).alias("windows"), F.avg("gap").alias("mean_gap"), F.max("gap").alias("max_gap"))


def scaling_drift(returns: DataFrame, windows: DataFrame) -> DataFrame:
    """(w, end_dt, asset, mean, sd): mean and deviation of all days up to each window's end (w, end_dt); no deviation is 1.

    One day alone has a null deviation.
    """
    past = Window.partitionBy("asset").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    sd = F.stddev_samp("r").over(past)
    running = returns.select("dt", "asset", F.avg("r").over(past).alias("mean"), F.when(sd == 0, 1.0).otherwise(sd).alias("sd"))
    return running.join(windows.select("w", F.col("end_dt").alias("dt")), "dt").select("w", F.col("dt").alias("end_dt"), "asset", "mean", "sd")
