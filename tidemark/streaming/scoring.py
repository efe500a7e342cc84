"""Scoring of new days against fitted models, in batches or as a stream.

``score_days`` is stateless: returns in, probabilities out. ``one_sided_stream`` starts from prices and keeps per
configuration what the one-sided rule needs between days: the last known prices, and the models whose windows have
ended. Its state is one day of prices and the models that can still serve, whatever the length of the stream.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.mixture import State, posterior, state_of
from ..operators.panel import CASH_LIKE

SCHEMA = "dt date, p array<double>, regime int, log_density double"
MODEL = "w int, end_dt date, means array<array<double>>, covs array<array<array<double>>>, weights array<double>"
SERVED = "config_id string, dt date, w int, k int, p double"


def score_days(days: DataFrame, model: State, reg: float = 1e-6) -> DataFrame:
    """(dt, p, regime, log_density) of days (dt, x); stateless, so it works on batch and streaming frames alike.

    The model must have been fitted on days before those it scores.
    """

    def run(batches):
        for pdf in batches:
            if len(pdf):
                p, dens = posterior(np.array(pdf["x"].tolist(), float), model, reg)
                yield pd.DataFrame({"dt": pdf["dt"], "p": p.tolist(), "regime": p.argmax(1).astype("int32"), "log_density": dens})

    return days.select("dt", "x").mapInPandas(run, SCHEMA)


class OneSided(StatefulProcessor):
    """Days of one configuration in order: fill, log return, test for synchrony, model switch, posterior."""

    def __init__(self, exempt: Sequence[bool], reg: float):
        self.exempt, self.reg = np.array(exempt, bool), reg

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "dt date, px array<double>")
        self.models = handle.getListState("models", MODEL)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self._learn(initialState)

    def _learn(self, pdf: pd.DataFrame) -> None:
        for r in pdf.itertuples(index=False):
            self.models.appendValue((int(r.w), r.end_dt, _plain(r.means), _plain(r.covs), _plain(r.weights)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows))  # one micro-batch of one configuration: days, not ticks
        self._learn(pdf[pdf["w"].notna()])
        days = pdf[pdf["w"].isna()].sort_values("dt").drop_duplicates("dt", keep="first")
        if days.empty:
            return
        seen, px = self.last.get() if self.last.exists() else (None, None)
        if seen is not None:
            days = days[days["dt"] > seen]
        models = sorted(self.models.get(), key=lambda m: (m[1], m[0]))
        first, out = 0, []
        for day, new in zip(days["dt"], days["px"]):
            new = np.array(new, float)
            filled = new if px is None else np.where(np.isnan(new), np.array(px, float), new)
            while first + 1 < len(models) and models[first + 1][1] < day:
                first += 1
            if px is not None and first < len(models) and models[first][1] < day:
                x = _log(filled) - _log(np.array(px, float))
                if np.isfinite(x).all() and ((x != 0) | self.exempt).all():
                    w, _, means, covs, weights = models[first]
                    p, _ = posterior(x[None], state_of({"means": means, "covs": covs, "weights": weights}), self.reg)
                    out.append(pd.DataFrame({"config_id": key[0], "dt": day, "w": w, "k": range(p.shape[1]), "p": p[0]}))
            seen, px = day, filled
        if len(days):
            self.last.update((seen, [None if np.isnan(v) else float(v) for v in px]))
        if first:
            self.models.put(models[first:])  # models before the one that serves can't serve again
        if out:
            yield pd.concat(out)


def _plain(v):
    return [_plain(x) for x in v] if isinstance(v, (list, tuple, np.ndarray)) else float(v)


def _log(px: np.ndarray) -> np.ndarray:
    return np.log(px, out=np.full(len(px), np.nan), where=px > 0)


def one_sided_stream(days: DataFrame, fits: DataFrame, configs: Sequence[str], assets: Sequence[str], new_fits: DataFrame | None = None, exempt: Sequence[str] = CASH_LIKE, reg: float = 1e-6) -> DataFrame:
    """(config_id, dt, w, k, p) of a stream of days (dt, px in order of ``assets``, null where there is no price).

    A day is scored under its configuration's latest model (of ``fits``, or arrived since by the stream ``new_fits``) whose
    window ended before it; days without one, without a return of every asset, or on which an asset that is not exempt
    stood still, give no rows but carry their prices on. Days come in order of batches; within a batch any order will do.
    Days that are not after the last one seen, and repeats of a day, are left out. A model that arrives late serves the
    days that come after it.
    """
    if all(a in exempt for a in assets):
        raise ValueError("every asset is exempt from the test")
    fields = ["w", "end_dt", "means", "covs", "weights"]
    events = days.select(F.explode(F.array(*map(F.lit, configs))).alias("config_id"), "dt", "px")
    for name, kind in (f.split(" ", 1) for f in MODEL.split(", ")):
        events = events.withColumn(name, F.lit(None).cast(kind))
    if new_fits is not None:
        models = new_fits.select("config_id", F.lit(None).cast("date").alias("dt"), F.lit(None).cast("array<double>").alias("px"), *fields)
        events = events.unionByName(models)
    processor = OneSided([a in exempt for a in assets], reg)
    known = fits.select("config_id", *fields).groupBy("config_id")
    return events.groupBy("config_id").transformWithStateInPandas(processor, outputStructType=SERVED, outputMode="Append", timeMode="None", initialState=known)


def start(served: DataFrame, path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Writes a stream as Parquet; ``once`` takes what is there and ends. Its state needs the store that this sets."""
    keep_state(served.sparkSession)
    writer = served.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()


def keep_state(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
