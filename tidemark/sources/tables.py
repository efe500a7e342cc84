"""Readers and writers: Parquet tables, CSV with provenance lines, ticker masters, and long exports."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .workbook import read_workbook

MASTER = "bbg_ticker string, name string, asset_block string, sub_category string"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def prices(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame:
    """A wide price table: Parquet, the first sheet of a workbook, or CSV with a header, read as text and coerced later."""
    if kind not in ("parquet", "csv", "workbook"):
        raise ValueError("prices are read from parquet, csv or a workbook")
    if kind == "workbook":
        return read_workbook(spark, path)
    return spark.read.parquet(path) if kind == "parquet" else spark.read.option("header", True).csv(path)


def master(spark: SparkSession, path: str) -> DataFrame:
    """Ticker map with the columns bbg_ticker, name, asset_block and, in newer ones, sub_category."""
    return spark.read.option("header", True).option("enforceSchema", False).csv(path)


def annotated_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV whose first lines are comments that start with ``#``."""
    reader = spark.read.option("header", True).option("comment", "#")
    return reader.schema(schema).csv(path) if schema else reader.option("inferSchema", True).csv(path)


def write_annotated(df: DataFrame, path: str, notes: Sequence[str], mode: str = "errorifexists") -> None:
    """The table as Parquet at ``path``/data and its notes as rows at ``path``/notes, so that neither needs the driver's disk."""
    df.write.mode(mode).parquet(f"{path}/data")
    notes_df = df.sparkSession.createDataFrame([(i, n) for i, n in enumerate(notes)], "line int, note string")
    notes_df.coalesce(1).write.mode(mode).parquet(f"{path}/notes")


def write_csv(df: DataFrame, path: str, sep: str = ",", notes: Sequence[str] = (), mode: str = "errorifexists") -> None:
    """CSV or TSV export of a report-sized table in one file; ``notes`` become leading ``#`` lines (as text output)."""
    if not notes:
        df.coalesce(1).write.mode(mode).option("header", True).option("sep", sep).csv(path)
        return
    quoted = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in df.columns]
    head = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate([*(f"# {n}" for n in notes), sep.join(df.columns)])], "i long, line string")
    body = df.select((F.monotonically_increasing_id() + len(notes) + 1).alias("i"), F.concat_ws(sep, *quoted).alias("line"))
    head.union(body).repartition(1).sortWithinPartitions("i").select("line").write.mode(mode).text(path)


def write_sheets(sheets: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """One Parquet table per sheet of a workbook."""
    for name, df in sheets.items():
        df.write.mode(mode).parquet(f"{folder}/{name}")


def correlations_long(fits: DataFrame, assets: Sequence[str]) -> DataFrame:
    """(w, end_dt, regime, a, b, corr) of fits (w, end_dt, covs: states x assets x assets)."""
    names = F.array(*map(F.lit, assets))
    k = fits.select("w", "end_dt", F.posexplode("covs").alias("regime", "c"))
    i = k.select("w", "end_dt", "regime", "c", F.posexplode("c").alias("i", "row"))
    j = i.select("w", "end_dt", "regime", "i", F.posexplode("row").alias("j", "cov"), "c")
    scale = F.sqrt(F.get(F.get("c", F.col("i")), F.col("i")) * F.get(F.get("c", F.col("j")), F.col("j")))
    return j.select("w", "end_dt", "regime", F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), F.try_divide("cov", scale).alias("corr"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the folder that all machines share: ``spark.checkpoint.dir``, or one set here on a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        if kept.isEmpty():
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
            kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = kept.get()
    return f"{folder.rstrip('/')}/tidemark/{what}-{uuid.uuid4().hex}"
