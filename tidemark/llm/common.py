"""Small helpers shared by the operators of this package."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or (on a local master only) a new one."""
    own = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if own:
        return own.rstrip("/")
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isEmpty():
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="tidemark-"))
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    return kept.get().rstrip("/")


#: Spark then removes an execution's shuffle files when it ends, not when the driver happens to collect garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows that go to Python at once, unless their bytes are too many.
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, what: str, group_rows: int | None = None, batch_rows: int | None = None) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors.

    The shuffle files of the plan go as soon as the table stands; nothing reads them again. The table itself stays
    until :func:`released`. Where rows are large, ``group_rows`` bounds those of a row group, which a reader holds at
    once, and ``batch_rows`` those that go to Python at once while ``df`` is computed.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark/{what}-{uuid.uuid4().hex}"
    before, at_once = spark.conf.get(_CLEANUP, None), spark.conf.get(_BATCH, None)
    try:
        if before is not None:
            spark.conf.set(_CLEANUP, "true")
        if batch_rows:
            spark.conf.set(_BATCH, str(batch_rows))
        df.write.options(compression="zstd", **({"parquet.block.row.count.limit": group_rows} if group_rows else {})).parquet(path)
    finally:
        if before is not None:
            spark.conf.set(_CLEANUP, before)
        if batch_rows:
            spark.conf.unset(_BATCH) if at_once is None else spark.conf.set(_BATCH, at_once)
    return spark.read.schema(df.schema).parquet(path)


def released(*tables: DataFrame) -> None:
    """Deletes tables of :func:`written` that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            folder = spark._jvm.org.apache.hadoop.fs.Path(file).getParent()
            if folder.getParent().getName() != "tidemark":
                raise ValueError(f"not an intermediate table: {file}")
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
