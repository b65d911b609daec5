"""Reading the driver's tables and the folder for checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``, handed to Spark.

    Where it is unset, a local session gets a folder of its own; on a cluster, whose executors would not share it, this raises.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if (known := spark.sparkContext._jsc.sc().getCheckpointDir()).isDefined():
            return known.get()
        if spark.sparkContext.master != "local" and not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillspark-")
        spark.conf.set("spark.checkpoint.dir", folder)
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder: its plan is run once and survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


#: Bytes a core under which rows are spread: files too small to be split.
SMALL = 1 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores if its estimated size is under ``SMALL`` a core: a few small files before work that is heavy for each row.

    Only the plan's statistics are asked; larger inputs and streams keep their partitions.
    """
    n = df.sparkSession.sparkContext.defaultParallelism
    if df.isStreaming or int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) >= n * SMALL:
        return df
    return df.repartition(n)
