"""Where lineage is cut, and how tables are read."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own where that is unset.

    Only a local session has none; a cluster without the setting is refused, as a machine's own temporary
    folder would be lost with the machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there and lost executors do no harm.

    A compressed columnar table takes a fraction of the disk that checkpoint() takes for the same rows.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/strandline/{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, folder: str, name: str, columns: list[str] | None = None) -> DataFrame:
    """A Parquet table of a folder, optionally only some of its columns."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def broadcast_if(df: DataFrame, rows: int, bound: int) -> DataFrame:
    """Hint a broadcast only where the counted rows stay within the bound; else Spark shuffles."""
    return F.broadcast(df) if rows <= bound else df
