"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def folder(spark: SparkSession, what: str) -> str:
    """A new path below the folder that ``spark.checkpoint.dir`` names; where a local session has none, below a folder of this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a shared folder")
        base = "file://" + tempfile.mkdtemp(prefix="sillon-")
        spark.sparkContext.setCheckpointDir(base)
    if base.startswith("/"):
        base = "file://" + os.path.abspath(base)
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: the lineage ends there and survives lost executors."""
    path = folder(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_file(rows: DataFrame, line: str, order: str, path: str, head: str = "") -> None:
    """Writes a small table (one row of memory) as one text file of lines in order, after a head."""
    whole = rows.agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("all"))
    whole.select(F.concat(F.lit(head), F.array_join(F.transform("all", lambda r: r["l"]), "\n")).alias("value")).coalesce(1).write.mode("overwrite").text(path)
