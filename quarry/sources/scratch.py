"""Places for intermediate files that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the session's spark.checkpoint.dir. Where that is unset, a folder of this machine's serves a local
    session (as in tests); on a cluster it is an error, as executors would not see each other's files."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="quarry-shared-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/quarry-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table written once and read back, so that later jobs see the same rows at a parser's cost of one."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
