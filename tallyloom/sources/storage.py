"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_base(spark: SparkSession) -> str:
    """The folder all executors share: the session's checkpoint folder, set here only where none is, on a local master."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if base is None:
            if not sc.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="spark-shared-")
        sc.setCheckpointDir(base)
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read again: computed once, and safe from lost executors."""
    path = f"{shared_base(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
