"""Small results that later stages read several times."""

from __future__ import annotations

from pyspark.sql import DataFrame


def stored(df: DataFrame) -> DataFrame:
    """The rows, written to the checkpoint folder of the session: later stages join such small tables several times, and
    would otherwise repeat their whole plan at each place."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        spark.sparkContext.setCheckpointDir(named or "file:///tmp/checkpoints")
    return df.checkpoint()
