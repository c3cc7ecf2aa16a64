"""What several corpus operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.sources.folder import shared

#: A key is hot if at least this part of all rows has it.
HOT = 1000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage through a reliable checkpoint in the folder that the cluster shares."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared(df.sparkSession))
    return df.checkpoint()


def looked_up(rows: DataFrame, facts: DataFrame, key: str, total: int) -> DataFrame:
    """``rows`` with the columns of ``facts``, which has each ``key`` once and how many rows have it, n.

    Keys of at least a ``HOT``-th of all rows, of which there are ``HOT`` at most, are broadcast; the others are joined
    by shuffle, where no key is as frequent.
    """
    often = max(2, total // HOT)
    hot = F.broadcast(facts.where(F.col("n") >= often).drop("n"))
    rest = rows.join(hot, key, "left_anti").join(facts.where(F.col("n") < often).drop("n"), key)
    return rows.join(hot, key).unionByName(rest)
