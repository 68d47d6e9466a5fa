"""Session-level helpers shared by every operator."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder; a private one only where none is configured (tests, local runs)."""
    sc = spark.sparkContext
    defined = sc._jsc.sc().getCheckpointDir().isDefined()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        if not defined:  # set on the session only
            sc.setCheckpointDir(configured)
        return
    if not defined:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="foliospark-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared checkpoint folder and read it back: reused inputs are computed once and survive lost executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df over all cores where its input came in fewer partitions (a small or single file); large inputs stay as they are."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, *keys) if df.rdd.getNumPartitions() < cores else df


HOT_KEYS = 4096


def lookup_join(left: DataFrame, right: DataFrame, key: str, weight: str, how: str = "inner") -> DataFrame:
    """Join left to right (one row per key) without a hot partition.

    The HOT_KEYS rows of right with the largest weight are broadcast (a fixed number of rows); all other keys meet
    in a shuffle join. how: inner, or left (unmatched rows of left keep nulls)."""
    hot = right.orderBy(F.desc(weight), key).limit(HOT_KEYS)
    common = left.join(F.broadcast(hot), key)
    rest = left.join(F.broadcast(hot.select(key)), key, "left_anti").join(right, key, how)
    return common.unionByName(rest.select(common.columns))


def shared_folder(spark: SparkSession) -> str:
    """A folder all executors share: the configured checkpoint folder, a private one only in local runs."""
    ensure_checkpoint_dir(spark)
    configured = spark.conf.get("spark.checkpoint.dir", None)
    return configured or spark.sparkContext._jsc.sc().getCheckpointDir().get()
