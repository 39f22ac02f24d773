"""Lineage cuts and size checks of the operators: tables in the shared checkpoint folder."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Writes the rows of ``df`` to the checkpoint folder and goes on from there.

    The folder is the cluster's ``spark.checkpoint.dir``. Only a session in one JVM, as in tests, gets a temporary one.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and sc.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="sitelore-"))
    return df.checkpoint(eager=True)


def by_key(df: DataFrame, key: str) -> DataFrame:
    """The rows dealt by ``key`` as ``cut_by`` deals them."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), key)


def cut_by(df: DataFrame, key: str) -> DataFrame:
    """``cut`` of the rows dealt and sorted by ``key``, such that merge joins on it neither shuffle nor sort them again.

    Spark forgets the partitioning of what an adaptive plan wrote, so this one is written without; its keys are to be without skew.
    Joins within ``df`` whose sides are dealt by ``key`` and that have it among their columns don't shuffle either.
    """
    conf = df.sparkSession.conf
    settings = {"spark.sql.adaptive.enabled": "false", "spark.sql.requireAllClusterKeysForCoPartition": "false"}
    before = {k: conf.get(k, "true") for k in settings}
    try:
        for k, v in settings.items():
            conf.set(k, v)
        return cut(by_key(df, key).sortWithinPartitions(key))
    finally:
        for k, v in before.items():
            conf.set(k, v)


def broadcast_if_small(df: DataFrame, rows: int = 500_000) -> DataFrame:
    """Marks a cut table of narrow rows for broadcast if it has at most so many rows, counted first."""
    return F.broadcast(df) if df.count() <= rows else df
