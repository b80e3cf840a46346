"""Session helpers: loading tables and choosing where lineage is cut."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def read(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """One table of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints, set on the context.

    A cluster names a shared folder in ``spark.checkpoint.dir``; only on one machine, where that is unset, a temporary
    folder is used.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return sc._jsc.sc().getCheckpointDir().get()
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    path = named or os.path.join(tempfile.gettempdir(), "refloom-checkpoints")
    sc.setCheckpointDir(path)
    return path


_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, free: bool = False) -> DataFrame:
    """The frame with its lineage written to the checkpoint folder; survives the loss of executors.

    With ``free``, the shuffle files that it took are deleted as soon as it is written, not when the driver happens to
    collect its garbage; the frame itself can be used again, which then computes it anew.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    if not free:
        return df.checkpoint(eager=True)
    # Read when a frame is made, so other frames keep what is set for them.
    before = spark.conf.get(_FREE, None)
    spark.conf.set(_FREE, "true")
    try:
        own = df.select("*")
    finally:
        spark.conf.unset(_FREE) if before is None else spark.conf.set(_FREE, before)
    return own.checkpoint(eager=True)


_MADE: dict[tuple, DataFrame] = {}


def made_once(spark: SparkSession, directory: str, name: str, tables: tuple[str, ...], make) -> DataFrame:
    """What ``make`` gives, written once for a session and a version of the tables it is made of."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(f"{directory}/{t}.parquet") for t in tables]
    versions = tuple(p.getFileSystem(conf).getFileStatus(p).getModificationTime() for p in paths)
    key = (spark.sparkContext.applicationId, directory, name, versions)
    if key not in _MADE:
        for old in [k for k in _MADE if k[0] != key[0] or k[1:3] == key[1:3]]:
            del _MADE[old]
        _MADE[key] = cut(make(), free=True)
    return _MADE[key]
