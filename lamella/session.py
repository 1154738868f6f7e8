"""Session construction and the shared working folder."""

from __future__ import annotations

import gc
import tempfile

from pyspark.sql import SparkSession


def get_session(app: str = "lamella", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster the master comes from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
    } | conf
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and written tables that driver and executors share.

    It is the one the cluster names in spark.checkpoint.dir. Where that is unset in local mode (tests) a temporary
    folder is made and set; on a cluster that is an error, as its machines share no such folder.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="lamella-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


def cut(df):
    """Cut the lineage of df with a reliable checkpoint in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df):
    """cut(df); the driver then lets go of shuffles and checkpoints that nothing needs any more, to free their disk."""
    df = cut(df)
    gc.collect()
    df.sparkSession.sparkContext._jvm.System.gc()
    return df
