"""Session settings the package is tuned for, and the shared work folder."""

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

# No operator hints a broadcast: Spark compares the planned size, and with AQE the measured
# size, of a join side with these thresholds and shuffles whatever is larger.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "32m",
    "spark.sql.session.timeZone": "UTC",
}


def local_session(app="mailgrid", cpus="8", memory="8g", **extra):
    """A session for tests and the benchmark; a cluster passes SETTINGS to spark-submit."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", str(cpus))
        # Small shuffles that unfold into many rows keep all cores busy.
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
    )
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpointed(df):
    """Cuts the lineage with a reliable checkpoint in the folder all executors share.

    The files go when the frame is no longer referenced, if
    spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(work_folder(df.sparkSession, "checkpoints"))
    return df.checkpoint()


def work_folder(spark, name):
    """A fresh folder below the shared folder the cluster names in spark.checkpoint.dir.

    Only a local session, which has no other machine to share with, may fall back to a
    temporary folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="mailgrid-")
        atexit.register(shutil.rmtree, shared, ignore_errors=True)
    return os.path.join(shared, f"{name}-{uuid.uuid4().hex}")
