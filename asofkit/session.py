"""Session defaults for local runs; a cluster supplies its own configuration."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

LOCAL_DEFAULTS = {
    "spark.sql.shuffle.partitions": "8",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.driver.memory": "12g",
    # Call-site capture costs a stack walk for every column expression.
    "spark.python.sql.dataFrameDebugging.enabled": "false",
}


def local_session(cores: int | None = None, name: str = "asofkit", **settings: str) -> SparkSession:
    cores = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in {**LOCAL_DEFAULTS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, named by ``spark.checkpoint.dir``.

    Where it is not set, a run on one machine gets a temporary folder; a cluster must name one, as a folder of one
    machine would be lost to the others.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="asofkit-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(frame):
    """Cut lineage by a table in the shared folder: it is computed once however often what follows reads it."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/asofkit-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)
