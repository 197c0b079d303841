"""Session helpers: builder for tests and benches, checkpoint folder, shuffle sizing."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "tamarack", cpus: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Local session with the settings every plan here expects (UTC, AQE, Arrow)."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Folder for checkpoint(): the one that the session names, else on a single machine one of our own, removed when Python ends.

    On a cluster a folder of one machine would lose what other machines need: without spark.checkpoint.dir that is an error.
    """
    sc = spark.sparkContext
    if current := sc.getCheckpointDir():
        return current
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir names no folder that all machines share")
        own = tempfile.mkdtemp(prefix="tamarack-checkpoint-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        path = "file://" + own
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Materialise df in the shared checkpoint folder and continue from there: survives the loss of executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below sf_dir."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(scan: DataFrame) -> DataFrame:
    """The rows of a plain scan, dealt out over all cores if it has fewer splits than there are cores.

    A row group can't be split, so a costly map over a table of one row group would leave all cores but one idle. A large table has more
    splits than cores and stays as it is, without an exchange. Choose columns first.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if len(scan.inputFiles()) >= cores or scan.rdd.getNumPartitions() >= cores:
        return scan
    return scan.repartition(cores)
