"""Session helpers: a tuned builder and lineage cutting."""

from __future__ import annotations

import os
import re
import tempfile
import zipfile
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "cohortlens", master: str | None = None, **conf) -> SparkSession:
    """Session for local runs; on a cluster the submitter's settings win."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


@lru_cache(1)
def own_folder(master: str) -> str:
    """The temporary folder of this process, for a master that runs all tasks in it; others are refused,
    as their executors would write to disks of their own."""
    if not re.match(r"local(\[|$)", master):
        raise ValueError(f"master {master}: set spark.checkpoint.dir to a folder that the driver and all executors share")
    return tempfile.mkdtemp(prefix="cohortlens-")


def shared_base(spark: SparkSession) -> str:
    """The shared folder the cluster names in spark.checkpoint.dir, or own_folder where none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        defined = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = defined.get() if defined.isDefined() else own_folder(spark.sparkContext.master)
    return base


def _checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; only where none is set (local tests), a temporary one."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(os.path.join(shared_base(spark), "checkpoints"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it back, so iterations do not pile up plans.

    The copy lives on shared storage, so losing an executor costs nothing.
    """
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_spread(df: DataFrame) -> DataFrame:
    """cut_lineage of rows dealt evenly to all tasks: for what is read many times, as a compressed file or a join with a
    broadcast table comes in few partitions, however many rows it has."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return cut_lineage(df.repartition(max(cores, min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), 4 * cores))))


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in the Python workers, once per application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="cohortlens-"), "cohortlens.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(root)))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)
