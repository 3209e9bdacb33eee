"""Session settings the plans are written for, and the package on the executors."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

import newsloom

# Adaptive execution sizes shuffle partitions, splits skewed ones and balances
# the written files; everything else is left to the cluster.
SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128m",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.sql.session.timeZone": "UTC",
}


def configured(builder: SparkSession.Builder) -> SparkSession.Builder:
    """``builder`` with the settings; on a large cluster also set
    ``spark.sql.shuffle.partitions`` well above the number of cores (adaptive
    execution only merges partitions) and ``spark.checkpoint.dir`` to a shared
    folder."""
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    return builder


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, whose Python may not have it; once a session."""
    context = spark.sparkContext
    if getattr(context, "_newsloom_shipped", False):
        return
    root = Path(newsloom.__file__).resolve().parent.parent
    place = Path(tempfile.mkdtemp(prefix="newsloom-package-"))
    archive = shutil.make_archive(str(place / "newsloom_package"), "zip", root, "newsloom")
    context.addPyFile(archive)  # Spark serves the driver's file to every executor
    context._newsloom_shipped = True
