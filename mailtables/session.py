"""Session settings, code shipping and the shared scratch folder."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession

import mailtables

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A whole message file is one row, so the Arrow batches that feed Python are kept short.
    # Spark also bounds them in bytes (spark.sql.execution.arrow.maxBytesPerBatch).
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
}

_shipped: set[tuple[str, str]] = set()
_local_scratch: str | None = None


def configure(spark: SparkSession, *packages: ModuleType) -> SparkSession:
    """Apply the runtime settings the library relies on and send its code to the workers.

    Partition counts and memory stay the cluster's business. `packages` are further packages whose functions run
    in Python stages.
    """
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    for package in (mailtables, *packages):
        _ship(spark, package)
    return spark


def _ship(spark: SparkSession, package: ModuleType) -> None:
    """Add a package's source to the workers' path, once per application."""
    context = spark.sparkContext
    key = (context.applicationId, package.__name__)
    if key in _shipped:
        return
    _shipped.add(key)
    folder = os.path.dirname(package.__file__)
    archive = os.path.join(tempfile.mkdtemp(prefix="ship-"), f"{package.__name__}.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for base, _, names in os.walk(folder):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(base, name)
                    packed.write(path, os.path.relpath(path, os.path.dirname(folder)))
    context.addPyFile(archive)


def scratch_dir(spark: SparkSession, label: str) -> str:
    """A new folder under the cluster's shared checkpoint folder (`spark.checkpoint.dir`).

    A session in one process that names no such folder (a test) gets a local one. A cluster must name it, as its
    machines do not share local folders.
    """
    global _local_scratch
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[[^,]*\])?$", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        if _local_scratch is None:
            _local_scratch = tempfile.mkdtemp(prefix="mailtables-")
        base = _local_scratch
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def spread(rows: DataFrame) -> DataFrame:
    """Deal the rows of a small scan out over all cores, for a stage that is heavy per row.

    A scan that already has as many splits as there are cores, which is any large one, stays as it is. Use it
    directly on a scan: counting the splits of a plan with shuffles would run them.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows if rows.rdd.getNumPartitions() >= cores else rows.repartition(cores)
