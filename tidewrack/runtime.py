"""The session: what its Python workers import, and how a scan is dealt over its cores."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def reachable(spark: SparkSession) -> None:
    """Adds the folder of the package to the path of the session's Python workers.

    It matters on one machine only, or where the folder is shared; on other clusters the
    package is sent with --py-files.
    """
    here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    known = [p for x in (environment.get("PYTHONPATH"), os.environ.get("PYTHONPATH")) for p in (x or "").split(os.pathsep)]
    if here not in known:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [here, environment.get("PYTHONPATH")]))


def over_all_cores(scan: DataFrame) -> DataFrame:
    """The same rows, dealt anew if the scan has fewer splits than the session has cores.

    A row group is read by one task, so a small table of long texts would keep one core
    busy; a table of many files stays as it is.  Only for frames that just read a table:
    counting the splits of others could run them.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def run_folder(spark: SparkSession, name: str) -> str:
    """A new folder for one run's files under the session's ``spark.checkpoint.dir``, which all machines share.

    Where that is unset, a session on this machine gets a temporary folder; on a cluster it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + os.path.join(tempfile.gettempdir(), "tidewrack-runs")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def as_pattern(path: str) -> str:
    """A pattern that only the path itself fits: a file stream takes a folder, or a pattern of files."""
    named = path.rstrip("/")
    return f"{named[:-1]}[{named[-1]}]"
