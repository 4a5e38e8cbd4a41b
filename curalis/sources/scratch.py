"""A folder for files that queries write and read again: in the shared folder of the session, on one machine a temporary one."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession


def folder(spark: SparkSession, label: str) -> str:
    """A new folder that driver and executors see at the same place; it goes when the process ends."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    if found is None and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if found is not None and ":" in found and not found.startswith("file:"):
        raise ValueError(f"files cannot be opened by their path in {found}")
    base = found.removeprefix("file://").removeprefix("file:") if found else tempfile.gettempdir()
    path = os.path.join(base, f"curalis-{label}-{uuid.uuid4().hex}")
    os.makedirs(path)
    atexit.register(shutil.rmtree, path, ignore_errors=True)
    return path
