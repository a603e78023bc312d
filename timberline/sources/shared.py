"""A folder for tables and files that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

from timberline.errors import need


def new_folder(spark: SparkSession, *names: str) -> str:
    """A path below spark.checkpoint.dir that nothing else uses. Where that is unset, below a temporary folder, if driver and executors are one process; else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        need(master == "local" or master.startswith("local["), f"set spark.checkpoint.dir to a folder that all machines share (master {master})")
        base = "file://" + tempfile.mkdtemp(prefix="timberline-")
        spark.conf.set("spark.checkpoint.dir", base)
        atexit.register(shutil.rmtree, base.removeprefix("file://"), ignore_errors=True)
    return "/".join([base.rstrip("/"), *names, uuid.uuid4().hex])
