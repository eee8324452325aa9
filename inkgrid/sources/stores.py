"""Files on shared file systems, from the driver or from tasks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import SparkSession

_OWN: list[str] = []


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI (local, hdfs, s3, gs) and the path in it."""
    if re.match(r"^file:/(?!//)", path):  # as Hadoop writes it
        return fs.LocalFileSystem(), path.removeprefix("file:")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path)
    return fs.FileSystem.from_uri(path)


def prefix_of(path: str) -> str:
    """What stands before a path of the store in the name that Spark gives its files."""
    scheme = re.match(r"^([a-z0-9+.-]+)://([^/]*)", path)
    return "file:" if scheme is None or scheme[1] == "file" else f"{scheme[1]}://{scheme[2]}" if scheme[1] == "hdfs" else f"{scheme[1]}://"


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share; deleted when the driver's JVM ends."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.mkdtemp(prefix="inkgrid-"))
        base = f"file://{_OWN[0]}"
    folder = f"{base.rstrip('/')}/inkgrid/{name}-{uuid.uuid4().hex[:12]}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(path)
    return folder
