"""Paths on any file system that Spark can reach: local disks, HDFS, object stores."""

from __future__ import annotations

import atexit
import contextlib
import uuid

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    """(file system, path object) of the JVM."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), place


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place)


def is_file(spark: SparkSession, path: str) -> bool:
    system, place = _at(spark, path)
    return system.exists(place) and system.getFileStatus(place).isFile()


def names(spark: SparkSession, path: str) -> list[str]:
    """The sorted names of what lies in a folder."""
    system, place = _at(spark, path)
    return sorted(s.getPath().getName() for s in system.listStatus(place))


def remove(spark: SparkSession, path: str) -> None:
    system, place = _at(spark, path)
    system.delete(place, True)


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables in the folder that all executors share; removed when the driver ends."""
    from quillsift.session import shared_dir

    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def drop() -> None:
        with contextlib.suppress(Exception):  # the session may have ended before
            remove(spark, path)

    atexit.register(drop)
    return path
