"""Folders in any store that Spark reaches, through its own file system layer."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _system(spark: SparkSession, path: str):
    """The file system of a path, and the path as it names it."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def matching(spark: SparkSession, pattern: str) -> list[str]:
    """Whole paths that match a pattern with ``*``, in order; none if there are none."""
    system, place = _system(spark, pattern)
    return sorted(found.getPath().toString() for found in (system.globStatus(place) or []))


def exists(spark: SparkSession, path: str) -> bool:
    system, place = _system(spark, path)
    return system.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Removes a folder with all it holds; none there is no error."""
    system, place = _system(spark, path)
    system.delete(place, True)
