"""Folders that appear whole or not at all.

A writer fills a folder of its own and then publishes it by creating one empty file whose name says which
folder is meant: file systems and object stores create an empty file at once or not at all. Readers follow
the published names, so what a broken writer left behind is never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession

MARKS = "_published"


def _folder(spark: SparkSession, path: str):
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def published(spark: SparkSession, path: str) -> list[str]:
    """Names published under the path, in order."""
    place, files = _folder(spark, f"{path}/{MARKS}")
    if not files.exists(place):
        return []
    return sorted(status.getPath().getName() for status in files.listStatus(place))


def publish(spark: SparkSession, path: str, name: str) -> None:
    """Let readers see the folder ``name``; publishing it again changes nothing."""
    place, files = _folder(spark, f"{path}/{MARKS}/{name}")
    files.create(place, True).close()


def next_version(spark: SparkSession, path: str) -> str:
    """A folder name that nobody else uses and that sorts after all published ones."""
    names = published(spark, path)
    number = int(names[-1].split("-")[1]) + 1 if names else 0
    return f"version-{number:010d}-{uuid.uuid4().hex}"


def current(spark: SparkSession, path: str) -> str:
    """The newest published folder."""
    names = published(spark, path)
    if not names:
        raise FileNotFoundError(f"nothing was published under {path}")
    return f"{path}/{names[-1]}"


def drop_versions(spark: SparkSession, path: str, keep: int = 1) -> int:
    """Withdraw and delete all but the newest published versions; returns how many. For when nobody reads them any more."""
    if keep < 1:
        raise ValueError("the newest version is kept")
    old = published(spark, path)[:-keep]
    for name in old:
        for each in (f"{path}/{MARKS}/{name}", f"{path}/{name}"):
            place, files = _folder(spark, each)
            files.delete(place, True)
    return len(old)
