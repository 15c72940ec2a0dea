"""Folders that driver and executors share, for queries that write files before they read them."""

from __future__ import annotations

import atexit
import re
import uuid
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import SparkSession

T = TypeVar("T")
_MADE: list[tuple[SparkSession, str]] = []
_ONCE: dict[tuple[str, str, str], object] = {}


def _place(spark: SparkSession, path: str) -> tuple[object, object]:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; on one machine the warehouse folder serves where that is unset.

    It goes when the driver ends, as lazy results read it until then.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local($|\[)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    system, where = _place(spark, path)
    system.mkdirs(where)
    _MADE.append((spark, path))
    return path


def once(spark: SparkSession, sf_dir: str, name: str, make: Callable[[], T]) -> T:
    """What ``make`` gives, made once for an application and a scale: files that several queries read."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _ONCE:
        _ONCE[key] = make()
    return _ONCE[key]


def write_text(spark: SparkSession, path: str, text: str) -> str:
    """A small file; returns its path."""
    system, where = _place(spark, path)
    system.setWriteChecksum(False)
    out = system.create(where, True)
    out.write(text.encode())
    out.close()
    return path


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder before the driver ends."""
    system, where = _place(spark, path)
    system.delete(where, True)


def drop_folders() -> None:
    """Delete every folder made here.  Best effort: the session may be gone."""
    while _MADE:
        spark, path = _MADE.pop()
        try:
            system, where = _place(spark, path)
            system.delete(where, True)
        except Exception:  # noqa: BLE001 - the JVM has ended already
            continue


atexit.register(drop_folders)
