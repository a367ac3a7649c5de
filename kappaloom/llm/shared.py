"""Tables of a folder, and the library's helpers for the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import re

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..sources.shared import forget, fresh_path, remove, shared_dir, staged, staged_at, tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def opened(url: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URL as Spark writes it, and the path in it."""
    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", url))


def release() -> None:
    """Give freed memory back to the system: a worker lives on for other stages, whose memory its own would add to."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


__all__ = ["forget", "fresh_path", "opened", "release", "remove", "shared_dir", "staged", "staged_at", "table", "tidied"]
