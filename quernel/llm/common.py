"""Helpers that the corpus operators share: reading tables, cutting lineage, shipping this package to executors."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: White space as the contracts have it: space and U+0009 to U+000D. A Java regex class body.
SPACE = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints; only a local session without one gets a temporary folder."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or getattr(sc, "_quernel_folder", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = sc._quernel_folder = tempfile.mkdtemp(prefix="quernel-")
        atexit.register(shutil.rmtree, named, True)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again, so that its lineage ends there.

    A checkpoint would do the same, but it keeps the plan's estimated size, and in loops of joins these estimates
    multiply until the optimiser does little else than multiply them. ``drop`` removes what is no longer read.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/quernel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._quernel_path = path
    return out


def drop(*tables: DataFrame | None) -> None:
    """Removes what ``cut`` wrote for these tables."""
    for df in tables:
        path = getattr(df, "_quernel_path", None)
        if path is not None:
            spark = df.sparkSession
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def ship(spark: SparkSession) -> None:
    """Lets executors import this package however the driver found it: a zip of it goes out once a session."""
    sc = spark.sparkContext
    if getattr(sc, "_quernel_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    out = os.path.join(tempfile.mkdtemp(prefix="quernel-zip-"), "quernel_src.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, str(p.relative_to(root.parent)))
    sc.addPyFile(out)
    sc._quernel_shipped = True


def release() -> None:
    """Returns to the system what a worker process has freed but holds: stages take over the workers of those before."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not every C library has it
        ctypes.CDLL(None).malloc_trim(0)


def text_or_empty(values) -> list[str]:
    """A column's strings as a list, nulls as empty strings."""
    return [v if isinstance(v, str) else "" for v in values]
