"""Shared scratch space: tables that cut lineage and survive the loss of an executor.

Everything goes below ``spark.checkpoint.dir``, which driver and executors share. Only where that setting is
absent and everything runs in one process (tests, a laptop) a folder is made and used instead; elsewhere it is an error.
"""

from __future__ import annotations

import os
import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def ship_code(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it."""
    root = str(Path(__file__).resolve().parents[2])
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])
    if root not in sys.path:
        sys.path.insert(0, root)


def base_dir(spark: SparkSession) -> str:
    """The shared folder the session names; a folder of our own only if it names none and there are no other machines."""
    sc = spark.sparkContext
    base = sc.getConf().get("spark.checkpoint.dir")
    if not base:
        if not sc.master.startswith("local[") and sc.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _own.get(sc.applicationId)
        if base is None:
            base = _own[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="mnemo-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(base)
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{base_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: evaluated once, no lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def made(spark: SparkSession) -> list[str]:
    """Scratch tables of this session that are still there."""
    return [path for owner, path in _made if owner is spark]


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables; only for when no result still reads them."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    _made[:] = [x for x in _made if x[0] is not spark or x[1] not in set(paths)]


def keep_rows(docs: DataFrame, chosen: Callable[[pa.Array, np.ndarray], np.ndarray], given: Column) -> DataFrame:
    """The rows of docs, all columns, for whose text and given number chosen() says true: one pass, no shuffle.

    Rows travel as one struct, so no name of theirs can clash, and come back as the Arrow columns they went as: texts
    never become Python objects.
    """

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.struct_field(batch.column("doc"), "text")
            some = chosen(texts, batch.column("given").to_numpy(zero_copy_only=False))
            yield batch.select(["doc"]).filter(pa.array(some))
            del batch, texts
            pa.default_memory_pool().release_unused()

    ship_code(docs.sparkSession)
    rows = docs.select(F.struct("*").alias("doc"), given.cast("double").alias("given"))
    return rows.mapInArrow(pick, rows.select("doc").schema).select("doc.*")


def input_bytes(df: DataFrame, column: str) -> int:
    """Catalyst's size estimate of df: for a file scan the bytes of its files, from metadata alone. Where the plan knows
    nothing about its size, the bytes of a column are added up."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size if size < 1 << 55 else df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def bucket_count(df: DataFrame, column: str, target: int, least: int = 1) -> int:
    """Number of hash buckets so that each gets about target bytes of df's files."""
    return max(least, -(-input_bytes(df, column) // target))
