"""Folders that the driver and all executors see."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``; a temporary one only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="checkpoints-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def work_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read from there: lineage ends here."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def plain_names(df: DataFrame, keep: Sequence[str] | None, made: Sequence[T.StructField]) -> tuple[list[Column], list[T.StructField]]:
    """Columns ``keep`` (default: all) less those named like ``made`` in whatever case.

    They come as ``keep_0``, ``keep_1``, ..., which clash with no name of an
    operator's own, and as the fields that they are in the result.
    """
    taken = {f.name.lower() for f in made}
    fields = [f for f in df.schema.fields if (keep is None or f.name in keep) and f.name.lower() not in taken]
    if keep is not None:
        fields.sort(key=lambda f: list(keep).index(f.name))
    return [F.col(f"`{f.name}`").alias(f"keep_{i}") for i, f in enumerate(fields)], fields
