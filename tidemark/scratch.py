"""Intermediate tables on the folder that the whole cluster shares.

Every step whose result is used more than once, or whose lineage must end, is written as Parquet under the
session's ``spark.checkpoint.dir``: any executor can read it again after another one is lost.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder of this session; a temporary one only where the session is local and names none (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tidemark-"))
    return context.getCheckpointDir()


#: Rows of a small table that go to one file.
FILE_ROWS = 200_000


class Scratch:
    """Tables of one run of an operator."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def path(self, name: str) -> str:
        """A place of this run for files of another kind."""
        return f"{self.root}/{name}"

    def keep(self, frame: DataFrame, rows: int | None = None) -> DataFrame:
        """frame as written and read back; rows, if known to be its order of magnitude, limits the files written."""
        self.count += 1
        if rows is not None:
            frame = frame.coalesce(max(1, -(-rows // FILE_ROWS)))
        path = f"{self.root}/{self.count}"
        frame.write.parquet(path)
        kept = self.spark.read.schema(frame.schema).parquet(path)
        kept.scratch_path = path
        return kept

    def drop(self, *frames: DataFrame | None) -> None:
        """Delete tables that no frame still to be computed reads."""
        for frame in frames:
            path = getattr(frame, "scratch_path", None)
            if path:
                jvm = self.spark.sparkContext._jvm
                target = jvm.org.apache.hadoop.fs.Path(path)
                target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
