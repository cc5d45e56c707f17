"""Tables that queries write between steps, in the folder that the whole cluster shares."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

#: Where ``stored`` notes its tables, one list for each open ``noted`` block.
_notes: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where none is set and all tasks run in this process."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="riftline-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage: a lost executor costs a reread, not the work before.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/riftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if _notes:
        _notes[-1].append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def noted() -> Iterator[list[str]]:
    """Gives the list of what ``stored`` writes within, for a caller that knows when nobody will read it again."""
    _notes.append([])
    try:
        yield _notes[-1]
    finally:
        _notes.pop()


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Deletes tables, and takes them off the list."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    while paths:
        path = hadoop(paths.pop())
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
