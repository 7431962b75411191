"""Tables that cut lineage, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []
_made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is the one named in ``spark.checkpoint.dir``.  Where that is unset, a
    local session gets a folder of its own, removed at exit; any other session
    gets a folder below the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if spark.sparkContext.master.startswith("local["):
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="docpipe-"))
            atexit.register(shutil.rmtree, _own[0], True)
        return f"file://{_own[0]}"
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_docpipe_scratch"


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which :func:`clear` deletes."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made.append(path)
    return path


def clear(spark: SparkSession) -> None:
    """Delete all that this process has put into the shared folder.

    Results that were not yet written or collected can't be made afterwards.
    """
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while _made:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    The copy cuts the lineage, so that what follows neither repeats the work
    nor depends on executors that may be lost.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
