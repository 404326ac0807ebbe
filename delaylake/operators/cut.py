"""Cut points: a frame that several later steps read is written once."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_ROOTS: dict[str, str] = {}


def _drop(spark: SparkSession, root: str) -> None:
    try:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        return


def work_dir(spark: SparkSession) -> str:
    """This run's folder below ``spark.checkpoint.dir``, which all executors share.

    Where that is unset, a temporary folder takes its place, in local mode alone.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="delaylake-")
        _ROOTS[app] = f"{base.rstrip('/')}/delaylake-cut-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _ROOTS[app])
    return _ROOTS[app]


def cut(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table of Parquet files, so that losing an executor means reading and not computing again."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def uncut(df: DataFrame) -> None:
    """Delete the files of a frame that :func:`cut` returned and nobody reads again."""
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        _drop(df.sparkSession, folder)
