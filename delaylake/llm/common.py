"""Shared plumbing of the corpus operators: cut points, text batches, folders.

Every cut of a lineage goes through :func:`stored`, which writes Parquet into
the folder that the session names in ``spark.checkpoint.dir`` (all executors
share it), so a lost executor costs a re-read and not a recomputation.
"""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Iterable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_ROOTS: dict[str, str] = {}
_SHIPPED: set[str] = set()
#: Where it is set, Spark removes the shuffle files of a statement when that ends.
RELEASE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def ship(spark: SparkSession) -> None:
    """Send this package's modules to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    package = Path(__file__).resolve().parent.parent
    target = os.path.join(tempfile.mkdtemp(prefix="delaylake-code-"), "delaylake-code.zip")
    with zipfile.ZipFile(target, "w") as z:
        for source in sorted(package.rglob("*.py")):
            z.write(source, source.relative_to(package.parent))
    spark.sparkContext.addPyFile(target)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The run's own folder below ``spark.checkpoint.dir``.

    Where the setting is absent, a temporary folder takes its place, in local mode alone.
    """
    app = spark.sparkContext.applicationId
    if app not in _ROOTS:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="delaylake-")
        root = f"{base.rstrip('/')}/delaylake-{uuid.uuid4().hex}"
        _ROOTS[app] = root
        atexit.register(_drop, spark, root)
    return _ROOTS[app]


def _drop(spark: SparkSession, root: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001 - the session may be gone at interpreter exit
        return


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and return it as a table read from there.

    With ``release`` the shuffle files behind it go once it is written; else they
    stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    before = spark.conf.get(RELEASE, None)
    if release:
        spark.conf.set(RELEASE, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if release:
            spark.conf.unset(RELEASE) if before is None else spark.conf.set(RELEASE, before)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts_of(df: DataFrame) -> DataFrame:
    """``doc_id, text`` with null text as the empty text; other columns are left out."""
    ship(df.sparkSession)
    return df.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def strings(column: pa.Array | pa.ChunkedArray) -> list[str]:
    return [x if x is not None else "" for x in column.to_pylist()]


def pieces(batches: Iterable[pa.RecordBatch], size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` text bytes (a longer text is a batch of its own)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        start = 0
        total = max(1, batch.nbytes)
        step = max(1, int(n * size / total)) if total > size else n
        while start < n:
            yield batch.slice(start, step)
            start += step


def bounded_sample(df: DataFrame, keys: list[str], limit: int, distinct: bool = False) -> DataFrame:
    """At most ``limit`` rows, those with the least hash of ``keys``.

    A bound on the hash, from the number of rows, thins the table where it is
    read, so what is sorted, and what reaches the driver, does not grow with it.
    Keys should tell rows apart. With ``distinct`` equal rows are one, the bound
    comes from the (approximate) number of distinct keys, and rows are taken
    without it where fewer than ``limit`` pass: the sample is always full.
    """
    h = F.xxhash64(*keys)
    n = df.agg(F.approx_count_distinct(h)).first()[0] if distinct else df.count()
    rows = df.distinct() if distinct else df
    # half as many again as needed, and some for small limits
    share = (1.5 * limit + 200) / max(n, 1)
    if n > 2 * limit and share < 1:
        thin = df.filter(h < F.lit(int(-(1 << 63) + share * ((1 << 64) - 1))))
        if not distinct:
            rows = thin
        else:
            thin = stored(thin.distinct(), "sample")
            rows = thin if thin.count() >= limit else rows
    return rows.orderBy(h, *keys).limit(limit)
