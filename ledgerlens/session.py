"""Spark session defaults and the shared checkpoint folder.

Every operator in the library is a DataFrame → DataFrame function; the
session is only configured here.  On a cluster the session is created by
``spark-submit`` and we only read its settings; ``get_session`` is for
local runs, tests and the bench.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Settings every query relies on: UTC session zone (timestamps are NTZ but
# date functions on LTZ literals must agree with the oracle), ANSI mode on
# (overflow raises instead of wrapping), adaptive execution for runtime
# re-planning of joins, partition coalescing and skewed shuffles.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.parquet.compression.codec": "zstd",
    "spark.sql.timestampType": "TIMESTAMP_NTZ",
}

COMPILED_BYTES = 8000  # HotSpot compiles no longer methods
SORTED_SPLIT = "12m"  # some 400,000 transaction lines in Parquet


def get_session(
    master: str | None = None,
    app_name: str = "ledgerlens",
    shuffle_partitions: int | None = None,
    extra: dict[str, str] | None = None,
) -> SparkSession:
    """Create (or reuse) a session with the library defaults.

    ``master`` is only set for local runs; on a cluster leave it ``None`` so
    the submitter's choice wins.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    conf = dict(SESSION_DEFAULTS)
    conf["spark.ui.enabled"] = "false"
    if shuffle_partitions is not None:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    for key, value in SESSION_DEFAULTS.items():
        spark.conf.set(key, value)
    ensure_checkpoint_dir(spark)
    return spark


def _is_local(spark: SparkSession) -> bool:
    return re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master) is not None


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Return the shared checkpoint folder of this session.

    The folder named by ``spark.checkpoint.dir`` wins.  Only when it is unset
    (tests, local runs) do we pick ``fallback`` or a fresh folder under the
    system temp dir; a cluster without the setting is an error because a
    machine-local folder would not survive the loss of an executor.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None
    )
    if not configured:
        if fallback:
            configured = fallback
        elif _is_local(spark):
            configured = tempfile.mkdtemp(prefix="ledgerlens-ckpt-")
        else:
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at a shared folder "
                "(HDFS/S3/ABFS) so materialised intermediates survive executor loss"
            )
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique path inside the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as Parquet to the shared checkpoint folder.

    Unlike ``persist`` the result survives executor loss, and unlike
    ``checkpoint()`` later readers get column pruning and filter pushdown.
    Use it where two jobs must see the very same rows (ids, partition
    membership) or an expensive intermediate is read several times.  It is
    written below ``folder`` if one is given, for a caller that removes it later.
    """
    spark = df.sparkSession
    path = f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}" if folder else scratch_path(spark, name)
    with shuffles_removed(spark):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries that run inside remove their shuffle files at their end, not when the driver collects its garbage.

    A frame that ran inside would have to write them again if it ran once more.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def smaller_methods(spark: SparkSession) -> Iterator[None]:
    """Steps that run inside are not compiled as a whole where their method is longer than the JVM compiles.

    It would be interpreted; in parts, each is compiled.
    """
    key = "spark.sql.codegen.hugeMethodLimit"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(COMPILED_BYTES))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


@contextmanager
def smaller_scans(spark: SparkSession) -> Iterator[None]:
    """Scans that run inside are cut into splits of ``SORTED_SPLIT`` at most: their rows are sorted in memory."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    size = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    spark.conf.set(key, min(before, SORTED_SPLIT, key=size))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def file_system(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and the path."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, jpath = file_system(spark, path)
    return fs.exists(jpath)


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a file or folder of this library's own output; a missing one is fine."""
    fs, jpath = file_system(spark, path)
    fs.delete(jpath, True)
