"""Session set-up, staging of intermediate tables and broadcast size checks."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# A side is broadcast only after its row count was checked against one of these.
MAX_BROADCAST_ROWS = 200_000
MAX_BROADCAST_TERMS = 1_000_000
GROUP_BYTES = 1 << 24  # of a row group where tasks are to share a file
OPEN_BYTES = 1 << 16  # what opening a small file counts as where a task is to read many

# Parquet options of what is written to be read again: integers as differences of few bits, all of it compressed well
SMALL = {"compression": "zstd", "parquet.writer.version": "v2"}

_local_root: str | None = None


def local_session(cores: str = "8", app: str = "folioscope") -> SparkSession:
    """Session for tests and the benchmark; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def staging_root(spark: SparkSession) -> str | None:
    """This application's folder in the shared one the cluster names.

    Only a local master without such a setting gets a private folder.
    """
    global _local_root
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            return None
        if _local_root is None:
            _local_root = tempfile.mkdtemp(prefix="folioscope-")
            atexit.register(shutil.rmtree, _local_root, ignore_errors=True)
        shared = _local_root
    return f"{shared.rstrip('/')}/folioscope-{spark.sparkContext.applicationId}"


def drop_staged(spark: SparkSession) -> None:
    """Delete what this application staged; results that still read it become invalid."""
    root = staging_root(spark)
    if root is not None:
        _delete(spark, root)


def _delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)


@contextmanager
def small_batches(spark: SparkSession, rows: int) -> Iterator[None]:
    """Arrow batches of at most `rows` rows for what is run inside; a task holds them in the JVM and in Python."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    held = int(before)
    spark.conf.set(name, rows if held <= 0 else min(held, rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Scans that run inside give a task thousands of small files instead of a few dozen."""
    name = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(name)
    spark.conf.set(name, OPEN_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def path_exists(spark: SparkSession, path: str) -> bool:
    """Is there a file or folder, in whatever store Spark reads."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(place)


def is_folder(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return files.getFileStatus(place).isDirectory()


def local_path(spark: SparkSession, path: str) -> str | None:
    """The path for `open` where it is one of a file system that is mounted, as the shared folder of executors may be."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    return place.toUri().getPath() if files.getUri().getScheme() == "file" else None


def stage(df: DataFrame, name: str, by: str | None = None, group: int | None = None) -> DataFrame:
    """Cut lineage: write `df` as Parquet in the shared folder and read it back.

    With `by`, a column of few values, a read of one value reads its own folder only.  With `group`, files
    have row groups of so many bytes.  A row group is read by one task, so costly work is dealt more evenly.

    A lost executor then costs a re-read, not a recomputation.  Without a shared
    folder the rows are persisted and stay recomputable from their lineage.
    """
    spark = df.sparkSession
    root = staging_root(spark)
    if root is None:
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root}/staged/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    writer = writer if by is None else writer.partitionBy(by)
    (writer if group is None else writer.option("parquet.block.size", group)).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def staged(df: DataFrame, name: str) -> Iterator[DataFrame]:
    """As `stage`, for what is read inside only: the copy is deleted at the end."""
    spark = df.sparkSession
    root = staging_root(spark)
    if root is None:
        held = df.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            yield held
        finally:
            held.unpersist()
        return
    path = f"{root}/staged/{name}-{uuid.uuid4().hex}"
    try:
        df.write.option("compression", "zstd").parquet(path)
        yield spark.read.schema(df.schema).parquet(path)
    finally:
        _delete(spark, path)


def stage_all(parts: list[DataFrame], name: str) -> DataFrame:
    """One table of many parts, run and written one after the other.

    The parts are read back by a single scan, so the plan does not grow with their number.
    """
    if len(parts) == 1:
        return parts[0]
    spark = parts[0].sparkSession
    root = staging_root(spark)
    if root is None:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole.persist(StorageLevel.MEMORY_AND_DISK)
    path = f"{root}/staged/{name}-{uuid.uuid4().hex}"
    for part in parts:
        part.write.option("compression", "zstd").mode("append").parquet(path)
    return spark.read.schema(parts[0].schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Shuffle a scan only when it has fewer splits than the cores could work on.

    A file of one row group is a single task however large; a scan of many files is left
    as it is.
    """
    if df.rdd.getNumPartitions() >= 2 * df.sparkSession.sparkContext.defaultParallelism:
        return df
    return df.repartition(*keys)


def fits(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> bool:
    """True when `df` holds at most `rows` rows; reads no more than that."""
    return df.limit(rows + 1).count() <= rows


def broadcast_if_small(df: DataFrame, rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast hint behind a size check; otherwise the shuffle join stays."""
    return F.broadcast(df) if fits(df, rows) else df
