"""Session settings shared by jobs, tests and the bench."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dnslens import dims


def get_spark(app: str = "dnslens", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators rely on; ``conf`` adds or overrides.

    Shuffle sizing is left to AQE: start with many partitions, coalesce the small
    ones, split the skewed ones.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update({key.replace("__", "."): value for key, value in conf.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_local_dirs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session without
    that setting (tests) gets a temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _local_dirs:
        _local_dirs[application] = tempfile.mkdtemp(prefix="dnslens-")
    return _local_dirs[application]


def _hadoop_path(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def folder_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    store, target = _hadoop_path(spark, path)
    return store.exists(target)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names of what lies in a folder."""
    store, target = _hadoop_path(spark, path)
    return [entry.getPath().getName() for entry in store.listStatus(target)]


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate or replaced files, in whatever store it names."""
    store, target = _hadoop_path(spark, path)
    store.delete(target, True)


def written(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder, as Parquet, and read back: later steps see these rows
    whatever the splits or executors are by then."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/written-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def held(df: DataFrame) -> Iterator[tuple[DataFrame, int]]:
    """``df`` worked out once, as a table in the shared folder that is deleted at the end, and its number of rows
    (from the files' footers)."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/held-{uuid.uuid4().hex}"
    df.write.parquet(path)
    try:
        back = spark.read.schema(df.schema).parquet(path)
        yield back, back.count()
    finally:
        delete_folder(spark, path)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the shared folder, so lost executors cost no recomputation."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def broadcast_if_small(df: DataFrame, max_rows: int = dims.BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only when a bounded count shows that it is small."""
    if df.limit(max_rows + 1).count() <= max_rows:
        return F.broadcast(df)
    return df


def spread(df: DataFrame) -> DataFrame:
    """Give a small input enough partitions for the CPU-bound work after it.

    A large table has more splits than the cluster has cores and passes unchanged,
    without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, for the few operators with Python steps (once per application)."""
    application = spark.sparkContext.applicationId
    if application in _shipped:
        return
    root = Path(__file__).resolve().parent
    base = Path(tempfile.mkdtemp(prefix="dnslens-")) / "dnslens"
    archive = shutil.make_archive(str(base), "zip", root.parent, root.name)
    spark.sparkContext.addPyFile(archive)
    _shipped.add(application)
