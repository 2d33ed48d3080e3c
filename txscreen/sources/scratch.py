"""Tables written on the way, in the folder all executors share.

A written table cuts the lineage, survives the loss of executors and, unlike a
checkpointed one, is read column by column.
"""

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator, Mapping
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass, field

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class _Job:
    """A database with a folder of its own, and the frames kept on executors' disks meanwhile."""

    database: str
    folder: str
    kept: list[DataFrame] = field(default_factory=list)


# The innermost job that is running.
_job: ContextVar[_Job | None] = ContextVar("job", default=None)

# Folders made for local sessions; they go when the process ends.
_made: list[tempfile.TemporaryDirectory] = []

#: Set to true where ``file:`` names a file system that all machines mount.
SHARED_FILES = "spark.txscreen.sharedFiles"


def _root(spark: SparkSession) -> str:
    context = spark.sparkContext
    local = context.master.startswith("local")
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if root:
        shared = str(spark.conf.get(SHARED_FILES, None)).lower() == "true"
        if root.startswith("file:") and not local and not shared:
            raise ValueError(f"{root} may be a folder of one machine; set {SHARED_FILES} if not")
        return root.rstrip("/")
    if not local:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    _made.append(tempfile.TemporaryDirectory(prefix="txscreen-", ignore_cleanup_errors=True))
    context.setCheckpointDir(_made[-1].name)
    return context.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder, or the running job's, that nobody has used yet."""
    job = _job.get()
    return f"{job.folder if job else _root(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(
    df: DataFrame,
    name: str,
    *,
    partition_by: tuple[str, ...] = (),
    bucket_by: tuple[str, ...] = (),
    buckets: int = 0,
) -> DataFrame:
    """Write ``df`` as Parquet and return a scan of what was written.

    The returned DataFrame reads the table whenever it is run, so the table
    stays; inside ``job_folder`` or ``stored_result`` until that ends.

    With ``bucket_by`` the table has ``buckets`` buckets by these columns, each
    sorted by them, so that tables alike join without a shuffle. Spark knows
    buckets by the catalog only: outside of a job the table is listed in the
    current database.
    """
    spark, job = df.sparkSession, _job.get()
    writer = df.write.format("parquet").partitionBy(*partition_by)
    if bucket_by:
        writer = writer.bucketBy(buckets, *bucket_by).sortBy(*bucket_by)
    if job or bucket_by:
        table = f"{re.sub('[^A-Za-z0-9]', '_', name)}_{uuid.uuid4().hex}"
        if job:
            table = f"{job.database}.{table}"
        else:
            writer = writer.option("path", new_path(spark, name))
        writer.saveAsTable(table)
        return spark.table(table).select(*df.columns)
    path = new_path(spark, name)
    writer.save(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_on_disk(df: DataFrame) -> DataFrame:
    """``df``, computed once and kept partition by partition on the executors' disks.

    A partition that is lost with its executor is computed again, so ``df``
    must give the same rows in the same order each time. It is let go when the
    running job ends; outside of one, ``unpersist`` does it.
    """
    kept = df.persist(StorageLevel.DISK_ONLY)
    kept.count()
    if job := _job.get():
        job.kept.append(kept)
    return kept


@contextmanager
def job_folder(spark: SparkSession) -> Iterator[str]:
    """Keep the tables stored meanwhile in one database and folder, and drop both at the end.

    The folder is the job's own, below the shared one. Collect or write the
    results before the end. Jobs may be nested: each drops its own tables.
    """
    name = f"job_{uuid.uuid4().hex}"
    job = _Job(name, f"{_root(spark)}/{name}")
    place = job.folder.replace("\\", "\\\\").replace("'", "\\'")
    spark.sql(f"CREATE DATABASE {name} LOCATION '{place}'")
    token = _job.set(job)
    try:
        yield job.folder
    finally:
        _job.reset(token)
        for kept in job.kept:
            kept.unpersist()
        spark.sql(f"DROP DATABASE {name} CASCADE")


def stored_result(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """What ``build`` returns, stored; the tables it has stored on the way are dropped.

    The result belongs to the job that was running before, or stays if none was.
    """
    before = _job.get()
    with job_folder(spark):
        result = build()
        inner = _job.set(before)
        try:
            return materialize(result, name)
        finally:
            _job.reset(inner)


@contextmanager
def session_settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Session settings for the time being."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
