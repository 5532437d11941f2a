"""Keeping intermediate frames that are read more than once."""

from __future__ import annotations

import re
import tempfile
import uuid
import warnings
from urllib.parse import urlsplit

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from grainwise.errors import AuditError


#: Folders that executors have been seen to share, by application.
_TRIED: set[tuple[str, str]] = set()


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _seen_by_all(spark: SparkSession, folder: str) -> bool:
    """Whether the driver finds what tasks on all cores write under ``folder``: a mount that
    all machines share is a path like any other.  Tried once per application."""
    known = (spark.sparkContext.applicationId, folder)
    if known not in _TRIED:
        path, tasks = f"{folder.rstrip('/')}/grainwise-{uuid.uuid4().hex}", 2 * spark.sparkContext.defaultParallelism
        try:
            spark.range(0, tasks, 1, tasks).write.parquet(path)
            if spark.read.schema("id bigint").parquet(path).count() < tasks:
                return False
        finally:
            _delete(spark, path)
        _TRIED.add(known)
    return True


def _shared(spark: SparkSession, setting: str, folder: str) -> str:
    """``folder``, unless executors run on other machines and it lies on each one's own disk."""
    if spark.sparkContext.master.startswith("local"):
        return folder
    scheme = urlsplit(folder).scheme
    if not scheme:  # a bare path lies on the default file system
        scheme = urlsplit(spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS", "file:///")).scheme
    if scheme == "file":
        refused = f"{setting} is {folder}, which executors on other machines do not share"
        try:
            seen = _seen_by_all(spark, folder)
        except Exception as e:  # it cannot be written, whatever the reason
            raise AuditError(f"{refused}: {str(e).splitlines()[0] if str(e) else type(e).__name__}") from e
        if not seen:
            raise AuditError(f"{refused}.")
    return folder


def checkpoint_folder(spark: SparkSession) -> str | None:
    """The shared folder the cluster names for checkpoints, if it names one.  A folder of
    one machine is refused where executors run on others; a mount they share is not."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    return _shared(spark, "spark.checkpoint.dir", folder) if folder else None


def new_folder(spark: SparkSession) -> str:
    """Path of a new folder for tables that every executor can read, deleted when the session
    ends.  It lies under ``spark.checkpoint.dir``; unset, that is a temporary folder in local
    mode and the warehouse on a cluster, which must then be shared."""
    top = checkpoint_folder(spark)
    if not top and re.match(r"local(\[|$)", spark.sparkContext.master):
        top = tempfile.gettempdir()
    if not top:
        top = _shared(spark, "spark.sql.warehouse.dir", spark.conf.get("spark.sql.warehouse.dir"))
    path = f"{top.rstrip('/')}/grainwise-{uuid.uuid4().hex}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


class Shelf:
    """Holds the intermediate frames of one audit.

    With ``spark.checkpoint.dir`` set, a frame is written there as Parquet and read
    back: this cuts the lineage, survives lost executors and gives the next join a
    plain scan.  Without it, or where executors do not share that folder, the frame
    is persisted and rebuilt from its lineage when an executor is lost.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        try:
            folder = checkpoint_folder(spark)
        except AuditError as e:
            warnings.warn(f"{e} Frames are persisted instead.", stacklevel=2)
            folder = None
        self.folder = f"{folder.rstrip('/')}/grainwise-{uuid.uuid4().hex}" if folder else None
        self._held: list[DataFrame] = []
        self._written = 0

    def keep(self, df: DataFrame) -> DataFrame:
        """A frame equal to ``df`` that is computed once."""
        if self.folder is None:
            return self.hold(df)
        path = f"{self.folder}/{self._written}"
        self._written += 1
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def hold(self, df: DataFrame) -> DataFrame:
        """Persist ``df`` until the audit is done (short lineage, read twice)."""
        df = df.persist(StorageLevel.MEMORY_AND_DISK)
        self._held.append(df)
        return df

    def close(self) -> None:
        """Drop persisted frames and delete written ones."""
        for df in self._held:
            df.unpersist()
        self._held.clear()
        if self._written:
            _delete(self.spark, self.folder)
            self._written = 0
