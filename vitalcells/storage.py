"""Tables kept in the folder all executors share."""

import hashlib
import json
import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_roots: dict[str, str] = {}
_path_locks: dict[str, threading.RLock] = {}
_guard = threading.Lock()
_holders: dict[tuple[str, int], int] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local session without one gets its own folder."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/vitalcells/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that every executor can reach")
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="vitalcells-")
    return _local_roots[app]


def _file_system(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder exists on the file system the path names."""
    system, target = _file_system(spark, path)
    return system.exists(target)


def size_of(spark: SparkSession, path: str) -> int:
    """Bytes in a file or folder."""
    system, target = _file_system(spark, path)
    return system.getContentSummary(target).getLength()


def is_written(spark: SparkSession, path: str) -> bool:
    """Whether a finished Spark write exists at the path."""
    return exists(spark, f"{path}/_SUCCESS")


def small(df: DataFrame, max_rows: int) -> DataFrame:
    """Mark a lookup for broadcast after checking its size; a larger one is left to Spark."""
    return F.broadcast(df) if df.limit(max_rows + 1).count() <= max_rows else df


def stored(spark: SparkSession, path: str, build: Callable[[], DataFrame],
           partitions: tuple[str, ...] = ()) -> DataFrame:
    """Write a table once and read it from then on.

    A written table survives lost executors, and later readers prune its columns. It is written under
    a name of its own and then renamed, so nobody reads an unfinished one.
    """
    with _guard:
        lock = _path_locks.setdefault(path, threading.RLock())
    with lock:
        if not is_written(spark, path):
            system, target = _file_system(spark, path)
            draft = f"{path}-{uuid.uuid4().hex[:8]}"
            build().write.partitionBy(*partitions).parquet(draft)
            own = _file_system(spark, draft)[1]
            if is_written(spark, path):  # by another process, meanwhile
                system.delete(own, True)
            else:
                system.delete(target, True)
                if not system.rename(own, target) and not is_written(spark, path):
                    raise OSError(f"cannot rename {draft} to {path}")
    return spark.read.parquet(path)


@contextmanager
def cached(df: DataFrame) -> Iterator[DataFrame]:
    """A table kept as long as anybody works on it.

    Spark knows a cached table by its plan and drops it for all at the first unpersist, so that of two
    models on the same cells the slower one would compute them again in each of its passes.
    """
    key = (df.sparkSession.sparkContext.applicationId, df.semanticHash())
    with _guard:
        _holders[key] = _holders.get(key, 0) + 1
        df.persist()
    try:
        yield df
    finally:
        with _guard:
            _holders[key] -= 1
            if not _holders[key]:
                del _holders[key]
                df.unpersist()


def _short(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def input_state(spark: SparkSession, path: str) -> dict:
    """What tells whether an input has changed: bytes, files, and when it was last written."""
    system, target = _file_system(spark, path)
    summary = system.getContentSummary(target)
    return {"path": path, "bytes": summary.getLength(), "files": summary.getFileCount(),
            "written": system.getFileStatus(target).getModificationTime()}


class Store:
    """Tables that outlive their process, under `root`.

    A table's folder is named by what it is computed by (the text of its rules), from which paths, and in
    which state these are. So a later process with the same rules and unchanged inputs reads it; if an
    input has changed the table is built anew, and the one of the old state is removed.
    """

    def __init__(self, spark: SparkSession, root: str, inputs: list[str], rules: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.states = [input_state(spark, path) for path in sorted(inputs)]
        self.rules = _short(rules)
        self._of = f"{self.rules}-{_short(json.dumps([s['path'] for s in self.states]))}"
        self._state = _short(json.dumps(self.states))

    def path(self, name: str) -> str:
        return f"{self.root}/{name}/{self._of}-{self._state}"

    def table(self, name: str, build: Callable[[], DataFrame], partitions: tuple[str, ...] = ()) -> DataFrame:
        path = self.path(name)
        if not is_written(self.spark, path):
            stored(self.spark, path, build, partitions)
            self._describe(path)
            self._remove_stale(name)
        return self.spark.read.parquet(path)

    def manifest(self, name: str) -> dict:
        """The rules' digest and the inputs' states behind a table."""
        system, target = _file_system(self.spark, f"{self.path(name)}/_manifest.json")
        stream = system.open(target)
        try:
            return json.loads(self.spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _describe(self, path: str) -> None:
        system, target = _file_system(self.spark, f"{path}/_manifest.json")
        out = system.create(target, True)
        try:
            out.write(bytearray(json.dumps({"rules": self.rules, "inputs": self.states}).encode()))
        finally:
            out.close()

    def _remove_stale(self, name: str) -> None:
        system, folder = _file_system(self.spark, f"{self.root}/{name}")
        for status in system.listStatus(folder):
            other = status.getPath().getName()
            if other.startswith(f"{self._of}-") and not other.startswith(f"{self._of}-{self._state}"):
                system.delete(status.getPath(), True)


def lasting_folder(spark: SparkSession) -> str:
    """Where tables outlive a process: in the checkpoint folder, if the session names one."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    return f"{root.rstrip('/')}/vitalcells/store" if root else f"{shared_folder(spark)}/store"
