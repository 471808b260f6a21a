"""Tables and files in the folder that the driver and all executors share.

The folder is the one the cluster names in ``spark.checkpoint.dir``.  Where a
session of one machine (a ``local`` master: tests, a laptop) does not set it, one
folder under the system's temporary directory is made for the session and set,
so that later calls agree; anywhere else that is an error, as executors would
not see the driver's folder.
"""

from __future__ import annotations

import contextlib
import contextvars
import posixpath
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_DIR = "spark.checkpoint.dir"
#: What a broadcast may take, by the size counted before.
BROADCAST_BYTES = 32 << 20
#: The open blocks of ``staged_tables``, of each thread its own.
_scopes: contextvars.ContextVar[tuple[list[str], ...]] = contextvars.ContextVar("scopes", default=())


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; nothing is created."""
    base = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set(CHECKPOINT_DIR, base)
    path = f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    for scope in _scopes.get():
        scope.append(path)
    return path


def stage_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: whatever executor is lost later, the files remain.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table, with a broadcast hint if its rows of ``row_bytes`` each come to ``limit`` bytes at most; else as it is, for a shuffle."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


@contextlib.contextmanager
def staged_tables(spark: SparkSession) -> Iterator[None]:
    """Tables and files that this thread stages inside go when the block ends; write what is to stay before that."""
    mine: list[str] = []
    token = _scopes.set((*_scopes.get(), mine))
    try:
        yield
    finally:
        _scopes.reset(token)
        jvm = spark.sparkContext._jvm
        for path in mine:
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def open_fs(uri: str):
    """(filesystem, path) of a ``file:``, ``hdfs:`` or object-store URI."""
    from pyarrow import fs

    if uri.startswith("/"):
        uri = "file://" + uri
    uri = re.sub(r"^file:/+", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


class AtomicFile:
    """Write a file under an attempt's own name, then move it into place.

    A task that runs again (lost executor, speculation) writes the same final
    name with the same bytes, so readers see one whole file or none.
    """

    def __init__(self, uri: str):
        self._fs, self._path = open_fs(uri)
        self._temp = f"{self._path}.{uuid.uuid4().hex}.tmp"

    def __enter__(self):
        self._fs.create_dir(posixpath.dirname(self._path), recursive=True)
        self._out = self._fs.open_output_stream(self._temp)
        return self._out

    def __exit__(self, kind, value, trace):
        self._out.close()
        if kind is None:
            self._fs.move(self._temp, self._path)
        else:
            self._fs.delete_file(self._temp)
