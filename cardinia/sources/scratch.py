"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import ctypes
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Spark's setting by which a query's shuffle files go when it ends, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: The only local folder, made where ``spark.checkpoint.dir`` is unset (single-machine tests).
_own: list[str] = []
#: The tables of the scopes that are open.
_scopes: ContextVar[tuple[list[DataFrame], ...]] = ContextVar("scopes", default=())
#: Folders of applications that are marked to go when their JVM ends.
_marked: set[str] = set()
#: Seconds between two times that the driver gives memory back, and when it did last.
_PAUSE = 2.0
_given: list[float] = []


def _files(spark: SparkSession, path: str):
    """The JVM's path, and the file system that it is on."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def scratch_dir(spark: SparkSession) -> str:
    """This application's folder under ``spark.checkpoint.dir``; it goes when the application ends."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="cardinia-"))
        named = f"file://{_own[0]}"
    folder = f"{named.rstrip('/')}/cardinia-{spark.sparkContext.applicationId}"
    if folder not in _marked:
        path, files = _files(spark, folder)
        files.mkdirs(path)
        files.deleteOnExit(path)
        _marked.add(folder)
    return folder


def give_back(spark: SparkSession) -> None:
    """Gives the memory that the driver's Python and its JVM have freed back to the system, every ``_PAUSE`` seconds at most.

    The C library keeps for each of them the most that compiling, planning, collecting
    and fitting have taken, several hundred MB over a long run. A JVM that has no such
    command (it came with JDK 17.0.9 and 21) keeps its part.
    """
    if _given and time.monotonic() - _given[-1] < _PAUSE:
        return
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)
    with suppress(Py4JError):
        _trim_jvm(spark)
    _given[:] = [time.monotonic()]


def _trim_jvm(spark: SparkSession) -> None:
    # By reflection: the server's own class is not open to Py4J, its interface is.
    gateway, jvm = spark.sparkContext._gateway, spark._jvm
    kinds = [jvm.java.lang.Class.forName(x) for x in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
    types, given = gateway.new_array(jvm.java.lang.Class, 4), gateway.new_array(jvm.java.lang.Object, 4)
    for q, kind in enumerate(kinds):
        types[q] = kind
    given[0], given[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
    server = jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", types).invoke(server, given)


def materialised(df: DataFrame, name: str, lasting: bool = False) -> DataFrame:
    """``df`` written as a table in the shared folder and read again; ``lasting`` ones outlive any scope.

    This cuts the lineage: a lost executor costs only the reading of a file. The shuffle
    files that it took are deleted, and memory that the driver has freed is given back.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    if _scopes.get() and not lasting:
        _scopes.get()[-1].append(out)
    return out


@contextmanager
def scope(*kept: DataFrame) -> Iterator[list[DataFrame]]:
    """Tables that are written inside are deleted at the end, but for those in the list that it gives: these outlive it."""
    own: list[DataFrame] = []
    keep: list[DataFrame] = list(kept)
    token = _scopes.set((*_scopes.get(), own))
    try:
        yield keep
    finally:
        _scopes.reset(token)
        paths = {x.written_at for x in keep}
        discard(*[t for t in own if t.written_at not in paths])
        if _scopes.get():
            _scopes.get()[-1].extend(t for t in own if t.written_at in paths)


def discard(*tables: DataFrame | None) -> None:
    """Deletes ``materialised`` tables that nothing reads any more."""
    for t in tables:
        path = getattr(t, "written_at", None)
        if path is not None:
            p, files = _files(t.sparkSession, path)
            files.delete(p, True)
