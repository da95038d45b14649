"""Working tables in the folder that every node of the cluster shares."""

from __future__ import annotations

import ctypes
import re
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Folders of sessions on one machine that name none, by application.
_local: dict[str, str] = {}
#: Seconds from one trim of the driver's memory to the next, at least, and the end of the last one by application.
TRIM_S = 4
_trimmed: dict[str, float] = {}


def shared_dir(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``. Where it is unset, a session on one machine gets a local folder; on a cluster that raises, as executors could not share it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir is not set; it has to name a folder that the driver and all executors share")
    if app not in _local:
        _local[app] = "file://" + tempfile.mkdtemp(prefix="pagequery-shared-")
    return _local[app]


def _at(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path below the shared folder; it goes when the application ends, if not before."""
    target, store = _at(spark, f"{shared_dir(spark)}/pagequery-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}")
    store.deleteOnExit(target)
    return re.sub("^file:/+", "file:///", store.makeQualified(target).toString())


@contextmanager
def _shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is run inside are deleted when it ends: what it wrote is all that is read later."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    with suppress(PySparkException):  # a Spark without this setting leaves it to its cleaner
        spark.conf.set(name, "true")
    try:
        yield
    finally:
        with suppress(PySparkException):
            spark.conf.set(name, before) if before is not None else spark.conf.unset(name)


def trim(spark: SparkSession) -> None:
    """Gives memory that the driver's JVM and Python have freed back to the system.

    The C library keeps what their threads free, for each of its arenas. Every
    plan leaves some behind when it is compiled, so many small plans in a row
    hold hundreds of MB that nothing uses. A JVM without the command keeps it.
    """
    app = spark.sparkContext.applicationId
    if time.monotonic() - _trimmed.get(app, -TRIM_S) < TRIM_S:
        return
    with suppress(Py4JError):
        jvm, gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        kinds = [jvm.java.lang.Class.forName(name) for name in ("javax.management.ObjectName", "java.lang.String", "[Ljava.lang.Object;", "[Ljava.lang.String;")]
        values = [jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap", gateway.new_array(jvm.java.lang.Object, 0), gateway.new_array(jvm.java.lang.String, 0)]
        signature, given = gateway.new_array(jvm.java.lang.Class, len(kinds)), gateway.new_array(jvm.java.lang.Object, len(values))
        for k, (kind, value) in enumerate(zip(kinds, values)):
            signature[k], given[k] = kind, value
        # By the interface's method: the class behind it is not open to callers.
        invoke = jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethod("invoke", signature)
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), given)
    with suppress(AttributeError, OSError):  # other C libraries than glibc
        ctypes.CDLL(None).malloc_trim(0)
    _trimmed[app] = time.monotonic()


def stored(df: DataFrame, tag: str, *done: DataFrame) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: this cuts the lineage, and a lost executor costs no recomputation.

    ``done`` are stored tables that nothing reads from here on; they are deleted.
    """
    spark = df.sparkSession
    path = new_path(spark, tag)
    with _shuffles_go(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    drop(*done)
    trim(spark)
    return out


def drop(*tables: DataFrame | None) -> None:
    """Deletes stored tables that no later step reads."""
    for table in tables:
        path = getattr(table, "_stored_at", None)
        if path:
            target, store = _at(table.sparkSession, path)
            store.delete(target, True)
            table._stored_at = None


def free_names(taken: Iterable[str], *wanted: str) -> list[str]:
    """``wanted``, each with as many more underscores as it takes to differ from all column names in ``taken``."""
    held, out = {c.lower() for c in taken}, []
    for name in wanted:
        while name.lower() in held:
            name += "_"
        held.add(name.lower())
        out.append(name)
    return out


def numbered(df: DataFrame) -> DataFrame:
    """The same columns called by their place, for functions over all of them: Spark resolves some names with dots only if they are quoted."""
    return df.toDF(*[f"c{k}" for k in range(len(df.columns))])


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and backticks included."""
    return F.col(f"`{name.replace('`', '``')}`")
