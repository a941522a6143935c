"""Scratch tables in a folder that all machines share."""
from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import DataFrame, SparkSession

#: Bytes by which the driver's heap may grow between two tables before its garbage is collected.
GARBAGE = 64 << 20
_made: dict[str, str] = {}
_used: dict[str, int] = {}
_scope: ContextVar[list | None] = ContextVar("scope", default=None)


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``. Where it is unset, a folder of our own on a
    local master, and the warehouse, which a cluster's machines share, on any other."""
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    key = spark.sparkContext.applicationId
    if key not in _made:
        if not base:
            local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
            base = "file://" + tempfile.mkdtemp(prefix="loomline-") if local else spark.conf.get("spark.sql.warehouse.dir")
        _made[key] = f"{base}/loomline-{uuid.uuid4().hex}"
        atexit.register(_drop, spark, _made[key])
    return _made[key]


def _drop(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None and not spark.sparkContext._jsc.sc().isStopped():
            delete(spark, path)
    except Exception:  # noqa: BLE001  the session went first; nothing is left to clean with
        pass


def delete(spark: SparkSession, path: str) -> None:
    """Delete a scratch table through Spark's own file system layer."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def give_back(spark: SparkSession) -> None:
    """Return to the system what the driver's JVM holds of finished queries.

    An operator of many queries leaves a plan, its metrics and the memory of compilers and threads behind for each. The
    heap grows rather than being collected, and the C library keeps what is freed in every thread's arena. Collected
    plans also let Spark drop their shuffle files and broadcasts. Virtual machines that cannot trim do without.
    """
    jvm, key = spark._jvm, spark.sparkContext.applicationId
    heap = jvm.java.lang.Runtime.getRuntime()
    if heap.totalMemory() - heap.freeMemory() > _used.get(key, 0) + GARBAGE:
        jvm.java.lang.System.gc()
        _used[key] = heap.totalMemory() - heap.freeMemory()
    with contextlib.suppress(Py4JError):  # Java from 17.0.9 on, with the C library of GNU
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServerConnection").getMethods() if m.getName() == "invoke")
        args = spark.sparkContext._gateway.new_array(jvm.java.lang.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def materialise(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back: lineage ends in files that outlive any executor.

    The table stays until ``free``, the end of the surrounding ``scratch_tables`` (not if ``keep``), or of the session.
    """
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    give_back(spark)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    if _scope.get() is not None and not keep:
        _scope.get().append(path)
    return out


def free(*tables: DataFrame) -> None:
    """Delete materialised tables that nothing to come reads."""
    for t in tables:
        if _scope.get() is not None and t._scratch in _scope.get():
            _scope.get().remove(t._scratch)
        delete(t.sparkSession, t._scratch)


@contextlib.contextmanager
def scratch_tables(spark: SparkSession):
    """Tables materialised inside are deleted at the end; whatever reads them must have been written by then. Tables
    that other code of the session made are left alone."""
    token = _scope.set([])
    try:
        yield
    finally:
        paths = _scope.get()
        _scope.reset(token)
        for path in paths:
            delete(spark, path)
