"""Tables written in the middle of a job.

A staged table cuts the lineage: it lies in the folder that the cluster names
in ``spark.checkpoint.dir``, so that a lost executor costs a read, not a
recomputation. Where the setting is absent a local session (tests, a single
machine) gets a folder of its own, which goes when the program ends; on a
cluster, where executors couldn't see it, that is an error. ``cleanup`` deletes
what an application has staged; results that were not yet written may need it.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from trawl.shipping import ship

_own: dict[str, str] = {}
#: Paths of staged tables, in the order in which this program wrote them.
made: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _own:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="trawl-")
        atexit.register(shutil.rmtree, folder, True)
        _own[app] = "file://" + folder
    return _own[app]


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged-{spark.sparkContext.applicationId}"


def staged(df: DataFrame, label: str, **options: int) -> DataFrame:
    """Write ``df`` as Parquet, with the writer's ``options``, to the shared folder and return it reread."""
    spark = df.sparkSession
    ship(spark)
    path = f"{_root(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    made.append(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def read_by(spark: SparkSession, size: int) -> Iterator[None]:
    """Tasks of jobs that run inside read at most about ``size`` bytes of files each, whatever the session allows; less if it says less."""
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    own = spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    spark.conf.set(name, str(min(size, own)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def there(spark: SparkSession, table: DataFrame) -> bool:
    """Whether the files of a staged table still are where it was written."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path((table.inputFiles() or [_root(spark)])[0])
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)


def cleanup(spark: SparkSession) -> None:
    """Delete all tables that this application staged."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def forget(spark: SparkSession, paths: list[str], keep: DataFrame) -> None:
    """Delete staged tables that are done with, but for those that ``keep`` reads."""
    read = keep.inputFiles()
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        if not any(path.getName() in f for f in read):
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def give_back(spark: SparkSession) -> None:
    """Let the driver's two processes return the memory that they have freed, as far as their C library and JVM can (from 17 on)."""
    gc.collect()
    libc, jvm = ctypes.CDLL(None), spark.sparkContext._jvm
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)
    # by reflection, as py4j doesn't see the methods of a class that its module keeps to itself
    java, new = jvm.java.lang, spark.sparkContext._gateway.new_array
    server, name = java.management.ManagementFactory.getPlatformMBeanServer(), jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")

    def call(method: str, *args: object) -> object:
        given = new(java.Object, len(args))
        for k, x in enumerate(args):
            given[k] = x
        kinds = java.Class.forName("javax.management.MBeanServer").getMethods()
        return next(m for m in kinds if m.getName() == method and m.getParameterCount() == len(args)).invoke(server, given)

    if call("isRegistered", name) and any(x.getName() == "systemTrimNativeHeap" for x in call("getMBeanInfo", name).getOperations()):
        call("invoke", name, "systemTrimNativeHeap", None, None)


def settle(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of jobs that have ended: it does so as the driver collects their plans, which takes more than one go."""
    for _ in range(3):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)
