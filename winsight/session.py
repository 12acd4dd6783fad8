"""Session helpers: a local session for tests and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JError, Py4JJavaError
from pyspark.sql import SparkSession

#: Folder of this process when nothing is configured on a local master (tests, benches).
_LOCAL: list[str] = []
#: Scratch folders to delete at the end: the JVM that can reach them, and the path.
_SCRATCH: list[tuple] = []


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "winsight") -> SparkSession:
    """Single-JVM session for tests and benches (cluster jobs bring their own)."""
    spark = (SparkSession.builder.master(f"local[{cores}]").appName(app)
             .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
             .config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
             .config("spark.sql.adaptive.skewJoin.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC")
             .config("spark.ui.enabled", "false")
             # no per-call Python call-site capture: it costs several JVM round trips per function
             .config("spark.python.sql.dataFrameDebugging.enabled", "false")
             .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
             .config("spark.driver.memory", "8g")
             .getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Looked up in one order: the session setting, then the context's checkpoint
    folder.  A folder is chosen here only for a local master; on any other
    master a missing setting raises, because a machine-local folder would be
    invisible to the other executors.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not path:
        master = sc.master or ""
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError(f"spark.checkpoint.dir is not set (master {master}); name a folder that every executor sees")
        if not _LOCAL:
            _LOCAL.append(tempfile.mkdtemp(prefix="winsight-checkpoints-"))
        path = _LOCAL[0]
        os.makedirs(path, exist_ok=True)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A fresh sub-folder of the checkpoint folder for written intermediate tables.

    It is deleted when the driver's process ends, unless it is to be kept (the
    output and progress of streaming queries).
    """
    path = f"{checkpoint_dir(spark).rstrip('/')}/winsight/{name}-{uuid.uuid4().hex[:12]}"
    if not keep:
        if not _SCRATCH:
            atexit.register(clean_scratch)
        _SCRATCH.append((spark.sparkContext._jvm, path))
    return path


def clean_scratch() -> None:
    """Delete the scratch folders of this process (also after ``spark.stop()``)."""
    while _SCRATCH:
        jvm, path = _SCRATCH.pop()
        with contextlib.suppress(Py4JError, OSError):  # the JVM may be gone already
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(target, True)


def _on_file_system(spark: SparkSession, path: str):
    """The file system of a path as Spark reaches it, and the path."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch folder this process wrote, through Spark's file system of that path."""
    fs, p = _on_file_system(spark, path)
    fs.delete(p, True)


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _on_file_system(spark, path)
    return fs.exists(p)


def make_folder(spark: SparkSession, path: str) -> None:
    fs, p = _on_file_system(spark, path)
    fs.mkdirs(p)


def written_files(spark: SparkSession, path: str) -> list[str]:
    """The files of one write into a folder, in the order of the tasks that wrote them (their names begin with it)."""
    fs, p = _on_file_system(spark, path)
    return sorted(str(s.getPath()) for s in fs.listStatus(p) if s.isFile() and s.getPath().getName()[0] not in "._")


def age_in_order(spark: SparkSession, files: list[str]) -> bool:
    """Make each file a second older than the next, and the last as of now; False where the store keeps no set times."""
    now = int(time.time()) * 1000
    times = []
    for i, file in enumerate(files):
        fs, p = _on_file_system(spark, file)
        wanted = now - 1000 * (len(files) - 1 - i)
        try:
            fs.setTimes(p, wanted, -1)
        except Py4JJavaError:  # not supported, or not allowed
            return False
        times.append(fs.getFileStatus(p).getModificationTime())
        if times[-1] != wanted:
            return False
    return True


def materialise(df, name: str):
    """Write ``df`` as Parquet under the shared folder and read it back: cuts the
    lineage with files that survive a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
