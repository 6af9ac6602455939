"""Session helpers."""

from __future__ import annotations

import contextlib
import hashlib
import os
import shutil
import tempfile
import threading
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str | None = None, app: str = "codesieve", shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """A session tuned for the review jobs: AQE with skew-join splitting and
    runtime broadcast conversion (size checked from shuffle statistics)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster (``spark.checkpoint.dir``).

    Only in local mode with the setting absent (tests) a folder of our own is
    used; on a cluster a missing setting is an error, never a machine-local folder.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by the cluster")
        d = tempfile.mkdtemp(prefix="codesieve-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_SCOPE = threading.local()


def _file_system(spark: SparkSession, path: str):
    hpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hpath, hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


@contextlib.contextmanager
def intermediates(spark: SparkSession, name: str):
    """Intermediates written inside (by this thread) lie in one folder, which goes at the end, also of a failed block.

    The folder is named by ``name`` alone and lies beside the session's own checkpoint folder: what a killed driver left
    under a name goes when a later session does the same work again.  Nothing read lazily from an intermediate
    may be used after the block.
    """
    parent = checkpoint_dir(spark).rstrip("/").rpartition("/")[0]
    path = f"{parent}/codesieve-{hashlib.sha256(name.encode()).hexdigest()[:32]}"
    hpath, fs = _file_system(spark, path)
    fs.delete(hpath, True)
    fs.deleteOnExit(hpath)
    outer, _SCOPE.path = getattr(_SCOPE, "path", None), path
    try:
        yield path
    finally:
        _SCOPE.path = outer
        fs.delete(hpath, True)
        fs.cancelDeleteOnExit(hpath)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder name for an intermediate: in the folder of ``intermediates``, else under the checkpoint folder and
    removed when the session's JVM ends."""
    scope = getattr(_SCOPE, "path", None)
    if scope:
        return f"{scope}/{name}-{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hpath, fs = _file_system(spark, path)
    fs.deleteOnExit(hpath)
    return path


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """A narrow intermediate that several later steps read, written once to the shared folder.

    Its lineage is cut (a lost executor does not recompute it differently),
    and the planner knows its size from the files, so a small one is
    broadcast and a large one is not.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package where the job was started without --py-files or PYTHONPATH."""
    sc = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.realpath(__file__)))
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if sc.master.startswith("local["):
        known.add(os.path.realpath(os.getcwd()))
    if sc.applicationId in _SHIPPED or root in known or not os.path.isdir(root):
        return
    archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "codesieve"), "zip", root, "codesieve")
    sc.addPyFile(archive)
    _SHIPPED.add(sc.applicationId)
