"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import tempfile
import time

from pyspark.sql import SparkSession

# Settings every job relies on. AQE re-plans joins from real shuffle sizes
# (runtime broadcast, skew-join splitting, partition coalescing); UTC keeps
# epoch-millisecond arithmetic independent of the machine zone.
SESSION_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "quoteflow", extra: dict | None = None) -> SparkSession:
    """Return (or create) a session with the engine's settings applied.

    ``master`` is only used when no session exists yet; on a cluster the
    launcher decides it.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in SESSION_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    apply_runtime_conf(spark)
    return spark


def apply_runtime_conf(spark: SparkSession) -> None:
    """Set the runtime-modifiable settings on an existing session and make
    sure executors can import this package."""
    for k in ("spark.sql.session.timeZone", "spark.sql.adaptive.enabled",
              "spark.sql.adaptive.skewJoin.enabled"):
        try:
            spark.conf.set(k, SESSION_CONF[k])
        except Exception:  # pragma: no cover - some deployments lock confs
            pass
    ship_package(spark)


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Distribute this package to the executors' Python path once per
    SparkContext (what ``--py-files`` does): the Arrow-batch functions (P&L
    fold, streaming state) are pickled by module reference."""
    sc = spark.sparkContext
    key = (sc.applicationId, sc.startTime)
    if key in _SHIPPED:
        return
    import zipfile

    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="quoteflow-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; a private folder is
    created only where it is unset in a local session (tests). Elsewhere that is an error:
    a machine's own folder is not shared.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        d = spark.sparkContext.getCheckpointDir() if hasattr(spark.sparkContext, "getCheckpointDir") else None
    if not d:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        d = tempfile.mkdtemp(prefix="quoteflow-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written tables."""
    return os.path.join(checkpoint_dir(spark), name)


def _file(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; errors of the file system are raised."""
    fs, p = _file(spark, path)
    return bool(fs.exists(p))


def delete_path(spark: SparkSession, path: str) -> None:
    fs, p = _file(spark, path)
    fs.delete(p, True)


def date_in_order(spark: SparkSession, path: str) -> None:
    """Date a written folder's files a second apart, by name (the writing partitions' order). File streams read by date, so
    a file system that does not keep dates is an error."""
    fs, folder = _file(spark, path)
    files = sorted((s.getPath() for s in fs.listStatus(folder) if s.getPath().getName().startswith("part-")),
                   key=lambda p: p.getName())
    dates = [(int(time.time()) - len(files) + i) * 1000 for i in range(len(files))]
    for p, date in zip(files, dates):
        fs.setTimes(p, date, -1)
    if [fs.getFileStatus(p).getModificationTime() for p in files] != dates:
        raise OSError(f"{path}: its file system does not keep dates")


def size_for_input(spark: SparkSession, input_bytes: int, target_partition_bytes: int = 256 << 20,
                   expansion: float = 3.0) -> int:
    """Size shuffles and scan splits for an input of ``input_bytes`` (on-disk,
    compressed): shuffle partitions so that an expanded partition is about
    ``target_partition_bytes`` (AQE coalesces small ones and splits skewed
    ones from that advisory size), and 256 MB scan splits. Returns the
    partition count. Only runtime-settable confs are touched."""
    n = max(int(spark.sparkContext.defaultParallelism),
            int(input_bytes * expansion // target_partition_bytes) + 1)
    spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(target_partition_bytes))
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(target_partition_bytes))
    return n


def input_bytes(spark: SparkSession, paths: list[str]) -> int:
    """Total size of input files via the Hadoop file system (no data read)."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        total += path.getFileSystem(conf).getContentSummary(path).getLength()
    return int(total)
