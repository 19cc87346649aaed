"""Spark session defaults and the shared checkpoint folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.localShuffleReader.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    # top-k per group (row_number <= k) is trimmed map-side only for k up to this threshold
    "spark.sql.optimizer.windowGroupLimitThreshold": "10000",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, app: str = "paylens",
              shuffle_partitions: int | None = None, extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with UTC, ANSI and AQE switched on.

    On a cluster the master and resources come from spark-submit; locally
    ``master`` defaults to ``local[*]`` and shuffle partitions to the core count.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
        if master.startswith("local"):
            # local mode: the driver JVM is the only executor
            builder = builder.config("spark.driver.memory", os.environ.get("PAYLENS_DRIVER_MEMORY", "16g"))
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for k, v in (extra or {}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def is_local(spark: SparkSession) -> bool:
    """Driver and executors are one process (``local-cluster`` is not)."""
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def shared_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only in local mode, where driver and executors share one disk, an absent
    setting gives a scratch folder (removed when the session's process exits);
    on a cluster the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not is_local(spark):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="paylens-ckpt-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
        path = spark.sparkContext.getCheckpointDir()
    return path.rstrip("/")


_CHECKPOINTS: set[str] = set()
_REMOVED_AT_EXIT: list[tuple[SparkSession, str]] = []


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a file or folder through Hadoop, wherever it lies."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    conf = spark._jsc.hadoopConfiguration() if spark._jsc else jvm.org.apache.hadoop.conf.Configuration()
    target.getFileSystem(conf).delete(target, True)


def remove_at_exit(spark: SparkSession, path: str) -> str:
    """Have ``path`` deleted when the process exits (also after the session stopped)."""
    if not _REMOVED_AT_EXIT:
        atexit.register(_remove_all)
    _REMOVED_AT_EXIT.append((spark, path))
    return path


def _remove_all() -> None:
    while _REMOVED_AT_EXIT:
        spark, path = _REMOVED_AT_EXIT.pop()
        try:
            remove_path(spark, path)
        except Exception:  # noqa: BLE001  the JVM may be gone at exit
            return


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder for an intermediate result; deleted when the process exits."""
    return remove_at_exit(spark, f"{shared_dir(spark)}/paylens-{name}-{uuid.uuid4().hex}")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder; the context's own checkpoint folder (in it) is set once and deleted at exit."""
    path, context = shared_dir(spark), spark.sparkContext
    if context.applicationId not in _CHECKPOINTS:
        if not context.getCheckpointDir():
            context.setCheckpointDir(path)
        remove_at_exit(spark, context.getCheckpointDir())
        _CHECKPOINTS.add(context.applicationId)
    return path


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package: off local mode it is sent as a zip file.

    Workers of local mode find it in the folder they start in, or where PYTHONPATH names it.
    """
    app = spark.sparkContext.applicationId
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = [os.getcwd(), *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]
    if app in _SHIPPED or is_local(spark) and root in map(os.path.abspath, known):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="paylens-zip-"), "paylens.zip")
    atexit.register(shutil.rmtree, os.path.dirname(path), ignore_errors=True)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "paylens")):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def cut_lineage(df):
    """Reliable checkpoint into the shared checkpoint folder (never localCheckpoint)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df, name: str):
    """``df`` written once as a table in the shared folder, for frames that are read many times and by few columns."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
