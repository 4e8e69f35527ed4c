"""Session construction and cluster-safe scratch locations."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import SparkSession

# Settings every docweave job relies on. Time zone is pinned so TIMESTAMP text and
# day windows are identical on every executor; AQE re-plans joins and coalesces or
# splits skewed shuffle partitions at runtime.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # a Python worker holds a few batches at a time: 1,024 rows of 1,024-d double vectors are
    # 8 MB, and long texts end a batch sooner
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1024",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20),
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "docweave", extra: dict | None = None,
                driver_memory: str | None = None) -> SparkSession:
    """Build (or reuse) a session with the docweave defaults.

    On a cluster pass ``master=None`` and let spark-submit decide; tests use ``local[*]``.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(BASE_CONF)
    if driver_memory:
        # only effective when this call starts the JVM (local runs)
        conf["spark.driver.memory"] = driver_memory
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if extra:
        conf.update(extra)
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Make ``docweave`` importable in every Python worker (UDFs, mapInPandas, cogroup).

    The package is zipped once on the driver and registered with ``addPyFile``; Spark
    distributes it to the executors, so the driver's working directory does not matter.
    """
    import zipfile

    sc = spark.sparkContext
    if getattr(sc, "_docweave_shipped", False):
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    out_dir = tempfile.mkdtemp(prefix="docweave-pkg-")
    zpath = os.path.join(out_dir, "docweave.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as zf:
        for dirpath, dirnames, filenames in os.walk(pkg_dir):
            dirnames[:] = [d for d in dirnames if d != "__pycache__"]
            for f in filenames:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    zf.write(full, os.path.relpath(full, root))
    sc.addPyFile(zpath)
    sc._docweave_shipped = True


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of this session bounded in rows and bytes, whatever session was given."""
    for key in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"):
        spark.conf.set(key, BASE_CONF[key])


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names a shared (distributed file system) folder there. Only when the
    setting is absent -- local tests -- a private scratch folder is created.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf_dir = spark.conf.get("spark.checkpoint.dir", None)
    if not conf_dir and not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if not conf_dir:
        conf_dir = tempfile.mkdtemp(prefix="docweave-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", conf_dir)
    sc.setCheckpointDir(conf_dir)
    return sc.getCheckpointDir() or conf_dir


def scratch_path(spark: SparkSession, name: str) -> str:
    """A location for intermediate tables under the shared checkpoint folder."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


def recommended_conf(input_bytes: int, total_cores: int, partition_bytes: int = 128 << 20) -> dict:
    """Settings sized for a job reading ``input_bytes`` on ``total_cores`` cores.

    Shuffle partitions start at about one per ``partition_bytes`` of input (never fewer
    than two and never more than twenty per core) and AQE coalesces the small ones at run time and splits skewed
    ones in joins; scan splits stay at ``partition_bytes``.
    """
    # map-status size grows with maps x reducers: cap at 20 waves of the cluster
    parts = min(max(2 * total_cores, -(-input_bytes // partition_bytes)), 20 * total_cores)
    return {
        "spark.sql.shuffle.partitions": str(parts),
        "spark.sql.files.maxPartitionBytes": str(partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(partition_bytes),
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": str(4 * partition_bytes),
        "spark.sql.execution.arrow.maxRecordsPerBatch": BASE_CONF["spark.sql.execution.arrow.maxRecordsPerBatch"],
        "spark.sql.execution.arrow.maxBytesPerBatch": BASE_CONF["spark.sql.execution.arrow.maxBytesPerBatch"],
    }
