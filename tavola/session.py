"""Session helpers: one place for the configuration the operators assume."""

from __future__ import annotations

import os
import tempfile
import threading

from pyspark.sql import SparkSession

# Settings every job in this package relies on.  Time zone is fixed so hour
# labels and timestamp casts are reproducible; AQE re-plans joins/aggregates at
# runtime (partition coalescing, skew-join splitting).
DEFAULT_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "tavola", extra: dict | None = None) -> SparkSession:
    """Build (or reuse) a session with the package defaults.

    ``master`` and ``shuffle_partitions`` are for local runs; on a cluster the
    submitter's settings win because ``getOrCreate`` returns the live session.
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    conf = dict(DEFAULT_CONF)
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    if os.environ.get("TAVOLA_QUANTILE_EXACT_LIMIT"):
        # lets tests force the distributed exact-quantile path on small data
        conf["tavola.quantile.exactDistinctLimit"] = os.environ["TAVOLA_QUANTILE_EXACT_LIMIT"]
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    On a cluster the folder is set by the submitter (a shared file system);
    only when it is unset, as in local tests, a scratch folder is created.
    """
    sc = spark.sparkContext
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        # a static setting cannot be changed now; the context remembers the folder
        path = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="tavola-ckpt-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(path)
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder for written intermediates."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name)


_SHIPPED: set[str] = set()
_SHIPPING = threading.Lock()


def ship_package(spark: SparkSession) -> None:
    """Sends this package's modules to the executors, once per application, so
    that tasks can import them wherever the driver was started."""
    import zipfile

    with _SHIPPING:  # fits run side by side, and a file can be added once
        app = spark.sparkContext.applicationId
        if app in _SHIPPED:
            return
        top = os.path.dirname(os.path.abspath(__file__))
        path = os.path.join(tempfile.mkdtemp(prefix="tavola-package-"), "tavola-package.zip")
        with zipfile.ZipFile(path, "w") as z:
            for folder, _, names in os.walk(top):
                for name in sorted(n for n in names if n.endswith(".py")):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
        spark.sparkContext.addPyFile(path)
        _SHIPPED.add(app)
