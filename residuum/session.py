"""Spark session and shared scratch folders.

Everything here is plain Spark configuration; no scheduling of our own.
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

def build_session(master: str | None = None, app: str = "residuum",
                  shuffle_partitions: int | None = None,
                  extra: dict | None = None) -> SparkSession:
    """Session tuned for the operators in this package.

    On a cluster, ``master`` is left to spark-submit and only the SQL
    settings below apply; in tests a ``local[N]`` master is passed.
    """
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # Static (estimate-based) broadcast off: estimates after filters and
        # explodes are unreliable.  Broadcasts happen either through an
        # explicit hint on a literal or one-row side, or through AQE, which
        # measures the bytes of the materialised stage first.
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "64MB",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
        "spark.sql.files.maxPartitionBytes": "128MB",
    }
    # Python workers run one per core already; a multi-threaded BLAS inside
    # each forked worker oversubscribes the cores and can deadlock.
    for var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
        conf[f"spark.executorEnv.{var}"] = "1"
        os.environ.setdefault(var, "1")
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, as in
    tests, gets a temporary folder when it is unset: other executors would not
    see one, so elsewhere that is an error.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not d and not sc.master.split("[")[0] == "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="residuum-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/scratch/{name}-{uuid.uuid4().hex[:12]}"


def spread(df: DataFrame, key: str | None = None) -> DataFrame:
    """Give a scan at least one partition per core.

    Small test files arrive as one partition, which leaves 7 of 8 cores idle
    for per-row heavy work.  On a cluster a 100 TB scan already has far more
    splits than cores, so this is a no-op there (no extra shuffle).
    """
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no RDD view (e.g. a Connect session): leave the plan as it is
        return df
    if n >= cores:
        return df
    if key is not None:
        return df.repartition(cores, F.col(key))
    return df.repartition(cores)


ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Smaller Arrow batches than Spark's default of 10,000 rows, which are tens of
    megabytes of text in the JVM and again in each Python worker. A session that names
    another number keeps it."""
    if spark.conf.get(ARROW_ROWS) == "10000":
        spark.conf.set(ARROW_ROWS, "2000")


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``residuum`` importable in the Python workers (as ``--py-files``
    would): zip the package once per application and ``addPyFile`` it.
    UDFs and ``mapInPandas`` bodies refer to package functions by name."""
    bound_batches(spark)
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    import zipfile
    root = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="residuum-pkg-"), "residuum.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for dirpath, _, files in os.walk(root):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(dirpath, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(root)))
    sc.addPyFile(out)
    _SHIPPED.add(sc.applicationId)


def data_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")
