"""Session construction and shared-storage helpers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import DataFrame, SparkSession

# Python workers run NumPy block products; one BLAS thread per worker keeps
# the executor's task slots from oversubscribing its cores.
for _var in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_var, "1")

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def _submitted() -> set[str]:
    """Names of the settings that ``spark-submit`` gave this application."""
    if "PYSPARK_GATEWAY_PORT" not in os.environ:
        return set()
    SparkContext._ensure_initialized()
    return {key for key, _ in SparkConf().getAll()}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "lectern", extra: dict | None = None) -> SparkSession:
    """Session with the settings the library is tuned for.

    Settings given to ``spark-submit`` win, and ``getOrCreate`` keeps an existing
    session; these defaults only matter for local runs and tests.
    """
    given = _submitted()
    builder = SparkSession.builder.appName(app_name)
    if "spark.master" not in given:
        builder = builder.master(master)
    defaults = {
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
        "spark.executorEnv.OPENBLAS_NUM_THREADS": "1",
        "spark.executorEnv.OMP_NUM_THREADS": "1",
    }
    for key, value in defaults.items():
        if key not in given:
            builder = builder.config(key, value)
    for key, value in (extra or {}).items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder of the cluster (``spark.checkpoint.dir``).

    The setting is read from the session. Only a local-mode session without
    the setting (tests, laptops) gets a fresh scratch folder; on a cluster a
    machine-local folder would not survive executor loss, so it is an error.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            raise RuntimeError(
                "spark.checkpoint.dir is not set; point it at shared storage "
                "(HDFS/S3/ABFS) so checkpoints survive executor loss")
        configured = tempfile.mkdtemp(prefix="lectern-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def reliable_checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable (shared-storage) checkpoint."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str, *folders: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: lineage ends
    here, and later readers read only the columns (and the ``folders`` they filter by) they use."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/lectern-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").partitionBy(*folders).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``lectern`` importable in the Python workers of this application.

    Worker-side code (chunk walk, embedder, scoring) lives in this package;
    a zip of it is added with ``addPyFile`` once per application, the standard
    way to ship Python code to executors when it is not installed there.
    """
    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    import shutil
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = tempfile.mkdtemp(prefix="lectern-pkg-")
    zpath = shutil.make_archive(os.path.join(out, "lectern"), "zip",
                                root_dir=os.path.dirname(pkg), base_dir=os.path.basename(pkg))
    sc.addPyFile(zpath)
    _SHIPPED.add(app)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the driver's parquet tables."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
