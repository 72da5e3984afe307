"""Spark session helpers shared by tests, bench and the driver entry points."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def build_session(master: str | None = None, shuffle_partitions: int | None = None,
                  app_name: str = "sluice") -> SparkSession:
    """Local session for tests and bench; on a cluster the submitter's conf wins.

    AQE stays on so shuffle partitions coalesce and skewed joins split at run
    time; the session zone is pinned to UTC because every fold orders by
    event time in microseconds.
    """
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(master or f"local[{cpus}]")
        .appName(app_name)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or int(cpus)))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.streaming.stateStore.providerClass",
                "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``sluice`` importable on executors (Arrow UDFs and mapInPandas
    folds run there): zip the package once and ``addPyFile`` it."""
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out_dir = tempfile.mkdtemp(prefix="sluice-pkg-", dir="/tmp")
    zpath = os.path.join(out_dir, "sluice.zip")
    with zipfile.ZipFile(zpath, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(zpath)
    _SHIPPED.add(key)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    A cluster job must set it to a shared filesystem.  Unset, a folder is made
    for local masters only, where driver and executors are one process.
    """
    current = spark.conf.get("spark.checkpoint.dir", None)
    if not current:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="sluice-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(current)
    return current


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder.  The folder's owner
    cleans it up (a lifecycle rule), as results may still be read from it."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}-{uuid.uuid4().hex[:10]}"


def materialize(df, name: str):
    """Write ``df`` as Parquet below the shared folder and read it back, where
    several later steps use it; a lost executor then repeats none of its work."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Session setting: read tables into so many partitions (a round-robin
#: shuffle).  Unset, scans are split by Spark's own settings; the bench sets it
#: because its tables are single files of one row group, which can't be split.
INPUT_PARTITIONS = "sluice.input.partitions"

_TABLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str):
    """Parquet table ``name`` under ``sf_dir`` (DataFrame reused per
    application; file listing and footer reads happen once)."""
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, id(spark), path)
    if key not in _TABLES:
        df = spark.read.parquet(path)
        parts = spark.conf.get(INPUT_PARTITIONS, None)
        _TABLES[key] = df.repartition(int(parts)) if parts else df
    return _TABLES[key]
