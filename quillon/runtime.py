"""Session building, shared folder handling and small helpers every operator uses."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "quillon", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; keyword ``a__b="c"`` sets ``a.b``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | {key.replace("__", "."): value for key, value in conf.items()}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Only where that is unset (local runs and tests) a folder of our own is made, one for each
    application.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = _own_folder(spark.sparkContext.applicationId)
    return folder


#: Whether shuffle files go when the query that wrote them ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@cache
def _own_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="quillon-")


def own_tables(spark: SparkSession) -> str:
    """Where this application's tables lie in the shared folder."""
    return f"{shared_dir(spark)}/quillon/{spark.sparkContext.applicationId}"


def materialize(df: DataFrame, tag: str, drop_shuffle: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage where a costly stage feeds several later ones; the files are
    compressed and columnar, so each reader takes only its columns, and a lost executor
    costs nothing but the tasks that ran on it. With ``drop_shuffle`` the shuffle files of
    the write are deleted at its end, else they lie until the driver collects its garbage.
    """
    spark = df.sparkSession
    path = f"{own_tables(spark)}/{tag}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    if drop_shuffle:
        spark.conf.set(_CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        if drop_shuffle:
            spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and nothing reads any more."""
    spark = df.sparkSession
    for path in {os.path.dirname(f) for f in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@cache
def _ship(application: str) -> None:
    """Give the executors this package, for clusters whose workers do not have it on their path."""
    package = Path(__file__).parent
    archive = Path(tempfile.mkdtemp(prefix="quillon-")) / "quillon.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted(package.rglob("*.py")):
            z.write(p, p.relative_to(package.parent))
    SparkSession.getActiveSession().sparkContext.addPyFile(str(archive))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table of the folder; the first call of an application also ships this package."""
    _ship(spark.sparkContext.applicationId)
    return spread(spark.read.parquet(os.path.join(folder, f"{name}.parquet")))


#: Bytes on disk from which a table in few parts is worth spreading.
SPREAD_BYTES = 512 << 10


def spread(scan: DataFrame) -> DataFrame:
    """A scan over all cores where the files give it fewer parts than there are cores.

    Only small tables are in so few parts, so the exchange is small too; a table of the size a
    cluster is for has more parts than cores and is read as it lies. Filters and the choice of
    columns still reach the scan.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if int(str(scan._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) < SPREAD_BYTES:
        return scan
    return scan.repartition(cores) if scan.rdd.getNumPartitions() < cores else scan


def clean_shared(spark: SparkSession) -> None:
    """Delete the tables that this application wrote; for its end, when no result is read any more."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(own_tables(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
