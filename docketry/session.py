"""Session helpers: building a session, reading tables, shipping the package to executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_PACKAGE = Path(__file__).resolve().parent
_SHIPPED = "docketry.shipped.app"


def build_session(app: str = "docketry", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings that the engine is tested with."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of a data folder; the folder may be any path that Spark can read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a local session (as in tests) gets a folder of its own; on a cluster that is an error, as each
    machine would have another folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="docketry-shared-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def settled(df: DataFrame, what: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    Lineage ends there, and what reads the table several times plans and computes it once.
    """
    path = f"{shared_folder(df.sparkSession)}/docketry-{what}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of a batch that goes to a Python worker; one row may be larger.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Batches for Python workers hold about BATCH_BYTES at most, unless the session has a bound of its own.

    Spark bounds their rows only: ten thousand texts lie in the executor's buffers and in the worker at once, often
    several times. No operator's rows depend on where a batch ends.
    """
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def ship(spark: SparkSession) -> None:
    """Send this package to the executors' Python workers, once per application."""
    sc = spark.sparkContext
    if os.environ.get(_SHIPPED) == sc.applicationId:
        return
    folder = tempfile.mkdtemp(prefix="docketry-")
    path = os.path.join(folder, "docketry_pkg.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for source in sorted(_PACKAGE.rglob("*.py")):
            archive.write(source, source.relative_to(_PACKAGE.parent))
    sc.addPyFile(path)
    os.environ[_SHIPPED] = sc.applicationId
