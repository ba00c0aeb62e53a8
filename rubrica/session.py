"""Session set-up and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def get_session(app: str = "rubrica", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the jobs rely on: UTC, AQE with skew splitting, Arrow."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.enabled": "false",
    }
    settings.update(conf)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return ship_code(builder.getOrCreate())


_SHIPPED: set[tuple[str, str]] = set()


def ship_code(spark: SparkSession, package: str | None = None) -> SparkSession:
    """Send a package (default: this one) to the Python workers, once per application.

    Workers import the functions they run; without this they could only do so where the package is installed or happens
    to lie in their working folder.
    """
    folder = Path(package or __file__).resolve().parent
    key = (spark.sparkContext.applicationId, str(folder))
    if key not in _SHIPPED:
        archive = Path(tempfile.mkdtemp(prefix="spark-", dir="/tmp")) / f"{folder.name}.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for source in sorted(folder.rglob("*.py")):
                out.write(source, source.relative_to(folder.parent))
        spark.sparkContext.addPyFile(str(archive))
        _SHIPPED.add(key)
    return spark


def shared_dir(spark: SparkSession, purpose: str) -> str:
    """A fresh folder for `purpose` under the shared folder named by spark.checkpoint.dir.

    Only a local-mode session without that setting falls back to a temporary folder; a cluster must name one,
    because a folder on one machine is lost with it.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of `df` in the shared folder; survives the loss of any executor."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_dir(spark, "checkpoint"))
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """`df` written to the shared folder and read back, for tables that are read more than once.

    As `cut_lineage`, but in compressed columns: it takes a fraction of a checkpoint's disk, readers take the columns they
    need, and a join knows how large the table is. The shuffle files behind it go when it is written.
    """
    path = shared_dir(df.sparkSession, "stored")
    with shuffles_dropped(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Within, the shuffle files of a query go when it has run, and not when the driver next collects garbage.

    For jobs of many short queries that each store or count their result.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)
