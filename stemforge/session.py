"""Session defaults and the durable way to cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """Session for tests and the bench; a cluster brings its own settings."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("stemforge")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship(spark)
    return spark


#: Applications that have the package on their workers.
_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Gives the package to the Python workers of the executors, once per application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    package = Path(__file__).resolve().parent
    # the driver's own copy, which Spark then serves to the workers
    archive = Path(tempfile.mkdtemp(prefix="spark-stemforge-code-")) / "stemforge_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for source in sorted(package.rglob("*.py")):
            out.write(source, source.relative_to(package.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)


#: Folder of this process where all tasks run on this machine and no setting names one.
_LOCAL: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as ``spark.checkpoint.dir`` names it.

    Only a local master may leave that unset (tests, one machine); a temporary folder then takes its
    place. Elsewhere executors would write to disks of their own, so it is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError(f"spark.checkpoint.dir must name a shared folder where the master is {master}")
    if not _LOCAL:
        _LOCAL.append(tempfile.mkdtemp(prefix="spark-stemforge-"))
        atexit.register(shutil.rmtree, _LOCAL[0], ignore_errors=True)
    return _LOCAL[0]


def run_folder(spark: SparkSession) -> str:
    """Folder of this application's intermediate tables within the shared one."""
    return f"{shared_folder(spark)}/stemforge-{spark.sparkContext.applicationId}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again.

    Cuts the lineage so that an expensive or non-deterministic result is made once, and survives the
    loss of an executor. The tables stay until :func:`release`, or until the shared folder is cleared.
    """
    path = f"{run_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> bool:
    """Deletes what :func:`written` left in this application; results that were not yet read can then not be read."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(run_folder(spark))
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
