"""Sessions, and the shared folder that intermediate results survive in."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(cpus: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench; clusters bring their own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tilefold")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return ship(spark)


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to all executors, for sessions whose workers cannot import it; does nothing the second time."""
    package = Path(__file__).resolve().parent
    archive = Path(tempfile.gettempdir()) / f"tilefold-{spark.sparkContext.applicationId}.zip"  # the driver serves it from here
    if not archive.exists():
        with zipfile.ZipFile(archive, "w") as z:
            for p in sorted(package.rglob("*.py")):
                z.write(p, p.relative_to(package.parent))
        atexit.register(archive.unlink, missing_ok=True)
        spark.sparkContext.addPyFile(str(archive))
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``; in local mode without one, a folder of our own.

    On a cluster a folder that one machine holds would be lost with it, so there the setting is required.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", "")
    if named:
        return named.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="tilefold-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def _own_folder(spark: SparkSession):
    """(file system, path, text) of what this application writes between steps."""
    text = f"{shared_dir(spark)}/tilefold/{spark.sparkContext.applicationId}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(text)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, text


def new_path(spark: SparkSession, name: str) -> str:
    """A new folder for an intermediate result. It is deleted when the application ends, or before by ``discard``."""
    files, path, text = _own_folder(spark)
    if not files.exists(path):
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{text}/{name}-{uuid.uuid4().hex[:12]}"


def discard(spark: SparkSession) -> None:
    """Delete all intermediate results now; results that still read them are lost with them."""
    files, path, _ = _own_folder(spark)
    files.delete(path, True)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again.

    Cuts the lineage: what follows can be recomputed after the loss of an executor without running the
    steps before, and rows that depend on how tasks were cut (partition ids) no longer change.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    out = df.write
    if partition_by:
        out = out.partitionBy(*partition_by)
    out.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
