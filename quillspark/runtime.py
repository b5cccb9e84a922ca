"""Session, table access and the scratch tables that cut lineage."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def local_session(cores: str = "8", shuffle_partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and the bench; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("quillspark")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; in local mode only, a temporary one where that is unset.

    Raises ValueError on a cluster without the setting: a machine-local folder would be invisible to the executors.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = f"file://{tempfile.mkdtemp(prefix='quillspark-')}"
    sc.setCheckpointDir(base)
    return base


class Scratch:
    """Tables written under the shared folder, so that a lost executor costs a re-read and not a re-run."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quillspark-{uuid.uuid4().hex}"
        atexit.register(self.clear)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        try:
            self._delete(self.root)
        except Exception:  # the session may be gone at exit
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def join_spread(rows: DataFrame, side: DataFrame, key: str, part: int = 1000) -> DataFrame:
    """Inner join on ``key`` where one key may fill much of ``rows``.

    Keys that hold at least 1 / ``part`` of the rows (no more than ``part`` exist) are joined by broadcasting their
    side, wherever their rows lie; the others by shuffle. ``side`` must hold a bounded number of rows a key.
    """
    counts = rows.groupBy(key).count()
    total = rows.count()
    hot = counts.where(F.col("count") >= max(2.0, total / part)).select(key)
    few = F.broadcast(hot)
    return rows.join(F.broadcast(side.join(few, key, "left_semi")), key).unionByName(
        rows.join(few, key, "left_anti").join(side.join(few, key, "left_anti"), key)
    )


def ship(spark: SparkSession) -> None:
    """Makes the package importable in the Python workers, wherever the driver was started; once for each context."""
    sc = spark.sparkContext
    if not getattr(sc, "_quillspark_shipped", False):
        root = Path(__file__).resolve().parent
        folder = tempfile.mkdtemp(prefix="quillspark-")  # on the driver, which serves the file to the executors
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        sc.addPyFile(shutil.make_archive(f"{folder}/quillspark", "zip", root.parent, root.name))
        sc._quillspark_shipped = True
