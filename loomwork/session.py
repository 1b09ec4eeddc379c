"""Session helpers shared by queries, tests and the benchmark."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType, "long": T.LongType, "int": T.IntegerType, "double": T.DoubleType, "boolean": T.BooleanType,
    "timestamp": T.TimestampType, "timestamp_ntz": T.TimestampNTZType, "binary": T.BinaryType,
}


def schema(fields: str) -> T.StructType:
    """A flat schema from "name type, ..." that needs no running session, so that modules may hold it."""
    return T.StructType([T.StructField(n, _TYPES[k]()) for n, k in (x.split() for x in fields.split(","))])


def session(app: str = "loomwork", master: str = "local[8]", **conf: str) -> SparkSession:
    """A local session with the settings that the tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give executors this package's code, once an application, for functions that run in their Python."""
    context = spark.sparkContext
    root = Path(__file__).resolve().parent
    if context.applicationId in _SHIPPED or not root.is_dir():
        return
    _SHIPPED.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="loomwork-code-")  # the driver serves it to the executors
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    with zipfile.ZipFile(f"{folder}/loomwork.zip", "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(f"{folder}/loomwork.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the fixture tables; any path that Spark can read will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder the cluster names; set one only where none is configured and all runs in one process (tests)."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "")
        if not named and not context.master.split("[")[0] == "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        if not named:
            named = tempfile.mkdtemp(prefix="loomwork-checkpoints-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        context.setCheckpointDir(named)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the shared folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, *keys: str, rows: int) -> DataFrame:
    """``rows`` rows hashed by keys into as many partitions as hold a million each, so that what a task holds doesn't grow with the table."""
    return df.repartition(max(shuffle_partitions(df.sparkSession), 1 + rows // 1_000_000), *keys)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
