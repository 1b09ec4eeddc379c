"""Snapshots, shards, caches and records in a store: Parquet and JSON lines below one root.

A write goes to a folder of its own first; a pointer moves last and is the
commit point. Readers follow the pointer.
"""

from __future__ import annotations

import os

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.operators import snapshots as S


def read_json_lines(spark: SparkSession, path: str, schema: T.StructType, limit: int | None = None) -> DataFrame:
    """Records of a JSON-lines file, or none if it doesn't exist; broken lines are dropped."""
    try:
        rows = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException:
        rows = spark.createDataFrame([], schema)
    return rows if limit is None else rows.limit(limit)


def write_json_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_snapshot(snapshot: dict[str, DataFrame], root: str, run: str, after: int | None = None) -> None:
    """Validate, write the run's tables and manifest, then publish it, if ``after`` is still the last publication."""
    spark = snapshot["units"].sparkSession
    bad = S.violations(snapshot).limit(5).collect()
    if bad:
        raise ValueError("invalid snapshot: " + "; ".join(f"{r.path}: {r.message}" for r in bad))
    for name in S.TABLES:
        snapshot[name].write.mode("overwrite").parquet(f"{root}/runs/{run}/{name}")
    S.manifest(snapshot).withColumn("run", F.lit(run)).coalesce(1).write.mode("overwrite").parquet(f"{root}/runs/{run}/manifest")
    publish(spark, root, run, after)


def _store(spark: SparkSession, path: str):
    """The file system that a path names, and the path in it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _published(spark: SparkSession, root: str) -> list[int]:
    fs, at = _store(spark, f"{root}/pointer")
    return sorted(int(f.getPath().getName()) for f in fs.listStatus(at) if f.getPath().getName().isdigit()) if fs.exists(at) else []


def last_number(spark: SparkSession, root: str) -> int:
    """The number of the last publication, 0 before the first."""
    return max(_published(spark, root), default=0)


def publish(spark: SparkSession, root: str, run: str, after: int | None = None) -> int:
    """Make ``run`` the published one and return its number.

    Pointers are numbered files that are created only if they aren't there, so of two writers of one number one is refused,
    where the store creates files atomically. With ``after``, the number that the writer started from, it is refused
    as well if another run was published since; without, the next free number is taken.
    """
    while True:
        last = last_number(spark, root)
        if after is not None and last != after:
            raise RuntimeError(f"run {last} was published since {after}")
        if _created(spark, f"{root}/pointer/{last + 1:010d}", run.encode()):
            return last + 1
        # Another writer was faster: look again.


def _created(spark: SparkSession, path: str, content: bytes) -> bool:
    """Create a file unless it is there; on a plain file system by the system's own exclusive call, as Hadoop's only looks first."""
    fs, at = _store(spark, path)
    try:
        if fs.getScheme() == "file":
            fs.mkdirs(at.getParent())
            handle = os.open(at.toUri().getPath(), os.O_CREAT | os.O_EXCL | os.O_WRONLY)
            os.write(handle, content)
            os.close(handle)
        else:
            out = fs.create(at, False)
            out.write(bytearray(content))
            out.close()
    except FileExistsError:
        return False
    except Py4JJavaError as e:
        if "AlreadyExists" in str(e.java_exception):
            return False
        raise
    return True


def current_run(spark: SparkSession, root: str) -> str | None:
    """The run that was published last; a pointer that is still being written doesn't count."""
    for number in reversed(_published(spark, root)):
        fs, at = _store(spark, f"{root}/pointer/{number:010d}")
        stream = fs.open(at)
        run = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        stream.close()
        if run:
            return run
    return None


def archive(spark: SparkSession, root: str, *, keep: int = 2) -> list[str]:
    """Move all runs but the ``keep`` published last, of those in ``runs``, to ``archive``; their names. Runs in writing stay."""
    names = []
    for number in _published(spark, root):
        fs, at = _store(spark, f"{root}/pointer/{number:010d}")
        stream = fs.open(at)
        names.append(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        stream.close()
    newest = list(dict.fromkeys(reversed(names)))
    moved = []
    for run in newest[keep:]:
        fs, at = _store(spark, f"{root}/runs/{run}")
        if fs.exists(at):
            fs.mkdirs(_store(spark, f"{root}/archive")[1])
            fs.rename(at, _store(spark, f"{root}/archive/{run}")[1])
            moved.append(run)
    return moved


def read_snapshot(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """Tables of the published run; empty ones if there is none."""
    run = current_run(spark, root)
    if run is None:
        return S.empty(spark)
    return {n: spark.read.parquet(f"{root}/runs/{run}/{n}") for n in S.TABLES}


def put_shards(nodes: DataFrame, root: str, run: str, *, buckets: int = 64) -> DataFrame:
    """Write graph rows (path, content_hash, ...) of files whose hash isn't stored yet; (path, content_hash) written."""
    spark = nodes.sparkSession
    try:
        have = spark.read.parquet(f"{root}/shards").select("path", "content_hash").distinct()
        fresh = nodes.join(have, ["path", "content_hash"], "left_anti")
    except AnalysisException:
        fresh = nodes
    bucket = F.pmod(F.xxhash64("path"), F.lit(buckets)).cast("int")
    fresh = fresh.withColumn("run", F.lit(run)).withColumn("bucket", bucket)
    fresh.write.mode("append").partitionBy("bucket").parquet(f"{root}/shards")
    return fresh.select("path", "content_hash").distinct()


def live_shards(spark: SparkSession, root: str, files: DataFrame) -> DataFrame:
    """Stored rows of files that are still there with the stored hash; orphans are left out."""
    return spark.read.parquet(f"{root}/shards").join(files.select("path", "content_hash"), ["path", "content_hash"], "left_semi")


def retention(entries: DataFrame, now, *, newest: int, days: int) -> DataFrame:
    """(folder, name) of entries (folder, name, modified) to remove: beyond ``newest`` a folder, or older than ``days``."""
    rank = F.row_number().over(Window.partitionBy("folder").orderBy(F.desc("modified"), "name"))
    return entries.withColumn("rn", rank).where((F.col("rn") > newest) | (F.col("modified") < now - F.make_dt_interval(F.lit(days)))).select("folder", "name")


def bundle(units: DataFrame) -> DataFrame:
    """(kind, path, document) of a portable text bundle: one document an active unit and one index a kind."""
    live = units.where("lifecycle = 'active'")
    body = F.format_string("---\nid: %s\nkind: %s\n---\n# %s\n\n%s\n", "id", "kind", "name", F.coalesce("description", F.lit("")))
    docs = live.select("kind", F.concat(F.lit("units/"), "kind", F.lit("/"), F.substring(F.sha2("id", 256), 1, 16), F.lit(".md")).alias("path"), body.alias("document"))
    names = live.groupBy("kind").agg(F.array_join(F.transform(F.sort_array(F.collect_list("name")), lambda n: F.concat(F.lit("- "), n)), "\n").alias("list"))
    index = names.select("kind", F.concat(F.lit("index/"), "kind", F.lit(".md")).alias("path"), F.concat(F.lit("# "), "kind", F.lit("\n"), "list").alias("document"))
    return docs.union(index)


def invalid_documents(documents: DataFrame) -> DataFrame:
    """(path, message) of bundle documents without front matter, id or title; index pages need a title only."""
    unit = F.col("path").startswith("units/")
    message = F.when(unit & ~F.col("document").rlike(r"(?s)^---\n.*\n---\n"), "front matter is missing").when(unit & ~F.col("document").rlike(r"(?m)^id: \S"), "id is missing").when(~F.col("document").rlike(r"(?m)^# \S"), "title is missing")
    return documents.select("path", message.alias("message")).where("message is not null")


def write_bundle(units: DataFrame, path: str) -> None:
    bundle(units).write.mode("overwrite").partitionBy("kind").parquet(path)


