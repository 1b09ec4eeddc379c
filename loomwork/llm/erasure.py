"""Erasure of rows from sorted Parquet files by intervals of their ranks.

``write_sorted`` lays a table out as files of equally many rows in one total
order: a range shuffle writes sorted runs, whose row counts give every row its
rank without a window, and the rank divided by the rows of a file is the file's
number; one task writes a file, streaming. A row's rank can be told from the
stored files alone: its file's number times the rows of a file, plus its place.

``intervals`` collapses ranks of victims into islands without gaps (in blocks
of ranks, so that no task holds one victim's rows), and splits them at file
boundaries by integer division. ``rewrite`` sorts each hit file's rows with its
intervals in front of the rows they erase; a task skips erased rows as
a stream, as slices of Arrow batches that share the batch's memory and
are concatenated. Spark's writer makes the new files and their footers
from the survivors and replaces the hit folders when all tasks are done.
Nothing is read from a row but its place and, for the victims, their keys.

Files lie in folders ``file_no=N`` below a table's folder, one each. A table
with a column of that name gets a longer name for the folders.

Defined results
* columns must be of sortable types; nulls come first, ties are whole repeated rows, which keep their number.
* empty table: no files. A file whose rows are all victims goes.
* a victim that isn't there, or is named twice, changes nothing more; null ranks are none.
* intervals of no file leave every file as it is, byte for byte.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.session import cut, ensure_checkpoint_dir, ship, shuffle_partitions

FILE, PLACE = "__lw_file", "__lw_place"
_LAST = "__lw_last"
_BLOCK = 1 << 16  # ranks whose victims one group holds


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder, which this leaves to its caller."""
    ensure_checkpoint_dir(spark)
    root = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/lw-{name}-{uuid4().hex}"


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder from the store that its path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def crc_order(value: Column) -> Column:
    """crc32 of a value as decimal text, null as empty text."""
    return F.crc32(F.coalesce(value.cast("string"), F.lit("")).cast("binary"))


def _part(schema: T.StructType) -> str:
    name, taken = "file_no", {c.lower() for c in schema.names}
    while name in taken:
        name = f"lw_{name}"
    return name


def _named(schema: T.StructType) -> list[Column]:
    return [F.col(f"`{c}`") for c in schema.names]


def stored(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Rows of a laid out table with FILE, PLACE in the file and the file's path."""
    part = _part(schema)
    rows = spark.read.schema(T.StructType([*schema, T.StructField(part, T.LongType())])).parquet(folder)
    meta = rows.metadataColumn("_metadata")
    return rows.select(*_named(schema), F.col(part).alias(FILE), meta["row_index"].alias(PLACE), meta["file_path"].alias("__lw_path"))


def write_sorted(rows: DataFrame, key: Column, schema: T.StructType, folder: str, *, files: int = 150) -> int:
    """Write the columns of ``schema`` sorted by ``key``, then by all of them, and return the rows of a file.

    A file has 1 + n div ``files`` rows, the last what is left.
    """
    spark = rows.sparkSession
    runs = f"{folder}-runs"
    keyed = rows.select(*_named(schema), key.alias("__lw_key"))
    order = [F.col("__lw_key"), *_named(schema)]
    keyed.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order).drop("__lw_key").write.parquet(runs)
    run = spark.read.schema(schema).parquet(runs)
    meta = run.metadataColumn("_metadata")
    # Runs are numbered in the order of their ranges; as many as the shuffle has partitions, so they may be broadcast.
    number = F.regexp_extract(meta["file_name"], r"part-(\d+)", 1).cast("int")
    sizes = run.groupBy(number.alias("__lw_run")).agg(F.count("*").alias("__lw_n"))
    before = Window.orderBy("__lw_run").rowsBetween(Window.unboundedPreceding, -1)
    sizes = cut(sizes.select("__lw_run", "__lw_n", F.coalesce(F.sum("__lw_n").over(before), F.lit(0)).alias("__lw_from")))
    n = sizes.agg(F.coalesce(F.sum("__lw_n"), F.lit(0))).first()[0]
    size = 1 + n // files
    placed = run.select(*_named(schema), number.alias("__lw_run"), meta["row_index"].alias("__lw_at")).join(F.broadcast(sizes.drop("__lw_n")), "__lw_run")
    rank = F.col("__lw_from") + F.col("__lw_at")
    part = _part(schema)
    placed = placed.select(*_named(schema), rank.alias("__lw_rank"), F.expr(f"(__lw_from + __lw_at) div {size}").alias(part))
    _write(placed, part, "__lw_rank", -(-n // size), schema, folder)
    remove(spark, runs)
    return size


def by_file(rows: DataFrame, part: str, files: int) -> DataFrame:
    """Each of the first ``files`` files' rows in one task, and as few files a task as the shuffle's partitions allow."""
    return rows.repartitionById(max(1, min(files, shuffle_partitions(rows.sparkSession))), F.col(part).cast("int"))


def _write(rows: DataFrame, part: str, order: str, files: int, schema: T.StructType, folder: str) -> None:
    """Write a file a number; those in ``folder`` of the same numbers are replaced when all are written."""
    dealt = by_file(rows, part, files).sortWithinPartitions(part, order)
    dealt.select(*_named(schema), part).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)


def intervals(victims: DataFrame, size: int) -> DataFrame:
    """(FILE, PLACE, last) of erased runs of rows in each file, from (FILE, PLACE) of victims; ``size`` rows a file.

    An island is cut at multiples of ``_BLOCK`` ranks and at file boundaries.
    """
    ranks = victims.select((F.col(FILE) * size + F.col(PLACE)).alias("r")).where("r is not null").distinct()
    place = F.row_number().over(Window.partitionBy("b").orderBy("r"))
    islands = ranks.withColumn("b", F.expr(f"r div {_BLOCK}")).withColumn("g", F.col("r") - place)
    spans = islands.groupBy("b", "g").agg(F.min("r").alias("lo"), F.max("r").alias("hi"))
    split = spans.select("lo", "hi", F.explode(F.expr(f"sequence(lo div {size}, hi div {size})")).alias(FILE))
    start = F.col(FILE) * size
    return split.select(FILE, (F.greatest("lo", start) - start).alias(PLACE), (F.least(F.col("hi"), start + size - 1) - start).alias(_LAST))


def survivors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches without the markers of intervals (FILE, PLACE, last, columns) and the rows that follow them up to their last place."""
    gone = 0  # rows to skip at the start of a batch
    for batch in batches:
        n, last = batch.num_rows, batch.column(2)
        kept, at = [], min(gone, n)
        gone -= at
        for i in np.flatnonzero(last.is_valid().to_numpy(zero_copy_only=False)).tolist():
            if i > at:
                kept.append(batch.slice(at, i - at))
            end = i + 2 + last[i].as_py() - batch.column(1)[i].as_py()
            at, gone = min(end, n), max(0, end - n)
        if at < n:
            kept.append(batch.slice(at))
        if kept:
            whole = kept[0] if len(kept) == 1 else pa.concat_batches(kept)
            yield whole.select([0, 1, *range(3, whole.num_columns)])


def rewrite(spark: SparkSession, folder: str, schema: T.StructType, marks: DataFrame) -> DataFrame:
    """Erase ``marks`` (of ``intervals``) from the files of a table; (FILE, erased) of the files that were hit.

    Survivors keep their order. If this is ended on the way, do it all again from the victims: ranks then
    are of the files as they are.
    """
    ship(spark)
    marks = cut(marks)  # the files that they are told from are replaced below
    hit = cut(marks.groupBy(FILE).agg(F.sum(F.col(_LAST) - F.col(PLACE) + 1).alias("erased")))
    files, top = hit.agg(F.count("*"), F.max(FILE)).first()
    if not files:
        return hit
    part = _part(schema)
    # One row a file.
    rows = stored(spark, folder, schema).join(F.broadcast(hit.select(FILE)), FILE, "left_semi")
    plain = [f"c{i}" for i in range(len(schema))]  # names that every function takes
    rows = rows.select(FILE, PLACE, F.lit(None).cast("long").alias(_LAST), *[c.alias(p) for c, p in zip(_named(schema), plain, strict=True)])
    signs = marks.select(FILE, PLACE, _LAST, *[F.lit(None).cast(f.dataType).alias(p) for f, p in zip(schema, plain, strict=True)])
    streams = by_file(rows.union(signs), FILE, top + 1).sortWithinPartitions(FILE, PLACE, F.col(_LAST).asc_nulls_last())
    ends = T.StructType([T.StructField(FILE, T.LongType()), T.StructField(PLACE, T.LongType())])
    left = streams.mapInArrow(survivors, T.StructType([*ends, *[T.StructField(p, f.dataType) for f, p in zip(schema, plain, strict=True)]]))
    # The rows of a file are in order, but only the sort tells the writer so; it doesn't move them.
    left = left.sortWithinPartitions(FILE, PLACE).select(*[F.col(p).alias(f.name) for f, p in zip(schema, plain, strict=True)], F.col(FILE).alias(part))
    before = cut(stored(spark, folder, schema).groupBy(FILE).agg(F.count("*").alias("n")))
    left.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(folder)
    for row in hit.join(before, FILE).where("erased = n").select(FILE).toLocalIterator():
        remove(spark, f"{folder}/{part}={row[0]}")
    return hit


def digests(spark: SparkSession, folder: str, schema: T.StructType, amount: str) -> DataFrame:
    """(FILE, path, n_rows, cents, ids_sha256) of each stored file, read back; the ids are the first column's."""
    ship(spark)
    rows = stored(spark, folder, schema)
    cents = F.coalesce(F.floor(F.col(f"`{amount}`") * 100 + 0.5), F.lit(0)).cast("long")
    sums = rows.groupBy(FILE).agg(F.count("*").alias("n_rows"), F.sum(cents).alias("cents"), F.any_value("__lw_path").alias("path"))
    below = F.concat(F.lit(folder + "/"), F.regexp_extract("path", "[^/]+/[^/]+$", 0))  # as the folder was named
    sums = sums.withColumn("path", below)
    ids = rows.select(FILE, PLACE, F.coalesce(F.col(f"`{schema.names[0]}`").cast("string"), F.lit("")).alias("id"))
    top = sums.agg(F.coalesce(F.max(FILE), F.lit(0))).first()[0]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, found = None, hashlib.sha256()
        kept: list[tuple[int, str]] = []
        for batch in batches:
            of = batch.column(0).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(np.diff(of)) + 1).tolist(), len(of)]
            for lo, hi in zip(starts, starts[1:], strict=False):
                if hi == lo:
                    continue
                text = ",".join(batch.column(2).slice(lo, hi - lo).to_pylist()).encode()
                if of[lo] == file:
                    found.update(b"," + text)
                else:
                    if file is not None:
                        kept.append((file, found.hexdigest()))
                    file, found = int(of[lo]), hashlib.sha256(text)
        if file is not None:
            kept.append((file, found.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.string())], names=[FILE, "ids_sha256"])

    streams = by_file(ids, FILE, top + 1).sortWithinPartitions(FILE, PLACE)
    shas = streams.mapInArrow(each, T.StructType([T.StructField(FILE, T.LongType()), T.StructField("ids_sha256", T.StringType())]))
    return sums.join(shas, FILE)


def victims_of(rows: DataFrame, on: str, ids: DataFrame) -> DataFrame:
    """Stored rows whose ``on`` is one of ``ids``; null is none."""
    return rows.join(ids.select(F.col(ids.columns[0]).alias("__lw_id")), F.col(f"`{on}`") == F.col("__lw_id"), "left_semi")
