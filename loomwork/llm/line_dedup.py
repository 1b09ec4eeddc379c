"""Line dedup by levelled sorted runs of line hashes (DataFrame operations only).

All lines are hashed once, into a table by batches of the input's partitions. Each
batch is reduced to one row per line hash with its smallest id, merge-joined
against the sorted runs of the hashes seen so far, and its unseen hashes are a
new run; the smallest id of a repeated hash is the least of all batches' rows. When a level holds
``fanout`` runs they are compacted into one run of the next level, so a batch
meets only a logarithmic number of runs. Runs are checkpoints in partitions of the
hash, sorted: a batch shuffles its own distinct hashes, no merge shuffles or sorts a
run, and no compaction shuffles one. Lines themselves aren't partitioned, so a
line that a third of all documents hold is combined before it is shuffled, and
split in the last join.

Defined results
* null or empty text: one empty line, kept; keys under ``min_chars`` stay.
* null ids sort after every id: their lines fall to any id that holds the key,
  and stay among themselves.
* rows that repeat an id count as one document; each is cut by its own text.
* empty table: empty result. Other columns pass through untouched, but one named
  ``n_lines`` or ``n_dropped`` (in any letter case) gives way to the operator's.
"""

from __future__ import annotations

from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm.components import cut_rows
from loomwork.llm.names import others
from loomwork.session import cut, ensure_checkpoint_dir, shuffle_partitions

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_BLANKS = " \t\n\x0b\x0c\r"
_ID, _POS, _H1, _H2, _OWNER, _ROW, _BATCH = "__lw_id", "__lw_pos", "__lw_h1", "__lw_h2", "__lw_owner", "__lw_row", "__lw_batch"
_KEY = [_H1, _H2]


def line_key(line: Column) -> Column:
    """The line stripped of ASCII blanks, with A-Z (and no other letter) lowered."""
    bare = F.btrim(line, F.lit(_BLANKS))
    ascii_only = F.octet_length(bare) == F.char_length(bare)
    return F.when(ascii_only, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _hashed(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """One row per line long enough to be a key: id, row digest, position and a 128-bit hash."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias(_ID), F.xxhash64(text).alias(_ROW), F.posexplode(_lines(text)).alias(_POS, "__lw_line"))
    rows = rows.select(_ID, _ROW, _POS, line_key(F.col("__lw_line")).alias("__lw_key"))
    rows = rows.where(F.char_length("__lw_key") >= min_chars)
    return rows.select(_ID, _ROW, _POS, F.xxhash64("__lw_key").alias(_H1), F.xxhash64(F.lit(7), "__lw_key").alias(_H2))


def _folder(spark: SparkSession) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/lw-lines-{uuid4().hex}"


def run_of(rows: DataFrame) -> DataFrame:
    """``rows`` as a run: a checkpoint in the partitions of the key that they come in, sorted by it.

    A checkpoint knows its partitions and order if the plan that made it had
    them from the start, so it is made without adaptive changes.
    """
    spark, key = rows.sparkSession, "spark.sql.adaptive.enabled"
    was = spark.conf.get(key)
    spark.conf.set(key, "false")
    try:
        return cut(rows.sortWithinPartitions(*_KEY))
    finally:
        spark.conf.set(key, was)


def meet(firsts: DataFrame, runs: list[DataFrame]) -> DataFrame:
    """A batch's keys merge-joined to every run: does one hold the key, and the smallest id known so far."""
    held, least = F.lit(False), F.col("__lw_lo")
    for i, run in enumerate(runs):
        marked = run.select(*_KEY, F.col(_OWNER).alias(f"__lw_o{i}"), F.lit(True).alias(f"__lw_in{i}"))
        firsts = firsts.join(marked.hint("merge"), _KEY, "left")
        held = held | F.coalesce(f"__lw_in{i}", F.lit(False))
        least = F.least(least, f"__lw_o{i}")
    return firsts.select(*_KEY, "__lw_many", held.alias("__lw_held"), least.alias(_OWNER))


def compacted(runs: list[DataFrame]) -> DataFrame:
    """One run of all: runs share no key, and lie in the same partitions."""
    return run_of(reduce(DataFrame.unionByName, runs))


def repeated_keys(hashed: DataFrame, batches: int, *, fanout: int = 2) -> DataFrame:
    """Line hashes found in at least two documents, each with the smallest id that holds it; ``hashed`` has a batch column."""
    levels: list[list[DataFrame]] = []
    repeated: list[DataFrame] = []
    for k in range(batches):
        firsts = hashed.where(F.col(_BATCH) == k).groupBy(*_KEY).agg(F.min(_ID).alias("__lw_lo"), F.max(_ID).alias("__lw_hi"), F.max(F.col(_ID).isNull()).alias("__lw_null"))
        many = (F.col("__lw_lo") < F.col("__lw_hi")) | (F.col("__lw_lo").isNotNull() & F.col("__lw_null"))
        firsts = firsts.select(*_KEY, "__lw_lo", F.coalesce(many, F.lit(False)).alias("__lw_many"))
        met = run_of(meet(firsts, [r for level in levels for r in level]))
        repeated.append(met.where("__lw_held or __lw_many").select(*_KEY, _OWNER))
        run, level = met.where("not __lw_held").select(*_KEY, _OWNER), 0
        while k + 1 < batches:
            if len(levels) == level:
                levels.append([])
            levels[level].append(run)
            if len(levels[level]) < fanout:
                break
            run = compacted(levels[level])
            levels[level] = []
            level += 1
    every = reduce(DataFrame.unionByName, repeated)
    owners = every.groupBy(*_KEY).agg(F.min(_OWNER).alias(_OWNER)).where(F.col(_OWNER).isNotNull())
    # Cut off, so that the last join is between two plain shuffles and a hot line's side can be split.
    return cut_rows(owners, every.count())


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_chars: int = 10, batches: int = 4, task_docs: int = 16_384, fanout: int = 2) -> DataFrame:
    """``docs`` with repeated lines cut from ``text_col``, plus ``n_lines`` and ``n_dropped``.

    There are ``batches`` batches, or more if one would have more than
    ``task_docs`` documents a shuffle partition; ``fanout`` runs of a level are
    compacted into one. Neither changes the result.
    """
    spark = docs.sparkSession
    n = docs.count()
    batches = max(batches, -(-n // (task_docs * shuffle_partitions(spark))))
    path = _folder(spark)
    # Few documents in many partitions would make as many small files.
    tasks = max(-(-n // task_docs), 4 * spark.sparkContext.defaultParallelism, batches)
    lines = _hashed(docs.coalesce(tasks), id_col, text_col, min_chars).withColumn(_BATCH, F.pmod(F.spark_partition_id(), F.lit(batches)))
    lines.write.partitionBy(_BATCH).parquet(path)
    hashed = spark.read.schema(lines.schema).parquet(path)
    owners = repeated_keys(hashed, batches, fanout=fanout)
    hits = hashed.join(owners, _KEY).where((F.col(_ID) > F.col(_OWNER)) | F.col(_ID).isNull())
    drops = hits.groupBy(_ID, _ROW).agg(F.sort_array(F.collect_set(_POS)).alias("__lw_drops"))

    keep = others(docs.columns, "n_lines", "n_dropped")
    base = docs.select(*keep, F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("__lw_t"))
    same = base[id_col].eqNullSafe(drops[_ID]) & (base["__lw_t"] == drops[_ROW])
    met = base.join(drops.hint("merge"), same, "left").select(*[base[c] for c in keep], "__lw_drops", _lines(base[text_col]).alias("__lw_lines"))
    n, k = F.size("__lw_lines"), F.size("__lw_drops")
    met = met.select(*keep, "__lw_drops", "__lw_lines", n.cast("long").alias("n_lines"), F.when(F.col("__lw_drops").isNull(), 0).otherwise(k).cast("long").alias("n_dropped"))
    # The runs of lines between drops, so that the cost is linear in the lines.
    starts = F.concat(F.array(F.lit(0)), F.transform("__lw_drops", lambda d: d + 1))
    ends = F.concat(F.col("__lw_drops"), F.array(F.col("n_lines").cast("int")))
    spans = F.arrays_zip(starts.alias("s"), ends.alias("e"))
    kept = F.flatten(F.transform(spans, lambda x: F.slice("__lw_lines", x["s"] + 1, x["e"] - x["s"])))
    cut_text = F.when(F.col("__lw_drops").isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    return met.select(*[cut_text.alias(c) if c == text_col else F.col(c) for c in keep], "n_lines", "n_dropped")
