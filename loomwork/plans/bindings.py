"""The fixture tables seen as repository facts, in Spark and in SQL.

Orders stand for commits and parts for the files they change; a part followed
by another in the same order at least twice stands for a dependency edge.
Documents stand for files, events for test runs and canonical events.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.session import spread, table

COMMITS_SQL = "commits AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS path FROM lineitem)"


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(commit_id, path)"""
    lines = table(spark, sf_dir, "lineitem")
    return spread(lines.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("path")), "commit_id", rows=lines.count()).distinct()


EDGES_SQL = """edges AS (
  SELECT src, dst, count(*) AS weight FROM (
    SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem)
  WHERE dst IS NOT NULL AND src <> dst GROUP BY src, dst HAVING count(*) >= 2)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst, weight)"""
    inside = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, sf_dir, "lineitem")
    rows = lines.count()
    by_order = spread(lines.select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey", rows=rows)
    steps = by_order.select(F.col("l_partkey").alias("src"), F.lead("l_partkey").over(inside).alias("dst"))
    return spread(steps.where("dst is not null and src <> dst"), "src", "dst", rows=rows).groupBy("src", "dst").agg(F.count("*").alias("weight")).where("weight >= 2")


FILES_SQL = """files AS (
  SELECT doc_id, source || '/' || CASE WHEN doc_id % 5 = 0 THEN 'tests/' ELSE '' END || 'd' || doc_id ||
         CASE WHEN doc_id % 5 = 0 THEN '.test.' ELSE '.' END || lang AS path,
         source, lang, text, n_chars, sha256(text) AS content_hash,
         len(string_split(text, chr(10))) AS line_count, doc_id % 5 = 0 AS is_test
  FROM documents)"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, path, source, lang, text, n_chars, content_hash, line_count, is_test)"""
    docs = table(spark, sf_dir, "documents")
    test = F.col("doc_id") % 5 == 0
    path = F.concat("source", F.lit("/"), F.when(test, "tests/").otherwise(""), F.lit("d"), F.col("doc_id").cast("string"), F.when(test, ".test.").otherwise("."), "lang")
    return docs.select("doc_id", path.alias("path"), "source", "lang", "text", "n_chars", F.sha2("text", 256).alias("content_hash"), F.size(F.split("text", "\n", -1)).cast("long").alias("line_count"), test.alias("is_test"))


RUNS_SQL = """runs AS (
  SELECT user_id AS test_id, event_id AS attempt, event_type <> 'error' AS passed, event_type AS message FROM events)"""


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(test_id, attempt, passed, message)"""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("test_id"), F.col("event_id").alias("attempt"), (F.col("event_type") != "error").alias("passed"), F.col("event_type").alias("message"))


#: Snapshots before and after: overlapping parts of the orders, hashed by content; some lose their status in between.
OLD_SQL = "old AS (SELECT o_orderkey AS path, sha256(o_orderstatus || '|' || o_orderpriority) AS content_hash, sha256(o_orderpriority) AS structural_hash FROM orders WHERE o_orderkey % 7 <> 0)"
NEW_SQL = """new AS (SELECT o_orderkey AS path,
  sha256(CASE WHEN o_orderkey % 11 = 0 THEN 'X' ELSE o_orderstatus END || '|' || CASE WHEN o_orderkey % 22 = 0 THEN 'Y' ELSE o_orderpriority END) AS content_hash,
  sha256(CASE WHEN o_orderkey % 22 = 0 THEN 'Y' ELSE o_orderpriority END) AS structural_hash FROM orders WHERE o_orderkey % 5 <> 0)"""


def snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(path, content_hash, structural_hash) before and after."""
    orders = table(spark, sf_dir, "orders")
    key, status, prio = F.col("o_orderkey"), F.col("o_orderstatus"), F.col("o_orderpriority")
    later, deep = F.when(key % 11 == 0, F.lit("X")).otherwise(status), F.when(key % 22 == 0, F.lit("Y")).otherwise(prio)

    def seen(s, p):
        return [key.alias("path"), F.sha2(F.concat(s, F.lit("|"), p), 256).alias("content_hash"), F.sha2(p, 256).alias("structural_hash")]

    return orders.where(key % 7 != 0).select(*seen(status, prio)), orders.where(key % 5 != 0).select(*seen(later, deep))


TOKENS = X.lexical_tokens


def literal(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A few fixed rows as a local relation (no Python on executors)."""
    names = [c.split(" ")[0] for c in columns.split(", ")]
    kinds = [c.split(" ", 1)[1] for c in columns.split(", ")]
    made = [F.struct(*[F.lit(v).cast(k).alias(n) for v, n, k in zip(r, names, kinds, strict=True)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*made)))


def values_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """The same rows as a CTE for DuckDB."""
    shown = ", ".join("(" + ", ".join("NULL" if v is None else str(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)
    return f"{name}({', '.join(columns)}) AS (VALUES {shown})"


def texts_sql(name: str, columns: list[str], rows: list[tuple]) -> str:
    """The rows (id, text) and all turns of conversations as a CTE for DuckDB."""
    made = values_sql("v", columns, rows).split(" AS ", 1)[1]
    return f"{name}({', '.join(columns)}) AS (SELECT * FROM {made} UNION ALL SELECT 1000 + conv_id * 1000 + turn, coalesce(text, '') FROM conversations)"


def texts(spark: SparkSession, sf_dir: str, columns: str, rows: list[tuple]) -> DataFrame:
    """A few fixed rows (id, text) and all turns of conversations."""
    turns = table(spark, sf_dir, "conversations").select((1000 + F.col("conv_id") * 1000 + F.col("turn")).cast("long"), F.coalesce("text", F.lit("")))
    return literal(spark, columns.replace("id int", "id long"), rows).union(turns)
