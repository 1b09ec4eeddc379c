"""External records: commit logs, coverage reports and telemetry, parsed in the plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "@@commit@@"


def parse_commits(logs: DataFrame, mark: str = MARK) -> DataFrame:
    """(log_id, commit, path) of logs (log_id, output) whose commits are parted by a mark, with file names a line."""
    blocks = logs.select("log_id", F.posexplode(F.split("output", mark)).alias("commit", "block")).where("commit > 0")
    return blocks.select("log_id", "commit", F.explode(F.split("block", "\n")).alias("path")).select("log_id", "commit", F.trim("path").alias("path")).where("path <> ''").distinct()


def istanbul(reports: DataFrame) -> DataFrame:
    """(report, path, line, hits) of reports (report, json): a file's statement map and hit counts."""
    statement = "struct<start:struct<line:int>>"
    parsed = F.from_json("json", f"map<string,struct<path:string,statementMap:map<string,{statement}>,s:map<string,bigint>>>")
    files = reports.select("report", F.explode(parsed).alias("file", "c"))
    hits = files.select("report", F.coalesce("c.path", "file").alias("path"), F.col("c.statementMap").alias("m"), F.explode("c.s").alias("k", "hits"))
    return hits.select("report", "path", F.col("m")[F.col("k")]["start"]["line"].alias("line"), "hits").where("line is not null")


def line_lists(reports: DataFrame) -> DataFrame:
    """(report, path, line, hits) of the second format: {"files": [{"name", "lines": [..]}]}, every line hit once."""
    parsed = F.from_json("json", "files array<struct<name:string,lines:array<int>>>")
    files = reports.select("report", F.explode(parsed["files"]).alias("f"))
    return files.select("report", F.col("f.name").alias("path"), F.explode("f.lines").alias("line"), F.lit(1).cast("bigint").alias("hits"))


def first_source(*tables: DataFrame) -> DataFrame:
    """The first table that has rows, else the last."""
    return next((t for t in tables[:-1] if not t.isEmpty()), tables[-1])


def covered(reports: DataFrame) -> DataFrame:
    """(path, lines, covered) over both formats, a line covered if hit anywhere."""
    lines = reduce(DataFrame.unionByName, [istanbul(reports), line_lists(reports)]).groupBy("path", "line").agg(F.max("hits").alias("hits"))
    return lines.groupBy("path").agg(F.count("*").alias("lines"), F.count_if(F.col("hits") > 0).alias("covered"))


def telemetry(records: DataFrame) -> DataFrame:
    """(id, file, metric) of records (json): an array, or an object with ``mappings``; several names of a field."""
    row = "array<struct<id:string,file:string,filePath:string,path:string,metric:double,value:double>>"
    rows = F.when(F.trim("json").startswith("["), F.from_json("json", row)).otherwise(F.from_json("json", f"mappings {row}")["mappings"])
    return records.select(F.explode(rows).alias("r")).select("r.id", F.coalesce("r.filePath", "r.file", "r.path").alias("file"), F.coalesce("r.metric", "r.value").alias("metric")).where("id is not null and file is not null")
