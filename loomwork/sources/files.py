"""Repository files as a source: scan, ignore rules, text sniffing, inspection."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.operators.extract import identify_language

#: Folders and extensions that a scan leaves out, and the size above which a file is skipped.
IGNORED_FOLDERS = "node_modules .git dist build out coverage .venv venv __pycache__ target vendor .next .cache .idea .vscode bin obj".split()
BINARY_EXTENSIONS = "png jpg jpeg gif webp ico pdf zip gz tar jar class exe dll so dylib woff woff2 ttf eot mp3 mp4 mov avi wasm bin".split()
MAX_BYTES = 3 * 1024 * 1024
SNIFF_BYTES = 8192


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, modified, content) of every file below ``root``, by any store Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = F.lit(re.sub(r"^[a-z0-9]+:/*", "", root).strip("/") + "/")
    bare = F.regexp_replace("path", r"^[a-z0-9]+:/*", "")
    start = F.instr(bare, base)
    return rows.select(F.when(start > 0, F.substring(bare, start + F.length(base), F.length(bare))).otherwise(bare).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")


def looks_like_text(content: Column) -> Column:
    """No zero byte and under a tenth of control bytes among the first 8192; empty is text."""
    head = F.hex(F.substring(content, 1, SNIFF_BYTES))
    pairs = F.length(head) / 2
    codes = F.regexp_replace(head, "(..)", "$1 ")
    odd = F.regexp_count(codes, F.lit(r"\b(?:0[1-8BEF]|1[0-9A-F]|7F)\b"))
    return (pairs == 0) | (~codes.rlike(r"\b00\b") & (odd / F.greatest(pairs, F.lit(1)) < 0.1))


def parse_ignore(text: str) -> list[tuple[int, str, bool, bool]]:
    """Rules of an ignore file: number, regex over the path, negated, folders only; in order."""
    out = []
    for n, raw in enumerate(text.splitlines()):
        line = raw.rstrip()
        if not line or line.startswith("#"):
            continue
        negated, line = line.startswith("!"), line.lstrip("!")
        folder, line = line.endswith("/"), line.rstrip("/")
        anchored = "/" in line
        out.append((n, ("^" if anchored else "(?:^|/)") + glob_regex(line.lstrip("/")) + "(?:/|$)", negated, folder))
    return out


def glob_regex(glob: str) -> str:
    """A path glob as a regex: * within a step, ** across steps, ? one letter."""
    out, i = "", 0
    while i < len(glob):
        if glob[i : i + 3] == "**/":
            out, i = out + "(?:.*/)?", i + 3
        elif glob[i : i + 2] == "**":
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return out


def ignored(path: Column, rules: list[tuple[int, str, bool, bool]]) -> Column:
    """Whether the last rule that matches ignores the path; a rule for folders needs something below it."""
    hits = [F.when(path.rlike(regex[:-1].replace("(?:/|$", "/") + ".") if folder else path.rlike(regex), F.struct(F.lit(n).alias("n"), F.lit(negated).alias("neg"))) for n, regex, negated, folder in rules]
    if not hits:
        return F.lit(False)
    last = F.array_max(F.array_compact(F.array(*hits)))
    return F.coalesce(~last["neg"], F.lit(False))


def inspect(files: DataFrame, rules: list[tuple[int, str, bool, bool]] = (), *, most: int = MAX_BYTES) -> DataFrame:
    """(path, length, lang, status) of scanned files: kept, ignored, binary or too-large."""
    steps = F.split("path", "/")
    skip = F.exists(steps, lambda s: s.isin(IGNORED_FOLDERS)) | ignored(F.col("path"), list(rules))
    ext = F.lower(F.regexp_extract(X.basename(F.col("path")), r"\.([^.]+)$", 1))
    status = F.when(skip, "ignored").when(ext.isin(BINARY_EXTENSIONS), "binary").when(F.col("length") > most, "too-large")
    status = status.when((identify_language(F.col("path")) == "text") & ~looks_like_text(F.col("content")), "binary").otherwise("kept")
    return files.select("path", "length", identify_language(F.col("path")).alias("lang"), status.alias("status"))


def as_sources(files: DataFrame, rules: list[tuple[int, str, bool, bool]] = ()) -> DataFrame:
    """(path, lang, text) of the files a scan keeps."""
    kept = inspect(files, rules).where("status = 'kept'").select("path", "lang")
    return files.select("path", F.decode("content", "UTF-8").alias("text")).join(kept, "path").select("path", "lang", "text")
