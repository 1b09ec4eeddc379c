"""Fill-in-the-middle transformation: DuckDB SQL over Arrow batches.

Each batch is registered in a DuckDB connection of the task. One statement cuts
texts into pieces of code points with ``regexp_extract_all``, takes prefix,
middle and suffix with ``list_slice`` and ``array_to_string`` and draws the
cuts and the form from ``sha256`` of a salt and the id; its result returns as
Arrow, no row is touched in Python. A piece has ``_UNIT`` code points and only
the pieces that hold a cut are cut into single ones, so that the lists of a
very long text stay far smaller than the text. Batches are divided by bytes.

A text is left plain if it is empty, holds a sentinel (its output could not be
read back), or is not drawn; others become suffix-first or prefix-first output.

Defined results
* null text: an empty text, which is plain; null id: drawn as an empty id.
* output starts no sentinel but its own, so ``restored`` gives every text back.
* rows of the same id and text are formed alike; ties can't occur.
* empty table: empty result; other columns pass through, but those with the
  name of a made column (in any letter case) give way.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.names import others
from loomwork.session import ship

_UNIT = 64
_BYTES = 4_000_000  # of text in one statement, or one text
_MADE = {"form": pa.string(), "n": pa.int64(), "prefix_chars": pa.int64(), "middle_chars": pa.int64(), "output": pa.string()}


def statement(salt: str, rate: int, spm: int) -> str:
    """SQL over ``batch`` (key, text, and the row's place): the columns of ``_MADE`` in the order of the rows."""
    unit = f"'(?s).{{1,{_UNIT}}}'"

    def head(cut: str, tail: bool) -> str:
        """What lies before a cut, or after it, of the pieces."""
        at = f"{cut} // {_UNIT}"
        singles = f"regexp_extract_all(pieces[{at} + 1], '(?s).')"
        if tail:
            return f"array_to_string(list_slice({singles}, {cut} % {_UNIT} + 1, {_UNIT}), '') || array_to_string(list_slice(pieces, {at} + 2, len(pieces)), '')"
        return f"array_to_string(list_slice(pieces, 1, {at}), '') || coalesce(array_to_string(list_slice({singles}, 1, {cut} % {_UNIT}), ''), '')"

    return f"""
WITH cut AS (
  SELECT place, coalesce(text, '') AS text, sha256('{salt}:' || coalesce(key, '')) AS h,
         regexp_extract_all(coalesce(text, ''), {unit}) AS pieces
  FROM batch),
sized AS (
  SELECT *, CASE WHEN len(pieces) = 0 THEN 0 ELSE {_UNIT} * (len(pieces) - 1) + length(pieces[len(pieces)]) END AS n
  FROM cut),
drawn AS (
  SELECT place, text, pieces, n,
         ('0x' || h[1:8])::BIGINT % (n + 1) AS c1, ('0x' || h[9:16])::BIGINT % (n + 1) AS c2,
         CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR ('0x' || h[17:24])::BIGINT % 100 >= {rate} THEN 'plain'
              WHEN ('0x' || h[25:32])::BIGINT % 100 < {spm} THEN 'spm' ELSE 'psm' END AS form
  FROM sized),
cuts AS (SELECT *, least(c1, c2) AS lo, greatest(c1, c2) AS hi FROM drawn),
parted AS (
  SELECT *, CASE WHEN form <> 'plain' THEN {head("lo", False)} END AS prefix,
         CASE WHEN form <> 'plain' THEN coalesce({head("hi", True)}, '') END AS suffix,
         CASE WHEN form <> 'plain' THEN {head("hi", False)} END AS upto
  FROM cuts)
SELECT form, n, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       CASE form WHEN 'plain' THEN text
            WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || upto[lo + 1:]
            ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || upto[lo + 1:] END AS output
FROM parted ORDER BY place"""


def _divided(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with up to ``_BYTES`` of text each, at least one row."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    upto, at = np.cumsum(sizes, dtype=np.int64), 0
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + _BYTES, side="right")))
        yield batch.slice(at, end - at)
        at = end


def transform(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, salt: str = "1", rate: int = 90, spm: int = 20, keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all by default) with ``form``, ``n``, ``prefix_chars``, ``middle_chars`` and ``output``.

    ``rate`` of 100 texts are drawn, ``spm`` of 100 of these are suffix-first.
    """
    keep = others(docs.columns if keep is None else keep, *_MADE)
    ship(docs.sparkSession)
    kinds = {"string": T.StringType(), "int64": T.LongType()}
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, kinds[str(k)]) for c, k in _MADE.items()]])
    sql = statement(salt, rate, spm)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with duckdb.connect(config={"threads": 1, "temp_directory": ""}) as con:
            for batch in batches:
                for part in _divided(batch, len(keep) + 1):
                    rows = pa.table([part.column(len(keep)), part.column(len(keep) + 1), pa.array(np.arange(part.num_rows))], names=["key", "text", "place"])
                    con.register("batch", rows)
                    made = con.sql(sql).to_arrow_table().combine_chunks()
                    con.unregister("batch")
                    columns = [made.column(c).cast(k).combine_chunks() for c, k in _MADE.items()]
                    columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                    yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(keep))], *columns], names=schema.names)

    key = F.col(f"`{id_col}`").cast("string").alias("__lw_key")
    return docs.select(*[F.col(f"`{c}`") for c in keep], key, F.col(f"`{text_col}`").alias("__lw_text")).mapInArrow(each, schema)


def restored() -> Column:
    """The text that ``output`` and ``form`` stand for."""
    parts = F.split("output", "<[PSM]>", -1)
    prefix = F.when(F.col("form") == "psm", F.element_at(parts, 2)).otherwise(F.element_at(parts, 3))
    suffix = F.when(F.col("form") == "psm", F.element_at(parts, 3)).otherwise(F.element_at(parts, 2))
    return F.when(F.col("form") == "plain", F.col("output")).otherwise(F.concat(prefix, F.element_at(parts, 4), suffix))
