"""The corpus pipeline: toxic documents go, repeated lines go, one of each group of
near copies stays, the rest is put into the order of its sources' target weights
and encoded. Each stage takes all that the one before it kept.

Every stage but the last returns the columns of its input, whatever their names.
``ORACLE_SQL`` is None: a trained tagger and sketches have no SQL; the tests hold
each stage against a brute-force version.

Defined results
* null and empty texts count as empty: they aren't toxic, and all documents
  without words are copies of one another. After the line stage a text isn't null.
* a null id is an id of its own: such rows are scored, cut and mixed like others
  and never go as copies. Rows that repeat an id stay or go together in the
  near-copy stage.
* null sources are one source; of ties the smaller id stays; rows that are
  alike in every column are kept or dropped alike.
* empty table: every stage returns an empty table with its columns.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, line_dedup, mixing, simhash, toxicity
from loomwork.llm.names import aside
from loomwork.llm.queries import held_out
from loomwork.session import cut, table

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.7; the tagger learns from the rows not held out."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, use=~held_out(F.col("doc_id")))
    return toxicity.reject(docs, model)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents less the lines that a smaller id holds; ``n_chars`` follows the text."""
    kept = aside(docs, lambda rows, named: line_dedup.dedup_lines(rows, named["doc_id"], named["text"]))
    return kept.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else kept


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: linked by SimHash, completed by bands, all decided by five-word shingles, similarity 0.8 or more."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, sorted into the schedule of their sources."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens and the token ids of each document, in order."""
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    made = bpe.encode(docs, ranks, public_tokenizers.PATTERN, keep=["doc_id", "source"])
    return made.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("byte-level BPE", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are cut off in the checkpoint folder."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
