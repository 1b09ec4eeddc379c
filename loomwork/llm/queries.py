"""Queries of the corpus operators and their SQL, by name."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, chat, erasure, fim, html, line_dedup, media, mixing, quality, secrets, simhash, topk, toxicity
from loomwork.session import cut, table


def held_out(doc_id: Column) -> Column:
    """The third of the ids that no model learns from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels, use=~held_out(F.col("doc_id")))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op2_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = media.features(media.store_text(docs))
    return found.select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256",
        F.col("dhash").alias("feature"), F.sha2("tile", 256).alias("tile_sha256"),
    )


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 100 == 0)


OP3_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS x
  FROM embeddings),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(list_inner_product(CAST(a.x AS DOUBLE[]), CAST(b.x AS DOUBLE[])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 10
"""


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    found = secrets.verdicts(docs)
    kinds = F.array(*[F.lit(k) for k in secrets.KINDS])
    printed = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", kinds[x["kind"]], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] < len(secrets.BASE))
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(printed(base), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"),
    )


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(own)
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return chat.read_back(chat.format_turns(turns, ranks, public_tokenizers.PATTERN), ranks, public_tokenizers.PATTERN)


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html.extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    plan = mixing.mix_plan(docs)
    return plan.select(F.col("id").alias("doc_id"), F.col("s").alias("source"), "block", "slot", "release", "deadline", "within")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = line_dedup.dedup_lines(docs)
    return cut.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
  FROM documents),
keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM lines),
owners AS (SELECT k, min(doc_id) AS owner FROM keyed WHERE length(k) >= 10 GROUP BY k),
marked AS (
  SELECT a.doc_id, a.pos, a.line, coalesce(a.doc_id > o.owner, false) AS dropped
  FROM keyed a LEFT JOIN owners o ON a.k = o.k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    classes = simhash.near_classes(docs)
    digits = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return classes.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), F.col("component").alias("component_id"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ranks = bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return bpe.digests(bpe.encode(docs, ranks, public_tokenizers.PATTERN), ranks)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    formed = fim.transform(docs, keep=["doc_id"])
    return formed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(), 256).alias("restored_sha256"),
    )


OP11_SQL = """
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT *, CAST('0x' || substr(h, 1, 8) AS BIGINT) AS h1, CAST('0x' || substr(h, 9, 8) AS BIGINT) AS h2,
             CAST('0x' || substr(h, 17, 8) AS BIGINT) AS h3, CAST('0x' || substr(h, 25, 8) AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
             CASE WHEN text = '' OR text LIKE '%<P>%' OR text LIKE '%<S>%' OR text LIKE '%<M>%' OR h3 % 100 >= 90 THEN 'plain'
                  WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT *, left(text, a) AS pre, substr(text, a + 1, b - a) AS mid, substr(text, b + 1) AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN text ELSE pre || mid || suf END) AS restored_sha256
FROM p
"""


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = quality.train(docs, labels, use=~out)
    scored = quality.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"), "bad_share", "n_bad")


def victim_masters(clients: DataFrame, clicks: DataFrame) -> DataFrame:
    """Masters whose crc32 is divisible by 100, and the one with most clicks (the smallest of several)."""
    pairs = clients.where("master_id is not null").select("master_id", "client_id").distinct()
    per_client = clicks.groupBy("client_id").agg(F.count("*").alias("n"))
    per_master = pairs.join(per_client, "client_id", "left").groupBy("master_id").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    most = per_master.orderBy(F.desc("n"), "master_id").limit(1).select("master_id")
    return per_master.where(erasure.crc_order(F.col("master_id")) % 100 == 0).select("master_id").union(most).distinct()


def op13_erasure(spark: SparkSession, sf_dir: str) -> DataFrame:
    amounts = {"clients": "balance", "clicks": "value", "sales": "total", "sale_lines": "amount"}
    folder = erasure.new_folder(spark, "erasure")
    given = {t: table(spark, sf_dir, t) for t in amounts}
    # Cut off, so that the join is between two plain shuffles and a hot sale's lines can be split.
    owners = cut(given["sales"].where("sale_id is not null").groupBy(F.col("sale_id").alias("__lw_sale")).agg(F.min("client_id").alias("__lw_client")))
    keyed = {t: (rows, F.col("client_id")) for t, rows in given.items()}
    keyed["sale_lines"] = given["sale_lines"].join(owners, F.col("sale_id") == F.col("__lw_sale"), "left"), F.col("__lw_client")
    size = {t: erasure.write_sorted(rows, erasure.crc_order(key), given[t].schema, f"{folder}/{t}") for t, (rows, key) in keyed.items()}

    rows = {t: erasure.stored(spark, f"{folder}/{t}", given[t].schema) for t in amounts}
    masters = victim_masters(rows["clients"], rows["clicks"])
    clients = cut(erasure.victims_of(rows["clients"], "master_id", masters).select(erasure.FILE, erasure.PLACE, "client_id"))
    ids = clients.select("client_id")
    clicks = erasure.victims_of(rows["clicks"], "client_id", ids)
    sales = cut(erasure.victims_of(rows["sales"], "client_id", ids).select(erasure.FILE, erasure.PLACE, "sale_id"))
    lines = erasure.victims_of(rows["sale_lines"], "sale_id", sales.select("sale_id"))
    marks = {t: cut(erasure.intervals(v, size[t])) for t, v in {"clients": clients, "clicks": clicks, "sales": sales, "sale_lines": lines}.items()}

    out = []
    for t, amount in amounts.items():
        hit = erasure.rewrite(spark, f"{folder}/{t}", given[t].schema, marks[t])
        found = erasure.digests(spark, f"{folder}/{t}", given[t].schema, amount).join(F.broadcast(hit), erasure.FILE, "left")  # one row a file
        erased = F.coalesce("erased", F.lit(0))
        out.append(found.select(
            F.lit(t).alias("table_name"), F.col(erasure.FILE).alias("file_no"), "n_rows", erased.alias("n_erased"), "cents",
            (erased > 0).alias("rewritten"), "ids_sha256", F.lit(",".join(given[t].columns)).alias("columns"), "path",
        ))
    return reduce(DataFrame.unionByName, out)


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity, "op2_media": op2_media, "op3_topk": op3_topk, "op4_secrets": op4_secrets, "op5_mixing": op5_mixing,
        "op6_chat": op6_chat, "op7_line_dedup": op7_line_dedup, "op8_simhash": op8_simhash, "op9_bpe": op9_bpe,
        "op10_html": op10_html, "op11_fim": op11_fim, "op12_quality": op12_quality, "op13_erasure": op13_erasure, "pipeline": pipeline,
    }


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op7_line_dedup": OP7_SQL, "op11_fim": OP11_SQL}
