"""SimHash near-dedup by meet-in-the-middle ball hashing.

Two fingerprints at distance 2 or less share a string at distance 1 or less
from both. So every distinct fingerprint emits itself and its 64 one-bit
flips, and the shuffle on these variants brings all links together. A variant
has at most 65 distinct fingerprints around it, however many documents are
copies, and they are all within distance 2 of one another: each is linked to
the smallest (a star instead of all pairs), verified by popcount, deduplicated.

Defined results
* null or empty text and text of blanks: fingerprint 0, linked like any other.
* fewer words than a shingle: the whole sequence is the only shingle.
* null ids keep their fingerprint; a component's id is the smallest non-null id.
* repeated rows are repeated in the result; empty table: empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomwork.llm.components import cut_rows, star_components
from loomwork.session import cut, ship

BITS = 64
_CHUNK = 1 << 16
#: Shingles mixed at once, rounds of stars, pairs a member up to which all pairs of a key are tested, and the ratio of a class of sizes.
_BLOCK, _STARS, _LIGHT, _RATIO = 1 << 10, 2, 4, 1.05


def fingerprint(text: bytes | None, words: int = 3, seed: int = 42) -> int:
    """The SimHash of one text: bit b is set if set in over half of the shingles' hashes."""
    found = (text or b"").lower().split()
    if not found:
        return 0
    n = max(1, len(found) - words + 1)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends.tolist()
    whole, last = b" ".join(found), len(found)
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, dtype=np.int64)
    for a in range(0, n, _CHUNK):
        stop = min(n, a + _CHUNK)
        hashes = np.array([digest(whole[starts[i] : ends[min(i + words, last) - 1]], seed) for i in range(a, stop)], dtype="<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * votes > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3) -> DataFrame:
    """(id, fp): the signed 64-bit SimHash of each row's text."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [fingerprint(x.as_py(), words) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.int64())], names=["id", "fp"])

    ship(docs.sparkSession)
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField("id", kind), T.StructField("fp", T.LongType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(each, schema)


def _ball(name: str) -> Column:
    """The fingerprint and its 64 one-bit flips."""
    masks = F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(BITS)])
    return F.transform(masks, lambda m: F.col(name).bitwiseXOR(m))


def links(distinct: DataFrame) -> DataFrame:
    """Star edges (u, v) between distinct ``fp`` at Hamming distance 2 or less."""
    spread = distinct.select("fp", F.explode(_ball("fp")).alias("variant"))
    least = F.min("fp").over(Window.partitionBy("variant"))
    star = spread.select("fp", least.alias("v")).where("fp <> v").distinct()
    return star.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("v"))) <= 2).select(F.col("fp").alias("u"), "v")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 3) -> DataFrame:
    """(id, fp, component) per row; ``component`` is the smallest id reachable by links."""
    prints = cut(fingerprints(docs, id_col, text_col, words=words))
    distinct = prints.groupBy("fp").agg(F.min("id").alias("least"))
    roots = star_components(links(distinct.select("fp")))
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    of_root = rooted.groupBy("root").agg(F.min("least").alias("component"))
    of_fp = rooted.join(of_root, "root").select("fp", "component")
    return prints.join(of_fp, "fp").select("id", "fp", "component")


def _mixed(h: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """A family of 64-bit mixes of the hashes, one a seed (SplitMix64's finalizer)."""
    h = h + seed
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _seeds(n: int) -> np.ndarray:
    return np.array([0x9E3779B97F4A7C15 * (k + 1) % (1 << 64) for k in range(n)], dtype=np.uint64)


def shingles(text: bytes | None, words: int = 5) -> np.ndarray:
    """The sorted distinct hashes of the shingles: one of all words if they are fewer, none of a text without words."""
    found = (text or b"").lower().split()
    if not found:
        return np.zeros(0, dtype=np.uint64)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts, ends = [0, *(ends[:-1] + 1).tolist()], ends.tolist()
    whole, last = b" ".join(found), len(found)
    digest = xxhash.xxh64_intdigest
    made = (digest(whole[starts[i] : ends[min(i + words, last) - 1]]) for i in range(max(1, last - words + 1)))
    return np.unique(np.fromiter(made, dtype=np.uint64))


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """The similarity of two sorted sets; two empty ones are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def band_keys(hashes: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A key a band: the digest of the least values of ``rows`` mixes of the shingles' hashes."""
    seeds, least = _seeds(bands * rows)[:, None], np.full(bands * rows, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(hashes), _BLOCK):
        np.minimum(least, _mixed(hashes[None, a : a + _BLOCK], seeds).min(axis=1), out=least)
    return np.array([xxhash.xxh64_intdigest(least[b * rows : (b + 1) * rows].tobytes(), b) for b in range(bands)], dtype=np.uint64).view(np.int64)


def _overlap(a: Column, b: Column, share: Fraction) -> Column:
    """The least overlap of two sets of sizes a and b whose Jaccard similarity is ``share``, rounded up, in whole numbers."""
    over = F.lit(share.numerator) * (a + b)
    under = F.lit(share.numerator + share.denominator)
    return F.floor((over + under - 1) / under).cast("long")


def _rooted(members: DataFrame, n: int, edges: DataFrame, m: int) -> DataFrame:
    """(key, node, root, pop) of the keys that still hold more than one root, with ``heavy`` if many of their pairs are apart.

    ``members`` has ``n`` rows, ``edges`` up to ``m`` of the fingerprints and ``n`` of each round of stars.
    """
    roots = star_components(edges, most=m + _STARS * n).withColumnRenamed("node", "__n")
    rooted = members.join(roots, members["node"] == roots["__n"], "left").select("key", "node", "pop", F.coalesce("root", "node").alias("root"))
    alike = rooted.groupBy("key", "root").agg(F.count("*").cast("double").alias("m"))
    open_ = alike.groupBy("key").agg(F.count("*").alias("roots"), F.sum("m").alias("m"), F.sum(F.col("m") * F.col("m")).alias("same"), F.max_by("root", F.struct("m", "root")).alias("first"))
    apart = (F.col("m") * F.col("m") - F.col("same")) / 2
    return cut_rows(rooted.join(open_.where("roots > 1").select("key", "first", (apart > _LIGHT * F.col("m")).alias("heavy")), "key"), n)


def _pair(u: str = "node", v: str = "v") -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def _print_links(nodes: DataFrame) -> DataFrame:
    """Pairs of ``nodes`` (node, fp) that their fingerprints link: each with the least of its fingerprint, and these by the balls."""
    hubs = cut(nodes.groupBy("fp").agg(F.min("node").alias("hub")))
    same = nodes.join(hubs, "fp").where("node <> hub").select(*_pair("node", "hub"))
    one, two = hubs.toDF("u", "a"), hubs.toDF("v", "b")
    near = links(hubs.select("fp")).join(one, "u").join(two, "v").where("a <> b").select(*_pair("a", "b"))
    return same.union(near).distinct()


def _stars(rooted: DataFrame) -> DataFrame:
    """Pairs of each key's most popular node outside its largest root with every node of another root."""
    hubs = rooted.where("root <> first or node = first").groupBy("key").agg(F.max_by(F.struct(F.col("node").alias("v"), F.col("root").alias("rv")), F.struct(F.col("root") != F.col("first"), "pop", "node")).alias("hub"))
    return rooted.join(hubs.select("key", "hub.*"), "key").where("root <> rv").select(*_pair()).distinct()


def _rare_pairs(rooted: DataFrame, sets: DataFrame, share: Fraction) -> DataFrame:
    """Pairs of different roots that may still be alike, by the prefix filter over their shingles, rarest first.

    Two sets that must overlap in t shingles of a common order share one among
    the first |x| - t + 1 of each. Shingles that only one set holds come first
    and meet nothing, so sets with many of their own drop out. As t grows with
    the other's size, prefixes are taken for each class of sizes apart. Pairs
    within the largest root of a shingle are never built.
    """
    some = rooted.select("node", "root").distinct()
    held = some.join(sets.withColumnRenamed("id", "node"), "node").select("node", "root", F.size("hashes").cast("long").alias("a"), F.explode("hashes").alias("tok"))
    counts = held.groupBy("tok").agg(F.count("*").alias("df")).where("df > 1")
    # What all share can't be hot on both sides: ``counts`` has a row a shingle.
    ranked = held.join(counts, "tok").groupBy("node", "root", "a").agg(F.sort_array(F.collect_list(F.struct("df", "tok"))).alias("shared"))
    kind = F.floor(F.log("a") / F.log(F.lit(_RATIO))).cast("int")
    reach = -(-float(np.log(1 / float(share)) / np.log(_RATIO)) // 1)
    aimed = ranked.select("*", kind.alias("c"), F.explode(F.sequence(kind - int(reach) - 1, kind + int(reach) + 1)).alias("to"))
    floor_ = F.greatest(F.floor(F.pow(F.lit(_RATIO), F.col("to").cast("double")) - 1e-6), F.ceil(F.col("a") * F.lit(float(share)) - 1e-6), F.lit(1)).cast("long")
    first = F.col("a") - F.size("shared")  # the set's own shingles
    length = F.col("a") - _overlap(F.col("a"), floor_, share) + 1 - first
    cut_off = F.slice("shared", F.lit(1), F.greatest(length, F.lit(0)).cast("int"))
    keys = [F.col("x.tok").alias("tok"), F.least("c", "to").alias("lo"), F.greatest("c", "to").alias("hi")]
    spread = aimed.where(length > 0).select("node", "root", "a", "c", "to", first.alias("own"), F.posexplode(cut_off).alias("at", "x"))
    spread = cut(spread.select(*keys, "node", "root", "a", "c", (F.col("own") + F.col("at")).alias("at")))  # ``at`` shingles come before
    by = ["tok", "lo", "hi"]
    heads = spread.groupBy(*by, "root").agg(F.count("*").alias("n")).groupBy(*by).agg(F.max_by("root", F.struct("n", "root")).alias("head"), F.count("*").alias("roots")).where("roots > 1").drop("roots")
    left = spread.join(heads, by).where("root <> head")
    right = spread.select(*by, F.col("node").alias("v"), F.col("root").alias("rv"), F.col("a").alias("b"), F.col("c").alias("cv"), F.col("at").alias("bt"))
    met = left.join(right, by).where("root <> rv and (rv = head or node < v) and (lo = hi or c <> cv)")
    return met.where(F.least(F.col("a") - F.col("at"), F.col("b") - F.col("bt")) >= _overlap(F.col("a"), F.col("b"), share)).select(*_pair()).distinct()


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8, bands: int = 24, rows: int = 4) -> tuple[DataFrame, DataFrame]:
    """(node ids, edges) that join documents whose distinct shingles have a Jaccard similarity of ``similarity`` or more.

    The first candidates are the links of the documents' SimHashes. They can't
    give all: at 0.8 two fingerprints differ in some 10 bits. Further ones
    share all ``rows`` minima of one of ``bands`` bands of shingles:
    similarity j is missed with probability (1 - j ** rows) ** bands. Two
    rounds of stars around each key's most popular nodes join large groups.
    Of the pairs that aren't joined by then, those of keys with few are all
    tested; those of the other keys go through the prefix filter, which is
    exact. Every edge is decided by the exact similarity of the two sets.
    Documents of one set of shingles are one node, its smallest id.
    """
    share = Fraction(similarity).limit_denominator(1_000_000)

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for batch in batches:
                found, keys, prints = [], [], []
                for x in batch.column(1):
                    prints.append(fingerprint(x.as_py()))
                    hashes = shingles(x.as_py(), words)
                    found.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    keys.append(band_keys(hashes, bands, rows))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(prints, pa.int64())], names=["id", "set", "keys", "fp"])

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                made = [shingles(x.as_py(), words).view(np.int64) for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(made, pa.list_(pa.int64()))], names=["id", "hashes"])

    ship(docs.sparkSession)
    own_id = T.StructField("id", docs.schema[id_col].dataType)
    longs = T.ArrayType(T.LongType())
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("t"))
    sketched = texts.mapInArrow(sketch, T.StructType([own_id, T.StructField("set", T.BinaryType()), T.StructField("keys", longs), T.StructField("fp", T.LongType())]))
    nodes = cut(sketched.groupBy("set", "keys").agg(F.min(F.struct("id", "fp")).alias("x")).select("keys", F.col("x.id").alias("node"), "x.fp"))
    linked = cut(_print_links(nodes))
    spread = nodes.select("node", F.explode("keys").alias("key"))
    shared = spread.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    met = cut(spread.join(shared, "key").select("key", "node", "n"))
    popular = met.groupBy("node").agg(F.sum("n").alias("pop"))
    n = met.count()
    members = cut_rows(met.join(popular, "node").select("key", "node", "pop"), n)
    asked = popular.select("node").union(linked.select("u")).union(linked.select("v"))
    sets = cut(texts.join(asked.toDF("id"), "id", "left_semi").distinct().mapInArrow(listed, T.StructType([own_id, T.StructField("hashes", longs)])))

    def decide(pairs: DataFrame, rows: int) -> DataFrame:
        with_u = pairs.join(sets.toDF("u", "hu"), "u")
        sized = with_u.join(sets.toDF("v", "hv"), "v")
        a, b = F.size("hu").cast("long"), F.size("hv").cast("long")
        met = F.size(F.array_intersect("hu", "hv"))
        return cut_rows(sized.where(F.least(a, b) >= _overlap(a, b, share)).where(met >= _overlap(a, b, share)).select("u", "v").distinct(), rows)

    m = linked.count()
    edges = decide(linked, m)
    for _ in range(_STARS):
        edges = edges.union(decide(_stars(_rooted(members, n, edges, m)), n))  # a pair a member at most
    left = _rooted(members, n, edges, m)
    light = left.where(~F.col("heavy"))
    others = light.select("key", F.col("node").alias("v"), F.col("root").alias("rv"))
    few = light.join(others, "key").where("root <> rv and node < v").select(*_pair())
    many = _rare_pairs(left.where("heavy"), sets, share)
    return nodes.select("node"), edges.union(decide(few.union(many).distinct(), _LIGHT * n))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the smallest id of each group of near copies; rows without an id stay.

    Rows that repeat an id stay or go together.
    """
    nodes, edges = near_links(docs, id_col, text_col, words=words, similarity=similarity)
    roots = star_components(edges)
    kept = nodes.join(roots, "node", "left_anti").select(F.col("node").alias("__lw_kept"))
    stay = docs.join(kept.hint("shuffle_hash"), docs[id_col] == kept["__lw_kept"], "left_semi")
    return stay.unionByName(docs.where(F.col(id_col).isNull()))
