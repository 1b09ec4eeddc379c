import random

import xxhash

from loomwork.llm import simhash
from loomwork.llm.components import star_components
from tests.llm.data import SCHEMA, documents


def brute_print(text, words=3):
    found = (text or "").encode().lower().split()
    if not found:
        return 0
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(rows, near):
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if near(i, j):
                parent[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(doc, least.get(find(i), doc))
    return [least.get(find(i)) for i in range(len(rows))]


def test_spark_hash_and_python_hash_agree(spark):
    text = "one two three"
    assert spark.sql(f"select xxhash64('{text}')").first()[0] % 2**64 == xxhash.xxh64_intdigest(text.encode(), 42)


def test_near_classes_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    prints = [brute_print(t) for _, t in rows]
    want = brute_classes(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = simhash.near_classes(docs).collect()
    assert sorted(((r.id, r.fp % 2**64, r.component) for r in got), key=str) == sorted(((d, p, c) for (d, _), p, c in zip(rows, prints, want)), key=str)


def test_links_reach_every_close_pair(spark):
    rng = random.Random(1)
    prints = {rng.getrandbits(64) for _ in range(40)}
    for p in list(prints):
        for _ in range(4):
            p ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            prints.add(p)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in star_components(edges).collect()}
    rows = sorted((p, "") for p in signed)
    want = brute_classes(rows, lambda i, j: ((rows[i][0] ^ rows[j][0]) % 2**64).bit_count() <= 2)
    assert [roots.get(p, p) for p, _ in rows] == want


def test_star_components_on_a_path_a_star_and_nothing(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 180)] + [(7, 7)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, **{i: 100 for i in range(101, 180)}}
    assert star_components(spark.createDataFrame([], "u long, v long")).count() == 0


def similar(a, b, words=5):
    grams = lambda t: {tuple(t.lower().split()[i : i + words]) for i in range(max(1, len(t.split()) - words + 1))}
    x, y = grams(a), grams(b)
    return len(x & y) / len(x | y)


def test_keep_one_removes_copies_and_leaves_the_rest(spark):
    rng = random.Random(3)
    vocab = ["".join(rng.choice("bdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(4000)]
    base = [[rng.choice(vocab) for _ in range(rng.randint(120, 400))] for _ in range(60)]
    rows, near = [], 0
    for k, words in enumerate(base):
        rows.append((k, " ".join(words), "hot"))
        for c in range(3):
            copy = list(words)
            for _ in range(c):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            rows.append((100 + 3 * k + c, " ".join(copy), "hot"))
            near += similar(rows[-1][1], rows[4 * k][1]) >= 0.8
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert set(range(60)) <= kept
    gone = sum(r[0] not in kept for r in rows)
    assert near >= 150 and gone >= 0.95 * near


def test_keep_one_edges(spark):
    assert simhash.keep_one(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(3, "a b", "s"), (1, "a b", "s"), (3, "a b", "s"), (None, "a b", "s"), (7, None, "s"), (8, "", "s"), (9, " ", "s")]
    got = simhash.keep_one(documents(spark, rows))
    assert got.columns == documents(spark, rows).columns
    assert sorted((r.doc_id for r in got.collect()), key=str) == [1, 7, None]
    hot = [(i, "the same text of a third of all rows " * 3, "hot") for i in range(900)] + [(1000 + i, f"word{i} other{i * 7}", "b") for i in range(20)]
    assert simhash.keep_one(documents(spark, hot)).count() == 21


def test_keep_one_finds_copies_among_many_texts_of_one_token(spark):
    """Half of all words are one token, so word SimHashes are all alike; each true pair is neither next by id nor with the smallest."""
    rng = random.Random(5)
    made = [" | ".join(f"w{rng.getrandbits(40)}" for _ in range(100)) for _ in range(300)]
    copies = [t.replace(t.split()[100], "changed") for t in made[100:200]]
    rows = [(i, t, "hot") for i, t in enumerate(made + copies)]
    assert all(similar(made[100 + i], t) >= 0.8 for i, t in enumerate(copies))
    assert {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()} == set(range(300))


def test_keep_one_decides_by_similarity(spark):
    """Pairs below 0.8 stay whole and pairs from 0.8 lose one, however close to it."""
    rng = random.Random(11)
    rows, want = [], set()
    for k in range(120):
        words = [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(60, 300))]
        tail = round(len(words) * rng.uniform(0.06, 0.25))
        copy = words[:-tail] + [f"w{rng.getrandbits(40)}" for _ in range(tail)]
        rows += [(2 * k, " ".join(words), "hot"), (2 * k + 1, " ".join(copy), "hot")]
        want |= {2 * k} if similar(rows[-1][1], rows[-2][1]) >= 0.8 else {2 * k, 2 * k + 1}
    assert 150 < len(want) < 230
    assert {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()} == want


def test_query_matches_brute_force(spark):
    from loomwork.llm.queries import op8_simhash

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    prints = [brute_print(t) for _, t in rows]
    want = brute_classes(rows, lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op8_simhash(spark, sf).collect()}
    assert got == {d: (f"{p:016x}", c) for (d, _), p, c in zip(rows, prints, want)}


def test_keep_one_on_a_large_group_around_a_base(spark):
    """Edits of one text at all distances from it and from each other: the exact classes, by brute force over all pairs."""
    rng = random.Random(21)
    base = [f"w{rng.getrandbits(40)}" for _ in range(120)]
    rows = []
    for i in range(500):
        words = list(base)
        for _ in range(rng.choice([0, 1, 1, 2, 2, 3, 3, 4, 5, 6, 8])):
            at = rng.randrange(len(words))
            words[at : at + 1] = rng.choice([[], [f"w{rng.getrandbits(40)}"], [words[at], f"w{rng.getrandbits(40)}"]])
        rows.append((i, " ".join(words), "hot"))
    grams = [frozenset(tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)) for _, t, _ in rows]
    want = brute_classes([(i, t) for i, t, _ in rows], lambda i, j: 9 * len(grams[i] & grams[j]) >= 4 * (len(grams[i]) + len(grams[j])))
    assert 20 < len(set(want)) < 400
    assert {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()} == set(want)


def test_recall_by_band_of_similarity(spark):
    """Pairs of generated documents in bands from 0.8: at least 0.9 of each band is found, and nothing under 0.8 goes."""
    rng = random.Random(31)
    rows, bands = [], {}
    for k in range(300):
        words = [f"w{rng.getrandbits(40)}" for _ in range(rng.randint(40, 250))]
        copy = list(words)
        for _ in range(rng.randint(0, max(1, len(words) // 25))):
            copy[rng.randrange(len(copy))] = f"w{rng.getrandbits(40)}"
        rows += [(2 * k, " ".join(words), "a"), (2 * k + 1, " ".join(copy), "a")]
        bands[k] = similar(rows[-1][1], rows[-2][1])
    kept = {r.doc_id for r in simhash.keep_one(documents(spark, rows)).collect()}
    assert all(2 * k + 1 in kept for k, j in bands.items() if j < 0.8)
    for low in (0.8, 0.85, 0.9, 0.95):
        own = [k for k, j in bands.items() if low <= j < low + 0.05 or (low == 0.95 and j == 1)]
        assert len(own) > 5 and sum(2 * k + 1 not in kept for k in own) >= 0.9 * len(own)


def test_near_copies_start_from_the_links_of_the_fingerprints(spark):
    """Without any bands the SimHashes still bring copies together, and the exact similarity decides."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**6)}" for _ in range(500)]
    prints = {i: simhash.fingerprint(" ".join([*base[:-1], f"end{i}"]).encode()) for i in range(200)}
    own = simhash.fingerprint(" ".join(base).encode())
    near = [i for i, fp in prints.items() if 0 < ((fp ^ own) & (2**64 - 1)).bit_count() <= 2][:3]
    same = [i for i, fp in prints.items() if fp == own][:2]
    rows = [(1, " ".join(base), "s"), *[(10 + i, " ".join([*base[:-1], f"end{i}"]), "s") for i in [*near, *same]]]
    rows += [(900, "a b c d e f", "s"), (901, "a b c d e f a b c d e f a b c d e g", "s"), (902, None, "s"), (903, "  ", "s")]
    nodes, edges = simhash.near_links(documents(spark, rows), bands=0)
    got = {(r.u, r.v) for r in edges.collect()}
    assert near and got >= {(1, 10 + i) for i in same} and {x for e in got for x in e} == {1, *(10 + i for i in [*near, *same])}
    assert 902 in {r.node for r in nodes.collect()}
