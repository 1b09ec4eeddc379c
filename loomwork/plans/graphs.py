"""Graph operators over the part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import graph as G
from loomwork.plans import bindings as B
from loomwork.plans.registry import query
from loomwork.session import cut, table

WAYS_SQL = f"{B.EDGES_SQL}, ways AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)"


def _seeds(spark, sf, m):
    return B.edges(spark, sf).where(f"src % {m} = 0").select(F.col("src").alias("id")).distinct()


@query("g1_entry_points", f"""WITH {B.EDGES_SQL} SELECT p_partkey AS path, p_name FROM part WHERE p_partkey IN (SELECT src FROM edges) AND (p_name LIKE 'small%' OR p_partkey % 11 = 0)""")
def g1(spark, sf):
    parts = table(spark, sf, "part").where(F.col("p_name").startswith("small") | (F.col("p_partkey") % 11 == 0)).select(F.col("p_partkey").alias("path"), "p_name")
    return parts.join(B.edges(spark, sf), F.col("path") == F.col("src"), "left_semi")


CYCLES = [(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6), (7, 8), (8, 9), (5, 9)]


@query("g2_cycles", f"""WITH RECURSIVE {B.EDGES_SQL}, {B.values_sql("lit", ["src", "dst"], CYCLES)}, e AS (SELECT src, dst FROM edges UNION SELECT src - 100, dst - 100 FROM lit),
r(a, b) AS (SELECT src, dst FROM e UNION SELECT r.a, e.dst FROM r JOIN e ON r.b = e.src)
SELECT x.a AS id, max(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def g2(spark, sf):
    lit = B.literal(spark, "src long, dst long", CYCLES).selectExpr("src - 100 as src", "dst - 100 as dst")
    return G.strong_components(cut(B.edges(spark, sf).select("src", "dst").union(lit)))


@query("g3_communities", f"""WITH RECURSIVE {WAYS_SQL}, r(a, b) AS (SELECT src, src FROM ways UNION SELECT r.a, dst FROM r JOIN ways ON r.b = src),
c AS (SELECT a AS id, min(b) AS component FROM r GROUP BY a)
SELECT component, count(*) AS members, (SELECT count(*) FROM edges WHERE src IN (SELECT id FROM c x WHERE x.component = c.component)) AS internal_edges FROM c GROUP BY component""")
def g3(spark, sf):
    edges = cut(B.edges(spark, sf).select("src", "dst"))
    parts = G.components(edges)
    inner = edges.join(parts.select(F.col("id").alias("src"), "component"), "src").groupBy("component").agg(F.count("*").alias("internal_edges"))
    return parts.groupBy("component").agg(F.count("*").alias("members")).join(inner, "component")


REACH_SQL = "{edges}, r(origin, id, depth) AS (SELECT DISTINCT src, src, 0 FROM edges WHERE src % {m} = 0 UNION SELECT origin, {to}, depth + 1 FROM r JOIN edges ON id = {at} WHERE depth < {d}) SELECT origin, id, min(depth) AS depth FROM r GROUP BY origin, id"


@query("g4_flow_trace", "WITH RECURSIVE " + REACH_SQL.format(edges=B.EDGES_SQL, m=5, to="dst", at="src", d=8))
def g4(spark, sf):
    return G.reach(cut(B.edges(spark, sf)), _seeds(spark, sf, 5), 8)


@query("g5_impact", "WITH RECURSIVE " + REACH_SQL.format(edges=B.EDGES_SQL, m=3, to="src", at="dst", d=6).replace("SELECT origin, id, min(depth) AS depth FROM r GROUP BY origin, id", "SELECT id, min(depth) AS depth, id % 5 = 0 AS is_test FROM r GROUP BY id"))
def g5(spark, sf):
    back = cut(B.edges(spark, sf).select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    met = G.reach(back, _seeds(spark, sf, 3), 6).groupBy("id").agg(F.min("depth").alias("depth"))
    return met.withColumn("is_test", F.col("id") % 5 == 0)


@query("g6_label_communities")
def g6(spark, sf):
    nodes = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size") > 45).alias("noisy"))
    return G.label_communities(nodes, cut(B.edges(spark, sf).withColumn("weight", F.col("weight").cast("double"))))


def _largest(spark, sf):
    """Source and target of a path query: the ends of the largest component."""
    edges = cut(B.edges(spark, sf))
    parts = cut(G.components(edges))
    top = parts.groupBy("component").agg(F.count("*").alias("n"), F.max("id").alias("last")).orderBy(F.desc("n"), "component").limit(1)
    return edges, cut(top.select(F.col("component").alias("first"), "last"))


ENDS_SQL = """reachall(a, b) AS (SELECT src, src FROM ways UNION SELECT reachall.a, dst FROM reachall JOIN ways ON reachall.b = src), comp AS (SELECT a AS id, min(b) AS component FROM reachall GROUP BY a),
ends AS (SELECT component AS first, max(id) AS last FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1)"""


@query("g7_structural_path", f"""WITH RECURSIVE {WAYS_SQL}, {ENDS_SQL}, w(id, depth) AS (SELECT first, 0 FROM ends UNION SELECT dst, depth + 1 FROM w JOIN ways ON id = src WHERE depth < 40),
d AS (SELECT id, min(depth) AS depth FROM w GROUP BY id), b(id, depth) AS (SELECT last, (SELECT depth FROM d WHERE id = last) FROM ends UNION ALL
SELECT (SELECT min(d.id) FROM d JOIN ways ON ways.src = d.id WHERE ways.dst = b.id AND d.depth = b.depth - 1), b.depth - 1 FROM b WHERE b.depth > 0)
SELECT depth AS position, id FROM b""")
def g7(spark, sf):
    edges, ends = _largest(spark, sf)
    best = G.cheapest_paths(G.both_ways(edges).withColumn("cost", F.lit(1.0)), ends.select(F.col("first").alias("id")))
    return G.walk_back(best, ends.select(F.col("last").alias("id")))


@query("q6_cheapest_path", f"""WITH RECURSIVE {WAYS_SQL}, {ENDS_SQL}, cost AS (SELECT src, dst, min(c) AS c FROM (SELECT src, dst, round(1.1 - least(0.45, weight / 10.0 * 0.45), 9)::DOUBLE AS c FROM edges UNION ALL SELECT dst, src, round(1.1 - least(0.45, weight / 10.0 * 0.45), 9)::DOUBLE FROM edges) GROUP BY 1, 2),
w(id, cost) USING KEY (id) AS (SELECT first, 0::DOUBLE FROM ends UNION (SELECT dst, min(round(w.cost + c, 9)) FROM w JOIN cost ON w.id = src LEFT JOIN recurring.w AS r ON r.id = dst WHERE r.cost IS NULL OR round(w.cost + c, 9) < r.cost GROUP BY dst))
SELECT id, round(cost, 6) AS cost FROM w""")
def q6(spark, sf):
    edges, ends = _largest(spark, sf)
    price = F.round(1.1 - F.least(F.lit(0.45), F.col("weight") / 10.0 * 0.45), 9)
    ways = edges.select("src", "dst", price.alias("cost")).union(edges.select("dst", "src", price)).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    return G.cheapest_paths(ways, ends.select(F.col("first").alias("id"))).select("id", F.round("cost", 6).alias("cost"))


@query("g8_community_neighbours", f"""WITH {B.EDGES_SQL} SELECT DISTINCT a.p_brand AS community, b.p_brand AS neighbour FROM edges JOIN part a ON a.p_partkey = src JOIN part b ON b.p_partkey = dst WHERE a.p_brand <> b.p_brand""")
def g8(spark, sf):
    part = table(spark, sf, "part")
    a, b = part.select(F.col("p_partkey").alias("src"), F.col("p_brand").alias("community")), part.select(F.col("p_partkey").alias("dst"), F.col("p_brand").alias("neighbour"))
    return B.edges(spark, sf).join(a, "src").join(b, "dst").where("community <> neighbour").select("community", "neighbour").distinct()


VIEW_SQL = f"""WITH RECURSIVE {WAYS_SQL}, r(id, depth) AS (SELECT DISTINCT src, 0 FROM edges WHERE src % 17 = 0 UNION SELECT dst, depth + 1 FROM r JOIN ways ON id = src WHERE depth < 3),
n AS (SELECT id, min(depth) AS depth FROM r GROUP BY id ORDER BY depth, id LIMIT 40)"""


@query("g9_graph_view", VIEW_SQL + " SELECT src, dst, weight FROM edges WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n)")
def g9(spark, sf):
    return G.graph_view(cut(B.edges(spark, sf)), _seeds(spark, sf, 17), 3, 40)[1].select("src", "dst", "weight")


@query("g10_cpg_view", f"""WITH RECURSIVE {B.EDGES_SQL}, k AS (SELECT *, CASE WHEN (src + dst) % 3 = 0 THEN 'cfg' WHEN (src + dst) % 3 = 1 THEN 'dfg' ELSE 'ast' END AS kind FROM edges),
b AS (SELECT src, dst, kind FROM k WHERE kind <> 'ast'), ways AS (SELECT src, dst FROM b UNION SELECT dst, src FROM b), deg AS (SELECT src AS id, count(*) AS n FROM ways GROUP BY 1), s AS (SELECT id FROM deg ORDER BY n DESC, id LIMIT 1),
r(id, depth) AS (SELECT id, 0 FROM s UNION SELECT dst, depth + 1 FROM r JOIN ways ON id = src WHERE depth < 4), n AS (SELECT id, min(depth) AS depth FROM r GROUP BY id ORDER BY depth, id LIMIT 24)
SELECT kind, min(src * 1000000 + dst) AS sample, count(*) AS edges FROM b WHERE src IN (SELECT id FROM n) AND dst IN (SELECT id FROM n) GROUP BY kind""")
def g10(spark, sf):
    m = (F.col("src") + F.col("dst")) % 3
    edges = cut(B.edges(spark, sf).withColumn("kind", F.when(m == 0, "cfg").when(m == 1, "dfg").otherwise("ast")).where("kind <> 'ast'"))
    seed = cut(G.both_ways(edges).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "id").limit(1).select("id"))
    inside = G.graph_view(edges, seed, 4, 24)[1]
    return inside.groupBy("kind").agg(F.min(F.col("src") * 1000000 + F.col("dst")).alias("sample"), F.count("*").alias("edges"))


@query("t6_default_seeds", f"WITH {B.EDGES_SQL}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY id) SELECT id, degree FROM d JOIN part ON p_partkey = id ORDER BY degree DESC, CASE p_type WHEN 'ECONOMY' THEN 0 WHEN 'STANDARD' THEN 1 ELSE 2 END, id LIMIT 5")
def t6(spark, sf):
    d = B.edges(spark, sf).select(F.explode(F.array("src", "dst")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))
    kinds = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.when(F.col("p_type") == "ECONOMY", 0).when(F.col("p_type") == "STANDARD", 1).otherwise(2).alias("k"))
    return d.join(kinds, "id").orderBy(F.desc("degree"), "k", "id").limit(5).select("id", "degree")
