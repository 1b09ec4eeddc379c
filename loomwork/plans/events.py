"""The event log over ``events``."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwork.operators import events as V
from loomwork.plans.registry import query
from loomwork.session import table


def log(spark, sf):
    return table(spark, sf, "events").select("event_id", "ts", F.col("user_id").cast("string").alias("correlation_id"), F.col("event_type").alias("type"), "value", "props")


@query("e1_append", "SELECT event_id FROM events ORDER BY event_id DESC LIMIT 500")
def e1(spark, sf):
    e = log(spark, sf)
    return V.append(e.where("event_id % 3 <> 0"), e.where("event_id % 2 = 0 or event_id % 3 = 0"), keep=500).select("event_id")


@query("e2_subscribe", "SELECT event_id FROM events WHERE event_type IN ('error', 'purchase') AND user_id = 8 AND value > 5")
def e2(spark, sf):
    return V.matching(log(spark, sf), types=["error", "purchase"], correlation="8", predicate=F.col("value") > 5).select("event_id")


@query("e3_replay", "SELECT event_id FROM events WHERE ts BETWEEN TIMESTAMP '2024-01-01 00:10:00' AND TIMESTAMP '2024-01-01 06:00:00'")
def e3(spark, sf):
    return V.replay(log(spark, sf), "2024-01-01 00:10:00", "2024-01-01 06:00:00").select("event_id")


ATTEMPTS_SQL = "a AS (SELECT event_id // 4 AS event_id, event_id % 4 + 1 AS attempt, event_type <> 'error' AND value > 20 AS ok FROM events), t AS (SELECT event_id, bool_or(ok) AS delivered, count(*) AS attempts FROM a WHERE attempt <= 3 GROUP BY 1)"


@query("e4_dead_letters", f"WITH {ATTEMPTS_SQL} SELECT event_id, attempts FROM t WHERE NOT delivered ORDER BY event_id DESC LIMIT 500")
def e4(spark, sf):
    a = table(spark, sf, "events").selectExpr("event_id div 4 as event_id", "event_id % 4 + 1 as attempt", "event_type <> 'error' and value > 20 as ok")
    return V.deliver(a)[1].select("event_id", "attempts")


@query("e4_deliveries", f"WITH {ATTEMPTS_SQL} SELECT event_id, attempts FROM t WHERE delivered")
def e4b(spark, sf):
    a = table(spark, sf, "events").selectExpr("event_id div 4 as event_id", "event_id % 4 + 1 as attempt", "event_type <> 'error' and value > 20 as ok")
    return V.deliver(a)[0].select("event_id", "attempts")


@query("e5_metadata_validation", "SELECT event_id, concat_ws(',', CASE WHEN event_type = 'error' THEN 'type' END, CASE WHEN value > 50 THEN 'value' END) AS missing FROM events WHERE event_type = 'error' OR value > 50")
def e5(spark, sf):
    e = log(spark, sf).withColumn("type", F.nullif("type", F.lit("error"))).withColumn("value", F.when(F.col("value") <= 50, F.col("value")))
    return V.invalid(e, ["type", "value"])


@query("e6_debounce", """WITH g AS (SELECT user_id, event_id, ts, CASE WHEN epoch_us(ts) - epoch_us(lag(ts) OVER w) > 2000000000 THEN 1 ELSE 0 END AS gap FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)), b AS (SELECT *, sum(gap) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS burst FROM g)
SELECT user_id, count(*) AS events, max(event_id) AS last_event FROM b GROUP BY user_id, burst""")
def e6(spark, sf):
    e = table(spark, sf, "events").select("event_id", "ts", "user_id")
    return V.debounce(e, "user_id", 2_000_000).drop("burst")


@query("e7_supersede", "SELECT event_id, user_id FROM events WHERE (user_id, event_id // 100) IN (SELECT user_id, max(event_id // 100) FROM events GROUP BY 1)")
def e7(spark, sf):
    e = table(spark, sf, "events").selectExpr("event_id", "user_id", "event_id div 100 as generation")
    return V.supersede(e, "user_id", "generation").select("event_id", "user_id")
