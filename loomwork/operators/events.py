"""The canonical event log: append, filter, replay, deliver, measure, validate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fields that an event's metadata must have.
REQUIRED = ["event_id", "type", "platform", "correlation_id", "timestamp", "source", "version", "workspace_id", "actor", "trace_id", "attributes"]


def append(history: DataFrame, new: DataFrame, *, keep: int = 5000) -> DataFrame:
    """The newest ``keep`` events (by event_id) of the log with ``new``; an id that is already there isn't added."""
    both = history.unionByName(new.join(history.select("event_id"), "event_id", "left_anti"))
    return both.orderBy(F.desc("event_id")).limit(keep)


def matching(events: DataFrame, *, types: list[str] | None = None, correlation: str | None = None, predicate: Column | None = None) -> DataFrame:
    """A subscriber's events; works on a stream as well."""
    out = events
    if types is not None:
        out = out.where(F.col("type").isin(types))
    if correlation is not None:
        out = out.where(F.col("correlation_id") == correlation)
    return out if predicate is None else out.where(predicate)


def replay(events: DataFrame, since: str, until: str) -> DataFrame:
    """Events from ``since`` to ``until``, both included."""
    return events.where(F.col("ts").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


def deliver(attempts: DataFrame, *, retries: int = 3, limit: int = 500) -> tuple[DataFrame, DataFrame]:
    """(deliveries, dead letters) of attempts (event_id, attempt, ok): delivered if one of the first ``retries`` succeeded."""
    tried = attempts.where(F.col("attempt") <= retries).groupBy("event_id").agg(F.bool_or("ok").alias("delivered"), F.count("*").alias("attempts"))
    return tried.where("delivered"), tried.where("not delivered").orderBy(F.desc("event_id")).limit(limit)


def invalid(events: DataFrame, columns: list[str]) -> DataFrame:
    """(event_id, missing) of events that lack a required field."""
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in columns]))
    return events.select("event_id", F.array_join(missing, ",").alias("missing")).where("missing <> ''")


def debounce(events: DataFrame, by: str, quiet_ms: int) -> DataFrame:
    """Bursts of events with gaps of up to ``quiet_ms``: when each would trigger a refresh, and how many it joins."""
    w = Window.partitionBy(by).orderBy("ts", "event_id")
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = (at - F.lag(at).over(w)) > quiet_ms * 1000
    burst = F.sum(F.when(gap, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return events.withColumn("burst", burst).groupBy(by, "burst").agg(F.count("*").alias("events"), F.max("event_id").alias("last_event"))


def supersede(results: DataFrame, by: str, generation: str) -> DataFrame:
    """Results of the newest generation of each key; stale ones are rejected."""
    newest = results.groupBy(by).agg(F.max(generation).alias(generation))
    return results.join(newest, [by, generation], "left_semi")
