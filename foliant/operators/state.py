"""What a catalogue keeps beside its rows: counters, replaced metadata, a redelivering queue, claims, admission, schedules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def counted(rows: DataFrame, key: str, deltas: DataFrame, counters: dict[str, str]) -> DataFrame:
    """rows with counters moved by the summed deltas of their key: counters maps a column of rows to one of deltas. Null counters count from
    0; no counter falls below 0. Deltas without a row of their key change nothing."""
    sums = deltas.groupBy(F.col(key).alias("_key")).agg(*(F.sum(d).alias(f"_{c}") for c, d in counters.items()))
    moved = {c: F.greatest(F.coalesce(F.col(c), F.lit(0)).cast("bigint") + F.coalesce(f"_{c}", F.lit(0)), F.lit(0).cast("bigint")) for c in counters}
    return rows.join(sums, rows[key] == sums["_key"], "left").withColumns(moved).select(*rows.columns)


def counted_both(documents: DataFrame, bases: DataFrame, deltas: DataFrame, counters: dict[str, str], document: str, base: str) -> tuple[DataFrame, DataFrame]:
    """Both tables after the same deltas (document, base, …): they can't come apart, as both are made from one table."""
    return counted(documents, document, deltas, counters), counted(bases, base, deltas, counters)


def with_replaced(rows: DataFrame, key: str, column: str, new: DataFrame) -> DataFrame:
    """rows with the column replaced as a whole where new (key, column) has the key, by null too; of several the greatest counts."""
    one = new.groupBy(F.col(key).alias("_key")).agg(F.max(column).alias("_new"))
    return rows.join(one, rows[key] == one["_key"], "left").withColumn(column, F.when(F.col("_key").isNotNull(), F.col("_new")).otherwise(F.col(column))).select(*rows.columns)


def queue_states(messages: DataFrame, deliveries: DataFrame, acks: DataFrame, key: str, now: Column, patience: int) -> DataFrame:
    """(key, state): DONE once acknowledged; of the others NEW without a delivery, REDELIVER if the last delivery (column at) is ``patience``
    seconds old or more, else PENDING. Every message is delivered at least once: nothing but an acknowledgement ends it."""
    last = deliveries.groupBy(F.col(key).alias("_key")).agg(F.max("at").alias("_last"))
    done = acks.select(F.col(key).alias("_ack")).distinct()
    rows = messages.select(key).distinct()
    rows = rows.join(last, rows[key] == last["_key"], "left").join(done, rows[key] == done["_ack"], "left")
    idle = F.unix_timestamp(now) - F.unix_timestamp("_last") >= patience
    state = F.when(F.col("_ack").isNotNull(), "DONE").when(F.col("_last").isNull(), "NEW").when(idle, "REDELIVER").otherwise("PENDING")
    return rows.select(key, state.alias("state"))


def claims(jobs: DataFrame, owner: str, key: str, eligible: Column, order: list[Column]) -> DataFrame:
    """(owner, key): the first eligible job of each owner, by the order and then the key: an aggregation, no owner's queue is sorted."""
    return jobs.where(eligible).groupBy(owner).agg(F.min_by(key, F.struct(*order, F.col(key))).alias(key))


def admitted(waiting: DataFrame, running: DataFrame, group: str, order: list[Column], limit: int) -> DataFrame:
    """waiting rows that may start: in each group, first in first out, as many as the limit leaves beside those running (group, n)."""
    first = waiting.withColumn("_place", F.row_number().over(W.partitionBy(group).orderBy(*order))).where(F.col("_place") <= limit)
    busy = running.select(F.col(group).alias("_group"), "n")
    return first.join(busy, first[group] == busy["_group"], "left").where(F.col("_place") <= limit - F.coalesce("n", F.lit(0))).select(*waiting.columns)


def due(last_run: Column, now: Column, zone: str) -> Column:
    """Whether a daily run is due: none yet, or the last one was before today in the zone. Times are UTC without zone."""
    day = lambda c: F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), c.cast("timestamp_ntz")))
    return last_run.isNull() | (day(last_run) < day(now))


def queue_length(pending: Column, lag: Column) -> Column:
    """Jobs that wait: what the queue reports as its lag, but no more than are pending; an unknown lag doesn't count."""
    return F.least(pending, F.coalesce(lag, pending))
