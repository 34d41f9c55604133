"""Queries over the change feed as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.plans.registry import Registry
from foliant.sources.tables import load
from foliant.streaming import changes as E

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql


def _stream(s: SparkSession, d: str, table: str) -> DataFrame:
    """The table's files as a stream, in the schema that the batch reader finds."""
    return s.readStream.schema(load(s, d, table).schema).parquet(f"{d}/{table}*.parquet")


@query("""WITH f AS (SELECT change_no, source_id, path, epoch * 1000000 + generation AS o FROM pending),
  m AS (SELECT *, coalesce(max(o) OVER (PARTITION BY source_id, path ORDER BY change_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS newest FROM f)
  SELECT change_no, CASE WHEN o > newest THEN 'APPLIED' WHEN o = newest THEN 'REPLAY' ELSE 'IGNORED_STALE' END AS outcome FROM m""")
def e3_stale_observations(s: SparkSession, d: str) -> DataFrame:
    rows = _stream(s, d, "pending").select("change_no", "source_id", "path", "epoch", "generation")
    return E.run_available(E.observations(rows, ["source_id", "path"], "change_no")).select("change_no", "outcome")


@query("""WITH f AS (SELECT change_no, source_id, path, fingerprint, epoch_us(received_at) / 1e6 AS t FROM pending WHERE fingerprint IS NOT NULL),
  r AS (SELECT *, CASE WHEN lag(fingerprint) OVER w IS NOT DISTINCT FROM fingerprint THEN 0 ELSE 1 END AS s FROM f WINDOW w AS (PARTITION BY source_id, path ORDER BY change_no)),
  g AS (SELECT *, sum(s) OVER (PARTITION BY source_id, path ORDER BY change_no) AS run FROM r)
  SELECT change_no, CASE WHEN s = 0 AND t - first_value(t) OVER (PARTITION BY source_id, path, run ORDER BY change_no) >= 10 THEN 'STABLE' ELSE 'WAITING' END AS outcome FROM g""")
def e4_debounce(s: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.to_timestamp_ltz(F.col("received_at").cast("string"))) / 1e6
    rows = _stream(s, d, "pending").where("fingerprint is not null").select("change_no", "source_id", "path", "fingerprint", seconds.alias("seconds"))
    return E.run_available(E.debounced(rows, ["source_id", "path"], "change_no")).select("change_no", "outcome")


@query("""SELECT change_no FROM pending QUALIFY row_number() OVER (PARTITION BY source_id, epoch, generation ORDER BY change_no) = 1""")
def e6_first_observation(s: SparkSession, d: str) -> DataFrame:
    """The batch form of repeated-observation removal."""
    return load(s, d, "pending").groupBy("source_id", "epoch", "generation").agg(F.min("change_no").alias("change_no")).select("change_no")


@query("""SELECT DISTINCT w.source_id, w.path, w.change_no FROM (SELECT source_id, path, change_no, lower(trim(kind)) AS kind, epoch, generation FROM pending) w WHERE kind IN ('create', 'upsert', 'move') AND NOT EXISTS (
  SELECT 1 FROM pending t WHERE lower(trim(t.kind)) = 'delete' AND t.source_id = w.source_id AND (t.path = w.path OR starts_with(w.path, t.path || '/')) AND (t.epoch > w.epoch OR (t.epoch = w.epoch AND t.generation >= w.generation)))""")
def e5_tombstone_fence(s: SparkSession, d: str) -> DataFrame:
    """Writes that no tombstone of the same path or of a folder above it fences off, wherever it came in the feed; a change once, however often it came."""
    rows = load(s, d, "pending").withColumn("kind", F.lower(F.trim("kind")))
    fence = rows.where("kind = 'delete'").groupBy("source_id", F.col("path").alias("prefix")).agg(F.max(F.struct("epoch", "generation")).alias("fence"))
    writes = rows.where("kind in ('create', 'upsert', 'move')").select("source_id", "path", "change_no", F.struct("epoch", "generation").alias("at"))
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    met = writes.withColumn("prefix", F.explode_outer(above)).join(fence, ["source_id", "prefix"], "left")
    return met.groupBy("source_id", "path", "change_no").agg(F.max(F.coalesce(F.col("fence") >= F.col("at"), F.lit(False))).alias("gone")).where("not gone").select("source_id", "path", "change_no")


@query("""WITH m AS (SELECT change_no, source_id, old_path, path FROM pending WHERE lower(trim(kind)) = 'move' AND old_path IS NOT NULL AND old_path <> ''), k AS (SELECT DISTINCT source_id, path FROM pending WHERE lower(trim(kind)) IN ('create', 'upsert'))
  SELECT change_no, CASE WHEN EXISTS (SELECT 1 FROM k WHERE k.source_id = m.source_id AND k.path = m.old_path) THEN 'MOVED' ELSE 'DEFERRED' END AS outcome FROM m""")
def e8_moves(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "pending").withColumn("kind", F.lower(F.trim("kind")))
    known = rows.where("kind in ('create', 'upsert')").select("source_id", F.col("path").alias("old_path"), F.lit(True).alias("known")).distinct()
    moves = rows.where("kind = 'move' and old_path is not null and old_path <> ''").join(known, ["source_id", "old_path"], "left")
    return moves.select("change_no", F.when(F.col("known"), "MOVED").otherwise("DEFERRED").alias("outcome"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def extra_window_counts(s: SparkSession, d: str) -> DataFrame:
    """Event-time windows, an extra: the reference has none."""
    return load(s, d, "events").groupBy(F.window("ts", "1 day"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("day"), "event_type", "n")

