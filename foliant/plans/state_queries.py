"""Queries of logs, leases, pointers, counters, queues, claims, admission and schedules."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators import state as S
from foliant.operators.ranking import row_numbers
from foliant.plans.registry import Registry
from foliant.plans.relational_queries import FILES, LATEST_CHUNKS, chunks_now, files
from foliant.sources.tables import load
from foliant.streaming import changes as E

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql


def _log(s: SparkSession, d: str) -> DataFrame:
    """Events as an ordered log of each user: numbered, some sent twice, some sent again with another payload, some lost."""
    rows = row_numbers(load(s, d, "events").select("user_id", "event_id", "event_type"), ["user_id"], [F.col("event_id")], "sequence")
    kinds = F.filter(F.array(F.lit(0), F.when(F.col("event_id") % 7 == 0, 1), F.when(F.col("event_id") % 11 == 0, 2)), lambda x: x.isNotNull())
    sent = rows.where("event_id % 997 <> 0").withColumn("sent", F.explode(kinds))
    digest = F.concat("event_type", F.when(F.col("sent") == 2, "!").otherwise(""))
    return sent.select(F.col("user_id").cast("string").alias("source_id"), F.lit(1).cast("bigint").alias("epoch"), F.col("sequence").cast("bigint").alias("sequence"), F.concat(F.lit("r"), "event_id").alias("request_id"), digest.alias("digest"), (F.col("event_id") * 3 + F.col("sent")).alias("arrival"))


@query("""WITH n AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS sequence FROM events), lost AS (SELECT user_id, min(sequence) AS first FROM n WHERE event_id % 997 = 0 GROUP BY 1),
  sent AS (SELECT user_id, event_id, sequence, unnest(list_filter([0, CASE WHEN event_id % 7 = 0 THEN 1 END, CASE WHEN event_id % 11 = 0 THEN 2 END], lambda x: x IS NOT NULL)) AS sent FROM n WHERE event_id % 997 <> 0)
  SELECT CAST(user_id AS VARCHAR) AS source_id, sequence, event_id * 3 + sent AS arrival, CASE WHEN sequence > first THEN 'GAP' WHEN sent = 0 THEN 'OK' WHEN sent = 1 THEN 'REPLAY' ELSE 'CONFLICT' END AS outcome FROM sent LEFT JOIN lost USING (user_id)""")
def e1_ordered_log(s: SparkSession, d: str) -> DataFrame:
    return E.run_available(E.ordered_log(E.as_stream(_log(s, d)))).select("source_id", "sequence", "arrival", "outcome")


@query("""WITH RECURSIVE r AS (SELECT source_id, change_no, worker_id, epoch_us(received_at) / 1e6 AS t, row_number() OVER (PARTITION BY source_id ORDER BY received_at, change_no) AS i FROM pending WHERE worker_id IS NOT NULL AND received_at IS NOT NULL),
  s AS (SELECT source_id, i, change_no, worker_id, t + 300 AS ends, 'GRANTED' AS outcome FROM r WHERE i = 1
    UNION ALL SELECT r.source_id, r.i, r.change_no, CASE WHEN r.t < s.ends THEN s.worker_id ELSE r.worker_id END, CASE WHEN r.t < s.ends THEN s.ends ELSE r.t + 300 END,
      CASE WHEN r.t >= s.ends THEN 'GRANTED' WHEN r.worker_id = s.worker_id THEN 'HELD' ELSE 'BUSY' END FROM s JOIN r ON r.source_id = s.source_id AND r.i = s.i + 1) SELECT source_id, change_no, outcome FROM s""")
def e2_leases(s: SparkSession, d: str) -> DataFrame:
    seconds = F.unix_micros(F.to_timestamp_ltz(F.col("received_at").cast("string"))) / 1e6
    rows = load(s, d, "pending").where("worker_id is not null and received_at is not null").select("source_id", "change_no", "worker_id", seconds.alias("seconds"))
    return E.run_available(E.leases(E.as_stream(rows), "source_id", "change_no")).select("source_id", "change_no", "outcome")


@query("""WITH RECURSIVE r AS (SELECT o_custkey, o_orderkey, o_orderkey % 5 AS expected, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders),
  s AS (SELECT o_custkey, i, o_orderkey, expected = 0 AS ok, CASE WHEN expected = 0 THEN 1 ELSE 0 END AS version FROM r WHERE i = 1
    UNION ALL SELECT r.o_custkey, r.i, r.o_orderkey, r.expected = s.version, s.version + CASE WHEN r.expected = s.version THEN 1 ELSE 0 END FROM s JOIN r ON r.o_custkey = s.o_custkey AND r.i = s.i + 1)
  SELECT o_custkey, o_orderkey, CASE WHEN ok THEN 'APPLIED' ELSE 'REJECTED' END AS outcome FROM s""")
def d4_compare_and_set(s: SparkSession, d: str) -> DataFrame:
    """Orders as writers of their customer's pointer, each with the version it has seen."""
    rows = load(s, d, "orders").select("o_custkey", "o_orderkey", (F.col("o_orderkey") % 5).alias("expected"))
    return E.run_available(E.pointers(E.as_stream(rows), "o_custkey", "o_orderkey")).select("o_custkey", "o_orderkey", "outcome")


@query(f"""WITH x AS (SELECT doc_id, kb_id, count(*) AS c, sum(coalesce(length(content), 0)) AS t FROM {LATEST_CHUNKS} GROUP BY 1, 2), f AS (SELECT id, max(chunk_num) AS chunk_num, max(token_num) AS token_num FROM source_documents GROUP BY 1)
  SELECT 'document' AS kind, f.id, coalesce(chunk_num, 0) + coalesce(c, 0) AS chunks, coalesce(token_num, 0) + coalesce(t, 0) AS tokens FROM f LEFT JOIN (SELECT doc_id, sum(c) AS c, sum(t) AS t FROM x GROUP BY 1) y ON y.doc_id = f.id
  UNION ALL SELECT 'base', k.id, coalesce(c, 0), coalesce(t, 0) FROM (SELECT DISTINCT id FROM knowledgebases) k LEFT JOIN (SELECT kb_id, sum(c) AS c, sum(t) AS t FROM x GROUP BY 1) y ON y.kb_id = k.id""")
def d3_counters(s: SparkSession, d: str) -> DataFrame:
    """New chunks counted on their file and on their base, from one table of deltas."""
    deltas = chunks_now(s, d, "chunk_id", "doc_id", "kb_id", "content").select(F.col("doc_id").alias("document"), F.col("kb_id").alias("base"), F.lit(1).alias("c"), F.coalesce(F.length("content"), F.lit(0)).alias("t"))
    documents = load(s, d, "source_documents").groupBy(F.col("id").alias("document")).agg(F.max("chunk_num").alias("chunks"), F.max("token_num").alias("tokens"))
    bases = load(s, d, "knowledgebases").select(F.col("id").alias("base"), F.lit(0).alias("chunks"), F.lit(0).alias("tokens")).distinct()
    one, two = S.counted_both(documents, bases, deltas, {"chunks": "c", "tokens": "t"}, "document", "base")
    named = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), F.col(kind).alias("id"), "chunks", "tokens")
    return named(one, "document").unionByName(named(two, "base"))


@query(f"""SELECT chunk_id, CASE WHEN doc_id IN (SELECT id FROM {FILES} WHERE lower(trim(suffix, ' .')) = 'pdf') THEN '{{"kind":"paper"}}' ELSE metadata END AS metadata FROM {LATEST_CHUNKS}""")
def d5_replace_metadata(s: SparkSession, d: str) -> DataFrame:
    rows = chunks_now(s, d, "chunk_id", "doc_id", "metadata")
    paper = files(s, d).where(F.lower(F.trim("suffix", F.lit(" ."))) == "pdf").select(F.col("id").alias("doc_id"), F.lit('{"kind":"paper"}').alias("metadata"))
    return S.with_replaced(rows, "doc_id", "metadata", paper).select("chunk_id", "metadata")


_NOW = "2024-06-01 00:00:00"


@query(f"""WITH m AS (SELECT DISTINCT change_no FROM pending), dl AS (SELECT change_no, max(received_at) AS last FROM pending WHERE stable_count > 0 GROUP BY 1), a AS (SELECT DISTINCT change_no FROM pending WHERE fingerprint IS NOT NULL)
  SELECT m.change_no, CASE WHEN a.change_no IS NOT NULL THEN 'DONE' WHEN last IS NULL THEN 'NEW' WHEN epoch(TIMESTAMP '{_NOW}') - floor(epoch(last)) >= 86400 THEN 'REDELIVER' ELSE 'PENDING' END AS state FROM m LEFT JOIN dl USING (change_no) LEFT JOIN a ON a.change_no = m.change_no""")
def e9_queue(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "pending")
    return S.queue_states(rows, rows.where("stable_count > 0").select("change_no", F.col("received_at").cast("timestamp").alias("at")), rows.where("fingerprint is not null"), "change_no", F.to_timestamp(F.lit(_NOW)), 86_400)


@query(f"""SELECT source_id, arg_min(change_no, (due_at, change_no)) AS change_no FROM pending WHERE lower(trim(kind)) IN ('create', 'upsert', 'move') AND due_at <= TIMESTAMP '{_NOW}' AND source_id IN (SELECT id FROM sync_sources WHERE enabled) GROUP BY 1""")
def e10_claims(s: SparkSession, d: str) -> DataFrame:
    jobs = load(s, d, "pending").join(load(s, d, "sync_sources").where("enabled").select(F.col("id").alias("source_id")), "source_id", "left_semi")
    ready = F.lower(F.trim("kind")).isin("create", "upsert", "move") & (F.col("due_at") <= F.to_timestamp_ntz(F.lit(_NOW)))
    return S.claims(jobs, "source_id", "change_no", ready, [F.col("due_at")])


@query("""WITH l AS (SELECT source_id, max(changed_at) AS last FROM pending GROUP BY 1), n AS (SELECT max(changed_at) AS now FROM pending) SELECT x.id, last IS NULL OR CAST(last + INTERVAL 9 HOUR AS DATE) < CAST(now + INTERVAL 9 HOUR AS DATE) AS due FROM (SELECT DISTINCT id FROM sync_sources) x LEFT JOIN l ON l.source_id = x.id, n""")
def e11_due(s: SparkSession, d: str) -> DataFrame:
    """Sources whose last change was before the last day of the feed, in Korean time."""
    rows = load(s, d, "pending")
    last, now = rows.groupBy("source_id").agg(F.max("changed_at").alias("last")), rows.agg(F.max("changed_at").alias("now"))  # now: one row
    sources = load(s, d, "sync_sources").select("id").distinct()
    return sources.join(last, sources["id"] == last["source_id"], "left").crossJoin(F.broadcast(now)).select("id", S.due(F.col("last"), F.col("now"), "Asia/Seoul").alias("due"))


@query("""WITH b AS (SELECT source_id, count(*) AS n FROM pending WHERE initial_registration GROUP BY 1) SELECT change_no, p.source_id FROM (SELECT DISTINCT change_no, source_id, due_at FROM pending WHERE NOT coalesce(initial_registration, false)) p LEFT JOIN b ON b.source_id = p.source_id
  QUALIFY row_number() OVER (PARTITION BY p.source_id ORDER BY due_at, change_no) <= 60 - coalesce(n, 0)""")
def t10_admission(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "pending")
    waiting = rows.where("not coalesce(initial_registration, false)").select("change_no", "source_id", "due_at").distinct()
    running = rows.where("initial_registration").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    return S.admitted(waiting, running, "source_id", [F.col("due_at"), F.col("change_no")], 60).select("change_no", "source_id")


@query("""WITH f AS (SELECT id, kb_id, max(progress) AS progress FROM source_documents GROUP BY ALL), p AS (SELECT k.permission, count(*) AS pending FROM f JOIN knowledgebases k ON k.id = f.kb_id WHERE progress >= 0 AND progress < 1 GROUP BY 1), l AS (SELECT permission, count(*) * 3 AS lag FROM knowledgebases WHERE permission = 'team' GROUP BY 1)
  SELECT p.permission, pending, least(pending, coalesce(lag, pending)) AS queued FROM p LEFT JOIN l USING (permission)""")
def a23_queue_length(s: SparkSession, d: str) -> DataFrame:
    """Unfinished files by the permission of their base; the lag of one queue is known."""
    bases = load(s, d, "knowledgebases")
    f = load(s, d, "source_documents").groupBy("id", "kb_id").agg(F.max("progress").alias("progress")).where("progress >= 0 and progress < 1")
    pending = f.join(bases.select(F.col("id").alias("kb_id"), "permission"), "kb_id").groupBy("permission").agg(F.count(F.lit(1)).alias("pending"))
    lag = bases.where("permission = 'team'").groupBy("permission").agg((F.count(F.lit(1)) * 3).alias("lag"))
    return pending.join(lag, "permission", "left").select("permission", "pending", S.queue_length(F.col("pending"), F.col("lag")).alias("queued"))


@query(f"""SELECT chunk_id, row_number() OVER (ORDER BY chunk_order NULLS LAST, coalesce(page_num[1], 0), coalesce(top[1], 0), created DESC, chunk_id) AS place FROM {LATEST_CHUNKS} QUALIFY place <= 300""")
def t2_browse_order(s: SparkSession, d: str) -> DataFrame:
    """The first 300 chunks as they are browsed: by their order, page and height, the newest first."""
    first = lambda c: F.coalesce(F.get(c, F.lit(0)), F.lit(0))
    rows = chunks_now(s, d, "chunk_id", "chunk_order", "page_num", "top", "created").select("chunk_id", "chunk_order", first("page_num").alias("page"), first("top").alias("t"), "created")
    order = [F.asc_nulls_last("chunk_order"), F.col("page"), F.col("t"), F.desc("created"), F.col("chunk_id")]
    return row_numbers(rows.orderBy(*order).limit(300).withColumn("one", F.lit(1)), ["one"], order, "place").select("chunk_id", "place")
