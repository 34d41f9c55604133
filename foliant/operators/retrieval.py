"""Batch retrieval: a table of queries against a corpus, as joins, aggregations and windows.

Postings are (key, term, tf). A query batch is a table (query, term, weight); its terms are joined with the postings they
occur in, so the work follows the postings of the asked terms, and ranks come from a window whose limit Spark pushes into
the partial sort. Corpus statistics are one aggregation each.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators.ranking import TopK
from foliant.session import cut

K1, B = 1.2, 0.75
#: Bytes of query vectors, and terms of queries, that one task may hold at once; more queries go in blocks of that size, and each
#: block is one more pass over the corpus: a batch of queries is meant to be small against the corpus.
BLOCK_BYTES, BLOCK_TERMS = 64 << 20, 500_000
#: Matches of texts and queries that are added up at once.
MATCHES_AT_ONCE = 4_000_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in reading order; empty for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def postings(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term, tf)"""
    words = df.select(F.col(key).alias("key"), F.explode(tokens(F.col(text))).alias("term"))
    return words.groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))


def query_terms(df: DataFrame, query: str, text: str) -> DataFrame:
    """(query, term): the distinct terms of each query."""
    return df.select(F.col(query).alias("query"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))


def idf(n: Column, df_: Column) -> Column:
    return F.log(1 + (n - df_ + 0.5) / (df_ + 0.5))


def bm25(corpus: DataFrame, key: str, text: str, queries: DataFrame, boost: float = 1.0) -> DataFrame:
    """(query, key, score, matched): BM25 with Lucene's idf; ``queries`` is (query, term)."""
    asked = queries.select("term").distinct()
    worded = corpus.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w"), *([F.col(vector).cast("array<double>").alias("v")] if vector else [])).withColumn("dl", F.size("w"))
    if phrases:
        pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
        worded = worded.withColumn("w", F.concat("w", pairs))
    stats = worded.select("dl").where("dl > 0").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))
    # only occurrences of asked terms are counted and shuffled; a text's length goes along with them
    found = worded.select("key", F.size("w").alias("dl"), F.explode("w").alias("term")).join(asked, "term", "left_semi")
    wanted = found.groupBy("key", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    freq = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    scored = wanted.join(freq, "term").crossJoin(F.broadcast(stats))
    part = boost * idf(F.col("n"), F.col("df")) * F.col("tf") / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.select("key", "term", part.alias("part")).join(queries, "term").groupBy("query", "key").agg(F.sum("part").alias("score"), F.count(F.lit(1)).alias("matched"))


def scripted(corpus: DataFrame, key: str, text: str, queries: DataFrame, boost: float = 1.0) -> DataFrame:
    """(query, key, score): each term once, its idf over the idf of a term in one document; no length norm."""
    once = corpus.select(F.col(key).alias("key"), F.explode(F.array_distinct(tokens(F.col(text)))).alias("term"))
    n = corpus.where(F.size(tokens(F.col(text))) > 0).agg(F.count(F.lit(1)).alias("n"))
    wanted = once.join(queries.select("term").distinct(), "term", "left_semi")
    freq = wanted.groupBy("term").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(n))
    ratio = boost * idf(F.col("n"), F.col("df")) / F.log(1 + (F.col("n") - 0.5) / 1.5)
    return wanted.join(freq.select("term", ratio.alias("part")), "term").join(queries, "term").groupBy("query", "key").agg(F.sum("part").alias("score"))


def should_match(hits: DataFrame, queries: DataFrame, share: float) -> DataFrame:
    """Hits with at least max(1, floor(share * terms of the query)) matched terms."""
    n = queries.groupBy("query").agg(F.count(F.lit(1)).alias("n_terms"))
    return hits.join(n, "query").where(F.col("matched") >= F.greatest(F.lit(1), F.floor(F.lit(share) * F.col("n_terms")))).drop("n_terms")


def dis_max(*lanes: DataFrame) -> DataFrame:
    """(query, key, score): the best score of any lane."""
    every = lanes[0].select("query", "key", "score")
    for lane in lanes[1:]:
        every = every.unionByName(lane.select("query", "key", "score"))
    return every.groupBy("query", "key").agg(F.max("score").alias("score"))


def top(hits: DataFrame, k: int, digits: int = 6) -> DataFrame:
    """(query, key, score, place): the k best of each query by rounded score, then key."""
    w = W.partitionBy("query").orderBy(F.desc("score"), "key")
    return hits.withColumn("score", F.round("score", digits)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k).select("query", "key", "score", "place")


def _directions(vectors: dict, names) -> np.ndarray:
    """A row of unit length for each name; zeros for what has no vector or none of any length."""
    width = max((len(v) for v in vectors.values() if v is not None), default=0)
    out = np.zeros((len(names), width))
    for i, name in enumerate(names):
        v = vectors.get(name)
        if v is not None and len(v) == width:
            out[i] = v
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def lexical_top(corpus: DataFrame, key: str, text: str, queries: DataFrame, k: int, model: str = "bm25", least: float | None = None, whole: float | None = None, keep_self: bool = True, phrases: bool = False, vector: str | None = None, query_vectors: DataFrame | None = None, vector_weight: float = 0.0) -> DataFrame:
    """(query, key, score, place): the k best texts of each query, scored while the corpus is read.

    queries is (query, term) or (query, term, weight). A first pass counts in how many texts the asked terms are; then each task adds
    up the scores of its own texts against a block of queries and hands on its k best, so what is shuffled follows the
    queries and not the matches. model: bm25, or scripted (each term once, its idf over that of a term in one text). With ``least``,
    texts need max(1, floor(least * terms)) of a query's terms; with ``whole``, texts with all of them count so many times. With ``phrases``, a term of two
    words is found where they stand side by side. With ``vector`` (a column of the corpus) and query_vectors (query, v), the score of a text
    that matches is (1 - vector_weight) of it and vector_weight of (1 + cosine) / 2, 0 where either has no vector."""
    weight = F.col("weight").cast("double") if "weight" in queries.columns else F.lit(1.0)
    asked = queries.select("query", "term", weight.alias("weight"))
    worded = corpus.select(F.col(key).alias("key"), tokens(F.col(text)).alias("w"), *([F.col(vector).cast("array<double>").alias("v")] if vector else [])).withColumn("dl", F.size("w"))
    if phrases:
        pairs = F.when(F.size("w") > 1, F.zip_with(F.slice("w", F.lit(1), F.size("w") - 1), F.slice("w", F.lit(2), F.size("w") - 1), lambda x, y: F.concat(x, F.lit(" "), y))).otherwise(F.array().cast("array<string>"))
        worded = worded.withColumn("w", F.concat("w", pairs))
    # texts are read once for both: each gives its distinct terms, and one row without a term for its length
    size = F.col("dl").cast("bigint")
    own = F.concat(F.transform(F.array_distinct("w"), lambda t: F.struct(t.alias("term"), F.lit(0).cast("bigint").alias("dl"))), F.array(F.struct(F.lit(None).cast("string").alias("term"), size.alias("dl"))))
    wanted = asked.select("term").distinct().withColumn("_asked", F.lit(True))
    met = worded.select(F.inline(own)).join(wanted, "term", "left").where("_asked or term is null")
    counted = cut(met.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("dl").alias("words"), F.count_if(F.col("dl") > 0).alias("texts")))
    stats = counted.where("term is null").first()
    n = stats["texts"] if stats else 0
    avgdl = stats["words"] / n if n else 1.0
    freq = counted.where("term is not null").select("term", "df")
    part = F.col("weight") * idf(F.lit(n), F.col("df"))
    if model == "scripted":
        part = part / math.log(1 + max(n - 0.5, 0.5) / 1.5)
    terms = asked.groupBy("query").agg(F.count(F.lit(1)).alias("terms"))
    weighed = cut(asked.join(freq, "term").join(terms, "query").select("query", "term", part.alias("part"), "terms"))
    blocks = max(1, -(-weighed.count() // BLOCK_TERMS))
    kinds = {"query": queries.schema["query"].dataType.simpleString(), "key": corpus.schema[key].dataType.simpleString()}
    out: DataFrame | None = None
    for b in range(blocks):
        block = weighed.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).toPandas()
        words, word_of = np.unique(block["term"].to_numpy(object), return_inverse=True)
        names, query_of = np.unique(block["query"].to_numpy(), return_inverse=True)
        order = np.argsort(word_of, kind="stable")
        n_terms = np.zeros(len(names), np.int64)
        n_terms[query_of] = block["terms"]
        starts = np.searchsorted(word_of[order], np.arange(len(words) + 1))
        directions = None
        if vector:
            given = query_vectors.where(F.pmod(F.xxhash64("query"), F.lit(blocks)) == b).where("v is not null").toPandas()
            directions = _directions({q: v for q, v in zip(given["query"], given["v"], strict=True)}, list(names))
        sent = corpus.sparkSession.sparkContext.broadcast((words, starts, query_of[order], block["part"].to_numpy(np.float64)[order], names, n_terms, directions))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            words, starts, query_of, part, names, n_terms, directions = sent.value
            known, best = pa.array(words, pa.string()), TopK(len(names), k)
            for batch in batches:
                keys = batch.column("key").to_numpy(zero_copy_only=False)
                length, dl = pc.list_value_length(batch.column("w")).to_numpy(zero_copy_only=False).astype(np.int64), batch.column("dl").to_numpy(zero_copy_only=False)
                term = pc.fill_null(pc.index_in(batch.column("w").flatten(), value_set=known), -1).to_numpy(zero_copy_only=False).astype(np.int64)
                text_of = np.repeat(np.arange(len(keys)), length)[term >= 0]
                pair, tf = np.unique(text_of * len(words) + term[term >= 0], return_counts=True)
                text_of, term = pair // max(len(words), 1), pair % max(len(words), 1)
                share = tf / (tf + K1 * (1 - B + B * dl[text_of] / avgdl)) if model == "bm25" else np.ones(len(tf))
                wide = starts[term + 1] - starts[term]
                ends = np.cumsum(wide)
                texts = None if directions is None else _directions(dict(enumerate(batch.column("v").to_pylist())), range(len(keys)))
                lo = 0
                while lo < len(pair):  # whole texts, so many that their matches fit
                    hi = int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MATCHES_AT_ONCE, "right"))
                    hi = int(np.searchsorted(text_of, text_of[max(hi, lo + 1) - 1], "right"))
                    reps = wide[lo:hi]
                    at = np.arange(reps.sum()) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(starts[term[lo:hi]], reps)
                    hit, back = np.unique(np.repeat(text_of[lo:hi], reps) * len(names) + query_of[at], return_inverse=True)
                    score = np.bincount(back, weights=part[at] * np.repeat(share[lo:hi], reps), minlength=len(hit))
                    matched, q = np.bincount(back, minlength=len(hit)), hit % len(names)
                    if whole is not None:
                        score = np.where(matched >= n_terms[q], np.maximum(score, whole * score), score)
                    if directions is not None:
                        own = texts[hit // len(names)]
                        cos = (own * directions[q]).sum(axis=1) if own.shape[1] == directions.shape[1] else np.zeros(len(hit))
                        near = np.where(own.any(axis=1) & directions[q].any(axis=1), (1 + cos) / 2, 0.0) if own.shape[1] else np.zeros(len(hit))
                        score = (1 - vector_weight) * score + vector_weight * near
                    ok = np.ones(len(hit), bool) if least is None else matched >= np.maximum(1, np.floor(least * n_terms[q] + 1e-9))
                    if not keep_self:
                        ok &= names[q] != keys[hit // len(names)]
                    best.add(q[ok], keys[hit[ok] // len(names)], np.round(score[ok], 6))
                    lo = hi
            q, found, score = best.rows()
            yield pa.RecordBatch.from_pydict({"query": pa.array(names[q]), "key": pa.array(found), "score": pa.array(score, pa.float64())}) if len(q) else pa.RecordBatch.from_arrays([pa.array([], pa.null())] * 3, names=["query", "key", "score"])

        scored = worded.mapInArrow(run, f"query {kinds['query']}, key {kinds['key']}, score double") if len(block) else None
        out = scored if out is None else out if scored is None else out.unionByName(scored)
    if out is None:
        out = worded.limit(0).select(F.lit(None).cast(kinds["query"]).alias("query"), "key", F.lit(0.0).alias("score"))
    return top(out, k)


def knn(corpus: DataFrame, key: str, vector: str, queries: DataFrame, query: str, k: int, least: float | None = -1.0, keep_self: bool = True, metric: str = "cosine") -> DataFrame:
    """(query, key, score, place): exact nearest neighbours by cosine, or by the inner product with metric "dot".

    The corpus streams through blocks of queries as matrix products; every task keeps its own k best of each query, and
    a window over these partial lists gives the final k. Queries come in blocks of at most BLOCK_BYTES, each block a
    broadcast of that size and a pass over the corpus. Nulls have no neighbours, nor have vectors without length by cosine.
    """
    valid = queries.select(F.col(query).cast("long").alias("q"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")
    width = (valid.select(F.max(F.size("v")).alias("n")).first()["n"] or 1) * 8
    count = valid.count()
    blocks = max(1, -(-count * width // BLOCK_BYTES))
    spark = corpus.sparkSession
    rows = corpus.select(F.col(key).cast("long").alias("key"), F.col(vector).cast("array<double>").alias("v")).where("v is not null")

    def scaled(m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Vectors as they are compared, and which of them are."""
        if metric == "dot":
            return m, np.ones(len(m), bool)
        length = np.linalg.norm(m, axis=1)
        return np.divide(m, length[:, None], out=np.zeros_like(m), where=length[:, None] > 0), length > 0

    out: DataFrame | None = None
    for b in range(blocks):
        block = valid.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b).toPandas()
        if not len(block):
            continue
        sent = spark.sparkContext.broadcast((block["q"].to_numpy(), np.stack(block["v"].to_numpy())))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            q, asked = scaled(q)
            best = TopK(len(ids), k)
            for whole in batches:
                for lo in range(0, whole.num_rows, at_once := max(1, MATCHES_AT_ONCE // len(ids))):
                    batch = whole.slice(lo, at_once)
                    keys = batch.column("key").to_numpy()
                    m, usable = scaled(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(len(keys), -1))
                    score = np.round(q @ m.T, 6)
                    ok = asked[:, None] & usable & (score >= best.least[:, None])
                    if least is not None:
                        ok &= score > max(least, -1.0) - 1e-12
                    if not keep_self:
                        ok &= ids[:, None] != keys[None, :]
                    x, y = np.nonzero(ok)
                    best.add(x, keys[y], score[x, y])
            x, found, score = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(found), pa.array(score)], names=["query", "key", "score"])

        part = rows.mapInArrow(run, "query bigint, key bigint, score double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = rows.limit(0).select(F.col("key").alias("query"), "key", F.lit(0.0).alias("score"))
    return top(out, k)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays inside the JVM; null where a length is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def rrf(lanes: dict[str, DataFrame], k: int = 60, depth: int = 128) -> DataFrame:
    """(query, key, rrf, lanes): reciprocal ranks of lanes (query, key, place), each to its depth, summed."""
    every: DataFrame | None = None
    for name, lane in lanes.items():
        part = lane.where(F.col("place") <= depth).select("query", "key", (1 / (F.lit(k) + F.col("place"))).alias("part"), F.lit(name).alias("lane"))
        every = part if every is None else every.unionByName(part)
    return every.groupBy("query", "key").agg(F.sum("part").alias("rrf"), F.sort_array(F.collect_set("lane")).alias("lanes"))


def cap_and_refill(fused: DataFrame, document: str, cap: int = 8, total: int = 128) -> DataFrame:
    """(… place): at most ``cap`` keys of a document in fused order, then what was left out up to ``total``."""
    within = W.partitionBy("query", document).orderBy(F.desc("rrf"), "key")
    capped = fused.withColumn("_rn", F.row_number().over(within))
    filled = W.partitionBy("query").orderBy(F.col("_rn") > cap, F.desc("rrf"), "key")
    kept = capped.withColumn("_at", F.row_number().over(filled)).where(F.col("_at") <= total)
    return kept.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.desc("rrf"), "key"))).drop("_rn", "_at")


def groups(scored: DataFrame, document: str, content: str, least: float = 0.25, low: float = 0.5, documents: int = 32, evidence: int = 5, asked: DataFrame | None = None) -> DataFrame:
    """(query, document, key, score, document_place, evidence_place, status): the gate and the document groups.

    Scores under ``least`` fall out, but for documents whose title is the question (column exact). Where the best score of all is under
    ``low``, rows of mere extra recall (column supplemental) fall out too. Texts that differ only in white space
    are one within a document (the best survives); documents rank by their best surviving row, exact titles first. The status is
    matched, low if the first row is under ``low`` and no title is exact, and, for queries of ``asked`` (query) without any
    row, no_match.
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)) if c in scored.columns else F.lit(False)
    best = F.max("score").over(W.partitionBy("query"))
    rows = scored.select(*(c for c in scored.columns if c not in ("exact", "supplemental")), flag("exact").alias("_exact"), flag("supplemental").alias("_extra")).withColumn("_weak", best < low)
    rows = rows.where(F.col("_exact") | ((F.col("score") >= least) & ~(F.col("_weak") & F.col("_extra"))))
    text = F.trim(F.regexp_replace(content, r"\s+", " "))
    same = W.partitionBy("query", document, text).orderBy(F.desc("score"), "key")
    unique = rows.withColumn("_copy", F.row_number().over(same)).where("_copy = 1")
    order = W.partitionBy("query", document).orderBy(F.desc("score"), "key")
    placed = unique.withColumn("evidence_place", F.row_number().over(order)).where(F.col("evidence_place") <= evidence)
    first = W.partitionBy("query", document)
    placed = placed.withColumn("_best", F.max("score").over(first)).withColumn("_key", F.min_by("key", F.col("evidence_place")).over(first)).withColumn("_top", F.max("_exact").over(first))
    rank = F.dense_rank().over(W.partitionBy("query").orderBy(~F.col("_top"), F.desc("_best"), "_key"))
    status = F.when(~F.max("_exact").over(W.partitionBy("query")) & (F.max("score").over(W.partitionBy("query")) < low), "low").otherwise("matched")
    out = placed.withColumn("document_place", rank).withColumn("status", status).where(F.col("document_place") <= documents).select("query", document, "key", "score", "document_place", "evidence_place", "status")
    if asked is None:
        return out
    none = asked.select("query").distinct().join(out.select("query").distinct(), "query", "left_anti").withColumn("status", F.lit("no_match"))
    return out.unionByName(none, allowMissingColumns=True)


def token_similarity(pairs: DataFrame, query_terms_: str, text_terms: str) -> Column:
    """Share of the query's terms (equal weights) that the text has."""
    hit = F.size(F.array_intersect(query_terms_, text_terms))
    return hit / (F.size(F.array_distinct(query_terms_)) + F.lit(1e-9))


def hybrid(token_sim: Column, vector_sim: Column, token_weight: float = 0.3, vector_weight: float = 0.7, extra: Column | None = None) -> Column:
    return token_weight * token_sim + vector_weight * vector_sim + (F.lit(0.0) if extra is None else extra)


def tag_score(query_tags: Column, tags: Column, pagerank: Column) -> Column:
    """Cosine of two tag maps times ten, plus the page rank."""
    dot = F.aggregate(F.map_values(F.map_zip_with(query_tags, tags, lambda k, a, b: F.coalesce(a, F.lit(0.0)) * F.coalesce(b, F.lit(0.0)))), F.lit(0.0), lambda s, v: s + v)
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v * v))
    cos = dot / F.nullif(norm(query_tags) * norm(tags), F.lit(0.0))
    return F.coalesce(cos, F.lit(0.0)) * 10 + F.coalesce(pagerank, F.lit(0.0))


def ir_metrics(run: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """(query, ndcg, map, mrr, hit, recall): run is (query, key, place), qrels (query, key, rel)."""
    good = qrels.where("rel > 0")
    ideal = good.withColumn("_i", F.row_number().over(W.partitionBy("query").orderBy(F.desc("rel"), "key")))
    best = ideal.groupBy("query").agg(F.sum(F.when(F.col("_i") <= k, (F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("_i") + 1)).otherwise(0.0)).alias("idcg"), F.count(F.lit(1)).alias("n"))
    found = run.where(F.col("place") <= k).join(good, ["query", "key"]).withColumn("_c", F.row_number().over(W.partitionBy("query").orderBy("place")))
    seen = found.groupBy("query").agg(
        F.sum((F.pow(F.lit(2.0), "rel") - 1) / F.log2(F.col("place") + 1)).alias("dcg"), F.sum(F.col("_c") / F.col("place")).alias("ap"), F.max(1 / F.col("place")).alias("rr"), F.count(F.lit(1)).alias("hits")
    )
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return best.join(seen, "query", "left").select(
        "query", F.round(zero(F.col("dcg") / F.col("idcg")), 6).alias("ndcg"), F.round(zero(F.col("ap") / F.least("n", F.lit(k))), 6).alias("map"), F.round(zero(F.col("rr")), 6).alias("mrr"),
        (zero(F.col("hits").cast("double")) > 0).alias("hit"), F.round(zero(F.col("hits") / F.col("n")), 6).alias("recall"),
    )
