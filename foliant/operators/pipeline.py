"""End-to-end search of a query batch: scope, lanes, fusion, caps, rerank, gate, groups; and the embedding of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import retrieval as V
from foliant.operators import rewrite as Q
from foliant.session import cut

Embedder = Callable[[list[str]], np.ndarray]
DIMENSIONS = 64


def hashing_embedder(texts: list[str]) -> np.ndarray:
    """The default embedder: signed feature hashing of words, unit length; the same text always has the same vector."""
    out = np.zeros((len(texts), DIMENSIONS))
    for i, text in enumerate(texts):
        for word in (text or "").lower().split():
            h = xxhash.xxh64_intdigest(word)
            out[i, h % DIMENSIONS] += 1.0 if h >> 63 else -1.0
    length = np.linalg.norm(out, axis=1, keepdims=True)
    return np.divide(out, length, out=np.zeros_like(out), where=length > 0)


def embed(df: DataFrame, key: str, text: str, embedder: Embedder = hashing_embedder, title: str | None = None, title_weight: float = 0.1) -> DataFrame:
    """(key, embedding): vectors of texts, mixed with those of their titles; checked to be finite and of one width."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = None
        for batch in batches:
            vectors = embedder(batch["text"].fillna("").tolist())
            if title:
                vectors = title_weight * embedder(batch["title"].fillna("").tolist()) + (1 - title_weight) * vectors
            if len(vectors) != len(batch) or not np.isfinite(vectors).all() or width not in (None, vectors.shape[1]):
                raise ValueError("an embedder must give one finite vector of the same width for each text")
            width = vectors.shape[1]
            yield pd.DataFrame({"key": batch["key"], "embedding": list(vectors)})

    kind = df.schema[key].dataType.simpleString()
    source = df.select(F.col(key).alias("key"), F.col(text).alias("text"), *([F.col(title).alias("title")] if title else []))
    return source.mapInPandas(run, f"key {kind}, embedding array<double>")


def scope_documents(members: DataFrame, folders: DataFrame, mode: str, wanted: list[str] | None = None) -> DataFrame:
    """(document_id) of a scope: all, folders (with all below them) or documents; unknown ids are errors, an empty scope has none.

    members (folder_id, document_id), folders (id, ids) with ids from the root down."""
    if mode not in ("all", "folders", "documents") or (mode == "all") != (wanted is None):
        raise ValueError(f"not a scope: {mode} {wanted}")
    documents = members.select("document_id").distinct()
    if mode == "all":
        return documents
    spark = members.sparkSession
    asked = spark.createDataFrame([(w,) for w in wanted], "w string") if wanted else spark.createDataFrame([], "w string")
    known = (folders.select(F.col("id").alias("w")) if mode == "folders" else documents.select(F.col("document_id").alias("w"))).distinct()
    unknown = [r["w"] for r in asked.join(known, "w", "left_anti").limit(5).collect()]
    if unknown:
        raise LookupError(f"unknown {mode}: {unknown}")
    if mode == "documents":
        return asked.select(F.col("w").alias("document_id")).distinct()
    below = folders.select("id", F.explode("ids").alias("w")).join(F.broadcast(asked), "w", "left_semi").select(F.col("id").alias("folder_id")).distinct()
    return members.join(below, "folder_id", "left_semi").select("document_id").distinct()


def guard_scope(hits: DataFrame, document: str, scope: DataFrame) -> None:
    """An error if any hit lies outside the scope."""
    outside = hits.select(F.col(document).alias("document_id")).join(scope, "document_id", "left_anti").limit(1).collect()
    if outside:
        raise PermissionError(f"a hit lies outside the scope: {outside[0][0]}")


def lexical_score(question: str, text: str) -> Column:
    """The default reranker: share of the question's terms that a passage has."""
    q, t = F.array_distinct(V.tokens(F.col(question))), V.tokens(F.col(text))
    return F.size(F.array_intersect(q, t)) / F.greatest(F.size(q), F.lit(1))


def fused_search(queries: DataFrame, chunks: DataFrame, scope: DataFrame | None = None, embedder: Embedder = hashing_embedder, rerank: Callable[[str, str], Column] = lexical_score, depth: int = 128, synonyms: DataFrame | None = None) -> DataFrame:
    """(query, document, key, score, document_place, evidence_place, status).

    queries (query bigint, question), chunks (key bigint, document, name, content). Lanes rank on their own: a dense hit need not
    match a word. A query without words has no lexical lane, never a filter-only one; a batch's lanes share one scan of the corpus each."""
    rows = chunks if scope is None else chunks.join(scope.select(F.col("document_id").alias("document")), "document", "left_semi")
    terms = Q.scoring_terms(Q.rewritten(queries, "query", "question", synonyms))
    lexical = V.lexical_top(rows, "key", "content", terms, depth, phrases=True)
    vectors = embed(rows, "key", "content", embedder)
    asked = embed(queries, "query", "question", embedder)
    dense = V.knn(vectors, "key", "embedding", asked.withColumnRenamed("key", "query"), "query", depth, least=1e-9)
    fused = V.rrf({"bm25": lexical, "dense": dense}).join(rows.select("key", "document"), "key")
    capped = V.cap_and_refill(fused, "document", 8, depth)
    texts = rows.select("key", "name", F.substring("content", 1, 2400).alias("content"))
    scored = capped.join(texts, "key").join(queries, "query").withColumn("score", F.round(rerank("question", "content"), 6))
    exact = F.lower(F.trim("question")) == F.lower(F.regexp_replace("name", r"\.[^.\s]{1,8}$", ""))
    return V.groups(scored.withColumn("exact", F.coalesce(exact, F.lit(False))), "document", "content")


MODES = ("hybrid", "dense", "bm25")


def candidate_window(page: int | None, size: int, window: int) -> tuple[int, int]:
    """(page, first place of the page); a page below 1 is the first, and the window must hold all pages up to it."""
    page = max(page or 1, 1)
    if size < 1 or page * size > window:
        raise ValueError(f"a window of {window} candidates doesn't hold page {page} of {size}")
    return page, (page - 1) * size


def retrieve(
    queries: DataFrame, chunks: DataFrame, mode: str = "hybrid", page: int | None = 1, size: int = 10, window: int = 64, threshold: float = 0.2, vector_weight: float = 0.3, candidate_weight: float = 0.95,
    least: float | None = 0.3, features: str | None = None,
) -> DataFrame:
    """(query, key, document, score, place, total): one page of each query's hits.

    queries (query, question, v), chunks (key, document, content, v). Candidates are the ``window`` best by mode: bm25 by words alone (a question
    without words has none), dense by cosine of at least ``threshold``, hybrid by both among the chunks that have ``least`` of the words; hybrid
    questions without any candidate are asked once more with a tenth of the words. Their scores: BM25 as it is, else the weighted sum of
    the share of words and the cosine, and ``features``, a column of chunks. Rows below the threshold fall out, unless vectors count
    nothing; total is the number left. Ties keep the order of the candidates."""
    if mode not in MODES or not 0 <= candidate_weight <= 1 or not 0 <= vector_weight <= 1:
        raise ValueError(f"not a way to retrieve: {mode} {candidate_weight} {vector_weight}")
    page, first = candidate_window(page, size, window)
    terms = V.query_terms(queries, "query", "question")
    if mode == "dense":
        candidates, vector_weight = V.knn(chunks, "key", "v", queries, "query", window, least=threshold), 1.0
    elif mode == "bm25":
        candidates, vector_weight = V.lexical_top(chunks, "key", "content", terms, window, least=least), 0.0
    else:

        def hybrid(asked: DataFrame, share: float | None) -> DataFrame:
            return V.lexical_top(chunks, "key", "content", asked, window, least=share, vector="v", query_vectors=queries.select("query", "v"), vector_weight=candidate_weight)

        candidates = cut(hybrid(terms, least))
        missing = terms.join(candidates.select("query").distinct(), "query", "left_anti")
        if least is not None and not missing.isEmpty():
            candidates = candidates.unionByName(hybrid(missing, 0.1))
    extra = F.coalesce(F.col(features).cast("double"), F.lit(0.0)) if features else F.lit(0.0)
    texts = chunks.select("key", "document", "content", F.col("v").alias("_v"), extra.alias("_extra"))
    rows = candidates.join(texts, "key").join(queries.select("query", "question", F.col("v").alias("_q")), "query")
    cos = F.coalesce(V.cosine(F.col("_q"), F.col("_v")), F.lit(0.0)) if mode != "bm25" else F.lit(0.0)
    sim = V.hybrid(lexical_score("question", "content"), cos, 1 - vector_weight, vector_weight, F.col("_extra")) if mode != "bm25" else F.col("score")
    scored = rows.select("query", "key", "document", F.round(sim, 6).alias("score"), F.col("place").alias("_place")).where(F.col("score") >= (threshold if vector_weight > 0 else 0.0))
    own = W.partitionBy("query")  # at most ``window`` rows each
    placed = scored.withColumns({"place": F.row_number().over(own.orderBy(F.desc("score"), "_place")), "total": F.count(F.lit(1)).over(own)})
    return placed.where(F.col("place").between(first + 1, first + size)).drop("_place")


def recovered(main: DataFrame, lanes: dict[str, DataFrame], limits: dict[str, int], total: int, exact: DataFrame) -> DataFrame:
    """(query, document, key, score, place, extra): candidates with those that further lanes add.

    main (query, document, key, score, place) is in order; lanes have the same columns. Each lane adds its first keys that are not yet there, up
    to its limit, lanes in the order given; the best row of every document of exact (query, document) that no lane has brought keeps a place
    too. Where all are more than ``total``, main gives way from its end."""
    known = main.select("query", "document", "key", "score", "place").withColumn("extra", F.lit(None).cast("string"))
    added: DataFrame | None = None
    for name, lane in lanes.items():
        have = known if added is None else known.unionByName(added)
        fresh = lane.join(have.select("query", "key"), ["query", "key"], "left_anti").withColumn("_n", F.row_number().over(W.partitionBy("query").orderBy("place", "key"))).where(F.col("_n") <= limits[name])
        part = fresh.select("query", "document", "key", "score", "place", F.lit(name).alias("extra"))
        added = part if added is None else added.unionByName(part)
    extras = added.groupBy("query").agg(F.count(F.lit(1)).alias("_extras"))
    wanted = exact.select("query", "document").distinct().withColumn("_exact", F.lit(True))
    kept = known.join(wanted, ["query", "document"], "left").withColumn("_first", F.row_number().over(W.partitionBy("query", "document").orderBy("place")) == 1)
    safe = F.coalesce(F.col("_exact") & F.col("_first"), F.lit(False))
    spot = F.row_number().over(W.partitionBy("query").orderBy(~safe, "place"))
    kept = kept.withColumn("_spot", spot).join(extras, "query", "left").where(F.col("_spot") <= total - F.coalesce("_extras", F.lit(0))).select(known.columns)
    both = kept.unionByName(added)
    return both.withColumn("place", F.row_number().over(W.partitionBy("query").orderBy(F.col("extra").isNotNull(), "place", "key")))


def quality(run: DataFrame, wanted: DataFrame, k: int = 5) -> DataFrame:
    """(category, n, hit, mrr) and a row "all": run (query, document, place), wanted (query, document, category)."""
    best = run.where(F.col("place") <= k).join(wanted.select("query", "document"), ["query", "document"]).groupBy("query").agg(F.min("place").alias("first"))
    rows = wanted.select("query", "category").distinct().join(best, "query", "left")
    scored = rows.select("category", F.col("first").isNotNull().cast("double").alias("h"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("r"))
    out = scored.rollup("category").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("h"), 6).alias("hit"), F.round(F.avg("r"), 6).alias("mrr"))
    return out.select(F.coalesce("category", F.lit("all")).alias("category"), "n", "hit", "mrr")


def lane_ranks(scored: DataFrame) -> DataFrame:
    """(query, lane, key, place) from (query, lane, key, score)."""
    return scored.withColumn("place", F.row_number().over(W.partitionBy("query", "lane").orderBy(F.desc("score"), "key"))).drop("score")
