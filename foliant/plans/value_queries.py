"""Queries of ids and scopes, nested metadata, cells, vectors, citation marks, highlights, final orders and recovered candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import normalise as N
from foliant.operators import answers as A
from foliant.operators import pipeline as G
from foliant.operators import predicates as P
from foliant.operators import retrieval as V
from foliant.operators import text as X
from foliant.operators.ranking import row_numbers
from foliant.plans.registry import Registry
from foliant.plans.relational_queries import LATEST_CHUNKS, chunks_now
from foliant.plans.retrieval_queries import _LANES, _LEXICAL, _TOKENS, _TOP, _fused
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql

_IDS = list(range(0, 2_000, 7))


@query(f"SELECT doc_id, source FROM documents WHERE doc_id IN ({', '.join(map(str, _IDS))}) AND doc_type IS NOT NULL")
def f3_ids(s: SparkSession, d: str) -> DataFrame:
    """Rows by a list of ids, and with a field that is there."""
    rows = load(s, d, "documents").withColumn("id", F.col("doc_id"))
    return P.store_filter(rows, {"id": _IDS}).where("doc_type is not null").select("doc_id", "source")


@query(f"SELECT chunk_id, kb_id FROM {LATEST_CHUNKS} WHERE kb_id IN (SELECT id FROM knowledgebases WHERE permission = 'team' AND kb_status = '1')")
def f6_scope(s: SparkSession, d: str) -> DataFrame:
    """Chunks of the bases that are shared, a list that is bounded by the number of bases."""
    mine = [r["id"] for r in load(s, d, "knowledgebases").where("permission = 'team' and kb_status = '1'").select("id").distinct().collect()]
    return chunks_now(s, d, "chunk_id", "kb_id").where((P.Scope.some(mine) if mine else P.Scope.nothing()).on("kb_id"))


@query("SELECT doc_id FROM documents WHERE false")
def f11_no_hit(s: SparkSession, d: str) -> DataFrame:
    """A filter set by hand without a hit is an empty scope, never none."""
    eav = load(s, d, "documents").select("doc_id", F.lit("lang").alias("key"), F.col("lang").alias("value"))
    return P.manual_filter(eav, [("lang", "=", "no such language")])


@query(f"""SELECT chunk_id, json_extract_string(m, '$.origin.id') AS id, json_extract_string(m, '$.origin.set') AS part, len(json_keys(m)) AS names FROM (SELECT chunk_id, json_merge_patch(metadata, json_object('origin', json_object('id', chunk_id, 'set', 'a'))) AS m FROM {LATEST_CHUNKS} WHERE metadata IS NOT NULL)""")
def k6_nested_paths(s: SparkSession, d: str) -> DataFrame:
    """Two values set under a path of the metadata that isn't there yet."""
    rows = chunks_now(s, d, "chunk_id", "metadata").where("metadata is not null")
    merged = A.with_path(A.with_path(F.col("metadata"), ["origin", "id"], F.col("chunk_id")), ["origin", "set"], F.lit("a"))
    m = rows.select("chunk_id", merged.alias("m"))
    return m.select("chunk_id", F.get_json_object("m", "$.origin.id").alias("id"), F.get_json_object("m", "$.origin.set").alias("part"), F.size(F.json_object_keys("m")).alias("names"))


_CONFIG = '{"chunk":{"cap":128,"overlap":10},"layout":"plain","pages":[[1,9]]}'
_CHANGE = """'{"chunk":{"cap":' || (doc_id % 9) || '},"layout":"' || lower(trim(lang)) || '"}'"""


@query(f"""SELECT doc_id, json_extract_string(m, '$.chunk.cap') AS cap, json_extract_string(m, '$.chunk.overlap') AS overlap, json_extract_string(m, '$.layout') AS layout FROM (SELECT doc_id, json_merge_patch('{_CONFIG}', {_CHANGE}) AS m FROM documents WHERE lang IS NOT NULL)""")
def k9_deep_merge(s: SparkSession, d: str) -> DataFrame:
    """A configuration with each document's changes: dictionaries are merged, other values replaced."""
    change = F.concat(F.lit('{"chunk":{"cap":'), (F.col("doc_id") % 9).cast("string"), F.lit('},"layout":"'), F.lower(F.trim("lang")), F.lit('"}'))
    m = load(s, d, "documents").where("lang is not null").select("doc_id", A.deep_merged(F.lit(_CONFIG), change).alias("m"))
    at = lambda path: F.get_json_object("m", path)
    return m.select("doc_id", at("$.chunk.cap").alias("cap"), at("$.chunk.overlap").alias("overlap"), at("$.layout").alias("layout"))


_CELLS = ["true", "YES", "否", "×", "maybe", "*", "", " no "]


@query(f"SELECT doc_id, CASE WHEN c IN ('true', 'yes', '是', '*', '✓', '✔', '☑', '✅', '√') THEN true WHEN c IN ('false', 'no', '否', '⍻', '×') THEN false END AS value FROM (SELECT doc_id, lower(trim([{', '.join(repr(c) for c in _CELLS)}][doc_id % {len(_CELLS)} + 1])) AS c FROM documents)")
def m6_cells(s: SparkSession, d: str) -> DataFrame:
    cells = F.array(*map(F.lit, _CELLS))
    return load(s, d, "documents").select("doc_id", X.cell_bool(F.get(cells, (F.col("doc_id") % len(_CELLS)).cast("int"))).alias("value"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 4) AS total, vec_id % 11 <> 0 AS valid FROM embeddings")
def m15_parsed_vectors(s: SparkSession, d: str) -> DataFrame:
    """Vectors written with tabs and read again, every eleventh with a word in it: whether they are valid."""
    e = load(s, d, "embeddings")
    text = F.array_join(F.transform("embedding", lambda x: x.cast("double").cast("string")), "\t")
    v = X.parsed_vector(F.when(F.col("vec_id") % 11 == 0, F.concat(text, F.lit("\tnone"))).otherwise(text))
    rows = e.select("vec_id", v.alias("v"), F.size("embedding").alias("n"))
    total = F.aggregate(F.filter("v", lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)
    return rows.select("vec_id", F.round(total, 4).alias("total"), F.coalesce((F.size("v") == F.col("n")) & F.forall("v", lambda x: x.isNotNull()), F.lit(False)).alias("valid"))


@query(r"""SELECT doc_id, regexp_replace(regexp_replace(t, '<think>.*?</think>', '', 'gis'), '[\[(【]\s*(?:id|ref|source)\s*[:：]?\s*(\d+)\s*[\])】]', '[ID:\1]', 'gi') AS answer FROM (SELECT doc_id, docnm_kwd || ' (id: ' || doc_id % 9 || ') <think>no' || chr(10) || 'no</think>【ref ' || doc_id % 5 || '】' AS t FROM documents WHERE docnm_kwd IS NOT NULL)""")
def x32_repaired_marks(s: SparkSession, d: str) -> DataFrame:
    t = F.concat("docnm_kwd", F.lit(" (id: "), (F.col("doc_id") % 9).cast("string"), F.lit(") <think>no\nno</think>【ref "), (F.col("doc_id") % 5).cast("string"), F.lit("】"))
    return load(s, d, "documents").where("docnm_kwd is not null").select("doc_id", A.repaired_citations(t).alias("answer"))


@query("SELECT doc_id, doc_id % 7 BETWEEN 1 AND 5 AS valid FROM documents")
def x35_valid_marks(s: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("one [1], and ["), (F.col("doc_id") % 7).cast("string"), F.lit("]"))
    return load(s, d, "documents").select("doc_id", A.valid_citations(answer, F.lit(5)).alias("valid"))


@query(r"SELECT doc_id, lower(regexp_replace(nfc_normalize(docnm_kwd), '\s+', '', 'g')) AS name FROM documents WHERE docnm_kwd IS NOT NULL")
def x37_comparison_key(s: SparkSession, d: str) -> DataFrame:
    key = F.pandas_udf(lambda c: c.map(N.comparison_key), T.StringType())
    return load(s, d, "documents").where("docnm_kwd is not null").select("doc_id", key("docnm_kwd").alias("name"))


_WORDS = f"list_filter(list_distinct({_TOKENS.format('docnm_kwd')}), lambda w: length(w) > 3)"


@query(rf"""WITH x AS (SELECT doc_id, {_WORDS} AS w, list_filter(list_transform(regexp_extract_all(text, '[^.。！？!?；;：:\n]*[.。！？!?；;：:\n]|[^.。！？!?；;：:\n]+$'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '') AS s FROM documents WHERE text IS NOT NULL AND docnm_kwd IS NOT NULL AND len({_WORDS}) > 0),
  u AS (SELECT doc_id, w, unnest(s) AS s FROM x) SELECT doc_id, count(*) AS sentences, sum(length(s)) AS characters FROM u WHERE len(list_intersect(w, {_TOKENS.format('s')})) > 0 GROUP BY 1""")
def x27_highlighted(s: SparkSession, d: str) -> DataFrame:
    """Sentences of every text with a word of its file's name: how many, and how long they are without the marks."""
    words = F.filter(F.array_distinct(V.tokens(F.col("docnm_kwd"))), lambda w: F.length(w) > 3)
    rows = load(s, d, "documents").where("text is not null and docnm_kwd is not null").withColumn("words", words).where("size(words) > 0")
    marked = rows.select("doc_id", X.highlighted(F.col("text"), F.array_join("words", "|")).alias("m")).where("size(m) > 0")
    bare = F.transform("m", lambda x: F.length(F.replace(F.replace(x, F.lit("<em>"), F.lit("")), F.lit("</em>"), F.lit(""))))
    return marked.select("doc_id", F.size("m").cast("bigint").alias("sentences"), F.aggregate(bare, F.lit(0).cast("bigint"), lambda a, n: a + n).alias("characters"))


@query(f"""WITH {_LANES}, r AS (SELECT query, key, round(rrf, 9) AS rrf, round(rrf, 4) AS score FROM f) SELECT query, key, row_number() OVER (PARTITION BY query ORDER BY score DESC, rrf DESC, key) AS place FROM r""")
def t8_final_order(s: SparkSession, d: str) -> DataFrame:
    """Score, then fused rank, then id."""
    rows = _fused(s, d).select("query", "key", F.round("rrf", 9).alias("rrf")).withColumn("score", F.round("rrf", 4))
    return row_numbers(rows, ["query"], [F.desc("score"), F.desc("rrf"), F.col("key")], "place").select("query", "key", "place")


@query(f"""WITH {_LEXICAL}, main AS ({_TOP.format('hit', 20)}), two AS ({_TOP.format('scr', 60)}), title AS (SELECT q.doc_id AS query, d.doc_id AS key, row_number() OVER (PARTITION BY q.doc_id ORDER BY d.doc_id) AS place FROM documents q JOIN documents d ON d.docnm_kwd = q.docnm_kwd WHERE q.doc_id % 20 = 0),
  x1 AS (SELECT query, key, place FROM title WHERE (query, key) NOT IN (SELECT query, key FROM main) QUALIFY row_number() OVER (PARTITION BY query ORDER BY place, key) <= 2),
  x2 AS (SELECT query, key, place FROM two WHERE (query, key) NOT IN (SELECT query, key FROM main UNION ALL SELECT query, key FROM x1) QUALIFY row_number() OVER (PARTITION BY query ORDER BY place, key) <= 3),
  extra AS (SELECT *, 'title' AS extra FROM x1 UNION ALL SELECT *, 'sparse' FROM x2), n AS (SELECT query, count(*) AS n FROM extra GROUP BY 1),
  m AS (SELECT main.query, main.key, place, (main.query, main.key) IN (SELECT query, key FROM title) AS exact FROM main), spot AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY NOT exact, place) AS spot FROM m),
  kept AS (SELECT spot.query, key, place, CAST(NULL AS VARCHAR) AS extra FROM spot LEFT JOIN n USING (query) WHERE spot <= 20 - coalesce(n, 0)), every AS (SELECT * FROM kept UNION ALL SELECT * FROM extra)
  SELECT query, key, extra, row_number() OVER (PARTITION BY query ORDER BY extra IS NOT NULL, place, key) AS place FROM every""")
def r21_recovery(s: SparkSession, d: str) -> DataFrame:
    """Twenty candidates of BM25, of which the last give way to texts of the very title and to those of another lane."""
    docs = load(s, d, "documents")
    terms = V.query_terms(docs.where("doc_id % 20 = 0"), "doc_id", "docnm_kwd")
    lane = lambda model, k: V.lexical_top(docs.select("doc_id", "text"), "doc_id", "text", terms, k, model=model).withColumn("document", F.col("key"))
    asked = docs.where("doc_id % 20 = 0").select(F.col("doc_id").alias("query"), "docnm_kwd")
    same = asked.join(docs.select(F.col("doc_id").alias("key"), "docnm_kwd"), "docnm_kwd").select("query", "key", F.col("key").alias("document"), F.lit(0.0).alias("score"))
    title = row_numbers(same, ["query"], [F.col("key")], "place")
    return G.recovered(lane("bm25", 20), {"title": title, "sparse": lane("scripted", 60)}, {"title": 2, "sparse": 3}, 20, title.select("query", "document")).select("query", "key", "extra", "place")


@query(r"""WITH l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) - 1 AS i FROM (SELECT doc_id, regexp_split_to_array('![p](' || doc_id % 3 || '.png) and ![q](a.png)' || chr(10) || text || chr(10) || '<img src="' || doc_id % 5 || '.jpg"> ![p](a.png) ![p](a.png)', '\r\n|\r|\n') AS x FROM documents WHERE text IS NOT NULL)),
  u AS (SELECT doc_id, i, unnest(list_concat(regexp_extract_all(line, '!\[[^\]]*\]\(([^)\s]+)', 1), regexp_extract_all(line, '(?i)src=["\x27]([^"\x27>\s]+)', 1))) AS url FROM l) SELECT DISTINCT doc_id, CAST(i AS INTEGER) AS line, url FROM u""")
def x38_image_links(s: SparkSession, d: str) -> DataFrame:
    """The images of every text, with some put around it, by line."""
    number = lambda n: (F.col("doc_id") % n).cast("string")
    text = F.concat(F.lit("![p]("), number(3), F.lit(".png) and ![q](a.png)\n"), "text", F.lit('\n<img src="'), number(5), F.lit('.jpg"> ![p](a.png) ![p](a.png)'))
    return load(s, d, "documents").where("text is not null").select("doc_id", F.inline(X.image_links(text)))
