"""Queries of question rewriting: plain questions, weighted terms, phrases, pieces, topics, and search with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions import normalise as N
from foliant.operators import pipeline as G
from foliant.operators import retrieval as V
from foliant.operators import rewrite as Q
from foliant.operators import text as X
from foliant.plans.registry import Registry
from foliant.plans.retrieval_queries import _LEXICAL, _TOP
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql

#: Questions of three kinds from file names.
_ASKED = """(SELECT doc_id, docnm_kwd, CASE doc_id % 3 WHEN 0 THEN 'What is the limit of ' || docnm_kwd || '?' WHEN 1 THEN docnm_kwd ELSE regexp_replace(docnm_kwd, '\\.[a-zA-Z0-9]{1,8}$', '') || ' 문서에서 보면 점검 결과와 예산은 어떻게 되나요' END AS question FROM documents WHERE docnm_kwd IS NOT NULL)"""
_WIDE = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　", "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''") + " "
_HAN = r"\x{4e00}-\x{9fa5}"
_SIGNS = Q.SIGNS.replace("'", r"\x27")
_PLAIN = rf"""trim(regexp_replace(translate(lower(regexp_replace(regexp_replace(question, '([A-Za-z][0-9]*)([{_HAN}])', '\1 \2', 'g'), '([{_HAN}])([A-Za-z])', '\1 \2', 'g')), '{_WIDE[0]}', '{_WIDE[1]}'), '{_SIGNS}', ' ', 'g'), ' ')"""


def _bare(c: str) -> str:
    """The SQL that takes question words out of c once."""
    out = c
    for pattern, instead in X.QUESTION_WORDS:
        out = f"regexp_replace({out}, '{pattern.replace(chr(39), chr(39) * 2)}', '{instead}', 'gi')"
    return f"coalesce(nullif({out}, ''), {c})"


_NUMBER = r"regexp_full_match(t, '[0-9. \-]{2,}')"
_OOV = r"""CASE WHEN regexp_full_match(t, '(?:[ .\-]|\p{Latin}|\p{Greek}|\p{Cyrillic})+') AND length(regexp_replace(t, '[ .\-]', '', 'g')) > 0 THEN greatest(10, CAST(round_even(300 / pow(2.0, greatest(length(regexp_replace(t, '[ .\-]', '', 'g')) - 3, 0) / 2), 0) AS INTEGER)) END"""
_IDF = "log10(10 + ({n} - {s} + 0.5) / ({s} + 0.5))"
_WEIGHT = rf"""((0.3 * {_IDF.format(n='1e7', s=f"(CASE WHEN {_NUMBER} THEN 3 ELSE coalesce({_OOV}, 10) END)")} + 0.7 * {_IDF.format(n='1e9', s=f"(CASE WHEN {_NUMBER} THEN 5 ELSE coalesce({_OOV}, 3) END)")})
  * CASE WHEN regexp_full_match(t, '[0-9,.]{{2,}}') THEN 2.0 WHEN regexp_full_match(t, '[a-z]{{1,2}}') THEN 0.01 ELSE 1.0 END * CASE WHEN regexp_matches(t, '^[0-9-]') THEN 2.0 ELSE 1.0 END)"""
_CHARACTERS = "(len(s) <= 3 OR len(list_filter(s, lambda x: NOT regexp_full_match(x, '[a-zA-Z]+'))) / len(s) >= 0.7)"
_QUESTIONS = rf"""asked AS {_ASKED}, plain AS (SELECT doc_id, {_PLAIN} AS p FROM asked), once AS (SELECT doc_id, {_bare('p')} AS q FROM plain),
  told AS (SELECT doc_id, q, regexp_split_to_array(q, '[ \t]+') AS s FROM once), side AS (SELECT doc_id, {_CHARACTERS} AS by_characters, {_bare('q')} AS q FROM told)"""
_WORDS = rf"""{_QUESTIONS}, tok AS (SELECT doc_id, unnest(w) AS t, generate_subscripts(w, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(lower(q), '[\p{{L}}\p{{N}}]+') AS w FROM side WHERE NOT by_characters)),
  w AS (SELECT doc_id, pos, t, {_WEIGHT} AS raw FROM tok), n AS (SELECT doc_id, pos, t, raw / sum(raw) OVER (PARTITION BY doc_id) AS weight FROM w)"""


def _questions(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents").where("docnm_kwd is not null")
    name = F.col("docnm_kwd")
    spoken = F.concat(N.without_ending(name), F.lit(" 문서에서 보면 점검 결과와 예산은 어떻게 되나요"))
    kind = F.col("doc_id") % 3
    return docs.select("doc_id", "docnm_kwd", F.when(kind == 0, F.concat(F.lit("What is the limit of "), name, F.lit("?"))).when(kind == 1, name).otherwise(spoken).alias("question"))


@query(f"WITH {_QUESTIONS} SELECT doc_id, q AS question, by_characters FROM side")
def x6_question_words(s: SparkSession, d: str) -> DataFrame:
    once = X.without_question_words(Q.plain_question(F.col("question")))
    return _questions(s, d).select("doc_id", once.alias("q")).select("doc_id", X.without_question_words(F.col("q")).alias("question"), X.by_characters(F.col("q")).alias("by_characters"))


@query(f"WITH {_QUESTIONS} SELECT doc_id, by_characters AS characters FROM side")
def x9_query_language(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("doc_id", X.by_characters(X.without_question_words(Q.plain_question(F.col("question")))).alias("characters"))


@query(f"""WITH {_WORDS} SELECT doc_id, pos AS "at", t AS term, round(weight, 7) AS weight FROM n""")
def m11_term_weights(s: SparkSession, d: str) -> DataFrame:
    return Q.word_query(_questions(s, d), "doc_id", "question").where("kind = 'term'").select(F.col("key").alias("doc_id"), "at", F.col("text").alias("term"), F.round("weight", 7).alias("weight"))


#: (term, synonym, place): a small dictionary.
SYNONYMS = [("report", "account", 0), ("report", "record", 1), ("plan", "scheme", 0), ("inspection", "check", 0), ("limit", "bound", 0), ("limit", "ceiling", 1), ("limit", "threshold", 2), ("점검", "검사", 0), ("예산은", "재정", 0), ("maintenance", "upkeep", 0)]
_SYN = "syn AS (SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {c})" for a, b, c in SYNONYMS) + ") v(term, synonym, place))"


def _synonyms(s: SparkSession) -> DataFrame:
    return s.createDataFrame(SYNONYMS, "term string, synonym string, place int")


@query(f"""WITH {_WORDS}, {_SYN}, every AS (SELECT doc_id, pos, 'term' AS kind, t AS text, weight FROM n
  UNION ALL SELECT doc_id, pos, 'synonym', synonym, weight / 4 FROM n JOIN syn ON syn.term = n.t
  UNION ALL SELECT a.doc_id, a.pos, 'phrase', a.t || ' ' || b.t, 2 * greatest(a.weight, b.weight) FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1) SELECT doc_id, pos AS "at", kind, text, round(weight, 7) AS weight FROM every""")
def r3_word_query(s: SparkSession, d: str) -> DataFrame:
    return Q.word_query(_questions(s, d), "doc_id", "question", _synonyms(s)).select(F.col("key").alias("doc_id"), "at", "kind", "text", F.round("weight", 7).alias("weight"))


@query(rf"""WITH {_QUESTIONS}, {_SYN}, word AS (SELECT doc_id, unnest(s) AS word, generate_subscripts(s, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(q, '\s+'), lambda x: x <> '') AS s FROM side WHERE by_characters)),
  edge AS (SELECT *, CASE WHEN regexp_matches(word, '[a-zA-Z]$') AND regexp_matches(lag(word) OVER w, '[a-zA-Z]$') THEN 0 ELSE 1 END AS fresh FROM word WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
  run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) - 1 AS pos FROM edge), piece AS (SELECT doc_id, CAST(pos AS INTEGER) AS pos, string_agg(word, ' ' ORDER BY i) AS piece FROM run GROUP BY ALL),
  tok AS (SELECT doc_id, pos, unnest(w) AS t, generate_subscripts(w, 1) AS j FROM (SELECT doc_id, pos, list_filter(regexp_extract_all(lower(piece), '[\p{{L}}\p{{N}}]+'), lambda x: x NOT IN ({", ".join(f"'{x}'" for x in Q.STOP_WORDS)})) AS w FROM piece)),
  raw AS (SELECT *, {_WEIGHT} AS raw FROM tok), n AS (SELECT doc_id, pos, j, t, raw / sum(raw) OVER (PARTITION BY doc_id, pos) AS weight FROM raw),
  fine AS (SELECT *, array_to_string(list_transform(range(1, length(t)), lambda i: substr(t, i, 2)), ' ') AS parts FROM n WHERE length(t) >= 3 AND NOT regexp_full_match(t, '[0-9a-z.+#_*\-]+')),
  base AS (SELECT doc_id, pos, 'term' AS kind, t AS text, weight FROM n UNION ALL SELECT doc_id, pos, 'exact', parts, weight FROM fine UNION ALL SELECT doc_id, pos, 'near', parts, weight / 2 FROM fine
    UNION ALL SELECT doc_id, pos, 'synonym', synonym, weight * 0.2 FROM n JOIN syn ON syn.term = n.t
    UNION ALL SELECT doc_id, pos, 'piece', string_agg(t, ' ' ORDER BY j), 1.5 FROM n GROUP BY doc_id, pos HAVING count(*) > 1),
  every AS (SELECT doc_id, pos, kind, text, weight * CASE WHEN (doc_id, pos) IN (SELECT doc_id, pos FROM piece WHERE piece IN (SELECT term FROM syn)) THEN 5 ELSE 1 END AS weight FROM base
    UNION ALL SELECT doc_id, pos, 'piece_synonym', synonym, 0.7 FROM piece JOIN syn ON syn.term = piece.piece) SELECT doc_id, pos AS "at", kind, text, round(weight, 7) AS weight FROM every""")
def r4_piece_query(s: SparkSession, d: str) -> DataFrame:
    return Q.piece_query(_questions(s, d), "doc_id", "question", _synonyms(s)).select(F.col("key").alias("doc_id"), "at", "kind", "text", F.round("weight", 7).alias("weight"))


@query(rf"""WITH tok AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+')) AS t FROM documents WHERE text IS NOT NULL), raw AS (SELECT doc_id, t, {_WEIGHT} AS raw FROM tok),
  n AS (SELECT doc_id, t, raw / sum(raw) OVER (PARTITION BY doc_id) AS weight, count(*) OVER (PARTITION BY doc_id) AS n FROM raw)
  SELECT doc_id, t AS term, round(weight, 7) AS weight, least(3, CAST(round_even(least(n, 30) / 10.0, 0) AS INTEGER)) AS required FROM n QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(weight, 12) DESC, t) <= 30""")
def r7_paragraph_query(s: SparkSession, d: str) -> DataFrame:
    return Q.paragraph_query(load(s, d, "documents").where("text is not null"), "doc_id", "text").select(F.col("key").alias("doc_id"), "term", F.round("weight", 7).alias("weight"), "required")


_PLAINED = "lower(nfc_normalize(regexp_replace(docnm_kwd, '<[^>]+>', ' ', 'g')))"


@query(rf"""SELECT doc_id, list_transform(list_distinct(regexp_extract_all(p, '[a-z0-9]+(?:[._-][a-z0-9]+)*(?:\+{{1,2}}|#)?')), lambda t: 'x' || lower(hex(encode(t)))) AS terms FROM (SELECT doc_id, coalesce({_PLAINED}, '') AS p FROM documents)""")
def x3_exact_terms(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", F.array_sort(N.exact_terms(N.plain_udf("docnm_kwd"))).alias("terms"))


SQL["x3_exact_terms"] = SQL["x3_exact_terms"].replace("SELECT doc_id, list_transform(", "SELECT doc_id, list_sort(list_transform(").replace(")) AS terms", "))) AS terms")


@query(rf"""WITH s AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce({_PLAINED}, ''), '[가-힣]+(?:\s+[가-힣]+)*'), lambda x: regexp_replace(x, '\s+', '', 'g')) AS spans FROM documents)
  SELECT doc_id, list_sort(list_distinct(flatten(list_transform(spans, lambda x: list_concat(list_transform(range(1, greatest(length(x), 1)), lambda i: substr(x, i, 2)), list_transform(range(1, greatest(length(x) - 1, 1)), lambda i: substr(x, i, 3))))))) AS terms FROM s""")
def x4_hangul_terms(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents").select("doc_id", F.array_sort(N.hangul_terms(N.plain_udf("docnm_kwd"))).alias("terms"))


def _exact_sql(c: str) -> str:
    return rf"""list_sort(list_transform(list_distinct(regexp_extract_all({c}, '[a-z0-9]+(?:[._-][a-z0-9]+)*(?:\+{{1,2}}|#)?')), lambda t: CASE WHEN length(t) <= 128 THEN 'x' || lower(hex(encode(t))) ELSE 'xh' || sha256(t) END))"""


_ENDLESS = r"lower(nfc_normalize(regexp_replace(coalesce(docnm_kwd, ''), '\.[a-zA-Z0-9]{1,8}$', '')))"


@query(rf"""SELECT DISTINCT chunk_id, {_exact_sql(_ENDLESS)} AS title_exact, len(regexp_extract_all({_ENDLESS}, '[가-힣]')) > 1 AS hangul FROM chunks WHERE docnm_kwd IS NOT NULL""")
def x5_supplemental_fields(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "chunks").where("docnm_kwd is not null").select("chunk_id", "docnm_kwd", "content").distinct()
    fields = N.supplemental_fields(rows, "docnm_kwd", "content")
    return fields.select("chunk_id", F.array_sort("title_exact").alias("title_exact"), (F.size("title_hangul") > 0).alias("hangul")).distinct()


@query(rf"""WITH a AS {_ASKED}, w AS (SELECT doc_id, list_filter(list_transform(regexp_extract_all(question, '[가-힣]+|[A-Za-z0-9][A-Za-z0-9.+#_-]*'), lambda x: regexp_replace(x, '{Q.PARTICLES}', '')),
  lambda x: length(x) >= 2 AND x NOT IN ({", ".join(f"'{x}'" for x in Q.ASKING)}) AND NOT regexp_matches(x, '(?:{"|".join(Q.VERB_ENDINGS)})$')) AS w FROM a)
  SELECT doc_id, CASE WHEN len(w) >= 3 AND regexp_matches(array_to_string(w[1:32], ' '), '[가-힣]') THEN array_to_string(w[1:32], ' ') ELSE '' END AS terms FROM w""")
def x20_body_terms(s: SparkSession, d: str) -> DataFrame:
    return _questions(s, d).select("doc_id", Q.korean_body_terms(F.col("question")).alias("terms"))


@query(rf"""WITH a AS {_ASKED}, f AS (SELECT doc_id, regexp_extract(trim(question), '{Q.TITLE_TOPIC}', ['f', 't']) AS x FROM a WHERE regexp_matches(trim(question), '{Q.TITLE_TOPIC}')),
  g AS (SELECT doc_id, lower(nfc_normalize(regexp_replace(x.f, '\s+', '', 'g'))) AS fragment, trim(regexp_replace(x.t, '{Q.TOPIC_OPENING}', '')) AS topic FROM f),
  n AS (SELECT doc_id AS document, lower(nfc_normalize(regexp_replace(docnm_kwd, '\s+', '', 'g'))) AS name FROM documents WHERE docnm_kwd IS NOT NULL),
  m AS (SELECT g.doc_id, topic, document FROM g JOIN n ON contains(n.name, g.fragment) WHERE length(fragment) >= 3 AND length(topic) >= 4 AND g.doc_id % 20 = 0)
  SELECT doc_id, topic, document FROM m QUALIFY count(*) OVER (PARTITION BY doc_id) <= 16""")
def x19_title_topics(s: SparkSession, d: str) -> DataFrame:
    docs = load(s, d, "documents").where("docnm_kwd is not null")
    return Q.title_topics(_questions(s, d).where("doc_id % 20 = 0"), "doc_id", "question", docs, "doc_id", "docnm_kwd").select(F.col("key").alias("doc_id"), "topic", "document")


_SEARCH = rf"""{_WORDS}, term AS (SELECT doc_id AS query, t AS term, weight FROM n UNION ALL SELECT a.doc_id, a.t || ' ' || b.t, 2 * greatest(a.weight, b.weight) FROM n a JOIN n b ON a.doc_id = b.doc_id AND b.pos = a.pos + 1),
  q AS (SELECT query, term, sum(weight) AS weight FROM term WHERE query % 20 = 0 GROUP BY 1, 2),
  doc AS (SELECT doc_id AS key, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}]+') AS w FROM documents WHERE text IS NOT NULL), sized AS (SELECT key, len(w) AS dl FROM doc WHERE len(w) > 0), stats AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM sized),
  occ AS (SELECT key, unnest(list_concat(w, list_transform(range(1, greatest(len(w), 1)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM doc), post AS (SELECT key, term, count(*) AS tf FROM occ WHERE term IN (SELECT term FROM q) GROUP BY 1, 2),
  freq AS (SELECT term, count(*) AS df FROM post GROUP BY 1), hit AS (SELECT query, key, sum(weight * ln(1 + (stats.n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score FROM post JOIN freq USING (term) JOIN sized USING (key) JOIN q USING (term), stats GROUP BY 1, 2)"""


@query(f"WITH {_SEARCH} {_TOP.format('hit', 10)}")
def r3_search(s: SparkSession, d: str) -> DataFrame:
    """BM25 with the weights and phrases of rewritten questions: every twentieth document's question against all texts."""
    asked = Q.scoring_terms(Q.word_query(_questions(s, d).where("doc_id % 20 = 0"), "doc_id", "question"))
    return V.lexical_top(load(s, d, "documents").select("doc_id", "text"), "doc_id", "text", asked, 10, phrases=True)


_SIDES = """e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), side AS (SELECT doc_id AS query, docnm_kwd AS question, v FROM documents LEFT JOIN e ON vec_id = doc_id WHERE doc_id % 20 = 0 AND docnm_kwd IS NOT NULL),
  ok AS (SELECT hit.* FROM hit JOIN (SELECT query, count(*) AS n FROM q GROUP BY 1) USING (query) WHERE matched >= greatest(1, floor(0.3 * n)))"""
_SHARE = "len(list_intersect(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+')), regexp_extract_all(lower(d.text), '[\\p{L}\\p{N}]+'))) / greatest(len(list_distinct(regexp_extract_all(lower(question), '[\\p{L}\\p{N}]+'))), 1)"
_PAGE = """row_number() OVER (PARTITION BY query ORDER BY score DESC, spot) AS place, count(*) OVER (PARTITION BY query) AS total FROM s WHERE score >= {}), p AS (SELECT query, key, document, score, place, total FROM r WHERE place BETWEEN {} AND {}) SELECT * FROM p"""


def _asked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every twentieth file name as a question to all texts; texts whose number a vector has go with it."""
    docs, e = load(s, d, "documents"), load(s, d, "embeddings")
    rows = docs.join(e, docs["doc_id"] == e["vec_id"], "left").select("doc_id", "docnm_kwd", "kb_id", "text", F.col("embedding").cast("array<double>").alias("v"))
    chunks = rows.select(F.col("doc_id").alias("key"), F.col("kb_id").alias("document"), F.col("text").alias("content"), "v")
    return rows.where("doc_id % 20 = 0 and docnm_kwd is not null").select(F.col("doc_id").alias("query"), F.col("docnm_kwd").alias("question"), "v"), chunks


def _page_sql(threshold: float, first: int, last: int) -> str:
    return _PAGE.format(threshold, first, last)


@query(f"""WITH {_LEXICAL}, {_SIDES}, t AS ({_TOP.format('ok', 64)}), s AS (SELECT query, key, kb_id AS document, score, place AS spot FROM t JOIN documents ON doc_id = key), r AS (SELECT *, {_page_sql(0.0, 6, 10)}""")
def r11_words(s: SparkSession, d: str) -> DataFrame:
    """The second page of five by words alone."""
    return G.retrieve(*_asked(s, d), mode="bm25", page=2, size=5)


@query(f"""WITH {_LEXICAL}, {_SIDES}, c AS (SELECT query, vec_id AS key, list_cosine_similarity(side.v, e.v) AS score FROM side, e WHERE side.v IS NOT NULL), f AS (SELECT * FROM c WHERE round(score, 6) > 0.2 - 1e-12 AND key IN (SELECT doc_id FROM documents)), t AS ({_TOP.format('f', 64)}),
  s AS (SELECT query, key, kb_id AS document, round(score, 6) AS score, place AS spot FROM t JOIN documents ON doc_id = key), r AS (SELECT *, {_page_sql(0.2, 1, 10)}""")
def r11_dense(s: SparkSession, d: str) -> DataFrame:
    return G.retrieve(*_asked(s, d), mode="dense")


@query(f"""WITH {_LEXICAL}, {_SIDES}, first AS (SELECT query, key, 0.05 * hit.score + 0.95 * coalesce((1 + list_cosine_similarity(x.v, y.v)) / 2, 0) AS score, matched >= greatest(1, floor(0.3 * n)) AS strict, matched >= greatest(1, floor(0.1 * n)) AS loose
    FROM hit JOIN (SELECT query, count(*) AS n FROM q GROUP BY 1) USING (query) LEFT JOIN e x ON x.vec_id = query LEFT JOIN e y ON y.vec_id = key),
  whole AS (SELECT query, key, score FROM first WHERE strict OR (loose AND query NOT IN (SELECT query FROM first WHERE strict))), t AS ({_TOP.format('whole', 64)}),
  s AS (SELECT t.query, t.key, d.kb_id AS document, round(0.7 * ({_SHARE}) + 0.3 * coalesce(list_cosine_similarity(side.v, y.v), 0), 6) AS score, place AS spot FROM t JOIN documents d ON d.doc_id = t.key JOIN side USING (query) LEFT JOIN e y ON y.vec_id = t.key), r AS (SELECT *, {_page_sql(0.2, 1, 10)}""")
def r17_hybrid(s: SparkSession, d: str) -> DataFrame:
    """Candidates by words and vectors, the retry, the rerank, the threshold and the page."""
    return G.retrieve(*_asked(s, d))
