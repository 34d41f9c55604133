"""Queries of text scalars, hashes, dates, vectors and chunkers."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.functions import normalise as N
from foliant.operators import chunking as C
from foliant.operators import outline as O
from foliant.operators import text as X
from foliant.plans.registry import Registry
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql


def docs(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "documents")


def _one(s: SparkSession, d: str, value) -> DataFrame:
    return docs(s, d).where("text is not null").select("doc_id", value.alias("value"))


def text_query(name: str, value, sql: str) -> None:
    """A scalar over every text."""
    QUERIES[name] = lambda s, d: _one(s, d, value(F.col("text")))
    SQL[name] = f"SELECT doc_id, {sql} AS value FROM documents WHERE text IS NOT NULL"


def _text_queries() -> None:
    text_query("x14_newlines", lambda t: F.sha2(X.newlines(t), 256), r"sha256(regexp_replace(text, '\r\n?', chr(10), 'g'))")
    text_query("x16_sentences", lambda t: F.sha2(F.array_join(X.sentences(t), "\u001f"), 256), r"sha256(array_to_string(list_filter(list_transform(regexp_extract_all(text, '[^.。！？!?；;：:\n]*[.。！？!?；;：:\n]|[^.。！？!?；;：:\n]+$'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''), chr(31)))")
    text_query("x26_multi_values", lambda t: F.sha2(F.array_join(F.array_sort(X.multi_values(t)), "\u001f"), 256), r"sha256(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[、,，;；|]+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''))), chr(31)))")
    text_query("x21_prefix", lambda t: F.sha2(F.substring(t, 1, 2400), 256), "sha256(substr(text, 1, 2400))")
    text_query("x7_spaced_scripts", lambda t: F.sha2(X.spaced_scripts(t), 256), r"sha256(regexp_replace(regexp_replace(text, '([A-Za-z0-9])([\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}])', '\1 \2', 'g'), '([\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}])([A-Za-z0-9])', '\1 \2', 'g'))")
    text_query("x8_escaped", lambda t: F.sha2(X.escaped(t), 256), r"sha256(trim(regexp_replace(replace(text, chr(39), ''), '([:{}/\[\]\-*?\x22\(\)|+~^])', '\\\1', 'g'), ' ' || chr(9) || chr(10) || chr(13)))")
    text_query("x10_english", lambda t: X.is_english(X.sentences(t)), r"coalesce(len(list_filter(list_filter(list_transform(regexp_extract_all(text, '[^.。！？!?；;：:\n]*[.。！？!?；;：:\n]|[^.。！？!?；;：:\n]+$'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''), lambda p: regexp_full_match(p, '[`a-zA-Z0-9\s.,\x27:;/\x22?<>!\(\)\-]+'))) / nullif(len(list_filter(list_transform(regexp_extract_all(text, '[^.。！？!?；;：:\n]*[.。！？!?；;：:\n]|[^.。！？!?；;：:\n]+$'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')), 0) > 0.8, false)")
    text_query("x10_han", lambda t: X.is_han(t), r"coalesce(len(regexp_extract_all(text, '[\x{4e00}-\x{9fff}]')) / nullif(length(text), 0) > 0.2, false)")
    text_query("x13_without_fence", lambda t: F.sha2(X.without_fence(F.concat(F.lit("```markdown\n"), t, F.lit("\n```"))), 256), r"sha256(trim(regexp_replace(regexp_replace('```markdown' || chr(10) || text || chr(10) || '```', '^\s*```markdown\s*\n?', ''), '\n?\s*```\s*$', ''), ' ' || chr(9) || chr(10) || chr(13)))")
    text_query("x13_blank", lambda t: X.is_blank(t), r"trim(text, ' ' || chr(9) || chr(10) || chr(13)) = ''")
    text_query("x25_keyword_terms", lambda t: F.sha2(F.array_join(F.array_sort(X.keyword_terms(t)), "\u001f"), 256), r"sha256(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_split_to_array(text, '[,，;；、\r\n]+'), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''))), chr(31)))")
    text_query("x28_between", lambda t: F.sha2(F.array_join(X.between(t, "(", ")"), "\u001f"), 256), r"sha256(array_to_string(regexp_extract_all(text, '(?s)\((.*?)\)', 1), chr(31)))")
    text_query("x10_script_shares", lambda t: F.round(X.share_of(t, r"[一-龥가-힣぀-ヿ]"), 6), r"round(len(regexp_extract_all(text, '[\x{4e00}-\x{9fa5}\x{ac00}-\x{d7a3}\x{3040}-\x{30ff}]')) / nullif(length(text), 0), 6)")
    text_query("x11_without_tables", lambda t: F.sha2(X.without_tables(t), 256), r"sha256(regexp_replace(text, '</?(table|td|caption|tr|th)( [^<>]{0,12})?>', ' ', 'gi'))")
    text_query("x12_punctuation", lambda t: F.sha2(X.tight_punctuation(t), 256), r"sha256(regexp_replace(regexp_replace(text, '([(\[{]) +', '\1', 'g'), ' +([)\]},.;:!?])', '\1', 'g'))")
    text_query("x38_links", lambda t: F.sha2(F.array_join(F.array_sort(X.links(t)), " "), 256), r"sha256(array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(https?://[^\s)\]>\x22\x27]+)', 1))), ' '))")
    text_query("x2_half_width", lambda t: F.sha2(X.half_width(t), 256), "sha256(translate(text, '" + "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　', '" + "".join(chr(x) for x in range(0x21, 0x7F)).replace("'", "''") + " '))")
    text_query("m2_canonical_hash", lambda t: X.canonical_hash("kb_id", "doc_id", "docnm_kwd"), """sha256('{"doc_id":' || doc_id || ',"docnm_kwd":' || coalesce(to_json(docnm_kwd)::VARCHAR, 'null') || ',"kb_id":' || coalesce(to_json(kb_id)::VARCHAR, 'null') || '}')""")
    QUERIES["m4_bucket"] = lambda s, d: docs(s, d).select("doc_id", X.bucket(F.coalesce("docnm_kwd", F.lit(""))).alias("bucket"))
    digits = [f"CAST('0x' || substr(h, {at}, 8) AS HUGEINT)" for at in range(1, 41, 8)]
    number = " + ".join(f"({x} % 100000000) * {(1 << (32 * (4 - i))) % 10**8} % 100000000" for i, x in enumerate(digits))
    SQL["m4_bucket"] = f"SELECT doc_id, CAST(({number}) % 100000000 AS BIGINT) AS bucket FROM (SELECT doc_id, sha1(coalesce(docnm_kwd, '')) AS h FROM documents)"
    text_query("m5_day", lambda t: F.date_format(F.date_trunc("day", "created_at"), "yyyy-MM-dd"), "strftime(date_trunc('day', created_at), '%Y-%m-%d')")
    text_query("m8_pretty_size", lambda t: X.pretty_bytes(F.octet_length(t) * F.octet_length(t)), "CASE WHEN b < 1024 THEN printf('%.0f B', b) WHEN b < 1048576 THEN printf(CASE WHEN b / 1024 >= 100 THEN '%.0f KB' WHEN b / 1024 >= 10 THEN '%.1f KB' ELSE '%.2f KB' END, b / 1024) WHEN b < 1073741824 THEN printf(CASE WHEN b / 1048576 >= 100 THEN '%.0f MB' WHEN b / 1048576 >= 10 THEN '%.1f MB' ELSE '%.2f MB' END, b / 1048576) ELSE printf('%.2f GB', b / 1073741824) END")
    QUERIES["m8_pretty_size"] = lambda s, d: docs(s, d).where("text is not null").select("doc_id", F.octet_length("text").cast("bigint").alias("n")).select("doc_id", X.pretty_bytes(F.col("n") * F.col("n")).alias("value"))
    SQL["m8_pretty_size"] = SQL["m8_pretty_size"].replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT doc_id, CAST(strlen(text) AS DOUBLE) * strlen(text) AS b FROM documents WHERE text IS NOT NULL)")
    text_query("m7_overlap", lambda t: X.overlap_percent(F.col("n_chars") / 1000), "CAST(least(greatest(CASE WHEN n_chars / 1000 > 0 AND n_chars / 1000 < 1 THEN n_chars / 1000 * 100 ELSE n_chars / 1000 END, 0), 90) - 0.5 + 0.5 AS DOUBLE)::DOUBLE")
    SQL["m7_overlap"] = SQL["m7_overlap"].replace("CAST(least", "CAST(floor(least").replace("- 0.5 + 0.5 AS DOUBLE)::DOUBLE", ") AS INTEGER)")
    text_query("m18_years", lambda t: X.months_between_years(F.col("created_at"), F.lit(None).cast("timestamp"), "2026-01-01 00:00:00"), "CASE WHEN (2026 - year(created_at)) * 12 + 1 - month(created_at) > 0 THEN round_even(((2026 - year(created_at)) * 12 + 1 - month(created_at)) / 12, 1) ELSE 0 END")


_text_queries()


@query(r"""SELECT DISTINCT w AS word, CASE WHEN regexp_full_match(w, '[\p{Latin}\p{Greek}\p{Cyrillic}]+') AND NOT regexp_matches(w, '\P{L}') THEN greatest(10, CAST(round_even(300 / pow(2.0, greatest(length(w) - 3, 0) / 2), 0) AS INTEGER)) END AS freq
  FROM (SELECT unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents WHERE text IS NOT NULL)""")
def m12_oov_frequency(s: SparkSession, d: str) -> DataFrame:
    words = docs(s, d).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))).alias("word")).distinct()
    return words.select("word", X.oov_frequency(F.col("word")).alias("freq"))


@query("SELECT vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))) * 0.1 + 0.9 * list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * 2)), 5) AS total, len(embedding) = 64 AS valid FROM embeddings")
def m13_mixed_vectors(s: SparkSession, d: str) -> DataFrame:
    e = F.col("embedding").cast("array<double>")
    mixed = X.mixed_vectors(e, F.transform(e, lambda x: x * 2))
    return load(s, d, "embeddings").select("vec_id", F.round(F.aggregate(mixed, F.lit(0.0), lambda a, x: a + x), 5).alias("total"), X.valid_vector(F.col("embedding"), 64).alias("valid"))


@query("SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def k10_json_field(s: SparkSession, d: str) -> DataFrame:
    return load(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT chunk_id, p[1] AS page, CAST(p[4] AS INTEGER) AS top, place FROM (SELECT chunk_id, unnest(positions) AS p, generate_subscripts(positions, 1) - 1 AS place FROM (SELECT DISTINCT chunk_id, positions FROM chunks WHERE positions IS NOT NULL))""")
def k7_positions(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "chunks").where("positions is not null").select("chunk_id", "positions").distinct()
    return rows.select("chunk_id", F.posexplode("positions").alias("place", "p")).select("chunk_id", F.col("p")[0].alias("page"), F.col("p")[3].alias("top"), "place")


@query("""SELECT doc_id, place, chunk FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> '')) AS chunk,
  generate_subscripts(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda p: trim(p, ' ' || chr(9) || chr(10) || chr(13))), lambda p: p <> ''), 1) - 1 AS place FROM documents WHERE text IS NOT NULL)""")
def c4_delimiter_chunks(s: SparkSession, d: str) -> DataFrame:
    parts = F.filter(F.transform(F.split("text", "\n\n"), lambda p: F.trim(p, F.lit(" \t\n\r"))), lambda p: p != "")
    return docs(s, d).where("text is not null").select("doc_id", F.posexplode(parts).alias("place", "chunk"))


def c1_naive_merge(s: SparkSession, d: str) -> DataFrame:
    """Tokens of a public vocabulary where its file is, words and marks elsewhere."""
    vocabulary = Path("/opt/tokenizers/byte_bpe_50k.tiktoken")
    count = C.BpeCounter(str(vocabulary)) if vocabulary.exists() else C.count_tokens
    return C.chunk_column(docs(s, d), "doc_id", "text", lambda t: C.naive_merge(t, 128, "\n。；！？.", 10, count))


_LINES = "list_filter(string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: x <> '')"


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_LINES} AS x FROM documents WHERE text IS NOT NULL)), s AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS n FROM p),
  r AS (SELECT doc_id, i, 0 AS g, n <= 64 AS room, CASE WHEN n > 64 THEN 0 ELSE n END AS total FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.room AND r.total <= 64 AND s.n <= 64 THEN r.g ELSE r.g + 1 END, s.n <= 64, CASE WHEN s.n > 64 THEN 0 WHEN r.room AND r.total <= 64 THEN r.total + s.n ELSE s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
  SELECT doc_id, r.g AS place, string_agg(chr(10) || t, '' ORDER BY i) AS chunk FROM r JOIN s USING (doc_id, i) GROUP BY 1, 2""")
def c2_over_cap(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_column(docs(s, d), "doc_id", "text", lambda t: C.naive_merge(t, 64, "\n", count=C.count_words))


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_LINES} AS x FROM documents WHERE text IS NOT NULL)), s AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[\p{{L}}\p{{N}}]+')) AS n FROM p),
  r AS (SELECT doc_id, i, 0 AS g, n <= 64 AS room, n AS total FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.room AND r.total + s.n <= 64 AND s.n <= 64 THEN r.g ELSE r.g + 1 END, s.n <= 64, CASE WHEN r.room AND r.total + s.n <= 64 AND s.n <= 64 THEN r.total + s.n ELSE s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
  SELECT doc_id, r.g AS place, string_agg(chr(10) || t, '' ORDER BY i) AS chunk FROM r JOIN s USING (doc_id, i) GROUP BY 1, 2""")
def c2_under_cap(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_column(docs(s, d), "doc_id", "text", lambda t: C.naive_merge(t, 64, "\n", count=C.count_words, strategy="under"))


@query(rf"""WITH RECURSIVE p AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, {_LINES} AS x FROM documents WHERE text IS NOT NULL)),
  r AS (SELECT doc_id, i, t AS chunk FROM p WHERE i = 1 UNION ALL SELECT p.doc_id, p.i, substr(r.chunk, CAST(floor(length(r.chunk) * 80 / 100.0) AS INTEGER) + 1) || p.t FROM r JOIN p ON p.doc_id = r.doc_id AND p.i = r.i + 1)
  SELECT doc_id, CAST(i - 1 AS INTEGER) AS place, chunk FROM r""")
def c3_overlap(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_column(docs(s, d), "doc_id", "text", lambda t: C.with_overlap([x for x in C.newlines(t).split("\n") if x], 20))


def c5_tree_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_column(docs(s, d), "doc_id", "text", O.tree_chunks)


def c5_hierarchical(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_column(docs(s, d), "doc_id", "text", lambda t: ["\n".join(c) for c in O.hierarchical_chunks("\n".join(O.without_contents(C.newlines(t).split("\n"))))])


_HEADS = "list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '' AND NOT regexp_matches(x, '^" + O.NO_BULLET + "'))"
_HITS = ", ".join("len(list_filter(h, lambda x: regexp_matches(x, '^(?:" + "|".join(f) + ")')))" for f in O.FAMILIES)


@query(f"WITH x AS (SELECT doc_id, {_HEADS} AS h FROM documents WHERE text IS NOT NULL), y AS (SELECT doc_id, [{_HITS}] AS hits FROM x) SELECT doc_id, CAST(CASE WHEN list_max(hits) = 0 THEN -1 ELSE list_position(hits, list_max(hits)) - 1 END AS INTEGER) AS family FROM y")
def x22_bullets(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where("text is not null").select("doc_id", O.family_column(F.split("text", "\n")).alias("family"))


@query(rf"SELECT doc_id, NOT regexp_matches(docnm_kwd, '^{O.ARTICLE}') AND (len(list_filter(regexp_split_to_array(docnm_kwd, '\s+'), lambda w: w <> '')) > 12 OR (NOT contains(docnm_kwd, ' ') AND length(docnm_kwd) >= 32) OR regexp_matches(docnm_kwd, '{O.SENTENCE_MARKS}')) AS no_title FROM documents WHERE docnm_kwd IS NOT NULL")
def x23_no_title(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).where("docnm_kwd is not null").select("doc_id", O.is_no_title(F.col("docnm_kwd")).alias("no_title"))


@query(r"SELECT DISTINCT w AS word, CASE WHEN regexp_full_match(w, '\d+') THEN CAST(w AS BIGINT) ELSE -1 END AS number FROM (SELECT unnest(regexp_extract_all(docnm_kwd, '[0-9]+|[a-z]{4,}')) AS w FROM documents) WHERE w NOT IN ('zero', 'four', 'five', 'nine', 'three', 'seven', 'eight', 'forty', 'fifty', 'sixty', 'eleven', 'twelve', 'twenty', 'thirty', 'eighty', 'ninety', 'hundred', 'thousand', 'million', 'mill', 'civil') AND NOT regexp_full_match(w, '[ivxlcdm]+')")
def x24_numerals(s: SparkSession, d: str) -> DataFrame:
    words = docs(s, d).select(F.explode(F.regexp_extract_all("docnm_kwd", F.lit(r"([0-9]+|[a-z]{4,})"), F.lit(1))).alias("word")).distinct()
    read = F.pandas_udf(lambda w: w.map(O.numeral), T.LongType())
    number = words.select("word", read("word").alias("number"))
    return number.where((F.col("number") >= 0) & F.col("word").rlike(r"^\d") | (F.col("number") == -1))


_SPLIT = "len(string_split(line, {})) = 2"
_RECORDS = f"""l AS (SELECT doc_id, unnest(x) AS line, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents WHERE text <> '')),
  m AS (SELECT doc_id, CASE WHEN count(*) FILTER ({_SPLIT.format('chr(9)')}) >= count(*) FILTER ({_SPLIT.format("','")}) THEN chr(9) ELSE ',' END AS mark FROM l GROUP BY 1), h AS (SELECT l.*, string_split(line, mark) AS f, {_SPLIT.format('mark')} AS head FROM l JOIN m USING (doc_id))"""


@query(f"""WITH {_RECORDS}, g AS (SELECT *, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i) AS grp, sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id) AS heads FROM h),
  p AS (SELECT doc_id, grp, max(heads) AS heads, max(f[1]) FILTER (head) AS question, string_agg(CASE WHEN head THEN f[2] ELSE line END, chr(10) ORDER BY i) AS answer FROM g WHERE grp > 0 GROUP BY 1, 2)
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY grp) - 1 AS INTEGER) AS place, question, answer FROM p WHERE question <> '' AND (answer <> '' OR grp = heads)""")
def c11_question_answers(s: SparkSession, d: str) -> DataFrame:
    return C.pair_column(docs(s, d), "doc_id", "text", C.question_answers, ("question", "answer"))


@query(f"""WITH {_RECORDS}, g AS (SELECT *, coalesce(sum(CAST(head AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS grp FROM h)
  SELECT doc_id, CAST(grp AS INTEGER) AS place, string_agg(chr(10) || CASE WHEN head THEN f[1] ELSE line END, '' ORDER BY i) AS passage, max(f[2]) FILTER (head) AS tags FROM g GROUP BY doc_id, grp HAVING bool_or(head)""")
def c12_tagged_passages(s: SparkSession, d: str) -> DataFrame:
    return C.pair_column(docs(s, d), "doc_id", "text", C.tagged_passages, ("passage", "tags"))


def c7_markdown_chunks(s: SparkSession, d: str) -> DataFrame:
    return C.chunk_column(docs(s, d), "doc_id", "text", C.markdown_chunks)


@query("""WITH r AS (SELECT doc_id, o, g, t FROM (SELECT l_orderkey AS doc_id, l_linenumber AS o, l_returnflag AS g, CAST(l_partkey AS VARCHAR) AS t, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1),
  b AS (SELECT *, CASE WHEN lag(g) OVER w IS NOT DISTINCT FROM g THEN 0 ELSE 1 END AS s FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY o)), n AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY o) AS block FROM b)
  SELECT doc_id, CAST(block AS BIGINT) AS block, string_agg(t, chr(10) ORDER BY o) AS text FROM n GROUP BY 1, 2""")
def c9_session_blocks(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("o")).agg(F.count(F.lit(1)).alias("n"), F.min("l_returnflag").alias("g"), F.min(F.col("l_partkey").cast("string")).alias("t")).where("n = 1")
    return C.session_blocks(rows, "doc_id", "o", "g", "t")


@query("SELECT column, kind FROM (VALUES ('o_orderkey', 'int'), ('o_totalprice', 'float'), ('o_orderstatus', 'text'), ('o_orderdate', 'datetime')) AS v(\"column\", kind)".replace("SELECT column", 'SELECT "column"'))
def c14_column_types(s: SparkSession, d: str) -> DataFrame:
    return C.column_types(load(s, d, "orders"), ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderdate"])


@query(r"""WITH t AS (SELECT doc_id, regexp_replace(replace(lower(nfc_normalize(regexp_replace(docnm_kwd, '\s+', '', 'g'))), 'ß', 'ss'), '\.(?:pdf|docx?|pptx?|xlsx?|hwpx?|txt|md|csv|html?)$', '') AS k FROM documents) SELECT doc_id, coalesce(k, '') AS title FROM t""")
def x18_title_key(s: SparkSession, d: str) -> DataFrame:
    return docs(s, d).select("doc_id", N.title_key(N.folded_udf("docnm_kwd")).alias("title"))


QUERIES |= {f.__name__: f for f in (c1_naive_merge, c5_tree_chunks, c5_hierarchical, c7_markdown_chunks)}
