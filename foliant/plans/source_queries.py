"""Queries of the file parsers: the texts of the tables as files of several kinds."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.operators.chunking import count_words
from foliant.plans.registry import Registry
from foliant.sources import files, parsers
from foliant.sources.tables import load

_R = Registry()
query = _R.add
QUERIES, SQL = _R.queries, _R.sql


def _files(s: SparkSession, d: str, ending: str, content) -> DataFrame:
    rows = load(s, d, "documents").where("text is not null")
    return rows.select("doc_id", F.concat(F.lit("f."), F.lit(ending)).alias("name"), content.alias("data"))


@query("SELECT doc_id, 0 AS place, sha256(text) AS block FROM documents WHERE text IS NOT NULL")
def s9_decode(s: SparkSession, d: str) -> DataFrame:
    """Texts as UTF-8, UTF-8 with a mark and UTF-16, read without being told which."""
    text, kind = F.col("text"), F.col("doc_id") % 3
    data = F.when(kind == 0, F.encode(text, "UTF-8")).when(kind == 1, F.concat(F.unhex(F.lit("EFBBBF")), F.encode(text, "UTF-8"))).otherwise(F.encode(text, "UTF-16"))
    return files.parsed(_files(s, d, "txt", data), "doc_id", "name", "data", lambda n, b: [hashlib.sha256(parsers.decode(b)[0].encode()).hexdigest()])


@query(r"""WITH RECURSIVE p AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), '[\n!?;。；！？]'), lambda x: regexp_matches(x, '[^\s\x{a0}\x{3000}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{85}\x1c-\x1f]')) AS x FROM documents WHERE text IS NOT NULL)),
  s AS (SELECT doc_id, i, t, len(regexp_extract_all(t, '[\p{L}\p{N}]+')) AS n FROM p),
  r AS (SELECT doc_id, i, 0 AS g, n <= 128 AS room, CASE WHEN n > 128 THEN 0 ELSE n END AS total FROM s WHERE i = 1
    UNION ALL SELECT s.doc_id, s.i, CASE WHEN r.room AND r.total <= 128 AND s.n <= 128 THEN r.g ELSE r.g + 1 END, s.n <= 128, CASE WHEN s.n > 128 THEN 0 WHEN r.room AND r.total <= 128 THEN r.total + s.n ELSE s.n END FROM r JOIN s ON s.doc_id = r.doc_id AND s.i = r.i + 1)
  SELECT doc_id, r.g AS place, string_agg(t, chr(10) ORDER BY i) AS block FROM r JOIN s USING (doc_id, i) GROUP BY 1, 2""")
def s10_text(s: SparkSession, d: str) -> DataFrame:
    return files.parsed(_files(s, d, "txt", F.encode("text", "UTF-8")), "doc_id", "name", "data", lambda n, b: parsers.text_chunks(parsers.decode(b)[0], count=count_words))


@query("""SELECT p_partkey, 0 AS place, '- name: ' || p_name || chr(10) || '- size: ' || p_size AS block FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT p_partkey, 1, '- name: ' || p_brand || chr(10) || '- size: 1' FROM part WHERE p_partkey % 2 = 0
  UNION ALL SELECT p_partkey, 0, '- name: ' || p_name || chr(10) || '- size: ' || p_size FROM part WHERE p_partkey % 2 = 1""")
def s11_delimited(s: SparkSession, d: str) -> DataFrame:
    """A small table of each part, as tab-separated and as quoted comma-separated text, with a row of another width."""
    rows = load(s, d, "part")
    name, size = F.col("p_name"), F.col("p_size").cast("string")
    tabs = F.concat(F.lit("name\tsize\n"), name, F.lit("\t"), size, F.lit("\nshort\n"), F.col("p_brand"), F.lit("\t1\n"))
    commas = F.concat(F.lit('name,size\r\n"'), name, F.lit('",'), size, F.lit("\r\na,b,c\r\n"))
    data = rows.select("p_partkey", F.lit("t.csv").alias("name"), F.encode(F.when(F.col("p_partkey") % 2 == 0, tabs).otherwise(commas), "UTF-8").alias("data"))
    return files.parsed(data, "p_partkey", "name", "data")


_FOLDED = r"trim(regexp_replace({}, '[ \t\r\n\f]+', ' ', 'g'), ' ')"


@query(f"""WITH f AS (SELECT doc_id, {_FOLDED.format('docnm_kwd')} AS head, {_FOLDED.format("replace(text, chr(0), ' ')")} AS body FROM documents WHERE text IS NOT NULL AND docnm_kwd IS NOT NULL)
  SELECT doc_id, 0 AS place, sha256('## ' || head) AS block FROM f WHERE head <> '' UNION ALL SELECT doc_id, 1, sha256(body) FROM f WHERE regexp_matches(body, '[^\\s\\x{{a0}}\\x{{3000}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{85}}]') AND head <> ''""")
def s14_html(s: SparkSession, d: str) -> DataFrame:
    """Pages of a heading and a paragraph, with a script and a comment that are none."""
    safe = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    page = F.concat(F.lit("<html><head><title>t</title><script>no()</script></head><body><!-- no --><h2>"), safe("docnm_kwd"), F.lit("</h2><p>"), safe("text"), F.lit("</p></body></html>"))
    rows = load(s, d, "documents").where("text is not null and trim(docnm_kwd) <> ''").select("doc_id", F.lit("p.html").alias("name"), F.encode(page, "UTF-8").alias("data"))
    return files.parsed(rows, "doc_id", "name", "data", lambda n, b: [hashlib.sha256(x.encode("utf-8", "replace")).hexdigest() for x in parsers.parse(n, b)])


@query("""SELECT DISTINCT chunk_id, 0 AS place, len(json_keys(metadata)) AS names FROM chunks WHERE metadata IS NOT NULL AND metadata <> '{}'""")
def s15_json(s: SparkSession, d: str) -> DataFrame:
    rows = load(s, d, "chunks").where("metadata is not null").select("chunk_id", F.lit("m.json").alias("name"), F.encode("metadata", "UTF-8").alias("data")).distinct()
    blocks = files.parsed(rows, "chunk_id", "name", "data")
    return blocks.select("chunk_id", "place", F.size(F.json_object_keys("block")).alias("names"))
