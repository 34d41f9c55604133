"""Queries of the training-data operators, added to the registry where this subpackage is present."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliant.llm import abuse, encoding, mixing, neardup, scans, splitting
from foliant.sources.tables import load


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    pieces = splitting.split_column(load(spark, directory, "chunks"), "chunk_id", "content")
    return pieces.where("piece = 0").select("chunk_id", "cut_level")


def p1_pieces(spark: SparkSession, directory: str) -> DataFrame:
    return splitting.split_column(load(spark, directory, "chunks"), "chunk_id", "content")


def p6_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encoding.encode_column(load(spark, directory, "documents"), "doc_id", "text")


def p7_mix(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.mix(load(spark, directory, "documents"), load(spark, directory, "mix_targets"))


def p7_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.report(load(spark, directory, "documents"), load(spark, directory, "mix_targets"))


def p7_temperature(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.temperature_weights(load(spark, directory, "documents"), load(spark, directory, "mix_targets"))


def p7_temperature_shares(spark: SparkSession, directory: str) -> DataFrame:
    return mixing.temperature_report(load(spark, directory, "documents"), load(spark, directory, "mix_targets"))


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return scans.noise_found(load(spark, directory, "chunks"))


def p4_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return scans.repaired(load(spark, directory, "chunks"))


#: The measure that TESTDATA.md fixes for problem 5.
_ALIKE = {"k": 3, "t": 0.7, "min_words": 40}


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    pairs = neardup.similar_pairs(load(spark, directory, "chunks"), "chunk_id", "content", **_ALIKE)
    return pairs.select(pairs["a"].alias("chunk_a"), pairs["b"].alias("chunk_b"))


def p5_groups(spark: SparkSession, directory: str) -> DataFrame:
    return neardup.groups(load(spark, directory, "chunks"), "chunk_id", "content", **_ALIKE)


def p8_found(spark: SparkSession, directory: str) -> DataFrame:
    return abuse.found(load(spark, directory, "documents"), load(spark, directory, "abuse_labels"))


def p8_scores(spark: SparkSession, directory: str) -> DataFrame:
    return abuse.score(load(spark, directory, "documents"), load(spark, directory, "abuse_labels")).select("doc_id", "score")


def p8_rates(spark: SparkSession, directory: str) -> DataFrame:
    return abuse.rates(load(spark, directory, "documents"), load(spark, directory, "abuse_labels"))


QUERIES = {
    "p1_found": p1_found,
    "p1_pieces": p1_pieces,
    "p4_found": p4_found,
    "p4_repaired": p4_repaired,
    "p5_found": p5_found,
    "p5_groups": p5_groups,
    "p6_ids": p6_ids,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_temperature": p7_temperature,
    "p7_temperature_shares": p7_temperature_shares,
    "p8_found": p8_found,
    "p8_scores": p8_scores,
    "p8_rates": p8_rates,
}

#: A unit without the white space around it; CR LF is written as two signs that no line end pattern can take apart.
_STRIP = r"regexp_replace(u, '^[\s\x01\x02]+|[\s\x01\x02]+$', '', 'g')"

_PAIRS = r"""WITH RECURSIVE doc AS (SELECT chunk_id, regexp_extract_all(lower(any_value(content)), '[\p{L}\p{N}]+') AS w FROM chunks WHERE content IS NOT NULL GROUP BY 1),
gram AS (SELECT DISTINCT chunk_id, unnest([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] for i in range(1, len(w) - 1)]) AS g FROM doc WHERE len(w) >= 40),
size AS (SELECT chunk_id, count(*) AS n FROM gram GROUP BY 1), common AS (SELECT a.chunk_id AS chunk_a, b.chunk_id AS chunk_b, count(*) AS c FROM gram a JOIN gram b ON a.g = b.g AND a.chunk_id < b.chunk_id GROUP BY 1, 2),
pair AS (SELECT chunk_a, chunk_b FROM common JOIN size x ON x.chunk_id = chunk_a JOIN size y ON y.chunk_id = chunk_b WHERE c >= 0.7 * (x.n + y.n - c) - 1e-9)"""

SQL: dict[str, str] = {
    "p1_found": rf"""
WITH long AS (SELECT chunk_id, replace(any_value(content), chr(13) || chr(10), chr(1) || chr(2)) AS content FROM chunks WHERE length(content) > 1200 GROUP BY 1),
lines AS (SELECT chunk_id, unnest(regexp_split_to_array(content, '\x01\x02|\r|\n')) AS u FROM long),
sentences AS (SELECT chunk_id, unnest(string_split(regexp_replace(regexp_replace(u, '([.!?])(\s)', '\1' || chr(3) || '\2', 'g'), '([。！？])', '\1' || chr(3), 'g'), chr(3))) AS u FROM lines),
fits AS (
  SELECT chunk_id, 1 AS level, max(length({_STRIP})) AS n
  FROM (SELECT chunk_id, unnest(regexp_split_to_array(content, '(?:\x01\x02|\r|\n)(?:[ \t]*(?:\x01\x02|\r|\n))+')) AS u FROM long) GROUP BY 1
  UNION ALL SELECT chunk_id, 2, max(length({_STRIP})) FROM lines GROUP BY 1
  UNION ALL SELECT chunk_id, 3, max(length({_STRIP})) FROM sentences GROUP BY 1
  UNION ALL SELECT chunk_id, 4, max(length(u)) FROM (SELECT chunk_id, unnest(regexp_split_to_array(content, '[\s\x01\x02]+')) AS u FROM long) GROUP BY 1)
SELECT chunk_id, CASE min(CASE WHEN n <= 1200 THEN level ELSE 5 END)
  WHEN 1 THEN 'paragraph' WHEN 2 THEN 'line' WHEN 3 THEN 'sentence' WHEN 4 THEN 'word' ELSE 'hard' END AS cut_level
FROM fits GROUP BY 1""",
    "p5_found": _PAIRS + " SELECT chunk_a, chunk_b FROM pair",
    "p5_groups": _PAIRS + r""", edge AS (SELECT chunk_a AS a, chunk_b AS b FROM pair UNION SELECT chunk_b, chunk_a FROM pair),
reach AS (SELECT a, b FROM edge UNION SELECT reach.a, edge.b FROM reach JOIN edge ON edge.a = reach.b),
first AS (SELECT a, least(a, min(b)) AS group_id FROM reach GROUP BY 1), text AS (SELECT DISTINCT chunk_id, content FROM chunks),
links AS (SELECT edge.a, count(DISTINCT y.content) FILTER (y.content <> x.content) AS n FROM edge JOIN text x ON x.chunk_id = edge.a JOIN text y ON y.chunk_id = edge.b GROUP BY 1)
SELECT DISTINCT c.chunk_id, coalesce(f.group_id, c.chunk_id) AS group_id, coalesce(l.n, 0) AS links FROM chunks c LEFT JOIN first f ON f.a = c.chunk_id LEFT JOIN links l ON l.a = c.chunk_id""",
}
