"""What happens to hits after ranking: parents, neighbours, citations, budgets, tags, highlights, boxes, dictionaries."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliant.operators.chunking import count_tokens


def parent_expansion(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query, key, score, children): children of one parent give way to it with their mean score; a hit without a parent,
    or whose parent isn't there, stays. hits (query, key, score), chunks (key, parent)."""
    known = chunks.select(F.col("key").alias("_parent"))
    linked = hits.join(chunks.select("key", "parent"), "key", "left").join(known, F.col("parent") == F.col("_parent"), "left")
    target = F.coalesce("_parent", "key")
    return linked.groupBy("query", target.alias("key")).agg(F.avg("score").alias("score"), F.count_if(F.col("_parent").isNotNull()).alias("children"))


def toc_boost(hits: DataFrame, toc: DataFrame) -> DataFrame:
    """Scores with the relevance that a table of contents gives to chunks of each query's best document.

    hits (query, key, document, score), toc (key, relevance)."""
    best = hits.groupBy("query", "document").agg(F.sum("score").alias("s")).groupBy("query").agg(F.max_by("document", F.struct("s", "document")).alias("best"))
    rows = hits.join(best, "query").join(toc, "key", "left")
    gain = F.when(F.col("document") == F.col("best"), F.coalesce("relevance", F.lit(0.0))).otherwise(0.0)
    return rows.select("query", "key", "document", (F.col("score") + gain).alias("score"))


def tag_weights(tagged: DataFrame, corpus: DataFrame, top: int = 3, smooth: float = 1000.0) -> DataFrame:
    """(key, tag, weight): how much more often the chunks alike have a tag than the corpus, the best ``top`` of each.

    tagged (key, tag) of the chunks alike, corpus (tag) of all."""
    counted = corpus.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))
    total = counted.agg(F.sum("n").alias("total"))  # one row
    prior = counted.crossJoin(F.broadcast(total)).select("tag", ((F.col("n") + 1) / (F.col("total") + smooth)).alias("prior"))
    counts = tagged.groupBy("key", "tag").agg(F.count(F.lit(1)).alias("c"))
    scored = counts.withColumn("t", F.sum("c").over(W.partitionBy("key"))).join(prior, "tag", "left")
    weight = F.bround(0.1 * (F.col("c") + 1) / (F.col("t") + smooth) / F.greatest(F.lit(1e-6), F.coalesce("prior", F.lit(1e-4))), 0).cast("int")
    ranked = scored.withColumn("weight", weight).withColumn("rn", F.row_number().over(W.partitionBy("key").orderBy(F.desc("weight"), "tag")))
    return ranked.where(F.col("rn") <= top).select("key", "tag", "weight")


def citations(pieces: DataFrame, sources: DataFrame, similarity: Column, start: float = 0.63, floor: float = 0.3, most: int = 4) -> DataFrame:
    """(query, piece, key): up to ``most`` sources for each piece of an answer, those within a hundredth of the piece's best.

    A piece counts if 0.99 of its best reaches the threshold, which falls by a fifth until some piece of the answer counts; the passes are
    bounded by start and floor. pieces (query, piece, …) and sources (query, key, …) meet within their query; a source is cited once in an
    answer, at the first piece that would cite it."""
    rows = pieces.join(sources, "query").withColumn("sim", similarity)
    rows = rows.withColumns({"best": 0.99 * F.max("sim").over(W.partitionBy("query", "piece")), "top": 0.99 * F.max("sim").over(W.partitionBy("query"))})
    threshold = F.lit(None).cast("double")
    at = start
    while at > floor:
        threshold = F.coalesce(threshold, F.when(F.col("top") >= at, F.lit(at)))
        at *= 0.8
    near = rows.withColumn("limit", threshold).where((F.col("best") >= F.col("limit")) & (F.col("sim") > F.col("best")))
    cited = near.withColumn("rn", F.row_number().over(W.partitionBy("query", "piece").orderBy(F.desc("sim"), "key"))).where(F.col("rn") <= most)
    return cited.groupBy("query", "key").agg(F.min("piece").alias("piece")).select("query", "piece", "key")


def pack(rows: DataFrame, budget: int) -> DataFrame:
    """(query, key, place): rows that fit a budget of bytes, seeds first, then by (distance, rank); what doesn't fit is skipped.

    Greedy with skips is sequential, so a query's candidates (a bounded list by then) are packed in one group.
    rows (query, key, rank, distance, bytes)."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        kept, left = [], budget
        for r in group.sort_values(["distance", "rank", "key"], kind="stable").itertuples():
            if r.bytes <= left:
                kept.append((r.query, r.key))
                left -= r.bytes
        return pd.DataFrame([(q, k, i) for i, (q, k) in enumerate(kept)], columns=["query", "key", "place"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    return rows.groupBy("query").applyInPandas(run, f"query {kinds['query']}, key {kinds['key']}, place int")


def trim_messages(messages: list[dict], most: int, count=count_tokens) -> list[dict]:
    """Messages within a token budget: all if they fit, else the system message and the last one, the larger of the two cut
    (the last one where it has more than a fifth, the system message where it has four fifths and more)."""
    size = lambda ms: sum(count(m["content"]) for m in ms)
    if size(messages) <= most:
        return messages
    kept = [m for m in messages[:1] if m["role"] == "system"] + messages[-1:]
    kept = kept[-1:] if len(kept) == 2 and kept[0] is kept[1] else kept
    if size(kept) <= most or not kept:
        return kept

    def cut(text: str, tokens: int) -> str:
        spans = [m.end() for m in re.finditer(r"[^\W_]+|[^\w\s]", text)]
        return text if tokens >= len(spans) else text[: spans[tokens - 1]] if tokens > 0 else ""

    first, last = count(kept[0]["content"]), count(kept[-1]["content"])
    which = 0 if len(kept) == 2 and first / (first + last) > 0.8 else -1
    rest = first + last - count(kept[which]["content"]) if len(kept) == 2 else 0
    return [dict(m, content=cut(m["content"], most - rest)) if m is kept[which] else m for m in kept]


def valid_citations(answer: Column, sources: Column) -> Column:
    """Whether every [n] of an answer is a number from 1 to the number of sources."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: x.cast("int"))
    return F.coalesce(F.forall(numbers, lambda n: n.between(1, sources)), F.lit(False))


def repaired_citations(answer: Column) -> Column:
    """Spellings of a source mark brought to [ID:n], what a model thought aloud taken out."""
    out = F.regexp_replace(answer, r"(?is)<think>.*?</think>", "")
    return F.regexp_replace(out, r"(?i)[\[(【]\s*(?:id|ref|source)\s*[:：]?\s*(\d+)\s*[\])】]", "[ID:$1]")


def organisation_key(name: Column) -> Column:
    """A name for comparison: half width, lower case, without brackets, legal forms and marks."""
    from foliant.operators.text import half_width

    out = F.lower(half_width(name))
    out = F.regexp_replace(out, r"\([^)]*\)", " ")
    out = F.regexp_replace(out, r"(?:^|\s)(?:co|ltd|inc|corp|gmbh|ag|llc|plc|sa|srl|limited|company|corporation|group|holding|holdings)\b\.?", " ")
    out = F.regexp_replace(out, r"(주식회사|유한회사|株式会社|有限公司|股份|集团)", "")
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def dictionary_match(rows: DataFrame, key: str, text: str, entries: DataFrame) -> DataFrame:
    """(key, entry): the first entry (by place) that fits a text. An entry of ASCII letters, digits, dots, commas and blanks must be the whole
    text, any other may stand anywhere in it, one of less than three characters only in a text less than twice as long.

    The theta join becomes equi-joins: on the text, and on the first two characters of an entry against all pairs of the text.
    entries (entry, place); a text that is null matches nothing."""
    asked = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where(F.length("text") > 0)
    plain = F.col("entry").rlike("^[0-9a-zA-Z., ]+$")
    same = asked.join(entries.where(plain).withColumnRenamed("entry", "text"), "text").select("key", F.col("text").alias("entry"), "place")
    inner = entries.where(~plain & (F.length("entry") > 0)).withColumn("gram", F.substring("entry", 1, 2))
    grams = F.array_distinct(F.flatten(F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.array(F.substr("text", i, F.lit(1)), F.substr("text", i, F.lit(2))))))
    met = asked.withColumn("gram", F.explode(grams)).join(inner, "gram").where(F.col("text").contains(F.col("entry")))
    met = met.where((F.length("entry") >= 3) | (F.length("text") < 2 * F.length("entry"))).select("key", "entry", "place")
    return same.unionByName(met).groupBy("key").agg(F.min_by("entry", F.struct("place", "entry")).alias("entry"))


def overlapping_boxes(a: DataFrame, b: DataFrame, band: int = 64) -> DataFrame:
    """(a, b, area): for each box of a the box of b on its page that it shares the largest area with (ties by id).

    Boxes (id, page, x0, y0, x1, y1) meet by page and by bands of y, so no page is compared all with all."""
    bands = lambda: F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band)))
    left = a.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1")), "page", bands().alias("band"))
    right = b.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")), "page", bands().alias("band"))
    width = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0")
    height = F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    met = left.join(right, ["page", "band"]).where((width > 0) & (height > 0)).select("a_id", "b_id", (width * height).alias("area")).distinct()
    return met.groupBy(F.col("a_id").alias("a")).agg(F.min_by("b_id", F.struct((-F.col("area")).alias("area"), "b_id")).alias("b"), F.max("area").alias("area"))


def overlapping_boxes_within(boxes: DataFrame, band: int = 64) -> DataFrame:
    """(a, area): for each box the largest area that it shares with another box of its page; boxes that share none are left out."""
    bands = F.explode(F.sequence(F.floor(F.col("y0") / band), F.floor(F.col("y1") / band)))
    one = boxes.select(*(F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1")), "page", bands.alias("band"))
    two = boxes.select(*(F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")), "page", bands.alias("band"))
    width, height = F.least("a_x1", "b_x1") - F.greatest("a_x0", "b_x0"), F.least("a_y1", "b_y1") - F.greatest("a_y0", "b_y0")
    met = one.join(two, ["page", "band"]).where((F.col("a_id") != F.col("b_id")) & (width > 0) & (height > 0))
    return met.groupBy(F.col("a_id").alias("a")).agg(F.max(width * height).alias("area"))


def reading_order(boxes: DataFrame, tolerance: float) -> DataFrame:
    """boxes with place: by page, rows of y within the tolerance, then x."""
    row = F.floor(F.col("y0") / tolerance)
    return boxes.withColumn("place", F.row_number().over(W.partitionBy("page").orderBy(row, "x0", "y0", "id")))


def merge_metadata(old: Column, new: Column) -> Column:
    """Two maps of string lists: lists are joined, each value once; keys of either side stay."""
    return F.map_zip_with(old, new, lambda k, a, b: F.array_distinct(F.concat(F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>")))))


def edit_metadata(meta: Column, key: str, remove: list[str] | None = None, replace: dict[str, str] | None = None, add: list[str] | None = None) -> Column:
    """A map of string lists with values of one key removed, replaced and added; keys without values fall out."""

    def swap(values: Column, old: str, new: str) -> Column:
        return F.transform(values, lambda v: F.when(v == old, new).otherwise(v))

    def change(k: Column, values: Column) -> Column:
        out = values
        for old, new in (replace or {}).items():
            out = swap(out, old, new)
        for gone in remove or []:
            out = F.array_remove(out, gone)
        if add:
            out = F.concat(out, F.array(*map(F.lit, add)))
        return F.when(k == key, F.array_distinct(out)).otherwise(values)

    return F.map_filter(F.transform_values(meta, change), lambda k, v: F.size(v) > 0)


def _json_udf(change):
    """A string function of JSON texts in Arrow batches; what is no JSON object counts as an empty one."""
    import json

    def read(text: str | None) -> dict:
        try:
            value = json.loads(text) if text else {}
        except ValueError:
            value = {}
        return value if isinstance(value, dict) else {}

    @F.pandas_udf(T.StringType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([json.dumps(change(read(x), y), ensure_ascii=False) for x, y in zip(a, b, strict=True)], dtype=object)

    return run, read


def with_path(meta: Column, path: list[str], value: Column) -> Column:
    """A JSON object with a string value under a path of names; what is missing on the way is made, what is no object replaced."""

    def change(whole: dict, new: str | None) -> dict:
        at = whole
        for name in path[:-1]:
            if not isinstance(at.get(name), dict):
                at[name] = {}
            at = at[name]
        at[path[-1]] = new
        return whole

    return _json_udf(change)[0](meta, value)


def deep_merged(old: Column, new: Column) -> Column:
    """Two JSON objects: objects under the same name are merged, other values are those of the second."""

    def merge(a: dict, b: dict) -> dict:
        return a | {k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}

    run, read = _json_udf(lambda a, b: merge(a, read(b)))
    return run(old, new)


def parse_features(texts: Iterator[str | None]) -> list[dict[str, float]]:
    """Tag features from JSON or Python literals; what isn't a finite number under a name is left out."""
    import ast
    import json
    import math

    out = []
    for t in texts:
        value: object = None
        for read in (json.loads, ast.literal_eval):
            try:
                value = read(t) if isinstance(t, str) else t
                break
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError):
                continue
        pairs = value.items() if isinstance(value, dict) else []
        out.append({str(k).strip(): float(v) for k, v in pairs if str(k).strip() and isinstance(v, (int, float)) and not isinstance(v, bool) and math.isfinite(v)})
    return out
