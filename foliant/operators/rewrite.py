"""Questions to weighted query terms: a table of questions becomes a table of (term, weight) rows of several kinds.

A question is made plain (half width, lower case, blanks between scripts, reserved signs and filler out) and read by words or,
where words have no borders, by pieces. Weights of terms depend on their form and length alone, as the dictionaries of the
engine this follows are not public: unknown parts of speech and names count 1. All of it are JVM expressions;
synonyms come as a table.

Cases: null, empty and blank questions have no rows. A term that comes twice keeps both rows with their places.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.operators import retrieval as V
from foliant.operators import text as X

#: Fixed value: signs of a question that count as blanks.
SIGNS = r"""[ :|\r\n\t,，。？?/`!！&^%()\[\]{}<>*~'"\\]+"""
#: Words of a piece that are left out.
STOP_WORDS = ["请问", "您", "你", "我", "他", "是", "的", "就", "有", "于", "及", "即", "在", "为", "最", "从", "以", "了", "将", "与", "吗", "吧", "中", "#", "什么", "怎么", "哪个", "哪些", "啥", "相关"]
#: At most so many terms and pieces have synonyms, so many synonyms each, so many terms of a paragraph count.
MOST_TERMS, MOST_SYNONYMS, PARAGRAPH_TERMS = 256, 8, 30
#: Korean endings and question words that carry no topic.
PARTICLES = "(?:에서는|에서|으로|에게|까지|부터|에는|은|는|을|를|과|와)$"
ASKING = ["어디", "어떤", "어떻게", "어느", "무슨", "어디서", "대한"]
VERB_ENDINGS = ["나요", "니까", "세요", "할", "하려면"]
#: Fixed value: how a question names a document before its topic.
TITLE_TOPIC = r"^(.{3,60}?)(?:에서(?:는)?\s+|\s+(?:문서|자료|파일|보고서)(?:를|을|에서|의|에)?\s+|\s+기준으로\s+)(.+)$"
TOPIC_OPENING = r"^(?:보면|따르면|나오는|나온)\s+"
MOST_TITLES = 16
_WEIGHTED = "array<struct<term:string,weight:double>>"


def plain_question(c: Column) -> Column:
    han = r"\x{4e00}-\x{9fa5}"
    spaced = F.regexp_replace(F.regexp_replace(c, rf"([A-Za-z][0-9]*)([{han}])", "$1 $2"), rf"([{han}])([A-Za-z])", "$1 $2")
    return F.trim(F.regexp_replace(X.half_width(F.lower(spaced)), SIGNS, " "))


def term_weight(t: Column) -> Column:
    """The weight of a term by itself: rarity by its assumed frequencies, times what kind of term it is."""
    number = t.rlike(r"^[0-9. \-]{2,}$")
    guess = X.oov_frequency(t)
    rarity = lambda n, s: F.log10(10 + (n - s + 0.5) / (s + 0.5))
    common = rarity(F.lit(1e7), F.when(number, 3).otherwise(F.coalesce(guess, F.lit(10))))
    spread = rarity(F.lit(1e9), F.when(number, 5).otherwise(F.coalesce(guess, F.lit(3))))
    kind = F.when(t.rlike("^[0-9,.]{2,}$"), 2.0).when(t.rlike("^[a-z]{1,2}$"), 0.01).otherwise(1.0)
    return (0.3 * common + 0.7 * spread) * kind * F.when(t.rlike("^[0-9-]"), 2.0).otherwise(1.0)


def settled(df: DataFrame, **columns: Column) -> DataFrame:
    """df with further columns that are worked out once, wherever they are used: the optimizer doesn't copy what a generator yields."""
    return df.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


def weighted(df: DataFrame, words: Column) -> DataFrame:
    """df with w, the (term, weight) of an array of terms, the weights of all summing to 1."""
    raw = settled(df, _raw=F.transform(words, lambda t: F.struct(t.alias("term"), term_weight(t).alias("weight"))))
    raw = settled(raw, _total=F.aggregate("_raw", F.lit(0.0), lambda s, x: s + x["weight"]))
    w = F.transform("_raw", lambda x: F.struct(x["term"].alias("term"), (x["weight"] / F.col("_total")).alias("weight")))
    return settled(raw, w=F.coalesce(w, F.array().cast(_WEIGHTED))).drop("_raw", "_total")


def _read(questions: DataFrame, key: str, text: str, characters: bool) -> DataFrame:
    """(key, q): plain questions without question words, of those that are read by characters or by words."""
    plain = settled(questions.select(F.col(key).alias("key"), plain_question(F.col(text)).alias("p")), once=X.without_question_words(F.col("p")))
    side = X.by_characters(F.col("once"))
    return settled(plain.where(side if characters else ~side), q=X.without_question_words(F.col("once"))).select("key", "q")


def _with_synonyms(rows: DataFrame, synonyms: DataFrame | None, share: float, kind: str) -> DataFrame:
    """Rows of the synonyms (term, synonym, place) of term rows, the first MOST_SYNONYMS by place, at a share of the weight."""
    if synonyms is None:
        return rows.limit(0)
    first = synonyms.withColumn("_n", F.row_number().over(W.partitionBy("term").orderBy("place", "synonym"))).where(F.col("_n") <= MOST_SYNONYMS)
    said = rows.withColumnRenamed("text", "term").join(first.select("term", "synonym"), "term")
    return said.select("key", "at", F.lit(kind).alias("kind"), F.col("synonym").alias("text"), (F.col("weight") * share).alias("weight"))


def word_query(questions: DataFrame, key: str, text: str, synonyms: DataFrame | None = None) -> DataFrame:
    """(key, at, kind, text, weight) of questions that are read by words: terms, synonyms at a quarter of their term's weight, and phrases
    of neighbours at twice the greater weight of the two."""
    w = weighted(_read(questions, key, text, False), V.tokens(F.col("q"))).select("key", "w")
    terms = w.select("key", F.posexplode("w").alias("at", "x")).where(F.col("at") < MOST_TERMS).select("key", "at", F.lit("term").alias("kind"), F.col("x.term").alias("text"), F.col("x.weight").alias("weight"))
    two = F.when(
        F.size("w") > 1,
        F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.concat_ws(" ", F.get("w", i - 1)["term"], F.get("w", i)["term"]).alias("text"), (2 * F.greatest(F.get("w", i - 1)["weight"], F.get("w", i)["weight"])).alias("weight"))),
    )
    phrases = w.select("key", F.posexplode(two).alias("at", "x")).select("key", "at", F.lit("phrase").alias("kind"), "x.text", "x.weight")
    return terms.unionByName(_with_synonyms(terms, synonyms, 0.25, "synonym")).unionByName(phrases)


def pieces(q: Column) -> Column:
    """The blank-separated pieces of a plain question; neighbours that end in Latin letters are one piece."""

    def add(done: Column, word: Column) -> Column:
        joins = (F.size(done) > 0) & F.element_at(done, -1).rlike("[a-zA-Z]$") & word.rlike("[a-zA-Z]$")
        return F.when(joins, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(F.concat_ws(" ", F.element_at(done, -1), word)))).otherwise(F.concat(done, F.array(word)))

    words = F.filter(F.split(q, r"\s+"), lambda x: x != "")
    # an element_at of an empty array is an error even where the condition is false, so the fold starts with the first word
    return F.when(F.size(words) > 0, F.aggregate(F.slice(words, 2, 1_000_000), F.slice(words, 1, 1), add)).otherwise(F.array().cast("array<string>"))


def fine_grained(term: Column) -> Column:
    """The parts of a long term of a script without word borders: its pairs of neighbouring characters."""
    return F.when((F.length(term) >= 3) & ~term.rlike(r"^[0-9a-z.+#_*\-]+$"), F.transform(F.sequence(F.lit(1), F.length(term) - 1), lambda i: F.substr(term, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def piece_query(questions: DataFrame, key: str, text: str, synonyms: DataFrame | None = None) -> DataFrame:
    """(key, at, kind, text, weight) of questions that are read by pieces: terms; the parts of long terms in a row (exact) and at most
    two places apart (near, half the weight); whole pieces of several terms, near, at 1.5; synonyms of terms at a fifth. Where a piece
    itself has synonyms, they count 0.7 and all else of that piece five times."""
    cut = _read(questions, key, text, True).select("key", F.posexplode(pieces(F.col("q"))).alias("at", "piece")).where(F.col("at") < MOST_TERMS)
    words = F.filter(V.tokens(F.col("piece")), lambda t: ~t.isin(STOP_WORDS))
    w = weighted(cut, words).where("size(w) > 0")
    terms = w.select("key", "at", "piece", F.explode("w").alias("x")).select("key", "at", "piece", F.col("x.term").alias("text"), F.col("x.weight").alias("weight"))
    parts = terms.withColumn("parts", fine_grained(F.col("text"))).where("size(parts) > 0").withColumn("text", F.array_join("parts", " "))
    rows = terms.select("key", "at", F.lit("term").alias("kind"), "text", "weight")
    rows = rows.unionByName(parts.select("key", "at", F.lit("exact").alias("kind"), "text", "weight")).unionByName(parts.select("key", "at", F.lit("near").alias("kind"), "text", (F.col("weight") * 0.5).alias("weight")))
    rows = rows.unionByName(_with_synonyms(terms.select("key", "at", F.lit("term").alias("kind"), "text", "weight"), synonyms, 0.2, "synonym"))
    rows = rows.unionByName(w.where("size(w) > 1").select("key", "at", F.lit("piece").alias("kind"), F.array_join(F.transform("w", lambda x: x["term"]), " ").alias("text"), F.lit(1.5).alias("weight")))
    if synonyms is None:
        return rows
    known = synonyms.groupBy(F.col("term").alias("piece")).agg(F.lit(True).alias("said"))
    heavier = cut.join(known, "piece").select("key", "at", "said")
    rows = rows.join(heavier, ["key", "at"], "left").select("key", "at", "kind", "text", (F.col("weight") * F.when(F.col("said"), 5.0).otherwise(1.0)).alias("weight"))
    whole = cut.select("key", "at", F.lit("piece").alias("kind"), F.col("piece").alias("text"), F.lit(1.0).alias("weight"))
    return rows.unionByName(_with_synonyms(whole, synonyms, 0.7, "piece_synonym"))


def rewritten(questions: DataFrame, key: str, text: str, synonyms: DataFrame | None = None) -> DataFrame:
    """(key, at, kind, text, weight) of all questions, each read its own way."""
    return word_query(questions, key, text, synonyms).unionByName(piece_query(questions, key, text, synonyms))


def scoring_terms(rewritten_: DataFrame) -> DataFrame:
    """(query, term, weight) for lexical scoring: terms, synonyms and phrases; rows of several words are phrases."""
    return rewritten_.where("kind in ('term', 'synonym', 'piece_synonym', 'phrase')").groupBy(F.col("key").alias("query"), F.col("text").alias("term")).agg(F.sum("weight").alias("weight"))


def paragraph_query(texts: DataFrame, key: str, text: str, keywords: int = PARAGRAPH_TERMS) -> DataFrame:
    """(key, term, weight, required): the heaviest terms of a paragraph and how many of them a match needs."""
    sorted_ = F.array_sort(F.transform("w", lambda x: F.struct((-x["weight"]).alias("less"), x["term"].alias("term"))))
    best = F.transform(F.slice(sorted_, 1, keywords), lambda x: F.struct(x["term"].alias("term"), (-x["less"]).alias("weight")))
    rows = settled(weighted(texts.select(F.col(key).alias("key"), F.col(text).alias("text")), V.tokens(F.col("text"))), best=best).select("key", F.col("best").alias("w"))
    return rows.select("key", F.explode("w").alias("x"), F.least(F.lit(3), F.bround(F.size("w") / 10, 0).cast("int")).alias("required")).select("key", "x.term", "x.weight", "required")


def korean_body_terms(question: Column) -> Column:
    """Up to 32 topic words of a Korean question for a search in bodies; empty below three words or without Hangul."""
    words = F.transform(F.regexp_extract_all(question, F.lit(r"([가-힣]+|[A-Za-z0-9][A-Za-z0-9.+#_-]*)"), F.lit(1)), lambda w: F.regexp_replace(w, PARTICLES, ""))
    topic = F.filter(words, lambda w: (F.length(w) >= 2) & ~w.isin(ASKING) & ~w.rlike("(?:" + "|".join(VERB_ENDINGS) + ")$"))
    joined = F.array_join(F.slice(topic, 1, 32), " ")
    return F.coalesce(F.when((F.size(topic) >= 3) & joined.rlike("[가-힣]"), joined), F.lit(""))


def title_topics(questions: DataFrame, key: str, text: str, documents: DataFrame, document: str, name: str) -> DataFrame:
    """(key, topic, document): the documents whose names hold the title that a question speaks of, and what it asks of them; questions
    whose title fits more than MOST_TITLES documents are left out. A title meets the names by its first three letters."""
    from foliant.functions.normalise import folded_udf

    compact = lambda c: F.regexp_replace(folded_udf(c), r"(?U)\s+", "")
    asked = questions.select(F.col(key).alias("key"), F.trim(F.col(text), F.lit(X.BLANKS)).alias("q")).where(F.col("q").rlike(TITLE_TOPIC))
    asked = asked.select("key", F.regexp_extract("q", TITLE_TOPIC, 1).alias("fragment"), F.trim(F.regexp_replace(F.regexp_extract("q", TITLE_TOPIC, 2), TOPIC_OPENING, "")).alias("topic"))
    asked = asked.select("key", "topic", compact(F.col("fragment")).alias("fragment")).where((F.length("fragment") >= 3) & (F.length("topic") >= 4)).withColumn("gram", F.substring("fragment", 1, 3))
    names = documents.select(F.col(document).alias("document"), compact(F.col(name)).alias("name")).where(F.length("name") >= 3).distinct()
    grams = names.withColumn("gram", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("name") - 2), lambda i: F.substr("name", i, F.lit(3))))))
    met = asked.join(grams, "gram").where(F.col("name").contains(F.col("fragment"))).select("key", "topic", "document").distinct()
    few = met.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= MOST_TITLES)
    return met.join(few.select("key"), "key", "left_semi")
