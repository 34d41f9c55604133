"""Small text expressions shared by the operators."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = " \t\r\n"


def canonical_label(column: str) -> Column:
    """Trimmed, in lower case, with blanks and hyphens as underscores."""
    return F.regexp_replace(F.lower(F.trim(F.col(column))), r"[\s\-]+", "_")


def newlines(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n?", "\n")


def sentences(c: Column) -> Column:
    """Pieces up to and with a sentence mark or line end, white space around them cut, empty ones dropped."""
    parts = F.regexp_extract_all(c, F.lit(r"([^.。！？!?；;：:\n]*[.。！？!?；;：:\n]|[^.。！？!?；;：:\n]+$)"), F.lit(1))
    return F.filter(F.transform(parts, lambda p: F.trim(p, F.lit(BLANKS))), lambda p: p != "")


def multi_values(c: Column) -> Column:
    """Values of a field that lists several, each once."""
    return F.array_distinct(F.filter(F.transform(F.split(c, r"[、,，;；|]+"), lambda p: F.trim(p, F.lit(BLANKS))), lambda p: p != ""))


#: Question words and filler of three kinds, and what each is replaced by.
QUESTION_WORDS = [
    (r"是*(怎么办|什么样的|哪家|一下|那家|请问|啥样|咋样了|什么时候|何时|何地|何人|是否|是不是|多少|哪里|怎么|哪儿|怎么样|如何|哪些|是啥|啥是|啊|吗|呢|吧|咋|什么|有没有|呀|谁|哪位|哪个)是*", ""),
    (r"(^| )(what|who|how|which|where|why)('re|'s)? ", " "),
    (r"(^| )('s|'re|is|are|were|was|do|does|did|don't|doesn't|didn't|has|have|be|there|you|me|your|my|mine|just|please|may|i|should|would|wouldn't|will|won't|done|go|for|with|so|the|a|an|by|i'm|it's|he's|she's|they|they're|you're|as|by|on|in|at|up|out|down|of|to|or|and|if) ", " "),
]
#: Fixed value: characters that a query string reserves.
RESERVED = r"([:{}/\[\]\-*?\"\(\)|+~^])"


def without_question_words(c: Column) -> Column:
    """A query without question words and filler; the query itself if nothing at all is left."""
    bare = c
    for pattern, instead in QUESTION_WORDS:
        bare = F.regexp_replace(bare, f"(?i){pattern}", instead)
    return F.when(bare == "", c).otherwise(bare)


def by_characters(c: Column) -> Column:
    """Whether a query is read as a script without word borders: up to three words, or seven tenths of them not plain letters."""
    words = F.split(c, r"[ \t]+")
    return (F.size(words) <= 3) | (F.size(F.filter(words, lambda w: ~w.rlike("^[a-zA-Z]+$"))) / F.size(words) >= 0.7)


def is_english(pieces: Column) -> Column:
    """Whether more than eight tenths of the pieces that aren't blank are of ASCII letters, digits and common marks."""
    some = F.filter(F.transform(pieces, lambda p: F.trim(p, F.lit(BLANKS))), lambda p: p != "")
    plain = F.filter(some, lambda p: p.rlike(r"""^[`a-zA-Z0-9\s.,':;/"?<>!\(\)\-]+$"""))
    return F.coalesce(F.size(plain) / F.nullif(F.size(some), F.lit(0)) > 0.8, F.lit(False))


def is_han(c: Column) -> Column:
    """Whether more than a fifth of the characters are Han."""
    return F.coalesce(share_of(c, r"[\x{4e00}-\x{9fff}]") > 0.2, F.lit(False))


def without_fence(c: Column) -> Column:
    """A text without the Markdown fence around it."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"^\s*```markdown\s*\n?", ""), r"\n?\s*```\s*$", ""), F.lit(BLANKS))


def is_blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c, F.lit(BLANKS)) == "")


def between(c: Column, start: str, end: str) -> Column:
    """What stands between two tags, the shortest stretches, over line ends too."""
    quoted = (re.escape(x) for x in (start, end))
    return F.regexp_extract_all(c, F.lit("(?s){}(.*?){}".format(*quoted)), F.lit(1))


def keyword_terms(c: Column, most_bytes: int = 32_766) -> Column:
    """Keywords listed in a text, each trimmed and once, long ones cut at the last character that fits so many bytes."""
    steps = F.array(*(F.lit(1 << i) for i in range(most_bytes.bit_length() - 1, -1, -1)))

    def fits(t: Column) -> Column:
        """The longest beginning that fits, found bit by bit."""
        length = F.aggregate(steps, F.lit(0), lambda n, step: F.when(F.octet_length(F.substr(t, F.lit(1), n + step)) <= most_bytes, n + step).otherwise(n))
        return F.substr(t, F.lit(1), length)

    listed = F.transform(F.split(c, r"[,，;；、\r\n]+"), lambda t: F.trim(t, F.lit(BLANKS)))
    return F.array_distinct(F.filter(F.transform(listed, lambda t: F.when(F.octet_length(t) <= most_bytes, t).otherwise(F.rtrim(fits(t)))), lambda t: t != ""))


def image_links(c: Column) -> Column:
    """(line, url) of the images of a text, Markdown and HTML, each pair once; lines count from 0."""
    lines = F.split(c, r"\r\n|\r|\n")
    markdown, html = F.lit(r"!\[[^\]]*\]\(([^)\s]+)"), F.lit(r"""(?i)src=["']([^"'>\s]+)""")

    def found(line: Column, at: Column) -> Column:
        urls = F.concat(F.regexp_extract_all(line, markdown, F.lit(1)), F.regexp_extract_all(line, html, F.lit(1)))
        return F.transform(urls, lambda u: F.struct(at.alias("line"), u.alias("url")))

    return F.array_distinct(F.flatten(F.transform(lines, found)))


def spaced_scripts(c: Column) -> Column:
    """A blank between Latin letters or digits and CJK characters."""
    out = F.regexp_replace(c, r"([A-Za-z0-9])([一-龥가-힣])", "$1 $2")
    return F.regexp_replace(out, r"([一-龥가-힣])([A-Za-z0-9])", "$1 $2")


def escaped(c: Column) -> Column:
    """The characters that a query string reserves with a backslash; single quotes are taken out."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "'", ""), RESERVED, r"\\$1"), F.lit(BLANKS))


def tight_punctuation(c: Column) -> Column:
    """No blank after an opening and before a closing mark."""
    return F.regexp_replace(F.regexp_replace(c, r"([(\[{]) +", "$1"), r" +([)\]},.;:!?])", "$1")


def without_tables(c: Column) -> Column:
    return F.regexp_replace(c, r"(?i)</?(table|td|caption|tr|th)( [^<>]{0,12})?>", " ")


def share_of(c: Column, pattern: str) -> Column:
    """Share of the characters that match."""
    return F.regexp_count(c, F.lit(pattern)) / F.nullif(F.length(c), F.lit(0))


def links(c: Column) -> Column:
    """Addresses in a text, each once."""
    return F.array_distinct(F.regexp_extract_all(c, F.lit(r"(https?://[^\s)\]>\"']+)"), F.lit(1)))


def highlight(c: Column, words: list[str]) -> Column:
    """Sentences with a hit, joined by "...", the hits in <em>."""
    pattern = r"(?i)(^|[^\p{L}\p{N}])(" + "|".join(words) + r")(?=$|[^\p{L}\p{N}])"
    hit = F.filter(sentences(c), lambda p: p.rlike(pattern))
    return F.array_join(F.transform(hit, lambda p: F.regexp_replace(p, pattern, "$1<em>$2</em>")), "...")


def highlighted(c: Column, words: Column) -> Column:
    """The sentences with a hit of words (a column of alternatives, letters and digits between bars), the hits in <em>."""
    pattern = F.concat(F.lit(r"(?iu)(^|[^\p{L}\p{N}])("), words, F.lit(r")(?=$|[^\p{L}\p{N}])"))
    hit = F.filter(sentences(c), lambda p: F.rlike(p, pattern))
    return F.transform(hit, lambda p: F.regexp_replace(p, pattern, F.lit("$1<em>$2</em>")))


def parsed_vector(c: Column) -> Column:
    """Numbers between tabs; null where there is none."""
    return F.transform(F.split(c, "\t"), lambda x: x.try_cast("double"))


def half_width(c: Column) -> Column:
    """Full-width forms of ASCII as ASCII, the ideographic blank as a blank."""
    wide = "".join(chr(x) for x in range(0xFF01, 0xFF5F)) + "　"
    return F.translate(c, wide, "".join(chr(x) for x in range(0x21, 0x7F)) + " ")


def oov_frequency(c: Column) -> Column:
    """Assumed frequency of a term outside the dictionary: 300 up to three letters, halved every two more, 10 at least; null for a
    term without letters or with anything but Latin, Greek and Cyrillic letters, blanks, dots and hyphens."""
    letters = F.length(F.regexp_replace(c, r"[ .\-]", ""))
    guess = F.bround(300 / F.pow(F.lit(2.0), F.greatest(letters - 3, F.lit(0)) / 2), 0)
    return F.when(c.rlike(r"^(?:[ .\-]|(?=\p{L})[\p{IsLatin}\p{IsGreek}\p{IsCyrillic}])+$") & (letters > 0), F.greatest(F.lit(10), guess.cast("int")))


def canonical_hash(*columns: str) -> Column:
    """SHA-256 of the columns as compact JSON with sorted keys, nulls included."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def bucket(c: Column, modulus: int = 10**8) -> Column:
    """SHA-1 of a text as a number modulo so many, eight hex digits at a time."""
    digest, out = F.sha1(c.cast("binary")), F.lit(0).cast("bigint")
    for at in range(1, 41, 8):
        out = (out * (1 << 32) + F.conv(F.substring(digest, at, 8), 16, 10).cast("bigint")) % modulus
    return out


def joined_id(*columns: Column) -> Column:
    return F.sha2(F.concat_ws("\u001f", *columns), 256)


def pretty_bytes(c: Column) -> Column:
    """A number of bytes with its unit: three digits that count."""
    units = ["B", "KB", "MB", "GB", "TB", "PB"]
    out = F.lit(None).cast("string")
    for i in range(len(units) - 1, -1, -1):
        size = (c / float(1024**i)).cast("double")
        shown = F.when((size >= 100) | F.lit(i == 0), F.format_string("%.0f", F.bround(size, 0))).when(size >= 10, F.format_string("%.1f", F.bround(size, 1))).otherwise(F.format_string("%.2f", F.bround(size, 2)))
        written = F.concat(shown, F.lit(f" {units[i]}"))
        out = written if i == len(units) - 1 else F.when(c < 1024 ** (i + 1), written).otherwise(out)
    return out


def safe_float(c: Column) -> Column:
    return F.coalesce(c.try_cast("double"), F.lit(float("-inf")))


def overlap_percent(c: Column) -> Column:
    """A share up to 1 means percent times 100; the result lies in 0 to 90."""
    x = F.coalesce(c.try_cast("double"), F.lit(0.0))
    return F.least(F.greatest(F.when((x > 0) & (x < 1), x * 100).otherwise(x), F.lit(0.0)), F.lit(90.0)).cast("int")


def months_between_years(start: Column, end: Column, now: str) -> Column:
    """Whole months from start to end (an open end is now) in years, one decimal; not positive is 0."""
    last = F.coalesce(end, F.to_timestamp(F.lit(now)))
    months = (F.year(last) - F.year(start)) * 12 + F.month(last) - F.month(start)
    return F.when(months > 0, F.bround(months / 12, 1)).otherwise(F.lit(0.0))


def cell_bool(c: Column) -> Column:
    word = F.lower(F.trim(c))
    return F.when(word.isin("true", "yes", "是", "*", "✓", "✔", "☑", "✅", "√"), True).when(word.isin("false", "no", "否", "⍻", "×"), False)


def mixed_vectors(title: Column, content: Column, weight: float = 0.1) -> Column:
    """weight * title + (1 - weight) * content; a weight of 0 means the usual 0.1."""
    w = weight or 0.1
    return F.zip_with(title, content, lambda a, b: w * a + (1 - w) * b)


def valid_vector(c: Column, width: int) -> Column:
    return F.coalesce((F.size(c) == width) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def weighted_tokens(content: Column, title: Column, keywords: Column, questions: Column) -> Column:
    """Content terms once, title terms twice, keywords five and question terms six times."""
    return F.concat(F.array_distinct(content), F.flatten(F.array_repeat(title, 2)), F.flatten(F.array_repeat(keywords, 5)), F.flatten(F.array_repeat(questions, 6)))
