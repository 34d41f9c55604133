"""Mixing sources to target weights, repeating small sources a capped number of times.

Sizes are tokens of a public vocabulary. Without given targets the weights are those of temperature mixing: token
shares to the power of an exponent, found by bisection so that the weights have a wanted entropy, or as near to it as
the repetition limits allow. One exponent cannot meet nine given shares, so with given targets the same bisection runs
over the common scale of the targets: every source gets the scaled target or its limit, whichever is less, and the
sum is the wanted size. That is the mix nearest to the targets: no source below its limit is short of what a source at
its limit leaves over in proportion.

A source's budget is realised as block permutations: whole passes over its documents, each in an order of its own,
then a part of one more pass that ends at the document nearest to what is left. The running sums of the last pass come
in two levels, over a fixed number of hash buckets of each source and inside each bucket, so that no source, however
large, is sorted in one task.

Cases: sources are compared trimmed, in lower case, with blanks and hyphens as underscores; documents of no or of an
unlisted source count for the size of the corpus and are never drawn. Texts without tokens are never drawn. A listed
source without documents gets nothing and its share goes to the others. Null limits mean no repetition (1), null or
negative targets 0. If all limits together are below the wanted size, every source is used up to its limit.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foliant.llm.encoding import TOKENIZERS, encode_column
from foliant.session import cut

#: Hash buckets of each source for the two-level running sums: at least so many, and as many as keep them to this many documents.
BUCKETS, BUCKET_DOCS = 1024, 20_000
#: Rows (source and bucket) up to which the running sums are broadcast.
BROADCAST_ROWS = 500_000


def canonical(source: str) -> Column:
    return F.regexp_replace(F.lower(F.trim(F.col(source))), r"[\s\-]+", "_")


def entropy(weights: dict[str, float]) -> float:
    return -sum(w * math.log(w) for w in weights.values() if w > 0)


def temperature(sizes: dict[str, float], limits: dict[str, float] | None = None, wanted_entropy: float | None = None) -> tuple[float, dict[str, float]]:
    """(exponent, weights): sizes ** exponent, normalised; exponent 1 is natural, 0 uniform.

    The exponent is bisected down from 1 until the entropy is reached or a source's weight times the whole size would
    go beyond its limit (repetitions times its size).
    """
    whole = sum(sizes.values())
    shares = {s: n / whole for s, n in sizes.items() if n > 0}

    def weights(x: float) -> dict[str, float]:
        raw = {s: p**x for s, p in shares.items()}
        total = sum(raw.values())
        return {s: w / total for s, w in raw.items()}

    def allowed(x: float) -> bool:
        w = weights(x)
        enough = wanted_entropy is None or entropy(w) <= wanted_entropy
        return enough and all(w[s] * whole <= (limits or {}).get(s, math.inf) * sizes[s] * (1 + 1e-12) for s in w)

    if not shares:
        return 1.0, {}
    low, high = 0.0, 1.0  # allowed at high, or nothing is
    if allowed(low):
        return low, weights(low)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if allowed(mid) else (mid, high)
    return high, weights(high)


def budgets(sizes: dict[str, int], targets: dict[str, float], limits: dict[str, float], wanted: float) -> dict[str, float]:
    """Tokens for each listed source: min(scale * target, limit), the scale bisected so that they sum to ``wanted``."""
    most = {s: limits[s] * sizes.get(s, 0) for s in targets}

    def at(scale: float) -> dict[str, float]:
        return {s: min(scale * t, most[s]) for s, t in targets.items()}

    open_ = sum(m for s, m in most.items() if targets[s] > 0)
    if open_ <= wanted:
        return {s: most[s] if targets[s] > 0 else 0.0 for s in targets}
    low, high = 0.0, max(m / targets[s] for s, m in most.items() if targets[s] > 0)
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(at(mid).values()) < wanted else (low, mid)
    return at(high)


def sized(documents: DataFrame, vocabulary: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, source, tokens), the source in its canonical spelling."""
    slim = documents.select(F.struct("doc_id", canonical("source").alias("source")).alias("row"), "text")
    return encode_column(slim, "row", "text", vocabulary, folder, counts_only=True).select("row.doc_id", "row.source", "tokens")


def plan(sizes: DataFrame, mix_targets: DataFrame) -> tuple[dict[str, dict], int]:
    """What each listed source has, may give and shall give, and the size of the corpus. Both tables come down to one
    row for each source here, and only these rows reach the driver."""
    totals = {r["source"]: r for r in sizes.groupBy("source").agg(F.sum("tokens").alias("tokens"), F.count_if(F.col("tokens") > 0).alias("docs")).join(
        F.broadcast(mix_targets.select(canonical("source").alias("source")).distinct()), "source", "left_semi").collect()}
    corpus = sizes.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("n")).first()["n"]
    wanted = mix_targets.where(F.col("source").isNotNull()).groupBy(canonical("source").alias("source")).agg(F.max("target_share").alias("t"), F.max("max_repeats").alias("r")).collect()
    targets = {r["source"]: max(0.0, r["t"] or 0.0) for r in wanted}
    limits = {r["source"]: 1 if r["r"] is None else max(0, r["r"]) for r in wanted}
    have = {s: int(totals[s]["tokens"] or 0) if s in totals else 0 for s in targets}
    give = budgets(have, targets, limits, corpus)
    rows = {
        s: {"target_share": targets[s], "max_repeats": limits[s], "docs": totals[s]["docs"] if s in totals else 0, "tokens": have[s], "budget": give[s],
            "passes": int(give[s] // have[s] + 1e-9) if have[s] else 0}
        for s in targets
    }
    return rows, corpus


def select(sizes: DataFrame, rows: dict[str, dict], seed: int = 0, buckets: int | None = None) -> DataFrame:
    """(doc_id, source, tokens, pass, position): one row for each use of a document; within a source and pass,
    position orders the documents."""
    spark = sizes.sparkSession
    if buckets is None:
        largest = max((r["docs"] for r in rows.values()), default=0)
        buckets = max(BUCKETS, 1 << (largest // BUCKET_DOCS).bit_length())
    fixed = spark.createDataFrame(
        [(s, r["passes"], float(r["budget"] - r["passes"] * r["tokens"])) for s, r in rows.items()], "source string, passes int, left double"
    )
    order = F.xxhash64(F.col("doc_id"), F.col("passes"), F.lit(seed))
    placed = sizes.where("tokens > 0").join(F.broadcast(fixed), "source").withColumn("order", order)
    placed = placed.withColumn("bucket", F.shiftrightunsigned(F.col("order"), 64 - int(math.log2(buckets))) if buckets > 1 else F.lit(0))
    by_bucket = placed.groupBy("source", "bucket").agg(F.sum("tokens").alias("in_bucket"))
    before = W.partitionBy("source").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    by_bucket = by_bucket.select("source", "bucket", F.coalesce(F.sum("in_bucket").over(before), F.lit(0)).alias("before"))
    # at most sources x buckets rows
    joined = placed.join(F.broadcast(by_bucket) if len(rows) * buckets <= BROADCAST_ROWS else by_bucket, ["source", "bucket"])
    unsigned = F.shiftrightunsigned(F.col("order"), 1)
    running = W.partitionBy("source", "bucket").orderBy(unsigned, "order", "doc_id").rowsBetween(W.unboundedPreceding, -1)
    start = F.col("before") + F.coalesce(F.sum("tokens").over(running), F.lit(0))
    part = joined.withColumn("extra", (start + F.col("tokens") / 2 <= F.col("left")).cast("int"))
    uses = F.col("passes") + F.col("extra")
    drawn = part.where(uses > 0).select("doc_id", "source", "tokens", F.explode(F.sequence(F.lit(1), uses)).alias("pass"))
    return drawn.withColumn("position", F.xxhash64("doc_id", F.col("pass") - 1, F.lit(seed)))


def mix(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, **vocabulary: str) -> DataFrame:
    """(doc_id, source, tokens, pass, position) of the selection."""
    sizes = cut(sized(documents, **vocabulary))
    return select(sizes, plan(sizes, mix_targets)[0], seed)


def report(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, **vocabulary: str) -> DataFrame:
    """One row for each listed source: what it has, its target, its plan and the share really reached."""
    sizes = cut(sized(documents, **vocabulary))
    rows, corpus = plan(sizes, mix_targets)
    drawn = select(sizes, rows, seed).groupBy("source").agg(F.sum("tokens").alias("drawn"), F.count(F.lit(1)).alias("uses"), F.max("pass").alias("most_uses"))
    fixed = documents.sparkSession.createDataFrame(
        [(s, r["docs"], r["tokens"], float(r["target_share"]), int(r["max_repeats"]), r["budget"] / corpus if corpus else 0.0) for s, r in rows.items()],
        "source string, docs bigint, tokens bigint, target_share double, max_repeats int, planned_share double",
    )
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    out = fixed.join(drawn, "source", "left").select(*fixed.columns, zero("drawn"), zero("uses"), zero("most_uses"))
    return out.withColumn("actual_share", F.try_divide("drawn", F.sum("drawn").over(W.partitionBy()))).withColumn("corpus_tokens", F.lit(corpus))


def temperature_plan(sizes: DataFrame, mix_targets: DataFrame) -> tuple[float, dict[str, dict]]:
    """(exponent, rows as those of ``plan``) of temperature mixing: the exponent is bisected until the weights have the entropy of the
    target shares or a source is at its limit; a source's budget is its weight of what all listed sources have."""
    rows, _ = plan(sizes, mix_targets)
    have = {s: r["tokens"] for s, r in rows.items()}
    total, aims = sum(have.values()), sum(r["target_share"] for r in rows.values()) or 1
    wanted = entropy({s: r["target_share"] / aims for s, r in rows.items()})
    x, weights = temperature(have, {s: r["max_repeats"] for s, r in rows.items()}, wanted) if total else (1.0, {})
    for s, r in rows.items():
        r["weight"] = float(weights.get(s, 0.0))
        r["budget"] = r["weight"] * total
        r["passes"] = int(r["budget"] // have[s] + 1e-9) if have[s] else 0
    return float(x), rows


def temperature_weights(documents: DataFrame, mix_targets: DataFrame, **vocabulary: str) -> DataFrame:
    """(source, tokens, natural_share, exponent, weight): temperature mixing to the entropy of the target shares, the
    repetition limits kept."""
    x, rows = temperature_plan(cut(sized(documents, **vocabulary)), mix_targets)
    total = sum(r["tokens"] for r in rows.values()) or 1
    return documents.sparkSession.createDataFrame(
        [(s, r["tokens"], r["tokens"] / total, x, r["weight"]) for s, r in rows.items()], "source string, tokens bigint, natural_share double, exponent double, weight double"
    )


def temperature_report(documents: DataFrame, mix_targets: DataFrame, seed: int = 0, **vocabulary: str) -> DataFrame:
    """(source, exponent, weight, drawn, uses, most_uses, actual_share, target_share, missed): temperature weights realised as block
    permutations, with the shares really reached and by how much the exponent alone misses the targets."""
    sizes = cut(sized(documents, **vocabulary))
    x, rows = temperature_plan(sizes, mix_targets)
    drawn = select(sizes, rows, seed).groupBy("source").agg(F.sum("tokens").alias("drawn"), F.count(F.lit(1)).alias("uses"), F.max("pass").alias("most_uses"))
    fixed = documents.sparkSession.createDataFrame([(s, x, r["weight"], float(r["target_share"])) for s, r in rows.items()], "source string, exponent double, weight double, target_share double")
    whole = drawn.agg(F.sum("drawn").alias("whole"))  # one row
    out = fixed.join(drawn, "source", "left").crossJoin(F.broadcast(whole))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    share = F.coalesce(F.try_divide("drawn", "whole"), F.lit(0.0))
    return out.select("source", "exponent", "weight", zero("drawn"), zero("uses"), zero("most_uses"), share.alias("actual_share"), "target_share", (share - F.col("target_share")).alias("missed"))
