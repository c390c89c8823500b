"""Mixing sources to target weights: tempered shares, bisected exponent, budgeted block permutations.

A source's share of all tokens (words) is raised to an exponent and normalised: 1 keeps the natural shares, 0 makes all
sources equal. The exponent is bisected until the mix has a target entropy, or until no source is repeated more often
than a limit allows, whichever asks for less change. Weight times budget over tokens is the number of passes over a
source. Its documents are cut into blocks by a hash; every pass visits the blocks in its own permutation, whole passes
first, and the last, partial pass ends at the block whose middle crosses the rest of the budget. So a source's tokens
meet its budget to within half a block (at most 1 / ``LEAST_BLOCKS`` of the source, on average).

DataFrame functions only. The exponent comes from one row with the token sums of the sources (a mix has as many sources
as its configuration names; that list is the only thing gathered). Documents are summed per block with map-side sums;
places in a permutation are running sums of two levels, so that no window holds more than 1/256 of a source's blocks.
Documents meet the plan by source and block, which spreads a source of any size; the plan is far smaller than the
documents and is broadcast only when Spark finds its written size below its threshold.

Defined results: a null source is a source of its own, apart from the empty name. A null text has no tokens. Documents
without tokens belong to a block like all others. A source without tokens has weight 0; it is left out, but for
``keep_all``, where it is passed once. Rows that repeat are rows of their own, drawn together. Without documents the
result is empty. Extra columns are carried along; the added columns start with ``mix_``, and columns of the documents with their names are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shardframe.llm.shared import text_of, written

#: Tokens of a block, about, and the fewest blocks of a source.
BLOCK_TOKENS = 100_000
LEAST_BLOCKS = 64
#: Steps that double an exponent until it is enough, and that halve what lies before it.
STEPS = 60


def token_count() -> Column:
    """Words of the text."""
    return F.regexp_count(text_of(), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def source_key() -> Column:
    """The source as a key that tells null from every name."""
    return F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n"))


def block_hash(seed: int) -> Column:
    """A document's place among the blocks."""
    return F.xxhash64(F.lit(seed), F.col("doc_id"), F.col("text"))


def _sum(values: Column, of) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda total, x: total + of(x))


def _bracket(enough) -> Column:
    """The first of 1, 2, 4, ... that is enough; null if none is."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(STEPS)), F.lit(None).cast("double"), lambda at, k: F.coalesce(at, F.when(enough(F.pow(F.lit(2.0), k)), F.pow(F.lit(2.0), k))))


def _bisect(low: Column, high: Column, too_low) -> Column:
    """The smallest exponent that isn't too low, by halving."""
    start = F.struct(low.cast("double").alias("lo"), high.cast("double").alias("hi"))

    def halve(at: Column, _: Column) -> Column:
        middle = (at["lo"] + at["hi"]) / 2
        below = too_low(middle)
        return F.struct(F.when(below, middle).otherwise(at["lo"]).alias("lo"), F.when(below, at["hi"]).otherwise(middle).alias("hi"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, halve, lambda at: at["hi"])


def entropy(shares: Column, exponent: Column) -> Column:
    """Entropy (natural logarithm) of the normalised powers of the shares, given as shares of the largest."""
    total = _sum(shares, lambda p: F.pow(p, exponent))
    return F.ln(total) - exponent * _sum(shares, lambda p: F.pow(p, exponent) * F.ln(p)) / total


def source_weights(
    totals: DataFrame, target_entropy: float | None, max_repeats: float | None, budget: float, keep_all: bool
) -> DataFrame:
    """One row per source: ``key, tokens, share, weight, repeats, exponent, blocks``.

    ``totals`` has ``key, tokens``. ``target_entropy`` is a share of the largest possible entropy, ``budget`` one of all
    tokens. With ``keep_all`` the budget is the least that passes every source once.

    The exponent for an entropy is bracketed by doubling, so it has no bound; an entropy below that of the largest sources alone (several of
    one size) can't be met and is an error. The limit on repeats holds always: a larger budget is reduced to it, and the exponent stays where the
    most repeated source keeps it, whatever the entropy asks for. With ``keep_all`` a limit below 1 is an error.
    """
    if max_repeats is not None and (max_repeats <= 0 or keep_all and max_repeats < 1):
        raise ValueError("every source would have to be repeated more often than the limit")
    if max_repeats is not None and not keep_all:
        budget = min(budget, max_repeats)
    row = totals.agg(F.collect_list(F.struct("tokens", "key")).alias("s")).select(
        F.filter("s", lambda x: x["tokens"] > 0).alias("s"), F.filter("s", lambda x: x["tokens"] <= 0).alias("none")
    )
    row = row.withColumn("total", _sum(F.col("s"), lambda x: x["tokens"].cast("double")))
    row = row.withColumn("most", F.array_max(F.transform("s", lambda x: x["tokens"])))
    # Shares of the largest source: their powers neither overflow nor all vanish.
    row = row.withColumn("p", F.transform("s", lambda x: x["tokens"] / F.col("most"))).withColumn("top", F.col("most") / F.col("total"))
    p = F.col("p")
    row = row.withColumn("a", F.lit(0.0) if target_entropy is not None or max_repeats is not None else F.lit(1.0))
    if target_entropy is not None:
        goal = F.lit(target_entropy) * F.ln(F.size(p)) + F.lit(1e-12)
        row = row.withColumn("enough", _bracket(lambda a: entropy(p, a) <= goal))
        # Nothing to decide without sources.
        refused = F.when(F.size(p) > 0, F.raise_error(F.lit("no exponent has so small an entropy: several sources are the largest")).cast("double"))
        row = row.withColumn("a", F.coalesce(_bisect(F.lit(0.0), F.col("enough"), lambda a: entropy(p, a) > goal), refused, F.lit(1.0)))
    if max_repeats is not None:
        # The most repeated source is the smallest below an exponent of 1 and the largest above it.
        if keep_all:
            most = lambda a: F.array_max(F.transform(p, lambda x: F.pow(x, a - 1))) / F.array_min(F.transform(p, lambda x: F.pow(x, a - 1)))
        else:
            most = lambda a: F.lit(budget) / F.col("top") * F.array_max(F.transform(p, lambda x: F.pow(x, a - 1))) / _sum(p, lambda x: F.pow(x, a))
        over = lambda a: most(a) > F.lit(max_repeats + 1e-12)
        row = row.withColumn("least_a", _bisect(F.lit(0.0), F.lit(1.0), over))
        row = row.withColumn("far", F.coalesce(_bracket(lambda a: over(a + 1)), F.lit(2.0**STEPS)))
        row = row.withColumn("most_a", F.when(over(F.col("far") + 1), _bisect(F.lit(1.0), F.col("far") + 1, lambda a: ~over(a)) - F.lit(1e-9)).otherwise(F.col("far") + 1))
        row = row.withColumn("a", F.greatest(F.col("least_a"), F.least(F.col("a"), F.greatest(F.col("most_a"), F.lit(1.0)))))
    row = row.withColumn("z", _sum(p, lambda x: F.pow(x, F.col("a"))))
    least = F.array_min(F.transform(p, lambda x: F.pow(x, F.col("a") - 1)))
    rate = F.lit(1.0) / least if keep_all else F.lit(budget) / F.col("z") / F.col("top")
    row = row.withColumn("rate", rate)
    one = row.select(F.explode("s").alias("x"), "total", "most", "a", "z", "rate").select(
        F.col("x.key").alias("key"),
        F.col("x.tokens").alias("tokens"),
        (F.col("x.tokens") / F.col("total")).alias("share"),
        (F.col("x.tokens") / F.col("most")).alias("part"),
        "a",
        "z",
        "rate",
    )
    weighted = one.select(
        "key",
        "tokens",
        "share",
        (F.pow("part", "a") / F.col("z")).alias("weight"),
        (F.pow(F.col("part"), F.col("a") - 1) * F.col("rate")).alias("repeats"),
        F.col("a").alias("exponent"),
    )
    if keep_all:
        empty = row.select(F.explode("none").alias("x"), "a").select(
            F.col("x.key").alias("key"), F.col("x.tokens").alias("tokens"), F.lit(0.0).alias("share"), F.lit(0.0).alias("weight"), F.lit(1.0).alias("repeats"), F.col("a").alias("exponent")
        )
        weighted = weighted.unionByName(empty)
    blocks = F.greatest(F.lit(LEAST_BLOCKS), F.ceil(F.col("tokens") / BLOCK_TOKENS)).cast("int")
    return weighted.withColumn("blocks", blocks)


def block_plan(blocks: DataFrame, sources: DataFrame, seed: int) -> DataFrame:
    """The visits: ``key, block, pass, place``, from ``key, block, tokens`` and the sources."""
    # A hair below a whole number of passes is that number.
    whole = F.floor(F.col("repeats") + 1e-9).cast("long")
    visits = (
        blocks.join(sources.select("key", F.col("tokens").alias("source_tokens"), "repeats"), "key")
        .withColumn("whole", whole)
        .withColumn("rest", (F.col("repeats") - F.col("whole")) * F.col("source_tokens"))
        .withColumn("pass", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole"))))
        .withColumn("order", F.xxhash64(F.lit(seed), "pass", "key", "block"))
        .withColumn("lane", F.shiftrightunsigned("order", 56).cast("int"))
    )
    lanes = visits.groupBy("key", "pass", "lane").agg(F.sum("tokens").alias("lane_tokens"), F.count(F.lit(1)).alias("lane_blocks"))
    before = Window.partitionBy("key", "pass").orderBy("lane").rowsBetween(Window.unboundedPreceding, -1)
    lanes = lanes.select(
        "key",
        "pass",
        "lane",
        F.coalesce(F.sum("lane_tokens").over(before), F.lit(0)).alias("lane_start"),
        F.coalesce(F.sum("lane_blocks").over(before), F.lit(0)).alias("lane_place"),
    )
    inside = Window.partitionBy("key", "pass", "lane").orderBy("order", "block")
    placed = visits.join(lanes, ["key", "pass", "lane"]).select(
        "key",
        "block",
        "pass",
        (F.col("lane_place") + F.row_number().over(inside) - 1).alias("place"),
        (F.col("lane_start") + F.sum("tokens").over(inside.rowsBetween(Window.unboundedPreceding, 0)) - F.col("tokens") / 2).alias("middle"),
        "whole",
        "rest",
    )
    return placed.filter((F.col("pass") < F.col("whole")) | (F.col("middle") < F.col("rest"))).select("key", "block", "pass", "place")


def plan(
    docs: DataFrame,
    target_entropy: float | None = 0.98,
    max_repeats: float | None = 4.0,
    budget: float = 1.0,
    keep_all: bool = False,
    seed: int = 1,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Documents with ``key, tokens, hash``; the sources with their weights; and the visits."""
    slim = written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", source_key().alias("key"), token_count().alias("tokens"), block_hash(seed).alias("hash")),
        "tokens",
    )
    totals = slim.groupBy("key").agg(F.sum("tokens").alias("tokens"))
    sources = written(source_weights(totals, target_entropy, max_repeats, budget, keep_all), "sources")
    blocks = (
        slim.join(sources.select("key", "blocks"), "key")
        .groupBy("key", F.pmod("hash", "blocks").cast("int").alias("block"))
        .agg(F.sum("tokens").alias("tokens"))
    )
    return slim, sources, written(block_plan(blocks, sources, seed), "visits")


def mix(docs: DataFrame, **settings) -> DataFrame:
    """The drawn rows of ``docs``, with ``mix_pass`` (from 0), ``mix_block`` and ``mix_place`` (of the block in the pass)."""
    seed = settings.get("seed", 1)
    docs = docs.drop("mix_key", "mix_hash", "mix_blocks", "mix_block", "mix_pass", "mix_place")
    _, sources, visits = plan(docs, **settings)
    keyed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], source_key().alias("mix_key"), block_hash(seed).alias("mix_hash"))
    return _drawn(keyed, sources, visits).drop("mix_key", "mix_hash")


def _drawn(keyed: DataFrame, sources: DataFrame, visits: DataFrame) -> DataFrame:
    counts = sources.select(F.col("key").alias("mix_key"), F.col("blocks").alias("mix_blocks"))
    visits = visits.select(F.col("key").alias("mix_key"), F.col("block").alias("mix_block"), F.col("pass").alias("mix_pass"), F.col("place").alias("mix_place"))
    placed = keyed.join(counts, "mix_key").withColumn("mix_block", F.pmod("mix_hash", "mix_blocks").cast("int")).drop("mix_blocks")
    return placed.join(visits, ["mix_key", "mix_block"])


def mixture(docs: DataFrame, **settings) -> DataFrame:
    """One row per drawn document: ``doc_id, source, pass, block, place, n_tokens, weight``."""
    slim, sources, visits = plan(docs, **settings)
    keyed = slim.select("doc_id", "source", "tokens", F.col("key").alias("mix_key"), F.col("hash").alias("mix_hash"))
    weights = sources.select(F.col("key").alias("mix_key"), "weight")
    return _drawn(keyed, sources, visits).join(weights, "mix_key").select(
        "doc_id",
        "source",
        F.col("mix_pass").alias("pass"),
        F.col("mix_block").alias("block"),
        F.col("mix_place").alias("place"),
        F.col("tokens").alias("n_tokens"),
        "weight",
    )
