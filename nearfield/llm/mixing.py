"""Mixing sources to target weights by temperature.

A source's weight is its share of all tokens raised to an exponent between 0 and
1, over the sum of these.  The exponent is bisected until the weights reach a
target entropy, or until no source repeats more often than a limit allows.  The
budget then gives every source a number of tokens, which is realised as block
permutations: the documents of a source fall into blocks by a hash of their id,
an epoch runs through the blocks in the order of a hash of block and epoch, and
through the documents of a block in the order of a hash of document and epoch, so
each epoch has an order of its own.  Whole epochs come first; the last one stops at
the document that would exceed the budget.  The mixed corpus is in the order of its
copies: the epochs of every source are spread evenly over it.

Tokens are the runs of ``[^\\x20\\x09-\\x0D]+``.  Only per-block sums are shuffled
and ordered; one block per source, the one in which its budget ends, is ordered
by document.  A decision is a comparison with the source's cut, so a hot source
is never gathered.  Hashes are MD5 digests of decimal ids, as other engines have.

NULL sources are one source of their own, NULL texts have no tokens, rows of one
id stand or fall together.  A source without tokens costs nothing and is taken once.
"""

from __future__ import annotations

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import broadcast_limit, materialise

BLOCKS_HEX = 3  # blocks per source: 16 ** BLOCKS_HEX
GRID = 16  # exponents tried in one pass
PASSES = 8
SOURCE_BYTES = 256
NO_SOURCE = "\x00"


class Target(NamedTuple):
    """Exactly one limit: entropy as a share of log(sources), or repeats of a document."""

    entropy: float | None = None
    repeats: float | None = None


def token_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _hash(label: str, *parts: Column) -> Column:
    text = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(label), *text).cast("binary"))


def with_blocks(rows: DataFrame) -> DataFrame:
    """``_source`` and ``_block`` of each row."""
    made = rows.withColumn("_source", F.coalesce(F.col("source").cast("string"), F.lit(NO_SOURCE)))
    return made.withColumn("_block", F.substring(_hash("member", F.col("doc_id")), 1, BLOCKS_HEX))


def turn(epoch: Column | str) -> Column:
    """Place of a block among the blocks of its source in an epoch."""
    return _hash("block", F.col("_source"), F.col("_block"), F.col(epoch) if isinstance(epoch, str) else epoch)


def place(epoch: Column | str) -> Column:
    """Place of a document in its block in an epoch."""
    return _hash("document", F.col("doc_id"), F.col(epoch) if isinstance(epoch, str) else epoch)


def find_exponent(shares: DataFrame, target: Target, budget: int | None = None) -> float:
    """The exponent that meets ``target``, by narrowing [0, 1] ``GRID``-fold in each pass.

    ``shares`` has (tokens) per source.  Entropy falls and repeats of a small
    source fall as the exponent grows; the largest exponent whose entropy reaches
    the target is sought, or the smallest whose repeats keep the limit.  A ``budget``
    that no exponent can spend within the limit raises.
    """
    if (target.entropy is None) == (target.repeats is None):
        raise ValueError("set either entropy or repeats")
    least, most, total, count = shares.agg(F.min("tokens"), F.max("tokens"), F.sum("tokens"), F.count("*")).first()
    if not count:
        return 1.0
    low, high = 0.0, 1.0
    if target.repeats is not None and budget is None:
        # A document of the largest source counts once, so the smallest one repeats (most / least) ** (1 - a) times.
        reach = lambda a: (most / least) ** (1 - a) > target.repeats  # noqa: E731  repeats too often: go up
        if not reach(0.0):
            return 0.0
        for _ in range(4 * PASSES):
            middle = (low + high) / 2
            low, high = (middle, high) if reach(middle) else (low, middle)
        return high
    if target.repeats is not None:
        if budget > target.repeats * total:
            raise ValueError(f"a budget of {budget} tokens takes more than {target.repeats} repeats of {total}")
        for _ in range(PASSES):
            tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
            power = shares.select("tokens", F.explode(F.array(*map(F.lit, tried))).alias("a"))
            # The smallest source repeats budget / least / sum((tokens / least) ** a) times.
            sums = power.groupBy("a").agg(F.sum(F.pow(F.col("tokens") / F.lit(float(least)), "a")).alias("z"))
            kept = sums.filter(F.lit(budget / least) <= F.col("z") * F.lit(float(target.repeats))).agg(F.min("a")).first()[0]
            if kept is None:
                return high
            if kept <= low:
                return low
            low, high = kept - (high - low) / GRID, kept
        return high
    goal = target.entropy * math.log(count)
    share = F.col("tokens") / F.lit(float(total))
    for _ in range(PASSES):
        tried = [low + (high - low) * i / GRID for i in range(GRID + 1)]
        power = shares.select(share.alias("p"), F.explode(F.array(*map(F.lit, tried))).alias("a"))
        power = power.select("a", F.pow("p", "a").alias("w"))
        sums = power.groupBy("a").agg(F.sum("w").alias("z"), F.sum(F.col("w") * F.log("w")).alias("e"))
        entropy = sums.select("a", (F.log("z") - F.col("e") / F.col("z")).alias("h"))
        good = entropy.filter(F.col("h") >= goal).agg(F.max("a")).first()[0]
        if good is None:
            return low
        if good >= high:
            return high
        low, high = good, good + (high - low) / GRID
    return low


class Mix(NamedTuple):
    """``plan``: one row per source; ``exponent``: what the target led to."""

    plan: DataFrame
    exponent: float


def plan_mix(docs: DataFrame, target: Target, budget: int | None = None) -> Mix:
    """How often each source's documents are taken.

    The plan has source, tokens, weight, quota (tokens), epochs (whole ones) and
    the cut (turn, place) up to which the next epoch goes, in that epoch's order.
    Without a ``budget`` it is the smallest one that takes every document at least
    once.  A limit on repeats holds for every source with a budget, too.
    """
    narrow = docs.select("doc_id", "source", token_count(F.col("text").cast("string")).alias("tokens"))
    narrow = materialise(with_blocks(narrow).drop("source"), "mixing")
    blocks = materialise(narrow.groupBy("_source", "_block").agg(F.sum("tokens").alias("tokens")), "mixing_blocks")
    sources = blocks.groupBy("_source").agg(F.sum("tokens").alias("tokens"))
    shares = materialise(sources.filter("tokens > 0"), "mixing_sources")
    exponent = find_exponent(shares, target, budget)
    z = shares.agg(F.sum(F.pow("tokens", F.lit(exponent)))).first()[0]
    weight = F.pow("tokens", F.lit(exponent)) / F.lit(float(z or 1.0))
    weighted = shares.withColumn("weight", weight)
    if budget is None:
        budget = weighted.agg(F.max(F.col("tokens") / F.col("weight"))).first()[0] or 0.0
        quota = F.greatest(F.round(F.col("weight") * F.lit(float(budget))).cast("bigint"), F.col("tokens"))
    else:
        quota = F.round(F.col("weight") * F.lit(float(budget))).cast("bigint")
    if target.repeats is not None:
        quota = F.least(quota, F.greatest(F.floor(F.col("tokens") * F.lit(float(target.repeats))), F.lit(0)).cast("bigint"))
    quotas = weighted.withColumn("quota", quota)
    quotas = quotas.withColumn("epochs", F.expr("quota div tokens")).withColumn("rest", F.expr("quota % tokens"))
    # The block in which the last, partial epoch ends, and how many tokens it may still give.
    part = quotas.filter("rest > 0").select("_source", "rest", "epochs")
    so_far = F.sum("tokens").over(Window.partitionBy("_source").orderBy("_turn"))
    ordered = blocks.join(part, "_source").withColumn("_turn", turn("epochs"))
    last = ordered.withColumn("upto", so_far).filter("upto > rest AND upto - tokens <= rest")
    last = last.select("_source", "_block", "_turn", "epochs", (F.col("rest") - F.col("upto") + F.col("tokens")).alias("left"))
    inside = narrow.join(last, ["_source", "_block"]).withColumn("_place", place("epochs"))
    inside = inside.groupBy("_source", "_place", "left").agg(F.sum("tokens").alias("tokens"))
    taken = F.sum("tokens").over(Window.partitionBy("_source").orderBy("_place"))
    cut = inside.withColumn("taken", taken).filter("taken <= left")
    cut = cut.groupBy("_source").agg(F.max("_place").alias("cut_place"))
    plan = quotas.join(last.select("_source", F.col("_turn").alias("cut_turn")), "_source", "left")
    plan = plan.join(cut, "_source", "left")
    return Mix(materialise(plan.withColumnRenamed("_source", "source"), "mixing_plan"), exponent)


def _counted(docs: DataFrame, mix: Mix, least: int) -> DataFrame:
    """``docs`` plus _source, _block, _epochs (whole ones), _copies and _span (epochs of the source, the last in part)."""
    rows = with_blocks(docs)
    quota = (F.col("quota") / F.col("tokens")).alias("_span")
    plan = mix.plan.select(F.col("source").alias("_source"), F.col("epochs").alias("_epochs"), quota, "cut_turn", "cut_place")
    if plan.count() * SOURCE_BYTES <= broadcast_limit(docs.sparkSession):
        plan = F.broadcast(plan)
    joined = rows.join(plan, "_source", "left")
    now = turn("_epochs")
    within = (now == F.col("cut_turn")) & (place("_epochs") <= F.col("cut_place"))
    extra = F.when((now < F.col("cut_turn")) | within, 1).otherwise(0)
    # A source without a token has no plan.
    whole = F.coalesce("_epochs", F.lit(1)).cast("bigint")
    out = joined.withColumns({"_extra": extra, "_whole": whole, "_span": F.coalesce("_span", F.lit(1.0))})
    out = out.withColumn("_copies", F.greatest(F.col("_whole") + F.col("_extra"), F.lit(least)).cast("bigint"))
    return out.drop("cut_turn", "cut_place", "_extra", "_epochs").withColumnRenamed("_whole", "_epochs")


def copies(docs: DataFrame, mix: Mix, least: int = 0) -> DataFrame:
    """``docs`` plus ``epochs`` (whole ones), ``copies``, and ``turn`` and ``place`` in the epoch after these."""
    made = ["epochs", "copies", "turn", "place"]
    out = _counted(docs.drop(*made), mix, least)
    return out.select(
        *(c for c in docs.columns if c not in made),
        F.col("_epochs").alias("epochs"),
        F.col("_copies").alias("copies"),
        turn("_epochs").alias("turn"),
        place("_epochs").alias("place"),
    )


def with_positions(docs: DataFrame, mix: Mix, least: int = 0) -> DataFrame:
    """One row per copy: ``docs`` plus _epoch, _turn, _place and _at.

    Copies of a source are in the order of (_epoch, _turn, _place).  ``_at``, from 0 to
    1, is where a copy stands in the whole corpus: the share of its source's epochs
    that lie before its block.
    """
    counted = _counted(docs, mix, least).filter("_copies > 0")
    rows = counted.withColumn("_epoch", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_copies") - 1)))
    rows = rows.withColumns({"_turn": turn("_epoch"), "_place": place("_epoch")})
    within = F.conv(F.substring("_turn", 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    at = F.least(F.try_divide(F.col("_epoch") + within, F.greatest("_span", F.lit(1.0))), F.lit(1.0))
    return rows.withColumn("_at", at).drop("_source", "_block", "_epochs", "_copies", "_span")


def repeated(docs: DataFrame, mix: Mix, least: int = 0) -> DataFrame:
    """The mixed corpus in its order: each row as often as the plan takes it, with the columns of ``docs``."""
    rows = docs.select("doc_id", "source", F.struct(*docs.columns).alias("_row"))
    order = ["_at", "_turn", "_place"]
    placed = with_positions(rows, mix, least).repartitionByRange(*order).sortWithinPartitions(*order)
    return placed.select("_row.*")
