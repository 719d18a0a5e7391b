"""URL filter by the ratio of two character models.

Pages that a rule of the list judges are the examples.  For accepted and for
rejected URLs a Markov model of variable order gives each character's probability
after the characters before it: every order's counts are smoothed by the next
lower one, in proportion to how many different characters followed the context
(Witten-Bell), down to a uniform start.  A URL's score is the mean over its
characters of log P(accepted) - log P(rejected); pages without a rule are allowed
from a threshold on.  It is set by cross-fitting: the examples are dealt into folds,
each fold is scored by models of the others, and the cut is where all of them
together are told apart best.  The models that judge are counted over all examples.

Everything is DataFrame operations.  URLs are lower-cased and keep all their
characters, so the table of n-grams grows with the input; it is broadcast under the
size limit and joined otherwise.  A URL is cut once into pieces of bounded length,
so its n-grams cost in proportion to its length.

A URL without ``://`` (or NULL) has an empty host and path and fits no rule; it is
scored as a whole, a NULL or empty one scores 0.  Examples of fewer than two classes
leave the cut at 0.  Rows are never merged: a repeated page is judged each time.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from nearfield.session import broadcast_limit, materialise

ORDER = 3
PAD = "^"
PIECE = 256  # characters of a URL that are handled as one row
GRAM_BYTES = 96
FOLDS = 5
ALL = -1  # in place of the fold that a model leaves out
BIN = 0.01
CLIP = 20.0


class Rule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


# The rule list.
RULES = (
    Rule("block", "net", "/"),
    Rule("allow", "example.net", "/en/"),
    Rule("block", "example.com", "/de/"),
    Rule("allow", "org", "/fr/"),
)


def _rest(url: Column) -> Column:
    """What follows the first ``://``; NULL without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    host = F.regexp_extract(_rest(url), r"^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_column(host: Column, path: Column, field: str, rules: tuple[Rule, ...] = RULES) -> Column:
    """Name or verdict of the longest fitting rule, else NULL."""
    out = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: len(r.name)):  # the longest is asked first, so it is wrapped last
        fits = ((host == rule.host) | F.endswith(host, F.lit(f".{rule.host}"))) & F.startswith(path, F.lit(rule.path))
        out = F.when(fits, F.lit(getattr(rule, field))).otherwise(out)
    return out


def symbols(url: Column) -> Column:
    """The string that the models read."""
    return F.lower(F.coalesce(_rest(url), url, F.lit("")))


def grams(strings: DataFrame, order: int) -> DataFrame:
    """One row per character: ``g`` is the character after its ``order`` predecessors.

    A string (``s``, which isn't carried on) is cut into pieces in one sweep; each piece
    is led by the last characters of the one before.
    """
    kept = [c for c in strings.columns if c != "s"]
    pieces = F.regexp_extract_all("s", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    lead = lambda i: F.when(i == 0, F.lit(PAD * order)).otherwise(F.right(F.get(F.col("_pieces"), i - 1), F.lit(order)))
    led = F.transform("_pieces", lambda piece, i: F.concat(lead(i), piece))
    cut = strings.withColumn("_pieces", pieces).select(*kept, F.explode(led).alias("_piece"))
    each = cut.withColumn("_at", F.explode(F.sequence(F.lit(1), F.length("_piece") - order)))
    return each.select(*kept, F.substring("_piece", F.col("_at"), F.lit(order + 1)).alias("g"))


def without_folds(counts: DataFrame) -> DataFrame:
    """(model, g, accepted, rejected) from (g, fold, accepted, rejected): all counts, and for each fold those of the others."""
    every = counts.groupBy("g").agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected")))
    models = every.withColumn("model", F.explode(F.array(*map(F.lit, [ALL, *range(FOLDS)]))))
    own = counts.select("g", F.col("fold").alias("model"), *(F.col(c).alias(f"own_{c}") for c in ("accepted", "rejected")))
    left = lambda c: (F.col(c) - F.coalesce(f"own_{c}", F.lit(0))).alias(c)
    return models.join(own, ["g", "model"], "left").select("model", "g", left("accepted"), left("rejected"))


def gram_scores(counts: DataFrame, order: int, symbols_in_use: int) -> DataFrame:
    """(model, g, llr) from (model, g, accepted, rejected): the log ratio of the two smoothed models of each ``model``."""
    lower = None
    for k in range(order + 1):
        own = F.substring("g", order + 1 - k, k + 1)
        table = counts.groupBy("model", own.alias("g")).agg(*(F.sum(c).alias(c) for c in ("accepted", "rejected")))
        context = F.substring("g", 1, k)
        total = table.groupBy("model", context.alias("ctx")).agg(
            *(F.sum(c).alias(f"{c}_n") for c in ("accepted", "rejected")),
            *(F.sum((F.col(c) > 0).cast("bigint")).alias(f"{c}_t") for c in ("accepted", "rejected")),
        )
        table = table.withColumn("ctx", context).join(total, ["model", "ctx"])
        if lower is None:
            shorter = {c: F.lit(1.0 / symbols_in_use) for c in ("accepted", "rejected")}
        else:
            table = table.withColumn("tail", F.substring("g", 2, k)).join(lower, ["model", "tail"])
            shorter = {c: F.col(f"{c}_lower") for c in ("accepted", "rejected")}

        def smoothed(c: str) -> Column:
            # With nothing after this context the lower order stands alone; order 0 keeps all symbols possible.
            seen = F.col(f"{c}_t") if lower is not None else F.col(f"{c}_t") + 1
            p = F.try_divide(F.col(c) + seen * shorter[c], F.col(f"{c}_n") + seen)  # noqa: B023
            return F.coalesce(p, shorter[c])  # noqa: B023

        now = table.select("model", "g", *(smoothed(c).alias(f"p_{c}") for c in ("accepted", "rejected")))
        renamed = [F.col(f"p_{c}").alias(f"{c}_lower") for c in ("accepted", "rejected")]
        lower = now.select("model", F.col("g").alias("tail"), *renamed)
    return now.select("model", "g", (F.log("p_accepted") - F.log("p_rejected")).alias("llr"))


def threshold(scored: DataFrame) -> float:
    """Cut of the largest difference between the shares kept of both classes.

    ``scored`` has (score, allow, block) of examples; scores are counted in bins, so
    what is compared has at most ``2 * CLIP / BIN`` rows.  Without both classes the
    cut is 0.
    """
    low, high = F.lit(-CLIP), F.lit(CLIP)
    binned = F.floor(F.least(F.greatest("score", low), high) / BIN).alias("bin")
    counts = scored.groupBy(binned).agg(
        F.sum("allow").alias("good"),
        F.sum("block").alias("bad"),
    )
    above = Window.orderBy(F.desc("bin"))
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = lambda c: F.try_divide(F.sum(c).over(above), F.sum(c).over(every))
    best = counts.withColumns({"gain": share("good") - share("bad"), "below": F.lead("bin").over(Window.orderBy(F.desc("bin")))})
    first = best.filter("gain IS NOT NULL").orderBy(F.desc("gain"), F.desc("bin")).first()
    if first is None:
        return 0.0
    # Halfway to the next bin below that holds an example.
    below = first["bin"] if first["below"] is None else first["below"] + 1
    return (first["bin"] + below) / 2 * BIN


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, order: int = ORDER, url: str = "url") -> DataFrame:
    """``pages`` plus host, path, rule, score and verdict; same-named columns are replaced."""
    spark = pages.sparkSession
    address = F.col(url).cast("string")
    made = {"host": host_of(address), "path": path_of(address), "_s": symbols(address)}
    rows = pages.drop("host", "path", "rule", "score", "verdict").withColumns(made)
    rows = rows.withColumn("rule", rule_column(F.col("host"), F.col("path"), "name", rules))
    rows = rows.withColumn("_given", rule_column(F.col("host"), F.col("path"), "verdict", rules))
    # One row per string the models read, with how often it is allowed and blocked by a rule.
    times = lambda v: F.sum(F.when(F.col("_given") == v, 1).otherwise(0))
    strings = rows.groupBy(F.col("_s").alias("s")).agg(times("allow").alias("allow"), times("block").alias("block"))
    fold = F.pmod(F.xxhash64("s"), F.lit(FOLDS)).cast("int")
    # Characters are counted under a number of their string, which is fixed when it is written.
    strings = materialise(strings.withColumns({"fold": fold, "sid": F.monotonically_increasing_id()}), "urls")
    counts = grams(strings, order).groupBy("g", "fold")
    counts = materialise(counts.agg(F.sum("allow").alias("accepted"), F.sum("block").alias("rejected")), "grams")
    symbols_in_use = counts.select(F.right("g", F.lit(1))).distinct().count()
    model = materialise(gram_scores(without_folds(counts), order, max(1, symbols_in_use)), "model")
    if model.count() * GRAM_BYTES <= broadcast_limit(spark):
        model = F.broadcast(model)
    # Examples are scored by the models without their fold, all strings by those of all examples.
    examples = strings.filter("allow + block > 0")
    asked = strings.select("sid", "s", F.lit(ALL).alias("model"))
    asked = asked.unionByName(examples.select("sid", "s", F.col("fold").alias("model")))
    mean = (F.sum("llr") / F.count("*")).alias("score")
    scored = materialise(grams(asked, order).join(model, ["model", "g"]).groupBy("sid", "model").agg(mean), "scores")
    cut = threshold(examples.withColumnRenamed("fold", "model").join(scored, ["sid", "model"]))
    scores = scored.filter(F.col("model") == ALL).join(strings, "sid").select("s", "score")
    out = rows.join(scores.withColumnRenamed("s", "_s"), "_s", "left")
    out = out.withColumn("score", F.coalesce("score", F.lit(0.0)))
    own = F.when(F.col("score") >= cut, F.lit("allow")).otherwise(F.lit("block"))
    return out.withColumn("verdict", F.coalesce("_given", own)).drop("_s", "_given")
