"""Mixing sources to target weights by temperature.

A source with T tokens gets the weight T**x / sum(T**x). The exponent x is the largest, so
the closest to the natural shares, whose weights reach the target entropy (a share of the
greatest, log of the number of sources), unless that repeats a source too often; then it
is the least that meets the repetition limit. Every source is passed at least once, which
fixes the budget: source s is passed (T_max / T_s)**(1 - x) times.

A source's documents are put in a hashed order and cut into blocks of ``BLOCK_TOKENS``
tokens. Whole passes take all blocks; the last, partial pass takes blocks until the budget
of the source is met. In each pass the blocks are permuted anew and spread evenly over the
mixture, so that any stretch of it has about the target weights.

Sums within a source run over range-partitioned slices, so a source with a third of all
rows is spread over many tasks. Only DataFrame functions are used.

Defined results: a null source counts as the source ''; documents without words are passed
once for each whole pass; a source without words is passed once; repeated rows are separate
documents; an empty table gives an empty result; other columns pass through ``mixed``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab.operators.ordered import running_totals
from storelab.session import cut

TARGET_ENTROPY = 0.9
REPEAT_LIMIT = 2.0
BLOCK_TOKENS = 20_000
WORD = r"[^\x20\x09-\x0D]+"
_HALVINGS = 6  # of one job


def _at_exponents(totals: DataFrame, low: float, high: float) -> list:
    """Entropy share and largest repetition at the exponents that cut [low, high] in 64."""
    n = 1 << _HALVINGS
    x = F.lit(low) + F.lit(high - low) * F.col("i") / n
    spread = (totals.where("tokens > 0").withColumn("l", F.log("tokens"))
              .select("l", F.explode(F.sequence(F.lit(0), F.lit(n))).alias("i")).withColumn("x", x))
    sums = spread.groupBy("i", "x").agg(F.sum(F.exp(F.col("x") * F.col("l"))).alias("z"),
                                        F.sum(F.exp(F.col("x") * F.col("l")) * F.col("x") * F.col("l")).alias("e"),
                                        (F.max("l") - F.min("l")).alias("width"), F.count("*").alias("n"))
    entropy = F.log("z") - F.col("e") / F.col("z")
    share = F.when(F.col("n") > 1, entropy / F.log("n")).otherwise(1.0)
    return sums.select("x", share.alias("entropy"), F.exp((1 - F.col("x")) * F.col("width")).alias("repeats")).orderBy("i").collect()


def _bisect(totals: DataFrame, holds, jobs: int = 5) -> tuple[float, float]:
    """The exponents next to the change of ``holds``; each job makes six halvings."""
    low, high = 0.0, 1.0
    for _ in range(jobs):
        grid = _at_exponents(totals, low, high)
        state = [holds(r) for r in grid]
        change = next((i for i in range(1, len(grid)) if state[i] != state[0]), None)
        if change is None:
            return (low, low) if not grid else (grid[0].x, grid[-1].x)
        low, high = grid[change - 1].x, grid[change].x
    return low, high


def exponent(totals: DataFrame, target: float = TARGET_ENTROPY, limit: float = REPEAT_LIMIT) -> float:
    """The exponent for a table (source, tokens); 1 keeps the natural shares."""
    ends = _at_exponents(totals, 0.0, 1.0)
    if not ends:
        return 1.0
    if ends[-1].entropy >= target:
        wanted = 1.0
    elif ends[0].entropy < target:
        wanted = 0.0
    else:
        wanted = _bisect(totals, lambda r: r.entropy >= target)[0]
    if ends[0].repeats <= limit:
        return wanted
    return max(wanted, _bisect(totals, lambda r: r.repeats <= limit)[1])


def weights(totals: DataFrame, x: float) -> DataFrame:
    """(source, tokens, weight, passes) of each source."""
    powers = totals.where("tokens > 0").withColumn("p", F.pow("tokens", F.lit(x)))
    sums = powers.agg(F.sum("p").alias("z"), F.max("tokens").alias("most"))
    z, most = sums.first() or (None, None)
    empty = F.col("tokens") == 0
    return totals.select(
        "source", "tokens",
        F.when(empty, 0.0).otherwise(F.pow("tokens", F.lit(x)) / F.lit(z or 1.0)).alias("weight"),
        F.when(empty, 1.0).otherwise(F.pow(F.lit(float(most or 1)) / F.col("tokens"), F.lit(1.0 - x))).alias("passes"))


def _source() -> Column:
    return F.coalesce(F.col("source"), F.lit(""))


def mixture(docs: DataFrame, target: float = TARGET_ENTROPY, limit: float = REPEAT_LIMIT, seed: int = 7) -> DataFrame:
    """One row per document and pass: doc_id, code, source, n_tokens, pass, block, place, weight.

    ``code`` is the hash of the text, ``place`` the place in the mixture, from 0 to 1.
    """
    text = F.coalesce("text", F.lit(""))
    rows = cut(docs.select("doc_id", F.xxhash64(text).alias("code"), _source().alias("source"),
                           F.regexp_count(text, F.lit(WORD)).cast("bigint").alias("n_tokens"))
               .withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "code")))
    totals = cut(rows.groupBy("source").agg(F.sum("n_tokens").alias("tokens")))
    planned = cut(weights(totals, exponent(totals, target, limit)))
    summed = running_totals(rows, ["order"], {"upto": F.col("n_tokens")}, ["source"])
    block = F.call_function("div", F.col("upto") - F.col("n_tokens"), F.lit(BLOCK_TOKENS).cast("bigint"))
    placed = summed.withColumn("block", block).join(planned, "source")
    passes = F.explode(F.sequence(F.lit(0), F.floor("passes").cast("int")))
    u = F.abs(F.xxhash64(F.lit(seed), "source", "pass", "block") % 1_000_003) / 1_000_003.0
    whole = F.col("pass") < F.floor("passes")
    part = F.col("block") * BLOCK_TOKENS < (F.col("passes") - F.floor("passes")) * F.col("tokens")
    return (placed.select("*", passes.alias("pass")).where(whole | (part & (F.col("n_tokens") > 0)))
            .select("doc_id", "code", "source", "n_tokens", "pass", "block",
                    ((F.col("pass") + u) / F.greatest(F.col("passes"), F.col("pass") + 1.0)).alias("place"), "weight"))


def mixed(docs: DataFrame, target: float = TARGET_ENTROPY, limit: float = REPEAT_LIMIT, seed: int = 7) -> DataFrame:
    """``docs`` with one row per pass; columns as before."""
    code = F.xxhash64(F.coalesce("text", F.lit("")))
    counts = (mixture(docs, target, limit, seed).groupBy("doc_id", "code")
              .agg(F.countDistinct("pass").alias("passes"))
              .select(F.col("doc_id").alias("_mix_id"), F.col("code").alias("_mix_code"), F.col("passes").alias("_mix_passes")))
    keyed = docs.withColumn("_code", code)
    return (keyed.join(counts, keyed["doc_id"].eqNullSafe(F.col("_mix_id")) & (F.col("_code") == F.col("_mix_code")))
            .withColumn("_pass", F.explode(F.sequence(F.lit(1), F.col("_mix_passes").cast("int"))))
            .select(*docs.columns))
