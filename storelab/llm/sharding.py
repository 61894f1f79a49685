"""A reproducible shuffle into shards by a Feistel permutation of global row numbers.

Rows are numbered in ascending order of (doc_id, bytes of the text), nulls first. With n
rows and a = ceil(sqrt(n)), b = ceil(n / a), a row number is the pair (x div b, x mod b);
each round adds a keyed function of one half to the other, modulo a or b in turn, which is
a permutation of a * b numbers. Numbers of n or more are permuted again (cycle walking)
until they fall below n. The permuted number p gives shard p mod k and slot p div k, so
anyone who knows n, k and the seed can compute both, and the row numbers of a shard by the
inverse permutation.

Law ``rows``: the counts of two shards differ by one at most, whatever the sizes of the
texts or of groups of equal texts, whose members are spread like any other rows.

Defined results: a null text has size 1 and crc32 0; a null ``doc_id`` sorts first; rows
equal in doc_id and text are interchangeable and get different slots; an empty table gives
an empty result; extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab.operators.ordered import row_numbers
from storelab.session import cut

ROUNDS = 6
# A walk leaves the surplus of less than a numbers after at most that many steps, and
# after STEPS steps with probability over 1 - a**-STEPS.
STEPS = 64
# A prime below 2**31 and the multiplier of the round function.
PRIME = 2147483647
FACTOR = 1103515245


def round_keys(seed: int) -> list[int]:
    return [(seed * 69069 + 362437 * (i + 1) ** 3 + i) % PRIME for i in range(ROUNDS)]


def halves(n: int) -> tuple[int, int]:
    """The sizes a and b of the two halves for n numbers."""
    a = max(1, math.isqrt(max(n - 1, 0)) + (math.isqrt(max(n - 1, 0)) ** 2 < n))
    return a, max(1, -(-n // a))


def _keyed(half: Column, key: Column) -> Column:
    """A number below ``PRIME`` from one half and a key; all products stay below 2**62."""
    y = (half % PRIME * FACTOR + key) % PRIME
    y = (y * y + key) % PRIME
    return (y * FACTOR + half) % PRIME


def permuted(x: Column, n: int, seed: int) -> Column:
    """The place of number ``x`` (0 to n - 1) in the permutation of n numbers."""
    a, b = halves(n)
    keys = F.array(*[F.struct(F.lit(k).cast("bigint").alias("key"), F.lit(i % 2 == 0).alias("first"))
                     for i, k in enumerate(round_keys(seed))])

    def round_(s: Column, k: Column) -> Column:
        left = F.when(k["first"], (s["l"] + _keyed(s["r"], k["key"])) % a).otherwise(s["l"])
        right = F.when(k["first"], s["r"]).otherwise((s["r"] + _keyed(s["l"], k["key"])) % b)
        return F.struct(left.alias("l"), right.alias("r"))

    def once(v: Column) -> Column:
        start = F.struct(F.call_function("div", v, F.lit(b).cast("bigint")).alias("l"), (v % b).alias("r"))
        return F.aggregate(keys, start, round_, lambda s: s["l"] * b + s["r"])

    walk = F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), once(x), lambda v, _: F.when(v >= n, once(v)).otherwise(v))
    return F.when(walk < n, walk).otherwise(F.raise_error(F.lit("cycle walk did not end")).cast("bigint"))


def sharded(docs: DataFrame, shards: int, seed: int = 0) -> DataFrame:
    """Shard and slot of every row: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("bigint").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"), F.xxhash64(text).alias("code"))
    numbered = cut(row_numbers(rows, ["doc_id", "code"]))
    n = numbered.count()
    place = permuted(F.col("row_number") - 1, n, seed)
    return (numbered.select("doc_id", "size", "text_crc32", place.alias("place"))
            .select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
                    (F.col("place") % shards).cast("int").alias("shard"),
                    F.call_function("div", "place", F.lit(shards).cast("bigint")).alias("slot"),
                    F.lit(None).cast("int").alias("grown_shard")))
