"""Column functions that turn listing text into typed values.

Every function takes and returns a ``Column``; none needs Python on the workers.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

from storelab import constants as K

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_STAR_SCHEMA = "array<map<string,bigint>>"


def _number(c: Column) -> Column:
    """Text as double, NULL unless the whole text is a plain decimal number."""
    return F.when(c.rlike(NUMBER), F.trim(c).try_cast("double"))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def _missing(c: Column) -> Column:
    """NULL, blank, ``nan`` or ``N/A``."""
    return c.isNull() | _strip(c).isin("", "nan", "N/A")


def to_float(c: Column) -> Column:
    """Number from text; unreadable text gives 0.0, a missing value stays NULL."""
    return F.when(c.isNull() | (F.lower(_strip(c)) == "nan"), None).otherwise(
        F.coalesce(_number(c), F.lit(0.0)))


def days_since(c: Column, as_of: date | str, fmt: str = "MMMM d, yyyy",
               missing: int | None = None) -> Column:
    """Whole days from a written date to ``as_of``; ``missing`` replaces a NULL input."""
    day = F.to_date(F.try_to_timestamp(_strip(c), F.lit(fmt)))
    days = F.datediff(F.lit(str(as_of)).cast("date"), day)
    if missing is None:
        return days
    return F.when(c.isNull(), F.lit(missing)).otherwise(days)


def days_since_release(c: Column, as_of: date | str) -> Column:
    """Days since the first of a written month such as ``2014 November``."""
    return days_since(c, as_of, "yyyy MMMM")


def review_range(c: Column) -> Column:
    """1 below 100 reviews or when missing or unreadable, 2 below 500, else 3."""
    n = _number(c)
    return (F.when(_missing(c) | n.isNull() | (n < 100), 1).when(n < 500, 2).otherwise(3))


def installs_min_max(c: Column) -> Column:
    """``500,000 - 1,000,000`` as struct(min, max); one number fills both, faults give 0."""
    parts = F.transform(F.split(c, "-"), lambda p: F.regexp_replace(_strip(p), ",", ""))
    nums = F.transform(parts, lambda p: F.when(p.rlike(r"^[+-]?\d+$"), p.try_cast("bigint")))
    good = F.size(nums).isin(1, 2) & ~F.exists(nums, lambda n: n.isNull())
    low, high = F.get(nums, F.lit(0)), F.get(nums, F.size(nums) - 1)
    zero = F.lit(0).cast("bigint")
    return F.struct(F.when(good, low).otherwise(zero).alias("min"),
                    F.when(good, high).otherwise(zero).alias("max"))


def version_digits(c: Column) -> Column:
    """First three digit runs as struct(d1, d2, d3); runs that are absent count as 0."""
    runs = F.regexp_extract_all(c, F.lit(r"\d+"), F.lit(0))

    def run(i: int) -> Column:
        return (F.when(F.size(runs) > i, F.get(runs, F.lit(i)).try_cast("int"))
                .when(F.size(runs) > 0, F.lit(0)))

    return F.struct(*[run(i).alias(f"d{i + 1}") for i in range(3)])


def version_head(c: Column) -> Column:
    """Leading ``d.d`` of a version text, NULL when it does not start that way."""
    return F.nullif(F.regexp_extract(c, r"^(\d.\d)", 1), F.lit(""))


def version_major_minor(c: Column) -> Column:
    """Single-digit major and minor number as struct(major, minor)."""
    def digit(group: int) -> Column:
        return F.regexp_extract(c, r"^(\d).(\d)", group).try_cast("double")
    return F.struct(digit(1).alias("major"), digit(2).alias("minor"))


def in_app_price_range(c: Column) -> Column:
    """Price range of in-app products as struct(min, max); none gives zeros."""
    hits = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\d+.\d+"), F.lit(0))

    def pick(i: Column) -> Column:
        return F.when(F.size(hits) == 0, 0.0).otherwise(F.get(hits, i).try_cast("double"))

    return F.struct(pick(F.lit(0)).alias("min"),
                    pick(F.least(F.size(hits) - 1, F.lit(1))).alias("max"))


def in_app_flag(c: Column) -> Column:
    return c.eqNullSafe(F.lit(K.IN_APP_TEXT)).cast("int")


def binary_size_kb(c: Column) -> Column:
    """File size in KB; text without a three-character number or a known unit gives 0.

    The number pattern wants at least three characters, so ``5MB`` and ``12MB`` are 0.
    """
    unit = F.upper(F.regexp_extract(c, r"[a-zA-Z]+", 0))
    number = F.regexp_extract(c, r"\d+.\d+", 0).try_cast("double")
    factor = (F.when(unit == "KB", 1.0).when(unit == "MB", 1024.0)
              .when(unit == "GB", 1024.0 * 1024.0))
    return F.coalesce(number * factor, F.lit(0.0))


def binary_size_range(kb: Column) -> Column:
    """1 below 3000 KB or when missing, 2 up to 10000, 3 up to 35000, else 4."""
    return (F.when(kb.isNull() | (kb < 3000), 1).when(kb <= 10000, 2)
            .when(kb <= 35000, 3).otherwise(4))


def ranking_label(c: Column) -> Column:
    text = _strip(c)
    return (F.when(c.isNull() | (c == "nan"), "no_info").when(text == "", "other")
            .otherwise(F.regexp_replace(text, r"\s+", "_")))


def reviews_per_star(c: Column) -> Column:
    """Counts for one to five stars from ``[{"1":n},...,{"5":n}]``, as array<bigint>."""
    def counts(entries: Column) -> Column:
        items = F.array(*[F.get(entries, F.lit(i))[str(i + 1)] for i in range(5)])
        return F.when(entries.isNotNull(), items)

    # bound to a variable, so that the text is read once
    return F.get(F.transform(F.array(F.from_json(c, _STAR_SCHEMA)), counts), F.lit(0))


def star_share(count: Column, total: Column) -> Column:
    """Share of one star among all reviews, 0 when there are no reviews."""
    return F.when(total == 0, 0.0).otherwise(F.try_divide(count, total))


def review_counts(c: Column) -> Column:
    """Five raw counts read by pattern, as array<double>."""
    hits = F.regexp_extract_all(c, F.lit(r":(\d*)\}"), F.lit(1))
    return F.when(c.isNotNull(),
                  F.array(*[F.get(hits, F.lit(i)).try_cast("double") for i in range(5)]))


def similar_ids(c: Column, style: str = "json") -> Column:
    """Ids listed in a text. ``json`` reads a list; ``strip`` removes brackets, quotes and
    commas and splits on blanks."""
    if style == "json":
        return F.from_json(c, "array<string>")
    words = F.split(F.regexp_replace(c, r'[\[\]",]', " "), r"\s+")
    return F.filter(words, lambda w: w != "")


def concat_text_reverse(columns: Sequence[Column]) -> Column:
    """Last column first, no separator; missing parts read ``nan``, a missing first
    column makes the whole text NULL."""
    first, *rest = columns
    return F.concat(*[F.coalesce(c, F.lit("nan")) for c in reversed(rest)], first)


def concat_text_blank(columns: Sequence[Column]) -> Column:
    """Columns in order, joined by a blank; missing parts read ``nan``."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("nan")) for c in columns])


def rename_category(c: Column, renames: dict[str, str] = K.CATEGORY_RENAMES) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in renames.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, c), c)


def group_categories(c: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Each group of categories becomes ``a_b_c``; later groups see earlier results."""
    for group in groups:
        c = F.when(c.isin(*group), "_".join(group)).otherwise(c)
    return c


def game_as_one(c: Column) -> Column:
    return F.when(c.isin(*K.GAME_CATEGORIES), "game").otherwise(c)


def game_prefix(c: Column) -> Column:
    games = [g.upper() for g in K.GAME_CATEGORIES]
    return F.when(c.isin(*games), F.concat(F.lit("GAME-"), c)).otherwise(c)


def merge_installs(c: Column) -> Column:
    return F.when(c.isin(*K.LARGE_INSTALLS), K.LARGE_INSTALLS_LEVEL).otherwise(c)


def positive_flag(c: Column) -> Column:
    """1.0 for every value above 0; other values stay."""
    return F.when(c > 0, 1.0).otherwise(c)


def score_text(f1: Column, error: Column) -> Column:
    """``f1 (error)`` rounded to 3 and 2 digits, a half in the error going to the even digit."""
    return F.concat(F.round(f1, 3).cast("string"), F.lit(" ("),
                    F.bround(error, 2).cast("string"), F.lit(")"))
