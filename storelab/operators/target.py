"""Price classes from quartile cuts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.operators.lookup import join_groups
from storelab.operators.ordered import quantiles

QUARTILES = [0.25, 0.5, 0.75]


def price_cuts(df: DataFrame, column: str = "price", by: Sequence[str] = ()) -> DataFrame:
    """Quartile cuts, one row per group: columns ``by``, q25, q50, q75.

    Cuts keep 9 digits, as averages that are compared with them do, so that ties do not
    hang on the order of additions.
    """
    q = quantiles(df, column, QUARTILES, by)
    return q.select(*by, *[F.round(F.col("q")[i], 9).alias(n) for i, n in enumerate(["q25", "q50", "q75"])])


def class_of(value: Column, q25: Column, q50: Column, q75: Column) -> Column:
    """1 to 4; a value equal to a cut belongs to the lower class, NULL stays NULL."""
    return (F.when(value <= q25, 1).when(value <= q50, 2).when(value <= q75, 3)
            .when(value.isNotNull(), 4))


def add_price_class(df: DataFrame, cuts: DataFrame, column: str = "price",
                    name: str = "price_range_index") -> DataFrame:
    """Apply cuts fitted on any set (one row) to a column of this one."""
    q = [cuts.select(c).scalar() for c in ("q25", "q50", "q75")]
    return df.withColumn(name, class_of(F.col(column), *q))


def add_price_class_by(df: DataFrame, cuts: DataFrame, by: str, columns: dict[str, str]) -> DataFrame:
    """Apply per-group cuts: ``columns`` maps a value column to the class column it fills."""
    joined = join_groups(df, cuts, by)
    return joined.withColumns({
        name: class_of(F.col(c), F.col("q25"), F.col("q50"), F.col("q75"))
        for c, name in columns.items()}).drop("q25", "q50", "q75")


def price_class_fraction(df: DataFrame, fitted_on: DataFrame, column: str = "price",
                         name: str = "price_class") -> DataFrame:
    """Classes 0.25, 0.5, 0.75 and 1; a price above the fitted maximum keeps its value."""
    q = quantiles(fitted_on, column, QUARTILES + [1.0])
    cuts = [q.select(F.col("q")[i].alias("q")).scalar() for i in range(4)]
    c = F.col(column)
    return df.withColumn(name, F.when(c <= cuts[0], 0.25).when(c <= cuts[1], 0.5)
                         .when(c <= cuts[2], 0.75).when(c <= cuts[3], 1.0).otherwise(c))


def fixed_price_class(price: Column) -> Column:
    """Class by the fixed price steps."""
    out = F.when(price <= K.PRICE_STEPS[0], 1)
    for i, step in enumerate(K.PRICE_STEPS[1:], start=2):
        out = out.when(price <= step, i)
    return out.when(price.isNotNull(), len(K.PRICE_STEPS) + 1)
