"""Scores of predictions. Everything starts from one count per (target, prediction),
which is at most classes x classes rows per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelab.operators.ordered import running_totals


def confusion(df: DataFrame, by: Sequence[str] = (), y_eval: str = "y_eval",
              y_pred: str = "y_pred") -> DataFrame:
    return (df.groupBy(*by, F.col(y_eval).alias("y_eval"), F.col(y_pred).alias("y_pred"))
            .agg(F.count("*").alias("n")))


def confusion_percent(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Count, error size and share within the target, largest errors first."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy(*by, "y_eval"))
    return (cells.select(*by, F.col("y_eval").alias("target"), F.col("y_pred").alias("predict"),
                         F.col("n").alias("count"),
                         F.abs(F.col("y_eval") - F.col("y_pred")).alias("error_type"),
                         share.alias("percent"))
            .orderBy(F.desc("error_type"), "target", "predict"))


def class_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1 and support per class; a share of nothing is 0."""
    sides = F.explode(F.array(
        F.struct(F.col("y_eval").alias("label"), F.col("n").alias("support"),
                 F.lit(0).cast("bigint").alias("predicted"),
                 F.when(F.col("y_eval") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("bigint").alias("support"),
                 F.col("n").alias("predicted"), F.lit(0).cast("bigint").alias("hit"))))
    per = (cells.select(*by, sides.alias("x")).select(*by, "x.*").groupBy(*by, "label")
           .agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")]))
    return per.select(
        *by, "label",
        F.when(F.col("predicted") > 0, F.try_divide("hit", "predicted")).otherwise(0.0).alias("precision"),
        F.when(F.col("support") > 0, F.try_divide("hit", "support")).otherwise(0.0).alias("recall"),
        F.try_divide(2 * F.col("hit"), F.col("predicted") + F.col("support")).alias("f1"),
        "support", "predicted", "hit")


def _weighted(metric: str) -> Column:
    return F.sum(F.col(metric) * F.col("support")) / F.sum("support")


def weighted_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """F1, precision, recall weighted by support, accuracy, and the rows scored."""
    return class_scores(cells, by).groupBy(*by).agg(
        _weighted("f1").alias("f1"), _weighted("precision").alias("prec"),
        _weighted("recall").alias("rec"), (F.sum("hit") / F.sum("support")).alias("acc"),
        F.sum("support").alias("rows"))


def class_rmse(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Root mean square of the class difference, 3 digits."""
    square = F.sum(F.pow(F.col("y_pred") - F.col("y_eval"), 2) * F.col("n")) / F.sum("n")
    return cells.groupBy(*by).agg(F.round(F.sqrt(square), 3).alias("err"))


def class_report(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per-class rows and an ``avg / total`` row weighted by support."""
    per = class_scores(cells, by).where("support > 0 or predicted > 0")
    rows = per.select(*by, F.col("label").cast("int").cast("string").alias("label"),
                      "precision", "recall", "f1", "support")
    total = per.groupBy(*by).agg(
        F.lit("avg / total").alias("label"), *[_weighted(m).alias(m) for m in ("precision", "recall", "f1")],
        F.sum("support").alias("support"))
    return rows.unionByName(total)


def macro_scores(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Plain mean and population deviation over the classes, and accuracy."""
    return class_scores(cells, by).groupBy(*by).agg(
        *[f(m).alias(f"{m}_{n}") for m in ("precision", "recall", "f1")
          for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
        (F.sum("hit") / F.sum("support")).alias("accuracy"))


def cohen_kappa(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    total = F.sum("support")
    observed = F.sum("hit") / total
    chance = F.sum(F.col("support") * F.col("predicted")) / (total * total)
    return class_scores(cells, by).groupBy(*by).agg(
        F.try_divide(observed - chance, 1 - chance).alias("kappa"))


def accuracy(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.avg((F.col("y_eval") == F.col("y_pred")).cast("double")).alias("accuracy"))


def confusion_normalized(cells: DataFrame) -> DataFrame:
    """Share of each prediction within its true class."""
    share = F.col("n") / F.sum("n").over(Window.partitionBy("y_eval"))
    return cells.select("y_eval", "y_pred", "n", share.alias("share"))


def specificity_gain(cells: DataFrame, literal: bool = False) -> DataFrame:
    """Specificity tn/(tn+fp) and the null-accuracy gain for classes 0 and 1.

    The gain compares the share of the most frequent true class with the accuracy;
    ``literal`` takes the share of class 0 instead.
    """
    n = F.col("n")
    true0 = F.sum(F.when(F.col("y_eval") == 0, n).otherwise(0))
    tn = F.sum(F.when((F.col("y_eval") == 0) & (F.col("y_pred") == 0), n).otherwise(0))
    hit = F.sum(F.when(F.col("y_eval") == F.col("y_pred"), n).otherwise(0))
    base = true0 if literal else F.greatest(true0, F.sum("n") - true0)
    return cells.agg(F.try_divide(tn, true0).alias("specificity"),
                     (F.try_divide(base, hit) - 1).alias("null_accuracy_gain"))


def roc_points(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """False and true positive rate at every distinct score, highest score first.

    Rows shrink to one per score before the running totals, which work in slices, so
    neither many rows nor many scores end up in one task.
    """
    by = list(by)
    steps = (df.where(F.col(score).isNotNull())
             .groupBy(*by, F.col(score).alias("threshold"))
             .agg(F.sum(F.col(label)).cast("bigint").alias("pos"),
                  F.sum(1 - F.col(label)).cast("bigint").alias("neg")))
    run = running_totals(steps, [F.desc("threshold")],
                         {"tp": F.col("pos"), "fp": F.col("neg")}, by)
    totals = steps.groupBy(*by).agg(F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    run = run.join(totals, by) if by else run.withColumns(
        {c: totals.select(c).scalar() for c in ("all_pos", "all_neg")})
    return run.select(*by, "threshold", F.try_divide("fp", "all_neg").alias("fpr"),
                      F.try_divide("tp", "all_pos").alias("tpr"), "pos", "neg", "tp", "fp",
                      "all_pos", "all_neg")


def roc_auc(points: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the curve: every step adds a trapezoid, lowest area first."""
    area = F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2.0))
    return (points.groupBy(*by, "all_pos", "all_neg").agg(area.alias("area"))
            .select(*by, F.try_divide("area", F.col("all_pos") * F.col("all_neg").cast("double")).alias("auc"))
            .orderBy("auc"))


def explained_variance(df: DataFrame, target: str = "target", predicted: str = "predicted",
                       swapped: bool = True, by: Sequence[str] = ()) -> DataFrame:
    """1 - var(difference) / var(truth). ``swapped`` takes the prediction as the truth,
    as the published regression reports do."""
    base = F.var_pop(predicted if swapped else target)
    return df.groupBy(*by).agg((1 - F.try_divide(F.var_pop(F.col(target) - F.col(predicted)), base))
                  .alias("explained_variance"))
