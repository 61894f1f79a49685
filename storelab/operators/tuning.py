"""Searches and cross-validation. The driver loops over candidates and folds; every fit
and every score is a Spark job, and only score rows reach the driver."""

from __future__ import annotations

import itertools
import random
import re
import time
from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelab.operators.evaluate import confusion, weighted_scores
from storelab.operators.models import TextPrediction, add_prediction_class
from storelab.session import cut

METRICS = {"f1_weighted": "f1", "precision_weighted": "prec", "recall_weighted": "rec", "accuracy": "acc"}
RESULT_SCHEMA = ("candidate int, params map<string,string>, fold int, split string, f1_weighted double, "
                 "precision_weighted double, recall_weighted double, accuracy double, "
                 "fit_seconds double, score_seconds double")
Build = Callable[[dict], Pipeline]


def names_read(stages: Sequence) -> set[str]:
    """All column names, and pieces of statements, that the parameters of stages mention."""
    found: set[str] = set()
    for stage in stages:
        values = [stage.getOrDefault(p) for p in stage.params if stage.isDefined(p)]
        for v in values:
            if isinstance(v, str):
                found |= {v, *re.findall(r"\w+", v)}
            elif isinstance(v, list | tuple):
                found |= {x for x in v if isinstance(x, str)}
    return found


def only_read(df: DataFrame, stages: Sequence, keep: Sequence[str] = ()) -> DataFrame:
    """The columns that the stages read or that are kept; texts and tokens that no stage reads
    any more would otherwise be written again after each step."""
    read = names_read(stages) | set(keep)
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c in read])


def fit_stages(stages: Sequence, df: DataFrame, keep: Sequence[str] = ()) -> PipelineModel:
    """As ``Pipeline.fit``, but the result of a text step is written, as few columns as the
    stages behind it read, and not worked out again by each of them."""
    made, rows = [], only_read(df, stages, keep)
    for i, stage in enumerate(stages):
        made.append(stage.fit(rows) if isinstance(stage, Estimator) else stage)
        if i + 1 < len(stages):
            rows = only_read(made[-1].transform(rows), stages[i + 1:], keep)
            if isinstance(stage, TextPrediction):
                rows = cut(rows)
    return PipelineModel(made)


def grid(options: dict[str, Sequence]) -> list[dict]:
    """All combinations of the listed values."""
    return [dict(zip(options, values)) for values in itertools.product(*options.values())]


def draws(options: dict[str, Sequence], n: int, seed: int = 0) -> list[dict]:
    """``n`` different combinations, drawn with a seed."""
    every = grid(options)
    return random.Random(seed).sample(every, min(n, len(every)))


def search(df: DataFrame, build: Build, candidates: Sequence[dict], folds: int,
           fold: str = "fold", workers: int = 4) -> DataFrame:
    """Four scores per candidate, fold and side (train, test).

    ``df`` has the columns that the pipeline reads, ``label`` and ``fold``.
    """
    read = [s for c in candidates for s in build(c).getStages()]
    data = cut(only_read(df, read, ["label", fold]))

    def run(job: tuple[int, dict, int]) -> list[tuple]:
        i, params, k = job
        start = time.perf_counter()
        model = fit_stages(build(params).getStages(), data.where(F.col(fold) != k))
        fitted = time.perf_counter()
        scored = model.transform(data).select(
            F.when(F.col(fold) == k, "test").otherwise("train").alias("split"),
            F.col("label").alias("y_eval"), F.col("prediction").alias("y_pred"))
        rows = weighted_scores(confusion(scored, ["split"]), ["split"]).collect()
        took = time.perf_counter() - fitted
        text = {a: str(b) for a, b in params.items()}
        return [(i, text, k, r.split, r.f1, r.prec, r.rec, r.acc, fitted - start, took) for r in rows]

    jobs = [(i, p, k) for i, p in enumerate(candidates) for k in range(1, folds + 1)]
    with ThreadPoolExecutor(workers) as pool:
        rows = [r for part in pool.map(run, jobs) for r in part]
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA)


def candidate_scores(results: DataFrame) -> DataFrame:
    """Mean and population deviation over the folds, one row per candidate."""
    metrics = [m for m in METRICS if m in results.columns]
    aggs = [f(F.when(F.col("split") == s, F.col(m))).alias(f"score_{m}_{s}_{n}")
            for m in metrics for s in ("train", "test")
            for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    times = [f(f"{t}_seconds").alias(f"time_{t}_{n}") for t in ("fit", "score")
             if f"{t}_seconds" in results.columns
             for n, f in (("mean", F.avg), ("std", F.stddev_pop))]
    keys = ["candidate"]
    return results.groupBy(*keys).agg(F.first("params").alias("params"),
                                      F.countDistinct("fold").alias("folds"), *aggs, *times)


def best_candidate(results: DataFrame, metric: str = "f1_weighted") -> DataFrame:
    """The candidate with the best mean test score, the first one on ties."""
    return (candidate_scores(results)
            .orderBy(F.col(f"score_{metric}_test_mean").desc_nulls_last(), "candidate").limit(1))


def refit_best(df: DataFrame, build: Build, candidates: Sequence[dict], results: DataFrame,
               metric: str = "f1_weighted"):
    """The best candidate fitted on all rows."""
    best = best_candidate(results, metric).first()
    return build(candidates[best.candidate]).fit(df)


Steps = Callable[[dict], list[tuple[str, object]]]


def search_steps(df: DataFrame, steps: Steps, candidates: Sequence[dict], folds: int,
                 fold: str = "fold", workers: int = 4) -> tuple[DataFrame, int]:
    """As ``search``, for candidates given as named steps: candidates with the same first
    steps share their fits. Gives the scores and the number of fits.

    A name says all that matters of a step. Per fold the names form a prefix tree; each of
    its nodes is fitted once, and its result is written once for the steps behind it. Branches
    that start from one result run side by side, as a fit may be one long task. First steps
    that are fitted to nothing are the same in all folds and are done once before.
    """
    lists = [steps(c) for c in candidates]
    read = [s for one in lists for _, s in one]
    data, start = cut(only_read(df, read, ["label", fold])), 0
    while (all(len(one) > start + 1 for one in lists) and len({one[start][0] for one in lists}) == 1
           and not isinstance(lists[0][start][1], Estimator)):
        later = [s for one in lists for _, s in one[start + 1:]]
        data, start = cut(only_read(lists[0][start][1].transform(data), later, ["label", fold])), start + 1

    def walk(k: int, own: list[int], depth: int, rows: DataFrame, spent: float) -> tuple[list[tuple], int]:
        def branch(name: str) -> tuple[list[tuple], int]:
            out, fits = [], 1
            group = [i for i in own if lists[i][depth][0] == name]
            stage, begun = lists[group[0]][depth][1], time.perf_counter()
            made = Pipeline(stages=[stage]).fit(rows.where(F.col(fold) != k))
            after, took = made.transform(rows), spent + time.perf_counter() - begun
            done = [i for i in group if len(lists[i]) == depth + 1]
            if done:
                begun = time.perf_counter()
                scored = after.select(F.when(F.col(fold) == k, "test").otherwise("train").alias("split"),
                                      F.col("label").alias("y_eval"), F.col("prediction").alias("y_pred"))
                scores = weighted_scores(confusion(scored, ["split"]), ["split"]).collect()
                seconds = time.perf_counter() - begun
                out += [(i, {a: str(b) for a, b in candidates[i].items()}, k, r.split, r.f1, r.prec, r.rec, r.acc, took, seconds)
                        for i in done for r in scores]
            rest = [i for i in group if len(lists[i]) > depth + 1]
            if rest:
                later = [s for i in rest for _, s in lists[i][depth + 1:]]
                more, n = walk(k, rest, depth + 1, cut(only_read(after, later, ["label", fold])), took)
                out, fits = out + more, fits + n
            return out, fits

        names = list(dict.fromkeys(lists[i][depth][0] for i in own))
        with ThreadPoolExecutor(workers) as branches:
            found = list(branches.map(branch, names))
        return [r for out, _ in found for r in out], sum(n for _, n in found)

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(lambda k: walk(k, list(range(len(lists))), start, data, 0.0), range(1, folds + 1)))
    rows = [r for part, _ in parts for r in part]
    return df.sparkSession.createDataFrame(rows, RESULT_SCHEMA), start + sum(n for _, n in parts)


def cross_val_predict(df: DataFrame, build: Callable[[], Pipeline], folds: int,
                      fold: str = "fold", workers: int = 4, keep: Sequence[str] | None = None) -> DataFrame:
    """Every row with the prediction of a model that has not seen its fold.

    ``keep`` names the columns wanted beside ``label``, the fold and the predictions, all if not given.
    """
    wanted = list(dict.fromkeys([*(df.columns if keep is None else keep), "label", fold]))
    data = cut(only_read(df, build().getStages(), wanted))

    def run(k: int) -> DataFrame:
        model = fit_stages(build().getStages(), data.where(F.col(fold) != k), ["label"])
        return cut(model.transform(data.where(F.col(fold) == k)).select(*[F.col(f"`{c}`") for c in wanted], "prediction"))

    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(run, range(1, folds + 1)))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return add_prediction_class(out).withColumn("y_eval", (F.col("label") + 1).cast("int"))


def per_category(df: DataFrame, run: Callable[[str, DataFrame], DataFrame], column: str = "category",
                 rows: int = 100, workers: int = 4) -> DataFrame:
    """``run`` for every category with at least ``rows`` rows, results put together.

    The frame is written once with a folder per category, so that each run reads its
    category only.
    """
    # an empty name cannot be a folder, so the folders are named after a sign and the category
    data = cut(df.withColumn("_part", F.concat(F.lit("="), F.col(column).cast("string"))), ["_part"])
    names = sorted(r[column] for r in data.groupBy(column).agg(F.count("*").alias("n"))
                   .where(F.col("n") >= rows).select(column).collect() if r[column] is not None)
    if not names:
        raise ValueError(f"no {column} has {rows} rows")
    with ThreadPoolExecutor(workers) as pool:
        parts = list(pool.map(lambda n: run(n, data.where(F.col("_part") == f"={n}").drop("_part")), names))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def learning_curve(df: DataFrame, build: Callable[[], Pipeline], key: str,
                   sizes: Sequence[float] = (0.05, 0.1, 0.3, 0.5, 0.7, 0.9, 1.0), folds: int = 4,
                   fold: str = "fold", workers: int = 4, seed: int = 0, classes: bool = True) -> DataFrame:
    """Mean and deviation of the accuracy, or of the explained variance without ``classes``,
    for growing shares of the training rows."""
    from storelab.operators.split import share_of
    data = cut(only_read(df.withColumn("_share", share_of(key, seed)), build().getStages(), ["label", fold, "_share"]))

    def run(job: tuple[float, int]) -> list[tuple]:
        size, k = job
        used = (F.col(fold) != k) & (F.col("_share") < size)
        model = fit_stages(build().getStages(), data.where(used))
        side = F.when(F.col(fold) == k, "test").when(used, "train")
        good = (F.avg((F.col("prediction") == F.col("label")).cast("double")) if classes else
                1 - F.try_divide(F.var_pop(F.col("label") - F.col("prediction")), F.var_pop("prediction")))
        rows = (model.transform(data).select(side.alias("side"), "label", "prediction").where("side is not null")
                .groupBy("side").agg(good.alias("acc"), F.count("*").alias("n")).collect())
        return [(float(size), k, r.side, r.acc, r.n) for r in rows]

    with ThreadPoolExecutor(workers) as pool:
        rows = [r for part in pool.map(run, itertools.product(sizes, range(1, folds + 1))) for r in part]
    return scores_frame(df.sparkSession, rows)


def scores_frame(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    points = spark.createDataFrame(rows, "size double, fold int, side string, accuracy double, n bigint")
    return points.groupBy("size", "side").agg(
        F.avg("accuracy").alias("accuracy_mean"), F.stddev_pop("accuracy").alias("accuracy_std"),
        F.avg("n").alias("rows_mean"))
