"""Queries that score predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from storelab.operators import evaluate, scoreboard
from storelab.plans.baseline import SOURCE, baseline_predictions, baseline_scoreboard, priced_listings
from storelab.plans.queries_join import class_sql
from storelab.plans.registry import on_apps, query, r6
from storelab.session import cut, scratch_path
from storelab.sources import store
from storelab.sources.apps import apps

BASE = [
    """base as (select "appId", price, coalesce(upper(category), (select upper(category) c from apps where price <> 0
 and category is not null group by 1 order by count(*) desc, c limit 1)) category, "similarApps" from apps where price <> 0)""",
    r"""base_ids as (select "appId", unnest(regexp_extract_all("similarApps", '"([^"]*)"', 1)) id from base)""",
    """known as (select b.*, average from base b join (select i."appId", round(avg(p.price), 9) average from base_ids i
 join (select "appId" id, max(price) price from base group by 1 having count(*) = 1) p using (id) group by 1) using ("appId"))""",
    """tagged as (select 'all' "Category", * from known union all select category, * from known where category in
 (select category from known group by 1 having count(*) >= 100))""",
    """cuts as (select "Category" cat, round(quantile_cont(price, 0.25), 9) q25, round(quantile_cont(price, 0.5), 9) q50,
 round(quantile_cont(price, 0.75), 9) q75 from tagged group by 1)""",
    f"""preds as (select "appId", "Category", price, average, {class_sql('price')} y_eval, {class_sql('average')} y_pred
 from tagged join cuts on cat = "Category")""",
]
PER_CLASS = [
    """labs as (select distinct "Category", y_eval label from preds union select distinct "Category", y_pred from preds)""",
    """counts as (select l."Category", label, count(*) filter (where y_eval = label) support,
 count(*) filter (where y_pred = label) predicted, count(*) filter (where y_eval = label and y_pred = label) hit
 from labs l join preds p on p."Category" = l."Category" group by 1, 2)""",
    """per as (select *, case when predicted = 0 then 0 else hit / predicted end prec, case when support = 0 then 0 else
 hit / support end rec, 2 * hit / (predicted + support) f1 from counts)""",
]
_WEIGHTED = ("sum(f1 * support) / sum(support) f1, sum(prec * support) / sum(support) prec, "
             "sum(rec * support) / sum(support) rec, sum(hit) / sum(support) acc")


def predictions(spark, sf_dir):
    return baseline_predictions(cut(priced_listings(apps(spark, sf_dir, SOURCE))))


def cells(spark, sf_dir):
    return evaluate.confusion(predictions(spark, sf_dir), ["Category"])


BY = ["Category"]
BOARD = [
    f"""weighted as (select "Category", {_WEIGHTED} from per group by 1)""",
    """errors as (select "Category", round(sqrt(avg(power(y_pred - y_eval, 2))), 3) err from preds group by 1)""",
    """board as (select "Category", f1, prec, rec, acc, err, concat(round(f1, 3), ' (', round_even(err, 2), ')') combined
 from weighted join errors using ("Category"))""",
]
_BOARD_SELECT = ('select "Category", round(f1, 6) f1, round(prec, 6) prec, round(rec, 6) rec, round(acc, 6) acc, err, '
                 'combined from board')


@query("baseline_scoreboard", on_apps(_BOARD_SELECT, *BASE, *PER_CLASS, *BOARD))
def baseline_scores(spark, sf_dir):
    board = baseline_scoreboard(apps(spark, sf_dir, SOURCE))
    return board.withColumns({c: r6(c) for c in ("f1", "prec", "rec", "acc")})


@query("baseline_predict", on_apps('select "appId", "Category", y_eval, y_pred from preds', *BASE))
def baseline_predict(spark, sf_dir):
    return predictions(spark, sf_dir).select("appId", "Category", "y_eval", "y_pred")


@query("predictions_diff", on_apps(
    "select 'Baseline' model, \"Category\", \"appId\", y_eval::double y_eval, y_pred::double y_pred, "
    "(y_pred - y_eval)::double diff from preds", *BASE))
def predictions_diff(spark, sf_dir):
    path = scratch_path(spark, "predictions")
    rows = scoreboard.prediction_rows(predictions(spark, sf_dir), "Baseline")
    store.write_predictions(rows, path)
    return spark.read.schema(rows.schema).parquet(path)


@query("weighted_scores", on_apps(
    'select "Category", round(f1, 6) f1, round(prec, 6) prec, round(rec, 6) rec, round(acc, 6) acc, n as rows from '
    f'(select "Category", {_WEIGHTED}, cast(sum(support) as bigint) n from per group by 1)', *BASE, *PER_CLASS))
def weighted_scores(spark, sf_dir):
    out = evaluate.weighted_scores(cells(spark, sf_dir), BY)
    return out.withColumns({c: r6(c) for c in ("f1", "prec", "rec", "acc")})


@query("class_rmse", on_apps('select * from errors', *BASE, BOARD[1]))
def class_rmse(spark, sf_dir):
    return evaluate.class_rmse(cells(spark, sf_dir), BY)


@query("scoreboard_update", on_apps(
    """select b."Category", round(b.f1, 6) "Baseline___f1", round(b.prec, 6) "Baseline___prec", round(b.rec, 6) "Baseline___rec",
 round(b.acc, 6) "Baseline___acc", b.err "Baseline___err", b.combined "Baseline___combined", m.err "mirror___err",
 round(m.acc, 6) "mirror___acc", round(m.acc, 6) "mirror___rec"
 from board b join (select "Category", round(sqrt(avg(power(5 - y_pred - y_eval, 2))), 3) err,
 avg(case when 5 - y_pred = y_eval then 1.0 else 0.0 end) acc from preds group by 1) m using ("Category")
 where b."Category" <> 'TOOLS'""", *BASE, *PER_CLASS, *BOARD))
def scoreboard_update(spark, sf_dir):
    """A board written to CSV and read back, then set for a second model; the category
    without a row stays out."""
    preds = predictions(spark, sf_dir)
    first = scoreboard.score_rows(preds).where("Category <> 'TOOLS'")
    path = scratch_path(spark, "board")
    store.write_report(first.select(F.lit(0).alias("Runs"), "Category", *[
        F.col(p).alias(f"Baseline___{p}") for p in scoreboard.PARTS]), path)
    board = store.read_scoreboard(spark, path, ["Baseline"])
    second = scoreboard.score_rows(preds.withColumn("y_pred", 5 - F.col("y_pred")))
    out = scoreboard.update(board, second, "mirror")
    names = [f"Baseline___{p}" for p in scoreboard.PARTS] + ["mirror___err", "mirror___acc", "mirror___rec"]
    return out.select("Category", *[r6(c).alias(c) if not c.endswith(("combined", "err")) else F.col(c)
                                    for c in names])


@query("results_append", on_apps(
    """select 'Baseline' model, "Category", round(f1, 6) f1, null::double err from board
 union all select 'Baseline', "Category", null, err from board""", *BASE, *PER_CLASS, *BOARD))
def results_append(spark, sf_dir):
    preds = predictions(spark, sf_dir)
    scores = scoreboard.score_rows(preds).withColumn("model", F.lit("Baseline"))
    first = scores.select("model", "Category", r6("f1").alias("f1"))
    return scoreboard.append_results(scoreboard.append_results(None, first), scores.select("model", "Category", "err"))


@query("confusion_counts", on_apps('select "Category", y_eval, y_pred, count(*) n from preds group by 1, 2, 3', *BASE))
def confusion_counts(spark, sf_dir):
    return cells(spark, sf_dir)


@query("confusion_percent", on_apps(
    'select "Category", y_eval target, y_pred predict, n count, abs(y_eval - y_pred) error_type, '
    'round(n / sum(n) over (partition by "Category", y_eval), 6) as percent from '
    '(select "Category", y_eval, y_pred, count(*) n from preds group by 1, 2, 3)', *BASE))
def confusion_percent(spark, sf_dir):
    return evaluate.confusion_percent(cells(spark, sf_dir), BY).withColumn("percent", r6("percent"))


@query("class_report", on_apps(
    """select "Category", label::varchar label, round(prec, 6) "precision", round(rec, 6) recall, round(f1, 6) f1, support from per
 union all select "Category", 'avg / total', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
 round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from per group by 1""", *BASE, *PER_CLASS))
def class_report(spark, sf_dir):
    out = evaluate.class_report(cells(spark, sf_dir), BY)
    return out.withColumns({c: r6(c) for c in ("precision", "recall", "f1")})


@query("macro_scores", on_apps(
    'select "Category", ' + ", ".join(
        f"round(avg({a}), 6) {b}_mean, round(stddev_pop({a}), 6) {b}_std" for a, b in
        (("prec", "precision"), ("rec", "recall"), ("f1", "f1")))
    + ', round(sum(hit) / sum(support), 6) accuracy from per group by 1', *BASE, *PER_CLASS))
def macro_scores(spark, sf_dir):
    out = evaluate.macro_scores(cells(spark, sf_dir), BY)
    return out.select("Category", *[r6(c).alias(c) for c in out.columns if c != "Category"])


@query("cohen_kappa", on_apps(
    'select "Category", round((po - pe) / (1 - pe), 6) kappa from (select "Category", sum(hit) / sum(support) po, '
    'sum(support * predicted) / (sum(support) * sum(support)) pe from per group by 1)', *BASE, *PER_CLASS))
def cohen_kappa(spark, sf_dir):
    return evaluate.cohen_kappa(cells(spark, sf_dir), BY).withColumn("kappa", r6("kappa"))


@query("accuracy", on_apps(
    'select "Category", round(avg(case when y_eval = y_pred then 1.0 else 0.0 end), 6) accuracy from preds group by 1', *BASE))
def accuracy(spark, sf_dir):
    return evaluate.accuracy(predictions(spark, sf_dir), BY).withColumn("accuracy", r6("accuracy"))


# two classes: cheap (classes 1, 2) and dear (classes 3, 4), over the whole set
_BINARY = """two as (select case when y_eval >= 3 then 1 else 0 end y_eval, case when y_pred >= 3 then 1 else 0 end y_pred
 from preds where "Category" = 'all')"""


def _two(spark, sf_dir):
    df = predictions(spark, sf_dir).where("Category = 'all'")
    return df.select("appId", "price", "similarAppsAvgPrice", (F.col("y_eval") >= 3).cast("int").alias("y_eval"),
                     (F.col("y_pred") >= 3).cast("int").alias("y_pred"))


@query("confusion_normalized", on_apps(
    "select y_eval, y_pred, count(*) n, round(count(*) / sum(count(*)) over (partition by y_eval), 6) share from two group by 1, 2",
    *BASE, _BINARY))
def confusion_normalized(spark, sf_dir):
    out = evaluate.confusion_normalized(evaluate.confusion(_two(spark, sf_dir)))
    return out.withColumn("share", r6("share"))


@query("specificity_gain", on_apps(
    """select round(tn / t0, 6) specificity, round(greatest(t0, n - t0) / hit - 1, 6) null_accuracy_gain, 'most frequent' as form
 from (select count(*) filter (where y_eval = 0 and y_pred = 0) tn, count(*) filter (where y_eval = 0) t0,
 count(*) filter (where y_eval = y_pred) hit, count(*) n from two)
 union all select round(tn / t0, 6), round(t0 / hit - 1, 6), 'class 0'
 from (select count(*) filter (where y_eval = 0 and y_pred = 0) tn, count(*) filter (where y_eval = 0) t0,
 count(*) filter (where y_eval = y_pred) hit from two)""", *BASE, _BINARY))
def specificity_gain(spark, sf_dir):
    counts = evaluate.confusion(_two(spark, sf_dir))
    meant = evaluate.specificity_gain(counts).withColumn("form", F.lit("most frequent"))
    literal = evaluate.specificity_gain(counts, literal=True).withColumn("form", F.lit("class 0"))
    return meant.unionByName(literal).withColumns({c: r6(c) for c in ("specificity", "null_accuracy_gain")})


_SCORES = """scored as (select 'similar' model, y, average score from lab union all select 'reviews', y,
 try_cast("totalNrOfReviews" as double) from lab join apps using ("appId") where try_cast("totalNrOfReviews" as double) is not null)"""
_LAB = """lab as (select "appId", average, case when y_eval >= 3 then 1 else 0 end y from preds where "Category" = 'all')"""


def _scored(spark, sf_dir):
    two = _two(spark, sf_dir)
    reviews = apps(spark, sf_dir, ["appId", "totalNrOfReviews"]).select(
        "appId", F.col("totalNrOfReviews").try_cast("double").alias("reviews"))
    items = F.explode(F.array(
        F.struct(F.lit("similar").alias("model"), F.col("similarAppsAvgPrice").alias("score")),
        F.struct(F.lit("reviews").alias("model"), F.col("reviews").alias("score"))))
    return two.join(reviews, "appId").select(F.col("y_eval").alias("y"), items.alias("x")).select("y", "x.*")


@query("roc_curve", on_apps(
    """select model, round(threshold, 6) threshold, round(sum(neg) over w / sum(neg) over (partition by model), 6) fpr,
 round(sum(pos) over w / sum(pos) over (partition by model), 6) tpr from
 (select model, score threshold, sum(y) pos, sum(1 - y) neg from scored group by 1, 2)
 window w as (partition by model order by threshold desc)""", *BASE, _LAB, _SCORES))
def roc_curve(spark, sf_dir):
    points = evaluate.roc_points(_scored(spark, sf_dir), "y", "score", ["model"])
    return points.select("model", r6("threshold").alias("threshold"), r6("fpr").alias("fpr"), r6("tpr").alias("tpr"))


@query("roc_auc", on_apps(
    """select model, round((sum(case when y = 1 then r end) - p * (p + 1) / 2) / (p * n), 6) auc from
 (select model, y, rank() over (partition by model order by score)
   + (count(*) over (partition by model, score) - 1) / 2.0 r, sum(y) over (partition by model) p,
   sum(1 - y) over (partition by model) n from scored) group by model, p, n""", *BASE, _LAB, _SCORES))
def roc_auc(spark, sf_dir):
    points = evaluate.roc_points(_scored(spark, sf_dir), "y", "score", ["model"])
    return evaluate.roc_auc(points, ["model"]).withColumn("auc", r6("auc"))


@query("explained_variance", on_apps(
    """select 'swapped' as form, round(1 - var_pop(price - average) / var_pop(average), 6) explained_variance from preds
 where "Category" = 'all' union all select 'meant', round(1 - var_pop(price - average) / var_pop(price), 6) from preds
 where "Category" = 'all'""", *BASE))
def explained_variance(spark, sf_dir):
    df = predictions(spark, sf_dir).where("Category = 'all'").select(
        "appId", F.col("price").alias("target"), F.col("similarAppsAvgPrice").alias("predicted"))
    swapped = evaluate.explained_variance(df).withColumn("form", F.lit("swapped"))
    meant = evaluate.explained_variance(df, swapped=False).withColumn("form", F.lit("meant"))
    return swapped.unionByName(meant).withColumn("explained_variance", r6("explained_variance"))


@query("regression_pairs", on_apps(
    'select "appId", round(average, 6) predicted, price target from preds where "Category" = \'all\' order by "appId" limit 200',
    *BASE))
def regression_pairs(spark, sf_dir):
    df = predictions(spark, sf_dir).where("Category = 'all'").select(
        "appId", F.col("price").alias("target"), r6("similarAppsAvgPrice").alias("predicted"))
    return store.sample_pairs(df, "appId")
