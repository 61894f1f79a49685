"""Queries that fit models, with the published parameters."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.operators import evaluate, knn, models, split, tuning
from storelab.plans import jobs, tables
from storelab.plans.queries_clean import cached_learn, learn
from storelab.plans.queries_eval import BASE, predictions
from storelab.plans.registry import AS_OF, on_apps, query, r6
from storelab.session import cut, scratch_path
from storelab.sources import store
from storelab.sources.apps import apps, table

_CACHE: dict[tuple[str, str, str], str] = {}


def _cached(spark, sf_dir, name, build):
    path = _CACHE.setdefault((spark.sparkContext.applicationId, sf_dir, name), scratch_path(spark, name))
    return store.cached_table(spark, path, build)


def model_table(spark, sf_dir):
    return _cached(spark, sf_dir, "models", lambda: jobs.model_table(cached_learn(spark, sf_dir), 5))


def number_table(spark, sf_dir):
    """The same rows, classes and folds without texts and stems, for models that read none."""
    return _cached(spark, sf_dir, "numbers", lambda: jobs.model_table(learn(spark, sf_dir, with_text=False), 5, with_tokens=False))


def category_table(spark, sf_dir):
    return _cached(spark, sf_dir, "categories",
                   lambda: jobs.model_table(cached_learn(spark, sf_dir), 2, by=["category"]))


def report_rows(spark, sf_dir):
    return _cached(spark, sf_dir, "report", lambda: jobs.safe_names(
        tables.report_table(apps(spark, sf_dir, tables.REPORT_SOURCE), AS_OF)))


def _predict(spark, sf_dir, spec):
    """Fit on folds 2 to 5, predict fold 1."""
    df = (model_table if spec.get("features") == "text" else number_table)(spark, sf_dir)
    stages = jobs.build(spec).getStages()
    model = tuning.fit_stages(stages, df.where("fold <> 1"))
    asked = tuning.only_read(df.where("fold = 1"), stages, ["appId", "price_class"])
    return models.add_prediction_class(model.transform(asked)).select(
        F.lit(spec["kind"]).alias("model"), "appId", F.col("price_class").alias("y_eval"), "y_pred")


def _predict_all(spark, sf_dir, specs):
    out = None
    for spec in specs:
        part = _predict(spark, sf_dir, spec)
        out = part if out is None else out.unionByName(part)
    return out


@query("gbt_classify")
def gbt_classify(spark, sf_dir):
    return _predict(spark, sf_dir, dict(kind="gbt", trees=150, depth=5, rate=0.1, subset="sqrt"))


@query("forest_classify")
def forest_classify(spark, sf_dir):
    return _predict(spark, sf_dir, dict(kind="forest", trees=75, depth=5))


@query("tree_classify")
def tree_classify(spark, sf_dir):
    return _predict_all(spark, sf_dir, [dict(kind="tree", depth=3), dict(kind="tree", depth=3, subset="sqrt")])


@query("nb_classify")
def nb_classify(spark, sf_dir):
    return _predict_all(spark, sf_dir, [dict(kind="multinomial"), dict(kind="gaussian"),
                                        dict(kind="bernoulli", features="text", binary=True, smoothing=0.0001)])


@query("linear_classify")
def linear_classify(spark, sf_dir):
    return _predict_all(spark, sf_dir, [dict(kind="logistic", alpha=0.01, penalty="l2"),
                                        dict(kind="logistic", alpha=0.001, penalty="l1")])


@query("sgd_classify")
def sgd_classify(spark, sf_dir):
    """Linear models by gradient steps, for both losses and penalties."""
    out = None
    for loss, penalty, alpha in (("hinge", "l2", 0.01), ("log", "l2", 0.007), ("hinge", "l1", 0.001)):
        part = _predict(spark, sf_dir, dict(kind="sgd", loss=loss, penalty=penalty, alpha=alpha)).withColumn("model", F.lit(f"{loss} {penalty}"))
        out = part if out is None else out.unionByName(part)
    return out


@query("svm_classify")
def svm_classify(spark, sf_dir):
    return _predict(spark, sf_dir, dict(kind="svm", features="text", max_df=0.6, cost=10.0, iterations=1000))


@query("mlp_classify")
def mlp_classify(spark, sf_dir):
    inputs = len(K.LEARN_NUMERIC) + len(jobs.CATEGORICAL)
    return _predict(spark, sf_dir, dict(kind="mlp", layers=[inputs, 10, 10, 10, 4], iterations=200))


_DUMMY_U = "(('0x' || substr(md5(concat(\"appId\", '-0')), 1, 8))::bigint / 4294967296.0)"


@query("dummy_classify", on_apps(
    f"""select "appId", y_eval, coalesce((select min(label) from cum where {_DUMMY_U} < cum.c), (select max(label) from cum)) y_pred
 from two where "Category" = 'all'""", *BASE, 'two as (select * from preds where "Category" = \'all\')',
    "cum as (select y_eval label, sum(count(*)) over (order by y_eval) / sum(count(*)) over () c from two group by 1)"))
def dummy_classify(spark, sf_dir):
    df = predictions(spark, sf_dir).where("Category = 'all'").drop("y_pred")
    return models.dummy_predictions(df, "y_eval", "appId").select("appId", "y_eval", "y_pred")


# --- neighbours ---------------------------------------------------------------------

_VECTORS = """vecs as (select vec_id, embedding::double[] v, label, ntile(5) over (partition by label order by vec_id) fold from embeddings),
near as (select t.vec_id as row, t.label y, n.label, d from (select t.vec_id, t.label, n.vec_id near, n.label nl,
  list_distance(t.v, n.v) d from vecs t join vecs n on t.fold = 1 and n.fold <> 1
  qualify row_number() over (partition by t.vec_id order by list_distance(t.v, n.v), n.vec_id) <= 10) t,
  lateral (select t.nl as label) n)"""


def _near(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    folds = split.stratified_folds(df.select("vec_id", "label"), "label", "vec_id", 5)
    df = df.join(folds.select("vec_id", "fold"), "vec_id")
    test = df.where("fold = 1")
    return knn.neighbours(df.where("fold <> 1"), test, 10, "vec_id", "embedding", "label"), test


@query("knn_classify", f"with {_VECTORS}, uni as (select row, label from (select row, label, row_number() over "
       "(partition by row order by count(*) desc, label) rn from near group by 1, 2) where rn = 1), "
       "wei as (select row, label from (select row, label, row_number() over (partition by row order by "
       "round(sum(case when d = 0 then 1e300 else 1 / d end), 9) desc, label) rn from near group by 1, 2) where rn = 1) "
       "select distinct near.row as vec_id, y y_eval, uni.label::double y_uniform, wei.label::double y_distance "
       "from near join uni using (row) join wei using (row)")
def knn_classify(spark, sf_dir):
    found, test = _near(spark, sf_dir)
    found = cut(found)
    uniform = knn.classify(found).select("row", F.col("prediction").alias("y_uniform"))
    weighted = knn.classify(found, "distance").select("row", F.col("prediction").alias("y_distance"))
    return (test.join(uniform, F.col("vec_id") == F.col("row")).drop("row")
            .join(weighted, F.col("vec_id") == F.col("row"))
            .select("vec_id", F.col("label").alias("y_eval"), "y_uniform", "y_distance"))


@query("knn_regress", f"with {_VECTORS} select row as vec_id, any_value(y) target, round(avg(label), 6) predicted from near group by 1")
def knn_regress(spark, sf_dir):
    found, test = _near(spark, sf_dir)
    return test.join(knn.regress(found), F.col("vec_id") == F.col("row")).select(
        "vec_id", F.col("label").alias("target"), r6("prediction").alias("predicted"))


# --- regression ---------------------------------------------------------------------

def _regress(spark, sf_dir, spec):
    df = number_table(spark, sf_dir)
    stages = [*models.numeric_stages(K.LEARN_NUMERIC, jobs.CATEGORICAL), *models.regressor(spec)]
    model = Pipeline(stages=stages).fit(df.where("fold <> 1"))
    return model.transform(df.where("fold = 1")).select(
        "appId", F.col("price").alias("target"), F.col("prediction").alias("predicted"))


@query("linear_regress")
def linear_regress(spark, sf_dir):
    return _regress(spark, sf_dir, dict(kind="linear", alpha=0.0001))


@query("tree_regress")
def tree_regress(spark, sf_dir):
    return _regress(spark, sf_dir, dict(kind="tree", depth=5))


# --- tuning -------------------------------------------------------------------------

def _folded(df, k):
    """The table with k nearly equal folds instead of five."""
    return split.stratified_folds(df.drop("fold"), "price_class", ["appId", "_row"], k)


@query("grid_search")
def grid_search(spark, sf_dir):
    """All candidates on the ten stratified folds of the published search."""
    candidates = [dict(kind="tree", **c) for c in tuning.grid({"depth": [2, 3], "subset": ["all", "sqrt"]})]
    found = tuning.search(_folded(number_table(spark, sf_dir), 10), jobs.build, candidates, 10)
    return tuning.candidate_scores(found).withColumn("params", F.col("params").cast("string"))


@query("random_search")
def random_search(spark, sf_dir):
    candidates = [dict(kind="forest", **c) for c in tuning.draws({"trees": [5, 10, 20], "depth": [2, 3]}, 2, seed=1)]
    found = tuning.search(_folded(number_table(spark, sf_dir), 2), jobs.build, candidates, 2)
    return tuning.candidate_scores(found).withColumn("params", F.col("params").cast("string"))


_RULES = """rules as (select "appId", y_eval, ntile(5) over (partition by y_eval order by "appId") fold,
 unnest([{'c': 0, 'p': y_pred}, {'c': 1, 'p': 5 - y_pred}, {'c': 2, 'p': 2}]) r from preds where "Category" = 'all'),
folds as (select r.c candidate, fold, avg(case when r.p = y_eval then 1.0 else 0.0 end) accuracy from rules group by 1, 2)"""


@query("grid_best", on_apps(
    """select candidate, name, folds, round(m, 6) score_accuracy_test_mean, round(s, 6) score_accuracy_test_std from
 (select candidate, count(*) folds, avg(accuracy) m, stddev_pop(accuracy) s from folds group by 1)
 join (values (0, 'baseline'), (1, 'mirror'), (2, 'constant')) t(c, name) on c = candidate order by m desc, candidate limit 1""",
    *BASE, _RULES))
def grid_best(spark, sf_dir):
    """The record of the best candidate, for three fixed rules scored on five folds."""
    df = predictions(spark, sf_dir).where("Category = 'all'").select("appId", "y_eval", "y_pred")
    df = split.stratified_folds(df, "y_eval", "appId", 5)
    rules = F.explode(F.array(*[
        F.struct(F.lit(i).alias("candidate"), F.create_map(F.lit("rule"), F.lit(n)).alias("params"), p.alias("p"))
        for i, (n, p) in enumerate([("baseline", F.col("y_pred")), ("mirror", 5 - F.col("y_pred")),
                                    ("constant", F.lit(2))])]))
    tagged = df.select("fold", "y_eval", rules.alias("x")).select("fold", "y_eval", "x.candidate", "x.params", F.col("x.p").alias("y_pred"))
    scored = evaluate.accuracy(tagged.withColumn("name", F.col("params")["rule"]), ["candidate", "name", "fold"])
    results = scored.withColumn("split", F.lit("test")).withColumn("params", F.create_map(F.lit("rule"), F.col("name")))
    best = tuning.best_candidate(results, "accuracy")
    return best.select("candidate", F.col("params")["rule"].alias("name"), "folds",
                       *[r6(c).alias(c) for c in ("score_accuracy_test_mean", "score_accuracy_test_std")])


@query("cross_val_predict")
def cross_val_predict(spark, sf_dir):
    out = tuning.cross_val_predict(number_table(spark, sf_dir), lambda: jobs.build(dict(kind="tree", depth=3)), 5, keep=["appId"])
    return out.select("appId", "fold", "y_eval", "y_pred")


@query("learning_curve")
def learning_curve(spark, sf_dir):
    df = _folded(number_table(spark, sf_dir), 4)
    return tuning.learning_curve(df, lambda: jobs.build(dict(kind="tree", depth=3)), "appId")


@query("train_per_category")
def train_per_category(spark, sf_dir):
    """The searches of a category run, for every category with 100 rows or more."""
    def run(category, rows):
        folded = split.stratified_folds(rows.drop("fold"), "price_class", ["appId", "_row"], 2)
        out = jobs.train_run(folded, None, 2, category)
        return out.withColumn("params", F.col("params").cast("string"))
    return tuning.per_category(category_table(spark, sf_dir), run)


@query("train_run")
def train_run(spark, sf_dir):
    """The searches of a full run, on two folds."""
    out = jobs.train_run(_folded(model_table(spark, sf_dir), 2), None, 2)
    return out.withColumn("params", F.col("params").cast("string"))


@query("train_predict")
def train_predict(spark, sf_dir):
    return jobs.train_predict(report_rows(spark, sf_dir))


@query("train_predict_text")
def train_predict_text(spark, sf_dir):
    """The report run on text alone."""
    return jobs.train_predict(report_rows(spark, sf_dir), jobs.RunConfig(text_only=True))


@query("train_predict_with_text")
def train_predict_with_text(spark, sf_dir):
    """The report run with the class that the text says as a feature."""
    return jobs.train_predict(report_rows(spark, sf_dir), jobs.RunConfig(with_text=True))


@query("train_predict_price")
def train_predict_price(spark, sf_dir):
    return jobs.train_predict(report_rows(spark, sf_dir), jobs.RunConfig(price_as_class=False))


@query("report_grid")
def report_grid(spark, sf_dir):
    """Search over networks: all scores, the best one, its parameters and its test report."""
    return jobs.train_predict(report_rows(spark, sf_dir), jobs.RunConfig(grid_search=True))


@query("report_grid_preprocess")
def report_grid_preprocess(spark, sf_dir):
    """Search over the number of features and their score."""
    return jobs.train_predict(report_rows(spark, sf_dir), jobs.RunConfig(grid_search=True, grid="preprocess"))


@query("report_grid_text")
def report_grid_text(spark, sf_dir):
    """Search between linear models and neighbours on text."""
    return jobs.train_predict(report_rows(spark, sf_dir), jobs.RunConfig(grid_search=True, text_only=True, grid="text_models"))


@query("full_set_models")
def full_set_models(spark, sf_dir):
    """Out-of-fold scores of the kept models, on two folds."""
    return jobs.full_set_models(_folded(model_table(spark, sf_dir), 2), 2)


@query("category_models")
def category_models(spark, sf_dir):
    """Out-of-fold scores of the model of each category, on two folds."""
    return jobs.category_models(category_table(spark, sf_dir), 2)


@query("scoreboard_run")
def scoreboard_run(spark, sf_dir):
    """The board after one model was scored and stored, read back from what the run wrote."""
    folder = scratch_path(spark, "board")
    jobs.scoreboard_run(_folded(number_table(spark, sf_dir), 10), "fd_numeric_forest_numeric", folder)
    return store.read_scoreboard(spark, f"{folder}/scoring", ["fd_numeric_forest_numeric"])


@query("model_roundtrip")
def model_roundtrip(spark, sf_dir):
    """Predictions of a model that was saved and loaded again."""
    df = number_table(spark, sf_dir)
    fitted = jobs.build(dict(kind="tree", depth=3)).fit(df.where("fold <> 1"))
    path = store.model_path(scratch_path(spark, "saved"), "tree", with_text=False)
    store.save_model(fitted, path)
    loaded = store.load_model(path)
    return models.add_prediction_class(loaded.transform(df.where("fold = 1"))).select(
        "appId", F.col("price_class").alias("y_eval"), "y_pred")
