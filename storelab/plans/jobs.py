"""The runs: report (train, predict, report), learn (tune and record) and scoreboard
(out-of-fold predictions and scores)."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.functions import parse
from storelab.operators import clean, evaluate, models, profile, related, scoreboard, split, stages, target, text, tuning
from storelab.session import cut
from storelab.sources import store

# Grids of the learning runs.
TEXT_GRID = {"min_df": [0.25, 0.4], "max_df": [0.6, 0.75]}
GRIDS = {
    "forest_numeric": {"trees": [50, 75, 100], "depth": [3, 5]},
    "gradient_numeric": {"rate": [0.01, 0.1, 1.0], "trees": [150], "depth": [3, 5]},
    "quick_numeric": {"depth": [3], "subset": ["sqrt"]},
    "bnb_text": {**TEXT_GRID, "binary": [True], "smoothing": [0.0001, 0.001, 0.01]},
    "gradient_text": {**TEXT_GRID, "rate": [0.1, 1.0], "trees": [50, 100], "depth": [5, 7]},
    "svm_text": {**TEXT_GRID, "cost": [1.0, 10.0, 100.0], "tol": [0.01], "iterations": [1000]},
}
KINDS = {"forest_numeric": dict(kind="forest"), "gradient_numeric": dict(kind="gbt"),
         "quick_numeric": dict(kind="tree"), "bnb_text": dict(kind="bernoulli", features="text"),
         "gradient_text": dict(kind="gbt", features="text"), "svm_text": dict(kind="svm", features="text")}
# Grids of the report runs.
_BOOSTING = dict(kind="gbt", rate=0.1, trees=500, depth=3)
REPORT_GRIDS = {
    "text": [*[dict(kind="sgd", loss="hinge", alpha=a, penalty=p) for a in (0.001, 0.0001, 0.01) for p in ("l1", "l2")],
             *[dict(kind="knn", k=k, weights=w) for k in (5, 10, 20) for w in ("uniform", "distance")]],
    "class": [dict(kind="mlp", hidden=h) for h in ((5, 5), (100,), (100, 100), (10, 10, 10))],
    "preprocess": [dict(_BOOSTING, k_best=k, score=s) for k in (10, 15, 30) for s in ("chi2", "f")],
    "ngrams": [dict(kind="sgd", loss="hinge", alpha=0.0001, grams=g) for g in ((3, 3), (2, 4), (3, 5))],
    "text_models": [dict(kind="sgd", loss="hinge", alpha=0.0001), dict(kind="knn", k=10, weights="distance")],
}


@dataclass(frozen=True)
class RunConfig:
    """Switches of a report run."""

    text_only: bool = False
    with_text: bool = False
    per_category: bool = False
    price_as_class: bool = True
    cross_validate: bool = False
    grid_search: bool = False
    grid: str | None = None
    k_best: int = 15
    selector: str = "chi2"
    all_models: bool = False
    documents: str | None = None
    min_rows: int = 100


# --- learning runs ------------------------------------------------------------------

def model_table(learn: DataFrame, folds: int = 10, with_tokens: bool = True,
                by: Sequence[str] = ()) -> DataFrame:
    """Learning table with class, label and fold; for text models also the text and its stems.
    Other models' rows are written without the text, if there is one.

    Listing ids may repeat: every row gets a number of its own, written once, on which
    folds and stems are put back, so as many rows come out as go in.
    """
    learn = learn if with_tokens else learn.drop("text")
    written = cut(learn.withColumns({"category_name": parse.game_prefix(F.col("category")),
                                     "_row": F.monotonically_increasing_id()}))
    df = written.drop("text")  # texts stay where they are until the narrow columns are ready
    if by:
        df = target.add_price_class_by(df.dropna(subset=list(by)), target.price_cuts(df, by=by), by[0],
                                       {"price": "price_class"})
        df = df.withColumn("_stratum", F.concat_ws("|", *by, F.col("price_class").cast("string")))
    else:
        df = target.add_price_class(df, target.price_cuts(df), name="price_class")
        df = df.withColumn("_stratum", F.col("price_class").cast("string"))
    folded = split.stratified_folds(df.select("_row", "appId", "_stratum"), "_stratum", ["appId", "_row"], folds)
    df = df.drop("_stratum").join(folded.select("_row", "fold"), "_row")
    if with_tokens:
        kept = written.select("_row", "text") if not by else written.dropna(subset=list(by)).select("_row", "text")
        df = df.join(text.stemmed_documents(kept, "_row", "text"), "_row")
    return models.add_label(df)


CATEGORICAL = ["installs", "contentRating", "category_name"]


def build_steps(spec: dict, category: str | None = None, text_model: dict | None = None,
                text_limits: dict | None = None) -> list[tuple[str, object]]:
    """Named stages of a learning model; category runs leave out installs and content rating.

    Few rows may have no token within the limits; text then says the most frequent class.
    """
    return models.pipeline_steps(spec, K.LEARN_NUMERIC, CATEGORICAL if category is None else [],
                                 text_model, text_limits, allow_empty=True)


def build(spec: dict, category: str | None = None, **text_options) -> Pipeline:
    """Pipeline of a learning model."""
    return Pipeline(stages=[s for _, s in build_steps(spec, category, **text_options)])


def train_run(table: DataFrame, searches: dict[str, dict] | None = None, folds: int = 10,
              category: str | None = None, text: bool = True, **text_options) -> DataFrame:
    """Tune each algorithm, record its best candidate and the dummy: one row per search."""
    grids = {n: GRIDS[n] for n in ("forest_numeric", "gradient_numeric")} if searches is None else searches
    results = None
    for name, options in grids.items():
        spec = dict(KINDS[name])
        if text and "features" not in spec:
            spec["features"] = "all"
        candidates = [{**spec, **c} for c in tuning.grid(options)]
        found, fits = tuning.search_steps(table, lambda c: build_steps(c, category, **text_options), candidates, folds)
        steps = [n.split(" ")[0] for n, _ in build_steps(spec, category, **text_options)]
        row = tuning.best_candidate(cut(found)).withColumns({
            "model": F.lit(name), "grid": F.lit(json.dumps(options)), "steps": F.lit(", ".join(dict.fromkeys(steps))),
            "features": F.lit(", ".join([*K.LEARN_NUMERIC, *(CATEGORICAL if category is None else [])])), "fits": F.lit(fits)})
        results = scoreboard.append_results(results, row)
    drawn = models.dummy_predictions(table, "price_class", "appId").select(
        "fold", F.col("price_class").alias("y_eval"), "y_pred")
    scores = evaluate.weighted_scores(evaluate.confusion(drawn, ["fold"]), ["fold"])
    dummy = scores.agg(*[f(c).alias(f"score_{m}_test_{n}") for m, c in tuning.METRICS.items()
                         for n, f in (("mean", F.avg), ("std", F.stddev_pop))],
                       F.count("*").alias("folds")).withColumn("model", F.lit("dummy"))
    results = scoreboard.append_results(results, dummy)
    return results if category is None else results.withColumn("category", F.lit(category))


# --- scoreboard runs ----------------------------------------------------------------

def full_set_models(table: DataFrame, folds: int = 10, names: Sequence[str] | None = None) -> DataFrame:
    """Scores of the models kept for the whole set, from out-of-fold predictions."""
    out = None
    for name in names or K.FULL_SET_MODELS:
        preds = tuning.cross_val_predict(table, lambda: build(K.FULL_SET_MODELS[name]), folds, keep=["appId"])
        rows = scoreboard.score_rows(preds.withColumn("Category", F.lit("all"))).withColumn("model", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out


def scoreboard_run(table: DataFrame, name: str, folder: str, folds: int = 10, category: str | None = None,
                   board: DataFrame | None = None) -> DataFrame:
    """Score a model out of fold, store its predictions and the model fitted on all rows, and
    set its columns on the board, which is written to ``folder/scoring`` and returned."""
    spec = K.FULL_SET_MODELS[name] if category is None else models.category_spec(category)
    place = category or "all"
    preds = tuning.cross_val_predict(table, lambda: build(spec, category), folds, keep=["appId"]).withColumn("Category", F.lit(place))
    store.write_predictions(scoreboard.prediction_rows(preds, name), f"{folder}/predictions")
    store.save_model(tuning.fit_stages(build(spec, category).getStages(), table), store.model_path(folder, name, category))
    if board is None:
        board = table.sparkSession.createDataFrame([(1, place)], "Runs int, Category string")
    out = cut(scoreboard.update(board, scoreboard.score_rows(preds), name))
    store.write_report(out, f"{folder}/scoring")
    return out


def category_models(table: DataFrame, folds: int = 10, min_rows: int = 100) -> DataFrame:
    """Scores of the model of each category; cuts and folds are those of the category."""
    def run(category: str, rows: DataFrame) -> DataFrame:
        preds = tuning.cross_val_predict(rows, lambda: build(models.category_spec(category), category), folds, keep=["appId"])
        return scoreboard.score_rows(preds.withColumn("Category", F.lit(category)))

    scores = tuning.per_category(table, run, "category", min_rows)
    return scores.withColumn("model", F.lit("cs_all_gradient_numeric"))


# --- report files -------------------------------------------------------------------

def write_documents(columns: DataFrame, authors: DataFrame, folder: str) -> dict[str, str]:
    """The tables of the data report, as CSV: numeric statistics, value counts of the
    categories, frequent authors and feature names. Gives the path of each."""
    numeric = [c for c in ["price", *K.SCALED_COLUMNS] if c in columns.columns]
    categories = [c for c in ["price_range_index", *K.ONE_HOT_COLUMNS, *K.ONE_HOT_NUMERIC] if c in columns.columns]
    documents = {"numeric_stats": profile.describe_numeric(columns, numeric),
                 "value_counts": profile.value_counts_all(columns, categories),
                 "frequent_authors": related.author_counts(authors, 1),
                 "columns": store.feature_columns(columns.drop(*NOT_FEATURES))}
    for name, df in documents.items():
        store.write_report(df, f"{folder}/{name}")
    return {name: f"{folder}/{name}" for name in documents}


# --- report runs --------------------------------------------------------------------

NOT_FEATURES = ["appId", "similarApps", "name", "appUrl", "text", "tokens", "price", "price_range_index",
                "label", "fold", "_row", *[f"similarApps_{s}" for s in K.SIMILAR_STATS]]
LEFT_OUT = {n.replace("%", "_") for n in NOT_FEATURES}


def report_rows(report: DataFrame, drop: Sequence[str] = ()) -> DataFrame:
    """Rows of the report table with a text and a price, with label and a shuffled fold 1 to 5.

    Other numbers that are missing, such as the shares of a listing without stars, are 0.
    """
    df = report.drop(*drop).dropna(subset=["text", "price", "price_range_index"])
    df = df.fillna(0, subset=stages.numeric_columns(df, LEFT_OUT))
    # ids may repeat, so folds come back by a row number that is written once
    df = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    folds = split.shuffled_folds(df.select("_row", "appId", "price_range_index"), "price_range_index",
                                 ["appId", "_row"], 5)
    return models.add_label(df.join(folds.select("_row", "fold"), "_row"), "price_range_index")


def safe_names(df: DataFrame) -> DataFrame:
    """Column names without dots and blanks, which vector assembly cannot read; names that
    become equal are told apart by a number."""
    names: list[str] = []
    for c in df.columns:
        plain = name = "".join(ch if ch.isalnum() or ch == "_" else "_" for ch in c)
        n = 1
        while name in names:
            n += 1
            name = f"{plain}_{n}"
        names.append(name)
    return df.toDF(*names)


def front_steps(config: RunConfig, columns: Sequence[str], scaled: Sequence[str], spec: dict) -> list[tuple[str, object]]:
    """Named steps before the model: text, scaling and selection; ``spec`` may set k_best, score and grams."""
    low, high = spec.get("grams", (2, 4))
    grams = (f"grams {low} {high}", stages.WordGrams(low=low, high=high))
    if config.text_only:
        return [grams]
    out, inputs = [], list(columns)
    if config.with_text:
        predictor = models.TextPrediction(models.build_models(text_only=True), dict(minDF=0.0), "text_class")
        out, inputs = [grams, ("text class", predictor)], [*inputs, "text_class"]
    score = spec.get("score", config.selector) if config.price_as_class else "f_regression"
    k = spec.get("k_best", config.k_best)
    best = stages.BestColumns(inputCols=inputs, k=k, score=score, labelCol="label" if config.price_as_class else "price")
    return [*out, ("scaling", stages.MinMaxColumns(inputCols=list(scaled))), (f"best {k} {score}", best)]


def model_stages(config: RunConfig, spec: dict, inputs: int) -> list:
    if config.text_only:
        return models.text_classifier(spec, dict(minDF=0.0))
    if not config.price_as_class:
        return models.regressor(spec)
    if spec["kind"] == "mlp":
        spec = {**spec, "layers": [min(spec.get("k_best", config.k_best), inputs), *spec["hidden"], 4]}
    return models.classifier(spec)


def train_predict(report: DataFrame, config: RunConfig = RunConfig()) -> DataFrame:
    """One report run: rows (category, model, part, item, value, support).

    ``part`` is ``accuracy`` or ``explained_variance`` (items train and test); ``precision``,
    ``recall`` and ``report`` (f1) of the class report; ``detail`` for the share of each
    prediction within its target; ``curve`` for a learning curve; for a search ``grid`` (all
    candidates), ``best_score`` and ``best_parameter``. With ``documents`` set, fitted
    pipelines, reports and the names of the feature columns are stored below that folder.
    """
    if config.grid_search and not config.price_as_class:
        raise ValueError("there is no grid for regression models")
    rows = cut(report_rows(safe_names(report)))
    if config.per_category and not config.cross_validate:
        return tuning.per_category(clean.per_category(rows), lambda c, df: _one_run(df.drop("category"), config, c),
                                   "category", config.min_rows, workers=2)
    return _one_run(rows, config, "all")


def _one_run(rows: DataFrame, config: RunConfig, category: str) -> DataFrame:
    columns = stages.numeric_columns(rows, LEFT_OUT)
    scaled = [c for c in K.SCALED_COLUMNS if c in columns]
    keep = ["appId", "_row", "text", "price", "label", "fold"]
    df = rows.select(*keep, *([] if config.text_only else columns))
    inputs = len(columns) + config.with_text
    train, order = df.where("fold <> 1"), ["appId", "_row"]

    def steps(spec: dict) -> list[tuple[str, object]]:
        last = model_stages(config, spec, inputs)
        return [*front_steps(config, columns, scaled, spec), *[(f"{i} {sorted(spec.items())}", s) for i, s in enumerate(last)]]

    def build(spec: dict) -> Pipeline:
        return Pipeline(stages=[s for _, s in steps(spec)])

    def fit(spec: dict) -> PipelineModel:
        return tuning.fit_stages(build(spec).getStages(), train)

    if config.documents and not config.text_only:
        store.write_report(store.feature_columns(df.select(*columns)), f"{config.documents}/{_place(category)}/columns")
    out = None
    if config.grid_search and not config.cross_validate:
        found = REPORT_GRIDS[config.grid or ("text" if config.text_only else "class")]
        out = _search_run(train, df, steps, fit, found, config, category)
    else:
        for spec in models.build_models(config.text_only, config.price_as_class, config.all_models):
            if config.cross_validate:
                part = _curve_run(train, build, spec, order, category, config)
            else:
                fitted = fit(spec)
                part = _scores(fitted, df, spec["kind"], config, category)
            out = part if out is None else out.unionByName(part)
    out = cut(out)
    if config.documents:
        store.write_report(out, f"{config.documents}/{_place(category)}/{_kind(config)}_{store.variant(config.text_only, config.with_text)}")
    return out


def _kind(config: RunConfig) -> str:
    return "curve" if config.cross_validate else "grid_report" if config.grid_search else \
        "class_report" if config.price_as_class else "regression_report"


def _place(category: str) -> str:
    return "all" if category == "all" else f"per_category/{category}"


def _curve_run(train: DataFrame, build, spec: dict, order: list[str], category: str, config: RunConfig) -> DataFrame:
    strata = train if config.price_as_class else train.withColumn("label", F.lit(0.0))
    folded = split.stratified_folds(strata.drop("fold"), "label", order, 4)
    if not config.price_as_class:
        folded = folded.withColumn("label", F.col("price"))
    curve = tuning.learning_curve(folded, lambda: build(spec), "_row", classes=config.price_as_class)
    return _result(curve.select(F.concat_ws(" ", "side", "size").alias("item"), F.col("accuracy_mean").alias("value"),
                                F.col("rows_mean").cast("bigint").alias("support")), category, spec["kind"], "curve")


def _search_run(train: DataFrame, df: DataFrame, steps, fit, candidates: list[dict], config: RunConfig, category: str) -> DataFrame:
    """Scores of all candidates, then the best one fitted again and scored on the test rows."""
    folded = split.stratified_folds(train.drop("fold"), "label", ["appId", "_row"], 3)

    def search_steps(spec: dict) -> list[tuple[str, object]]:
        first, *rest = steps(spec)
        return [first, *([("token numbers", stages.TokenNumbers())] if config.text_only else []), *rest]

    found, _ = tuning.search_steps(folded, search_steps, candidates, 3)
    found = cut(found)
    best = tuning.best_candidate(found, "accuracy").first()
    spec = candidates[best.candidate]
    scores = tuning.candidate_scores(found).select(
        F.col("params").cast("string").alias("item"), F.col("score_accuracy_test_mean").alias("value"), F.col("folds").alias("support"))
    told = df.sparkSession.createDataFrame(
        [(category, spec["kind"], "best_score", "accuracy", float(best.score_accuracy_test_mean), int(best.folds))]
        + [(category, spec["kind"], "best_parameter", f"{a}={b}", None, None) for a, b in sorted(spec.items())], RUN_SCHEMA)
    fitted = fit(spec)
    return (_result(scores, category, "all", "grid").unionByName(told)
            .unionByName(_scores(fitted, df, spec["kind"], config, category)))


RUN_SCHEMA = "category string, model string, part string, item string, value double, support bigint"


def _result(df: DataFrame, category: str, model: str, part: str) -> DataFrame:
    return df.select(F.lit(category).alias("category"), F.lit(model).alias("model"),
                     F.lit(part).alias("part"), "item", F.col("value").cast("double").alias("value"),
                     F.col("support").cast("bigint").alias("support"))


def _scores(fitted: PipelineModel, df: DataFrame, kind: str, config: RunConfig, category: str) -> DataFrame:
    """Scores on training and test rows; the fitted pipeline and sample predictions are stored."""
    side = F.when(F.col("fold") == 1, "test").otherwise("train").alias("side")
    if config.documents:
        store.save_model(fitted, store.model_path(config.documents, kind, None if category == "all" else category,
                                                  config.text_only, config.with_text))
    if not config.price_as_class:
        preds = cut(fitted.transform(df).select(side, "_row", F.col("price").alias("target"), F.col("prediction").alias("predicted")))
        if config.documents:
            pairs = store.sample_pairs(preds.where("side = 'test'"), "_row")
            store.write_report(pairs, f"{config.documents}/{_place(category)}/pairs_{kind}")
        score = evaluate.explained_variance(preds, by=["side"])
        return _result(score.select(F.col("side").alias("item"), F.col("explained_variance").alias("value"), F.lit(None).alias("support")),
                       category, kind, "explained_variance")
    preds = cut(models.add_prediction_class(fitted.transform(df)).select(side, (F.col("label") + 1).cast("int").alias("y_eval"), "y_pred"))
    cells = evaluate.confusion(preds.where("side = 'test'"))
    hits = evaluate.accuracy(preds, ["side"]).select(F.col("side").alias("item"), F.col("accuracy").alias("value"), F.lit(None).alias("support"))
    out = _result(hits, category, kind, "accuracy")
    report = evaluate.class_report(cells)
    for part, column in (("precision", "precision"), ("recall", "recall"), ("report", "f1")):
        out = out.unionByName(_result(report.select(F.col("label").alias("item"), F.col(column).alias("value"), "support"), category, kind, part))
    detail = evaluate.confusion_percent(cells).select(F.concat_ws(" ", "target", "predict").alias("item"), F.col("percent").alias("value"),
                                                      F.col("count").alias("support"))
    return out.unionByName(_result(detail, category, kind, "detail"))
