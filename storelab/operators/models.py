"""Model builders on Spark ML. Classes 1 to 4 become labels 0 to 3 and back."""

from __future__ import annotations

import json

from collections.abc import Sequence

from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (DecisionTreeClassifier, LogisticRegression,
                                       MultilayerPerceptronClassifier, NaiveBayes,
                                       RandomForestClassifier)
from pyspark.ml.feature import Binarizer, SQLTransformer, StringIndexer, VectorAssembler
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.regression import DecisionTreeRegressor, LinearRegression
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.operators.boosting import SoftmaxBoosting
from storelab.operators.linear import SgdClassifier
from storelab.operators.ordered import mode_rows
from storelab.operators.pairwise import PairwiseMargins
from storelab.operators.profile import class_balance
from storelab.operators.split import share_of
from storelab.operators.terms import TermBayes, TermNeighbours, TfIdf, VectorNeighbours
from storelab.operators.text import doc_frequency, elements
from storelab.session import cut

MAX_BINS = 256


def add_label(df: DataFrame, target: str = "price_class") -> DataFrame:
    return df.withColumn("label", (F.col(target) - 1).cast("double"))


def add_prediction_class(df: DataFrame, name: str = "y_pred") -> DataFrame:
    return df.withColumn(name, (F.col("prediction") + 1).cast("int"))


def kept_tokens(docs: DataFrame, column: str, low: float, high: float) -> DataFrame:
    """The tokens within the document shares."""
    pairs = elements(docs, F.array_distinct(column), "token")
    return doc_frequency(pairs, docs, low, high)


def has_tokens(docs: DataFrame, column: str, low: float, high: float) -> bool:
    """Whether any token lies within the document shares."""
    return kept_tokens(docs, column, low, high).limit(1).count() > 0


def classifier(spec: dict, features: str = "features", prediction: str = "prediction",
               seed: int = 25) -> list:
    """Stages for a model named by ``spec['kind']``; the other entries are its parameters."""
    stages = _classifier(spec, features, seed)
    names = dict(predictionCol=prediction, rawPredictionCol=f"{features}_raw_prediction",
                 probabilityCol=f"{features}_probability")
    model = stages[-1]
    for param, name in names.items():
        if model.hasParam(param):
            model.set(model.getParam(param), name)
    return stages


def _classifier(spec: dict, features: str, seed: int) -> list:
    kind, get = spec["kind"], spec.get
    common = dict(featuresCol=features, labelCol="label")
    tree = dict(common, maxDepth=get("depth", 3), maxBins=get("bins", MAX_BINS), seed=seed)
    if kind == "gbt":
        return [SoftmaxBoosting(**common, trees=get("trees", 100), depth=get("depth", 3), rate=get("rate", 0.1),
                                subset=get("subset", "all"), seed=seed)]
    if kind == "forest":
        return [RandomForestClassifier(**tree, numTrees=get("trees", 20), impurity="gini",
                                       featureSubsetStrategy=get("subset", "all"))]
    if kind == "tree":
        if get("subset", "all") != "all":
            return [RandomForestClassifier(**tree, numTrees=1, featureSubsetStrategy=spec["subset"],
                                           bootstrap=False)]
        return [DecisionTreeClassifier(**tree, impurity="gini")]
    if kind == "bernoulli":
        return [Binarizer(threshold=0.0, inputCol=features, outputCol=f"{features}_01"),
                NaiveBayes(modelType="bernoulli", smoothing=get("smoothing", 1.0),
                           featuresCol=f"{features}_01", labelCol="label")]
    if kind in ("multinomial", "gaussian"):
        return [NaiveBayes(modelType=kind, smoothing=get("smoothing", 1.0), **common)]
    if kind == "logistic":
        return [LogisticRegression(**common, regParam=get("alpha", 0.01), maxIter=get("iterations", 50),
                                   elasticNetParam=1.0 if get("penalty", "l2") == "l1" else 0.0)]
    if kind == "svm":
        return [PairwiseMargins(**common, cost=get("cost", 10.0), iterations=get("iterations", 1000), tol=get("tol", 0.01), seed=seed)]
    if kind == "sgd":
        return [SgdClassifier(**common, loss=get("loss", "hinge"), penalty=get("penalty", "l2"), alpha=get("alpha", 0.0001), seed=seed)]
    if kind == "knn":
        return [VectorNeighbours(inputCol=features, labelCol="label", k=get("k", 10), weights=get("weights", "uniform"))]
    if kind == "mlp":
        return [MultilayerPerceptronClassifier(**common, layers=get("layers"), seed=seed,
                                               maxIter=get("iterations", 50))]
    raise ValueError(f"unknown model {kind}")


def regressor(spec: dict, features: str = "features", target: str = "price", seed: int = 53) -> list:
    kind, get = spec["kind"], spec.get
    if kind == "linear":
        return [LinearRegression(featuresCol=features, labelCol=target, regParam=get("alpha", 0.0001),
                                 elasticNetParam=1.0 if get("penalty", "l2") == "l1" else 0.0)]
    if kind == "tree":
        return [DecisionTreeRegressor(featuresCol=features, labelCol=target, maxDepth=get("depth", 5),
                                      maxBins=get("bins", MAX_BINS), seed=seed)]
    if kind == "knn":
        return [VectorNeighbours(inputCol=features, labelCol=target, k=get("k", 10), weights=get("weights", "uniform"), mean=True)]
    raise ValueError(f"unknown regressor {kind}")


# Models per kind of run, in the order in which they are tried.
MODEL_LISTS = {
    "text": [dict(kind="multinomial")],
    "class": [dict(kind="gbt", rate=0.1, trees=500, depth=3)],
    "price": [dict(kind="linear", alpha=0.0001), dict(kind="knn", k=10), dict(kind="tree")],
}
OTHER_MODELS = {
    "text": [dict(kind="sgd", loss="log", alpha=0.007), dict(kind="knn", k=10), dict(kind="forest", trees=500),
             dict(kind="gbt", rate=0.1, trees=500, depth=3), dict(kind="mlp", hidden=(10, 10, 10))],
    "class": [dict(kind="sgd", loss="hinge", alpha=0.01), dict(kind="knn", k=10), dict(kind="gaussian"),
              dict(kind="tree"), dict(kind="mlp", hidden=(10, 10, 10))],
}


def build_models(text_only: bool = False, price_as_class: bool = True, all_models: bool = False) -> list[dict]:
    """Specs of the models tried in a run; ``all_models`` adds the prepared alternatives."""
    key = "text" if text_only else "class" if price_as_class else "price"
    return [dict(s) for s in MODEL_LISTS[key] + (OTHER_MODELS.get(key, []) if all_models else [])]


def numeric_stages(numeric: Sequence[str], categorical: Sequence[str], output: str = "features") -> list:
    """Categories numbered in sorted order, then one vector with the numeric columns.

    The numbers enter models as plain numbers, not as categories, so that trees split
    them by order whatever the number of values.
    """
    codes = [StringIndexer(inputCol=c, outputCol=f"{c}_code", stringOrderType="alphabetAsc",
                           handleInvalid="keep") for c in categorical]
    if categorical:
        # an expression drops the note that marks the column as categorical
        plain = ", ".join(f"{c}_code + 0.0D AS {c}_number" for c in categorical)
        codes.append(SQLTransformer(statement=f"SELECT *, {plain} FROM __THIS__"))
    return codes + [VectorAssembler(inputCols=[*numeric, *[f"{c}_number" for c in categorical]],
                                    outputCol=output)]


def text_classifier(spec: dict, limits: dict, prediction: str = "prediction") -> list:
    """Stages from a column of tokens to a class. Naive Bayes and neighbours read the terms
    themselves, other models read TF-IDF vectors."""
    limits, get = dict(limits), spec.get
    if spec["kind"] == "multinomial":
        return [TermBayes(predictionCol=prediction, smoothing=get("smoothing", 1.0), **limits)]
    if spec["kind"] == "knn":
        return [TermNeighbours(predictionCol=prediction, k=get("k", 10), weights=get("weights", "uniform"), keyCol=get("key", ""), **limits)]
    return [TfIdf(outputCol="text_features", **limits), *classifier(spec, "text_features", prediction)]


class TextPrediction(Estimator, DefaultParamsReadable, DefaultParamsWritable):
    """Adds the class that a text model predicts as the column ``name``.

    Several candidate models may be given; the one with the best accuracy on the
    training rows is kept. A subset may have no token within the limits; with
    ``allow_empty`` every row then gets the most frequent class.
    """

    specs = Param(Params._dummy(), "specs", "candidate models, as JSON", TypeConverters.toString)
    limits = Param(Params._dummy(), "limits", "limits of the vocabulary, as JSON", TypeConverters.toString)
    outputName = Param(Params._dummy(), "outputName", "the new column", TypeConverters.toString)
    allowEmpty = Param(Params._dummy(), "allowEmpty", "whether no token may be left", TypeConverters.toBoolean)
    inputs = Param(Params._dummy(), "inputs", "the columns that are read", TypeConverters.toListString)

    def __init__(self, specs: Sequence[dict] = (dict(kind="gbt", rate=0.1, trees=100, depth=7),),
                 tfidf: dict | None = None, name: str = "textFeaturePrediction",
                 allow_empty: bool = False):
        super().__init__()
        limits = dict(minDF=0.25, maxDF=0.6) if tfidf is None else dict(tfidf)
        self._set(specs=json.dumps([dict(s) for s in specs]), limits=json.dumps(limits), outputName=name, allowEmpty=allow_empty,
                  inputs=["label", "tokens"])

    @property
    def name(self) -> str:
        return self.getOrDefault("outputName")

    def _fit(self, dataset: DataFrame) -> PipelineModel:
        specs, limits, name = json.loads(self.getOrDefault("specs")), json.loads(self.getOrDefault("limits")), self.name
        if self.getOrDefault("allowEmpty") and not has_tokens(dataset, "tokens", limits.get("minDF", 0.0), limits.get("maxDF", 1.0)):
            top = mode_rows(dataset, "label").first().top
            return PipelineModel([SQLTransformer(
                statement=f"SELECT *, CAST({top} AS DOUBLE) AS {name} FROM __THIS__")])
        rows, front, fits = dataset.select("label", "tokens"), None, []
        lists = [text_classifier(spec, limits, name) for spec in specs]
        if len(specs) > 1 or isinstance(lists[0][0], TfIdf):  # a single model over terms reads its rows once
            rows = cut(rows)
        for stages in lists:
            if isinstance(stages[0], TfIdf):
                if front is None:  # vectors are made once for all candidates that read them
                    front = stages[0].fit(rows)
                    vectors = cut(front.transform(rows).select("label", "text_features"))
                fitted = PipelineModel([front, *Pipeline(stages=stages[1:]).fit(vectors).stages])
            else:
                fitted = Pipeline(stages=stages).fit(rows)
            good = 0.0
            if len(specs) > 1:
                hit = (F.col(name) == F.col("label")).cast("double")
                good = fitted.transform(rows).agg(F.avg(hit)).first()[0]
            fits.append((good, fitted))
        return max(fits, key=lambda f: f[0])[1]


def pipeline_steps(spec: dict, numeric: Sequence[str] = tuple(K.LEARN_NUMERIC), categorical: Sequence[str] = (),
                   text_model: dict | None = None, text_limits: dict | None = None, allow_empty: bool = False) -> list[tuple[str, object]]:
    """Named stages of a spec whose ``features`` is ``numeric``, ``text`` or ``all``; a name says all
    that matters of a stage, so that searches fit equal ones once.

    ``all`` first adds the prediction of the text model; text runs read the column
    ``tokens``. ``text_model`` and ``text_limits`` replace the parameters kept for it.
    """
    kind = spec.get("features", "numeric")
    if kind == "text":
        limits = dict(minDF=spec.get("min_df", 0.25), maxDF=spec.get("max_df", 0.75), binary=spec.get("binary", False))
        return [(f"text {sorted(spec.items())}", TextPrediction([spec], limits, "prediction", allow_empty))]
    front = []
    if kind == "all":
        options = dict(tfidf=text_limits, allow_empty=allow_empty)
        predictor = TextPrediction(**options) if text_model is None else TextPrediction([text_model], **options)
        front, numeric = [("text class", predictor)], [*numeric, predictor.name]
    numbers = [(f"numbers {i}", s) for i, s in enumerate(numeric_stages(numeric, categorical))]
    return [*front, *numbers, *[(f"model {i} {sorted(spec.items())}", s) for i, s in enumerate(classifier(spec))]]


def pipeline(spec: dict, *args, **options) -> Pipeline:
    """The stages of ``pipeline_steps`` as one pipeline."""
    return Pipeline(stages=[s for _, s in pipeline_steps(spec, *args, **options)])


def category_spec(category: str) -> dict:
    """Boosting parameters of a category, the shared default for a new one."""
    rate, depth, subset, trees = K.CATEGORY_MODELS.get(category, K.CATEGORY_MODEL_DEFAULT)
    return dict(kind="gbt", features="all", rate=rate, depth=depth, subset=subset, trees=trees)


def dummy_predictions(df: DataFrame, target: str, key: str, seed: int = 0) -> DataFrame:
    """A class drawn by class share, from a hash of the key."""
    # one row per class
    counts = class_balance(df, target).orderBy("label").collect()
    total, upto, pick = sum(r["count"] for r in counts), 0, None
    for r in counts[:-1]:
        upto += r["count"]
        below = share_of(key, seed) < upto / total
        pick = F.when(below, r["label"]) if pick is None else pick.when(below, r["label"])
    last = F.lit(counts[-1]["label"]) if counts else F.lit(None)
    return df.withColumn("y_pred", last if pick is None else pick.otherwise(last))
