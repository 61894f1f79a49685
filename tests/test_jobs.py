import pytest
from pyspark.ml import Pipeline
from pyspark.sql import functions as F

from storelab.operators import encode, models, stages, tuning
from storelab.plans import jobs, queries_models as q, tables
from storelab.plans.registry import AS_OF
from storelab.sources.apps import apps
from storelab.session import cut, scratch_path
from storelab.sources import store


@pytest.fixture(scope="module")
def report(spark, sf_dir):
    return q.report_rows(spark, sf_dir)


def parts(df):
    return {(r.category, r.part) for r in df.collect()}


@pytest.mark.parametrize("switch,part", [
    (dict(cross_validate=True), "curve"), (dict(selector="f", k_best=5), "accuracy"),
    (dict(price_as_class=False, cross_validate=True), "curve")])
def test_report_runs(report, monkeypatch, switch, part):
    monkeypatch.setitem(models.MODEL_LISTS, "class", [dict(kind="gbt", trees=5, depth=2)])
    monkeypatch.setitem(models.MODEL_LISTS, "price", [dict(kind="linear")])
    out = jobs.train_predict(report, jobs.RunConfig(**switch))
    assert ("all", part) in parts(out)


def test_report_run_per_category(report, monkeypatch):
    monkeypatch.setitem(models.MODEL_LISTS, "class", [dict(kind="gbt", trees=5, depth=2)])
    config = jobs.RunConfig(per_category=True, min_rows=40)
    found = {c for c, _ in parts(jobs.train_predict(report, config))}
    assert found and all(c.startswith("category_") for c in found)


def test_report_run_stores_what_it_did(spark, report, monkeypatch):
    """Reports, columns and the fitted pipeline are read back from the folder of the run."""
    monkeypatch.setitem(models.MODEL_LISTS, "class", [dict(kind="gbt", trees=5, depth=2), dict(kind="knn", k=3)])
    folder = scratch_path(spark, "documents")
    out = jobs.train_predict(report, jobs.RunConfig(documents=folder))
    rows = out.collect()
    assert {r.model for r in rows} == {"gbt", "knn"}
    assert {r.part for r in rows} == {"accuracy", "precision", "recall", "report", "detail"}
    for kind in ("gbt", "knn"):
        shares = {}
        for r in rows:
            if r.model == kind and r.part == "detail":
                shares[r.item[0]] = shares.get(r.item[0], 0) + r.value
        assert all(v == pytest.approx(1) for v in shares.values()) and len(shares) == 4
    assert spark.read.csv(f"{folder}/all/class_report_noText", header=True).count() == len(rows)
    columns = [r.column for r in spark.read.csv(f"{folder}/all/columns", header=True).orderBy(F.col("position").cast("int")).collect()]
    used = cut(jobs.report_rows(jobs.safe_names(report)))
    assert columns == stages.numeric_columns(used, jobs.LEFT_OUT)
    loaded = store.load_model(store.model_path(folder, "gbt"))
    test = used.where("fold = 1")
    hits = loaded.transform(test).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0]
    assert hits == pytest.approx(next(r.value for r in rows if (r.model, r.part, r.item) == ("gbt", "accuracy", "test")))


def test_grid_report(report, monkeypatch):
    """The best candidate by mean score is fitted again and scored on the test rows."""
    grid = [dict(kind="gbt", trees=t, depth=1, k_best=k) for k in (3, 6) for t in (1, 8)]
    monkeypatch.setitem(jobs.REPORT_GRIDS, "class", grid)
    rows = jobs.train_predict(report, jobs.RunConfig(grid_search=True)).collect()
    means = [r.value for r in rows if r.part == "grid"]
    best = next(r for r in rows if r.part == "best_score")
    assert len(means) == 4 and best.value == pytest.approx(max(means)) and best.model == "gbt"
    told = dict(r.item.split("=") for r in rows if r.part == "best_parameter")
    assert told["kind"] == "gbt" and set(told) == {"kind", "trees", "depth", "k_best"}
    assert {r.item for r in rows if r.part == "accuracy"} == {"train", "test"} and any(r.part == "report" for r in rows)
    with pytest.raises(ValueError, match="no grid"):
        jobs.train_predict(report, jobs.RunConfig(grid_search=True, price_as_class=False))


def test_searches_share_fits(spark):
    """Candidates with the same first steps fit them once per fold, with the scores of a plain search."""
    rows = [(i, float(i % 5), float(i % 3), float(i % 7), float(i % 2 + (i % 3 > 1)), i % 3 + 1) for i in range(210)]
    df = spark.createDataFrame(rows, "id int, a double, b double, c double, label double, fold int")
    candidates = [dict(kind="tree", depth=d, k=k) for k in (1, 2) for d in (1, 2, 3)]

    def steps(c):
        return [("scale", stages.MinMaxColumns(inputCols=["a", "b", "c"])), (f"best {c['k']}", stages.BestColumns(inputCols=["a", "b", "c"], k=c["k"])),
                (f"tree {c['depth']}", models.classifier(c)[0])]

    found, fits = tuning.search_steps(df, steps, candidates, 3)
    assert fits == 3 * (1 + 2 + 6)
    plain = tuning.search(df, lambda c: Pipeline(stages=[s for _, s in steps(c)]), candidates, 3)
    keys = ["candidate", "fold", "split", "f1_weighted", "accuracy"]
    assert sorted(map(str, found.select(*keys).collect())) == sorted(map(str, plain.select(*keys).collect()))


def test_grid_search_has_ten_folds(spark, sf_dir, monkeypatch):
    """Each candidate is scored on all ten folds, which hold every row of the table once."""
    seen = []
    plain = tuning.search
    monkeypatch.setattr(tuning, "search", lambda df, *a: seen.append(df) or plain(df, *a))
    assert [r.folds for r in q.grid_search(spark, sf_dir).collect()] == [10] * 4
    sizes = [r["count"] for r in seen[0].groupBy("fold").count().collect()]
    assert len(sizes) == 10 and sum(sizes) == q.number_table(spark, sf_dir).count() and max(sizes) - min(sizes) <= 4


def test_rows_without_stars_stay(spark, report):
    """Only rows without a text or a price go; repeated ids give the same folds twice."""
    n = report.where("text is not null and price is not null and price_range_index is not null").count()
    twice = report.unionAll(report.orderBy("appId").limit(5))
    made = [jobs.report_rows(jobs.safe_names(df)) for df in (report, twice, twice)]
    assert made[0].count() == n
    folds = [sorted((r.appId, r.fold) for r in m.collect()) for m in made[1:]]
    assert folds[0] == folds[1] and len(folds[0]) == n + twice.count() - report.count()


def test_names_stay_apart(spark):
    df = spark.createDataFrame([(1, 2, 3)], ["a.b", "a b", "a_b"])
    assert jobs.safe_names(df).columns == ["a_b", "a_b_2", "a_b_3"]


def test_scoreboard_run(spark, sf_dir):
    """Predictions, model and board are read back from what the run wrote."""
    table, folder = q._folded(q.model_table(spark, sf_dir), 2), scratch_path(spark, "board")
    name = "fd_numeric_forest_numeric"
    board = spark.createDataFrame([(7, "all"), (8, "OTHER")], "Runs int, Category string")
    jobs.scoreboard_run(table, name, folder, 2, board=board)
    read = {r.Category: r for r in store.read_scoreboard(spark, f"{folder}/scoring", [name]).collect()}
    preds = spark.read.parquet(f"{folder}/predictions")
    assert preds.count() == table.count() and preds.where("diff <> y_pred - y_eval").count() == 0
    hits = preds.agg(F.avg((F.col("y_pred") == F.col("y_eval")).cast("double"))).first()[0]
    assert read["all"][f"{name}___acc"] == pytest.approx(hits) and read["OTHER"][f"{name}___acc"] is None and read["all"].Runs == 7
    assert store.load_model(store.model_path(folder, name)).transform(table).count() == table.count()


def test_category_runs(spark, sf_dir):
    """Each category with enough rows has a row; an empty name is a category like others."""
    table = q.category_table(spark, sf_dir)
    scores = jobs.category_models(table, 2, min_rows=25)
    sizes = {r.category: r["count"] for r in table.groupBy("category").count().collect()}
    assert {r.Category for r in scores.collect()} == {c for c, n in sizes.items() if n >= 25 and c is not None}
    df = spark.createDataFrame([("", 1), ("a", 2), (None, 3)], "category string, n int")
    got = tuning.per_category(df, lambda c, rows: rows.select(F.lit(c).alias("c"), "category", "n"), rows=1)
    assert sorted(map(tuple, got.collect())) == [("", "", 1), ("a", "a", 2)]


def test_documents(spark, sf_dir):
    raw = apps(spark, sf_dir, tables.REPORT_SOURCE)
    columns = tables.report_columns(raw, "2002-01-01")
    paths = jobs.write_documents(columns, raw, scratch_path(spark, "documents"))
    stats = spark.read.csv(paths["numeric_stats"], header=True)
    assert stats.columns == ["feature", "min", "max", "mean", "std", "25%", "50%", "75%"]
    assert spark.read.csv(paths["value_counts"], header=True).where("feature = 'category'").count() == 4
    assert spark.read.csv(paths["columns"], header=True).count() > 10


def test_sparse_one_hot(spark):
    df = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "c string")
    model = encode.one_hot_sparse(df, ["c"])
    rows = model.transform(df).collect()
    found = sorted((str(r.c), list(r.c_vec.toArray())) for r in rows)
    assert found == [("None", [0.0, 0.0]), ("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("b", [0.0, 1.0])]


def test_any_number_of_levels(spark):
    df = spark.range(1500).select(F.concat(F.lit("v"), F.col("id") % 500).alias("c"), "id")
    rows = encode.one_hot_sparse(df, ["c"]).transform(df).collect()
    places = {r.c: list(r.c_vec.indices) for r in rows}
    assert len(rows) == 1500 and {r.c_vec.size for r in rows} == {500}
    assert [places[c] for c in sorted(places)] == [[i] for i in range(500)]
    assert len(encode.one_hot(df, ["c"]).columns) == 501


def test_grids():
    assert len(tuning.grid(jobs.GRIDS["forest_numeric"])) == 6
    some = tuning.draws(jobs.GRIDS["svm_text"], 3, seed=2)
    assert len(some) == 3 and some == tuning.draws(jobs.GRIDS["svm_text"], 3, seed=2)
    assert models.category_spec("RACING")["trees"] == 150 and models.category_spec("NEW")["trees"] == 5


def test_search_beats_nothing(spark):
    """A search finds the deeper tree when the class needs two splits."""
    rows = [(i, float(i % 2), float(i // 2 % 2), float(i % 2 + 2 * (i // 2 % 2)), i % 3 + 1) for i in range(240)]
    df = spark.createDataFrame(rows, "id int, a double, b double, label double, fold int")
    candidates = [dict(kind="tree", depth=d) for d in (1, 2)]
    found = tuning.search(df, lambda c: models.pipeline(c, ["a", "b"]), candidates, 3)
    best = tuning.best_candidate(found).first()
    assert best.candidate == 1 and best.score_accuracy_test_mean == 1.0 and best.folds == 3
    preds = tuning.cross_val_predict(df, lambda: models.pipeline(dict(kind="tree", depth=2), ["a", "b"]), 3)
    assert preds.count() == 240 and preds.where("y_eval <> y_pred").count() == 0


def test_repeated_ids_keep_every_row(spark, sf_dir):
    learn = tables.learn_table(apps(spark, sf_dir, tables.LEARN_SOURCE), AS_OF)
    twice = learn.unionAll(learn.orderBy("appId").limit(10)).unionAll(learn.orderBy("appId").limit(10))
    made = jobs.model_table(twice, 3)
    assert made.count() == learn.count() + 20
    sizes = [r["count"] for r in made.groupBy("price_class", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2 + learn.count() // 12
    most = made.groupBy("appId").count().agg({"count": "max"}).first()[0]
    assert most == 3


def test_later_versions_are_filled(spark):
    rows = [("4.4 and up",), ("10 and up",), ("10.0 and up",), ("Varies with device",), (None,), ("2.3",)]
    df = spark.createDataFrame(rows, "requiredAndroidVersion string")
    out = tables.add_version_numbers(df, F.lit("4.1")).collect()
    found = [(r.requiredAndroidVersion_major, r.requiredAndroidVersion_minor) for r in out]
    assert found == [(4, 4), (4, 1), (4, 1), (4, 1), (4, 1), (2, 3)]


def test_token_numbers_keep_order_and_counts(spark):
    from storelab.operators.stages import TokenNumbers
    rows = [(1, ["b c", "a", "b c"]), (2, []), (3, None), (4, ["a b"]), (4, ["a b"])]
    got = TokenNumbers().transform(spark.createDataFrame(rows, "i int, tokens array<string>")).collect()
    assert sorted((r.i, sorted(r.tokens)) for r in got) == [(1, [0, 2, 2]), (2, []), (3, []), (4, [1]), (4, [1])]


def test_search_does_unfitted_first_steps_once_and_branches_side_by_side(spark, monkeypatch):
    import threading
    from pyspark.ml.feature import SQLTransformer, VectorAssembler
    from storelab.operators import models, tuning
    from storelab.operators.stages import MinMaxColumns
    done, together = [], threading.Barrier(2, timeout=60)
    plain = SQLTransformer(statement="SELECT *, a + 1 AS b FROM __THIS__")
    monkeypatch.setattr(plain, "transform", lambda df: done.append(1) or SQLTransformer(statement=plain.getStatement()).transform(df))

    class Meets(MinMaxColumns):
        def _fit(self, dataset):
            together.wait()  # breaks unless the two candidates of a fold are fitted at one time
            return super()._fit(dataset)

    df = spark.createDataFrame([(float(i), float(i % 2), 1 + i % 4 // 2) for i in range(24)], "a double, label double, fold int")
    steps = lambda c: [("plain", plain), (f"meets {c['i']}", Meets(inputCols=["a"])),
                       ("vector", VectorAssembler(inputCols=["a", "b"], outputCol="features")), ("model", models.classifier(dict(kind="tree"))[0])]
    found, fits = tuning.search_steps(df, steps, [dict(i=0), dict(i=1)], 1)
    assert found.count() == 4 and fits == 7 and done == [1]


def test_text_search_on_numbers_scores_as_on_tokens(spark):
    from storelab.operators.stages import TokenNumbers, WordGrams
    text = ["red apple pie today", "green apple tart today", "fast blue car race", "slow blue car park", "", "red apple tart"]
    df = spark.createDataFrame([(text[i % 6] + f" word{i % 5} end", float(i % 6 in (2, 3)), 1 + i % 7 // 4) for i in range(42)],
                               "text string, label double, fold int")
    candidates = [dict(kind="sgd", loss="hinge", alpha=0.0001), dict(kind="knn", k=3, weights="distance")]
    scores = []
    for more in ([], [("numbers", TokenNumbers())]):
        steps = lambda c: [("grams", WordGrams()), *more, *[(f"{i} {c}", s) for i, s in enumerate(models.text_classifier(c, dict(minDF=0.0)))]]
        found, _ = tuning.search_steps(df, steps, candidates, 1)
        scores.append(sorted(map(str, found.select("candidate", "split", "f1_weighted", "accuracy").collect())))
    assert scores[0] == scores[1] and len(scores[0]) == 4
