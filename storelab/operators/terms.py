"""Text models over tables of terms: vectors, naive Bayes and neighbours, for vocabularies of any
size. A vocabulary is a table; nothing of its size is held by the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark import keyword_only
from pyspark.ml import Estimator
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCol, HasLabelCol, HasOutputCol, HasPredictionCol
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelab.operators import knn
from storelab.operators.lookup import BROADCAST_ROWS
from storelab.operators.ordered import row_numbers
from storelab.operators.table_model import ROW, TableModel, numbered, put_back
from storelab.operators.text import counted
from storelab.session import cut


class HasLimits(Params):
    """Document shares that bound a vocabulary, and whether a term counts once per document."""

    minDF = Param(Params._dummy(), "minDF", "least share of documents", TypeConverters.toFloat)
    maxDF = Param(Params._dummy(), "maxDF", "largest share of documents", TypeConverters.toFloat)
    binary = Param(Params._dummy(), "binary", "count a token once per document", TypeConverters.toBoolean)


# Documents of one term that are dealt to one task at a time.
POSTING_ROWS = 10_000


def counted_rows(dataset: DataFrame, column: str, *keep: Column | str) -> DataFrame:
    """The rows, written once, with ``ROW``, the kept columns and ``items``, their distinct tokens and counts."""
    return numbered(dataset.select(*keep, counted(F.col(column)).alias("items")))


def occurrences(docs: DataFrame, *keep: str) -> DataFrame:
    """Rows (ROW, kept columns, token, tf) of counted rows."""
    # outer, as an inner explode adds a filter on its array, which works the array out once more
    return docs.select(ROW, *keep, F.explode_outer("items").alias("x")).where("x is not null").select(ROW, *keep, "x.token", "x.tf")


def token_rows(docs: DataFrame, column: str) -> DataFrame:
    """Rows (ROW, token, tf) of numbered rows with a column of tokens."""
    return occurrences(docs.select(ROW, counted(F.col(column)).alias("items")))


def fitted_terms(docs: DataFrame, low: float, high: float) -> DataFrame:
    """(token, df, idf) of the tokens of counted rows within the limits."""
    n = docs.count()
    counts = occurrences(docs).groupBy("token").agg(F.count("*").alias("df"))
    kept = counts.where((F.col("df") >= n * low) & (F.col("df") <= n * high))
    return kept.withColumn("idf", _idf(n))


def _idf(n: int) -> Column:
    return F.log(F.lit(1.0 + n) / (1 + F.col("df"))) + 1


def join_terms(rows: DataFrame, terms: DataFrame, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (with ROW and token) next to their terms, which hold each token once with its ``df``.

    Few terms are broadcast. Of many, only those of more than ``POSTING_ROWS`` documents are
    dealt to several tasks, by the row: every other one is sent once.
    """
    if terms.count() <= broadcast_rows:
        return rows.join(F.broadcast(terms), "token")
    shares = F.ceil(F.col("df") / POSTING_ROWS).cast("int")
    hot = terms.where(F.col("df") > POSTING_ROWS).select("token", shares.alias("_shares"))
    dealt = (rows.join(F.broadcast(hot), "token", "left")
             .withColumn("_share", F.pmod(F.xxhash64(ROW), F.coalesce("_shares", F.lit(1))).cast("int")).drop("_shares"))
    copies = terms.withColumn("_share", F.explode(F.sequence(F.lit(0), F.greatest(shares, F.lit(1)) - 1)))
    # written tables are small on disk, so their size says nothing about a broadcast
    return dealt.join(copies.hint("merge"), ["token", "_share"]).drop("_share")


def weighed(rows: DataFrame, terms: DataFrame, binary: bool) -> DataFrame:
    """Occurrences of known tokens with ``raw``, their weight before a document is scaled to length 1."""
    return join_terms(rows, terms).withColumn("raw", _tf(binary) * F.col("idf"))


def _tf(binary: bool) -> Column:
    return F.lit(1.0) if binary else F.col("tf").cast("double")


def _length() -> Column:
    return F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("length")


def term_places(terms: DataFrame) -> DataFrame:
    """The terms, written, with a number from 0 in sorted order as ``place``."""
    found = row_numbers(terms, ["token"], name="number")
    return cut(found.withColumn("place", (F.col("number") - 1).cast("int")).drop("number"))


def vectors_of(rows: DataFrame, terms: DataFrame, binary: bool) -> DataFrame:
    """(ROW, places, weights) of the documents with a known token, in order of places, scaled to length 1."""
    found = weighed(rows, terms, binary).groupBy(ROW).agg(
        F.sort_array(F.collect_list(F.struct("place", "raw"))).alias("parts"), _length())
    return found.select(ROW, F.col("parts.place").alias("places"),
                        F.transform("parts.raw", lambda w: w / F.col("length")).alias("weights"))


class TfIdf(Estimator, HasInputCol, HasOutputCol, HasLimits, DefaultParamsReadable, DefaultParamsWritable):
    """TF-IDF of an array of tokens: tf * (ln((1+n)/(1+df)) + 1), scaled to length 1, as a sparse vector.

    ``minDF`` and ``maxDF`` are shares of the documents. Tokens are numbered in sorted order
    by range partitions, so a vocabulary of any size is kept whole.
    """

    @keyword_only
    def __init__(self, *, inputCol="tokens", outputCol="features", minDF=0.0, maxDF=1.0, binary=False):
        super().__init__()
        self._setDefault(inputCol="tokens", outputCol="features", minDF=0.0, maxDF=1.0, binary=False)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TfIdfModel":
        get = self.getOrDefault
        docs = counted_rows(dataset, get("inputCol"))
        terms = term_places(fitted_terms(docs, get("minDF"), get("maxDF")))
        size = terms.count()
        if not size:
            raise ValueError(f"no token is in {get('minDF')} to {get('maxDF')} of the documents; widen the limits")
        return self._copyValues(TfIdfModel(dict(terms=terms), dict(size=size)))


class TfIdfModel(TableModel, HasInputCol, HasOutputCol, HasLimits):
    TABLES = ("terms",)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get, size = self.getOrDefault, self.fact("size")
        docs = numbered(dataset)
        # written, as each reader of the result would work it out again
        found = cut(vectors_of(token_rows(docs, get("inputCol")), self.tables["terms"], get("binary")))
        # a sparse vector has no JVM expression; the call sees a row's own terms
        vector = F.udf(lambda places, weights: Vectors.sparse(size, places or [], weights or []), VectorUDT())
        parts = put_back(docs, found.withColumnsRenamed({"places": "_places", "weights": "_weights"}))
        return parts.withColumn(get("outputCol"), vector("_places", "_weights")).drop("_places", "_weights")


class TermBayes(Estimator, HasInputCol, HasLabelCol, HasPredictionCol, HasLimits, DefaultParamsReadable, DefaultParamsWritable):
    """Multinomial naive Bayes on TF-IDF weights of all tokens of an array.

    The model is a table of tokens with their idf and, per class, the sum of their weights;
    a document is scored by joining its tokens with it. Tokens are counted inside the rows,
    and a fit sends each occurrence three times: for its idf, for the length of its document
    and for the sums. The driver holds one row per class.
    """

    smoothing = Param(Params._dummy(), "smoothing", "added to each weight", TypeConverters.toFloat)

    @keyword_only
    def __init__(self, *, inputCol="tokens", labelCol="label", predictionCol="prediction", minDF=0.0, maxDF=1.0,
                 binary=False, smoothing=1.0):
        super().__init__()
        self._setDefault(inputCol="tokens", labelCol="label", predictionCol="prediction", minDF=0.0, maxDF=1.0,
                         binary=False, smoothing=1.0)
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TermBayesModel":
        get = self.getOrDefault
        docs = counted_rows(dataset, get("inputCol"), F.col(get("labelCol")).cast("double").alias("_label"))
        sizes = docs.where("_label is not null").groupBy("_label").agg(F.count("*").alias("n")).orderBy("_label").collect()
        if not sizes:
            raise ValueError("no row has a label")
        rows, every = F.col("df"), docs.count()
        known = cut(fitted_terms(docs, get("minDF"), get("maxDF")))
        lengths = cut(weighed(occurrences(docs), known, get("binary")).groupBy(ROW).agg(_length()))
        # the weights of a token are its idf times sums of tf / length, so one grouping by token ends the fit
        share = _tf(get("binary")) / F.col("length")
        of_class = [F.coalesce(F.sum(F.when(F.col("_label") == r["_label"], share)), F.lit(0.0)) for r in sizes]
        sums = (occurrences(docs.join(lengths, ROW), "_label", "length").groupBy("token")
                .agg(F.count("*").alias("df"), F.array(*of_class).alias("shares"))
                .where((rows >= every * get("minDF")) & (rows <= every * get("maxDF"))).withColumn("idf", _idf(every)))
        table = cut(sums.select("token", "df", "idf", F.transform("shares", lambda s: s * F.col("idf")).alias("sums")))
        found = table.agg(F.count("*"), *[F.coalesce(F.sum(F.col("sums")[i]), F.lit(0.0)) for i in range(len(sizes))]).first()
        n, vocabulary, alpha = sum(r.n for r in sizes), found[0], get("smoothing")
        totals = {r["_label"]: w for r, w in zip(sizes, found[1:])}
        rows = F.lit(float(n))
        prior = [(F.log(F.lit(float(r.n)) / rows), F.log(F.lit(totals.get(r["_label"], 0.0) + alpha * max(vocabulary, 1)))) for r in sizes]
        values = dataset.sparkSession.range(1).select(*[e.alias(f"c{i}") for i, e in enumerate(x for p in prior for x in p)]).first()
        facts = dict(labels=[r["_label"] for r in sizes], priors=list(values[0::2]), scales=list(values[1::2]))
        return self._copyValues(TermBayesModel(dict(terms=table), facts))


class TermBayesModel(TableModel, HasInputCol, HasLabelCol, HasPredictionCol, HasLimits):
    TABLES = ("terms",)
    smoothing = TermBayes.smoothing

    def _transform(self, dataset: DataFrame) -> DataFrame:
        get = self.getOrDefault
        docs = numbered(dataset)
        labels, alpha = self.fact("labels"), get("smoothing")
        found = weighed(token_rows(docs, get("inputCol")), self.tables["terms"], get("binary"))
        # the length scales the sums of a document, so it is divided by last
        sums = found.groupBy(ROW).agg(_length(), *[
            F.sum(F.col("raw") * (F.log(F.col("sums")[i] + alpha) - F.lit(s))).alias(f"s{i}") for i, s in enumerate(self.fact("scales"))])
        # written, as each reader of the result would work it out again
        every = docs.select(ROW).join(cut(sums), ROW, "left")
        score = [F.lit(p) + F.coalesce(F.col(f"s{i}") / F.col("length"), F.lit(0.0)) for i, p in enumerate(self.fact("priors"))]
        best = F.array_max(F.array(*[F.struct(s.alias("score"), F.lit(-i).alias("i")) for i, s in enumerate(score)]))["i"]
        label = F.element_at(F.array(*[F.lit(x) for x in labels]), 1 - best)
        return put_back(docs, every.select(ROW, label.alias(get("predictionCol"))))


# --- neighbours ---------------------------------------------------------------------

_SLACK = 1e-9
# Most terms of documents, of either side, in one unit of a search.
BLOCK_TERMS = 4_000_000


class _Neighbours(Params):
    k = Param(Params._dummy(), "k", "number of neighbours", TypeConverters.toInt)
    weights = Param(Params._dummy(), "weights", "uniform or distance", TypeConverters.toString)
    mean = Param(Params._dummy(), "mean", "predict the mean of the labels instead of a class", TypeConverters.toBoolean)
    keyCol = Param(Params._dummy(), "keyCol", "column that orders equally near rows, empty for their order", TypeConverters.toString)

    def _key(self) -> Column:
        name = self.getOrDefault("keyCol")
        return F.col(name) if name else F.monotonically_increasing_id()

    def _classified(self, docs: DataFrame, found: DataFrame) -> DataFrame:
        answer = knn.regress if self.getOrDefault("mean") else knn.classify
        votes = answer(cut(found), self.getOrDefault("weights"))
        return put_back(docs, votes.select(F.col("row").alias(ROW), F.col("prediction").alias(self.getOrDefault("predictionCol"))))


class TermNeighbours(Estimator, HasInputCol, HasLabelCol, HasPredictionCol, HasLimits, _Neighbours,
                     DefaultParamsReadable, DefaultParamsWritable):
    """Classes by the k nearest documents, by the distance of their TF-IDF vectors.

    The model holds a vector per document. All have length 1 (or 0), so near means a large
    product. A search deals both sides to blocks and joins each block of questions with each
    block of documents; a block keeps, per term, its documents and the largest weight it has
    in any. Terms of a question are added up from the one that can add most; when those left
    cannot lift a product to the k-th best one alone, only the documents that can still reach
    it are finished. No pair of documents becomes a row before the k best of a block are known.
    """

    @keyword_only
    def __init__(self, *, inputCol="tokens", labelCol="label", predictionCol="prediction", minDF=0.0, maxDF=1.0,
                 binary=False, k=10, weights="uniform", mean=False, keyCol=""):
        super().__init__()
        self._setDefault(inputCol="tokens", labelCol="label", predictionCol="prediction", minDF=0.0, maxDF=1.0,
                         binary=False, k=10, weights="uniform", mean=False, keyCol="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "TermNeighboursModel":
        get = self.getOrDefault
        docs = counted_rows(dataset.where(F.col(get("labelCol")).isNotNull()), get("inputCol"),
                            self._key().alias("near"), F.col(get("labelCol")).cast("double").alias("near_label"))
        terms = term_places(fitted_terms(docs, get("minDF"), get("maxDF")))
        found = vectors_of(occurrences(docs), terms, get("binary"))
        rows = cut(docs.select(ROW, "near", "near_label").join(found, ROW, "left"))
        # what fills up a list: documents without any term, and documents without a shared term
        plain = rows.select(ROW, "near", "near_label", F.col("places").isNull().alias("empty"))
        empty = plain.where("empty").orderBy("near", ROW).limit(get("k"))
        others = plain.where("not empty").orderBy("near", ROW).limit(2 * get("k"))
        return self._copyValues(TermNeighboursModel(dict(terms=terms, rows=rows, fill=cut(empty.unionAll(others)))))


class TermNeighboursModel(TableModel, HasInputCol, HasLabelCol, HasPredictionCol, HasLimits, _Neighbours):
    TABLES = ("terms", "rows", "fill")

    def _transform(self, dataset: DataFrame) -> DataFrame:
        docs = numbered(dataset)
        return self._classified(docs, self.search(docs))

    def asked(self, docs: DataFrame) -> DataFrame:
        """(row, places, weights): vectors of the numbered documents with a known term, written."""
        get = self.getOrDefault
        found = vectors_of(token_rows(docs, get("inputCol")), self.tables["terms"], get("binary"))
        return cut(found.withColumnRenamed(ROW, "row"))

    def questions(self, docs: DataFrame) -> DataFrame:
        """(row, token, q, df, most): weights of the known terms of numbered documents, and the
        most that each can add to a product."""
        terms = self.tables["terms"].join(_entries(self.tables["rows"], ROW).groupBy("place").agg(F.max("weight").alias("top")), "place")
        return (_entries(self.asked(docs), "row").join(terms, "place")
                .select("row", "token", F.col("weight").alias("q"), "df", (F.col("weight") * F.col("top")).alias("most")))

    def _products(self, asked: DataFrame) -> DataFrame:
        """(row, doc, product): sums over the asked (row, token, q)."""
        postings = (_entries(self.tables["rows"], ROW).join(self.tables["terms"].select("token", "place"), "place")
                    .select(F.col(ROW).alias("doc"), "token", "weight"))
        return (asked.join(postings, "token").groupBy("row", "doc")
                .agg(F.sum(F.col("q") * F.col("weight")).alias("product")))

    def essential(self, questions: DataFrame) -> DataFrame:
        """What a search may leave out, for a look at it: the questions with ``rest``, the most that
        terms up to this one add together in ascending order, and ``goal``, a product that k documents reach."""
        k = self.getOrDefault("k")
        strong = Window.partitionBy("row").orderBy(F.col("most").desc(), "token")
        before = F.coalesce(F.sum("df").over(strong.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        near = self._products(questions.withColumn("before", before).where(F.col("before") < k))
        place = F.row_number().over(Window.partitionBy("row").orderBy(F.col("product").desc(), "doc"))
        # products over some of the terms, so k documents reach them at least
        goals = (near.withColumn("place", place).where(F.col("place") <= k).groupBy("row")
                 .agg(F.count("*").alias("n"), F.min("product").alias("goal")).where(F.col("n") == k).select("row", "goal"))
        upto = Window.partitionBy("row").orderBy("most", "token").rowsBetween(Window.unboundedPreceding, 0)
        # documents have length 1, so terms add no more than their own length either
        rest = F.least(F.sum("most").over(upto), F.sqrt(F.sum(F.col("q") * F.col("q")).over(upto)))
        return (questions.withColumn("rest", rest).join(goals, "row", "left")
                .withColumn("goal", F.coalesce("goal", F.lit(0.0))))

    def _near(self, asked: DataFrame) -> DataFrame:
        """(row, doc, near, near_label, distance): the k best documents of each block for each question."""
        k, rows = self.getOrDefault("k"), self.tables["rows"].where("places is not null")
        sizes = [max(1, df.agg(F.sum(F.size("places"))).first()[0] or 0) for df in (rows, asked)]
        blocks = [-(-n // BLOCK_TERMS) for n in sizes]
        while blocks[0] * blocks[1] < 2 * rows.sparkSession.sparkContext.defaultParallelism:
            # every core gets work; the side with more terms in a block is cut
            side = int(sizes[1] / blocks[1] > sizes[0] / blocks[0])
            blocks[side] *= 2

        def every(n: int) -> Column:
            return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

        left = (rows.withColumn("b", F.pmod(F.xxhash64(ROW), F.lit(blocks[0])).cast("int")).withColumn("q", every(blocks[1]))
                .select("b", "q", F.col(ROW).alias("doc"), "near", "near_label", "places", "weights"))
        right = (asked.withColumn("q", F.pmod(F.xxhash64("row"), F.lit(blocks[1])).cast("int")).withColumn("b", every(blocks[0]))
                 .select("b", "q", "row", "places", "weights"))
        near_type = rows.schema["near"].dataType
        schema = f"row long, doc long, near {near_type.simpleString()}, near_label double, distance double"

        def closest(docs: pa.Table, questions: pa.Table) -> pa.Table:
            docs = docs.sort_by([("near", "ascending"), ("doc", "ascending")]).combine_chunks()
            questions = questions.combine_chunks()
            own, pick, product = _best_products(_lists(docs), _lists(questions), docs.num_rows, k)
            found = docs.select(["doc", "near", "near_label"]).take(pa.array(pick))
            distance = np.sqrt(np.maximum(2 - 2 * product, 0))
            return pa.table([questions.column("row").take(pa.array(own)), *found.columns, pa.array(distance, pa.float64())],
                            ["row", *found.column_names, "distance"])

        return left.groupBy("b", "q").cogroup(right.groupBy("b", "q")).applyInArrow(closest, schema)

    def search(self, docs: DataFrame) -> DataFrame:
        """The k nearest training documents of numbered documents: row, near, near_label, distance, rank."""
        k, asked = self.getOrDefault("k"), self.asked(docs)
        met = cut(self._near(asked))
        # a bounded list of documents fills up what shares too little
        fill = [F.struct(F.lit(r[ROW]).alias("doc"), F.lit(r.near).alias("near"), F.lit(r.near_label).alias("near_label"),
                         F.lit(r.empty).alias("empty")) for r in self.tables["fill"].collect()]
        out = met
        if fill:
            rows = docs.select(F.col(ROW).alias("row")).join(asked.select("row", F.lit(True).alias("known")), "row", "left")
            length = F.when(F.col("x.empty") & F.col("known").isNull(), 0.0).when(F.col("x.empty") | F.col("known").isNull(), 1.0)
            filling = (rows.withColumn("x", F.explode(F.array(*fill)))
                       .select("row", "x.doc", F.col("x.near").cast(met.schema["near"].dataType).alias("near"), "x.near_label",
                               length.otherwise(F.sqrt(F.lit(2.0))).alias("distance")))
            out = met.unionAll(filling.join(met.select("row", "doc"), ["row", "doc"], "left_anti").select(*met.columns))
        rank = F.row_number().over(Window.partitionBy("row").orderBy("distance", "near", "doc"))
        return out.withColumn("rank", rank).where(F.col("rank") <= k).drop("doc")


def _entries(vectors: DataFrame, key: str) -> DataFrame:
    """Rows (key, place, weight) of vectors."""
    return vectors.select(key, F.explode(F.arrays_zip("places", "weights")).alias("x")).select(
        key, F.col("x.places").alias("place"), F.col("x.weights").alias("weight"))


def _lists(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bounds, places and weights of the vectors of a table."""
    parts = [pa.concat_arrays(table.column(c).chunks) if table.num_rows else pa.array([], pa.list_(t))
             for c, t in (("places", pa.int32()), ("weights", pa.float64()))]
    sizes = parts[0].value_lengths().to_numpy(zero_copy_only=False)
    return np.r_[0, np.cumsum(sizes)].astype(np.int64), *[p.flatten().to_numpy(zero_copy_only=False) for p in parts]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """All places of the given runs, one run after another."""
    return np.repeat(starts - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())


def _best_products(docs, questions, n: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each question its k largest products above 0, earlier documents first on ties: places of
    questions and documents, and the products."""
    bounds, places, weights = docs
    order = np.argsort(places, kind="stable")
    known, first = np.unique(places[order], return_index=True)
    count = np.diff(np.r_[first, len(places)])
    owner = np.repeat(np.arange(n), np.diff(bounds))[order]
    by_term, local = weights[order], np.searchsorted(known, places)
    top = np.maximum.reduceat(by_term, first) if len(known) else np.zeros(0)
    own, pick, products = [], [], []
    for i in range(len(questions[0]) - 1 if len(known) else 0):
        part = slice(questions[0][i], questions[0][i + 1])
        at = np.minimum(np.searchsorted(known, questions[1][part]), len(known) - 1)
        met = known[at] == questions[1][part]
        at, q = at[met], questions[2][part][met]
        turn = np.argsort(-q * top[at], kind="stable")
        at, q = at[turn], q[turn]
        # the most that a term and those behind it add: their largest weights, or their own length
        rest = np.minimum(np.cumsum((q * top[at])[::-1]), np.sqrt(np.cumsum((q * q)[::-1])))[::-1]
        rest, product, done, step = np.r_[rest, 0.0], np.zeros(n), 0, 4
        while done < len(at):
            part = slice(done, done + step)
            hits = _ranges(first[at[part]], count[at[part]])
            product += np.bincount(owner[hits], by_term[hits] * np.repeat(q[part], count[at[part]]), n)
            done, step = min(done + step, len(at)), 2 * step
            goal = np.partition(product, n - k)[n - k] if n > k else 0.0
            if done < len(at) and rest[done] < goal - _SLACK:
                open_ = np.flatnonzero(product + rest[done] >= goal - _SLACK)
                sizes = bounds[open_ + 1] - bounds[open_]
                if sizes.sum() < count[at[done:]].sum():
                    left = np.zeros(len(known))
                    left[at[done:]] = q[done:]
                    hits = _ranges(bounds[open_], sizes)
                    more = np.bincount(np.repeat(np.arange(len(open_)), sizes), left[local[hits]] * weights[hits], len(open_))
                    whole = np.zeros(n)
                    whole[open_] = product[open_] + more
                    product, done = whole, len(at)
        found = np.flatnonzero(product > 0)
        best = found[knn._smallest(-np.round(product[found], 12), k)]
        own.append(np.full(len(best), i))
        pick.append(best)
        products.append(np.round(product[best], 12))
    return tuple(np.concatenate([np.zeros(0, t), *x]) for x, t in ((own, np.int64), (pick, np.int64), (products, np.float64)))


class VectorNeighbours(Estimator, HasInputCol, HasLabelCol, HasPredictionCol, _Neighbours, DefaultParamsReadable, DefaultParamsWritable):
    """Classes by the k nearest rows, by the distance of a vector column of fixed length."""

    @keyword_only
    def __init__(self, *, inputCol="features", labelCol="label", predictionCol="prediction", k=10, weights="uniform", mean=False, keyCol=""):
        super().__init__()
        self._setDefault(inputCol="features", labelCol="label", predictionCol="prediction", k=10, weights="uniform", mean=False, keyCol="")
        self._set(**self._input_kwargs)

    def _fit(self, dataset: DataFrame) -> "VectorNeighboursModel":
        from pyspark.ml.functions import vector_to_array
        get = self.getOrDefault
        rows = cut(dataset.where(F.col(get("labelCol")).isNotNull()).select(
            self._key().alias("near"), vector_to_array(get("inputCol")).alias("v"), F.col(get("labelCol")).cast("double").alias("near_label")))
        return self._copyValues(VectorNeighboursModel(dict(rows=rows)))


class VectorNeighboursModel(TableModel, HasInputCol, HasLabelCol, HasPredictionCol, _Neighbours):
    TABLES = ("rows",)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array
        docs = numbered(dataset)
        index = knn.PivotIndex(self.tables["rows"], "near", "v", "near_label")
        asked = docs.select(ROW, vector_to_array(self.getOrDefault("inputCol")).alias("v"))
        return self._classified(docs, index.search(asked, ROW, "v", self.getOrDefault("k")))
