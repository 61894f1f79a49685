"""Queries on text: tokens, stems, TF-IDF and text predictions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.operators import knn, text
from storelab.operators.models import TextPrediction, TfIdf, add_label
from storelab.operators.split import stratified_folds
from storelab.operators.table_model import ROW, numbered
from storelab.operators.terms import TermNeighbours
from storelab.plans.registry import query, r6
from storelab.session import cut, scratch_path
from storelab.sources import store
from storelab.sources.apps import spread, table

_TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')"
_STOP = ", ".join("'" + w.replace("'", "''") + "'" for w in K.STOP_WORDS)


def documents(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


@query("tokenize", f"select doc_id, len(t) n_tokens, len(list_distinct(t)) n_distinct, md5(array_to_string(t, ' ')) tokens_md5 "
       f"from (select doc_id, {_TOKENS} t from documents)")
def tokenize(spark, sf_dir):
    split = documents(spark, sf_dir).select("doc_id", text.tokens(F.col("text")).alias("t"))
    return split.select(
        "doc_id", F.size("t").cast("bigint").alias("n_tokens"),
        F.size(F.array_distinct("t")).cast("bigint").alias("n_distinct"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"))


_KEPT = f"list_filter({_TOKENS}, lambda w: w not in ({_STOP}))"


@query("stop_words", f"select doc_id, len(t) n_tokens, md5(array_to_string(t, ' ')) tokens_md5 "
       f"from (select doc_id, {_KEPT} t from documents)")
def stop_words(spark, sf_dir):
    kept = documents(spark, sf_dir).select(
        "doc_id", text.without_stop_words(text.tokens(F.col("text"))).alias("t"))
    return kept.select("doc_id", F.size("t").cast("bigint").alias("n_tokens"),
                       F.md5(F.array_join("t", " ")).alias("tokens_md5"))


def _grams_sql(n: int) -> str:
    return (f"case when len(t) >= {n} then list_transform(range(1, len(t) - {n} + 2), "
            f"lambda i: array_to_string(t[i:i + {n - 1}], ' ')) else [] end")


@query("ngrams", f"select doc_id, len(g) n_grams, len(list_distinct(g)) n_distinct, md5(array_to_string(g, '|')) grams_md5 "
       f"from (select doc_id, list_concat(list_concat({_grams_sql(2)}, {_grams_sql(3)}), {_grams_sql(4)}) g "
       f"from (select doc_id, {_KEPT} t from documents))")
def ngrams(spark, sf_dir):
    kept = documents(spark, sf_dir).select(
        "doc_id", text.without_stop_words(text.tokens(F.col("text"))).alias("t"))
    grams = kept.select("doc_id", text.ngrams(F.col("t")).alias("g"))
    return grams.select("doc_id", F.size("g").cast("bigint").alias("n_grams"),
                        F.size(F.array_distinct("g")).cast("bigint").alias("n_distinct"),
                        F.md5(F.array_join("g", "|")).alias("grams_md5"))


_COUNTS = f"counts as (select doc_id, unnest({_TOKENS}) token from documents)"
_TF = "tf as (select doc_id, token, count(*) tf from counts group by 1, 2)"
_DF = "df as (select token, count(*) df from tf group by 1)"
_N = "(select count(*) from documents)"


def _counts(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return text.term_counts(docs, "doc_id", text.tokens(F.col("text"))), docs


@query("doc_frequency", f"with {_COUNTS}, {_TF}, {_DF} select token, df from df where df >= 0.01 * {_N} and df <= 0.6 * {_N}")
def doc_frequency(spark, sf_dir):
    counts, docs = _counts(spark, sf_dir)
    return text.doc_frequency(counts, docs, 0.01, 0.6)


@query("tfidf", f"with {_COUNTS}, {_TF}, {_DF}, raw as (select doc_id, token, tf * (ln((1 + {_N}) / (1 + df)) + 1) raw "
       "from tf join df using (token)) select doc_id, token, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) weight from raw")
def tfidf(spark, sf_dir):
    counts, docs = _counts(spark, sf_dir)
    return text.tfidf(counts, docs, "doc_id").withColumn("weight", r6("weight"))


@query("tfidf_binary", f"with {_COUNTS}, {_TF}, {_DF}, raw as (select doc_id, token, ln((1 + {_N}) / (1 + df)) + 1 raw "
       f"from tf join df using (token) where df >= 0.25 * {_N} and df <= 0.75 * {_N}) "
       "select doc_id, token, round(raw / sqrt(sum(raw * raw) over (partition by doc_id)), 6) weight from raw")
def tfidf_binary(spark, sf_dir):
    counts, docs = _counts(spark, sf_dir)
    return text.tfidf(counts, docs, "doc_id", 0.25, 0.75, binary=True).withColumn("weight", r6("weight"))


@query("stem_vocabulary")
def stem_vocabulary(spark, sf_dir):
    return text.stem_vocabulary(documents(spark, sf_dir), "text")


@query("stemmed_tfidf")
def stemmed_tfidf(spark, sf_dir):
    docs = documents(spark, sf_dir)
    counts = text.stemmed_counts(docs, "doc_id", "text")
    return text.tfidf(counts, docs, "doc_id", 0.25, 0.75)


# --- text predictions; the quality label of a document plays the class --------------

_CACHE: dict[tuple[str, str, str], str] = {}


def labelled_documents(spark, sf_dir):
    """Labelled documents with stems and five folds, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "docs")
    path = _CACHE.setdefault(key, scratch_path(spark, "documents"))

    def build():
        docs = documents(spark, sf_dir).join(
            table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
        docs = text.stemmed_documents(docs, "doc_id", "text")
        docs = stratified_folds(docs.withColumn("price_class", F.col("quality") + 1), "price_class", "doc_id", 5)
        return add_label(docs)

    return store.cached_table(spark, path, build)


_FOLDED = """folded as (
  select doc_id, quality, text, ntile(5) over (partition by quality order by doc_id) fold from documents join labels using (doc_id))"""
_GRAMS = f"""grams as (
  select doc_id, quality, fold, unnest(list_concat(list_concat({_grams_sql(2)}, {_grams_sql(3)}), {_grams_sql(4)})) g
  from (select doc_id, quality, fold, {_KEPT} t from folded)),
gtf as (select doc_id, quality, fold, g, count(*) tf from grams group by all),
train_n as (select count(*) n from folded where fold <> 1),
gdf as (select g, ln((1 + n) / (1 + count(*)::double)) + 1 idf from gtf, train_n where fold <> 1 group by g, n),
gw as (select doc_id, quality, fold, g, tf * idf / sqrt(sum(tf * tf * idf * idf) over (partition by doc_id)) w from gtf join gdf using (g))"""


@query("text_feature_a", f"""with {_FOLDED}, {_GRAMS},
sums as (select quality c, g, sum(w) s from gw where fold <> 1 group by all),
sizes as (select quality c, ln(count(*) / (select n from train_n)) prior from folded where fold <> 1 group by 1),
totals as (select sizes.c, prior, coalesce(sum(s), 0) + (select count(*) from gdf) total from sizes left join sums using (c) group by all),
scored as (
  select d.doc_id, t.c, any_value(t.prior) + coalesce(sum(w * (ln(coalesce(s, 0) + 1) - ln(t.total))), 0) score
  from folded d cross join totals t left join gw on gw.doc_id = d.doc_id left join sums on sums.c = t.c and sums.g = gw.g group by 1, 2)
select folded.doc_id, fold, quality::double as label, (select arg_min(c, (-round(score, 9), c)) from scored s where s.doc_id = folded.doc_id)::double as text
from folded""")
def text_feature_a(spark, sf_dir):
    """The text replaced by the class that naive Bayes on all word 2- to 4-grams gives it."""
    grams = text.ngrams(text.without_stop_words(text.tokens(F.col("text"))))
    docs = labelled_documents(spark, sf_dir).withColumn("tokens", grams)
    model = TextPrediction([dict(kind="multinomial")], dict(minDF=0.0), "text_class").fit(docs.where("fold <> 1"))
    return model.transform(docs).select("doc_id", "fold", "label", F.col("text_class").alias("text"))


@query("text_neighbours", f"""with {_FOLDED}, {_GRAMS.replace(_grams_sql(2), "t").replace(f"list_concat(list_concat(t, {_grams_sql(3)}), {_grams_sql(4)})", "t")},
pairs as (
  select q.doc_id, t.doc_id near, round(sum(q.w * t.w), 12) p from gw q join gw t on q.g = t.g and q.fold = 1 and t.fold <> 1 group by 1, 2),
lengths as (select doc_id, sum(w * w) l from gw group by 1),
every as (
  select q.doc_id, q.quality, t.doc_id near, t.quality near_label,
    sqrt(greatest(round(coalesce(a.l, 0)) + round(coalesce(b.l, 0)) - 2 * coalesce(p, 0), 0)) d
  from folded q join folded t on q.fold = 1 and t.fold <> 1 left join pairs on pairs.doc_id = q.doc_id and pairs.near = t.doc_id
  left join lengths a on a.doc_id = q.doc_id left join lengths b on b.doc_id = t.doc_id
  qualify row_number() over (partition by q.doc_id order by d, t.doc_id) <= 10),
votes as (
  select doc_id, quality, near_label, count(*) u, sum(case when d = 0 then 1e300 else 1 / d end) w from every group by all)
select doc_id, quality::double as label, arg_min(near_label, (-u, near_label))::double as y_uniform,
  arg_min(near_label, (-round(w, 9), near_label))::double as y_distance from votes group by 1, 2""")
def text_neighbours(spark, sf_dir):
    """Classes by the 10 nearest labelled documents outside fold 1, by their TF-IDF vectors."""
    kept = text.without_stop_words(text.tokens(F.col("text")))
    docs = labelled_documents(spark, sf_dir).withColumn("tokens", kept)
    model = TermNeighbours(k=10, keyCol="doc_id").fit(docs.where("fold <> 1"))
    test = numbered(docs.where("fold = 1").select("doc_id", "label", "tokens"))
    found = cut(model.search(test))
    votes = [knn.classify(found, how).select(F.col("row").alias(ROW), F.col("prediction").alias(f"y_{how}")) for how in ("uniform", "distance")]
    return test.join(votes[0], ROW).join(votes[1], ROW).select("doc_id", "label", "y_uniform", "y_distance")


@query("text_feature_b")
def text_feature_b(spark, sf_dir):
    """The class from boosting on stems, fitted without fold 1, next to the text."""
    docs = labelled_documents(spark, sf_dir)
    model = TextPrediction([dict(kind="gbt", rate=0.1, trees=100, depth=7)]).fit(docs.where("fold <> 1"))
    return model.transform(docs).select("doc_id", "fold", "label", "textFeaturePrediction")


@query("text_feature_matrix")
def text_feature_matrix(spark, sf_dir):
    """TF-IDF as a sparse vector column next to the other columns: its non-zero entries."""
    docs = labelled_documents(spark, sf_dir)
    model = Pipeline(stages=[TfIdf(minDF=0.25, maxDF=0.75)]).fit(docs)
    dense = vector_to_array("features")
    return model.transform(docs).select(
        "doc_id", "label", F.size(dense).alias("n_columns"),
        F.size(F.filter(dense, lambda v: v != 0)).alias("n_filled"))


@query("tfidf_dense")
def tfidf_dense(spark, sf_dir):
    """TF-IDF over a limited vocabulary as an array."""
    docs = labelled_documents(spark, sf_dir)
    model = Pipeline(stages=[TfIdf(minDF=0.25, maxDF=0.75)]).fit(docs)
    return model.transform(docs.select("doc_id", "tokens")).select(
        "doc_id", F.array_join(F.transform(vector_to_array("features"), lambda v: F.round(v, 6).cast("string")), " ")
        .alias("weights"))
