"""Tokens, n-grams, stems, document frequencies and TF-IDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from storelab import constants as K
from storelab.operators.lookup import BROADCAST_ROWS
from storelab.session import cut


def tokens(text: Column) -> Column:
    """Lower-case runs of two or more letters, digits or underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def words(text: Column) -> Column:
    r"""Lower-case words of any length; a written ``\n`` counts as a blank."""
    plain = F.regexp_replace(text, r"\\n", " ")
    return F.regexp_extract_all(F.lower(plain), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))


def without_stop_words(items: Column, stop_words: Sequence[str] = K.STOP_WORDS) -> Column:
    return F.filter(items, lambda w: ~w.isin(*stop_words))


def ngrams(items: Column, low: int = 2, high: int = 4) -> Column:
    """All runs of ``low`` to ``high`` neighbouring tokens, joined by a blank."""
    def of(tokens: Column, n: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(tokens) - (n - 1), F.lit(1)))
        grams = F.transform(starts, lambda i: F.array_join(F.slice(tokens, i, n), " "))
        return F.when(F.size(tokens) >= n, grams).otherwise(F.array().cast("array<string>"))

    def every(tokens: Column) -> Column:
        return F.concat(*[of(tokens, n) for n in range(low, high + 1)])

    # bound to a variable, so that the tokens are worked out once per text
    return F.get(F.transform(F.array(items), every), F.lit(0))


# --- Porter stems -------------------------------------------------------------------
# A word is [C](VC)^m[V]: consonant and vowel runs, where y is a vowel after a consonant.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
M0 = f"^({_C})?{_V}{_C}"                      # m > 0
M1 = f"^({_C})?{_V}{_C}({_V})?$"              # m = 1
M2 = f"^({_C})?{_V}{_C}{_V}{_C}"              # m > 1
VOWEL = f"^({_C})?[aeiouy]"
CVC = f"(^{_C}[aeiouy][^aeiouwxy]$)|(^[aeiou][^aeiou]$)"
_DOUBLE = "(bb|cc|dd|ff|gg|hh|jj|kk|mm|nn|pp|qq|rr|tt|vv|ww|xx|yy)$"

# Suffix and replacement of the published algorithm, in matching order.
STEP_2 = [("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"),
          ("izer", "ize"), ("bli", "ble"), ("alli", "al"), ("entli", "ent"), ("eli", "e"),
          ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"),
          ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"),
          ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"), ("fulli", "ful")]
STEP_3 = [("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"),
          ("ful", ""), ("ness", "")]
STEP_4 = ["al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent",
          "ou", "ism", "ate", "iti", "ous", "ive", "ize"]
# Words with an irregular stem.
IRREGULAR = {"sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news",
             "innings": "inning", "inning": "inning", "outings": "outing", "outing": "outing",
             "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed",
             "exceed": "exceed", "succeed": "succeed"}


def _cut_end(w: Column, n: int | Column) -> Column:
    return F.substring(w, F.lit(1), F.length(w) - n)


def _longest(suffixes: Sequence[str]) -> str:
    """Pattern for the longest of the suffixes: a search from the left meets it first."""
    return "(" + "|".join(suffixes) + ")$"


def _lookup(pairs: dict[str, str], key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv]), key)


def _suffix_step(df: DataFrame, name: str, rules: dict[str, str], condition: str) -> DataFrame:
    """Replace the longest suffix that fits, if its stem meets ``condition``."""
    w = F.col(name)
    df = df.withColumn("_end", F.regexp_extract(w, _longest(rules), 1))
    stem = _cut_end(w, F.length("_end"))
    return df.withColumn(name, F.when((F.col("_end") != "") & stem.rlike(condition),
                                      F.concat(stem, _lookup(rules, F.col("_end")))).otherwise(w))


def _plural(w: Column) -> Column:
    return (F.when(w.endswith("ies") & (F.length(w) == 4), _cut_end(w, 1))
            .when(w.rlike("(sses|ies)$"), _cut_end(w, 2))
            .when(w.endswith("s") & ~w.endswith("ss"), _cut_end(w, 1)).otherwise(w))


def _past(w: Column) -> Column:
    """Without -ed or -ing; a trailing '+' marks a stem that may need repair."""
    return (F.when(w.endswith("ied"), F.when(F.length(w) == 4, _cut_end(w, 1)).otherwise(_cut_end(w, 2)))
            .when(w.endswith("eed"), F.when(_cut_end(w, 3).rlike(M0), _cut_end(w, 1)).otherwise(w))
            .when(w.endswith("ed") & _cut_end(w, 2).rlike(VOWEL), F.concat(_cut_end(w, 2), F.lit("+")))
            .when(w.endswith("ing") & _cut_end(w, 3).rlike(VOWEL), F.concat(_cut_end(w, 3), F.lit("+")))
            .otherwise(w))


def _repair(w: Column) -> Column:
    s = _cut_end(w, 1)
    fixed = (F.when(s.rlike("(at|bl|iz)$"), F.concat(s, F.lit("e")))
             .when(s.rlike(_DOUBLE), _cut_end(s, 1))
             .when(s.rlike("(ll|ss|zz)$"), s)
             .when(s.rlike(M1) & s.rlike(CVC), F.concat(s, F.lit("e"))).otherwise(s))
    return F.when(w.endswith("+"), fixed).otherwise(w)


def _final_y(w: Column) -> Column:
    s = _cut_end(w, 1)
    consonant = s.rlike("([^aeiouy]|[aeiou]y|^y)$")
    return F.when(w.endswith("y") & (F.length(s) > 1) & consonant, F.concat(s, F.lit("i"))).otherwise(w)


def _alli(w: Column) -> Column:
    return F.when(w.endswith("alli") & _cut_end(w, 4).rlike(M0), _cut_end(w, 2)).otherwise(w)


def _logi(w: Column) -> Column:
    return F.when(w.endswith("logi") & _cut_end(w, 3).rlike(M0), _cut_end(w, 1)).otherwise(w)


def _ion(w: Column) -> Column:
    stem = _cut_end(w, 3)
    return F.when(w.rlike("[st]ion$") & stem.rlike(M2), stem).otherwise(w)


def _final_e(w: Column) -> Column:
    s = _cut_end(w, 1)
    return F.when(w.endswith("e") & (s.rlike(M2) | (s.rlike(M1) & ~s.rlike(CVC))), s).otherwise(w)


def _final_ll(w: Column) -> Column:
    s = _cut_end(w, 1)
    return F.when(w.endswith("ll") & s.rlike(M2), s).otherwise(w)


def add_stem(df: DataFrame, word: str, name: str = "stem") -> DataFrame:
    """Porter stem of a column of words, as column expressions.

    Each step is a projection of its own, so a word is worked out once per step.
    Words of one or two letters stay as they are.
    """
    out = df.withColumn(name, F.lower(F.col(word)))
    for step in (_plural, _past, _repair, _final_y, _alli, _logi):
        out = out.withColumn(name, step(F.col(name)))
    out = _suffix_step(out, name, dict(STEP_2), M0)
    out = _suffix_step(out, name, dict(STEP_3), M0)
    # -ion has a condition of its own and shares its end with no other suffix
    before = F.col("_before")
    out = _suffix_step(out.withColumn("_before", F.col(name)), name, {s: "" for s in STEP_4}, M2)
    out = out.withColumn(name, F.when(F.col(name) == before, _ion(before)).otherwise(F.col(name)))
    for step in (_final_e, _final_ll):
        out = out.withColumn(name, step(F.col(name)))
    lower = F.lower(F.col(word))
    return out.drop("_end", "_before").withColumn(
        name, F.when(F.length(lower) <= 2, lower).otherwise(F.coalesce(_lookup(IRREGULAR, lower), F.col(name))))


def elements(df: DataFrame, items: Column, name: str, *keep: str) -> DataFrame:
    """One row per element of an array, as ``explode``. An inner explode adds a filter on the array's
    size, which works the array out once more; here it is worked out once."""
    return df.select(*keep, F.posexplode_outer(items).alias("_pos", name)).where("_pos is not null").drop("_pos")


def vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """Distinct words of a collection."""
    return elements(docs, words(F.col(text)), "word").distinct()


def stem_vocabulary(docs: DataFrame, text: str) -> DataFrame:
    """(word, stem) for every distinct word, so that no word is stemmed twice."""
    return add_stem(vocabulary(docs, text), "word")


# --- term tables --------------------------------------------------------------------

def term_counts(docs: DataFrame, key: str | Sequence[str], items: Column) -> DataFrame:
    """Rows (key, token, tf); ``key`` may be several columns."""
    keys = [key] if isinstance(key, str) else list(key)
    return (elements(docs, items, "token", *keys)
            .groupBy(*keys, "token").agg(F.count("*").alias("tf")))


def counted(items: Column) -> Column:
    """The distinct tokens of an array with their counts, worked out inside its row: an array of
    (token, tf) in token order."""
    def starts(s: Column) -> Column:
        places = F.when(F.size(s) > 0, F.sequence(F.lit(0), F.size(s) - 1)).otherwise(F.array().cast("array<int>"))
        return F.filter(places, lambda i: (i == 0) | (F.get(s, i) != F.get(s, i - 1)))

    def runs(x: Column) -> Column:
        return F.transform(x["at"], lambda i, j: F.struct(
            F.get(x["s"], i).alias("token"), (F.coalesce(F.get(x["at"], j + 1), F.size(x["s"])) - i).cast("bigint").alias("tf")))

    # bound to variables, so that an array is sorted once and its runs are found once
    ordered = F.transform(F.array(F.sort_array(F.array_compact(items))), lambda s: F.struct(s.alias("s"), starts(s).alias("at")))
    return F.get(F.transform(ordered, runs), F.lit(0))


def stemmed_words(docs: DataFrame, key: str, text: str, stop_words: Sequence[str] = K.STOP_WORDS,
                  broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Rows (key, token, tf): the stem of each distinct word of a text, without stop words; words
    with the same stem are rows of their own. Stop words go after stemming, so a stop word
    whose stem differs stays in.

    Words are counted inside their rows, which are written once. The words of most documents,
    about ``broadcast_rows`` at most, are sent to the rows, so that only rare ones are shuffled.
    """
    rows = cut(docs.select(key, counted(words(F.col(text))).alias("items")))
    pairs = rows.select(key, F.explode("items").alias("x")).select(key, F.col("x.token").alias("word"), "x.tf")
    # written once: a filter on the stem would otherwise be pushed into every step
    stems = cut(add_stem(pairs.groupBy("word").agg(F.count("*").alias("df")), "word"))
    n, least = stems.count(), 0
    if n > broadcast_rows:
        least = stems.agg(F.percentile_approx("df", F.lit(1 - broadcast_rows / n), F.lit(10_000))).first()[0]
    frequent, kept = F.col("df") > least, ~F.col("stem").isin(*stop_words)
    found = pairs.join(F.broadcast(stems.where(frequent & kept).select("word", "stem")), "word")
    if least:
        rare = pairs.join(F.broadcast(stems.where(frequent).select("word")), "word", "left_anti")
        found = found.unionAll(rare.join(stems.where(~frequent & kept).select("word", "stem").hint("shuffle_hash"), "word"))
    return found.select(key, F.col("stem").alias("token"), "tf")


def stemmed_counts(docs: DataFrame, key: str, text: str,
                   stop_words: Sequence[str] = K.STOP_WORDS) -> DataFrame:
    """Rows (key, token, tf) over stems."""
    return stemmed_words(docs, key, text, stop_words).groupBy(key, "token").agg(F.sum("tf").alias("tf"))


def doc_frequency(counts: DataFrame, docs: DataFrame, min_share: float = 0.0,
                  max_share: float = 1.0) -> DataFrame:
    """Documents per token, for tokens found in a share of documents within the limits."""
    n = docs.agg(F.count("*").alias("n")).select("n").scalar()
    df = counts.groupBy("token").agg(F.count("*").alias("df"))
    return df.where((F.col("df") >= n * min_share) & (F.col("df") <= n * max_share))


def tfidf(counts: DataFrame, docs: DataFrame, key: str, min_share: float = 0.0,
          max_share: float = 1.0, binary: bool = False) -> DataFrame:
    """Rows (key, token, weight): tf times ln((1+n)/(1+df)) + 1, scaled to length 1 per key."""
    # written once, as the shares and the weights both read them
    counts = cut(counts)
    n = docs.agg(F.count("*").alias("n")).select("n").scalar()
    idf = cut(doc_frequency(counts, docs, min_share, max_share)
              .select("token", (F.log((1 + n) / (1 + F.col("df"))) + 1).alias("idf")))
    tf = F.lit(1.0) if binary else F.col("tf")
    # few tokens are sent to the rows; else one row per token, so the hashed side is never skewed
    sent = F.broadcast(idf) if idf.count() <= BROADCAST_ROWS else idf.hint("shuffle_hash")
    raw = counts.join(sent, "token").select(key, "token", (tf * F.col("idf")).alias("raw"))
    # a document's terms are as many as its own distinct words
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.where(F.col(key).isNotNull()).select(key, "token", (F.col("raw") / norm).alias("weight"))


def stemmed_documents(docs: DataFrame, key: str, text: str, name: str = "tokens",
                      stop_words: Sequence[str] = K.STOP_WORDS) -> DataFrame:
    """The documents with their stems as an array; the order of words is not kept."""
    bags = (stemmed_words(docs, key, text, stop_words)
            .select(key, F.array_repeat("token", F.col("tf").cast("int")).alias("same"))
            .groupBy(key).agg(F.flatten(F.collect_list("same")).alias(name)))
    return (docs.join(bags, key, "left")
            .withColumn(name, F.coalesce(name, F.array().cast("array<string>"))))
