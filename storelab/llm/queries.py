"""The queries of the operators, over the whole ``documents`` table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from storelab.llm import (chat, edit_embedding, katz, mixing, near_dedup, packing, prefix_trie, quality_classifier, quality_rules,
                          rollups, sharding, substring_dedup, va_clustering)
from storelab.operators.lookup import join_groups
from storelab.session import cut, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@query("op1_quality_classifier")
def op1_quality_classifier(spark, sf_dir):
    """Quality score of every document."""
    return quality_classifier.classified(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query("op2_substring_dedup", r"""
with texts as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
windows as (
  select doc_id, i, array_to_string(w[i:i + 49], ' ') as s
  from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from texts where len(w) >= 50)),
firsts as (select s, min(doc_id) as first_id from windows group by s),
removed as (select distinct doc_id, unnest(range(i, i + 50)) as j from windows join firsts using (s) where first_id < doc_id),
words as (select doc_id, unnest(w) as word, generate_subscripts(w, 1) as j from texts),
kept as (
  select doc_id, count(*) as n_kept, string_agg(word, ' ' order by j) as t
  from words anti join removed using (doc_id, j) group by doc_id)
select doc_id, len(w) as n_words, len(w) - coalesce(n_kept, 0) as n_removed, sha256(coalesce(t, '')) as kept_sha256
from texts left join kept using (doc_id)
""")
def op2_substring_dedup(spark, sf_dir):
    """What is left of every document without passages of earlier documents."""
    return substring_dedup.digests(documents(spark, sf_dir))


@query("op3_sharding")
def op3_sharding(spark, sf_dir):
    """Shard and slot of every document in a reproducible shuffle."""
    return sharding.sharded(documents(spark, sf_dir), shards=16, seed=20240611)


@query("op4_edit_fingerprint")
def op4_edit_fingerprint(spark, sf_dir):
    """Fingerprint of every document, and its likeness to an edited text and to the next document."""
    return edit_embedding.edit_likeness(documents(spark, sf_dir))


@query("op5_mixing")
def op5_mixing(spark, sf_dir):
    """Passes and places of every document in the mixture."""
    return mixing.mixture(documents(spark, sf_dir))


@query("op6_katz_scores")
def op6_katz_scores(spark, sf_dir):
    """Log10 probability of every document under the backoff model and under the base."""
    return katz.language_scores(documents(spark, sf_dir))


@query("op7_packing")
def op7_packing(spark, sf_dir):
    """Sequence and offset of every token piece of every document."""
    return packing.packed(documents(spark, sf_dir))


@query("op8_token_rollups")
def op8_token_rollups(spark, sf_dir):
    """Token totals after three batches over all documents, one of them committed twice.

    Batch 1 inserts every document under two tokenizer versions. Batch 2 deletes the copies
    of a text with a smaller id. Batch 3 revises the ids of the others by the end id.
    """
    docs = documents(spark, sf_dir)
    digest = F.md5(F.coalesce("text", F.lit("")))
    counts = cut(rollups.token_counts(docs.select("doc_id", "source", "lang", "text", digest.alias("digest"))))
    # only texts that occur twice can have a copy
    firsts = (counts.groupBy("digest").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n"))
              .where("n > 1").drop("n"))
    marked = cut(join_groups(counts, firsts, "digest", "left")
                 .withColumn("copy", F.coalesce(F.col("first_id") < F.col("doc_id"), F.lit(False))))
    words, ids = ("words", F.col("n_words")), ("word_bpe_49k", F.col("n_ids"))
    inserts = rollups.changes(marked, "insert", *words).unionAll(rollups.changes(marked, "insert", *ids))
    copies = marked.where("copy")
    deletes = rollups.changes(copies, "delete", *words).unionAll(rollups.changes(copies, "delete", *ids))
    revised = rollups.changes(marked.where("not copy"), "revise", ids[0], F.col("n_ids") + 1, F.col("n_ids"))
    folder = scratch_path(spark, "rollups")
    rollups.commit(inserts, folder, "batch-1")
    rollups.commit(deletes, folder, "batch-2")
    rollups.commit(deletes, folder, "batch-2")
    rollups.commit(revised, folder, "batch-3")
    return rollups.totals(spark, folder)


@query("op9_quality_rules")
def op9_quality_rules(spark, sf_dir):
    """Base measures, divergence from the language references and the verdict."""
    return quality_rules.quality_rules(documents(spark, sf_dir))


@query("op10_minhash_dedup", r"""
with recursive texts as (
  select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
         'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
shingles as (
  select distinct doc_id, unnest(case when len(w) >= 5
    then list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    when len(w) > 0 then [array_to_string(w, ' ')] else [] end) as s from texts),
sizes as (select doc_id, count(*) as n from shingles group by doc_id),
pairs as (
  select a.doc_id as a, b.doc_id as b, count(*) as k from shingles a join shingles b on a.s = b.s and a.doc_id < b.doc_id
  group by 1, 2),
links as (
  select a, b from pairs join sizes x on x.doc_id = a join sizes y on y.doc_id = b where 100 * k >= 75 * (x.n + y.n - k)),
edges as (select a, b from links union select b, a from links),
reach as (select doc_id as a, doc_id as b from texts union select reach.a, edges.b from reach join edges on reach.b = edges.a),
least_id as (select a as doc_id, min(b) as component_id from reach group by a)
select doc_id, coalesce(n, 0) as n_shingles, component_id, component_id = doc_id as kept
from texts left join sizes using (doc_id) join least_id using (doc_id)
""")
def op10_minhash_dedup(spark, sf_dir):
    """Component and survivor of every document."""
    return near_dedup.near_duplicates(documents(spark, sf_dir))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


ESCAPE_CASE = "\\### Assistant: </turn> ok"


# a turn adds its marks, 19 characters; a backslash and the first character of a mark become two
@query("op11_chat_formatting", r"""
with told as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok' union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
sized as (
  select *, md5(strlen(role) || ':' || role || text) as code,
    19 + length(role) + length(text) + length(regexp_replace(role || chr(0) || text, '[^\\]', '', 'g'))
    + len(regexp_extract_all(role || chr(0) || text, '<turn>|<text>|</turn>')) as chars from told)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, code)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, code) filter (role = 'assistant'), '')) as loss_sha256,
  sum(chars)::bigint as formatted_chars
from sized group by conv_id
""")
def op11_chat_formatting(spark, sf_dir):
    """Digests of every conversation, and of one whose texts hold marks, read back from the formatted output."""
    told = conversations(spark, sf_dir)
    case = spark.range(2).select(F.lit(-7).alias("conv_id"), F.col("id").alias("turn"),
                                 F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit(ESCAPE_CASE).alias("text"))
    case = case.select(*[F.col(c).cast(told.schema[c].dataType) for c in case.columns])
    return chat.chat_digests(told.select(*case.columns).unionAll(case))


@query("op12_prefix_trie", r"""
with turns as (
  select conv_id, code, chars, row_number() over (partition by conv_id order by turn nulls first, code) as pos from (
    select conv_id, turn, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) as code, length(coalesce(text, '')) as chars
    from conversations where conv_id is not null)),
heads as (
  select conv_id, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::bigint)),
    lambda a, c: list_reduce(list_prepend(xor(a, c), [0, 0, 0, 0, 0, 0, 0, 0]::bigint[]),
      lambda r, z: case when r & 1 = 1 then xor(r >> 1, 3988292384::bigint) else r >> 1 end)), 4294967295::bigint) % 6 as h
  from (select distinct conv_id from turns)),
made as (
  select c.conv_id, pos, code, chars from heads c join turns t on t.conv_id = c.conv_id - c.conv_id % 100 and pos <= h
  union all select c.conv_id, pos, code, chars from heads c join turns t on t.conv_id = c.conv_id and pos > h),
prefixes as (
  select conv_id, row_number() over w as d, chars, sha256(string_agg(code, '') over w) as k from made window w as (partition by conv_id order by pos)
  union all select conv_id, 0, 0, '' from heads),
nodes as (select d, k, min(conv_id) as conv_id, count(*) as n, any_value(chars) as chars from prefixes group by d, k),
linked as (
  select v.*, p.conv_id as parent_conv_id from nodes v left join prefixes x on x.conv_id = v.conv_id and x.d = v.d - 1
  left join nodes p on p.d = x.d and p.k = x.k),
children as (select parent_conv_id as conv_id, d - 1 as d, count(*) as n_children from linked where d > 0 group by 1, 2),
counted as (select linked.*, coalesce(n_children, 0) as n_children from linked left join children using (conv_id, d)),
sums as (
  select a.d, a.k, count(*) filter (v.n_children = 0) as n_leaves, sum((v.n - 1) * v.chars) as saved
  from counted v join prefixes x on x.conv_id = v.conv_id and x.d <= v.d join nodes a on a.d = x.d and a.k = x.k group by 1, 2),
lasts as (select conv_id, max(d) as d from prefixes group by 1),
ends as (select d, k, string_agg(conv_id::varchar, ',' order by conv_id) as ids from prefixes join lasts using (conv_id, d) group by 1, 2)
select conv_id, d as depth, parent_conv_id, n as n_convs, n_children, n_leaves, saved::bigint as saved_tokens, sha256(coalesce(ids, '')) as ends_sha256
from counted join sums using (d, k) left join ends using (d, k)
""")
def op12_prefix_trie(spark, sf_dir):
    """Every node of the trie of rebuilt conversations."""
    return prefix_trie.conversation_trie(conversations(spark, sf_dir))


def _round_sql(i: int) -> str:
    """Assignment and new centroids of round ``i``."""
    return f"""
a{i} as materialized (
  select vec_id, x, arg_min(n, (list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint, n)) as n
  from kept, c{i} group by vec_id, x),
s{i} as (
  select n, list(m order by j) as c from (
    select n, j, (sum(x[j])::bigint - ((sum(x[j])::bigint % count(*)) + count(*)) % count(*)) // count(*) as m
    from a{i}, (select unnest(range(1, 65)) as j) group by n, j) group by n),
c{i + 1} as materialized (select n, coalesce(s{i}.c, c{i}.c) as c from c{i} left join s{i} using (n)),"""


@query("op13_va_clustering", """
with kept as materialized (
  select vec_id, list_transform(embedding, lambda e: floor(256 * e::double)::bigint) as x from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda e: e is null or isnan(e) or isinf(e))) = 0),
c0 as materialized (
  select row_number() over (order by h) - 1 as n, x as c from (select x, sha256('2:' || vec_id) as h from kept order by h limit 40)),"""
       + "".join(map(_round_sql, range(5))) + """
ended as materialized (
  select vec_id, min((d, n)) as b from (
    select vec_id, n, list_sum(list_transform(list_zip(x, c), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::bigint as d from kept, c5) group by vec_id)
select vec_id, b[2]::int as cluster, b[1] as distance, sum(b[1]) over (partition by b[2])::bigint as cluster_inertia,
  sum(b[1]) over ()::bigint as inertia, sha256(array_to_string(c5.c, ',')) as centroid_sha256
from ended join c5 on c5.n = b[2]
""")
def op13_va_clustering(spark, sf_dir):
    """Cluster and distance of every vector after five rounds."""
    return va_clustering.clustered(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
