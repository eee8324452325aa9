"""The registered queries of the pipeline operators and the SQL that some of them can be held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .clusters import clustered
from .common import Store, prepare, table
from .exact_dedup import exact_groups
from .embed_dedup import embedding_groups
from .lang_id import language_groups
from .licenses import BASE, NOTICES, labelled
from .lm_score import scored
from .mixing import draws
from .near_dedup import simhash_groups
from .ordering import ordered
from .packing import packed
from .resample import resampled
from .sharding import shard_documents
from .substring_dedup import remove_repeats


def op1_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(table(spark, sf_dir, "documents"), Store(prepare(spark), "op1"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"), Store(prepare(spark), "op8"), k=4, tau=4)


def _tokenizer() -> str:
    """The vocabulary file the queries use; operators take its path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), Store(prepare(spark), "op3"), shards=16, law="rows")


def op4_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """slot, shard, row, doc_id, piece, length, record_crc32 of every sequence, from the records that shards are written from."""
    rows = ordered(table(spark, sf_dir, "documents"), Store(prepare(spark), "op4"), _tokenizer(), length=512, shard_rows=16_384)
    return rows.withColumn("record_crc32", F.crc32("record")).drop("record")


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), Store(prepare(spark), "op6"), _tokenizer(), capacity=2048)


def op7_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_groups(table(spark, sf_dir, "embeddings"), Store(prepare(spark), "op7"), cosine=0.98)


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"), Store(prepare(spark), "op9"), width=50)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of 0.9 of the largest entropy (sharper than the sources where theirs is above), no source passed over more than four times, as many tokens as there are."""
    return draws(table(spark, sf_dir, "documents"), Store(prepare(spark), "op10"), entropy_share=0.9, most_passes=4.0)


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A quarter of the documents with 20 words or more, drawn by likeness to the benchmark's texts."""
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resampled(docs, target, Store(spark, "op11")).drop("n_words")


def op12_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustered(table(spark, sf_dir, "embeddings"), Store(spark, "op12"))


def op13_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labelled(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_lm_score, op2_exact_dedup, op3_sharding, op4_training_order, op5_language, op6_packing, op7_embeddings, op8_simhash, op9_substrings, op10_mixing, op11_resampling, op12_clusters, op13_licenses)}


def _rounds(n: int) -> str:
    """SQL of so many rounds of k-means: tables at{i} (vec_id, cluster, distance, v) and c{i} (k, c)."""
    parts = []
    for i in range(n + 1):
        parts.append(f"""at{i} as materialized (select vec_id, v, arg_min(k, d * 100 + k) as cluster, min(d) as distance from (
  select vec_id, v, k, list_sum(list_transform(range(1, 65), lambda j: (v[j] - c[j]) * (v[j] - c[j])))::bigint as d from v, c{i}) group by vec_id, v)""")
        if i < n:
            parts.append(f"""m{i} as (select cluster, list(m order by j) as c from (select cluster, j, floor(sum(x) / count(*))::bigint as m from (select cluster, unnest(v) as x, unnest(range(64)) as j from at{i}) group by 1, 2) group by 1),
c{i + 1} as materialized (select k, coalesce(m{i}.c, c{i}.c) as c from c{i} left join m{i} on cluster = k)""")
    return ",\n".join(parts)


def _templates() -> str:
    """SQL rows of all key phrases: template, label, phrase, place, head (the first one's place), words, notice."""
    quoted = lambda words: "[" + ", ".join(f"'{w.decode()}'" for w in words) + "]"
    rows = []
    for t, template in enumerate([*BASE, *NOTICES]):
        keys = template.keys()
        rows += [f"({t}, '{template.label}', {k}, {at}, {keys[0][0]}, {quoted(phrase)}, {quoted(template.words())})" for k, (at, phrase) in enumerate(keys)]
    return ",\n".join(rows)


_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op2_exact_dedup": f"""
with t as (select doc_id, {_LOW} as low from documents)
select doc_id, max(doc_id) over w as keep_id, count(*) over w as group_size,
       doc_id = max(doc_id) over w as kept, sha256(low) as text_sha256
from t window w as (partition by low)""",
    "op7_embeddings": """
with recursive v as (
  select vec_id, label, list_transform(embedding, lambda x: x::double) as e from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
links as (select a.vec_id as a, b.vec_id as b from v a join v b on a.label = b.label and a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.98),
walk as (select a as id, b as other from links union select w.id, l.b from walk w join links l on l.a = w.other),
least as (select id, least(id, min(other)) as component_id from walk group by id),
n as (select a as id, count(*) as n_links from links group by a)
select vec_id, coalesce(n_links, 0) as n_links, coalesce(component_id, vec_id) as component_id, vec_id = coalesce(component_id, vec_id) as kept
from embeddings left join n on n.id = vec_id left join least on least.id = vec_id""",
    "op9_substrings": """
with d as (select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
win as (select doc_id, i, list_slice(w, i, i + 49) as k from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d where len(w) >= 50)),
first as (select md5(array_to_string(k, ' ')) as h, min(doc_id) as first from win group by 1),
gone as (select doc_id, list(i) as starts from (select doc_id, i, md5(array_to_string(k, ' ')) as h from win) join first using (h) where first < doc_id group by doc_id),
cover as (select doc_id, list_distinct(flatten(list_transform(starts, lambda s: range(s, s + 50)))) as c from gone),
kept as (select doc_id, len(w) as n_words, coalesce(len(c), 0) as n_removed,
  case when c is null then w else list_filter(w, lambda x, i: not list_contains(c, i)) end as k from d left join cover using (doc_id))
select doc_id, n_words, n_removed, sha256(array_to_string(k, ' ')) as kept_sha256 from kept""",
    "op11_resampling": f"""
with words as (select doc_id, list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
target as (select list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from benchmark),
feat as (select doc_id, len(w) as n_words, w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) as f from words),
used as (select unnest(f) as f from feat),
wanted as (select unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from target),
-- CRC-32 by half bytes, the low one first
half as (select list(list_reduce([1, 2, 3, 4], lambda c, i: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end, k::bigint) order by k) as t from range(16) as r(k)),
code as (select f, xor(list_reduce(list_transform(range(0, 2 * octet_length(encode(f))), lambda i: instr('123456789ABCDEF', hex(encode(f))[(i // 2) * 2 + 2 - i % 2])),
  lambda c, n: xor(c // 16, t[xor(c % 16, n::bigint) + 1]), 4294967295::bigint), 4294967295) % 10000 as bucket from (select distinct f from (from used union all from wanted)), half),
corpus as (select bucket, count(*) as s from used join code using (f) group by 1), goal as (select bucket, count(*) as t from wanted join code using (f) group by 1),
sums as (select (select coalesce(sum(s), 0) from corpus) as big, (select coalesce(sum(t), 0) from goal) as small),
gain as (select bucket, floor(1000 * ln((coalesce(t, 0) + 1)::double * (big + 10000)::double / ((s + 1)::double * (small + 10000)::double))) as g from corpus left join goal using (bucket), sums),
mean as (select doc_id, floor(sum(g) / count(*))::bigint as weight from (select doc_id, unnest(f) as f from feat) join code using (f) join gain using (bucket) group by 1),
score as (select doc_id, n_words, len(f) as n_features, coalesce(weight, 0) as weight,
  coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('7:' || doc_id)[1:8])::bigint + 0.5::double) / 4294967296)))::bigint as score from feat left join mean using (doc_id)),
place as (select doc_id, row_number() over (order by score desc, doc_id) as place, 25 * count(*) over () // 100 as n from score where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= n then place end as rank from score left join place using (doc_id)""",
    "op12_clusters": f"""
with v as materialized (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
  where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (select row_number() over (order by sha256('1:' || vec_id)) - 1 as k, v as c from v order by sha256('1:' || vec_id) limit 16),
{_rounds(3)}
select vec_id, cluster::int as cluster, distance, (sum(distance) over (partition by cluster))::bigint as cluster_inertia,
  (sum(distance) over ())::bigint as inertia, sha256(array_to_string(c, ',')) as centroid_sha256 from at3 join c3 on k = cluster""",
    "op13_licenses": f"""
with phrase(template, label, k, place, head, words, notice) as (values {_templates()}),
d as materialized (select doc_id, list_filter(string_split_regex({_LOW}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') as w from documents),
word as materialized (select doc_id, unnest(w) as word, unnest(range(len(w))) as i from d),
run as (select *, list(word) over (partition by doc_id order by i rows between current row and 15 following) as run from word),
hit as materialized (select doc_id, i, template, k, label, place, head, notice from run join phrase on word = words[1] and run[1:len(words)] = words),
many as (select template, count(*) as n from phrase group by 1),
whole as (select a.doc_id, a.template, a.label, a.i, a.head, a.notice from hit a join many m on a.template = m.template left join hit b
    on a.doc_id = b.doc_id and a.template = b.template and b.k > 0 and abs(b.i - (a.i + b.place - a.head)) <= 8
  where a.k = 0 group by a.doc_id, a.template, a.label, a.i, a.head, a.notice, m.n having count(distinct b.k) = m.n - 1),
spot as (select *, i - head + unnest(range(len(notice))) as spot, unnest(notice) as want from whole),
share as (select s.doc_id, template, label, s.i, count(word) / len(notice) as share from spot s left join word on word.doc_id = s.doc_id and word.i = spot and word = want
  group by s.doc_id, template, label, s.i, notice),
found as (select doc_id, count(*) filter (template < {len(BASE)}) as n_base, min(i) filter (template < {len(BASE)}) as first_word, max(i) filter (template < {len(BASE)}) as last_word,
  string_agg(distinct label, ',' order by label) filter (template < {len(BASE)}) as base_labels, string_agg(distinct label, ',' order by label) as labels, max(share) as score from share group by doc_id)
select doc_id, len(w) as n_words, coalesce(n_base, 0) as n_base, first_word, last_word, coalesce(base_labels, '') as base_labels, coalesce(labels, '') as labels,
  coalesce(score, 0)::double as score from d left join found using (doc_id)""",
}
