"""The registered query of every operator: whole tables, production parameters."""

from __future__ import annotations

from uuid import uuid4

from riskloom.llm import decontaminate, hard_negatives, id_shards, license_scan, line_quality, near_dedup, packing, phrases, sentence_pieces, suffix_dedup, suffix_tree_lm, toxicity, url_rules
from pyspark.sql import functions as F

from riskloom.llm.registry import query
from riskloom.llm.text import read
from riskloom.session import checkpoint_root


def default_tokenizer() -> str:
    """The public vocabulary file that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def piece_model() -> str:
    """The public piece vocabulary that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


#: (rule_host, rule_path, verdict); fixed by the contract of the query.
URL_RULES = [
    ("net", "/", "block"),
    ("example.net", "/en/", "allow"),
    ("example.com", "/de/", "block"),
    ("org", "/fr/", "allow"),
]

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

URL_SQL = f"""
with rules(rule_host, rule_path, v) as (values {", ".join(str(r) for r in URL_RULES)}),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end as rest from pages),
parts as (select page_id, {_LOWER.format("regexp_extract(rest, '^([^/?#]*)', 1)")} as host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) as path from rest),
urls as (select distinct host, path from parts),
best as (
  select host, path, rule_host || rule_path as rule, v from urls join rules
  on (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path)
  qualify row_number() over (partition by host, path order by length(rule_host) + length(rule_path) desc) = 1)
select page_id, host, path, rule, coalesce(v, 'allow') as verdict from parts left join best using (host, path)
"""


@query("op3_url_filters", URL_SQL)
def op3_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(URL_RULES, "rule_host string, rule_path string, verdict string")
    return url_rules.judge_urls(read(spark, sf_dir, "pages", "page_id", "url"), rules).drop("url")


_WORDS = "regexp_extract_all(" + _LOWER.format("coalesce(text, '')") + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION_SQL = f"""
with d as (select row_number() over () as r, doc_id, {_WORDS} as w from documents),
b as (select item_id, {_WORDS} as w from benchmark where text is not null),
items as (select item_id, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as p, w from b where len(w) > 0),
wins as (select distinct item_id, least(len(w), 10) as n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') as s from items),
sizes as (select distinct n from wins),
places as (select r, n, unnest(range(1, len(w) - n + 2)) as p, w from d join sizes on len(w) >= n),
hits as (select r, p, n, item_id from (select r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') as s from places) join wins using (n, s)),
words as (select r, count(distinct q) as n_hit from (select r, unnest(range(p, p + n)) as q from (select distinct r, p, n from hits)) group by r),
found as (select r, count(distinct item_id) as n_items, string_agg(distinct item_id::varchar, ',' order by item_id::varchar) as ids from hits group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
  sha256(coalesce(ids, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join words using (r) left join found using (r)
"""


@query("op9_benchmark_decontamination", DECONTAMINATION_SQL)
def op9_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contamination(
        read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "benchmark", "item_id", "text")
    )


@query("op2_quality_rules")
def op2_quality_rules(spark, sf_dir):
    return line_quality.judge_quality(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "quality"))


@query("op4_license_scans")
def op4_license_scans(spark, sf_dir):
    return license_scan.scan_licenses(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op7_best_fit_packing")
def op7_best_fit_packing(spark, sf_dir):
    return packing.pack_documents(read(spark, sf_dir, "documents", "doc_id", "text"), default_tokenizer())


@query("op8_token_ids")
def op8_token_ids(spark, sf_dir):
    folder = f"{checkpoint_root(spark)}/id-shards-{uuid4().hex}"
    return id_shards.read_shards(id_shards.write_shards(read(spark, sf_dir, "documents", "doc_id", "text"), folder, default_tokenizer()))


@query("op10_suffix_array_dedup")
def op10_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.repeated_bytes(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op1_minhash_near_dedup")
def op1_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_components(read(spark, sf_dir, "documents", "doc_id", "text"))


@query("op5_toxicity")
def op5_toxicity(spark, sf_dir):
    return toxicity.score_toxicity(read(spark, sf_dir, "documents", "doc_id", "text"), read(spark, sf_dir, "labels", "doc_id", "toxic"))


@query("op6_lm_scoring")
def op6_lm_scoring(spark, sf_dir):
    return suffix_tree_lm.score_documents(read(spark, sf_dir, "documents", "doc_id", "text"))


NEGATIVES_SQL = """
with v as (
  select row_number() over () as r, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings
  where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
a as (select r as ar, vec_id as anchor_id, label as al, q as aq from v where vec_id % 100 = 0),
s as (select ar, anchor_id, al, r, vec_id, label, list_dot_product(aq, q)::bigint as score from a, v),
p as (select ar, anchor_id, al, r as pr, vec_id as positive_id, score as positive_score from s where r <> ar and label = al
  qualify row_number() over (partition by ar order by score desc, vec_id) <= 5)
select anchor_id, positive_id, row_number() over w::int as rank, vec_id as negative_id, positive_score, score as negative_score
from p join s using (ar, anchor_id, al)
where label <> al and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
window w as (partition by ar, pr order by score desc, vec_id)
qualify row_number() over w <= 10
"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def op11_hard_negatives(spark, sf_dir):
    vectors = read(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(vectors.withColumns({"label": label, "is_anchor": F.col("vec_id") % 100 == 0}))


PHRASES_SQL = f"""
with p as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[.,;:!?\\x0A-\\x0D]')) as piece from documents),
w as (select lang, regexp_extract_all(piece, '[^\\x20\\x09]+') as w from p),
t as (select lang, sum(len(w))::bigint as n from w group by lang),
g as (select lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) as phrase from w, (values (1), (2), (3)) s(k) where len(w) >= k),
f as (select lang, k, phrase, count(*) as a from g group by all having count(*) >= 10),
c as (select f.*, string_split(phrase, ' ') as ws, unnest(range(1, k)) as cut from f where k > 1),
s as (select c.lang, c.phrase, c.k, c.a, cut, x.a as l, y.a as r, ((1000000::hugeint * c.a * c.a) // (x.a::hugeint * y.a))::bigint as score from c
  join f x on x.lang = c.lang and x.phrase = array_to_string(list_slice(ws, 1, cut), ' ')
  join f y on y.lang = c.lang and y.phrase = array_to_string(list_slice(ws, cut + 1, c.k), ' ')
  qualify row_number() over (partition by c.lang, c.phrase order by score, cut) = 1),
i as (select lang, sub, max(a) as around from (select lang, a, unnest([array_to_string(string_split(phrase, ' ')[1:2], ' '), array_to_string(string_split(phrase, ' ')[2:3], ' ')]) as sub from f where k = 3) group by all),
kept as (select s.* from s left join i on i.lang = s.lang and i.sub = s.phrase where around is null or 100 * around < 50 * a)
select lang, row_number() over o as rank, phrase, a, l, r, n, score from kept join t using (lang)
window o as (partition by lang order by score desc, a desc, phrase)
qualify row_number() over o <= 2000
"""


@query("op12_phrase_mining", PHRASES_SQL)
def op12_phrase_mining(spark, sf_dir):
    found = phrases.mine_phrases(read(spark, sf_dir, "documents", "doc_id", "text", "lang"))
    return found.withColumn("rank", F.col("rank").cast("bigint")).drop("first")


@query("op13_sentence_pieces")
def op13_sentence_pieces(spark, sf_dir):
    return sentence_pieces.encoding_digests(read(spark, sf_dir, "documents", "doc_id", "text"), piece_model())
