"""The registered queries of the corpus operators, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, hard_negatives, html_template, mixing, ngram_join, pii, piece_dropout, posting_lists, quality_classifier, quality_rules, secret_scan, sharding, token_files
from .common import new_folder, table

SHARD_BYTES = 1 << 20


def vocabulary(name: str) -> str:
    """Where a public vocabulary file is; the operators get it as a parameter."""
    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(table(spark, sf_dir, "documents"), SHARD_BYTES).select("doc_id", "bytes", "shard", "depth", "page", "shard_bytes", "shard_docs", "oversized")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return pii.digest(docs, pii.disclosing_terms(docs))


def op3_piece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_dropout.round_trip(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary("piece_bpe_32k.model"))


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "token-files")
    token_files.write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary("byte_bpe_50k.json"))
    return token_files.digest(spark, path)


def op5_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return posting_lists.search(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_classifier.quality_classifier(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "expected_grade", "p_tail", "keep")


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.quality_rules(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))[0].select("doc_id", "size", "source_size", "target", "taken", F.try_element_at("slots", F.lit(1)).alias("first_slot"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def op10_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.digest(secret_scan.secret_scan(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents").select("text", "lang"))


QUERIES = {f.__name__: f for f in (op1_sharding, op2_pii, op3_piece_dropout, op4_token_files, op5_posting_lists, op6_ngram_join, op7_quality_classifier, op8_quality_rules, op9_mixing, op10_html_template, op11_secret_scan, op12_hard_negatives, op13_collocations, pipeline)}

ORACLE_SQL = {
    "op1_sharding": f"""
with recursive a as (
  select doc_id, coalesce(octet_length(encode(text)), 0)::bigint as bytes,
         substr(md5(coalesce(doc_id::varchar, 'null')), 1, 8) || substr(md5(coalesce(text, '')), 1, 7) as hex from documents),
b as (select doc_id, bytes, list_aggregate(list_transform(string_split(hex, ''), lambda x: lpad(bin(instr('0123456789abcdef', x) - 1), 4, '0')), 'string_agg', '') as address from a),
d as (select unnest(range(0, 61)) as depth),
s as (select depth, substr(address, 1, depth) as shard, sum(bytes)::bigint as shard_bytes, count(*) as shard_docs from b, d group by all),
f as (select doc_id, bytes, address, min(depth) as depth from b, s where s.shard = substr(b.address, 1, s.depth) and shard_bytes <= {SHARD_BYTES} group by all)
select f.doc_id, f.bytes, s.shard, f.depth::int as depth, 0 as page, s.shard_bytes, s.shard_docs, false as oversized
from f join s on s.depth = f.depth and s.shard = substr(f.address, 1, f.depth)""",
    "op9_mixing": r"""
with a as (
  select doc_id, source, row_number() over () as rid, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))) as place from documents),
s as (select source, sum(size)::bigint as n from a group by 1),
w as (select *, 1 + (row_number() over (order by source is null, encode(source)) - 1) % 3 as weight from s),
o as (select *, row_number() over (order by 3.0 * n / weight, encode(source) nulls last) as k, (sum(n) over ())::bigint as total from w),
c as (select *, sum(3 * n) over (order by k) - 3 * n as capped, sum(weight) over () - sum(weight) over (order by k) + weight as free from o),
g as (select *, (total - capped)::bigint as left_words, (total - capped) * weight <= 3 * n * free as fits from c),
h as (select *, min(case when fits then k end) over () as first_free from g),
level as (select left_words, free from h where k = first_free),
t as (select source, n, case when first_free is null or k < first_free then (3 * n)::double else ((select left_words from level) * weight)::double / (select free from level)::double end as target from h),
p as (select a.*, t.n, t.target, sum(a.size) over (partition by a.source order by a.place, a.rid) - a.size as start from a join t on a.source is not distinct from t.source),
b as (select source, n, floor(target)::bigint as goal, case when n > 0 then (floor(target)::bigint // n) * ((n + 1023) // 1024) + (floor(target)::bigint % n + 1023) // 1024 else 0 end as slots from t),
q as (select *, sum(slots) over (order by source is null, encode(source)) - slots as seen, sum(slots) over () as needed from b),
i as (select source, n, goal, greatest(1, (n + 1023) // 1024) as blocks, (seen::hugeint * 281474976710656) // greatest(needed, 1) as low, ((seen + slots)::hugeint * 281474976710656) // greatest(needed, 1) as high from q),
points as (select slot, (slot::hugeint * 173961102589771) % 281474976710656 as point from (select unnest(range(0, (select max(3 * needed + 64)::bigint from q))) as slot)),
owned as (select i.*, slot, row_number() over (partition by source order by slot) - 1 as k from points join i on point >= low and point < high),
taking as (select source, slot, k % blocks as at, least(1024, n - (k % blocks) * 1024, goal - (k // blocks) * n - (k % blocks) * 1024) as words from owned),
firsts as (select p.rid, min(slot) as first_slot from p join taking x on x.source is not distinct from p.source and x.at = p.start // 1024 and x.words > p.start % 1024 where p.size > 0 group by 1)
select doc_id, size, n as source_size, target,
       (case when n = 0 then 0 else floor(target)::bigint // n * size + greatest(0, least(start + size, floor(target)::bigint % n) - start) end)::bigint as taken, first_slot
from p left join firsts using (rid)""",
    "op12_hard_negatives": """
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from embeddings where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
pairs as (select a.rid as anchor, a.vec_id as anchor_id, b.rid, b.vec_id, a.label = b.label as same, list_dot_product(a.q, b.q)::bigint as score from v a join v b on a.rid <> b.rid where a.vec_id % 100 = 0),
p as (select * from pairs where same qualify row_number() over (partition by anchor order by score desc, vec_id, rid) <= 5)
select p.anchor_id, p.vec_id as positive_id, (row_number() over (partition by p.anchor, p.rid order by n.score desc, n.vec_id, n.rid))::int as rank, n.vec_id as negative_id, p.score as positive_score, n.score as negative_score
from p join pairs n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and n.score <= p.score qualify rank <= 5""",
    "op13_collocations": r"""
with pieces as (
  select lang, row_number() over () as pid, piece from (
    select coalesce(lang, 'und') as lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) as piece from documents where text is not null)),
ws as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (select lang, w, m, unnest(range(1, len(w) - m + 2)) as i from ws, range(1, 6) as s(m) where len(w) >= m),
f as (select lang, m, array_to_string(w[i:i + m - 1], ' ') as phrase, count(*) as f from places group by all),
totals as (select lang, sum(f)::bigint as n from f where m = 1 group by 1),
c as (select lang, m, phrase, f as a, string_split(phrase, ' ') as w from f where m > 1 and f >= 100),
kept as (select * from c where not exists (select 1 from c q where q.lang = c.lang and q.m > c.m and 100 * q.a >= 100 * c.a and contains(' ' || q.phrase || ' ', ' ' || c.phrase || ' '))),
cuts as (select *, unnest(range(1, m)) as k from kept),
s as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, n, ((1000::hugeint * a * n) // (x.f::hugeint * y.f))::bigint as score
      from cuts c join f x on x.lang = c.lang and x.phrase = array_to_string(c.w[1:c.k], ' ') join f y on y.lang = c.lang and y.phrase = array_to_string(c.w[c.k + 1:], ' ') join totals t on t.lang = c.lang),
one as (select * from s qualify row_number() over (partition by lang, phrase order by score, k) = 1)
select lang, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank, phrase, a, l, r, n, score from one qualify rank <= 2000""",
}
