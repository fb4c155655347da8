"""Registered queries over the given tables: name -> (spark, sf_dir) -> DataFrame, and the SQL of those that SQL can say."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op6_token_counts")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), keep=["doc_id"])


@query("op9_near_dedup", """
with recursive w as (select doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w from documents),
l as (select doc_id, list_distinct(case when len(w) > 1 then list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) else w end) as s from w),
g as (select doc_id, unnest(s) as s, len(s) as n from l),
p as (select a.doc_id as a, b.doc_id as b from g a join g b on a.s = b.s and a.doc_id < b.doc_id group by a.doc_id, b.doc_id having 100 * count(*) >= 80 * (max(a.n) + max(b.n) - count(*))),
e as (select a, b from p union select b, a from p),
reach(id, r) as (select doc_id, doc_id from l union select reach.id, e.b from reach join e on reach.r = e.a),
c as (select id, min(r) as component_id from reach group by id)
select doc_id, cast(len(s) as bigint) as n_shingles, component_id, doc_id = component_id as kept from l join c on doc_id = id""")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dedup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"), n=2, threshold=80)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), capacity=2048)


@query("op4_language_id")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .language_id import identify

    return identify(table(spark, sf_dir, "documents"))


def _quality_sql() -> str:
    from .quality_rules import DESIGN, RULES

    # steps of a rule run from its laxest cutoff
    steps = {r: sorted(cuts, reverse=side == "above") for r, (_, _, side, cuts) in RULES.items()}
    wide = max(map(len, steps.values())) + 1
    first = ", ".join(f"nullif(coalesce(list_position(list_transform([{', '.join(map(str, steps[r]))}], lambda c: {num} * 1000 {'>' if side == 'above' else '<'} c * {den}), true), 0), 0)"
                      for r, (num, den, side, _) in RULES.items())
    tail = "list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln(0.02) + (n - j) * ln(1 - 0.02))))"
    member = f"list_min(list_transform(list_zip(o, range(0, len(o))), lambda x: case when steps[x[1].rule] <= x[1].best then x[2] * {wide} + steps[x[1].rule] end))"
    return f"""
with t as (select row_number() over () as r, doc_id, lang, coalesce(text, '') as text from documents),
w as (select *, list_filter(regexp_split_to_array(text, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') as w,
        list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as l from t),
win as (select r, i, count(*) over (partition by r, g) as n from (select r, unnest(range(1, len(w) - 1)) as i, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i:i + 2])) as g from w)),
rep as (select r, count(distinct i + j) as n from win cross join range(3) as q(j) where n > 1 group by r),
m as (select w.r, doc_id, lang, cast(len(w) as bigint) as n_words, cast(length(array_to_string(w, '')) as bigint) as word_chars,
        cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) as n_symbols, cast(len(l) as bigint) as n_lines,
        cast(len(l) - len(list_distinct(l)) as bigint) as n_dup_lines, cast(coalesce(rep.n, 0) as bigint) as n_repeat_words from w left join rep using (r)),
b as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, [{first}] as steps from m),
lab as (select doc_id, max(quality) > 0 as good from labels where quality is not null and doc_id is not null group by doc_id),
held as (select lang, steps, case when not good then 'bad' when cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 13) as bigint) % {DESIGN} = 0 then 'design' else 'test' end as part
         from b join lab using (doc_id) where not base_failed),
size as (select lang, count(*) filter (part = 'bad') as m, count(*) filter (part = 'design') as nd, count(*) filter (part = 'test') as n from held group by lang),
step as (select unnest([{', '.join(f'[{i}, {s}]' for i, r in enumerate(RULES, 1) for s in range(1, len(steps[r]) + 1))}]) as rs),
hit as (select lang, rs[1] as rule, rs[2] as s, count(*) filter (part = 'bad') as b, count(*) filter (part = 'design') as d from held join step on steps[rs[1]] <= rs[2] group by all),
best as (select hit.lang, rule, s as best, round(coalesce(b / nullif(m, 0)::double, 0) - 20 * d / greatest(nd, 1)::double, 9) as gap from hit join size on hit.lang is not distinct from size.lang
         where gap > 0 qualify row_number() over (partition by hit.lang, rule order by gap desc, s) = 1),
fam as (select lang, list({{'rule': rule, 'best': best}} order by gap desc, rule) as o from best group by lang),
cnt as (select held.lang, {member} as mem, count(*) filter (part = 'bad') as b, count(*) filter (part = 'test') as k from held join fam on held.lang is not distinct from fam.lang group by all having mem is not null),
tried as (select cnt.lang, mem, m, n, cast(sum(b) over w as bigint) as kb, cast(sum(k) over w as bigint) as k from cnt join size on cnt.lang is not distinct from size.lang window w as (partition by cnt.lang order by mem)),
taken as (select lang, mem as most, coalesce(kb / nullif(m, 0)::double, 0) - 20 * k / greatest(n, 1)::double as gain from tried
          where n > 0 and k < n * 0.02 and {tail} <= 0.05 / (select greatest(1, count(*)) from size) and gain > 0 qualify row_number() over (partition by lang order by round(gain, 9) desc, mem) = 1),
gone as (select b.r from b join fam on b.lang is not distinct from fam.lang join taken on b.lang is not distinct from taken.lang where {member} <= most)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, base_failed, not base_failed and gone.r is null as kept from b left join gone using (r)"""


@query("op7_quality_rules", _quality_sql())
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), nested=True).drop("rejected_by")


@query("op2_license_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .license_scan import license_scan

    return license_scan(table(spark, sf_dir, "documents")).drop("expressions", "spans")


@query("op1_warc", """
with p as (select page_id, coalesce(html, '') as html from pages),
h as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha1(html) as x from p),
d as (select page_id, payload_bytes,
        list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + cast(
          (cast('0x' || substr(x, cast(5 * (i // 4) + 1 as int), 5) as bigint) // (32 ** (3 - i % 4))::bigint) % 32 as int), 1)), 'string_agg', '') as payload_digest
      from h),
f as (select *, min(page_id) over (partition by payload_digest, payload_bytes) as first from d)
select page_id, payload_bytes, payload_digest, case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to
from f""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_round_trip

    return archive_round_trip(table(spark, sf_dir, "pages")).drop("url")


@query("op5_top_k", """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(1024 * cast(x as double)) as bigint)) as v from embeddings
           where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id as vec_id, cast(list_sum(list_transform(list_zip(q.v, d.v), lambda p: p[1] * p[2])) as bigint) as score
      from v q join v d on q.vec_id <> d.vec_id where q.vec_id % 100 = 0),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 10""")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .topk_join import top_k

    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 100 = 0"), k=10)


@query("op3_sentencepiece")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pieces import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op8_lm_scores")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import scores

    return scores(table(spark, sf_dir, "documents"), order=5)


@query("op12_merkle_manifest", """
with recursive d as (select doc_id, coalesce('1' || source, '0') as k, cast(source as varchar) as source, cast(lang as varchar) as lang, n_chars, text,
  translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as low,
  list_reduce([cast(ascii(c) as bigint) for c in string_split(cast(doc_id as varchar), '')], lambda crc, c:
    list_reduce(range(8), lambda x, j: xor(x >> 1, 3988292384 * (x & 1)), xor(crc, c)), 4294967295::bigint) as crc from documents),
f as (select doc_id, k, crc, coalesce(octet_length(encode(cast(doc_id as varchar))) || ':' || doc_id, '-') || coalesce(octet_length(encode(source)) || ':' || source, '-')
  || coalesce(octet_length(encode(lang)) || ':' || lang, '-') || coalesce(octet_length(encode(cast(n_chars as varchar))) || ':' || n_chars, '-') as head,
  coalesce(octet_length(encode(text)) || ':' || text, '-') as body, coalesce(octet_length(encode(low)) || ':' || low, '-') as low from d),
l as (select doc_id, k, sha256(head || body) as leaf, case when xor(crc, 4294967295) % 5 = 0 then sha256(head || low) else sha256(head || body) end as used from f),
r as (select *, row_number() over (order by k) as rid, row_number() over (partition by k order by doc_id nulls first, leaf) - 1 as i, count(*) over (partition by k) as n from l),
nodes as (select k, 0 as lvl, i, n, leaf as h from r
  union all select k, lvl + 1, i // 16, max((n + 15) // 16), sha256(string_agg(h, '' order by i)) from nodes where n > 1 group by k, lvl, i // 16),
s as (select k, h as subroot, row_number() over (order by k) - 1 as i, count(*) over () as n from nodes where n = 1),
tops as (select 0 as lvl, i, n, subroot as h from s
  union all select lvl + 1, i // 16, max((n + 15) // 16), sha256(string_agg(h, '' order by i)) from tops where n > 1 group by lvl, i // 16),
runs as (select k, lvl, i // 16 as p, list(h order by i) as hs from nodes where n > 1 group by all
  union all select null, lvl, i // 16, list(h order by i) from tops where n > 1 group by all),
low as (select rid, k, 0 as lvl, i, n, '' as proof, used as h from r
  union all select rid, low.k, low.lvl + 1, i // 16, (n + 15) // 16,
    proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], ''), sha256(array_to_string(hs[1:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], ''))
  from low join runs on runs.k = low.k and runs.lvl = low.lvl and p = i // 16 where n > 1),
high as (select rid, subroot, 0 as lvl, s.i, s.n, proof, low.h from low join s using (k) where low.n = 1
  union all select rid, subroot, high.lvl + 1, i // 16, (n + 15) // 16,
    proof || array_to_string(hs[1:i % 16], '') || array_to_string(hs[i % 16 + 2:], ''), sha256(array_to_string(hs[1:i % 16], '') || h || array_to_string(hs[i % 16 + 2:], ''))
  from high join runs on runs.k is null and runs.lvl = high.lvl and p = i // 16 where n > 1),
root as (select h as root from tops where n = 1)
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, high.h as folded_root, high.h = root as verified from r join high using (rid) cross join root where high.n = 1""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import manifest, verified

    return verified(manifest(table(spark, sf_dir, "documents")))


@query("op11_token_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .alignment import align

    return align(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), tokenizer("piece_bpe_32k.model"))


@query("op13_neighbours")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .neighbours import neighbours

    vectors = table(spark, sf_dir, "embeddings")
    return neighbours(vectors, vectors.where("vec_id % 20 = 0"), k=20)
