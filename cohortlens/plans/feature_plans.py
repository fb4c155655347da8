"""Registered queries of section 2.K and 2.H: features, splits, scalar functions."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ..functions.dist import norm_ppf
from ..operators import features as K
from .inference_plans import sql_norm_cdf
from .registry import CASES_SQL, cases, query, rounded, sql_bits

SPAN = repr(float(16**13))


def _u(seed, tag, idc):
    return f"({sql_bits(str(seed), repr(tag), idc)} / {SPAN})"


@query("column_kinds", "K1", """select 'p_size' as name, 'num' as kind union all select 'p_retailprice', 'num' union all
select 'p_name', case when (select max(contains(replace(p_name, ' ', '|'), '|')) from part) then 'lst' else 'str' end union all
select 'p_brand', case when (select max(contains(p_brand, '|')) from part) then 'lst' else 'str' end""")
def _(t):
    p = t("part").withColumn("p_name", F.replace("p_name", F.lit(" "), F.lit("|")))
    return K.column_kinds(p, ["p_size", "p_retailprice", "p_name", "p_brand"])


HOT_SQL = """tr as (select p_type as v, 'p_type' as name from part where p_size <= 25 and p_type <> 'PROMO' union all select p_brand, 'p_brand' from part where p_size <= 25 and p_type <> 'PROMO'),
te as (select p_type as v, 'p_type' as name from part where p_size > 25 or p_type = 'PROMO' union all select p_brand, 'p_brand' from part where p_size > 25 or p_type = 'PROMO'),
lv as (select name, v, count(*) as n from tr group by all)"""


def hot_tables(t):
    p = t("part").select("p_size", "p_type", "p_brand")
    train = (F.col("p_size") <= 25) & (F.col("p_type") != "PROMO")
    return p.filter(train), p.filter(~train)


def _hot_counts(df, cols):
    parts = [df.select(F.lit(c).alias("name"), F.posexplode(vector_to_array(f"{c}_vec")).alias("pos", "x")) for c in cols]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("name", "pos").agg(F.sum("x").alias("n"))


@query("one_hot_mode_drop", "K2", f"""with {HOT_SQL}, ix as (select name, v, row_number() over (partition by name order by n, v) - 1 as pos, count(*) over (partition by name) as k from lv)
select name, pos, cast((select count(*) from te where te.name = ix.name and te.v = ix.v) as double) as n from ix where pos < k - 1""")
def _(t):
    train, test = hot_tables(t)
    return rounded(_hot_counts(K.ModeDropEncoder(["p_type", "p_brand"]).fit(train).transform(test), ["p_type", "p_brand"]))


@query("one_hot_keep", "K3", f"""with {HOT_SQL}, ix as (select name, v, row_number() over (partition by name order by v) - 1 as pos from lv)
select name, pos, cast((select count(*) from te where te.name = ix.name and te.v = ix.v) as double) as n from ix""")
def _(t):
    train, test = hot_tables(t)
    return rounded(_hot_counts(K.one_hot_pipeline(["p_type", "p_brand"]).fit(train).transform(test), ["p_type", "p_brand"]))


LEVEL_SQL = """lo as (select cast(o_custkey as varchar) as o, cast(cast(o_orderdate as date) as varchar) as p, o_orderpriority as m, o_orderkey as id, o_orderkey % 4 as k from orders),
tr as (select * from lo where k > 0), un as (select 'o' as name, o as level from tr union all select 'p', p from tr union all select 'm', m from tr),
dc as (select name, level, count(*) as n, row_number() over (order by name, level) - 1 as pos from un where level is not null group by name, level)"""


def many_levels(t):
    """Customer, day and priority of orders as levels, each with an id of its own."""
    d = t("orders").select(F.col("o_custkey").cast("string").alias("o"), F.col("o_orderdate").cast("date").cast("string").alias("p"), F.col("o_orderpriority").alias("m"),
                           F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 4).alias("k"))
    return d.filter("k > 0"), d


@query("level_dictionary", "K2,K4", f"""with {LEVEL_SQL} select name, level, n, pos from dc""")
def _(t):
    return rounded(K.level_dictionary(many_levels(t)[0], ["o", "p", "m"]))


@query("level_dictionary_frequent", "K2,K3", f"""with {LEVEL_SQL}, f as (select *, row_number() over (partition by name order by n desc, level) as rk from dc)
select name, level, n, row_number() over (order by name, level) - 1 as pos from f where rk between 2 and 50""")
def _(t):
    """The 50 most frequent levels of each column without the most frequent one."""
    return rounded(K.level_dictionary(many_levels(t)[0], ["o", "p", "m"], 50, drop_mode=True))


@query("sparse_code", "K3,K4", f"""with {LEVEL_SQL}, c as (select id, pos from (select id, 'o' as name, o as level from lo union all select id, 'p', p from lo union all select id, 'm', m from lo) join dc using (name, level))
select lo.id, count(pos) as ones, cast(coalesce(sum(pos), 0) as bigint) as places, coalesce(string_agg(pos::varchar, ',' order by pos), '') as positions from lo left join c using (id) group by lo.id""")
def _(t):
    """One-hot columns of all levels, stored as the positions of the ones; some rows have customers that training lacks."""
    train, d = many_levels(t)
    out = K.sparse_code(d, "id", ["o", "p", "m"], K.level_dictionary(train, ["o", "p", "m"]))
    return rounded(out.select("id", F.size("positions").alias("ones"), F.aggregate("positions", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("places"), F.array_join("positions", ",").alias("positions")))


@query("dummy_code", "K4", """select o_orderkey, cast((o_orderstatus = 'O')::int as bigint) as o_orderstatus_O, cast((o_orderstatus = 'P')::int as bigint) as o_orderstatus_P from orders""")
def _(t):
    o = t("orders").select("o_orderkey", "o_orderstatus")
    return rounded(K.dummy_code(o, K.training_levels(o, ["o_orderstatus"]), True))


@query("standardise_scale", "K5", """with s as (select avg(c_acctbal) as m, stddev_samp(c_acctbal) as s, min(c_custkey) as a, max(c_custkey) as b from customer where c_nationkey < 20)
select c_custkey as id, round((c_acctbal - m) / s, 6) as bal, round((c_custkey - a) / (b - a)::double, 6) as scaled from customer, s""")
def _(t):
    c = t("customer").select(F.col("c_custkey").alias("id"), "c_nationkey", F.col("c_acctbal").alias("bal"), F.col("c_custkey").cast("double").alias("scaled"))
    train = c.filter("c_nationkey < 20")
    return rounded(K.min_max(K.standardise(c, train, ["bal"]), train, ["scaled"]).drop("c_nationkey"))


@query("discretise", "K6", """with e as (select quantile_cont(l_extendedprice, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as q from lineitem where l_tax < 0.05)
select 'q' || cast(len(list_filter(e.q, lambda x: x <= l_extendedprice)) + 1 as varchar) as l_extendedprice, cast(l_linenumber as varchar) as l_linenumber, count(*) as n from lineitem, e group by all""")
def _(t):
    li = t("lineitem").select("l_extendedprice", "l_linenumber", "l_tax")
    d = K.discretise(li, li.filter("l_tax < 0.05"), ["l_extendedprice", "l_linenumber"])
    return d.groupBy("l_extendedprice", "l_linenumber").agg(F.count(F.lit(1)).alias("n"))


@query("tokens", "K7", """with a as (select doc_id, lang, unnest(list_distinct(string_split(regexp_replace(lower(regexp_replace(text, '\\s+', '|', 'g')), '[^a-z\\s|]', '', 'g'), '|'))) as token from documents)
select lang, token, count(*) as n_docs from a group by all""")
def _(t):
    d = t("documents").select("doc_id", "lang", F.regexp_replace("text", r"\s+", "|").alias("text"))
    return K.tokens(d, ["doc_id", "lang"], "text").groupBy("lang", "token").agg(F.count(F.lit(1)).alias("n_docs"))


FOLD_SQL = f"""{CASES_SQL}, lb as (select caseid, yr, case when yr = 1997 and caseid % 7 = 0 then -1 else y end as y from cases),
us as (select yr, row_number() over (order by yr) as k from lb group by yr having min(y) >= 0)"""


@query("expanding_folds", "K8", f"""with {FOLD_SQL}, f as (select l.caseid, l.y, t.yr as fold, case when t.k = u.k then 'test' when t.k = u.k + 1 and t.k > 2 then 'valid' else 'train' end as role
  from lb l join us u on u.yr = l.yr join us t on t.k >= u.k and t.k >= 2)
select fold, role, count(*) as n, cast(sum(y) as bigint) as events, cast(sum(caseid) as bigint) as checksum from f group by all""")
def _(t):
    lb = cases(t).select("caseid", "yr", F.when((F.col("yr") == 1997) & (F.col("caseid") % 7 == 0), -1).otherwise(F.col("y")).alias("y"))
    return rounded(K.expanding_folds(lb, "yr", "y").groupBy("fold", "role").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"), F.sum("caseid").alias("checksum")))


@query("kfold", "K9", f"""with {CASES_SQL} select caseid, y, (row_number() over (partition by y order by {sql_bits('5', "'f'", 'caseid')}, caseid) - 1) % 5 as fold from cases""")
def _(t):
    return rounded(K.kfold(cases(t).select("caseid", "y"), 5, ["y"], "caseid", 5))


@query("holdout", "K10", f"""with {CASES_SQL} select caseid, cast(({_u(3, 'h', 'caseid')} < 0.1)::int as bigint) as is_test from cases""")
def _(t):
    return rounded(K.holdout(cases(t).select("caseid"), 0.1, "caseid", 3))


@query("sample_n", "K11", f"""with {CASES_SQL}, r as (select g, caseid, row_number() over (partition by g order by caseid) as rn, count(*) over (partition by g) as sz from cases),
d as (select g, {sql_bits('4', "'n'", 'g', 'i')} % max(sz) + 1 as rn from r cross join range(1, 301) as x(i) group by g, i)
select r.g, r.caseid, count(*) as weight from d join r using (g, rn) group by all""")
def _(t):
    return K.sample_n(cases(t).select("g", "caseid"), ["g"], 300, "caseid", 4)


@query("permute", "K12", f"""with {CASES_SQL}, a as (select caseid, score, row_number() over (order by caseid) as rn from cases), b as (select y, row_number() over (order by {sql_bits('6', "'m'", 'caseid')}, caseid) as rn from cases)
select caseid, y, score from a join b using (rn)""")
def _(t):
    return K.permute(cases(t).select("caseid", "y", "score"), "caseid", ["y"], 6)


@query("valid_holdout", "K13", f"""with a as (select o_orderkey as caseid, cast((o_totalprice > 495000)::int as bigint) as rare, cast((o_orderstatus = 'F')::int as bigint) as f from orders),
h as (select s, caseid, rare, f from a cross join range(1, 9) as r(s) where {_u('X', 'h', 'caseid').replace("':', X", "':', s")} < 0.1),
k as (select min(s) as seed from (select s from h group by s having max(rare) = 1 and max(f) = 1))
select caseid, rare, f, cast(seed as bigint) as seed, cast(({_u('X', 'h', 'caseid').replace("':', X", "':', seed")} < 0.1)::int as bigint) as is_test from a, k where seed is not null""")
def _(t):
    a = t("orders").select(F.col("o_orderkey").alias("caseid"), (F.col("o_totalprice") > 495000).cast("bigint").alias("rare"),
                           (F.col("o_orderstatus") == "F").cast("bigint").alias("f"))
    return rounded(K.valid_holdout(a, ["rare", "f"], 0.1, "caseid", list(range(1, 9))))


@query("name_similarity", "H1", """with n as (select distinct p_name as a from part), p as (select x.a as a, y.a as b, 1 - levenshtein(x.a, y.a)::double / greatest(length(x.a), length(y.a)) as ratio
from n x join n y on x.a < y.a) select a, b, round(ratio, 6) as ratio from p where ratio >= 0.6 - 1e-9""")
def _(t):
    from ..operators.match import similar_pairs
    return rounded(similar_pairs(t("part"), "p_name", 0.6))


@query("normal_distribution", "H2", f"""with z as (select c_custkey, (c_acctbal - 4500) / 2000 as x from customer) select c_custkey, round({sql_norm_cdf('x')}, 6) as p from z""")
def _(t):
    from ..functions.dist import norm_cdf
    return rounded(t("customer").select("c_custkey", norm_cdf((F.col("c_acctbal") - 4500) / 2000).alias("p")))


@query("normal_quantile_roundtrip", "H2", """select c_custkey, round((c_custkey + 1) / ((select count(*) from customer) + 2)::double, 6) as p from customer""")
def _(t):
    from ..functions.dist import norm_cdf
    n = t("customer").agg(F.count(F.lit(1))).scalar()
    p = (F.col("c_custkey") + 1) / (n + 2)
    d = t("customer").select("c_custkey", p.alias("p0"))
    return rounded(d.select("c_custkey", F.when(F.abs(norm_cdf(norm_ppf(F.col("p0"))) - F.col("p0")) < 1e-6, F.col("p0")).alias("p")))


@query("scalar_functions", "2.H", """select p_partkey, upper(left(trim(p_type), 1)) || lower(substr(trim(p_type), 2)) as title, round(log2(p_retailprice), 6) as lg2, round(log10(p_retailprice), 6) as lg10, round(ln(p_size + 1), 6) as ln,
 round(exp(-p_size / 10.0), 6) as ex, round(sqrt(p_retailprice), 6) as sq, round(1 / (1 + exp(-(p_size - 25) / 10.0)), 6) as sigmoid, round(sin(p_size), 6) as sn, cast(sign(p_size - 25) as double) as sg, round(pow(p_size, 1.5), 4) as pw from part""")
def _(t):
    from ..functions.text import log_odds, sigmoid
    x = (F.col("p_size") - 25) / 10.0
    p = sigmoid(x)
    return rounded(t("part").select(
        "p_partkey", F.initcap(F.trim("p_type")).alias("title"), F.log2("p_retailprice").alias("lg2"), F.log10("p_retailprice").alias("lg10"),
        F.ln(F.col("p_size") + 1).alias("ln"), F.exp(-F.col("p_size") / 10.0).alias("ex"), F.sqrt("p_retailprice").alias("sq"),
        F.when(F.abs(log_odds(p) - x) < 1e-9, p).alias("sigmoid"), F.sin("p_size").alias("sn"), F.signum(F.col("p_size") - 25.0).alias("sg"),
        F.pow("p_size", F.lit(1.5)).alias("pw")), pw=4)
