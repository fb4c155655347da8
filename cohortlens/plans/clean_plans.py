"""Registered queries of section 2.B: projections, filters, recodes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import clean as C, profile as P
from .registry import query, rounded

DIRTY_SQL = """dirty as (
  select o_orderkey as caseid, cast(year(o_orderdate) as bigint) as yr,
    case when o_totalprice > 450000 then -99 else o_totalprice end as price,
    case when o_custkey % 10 = 0 then -99 else o_custkey end as cust,
    case when o_orderstatus = 'P' then 'NULL ' || o_orderpriority else o_orderpriority end as prio,
    case when o_orderstatus = 'F' then '' when o_orderstatus = 'P' then 'NULL' else o_orderstatus end as stat,
    case when year(o_orderdate) <= 1996 then null else o_totalprice end as late,
    case when o_orderpriority = '5-LOW' then null else o_orderstatus end as part,
    case when o_totalprice < 0 then o_orderstatus end as never,
    'same' as fixed
  from orders)"""


def dirty(t):
    """Orders with sentinels, null texts and columns missing by period."""
    yr = F.year("o_orderdate").cast("bigint")
    return t("orders").select(
        F.col("o_orderkey").alias("caseid"), yr.alias("yr"),
        F.when(F.col("o_totalprice") > 450000, -99.0).otherwise(F.col("o_totalprice")).alias("price"),
        F.when(F.col("o_custkey") % 10 == 0, -99).otherwise(F.col("o_custkey")).alias("cust"),
        F.when(F.col("o_orderstatus") == "P", F.concat(F.lit("NULL "), "o_orderpriority")).otherwise(F.col("o_orderpriority")).alias("prio"),
        F.when(F.col("o_orderstatus") == "F", "").when(F.col("o_orderstatus") == "P", "NULL").otherwise(F.col("o_orderstatus")).alias("stat"),
        F.when(yr > 1996, F.col("o_totalprice")).alias("late"),
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderstatus")).alias("part"),
        F.when(F.col("o_totalprice") < 0, F.col("o_orderstatus")).alias("never"),
        F.lit("same").alias("fixed"))


LABELS_SQL = """lab as (
  select l_orderkey, cast(year(l_shipdate) as bigint) as yr, l_suppkey as g,
    cast(case when l_returnflag = 'R' then 1 else 0 end as bigint) as shallow,
    cast(case when l_linenumber = 7 then -1 when l_discount > 0.05 then 1 else 0 end as bigint) as deep,
    cast(case when l_linestatus = 'F' and l_tax > 0.06 then 1 else 0 end as bigint) as cavity1,
    cast(case when l_quantity > 48 then 1 else 0 end as bigint) as cavity2,
    cast(l_linenumber - 4 as bigint) as ncnt
  from lineitem)"""


def labels_of(t):
    return t("lineitem").select(
        "l_orderkey", F.year("l_shipdate").cast("bigint").alias("yr"), F.col("l_suppkey").alias("g"),
        (F.col("l_returnflag") == "R").cast("bigint").alias("shallow"),
        F.when(F.col("l_linenumber") == 7, -1).when(F.col("l_discount") > 0.05, 1).otherwise(0).cast("bigint").alias("deep"),
        ((F.col("l_linestatus") == "F") & (F.col("l_tax") > 0.06)).cast("bigint").alias("cavity1"),
        (F.col("l_quantity") > 48).cast("bigint").alias("cavity2"),
        (F.col("l_linenumber") - 4).cast("bigint").alias("ncnt"))


@query("null_sentinels", "B1", f"""with {DIRTY_SQL}
select caseid, round(nullif(price, -99), 6) as price, cast(nullif(cust, -99) as double) as cust from dirty""")
def _(t):
    return rounded(C.null_sentinels(dirty(t), [-99], ["price", "cust"]).select("caseid", "price", F.col("cust").cast("double").alias("cust")))


@query("null_strings", "B2", f"""with {DIRTY_SQL}
select caseid, case when not contains(lower(prio), 'null') then lower(prio) end as prio,
  case when lower(stat) not in ('', 'null', '-99') then lower(stat) end as stat from dirty""")
def _(t):
    d = dirty(t).select("caseid", "prio", "stat")
    return C.null_strings(C.null_strings(d, "contains", ["prio"]), "equals", ["stat"])


@query("recode_period_default", "B3", f"""with {DIRTY_SQL}
select caseid, case when yr = 1998 and part is null then 'no' when yr = 1998 then 'yes' when part is null then 'unknown' else part end as part,
  case when prio in ('1-URGENT', '2-HIGH') then 'high' else prio end as prio from dirty""")
def _(t):
    d = dirty(t).select("caseid", "yr", "part", "prio")
    late = F.col("yr") == 1998
    return C.recode(d, {"part": [(late & F.col("part").isNull(), "no"), (late, "yes"), (F.col("part").isNull(), "unknown")],
                        "prio": [(F.col("prio").isin("1-URGENT", "2-HIGH"), "high")]}).drop("yr")


@query("recode_regex", "B4", """select p_partkey, regexp_replace(regexp_replace(p_name, '^(small|large)\\s', '', 'g'), 'ring|widget', 'item', 'g') as p_name,
  regexp_replace(p_brand, '[^0-9]', '', 'g') as p_brand from part""")
def _(t):
    return C.recode_regex(t("part").select("p_partkey", "p_name", "p_brand"),
                          {"p_name": [(r"^(small|large)\s", ""), ("ring|widget", "item")], "p_brand": [("[^0-9]", "")]})


@query("page_recode", "B4", """select page_id, regexp_replace(regexp_replace(lower(url), '^https?://', ''), '[?#].*$', '') as place from pages""")
def _(t):
    p = t("pages").select("page_id", F.lower("url").alias("place"))
    return C.recode_regex(p, {"place": [("^https?://", ""), ("[?#].*$", "")]})


@query("map_values", "B5", """select c_custkey, c_nationkey::bigint as c_nationkey, n_name as nation from customer left join nation on n_nationkey = c_nationkey and n_regionkey < 4""")
def _(t):
    return rounded(C.map_values(t("customer").select("c_custkey", "c_nationkey"), "c_nationkey",
                                t("nation").filter("n_regionkey < 4"), "n_nationkey", "n_name", "nation")
                   .select("c_custkey", "c_nationkey", "nation"))


@query("binarise_minority", "B6", f"""with {DIRTY_SQL},
r as (select 'part' as name, part as level, count(*) as n from dirty where part is not null group by all
  union all select 'stat', stat, count(*) from dirty group by all),
m as (select name, level from r qualify row_number() over (partition by name order by n, level) = 1)
select caseid, cast(case when part is null then -1 when part = (select level from m where name = 'part') then 1 else 0 end as bigint) as part,
  cast(case when stat = (select level from m where name = 'stat') then 1 else 0 end as bigint) as stat from dirty""")
def _(t):
    return rounded(C.binarise_minority(dirty(t).select("caseid", "part", "stat"), ["part", "stat"]))


@query("composite_labels", "B7", f"""with {LABELS_SQL}
select g, yr, cast(sum(case when shallow = 1 or deep = 1 then 1 else 0 end) as bigint) as agg_wound1,
  cast(sum(case when shallow = 1 or cavity1 = 1 or cavity2 = 1 then 1 else 0 end) as bigint) as agg_wound2,
  cast(sum(case when deep = -1 then 1 else 0 end) as bigint) as agg_wound1_any_missing from lab group by g, yr""")
def _(t):
    d = C.composite(labels_of(t), {"agg_wound1": ["shallow", "deep"], "agg_wound2": ["shallow", "cavity1", "cavity2"]}, True)
    return d.groupBy("g", "yr").agg(*[F.sum(c).alias(c) for c in ("agg_wound1", "agg_wound2", "agg_wound1_any_missing")])


@query("any_positive", "B8", f"""with {LABELS_SQL}
select yr, cast(sum(case when cavity1 + cavity2 > 0 then 1 else 0 end) as bigint) as cavity from lab group by yr""")
def _(t):
    return C.any_positive(labels_of(t), "cavity", "cavity").groupBy("yr").agg(F.sum("cavity").alias("cavity"))


@query("count_to_any", "B9", f"""with {LABELS_SQL}
select yr, cast(sum(case when ncnt > 0 then 1 else 0 end) as bigint) as any_cnt,
  cast(sum(least(shallow + cavity1 + cavity2, 1)) as bigint) as clipped from lab group by yr""")
def _(t):
    d = C.clip_sum(C.to_any(labels_of(t), ["ncnt"]), ["shallow", "cavity1", "cavity2"], "clipped")
    return d.groupBy("yr").agg(F.sum("ncnt").cast("bigint").alias("any_cnt"), F.sum("clipped").alias("clipped"))


@query("split_version", "B10", """with a as (select p_partkey, 'agg_' || p_type || case when p_size > 10 then cast(p_size % 7 + 1 as varchar) else '' end as code from part)
select p_partkey, code, regexp_replace(regexp_replace(code, '^agg_', ''), '[0-9]', '', 'g') as outcome,
  coalesce(try_cast(regexp_replace(code, '[^0-9]', '', 'g') as bigint), 1) as version from a""")
def _(t):
    a = t("part").select("p_partkey", F.concat(F.lit("agg_"), "p_type", F.when(
        F.col("p_size") > 10, (F.col("p_size") % 7 + 1).cast("string")).otherwise("")).alias("code"))
    return rounded(C.split_version(a, "code"))


@query("drop_sparse", "B11", f"""with {DIRTY_SQL},
pr as (select yr, avg(case when late is null then 1.0 else 0 end) as late, avg(case when part is null then 1.0 else 0 end) as part,
  avg(case when never is null then 1.0 else 0 end) as never from dirty group by yr),
k as (select sum((late > 0)::int) <= 2 and min(late) < 1 as late, sum((part > 0)::int) <= 2 and min(part) < 1 as part,
  sum((never > 0)::int) <= 2 and min(never) < 1 as never from pr)
select caseid, yr, round(d.price, 6) as price, d.cust, d.prio, d.stat, round(d.late, 6) as late, d.fixed from dirty d, k
where k.late and not k.part and not k.never""")
def _(t):
    return rounded(C.drop_sparse(dirty(t), "yr", 2))


@query("drop_rare_labels", "B12", """with a as (select o_orderkey, case when o_totalprice > 1e9 then 1 else 0 end as rare,
  cast(case when o_orderstatus = 'F' then 1 else 0 end as bigint) as common from orders)
select o_orderkey, common from a where (select sum(rare) from a) < 100 and (select sum(common) from a) >= 100""")
def _(t):
    a = t("orders").select("o_orderkey", (F.col("o_totalprice") > 1e9).cast("bigint").alias("rare"),
                           (F.col("o_orderstatus") == "F").cast("bigint").alias("common"))
    return C.drop_rare_labels(a, ["rare", "common"], 100)


@query("drop_constant", "B13", f"""with {DIRTY_SQL} select caseid, yr, prio from dirty where (select min(fixed) = max(fixed) from dirty)""")
def _(t):
    return C.drop_constant(dirty(t).select("caseid", "yr", "prio", "fixed"))


@query("profile_buckets", "B14", f"""with {DIRTY_SQL},
pr as (select 'late' as name, yr, avg(case when late is null then 1.0::double else 0 end) as share, count(*) as n from dirty group by yr
 union all select 'part', yr, avg(case when part is null then 1.0::double else 0 end), count(*) from dirty group by yr
 union all select 'never', yr, avg(case when never is null then 1.0::double else 0 end), count(*) from dirty group by yr
 union all select 'price', yr, avg(case when price is null then 1.0::double else 0 end), count(*) from dirty group by yr),
a as (select name, sum(share * n) / sum(n) as mu, max(share) - min(share) as delta from pr group by name)
select name, round(mu, 6) as mu, round(delta, 6) as delta,
 case when mu = 0 then 'complete' when mu = 1 then 'absent' when delta > 0.2 then 'swing' when mu < 0.4 then 'low' else 'high' end as bucket from a""")
def _(t):
    d = dirty(t)
    profile = P.missing_profile(d, "yr", ["late", "part", "never", "price"])
    return rounded(C.profile_buckets(profile, d.groupBy(F.col("yr").alias("period")).agg(F.count(F.lit(1)).alias("n"))))


@query("unit_conversion", "B15", """select o_orderkey, cast(round((o_totalprice / 5000) * 365.25) as bigint) as age_days,
  cast(date_diff('day', date '1995-01-01', cast(o_orderdate as date)) as bigint) as htooday, round(o_totalprice / 2.54, 1) as height, round(o_totalprice * 2.20462, 1) as weight from orders""")
def _(t):
    return rounded(t("orders").select(
        "o_orderkey", C.years_to_days(F.col("o_totalprice") / 5000).alias("age_days"),
        F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")).alias("htooday"),
        C.cm_to_inch(F.col("o_totalprice")).alias("height"), C.kg_to_lb(F.col("o_totalprice")).alias("weight")), 1)


@query("code_typing", "B16", """select p_partkey, 'c' || cast(10000 + p_partkey as varchar) as code, substr(cast(10000 + p_partkey as varchar), 1, 3) as prefix from part""")
def _(t):
    c = F.col("p_partkey") + 10000
    return t("part").select("p_partkey", C.code_key(c).alias("code"), C.code_prefix(c).alias("prefix"))


@query("clip_bounds", "B17", """select c_custkey, round(greatest(least(c_acctbal, 5000.0), 0.0), 6) as bal from customer""")
def _(t):
    return rounded(t("customer").select("c_custkey", C.clip(F.col("c_acctbal"), 0.0, 5000.0).alias("bal")))


@query("split_columns", "B18", """select o_orderkey, split_part(o_orderpriority, '-', 1) as lvl, split_part(o_orderpriority, '-', 2) as lbl from orders""")
def _(t):
    return C.split_cols(t("orders").select("o_orderkey", "o_orderpriority"), "o_orderpriority", "-", ["lvl", "lbl"], 2).drop("o_orderpriority")


@query("predicate_filter", "B19", """select o_orderkey, o_orderstatus from orders where o_totalprice >= 100000 and o_orderstatus in ('F', 'O')
 and o_orderpriority is not null and (contains(o_orderpriority, 'HIGH') or not regexp_matches(o_orderpriority, '^[45]'))""")
def _(t):
    return (t("orders").filter((F.col("o_totalprice") >= 100000) & F.col("o_orderstatus").isin("F", "O")
                               & F.col("o_orderpriority").isNotNull()
                               & (F.col("o_orderpriority").contains("HIGH") | ~F.col("o_orderpriority").rlike("^[45]")))
            .select("o_orderkey", "o_orderstatus"))


@query("pick_columns", "B20", """select p_partkey, p_name, p_type from part""")
def _(t):
    return C.pick(t("part"), "^p_(partkey|name|type|size)$", ["p_size"])


@query("override_values", "B21", """select c_custkey, coalesce(s_name, c_name) as c_name from customer left join supplier on s_suppkey = c_custkey""")
def _(t):
    patch = t("supplier").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_name").alias("c_name"))
    return C.override(t("customer").select("c_custkey", "c_name"), patch, "c_custkey", "c_name")
