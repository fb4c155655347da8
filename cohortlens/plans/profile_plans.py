"""Registered queries of section 2.D: aggregations and reshaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ordered as O, profile as P, thresholds as T
from .clean_plans import DIRTY_SQL, LABELS_SQL, dirty, labels_of
from .registry import CASES_SQL, SCORED_SQL, cases, query, rounded, scored


@query("group_summary", "D1,D2", f"""with {SCORED_SQL}
select yr, g, count(*) as n, cast(sum(y) as bigint) as events, round(avg(score), 4) as mean, round(min(score), 4) as lo, round(max(score), 4) as hi,
  round(stddev_samp(score), 4) as sd, round(var_samp(score) / 7e5, 4) as var_m from scored group by yr, g""")
def _(t):
    return rounded(P.summarise(scored(t), ["yr", "g"], {
        "n": F.count(F.lit(1)), "events": F.sum("y"), "mean": F.avg("score"), "lo": F.min("score"), "hi": F.max("score"),
        "sd": F.stddev_samp("score"), "var_m": F.var_samp("score") / 7e5}), 4)


@query("weighted_mean", "D3", """select l_returnflag, round(sum(l_discount * l_quantity) / sum(l_quantity), 6) as wm from lineitem group by 1""")
def _(t):
    return rounded(P.summarise(t("lineitem"), ["l_returnflag"], {"wm": P.weighted_mean("l_discount", "l_quantity")}))


MISS_SQL = f"""{DIRTY_SQL}, nd as (select yr as period, nullif(price, -99) as price, nullif(cust, -99) as cust, late, part, never from dirty),
pr as (select 'price' as name, period, avg(case when price is null then 1.0::double else 0 end) as share, count(*) as n from nd group by period
 union all select 'cust', period, avg(case when cust is null then 1.0::double else 0 end), count(*) from nd group by period
 union all select 'late', period, avg(case when late is null then 1.0::double else 0 end), count(*) from nd group by period
 union all select 'part', period, avg(case when part is null then 1.0::double else 0 end), count(*) from nd group by period
 union all select 'never', period, avg(case when never is null then 1.0::double else 0 end), count(*) from nd group by period)"""
MISS_COLS = ["price", "cust", "late", "part", "never"]


def no_sentinels(t):
    from ..operators.clean import null_sentinels
    return null_sentinels(dirty(t), [-99], ["price", "cust"])


@query("missing_profile", "D4", f"""with {MISS_SQL} select name, period, round(share, 6) as share from pr""")
def _(t):
    return rounded(P.missing_profile(no_sentinels(t), "yr", MISS_COLS))


@query("missing_overall", "D4", f"""with {MISS_SQL} select name, round(sum(share * n) / sum(n), 6) as share from pr group by name""")
def _(t):
    d = no_sentinels(t)
    sizes = d.groupBy(F.col("yr").alias("period")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(P.missing_overall(P.missing_profile(d, "yr", MISS_COLS), sizes))


@query("missing_swing", "D5", f"""with {MISS_SQL} select name, round(max(share) - min(share), 6) as swing from pr group by name""")
def _(t):
    return rounded(P.missing_swing(P.missing_profile(no_sentinels(t), "yr", MISS_COLS)))


@query("column_stats", "D6", f"""with {MISS_SQL}
select 'cust' as name, count(distinct cust) as n_distinct, count(*) - count(cust) as n_missing from nd
union all select 'part', count(distinct part), count(*) - count(part) from nd
union all select 'late', count(distinct late), count(*) - count(late) from nd
union all select 'never', count(distinct never), count(*) - count(never) from nd""")
def _(t):
    return P.column_stats(no_sentinels(t), ["cust", "part", "late", "never"])


@query("crosstab", "D7", """select o_orderpriority, round(avg((o_orderstatus = 'F')::int), 6) as F, round(avg((o_orderstatus = 'O')::int), 6) as O, round(avg((o_orderstatus = 'P')::int), 6) as P from orders group by 1""")
def _(t):
    return rounded(P.crosstab(t("orders"), "o_orderpriority", "o_orderstatus", ["F", "O", "P"]))


@query("pivot_wide", "D8", f"""with {CASES_SQL} select g, """ + ", ".join(
    f'cast(coalesce(sum(case when yr = {y} then y end), 0) as bigint) as "{y}"' for y in range(1995, 2002)) + " from cases group by g")
def _(t):
    return P.wide(cases(t), ["g"], "yr", list(range(1995, 2002)), F.sum("y"))


@query("unpivot_long", "D9", """select l_returnflag, name, round(sum(value), 4) as total from (
  select l_returnflag, 'l_quantity' as name, l_quantity as value from lineitem union all select l_returnflag, 'l_tax', l_tax from lineitem
  union all select l_returnflag, 'l_discount', l_discount from lineitem) group by all""")
def _(t):
    d = P.long(t("lineitem"), ["l_returnflag"], ["l_quantity", "l_tax", "l_discount"])
    return rounded(d.groupBy("l_returnflag", "name").agg(F.sum("value").alias("total")), 4)


@query("level_share", "D10", f"""with {CASES_SQL} select yr, st, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by yr), 6) as share from cases group by yr, st""")
def _(t):
    return rounded(P.level_share(cases(t), ["yr"], "st"))


@query("mode_of", "D11", f"""with {DIRTY_SQL}, l as (select 'part' as name, part as value from dirty where part is not null union all select 'prio', prio from dirty
  union all select 'cust', cast(cust as varchar) from dirty), c as (select name, value, count(*) as n from l group by all)
select name, value as mode, n from c qualify row_number() over (partition by name order by n desc, value) = 1""")
def _(t):
    return P.mode_of(dirty(t), ["part", "prio", "cust"])


@query("group_quantiles", "D12", f"""with {SCORED_SQL} select g, unnest([0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0]) as p,
  round(unnest(quantile_cont(score, [0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0])), 4) as q from scored group by g""")
def _(t):
    return rounded(O.exact_quantiles(scored(t), ["g"], "score", [0.0, 0.025, 0.25, 0.5, 0.9, 0.975, 1.0]), 4)


@query("event_rate", "D13", f"""with {LABELS_SQL} select g, round(avg(cast(deep as double)), 6) as rate, count(*) as n from lab where deep in (0, 1) group by g""")
def _(t):
    return rounded(P.event_rate(labels_of(t), ["g"], "deep"))


@query("event_counts", "D14", f"""with {LABELS_SQL}
select g, yr, 'shallow' as label, cast(sum((shallow = 1)::int) as bigint) as events from lab group by all
union all select g, yr, 'deep', cast(sum((deep = 1)::int) as bigint) from lab group by all
union all select g, yr, 'cavity1', cast(sum((cavity1 = 1)::int) as bigint) from lab group by all""")
def _(t):
    return P.event_counts(labels_of(t), ["g", "yr"], ["shallow", "deep", "cavity1"])


@query("frequent_groups", "D15", """select l_suppkey, count(*) as n from lineitem group by 1 having count(*) > 590""")
def _(t):
    return P.frequent(t("lineitem"), "l_suppkey", 590)


@query("share_with_event", "D16", f"""with {LABELS_SQL}, p as (select yr, g, max((cavity1 = 1 and cavity2 = 1)::int) as a from lab group by all)
select yr, round(avg(cast(a as double)), 6) as share, count(*) as groups from p group by yr""")
def _(t):
    d = labels_of(t).withColumn("y", F.col("cavity1") * F.col("cavity2"))
    return rounded(P.share_with_event(d, ["yr"], "g"))


@query("label_patterns", "D17", f"""with {LABELS_SQL} select shallow, deep, cavity1, cavity2, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (), 6) as share from lab group by all""")
def _(t):
    return rounded(P.label_patterns(labels_of(t), ["shallow", "deep", "cavity1", "cavity2"]))


@query("uniqueness", "D18", """with j as (select p_brand, p_name, count(*) as n_ab from part group by all)
select p_brand, p_name, n_ab, cast(sum(n_ab) over (partition by p_name) as bigint) as n_b, cast(case when n_ab = sum(n_ab) over (partition by p_name) then 1 else 0 end as bigint) as is_unique from j""")
def _(t):
    return rounded(P.uniqueness(t("part"), "p_brand", "p_name"))


@query("column_presence", "D19", """with c as (select 'orders' as tb, column_name as c from information_schema.columns where table_name = 'orders'
  union all select 'labels', column_name from information_schema.columns where table_name = 'labels' union all select 'documents', column_name from information_schema.columns where table_name = 'documents'),
s as (select replace(c, 'o_', '') as column, tb from c)
select "column", cast(count(distinct tb) as bigint) as n_extracts,
  max((tb = 'documents')::int)::varchar || max((tb = 'labels')::int)::varchar || max((tb = 'orders')::int)::varchar as pattern from s group by 1""")
def _(t):
    o = t("orders")
    return rounded(P.column_presence({"orders": o.toDF(*[c.replace("o_", "") for c in o.columns]),
                                      "labels": t("labels"), "documents": t("documents")}))


@query("share_variance", "D20", f"""with {CASES_SQL}, s as (select yr, g, cast(count(*) as double) / sum(count(*)) over (partition by yr) as share from cases group by yr, g)
select g, round(var_samp(share) * 1e4, 6) as var_share, round(avg(share), 6) as mean_share from s group by g""")
def _(t):
    d = P.share_variance(cases(t), "yr", "g")
    return rounded(d.withColumn("var_share", F.col("var_share") * 1e4))


ANOVA_SQL = f"""{SCORED_SQL}, v as (select cast(yr as varchar) as vv, g, score / 1000 as val from scored),
c as (select vv, g, avg(val) as xbar, count(*) as n, var_pop(val) * count(*) as ssw from v group by all), m as (select vv, avg(val) as mu from v group by vv),
r as (select c.vv, sum(ssw) as ss_w, sum(c.n * (xbar - mu) * (xbar - mu)) as ss_b, cast(sum(n) as bigint) as n, count(*) as k from c join m on m.vv = c.vv group by c.vv)"""


@query("anova_f", "D21", f"""with {ANOVA_SQL} select vv, round(ss_w, 3) as ss_w, round(ss_b, 3) as ss_b, n, k, k - 1 as dof_b, n - k as dof_w,
  round((ss_b / (k - 1)) / (ss_w / (n - k)), 3) as f_stat from r""")
def _(t):
    v = scored(t).select(F.col("yr").cast("string").alias("vv"), "g", (F.col("score") / 1000).alias("val"))
    return rounded(P.anova(v, ["vv"], "g", "val", with_p=False), 3)


@query("anova_pvalue", "D21")
def _(t):
    v = scored(t).select(F.col("yr").cast("string").alias("vv"), "g", (F.col("score") / 1000).alias("val"))
    return rounded(P.anova(v, ["vv"], "g", "val").select("vv", "f_stat", "pval"))


@query("correlate", "D22", """select l_returnflag, round(corr(l_quantity, l_extendedprice), 6) as rho from lineitem group by 1""")
def _(t):
    return rounded(P.correlate(t("lineitem"), ["l_returnflag"], "l_quantity", "l_extendedprice"))


@query("spread_summary", "D23", f"""with {CASES_SQL}, a as (select g, quantile_cont(score, 0.25) as q25, avg(score) as mean, quantile_cont(score, 0.75) as q75 from cases group by g)
select g, 'q25' as stat, round(q25, 3) as value from a union all select g, 'mean', round(mean, 3) from a union all select g, 'q75', round(q75, 3) from a""")
def _(t):
    return rounded(P.spread_summary(cases(t), ["g"], "score"), 3)


@query("counts_above", "D24", f"""with {CASES_SQL}, r as (select o_custkey, st, avg(cast(y as double)) as v, count(distinct yr) as ny from cases group by all), k as (select unnest([1.0, 2, 3, 4, 5, 6]) as cut)
select st, cast(cut as double) as cut, cast(sum((ny >= cut)::int) as bigint) as n, round(cast(sum((ny >= cut)::int) as double) / count(*), 6) as share from r cross join k group by all""")
def _(t):
    r = cases(t).groupBy("o_custkey", "st").agg(F.count_distinct("yr").alias("ny"))
    return rounded(P.counts_above(r, ["st"], "ny", [1, 2, 3, 4, 5, 6]))


@query("expected_vs_observed", "D25", f"""with {SCORED_SQL}, a as (select yr, cast(sum(y) as double) as o, sum(score) / 1e5 as p1, sum(0.33 + score * 0) as p2 from scored group by yr)
select yr, 'p1' as mdl, round(p1, 3) as total, round(o - p1, 3) as diff from a union all select yr, 'p2', round(p2, 3), round(o - p2, 3) from a""")
def _(t):
    s = scored(t).withColumn("p1", F.col("score") / 1e5).withColumn("p2", F.lit(0.33))
    return rounded(P.expected_vs_observed(s, ["yr"], "y", ["p1", "p2"]), 3)


@query("confusion", "D26", f"""with {SCORED_SQL} select yr, cast(sum((score >= 40000 and y = 1)::int) as bigint) as tp, cast(sum((score >= 40000 and y = 0)::int) as bigint) as fp,
  cast(sum((score < 40000 and y = 1)::int) as bigint) as fn, cast(sum((score < 40000 and y = 0)::int) as bigint) as tn from scored group by yr""")
def _(t):
    return T.confusion(scored(t), ["yr"], 40000.0)
