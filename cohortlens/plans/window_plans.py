"""Registered queries of sections 2.E, 2.F and 2.G."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile as P, sets as S, windows as W
from .registry import CASES_SQL, SCORED_SQL, cases, query, rounded, scored


@query("running_number", "E1", f"""with {CASES_SQL} select g, caseid, row_number() over (partition by g order by score, caseid) as rn from cases""")
def _(t):
    return W.running_number(cases(t).select("g", "caseid", "score"), ["g"], ["score", "caseid"]).drop("score")


@query("cumulate", "E2", """with d as (select event_type, cast(ts as date) as d, count(*) as n from events group by all)
select event_type, cast(d as varchar) as d, cast(sum(n) over (partition by event_type order by d) as bigint) as n_end,
  cast(sum(n) over (partition by event_type order by d) - n as bigint) as n_start from d""")
def _(t):
    d = t("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(W.cumulate(d, ["event_type"], ["d"], ["n"]).drop("n"))


@query("lag_diff", "E3", """select event_id, round(value - lag(value) over (partition by event_type order by ts, event_id), 6) as diff from events""")
def _(t):
    e = t("events").select("event_type", "event_id", "ts", "value")
    return rounded(W.lag_diff(e, ["event_type"], ["ts", "event_id"], "value").select("event_id", "diff"))


ROLL_SQL = """r as (select event_id, event_type, value, ts,
  case when count(*) over w1 = 30 then avg(value) over w1 end as mu, case when count(*) over w2 = 60 then stddev_samp(value) over w2 end as se from events
  window w1 as (partition by event_type order by ts, event_id rows between 15 preceding and 14 following),
         w2 as (partition by event_type order by ts, event_id rows between 30 preceding and 29 following))"""


def events_of(t):
    return t("events").select("event_type", "event_id", "ts", "value")


@query("rolling_stats", "E4", f"""with {ROLL_SQL} select event_id, round(mu, 5) as mu, round(se, 5) as se from r""")
def _(t):
    return rounded(W.rolling_stats(events_of(t), ["event_type"], ["ts", "event_id"], "value", 30).select("event_id", "mu", "se"), 5)


FILL_SQL = f"""{ROLL_SQL}, b as (select event_id, event_type, value, ts,
   coalesce(mu, first_value(mu ignore nulls) over (partition by event_type order by ts, event_id rows between current row and unbounded following)) as mu,
   coalesce(se, first_value(se ignore nulls) over (partition by event_type order by ts, event_id rows between current row and unbounded following)) as se from r),
f as (select event_id, event_type, value, coalesce(mu, last_value(mu ignore nulls) over (partition by event_type order by ts, event_id rows between unbounded preceding and current row)) as mu,
   coalesce(se, last_value(se ignore nulls) over (partition by event_type order by ts, event_id rows between unbounded preceding and current row)) as se from b)"""


@query("fill_edges", "E5", f"""with {FILL_SQL} select event_id, round(mu, 5) as mu, round(se, 5) as se from f""")
def _(t):
    r = W.rolling_filled(events_of(t), ["event_type"], ["ts", "event_id"], "value", 30)
    return rounded(r.select("event_id", "mu", "se"), 5)


@query("fill_nearest", "E5", """with e as (select event_id, event_type, ts, case when value > 12 then value end as v from events),
b as (select *, coalesce(v, first_value(v ignore nulls) over (partition by event_type order by ts, event_id rows between current row and unbounded following)) as w from e)
select event_id, round(coalesce(w, last_value(w ignore nulls) over (partition by event_type order by ts, event_id rows between unbounded preceding and current row)), 6) as v from b""")
def _(t):
    e = events_of(t).withColumn("v", F.when(F.col("value") > 12, F.col("value")))
    return rounded(W.fill_edges(e, ["event_type"], ["ts", "event_id"], ["v"]).select("event_id", "v"))


@query("rolling_outliers", "E6", f"""with {FILL_SQL} select event_id, cast(case when value > mu + 2 * se or value < mu - 2 * se then 1 else 0 end as bigint) as outlier,
  case when value > mu + 2 * se or value < mu - 2 * se then null else value end as kept from f""")
def _(t):
    out = W.rolling_outliers(events_of(t), ["event_type"], ["ts", "event_id"], "value", 30, F.lit(2.0))
    return rounded(out.select("event_id", "outlier", "kept"))


@query("midrank", "E7", f"""with {SCORED_SQL} select yr, g, y, score, rank() over (partition by yr order by score) + (count(*) over (partition by yr, score) - 1) / 2.0::double as rank from scored""")
def _(t):
    return rounded(W.midrank(scored(t).select("yr", "g", "y", "score"), ["yr"], "score"))


@query("top1_per_group", "E8", f"""with {CASES_SQL} select g, yr, caseid, score from cases qualify row_number() over (partition by g, yr order by score desc, caseid) = 1""")
def _(t):
    return W.top1(cases(t).select("g", "yr", "caseid", "score"), ["g", "yr"], [-F.col("score"), F.col("caseid")])


RATES_SQL = f"""{SCORED_SQL}, rates as (select g, avg(cast(y as double)) + g / 1e7 as rate from scored where yr < 2000 group by g)"""


def rates(t):
    return scored(t).filter("yr < 2000").groupBy("g").agg(F.avg(F.col("y").cast("double")).alias("r")).select(
        "g", (F.col("r") + F.col("g") / F.lit(1e7)).alias("rate"))


@query("quantile_bins", "E9", f"""with {RATES_SQL}, e as (select quantile_cont(rate, [0.2, 0.4, 0.6, 0.8]) as q from rates)
select g, cast(len(list_filter(e.q, lambda x: x < rate)) as bigint) as bin from rates, e""")
def _(t):
    return rounded(W.quantile_bins(rates(t), "g", "rate", 5).drop("rate"))


@query("grid_bins", "E10", f"""with {CASES_SQL}, e as (select g, quantile_cont(score, [0, 0.7, 0.8, 0.9, 0.95, 1.0]) as q from cases group by g)
select caseid, round(case when score > e.q[1] then list_min(list_filter(e.q[2:], lambda x: x >= score)) end, 3) as bin from cases join e using (g)""")
def _(t):
    d = W.grid_bins(cases(t).select("g", "caseid", "score"), ["g"], "score", [0.0, 0.7, 0.8, 0.9, 0.95, 1.0])
    return rounded(d.select("caseid", "bin"), 3)


@query("pareto", "E11", """with c as (select p_name, count(*) as n from part group by 1)
select p_name, n, row_number() over (order by n desc, p_name) as rank, round(sum(n) over (order by n desc, p_name) / sum(n) over ()::double, 6) as cum_share from c""")
def _(t):
    return rounded(P.pareto(t("part"), [], "p_name"))


@query("impute_group_mean", "E12", f"""with {CASES_SQL}, m as (select caseid, yr, case when st <> 'P' then score end as x from cases)
select caseid, round(coalesce(x, avg(x) over (partition by yr)), 3) as x from m""")
def _(t):
    m = cases(t).select("caseid", "yr", F.when(F.col("st") != "P", F.col("score")).alias("x"))
    return rounded(W.impute_group_mean(m, ["yr"], ["x"]).select("caseid", "x"), 3)


@query("share_above", "E13", f"""with {CASES_SQL}, c as (select caseid, yr, round(score, -3) as s from cases)
select caseid, round(cast(count(*) over (partition by yr) - (rank() over (partition by yr order by s) + count(*) over (partition by yr, s) - 1) as double) / count(*) over (partition by yr), 6) as share_above from c""")
def _(t):
    c = cases(t).select("caseid", "yr", F.round("score", -3).alias("s"))
    return rounded(W.share_above(c, ["yr"], "s").select("caseid", "share_above"))


@query("last_run_start", "E14", """with d as (select event_type, cast(ts as date) as d, avg(value) as v from events group by all),
f as (select *, v > 10 as hit, lag(v > 10) over (partition by event_type order by d) as prev from d)
select event_type, cast(max(d) as varchar) as d from f where hit and coalesce(not prev, true) group by event_type""")
def _(t):
    d = t("events").groupBy("event_type", F.to_date("ts").alias("d")).agg(F.avg("value").alias("v"))
    return rounded(W.last_run_start(d, ["event_type"], ["d"], F.col("v") > 10))


@query("share_within", "E15", f"""with {CASES_SQL} select g, st, count(*) as n, round(cast(count(*) as double) / sum(count(*)) over (partition by g), 6) as share from cases group by g, st""")
def _(t):
    return rounded(P.level_share(cases(t), ["g"], "st"))


@query("multi_key_sort", "F1", f"""with {CASES_SQL} select g, yr, count(*) as n from cases group by all order by g, yr desc""")
def _(t):
    return S.sort_rows(cases(t).groupBy("g", "yr").agg(F.count(F.lit(1)).alias("n")), [F.col("g").asc(), F.col("yr").desc()])


@query("top_n", "F2", """select o_orderkey, o_totalprice from orders order by o_totalprice desc, o_orderkey limit 25""")
def _(t):
    return S.top_n(t("orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey").asc()], 25)


@query("date_number_order", "F3", """select o_orderkey, row_number() over (order by cast(o_orderdate as date), o_orderkey) as rn from orders""")
def _(t):
    o = t("orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("d"))
    return W.running_number(o, [], ["d", "o_orderkey"]).drop("d")


@query("stack_sources", "G1", """select src, count(*) as n, round(sum(bal), 2) as bal, count(seg) as n_seg from (
  select 'customer' as src, c_acctbal as bal, c_mktsegment as seg from customer union all select 'supplier', s_acctbal, null from supplier) group by src""")
def _(t):
    d = S.stack({"customer": t("customer").select(F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg")),
                 "supplier": t("supplier").select(F.col("s_acctbal").alias("bal"))}, "src")
    return rounded(d.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("bal").alias("bal"), F.count("seg").alias("n_seg")), 2)


@query("intersect_keys", "G2", """select doc_id from documents intersect select doc_id from labels""")
def _(t):
    return S.common_keys(t("documents").select("doc_id"), t("labels").select("doc_id"))


@query("except_keys", "G3", """select c_custkey from customer except select o_custkey from orders""")
def _(t):
    return S.except_keys(t("customer").select("c_custkey"), t("orders").select(F.col("o_custkey").alias("c_custkey")))


@query("distinct_rows", "G4", """select distinct lang, source from documents""")
def _(t):
    return S.unique(t("documents"), ["lang", "source"])


@query("union_keys", "G5", """select c_nationkey::bigint as k from customer union select s_nationkey from supplier""")
def _(t):
    return S.union_keys(t("customer").select(F.col("c_nationkey").cast("bigint").alias("k")), t("supplier").select(F.col("s_nationkey").cast("bigint").alias("k")))


@query("duplicate_rows", "G6", """with a as (select * from orders union all select o_orderkey + 1000000, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority from orders where o_totalprice > 490000)
select o_orderkey, count(*) over (partition by o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) as copies from a
qualify count(*) over (partition by o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority) > 1""")
def _(t):
    o = t("orders")
    again = o.filter("o_totalprice > 490000").withColumn("o_orderkey", F.col("o_orderkey") + 1000000)
    return S.duplicates(o.unionByName(again), ["o_orderkey"]).select("o_orderkey", "copies")
