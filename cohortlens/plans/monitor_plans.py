"""Registered queries of sections 2.M, 2.N and 2.O."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions.dist import normal_quantile
from ..operators import inference as I, joins as J, match as N, monitor as M, windows as W
from ..streaming import monitor_stream as MS
from .inference_plans import POWERS, PPFS, Z975, sql_norm_cdf
from .join_plans import NEAREST_SQL, near_tables
from .registry import CASES_SQL, REGISTRY, SCORED_SQL, cases, query, rounded, scored

EV_SQL = """ev as (select event_id, ts, cast(ts as date) as date, user_id, cast(case when event_type = 'purchase' then 1 else 0 end as bigint) as y, value as preds,
  (user_id % 50) / 5.0::double as nb, cast(user_id % 10 as bigint) as g from events),
sg as (select g, avg(cast(y as double)) as r from ev where date < date '2024-01-11' group by g having avg(cast(y as double)) > 0.2),
rt as (select ev.*, case when sg.g is not null then 'preds' else 'nb' end as mdl, case when sg.g is not null then preds else nb end as phat from ev left join sg on sg.g = ev.g),
th as (select mdl, quantile_cont(phat, 0.4) as thresh from rt where y = 1 group by mdl),
ap as (select rt.*, cast(case when phat >= thresh then 1 else 0 end as bigint) as yhat from rt join th using (mdl))"""


def ev(t):
    return t("events").select(
        "event_id", "ts", F.to_date("ts").alias("date"), "user_id", (F.col("event_type") == "purchase").cast("bigint").alias("y"),
        F.col("value").alias("preds"), ((F.col("user_id") % 50) / 5.0).alias("nb"), (F.col("user_id") % 10).alias("g"))


def routed(t):
    e = ev(t)
    sg = e.filter("date < date'2024-01-11'").groupBy("g").agg(F.avg(F.col("y").cast("double")).alias("r")).filter("r > 0.2")
    return M.route(e, sg, "g", "preds", "nb")


def applied(t):
    from ..operators.ordered import quantile_columns
    r = routed(t)
    return M.apply_thresholds(r, quantile_columns(r.filter("y = 1"), ["mdl"], "phat", {"thresh": 0.4}))


@query("route_cases", "M1", f"""with {EV_SQL} select event_id, mdl, round(phat, 6) as phat, yhat from ap""")
def _(t):
    return rounded(applied(t).select("event_id", "mdl", "phat", "yhat"))


def _mon_sql(key: str = "") -> str:
    k = f"{key}, " if key else ""
    part = f"partition by {key} order by date" if key else "order by date"
    return f"""dd as (select {k}date, count(*) as n, sum(y) as y, sum(yhat * y) as tp, sum(yhat * (1 - y)) as fp from ap group by all),
cu as (select {k}date, sum(n) over ({part}) as n_rt, sum(y) over ({part}) as y, sum(tp) over ({part}) as tp, sum(fp) over ({part}) as fp from dd),
m0 as (select *, tp / y::double as sens, tp / nullif(tp + fp, 0)::double as prec from cu where y > 0),
m1 as (select *, sqrt(sens * (1 - sens) / y) as se_sens, sqrt(prec * (1 - prec) / nullif(tp + fp, 0)) as se_prec from m0),
m2 as (select *, case when se_sens = 0 and sens < 0.55 then '-infinity'::double else (sens - 0.55) / nullif(se_sens, 0) end as zscore from m1),
mon as (select *, case when zscore = '-infinity'::double then 1 else 1 - {sql_norm_cdf("case when zscore = '-infinity'::double then 0 else zscore end")} end as pval from m2 where {"prec is not null" if key else "zscore is not null"})"""


MON_COLS = """cast(date as varchar) as date, cast(n_rt as bigint) as n_rt, cast(y as bigint) as y, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(sens, 6) as sens, round(prec, 6) as prec,
  round(se_sens, 6) as se_sens, round(se_prec, 6) as se_prec, round(zscore, 5) as zscore, round(pval, 6) as pval from mon"""


def _mon_out(d):
    return rounded(d, zscore=5)


@query("sequential_monitor", "M2", f"""with {EV_SQL}, {_mon_sql()} select {MON_COLS}""")
def _(t):
    return _mon_out(M.monitor(applied(t), [], "date", 0.55))


@query("sequential_monitor_by_route", "M2", f"""with {EV_SQL}, {_mon_sql('mdl')} select mdl, {MON_COLS}""")
def _(t):
    return _mon_out(M.monitor(applied(t), ["mdl"], "date", 0.55))


@query("days_to_reject", "M3", f"""with {EV_SQL}, {_mon_sql()}, f as (select *, pval < 0.45 as hit, lag(pval < 0.45) over (order by date) as prev from mon)
select cast(max(date) as varchar) as date_reject, cast(date_diff('day', (select min(date) from ev), max(date)) as bigint) as days from f where hit and coalesce(not prev, true) having max(date) is not null""")
def _(t):
    first = ev(t).agg(F.min("date")).scalar()
    return rounded(M.days_to_reject(M.monitor(applied(t), [], "date", 0.55), first, "date", 0.45))


@query("power_at", "M4", f"""with {EV_SQL}, {_mon_sql()}, r as (select avg(cast(y as double)) as rate from ev),
gr as (select power, pow((sqrt(0.25) * zb - sqrt(0.24) * {NormalDist().inv_cdf(0.95)}) / -0.1, 2) / rate as n from (select unnest({POWERS}::double[]) as power, unnest({PPFS!r}::double[]) as zb) cross join r),
s as (select *, lead(n) over (order by n) as n2, lead(power) over (order by n) as p2 from gr)
select cast(date as varchar) as date, cast(n_rt as bigint) as n_rt, round(coalesce((select power + (mon.n_rt - n) / (n2 - n) * (p2 - power) from s where n <= mon.n_rt and n2 > mon.n_rt),
  case when mon.n_rt < (select min(n) from gr) then (select min(power) from gr) else (select max(power) from gr) end), 5) as power from mon""")
def _(t):
    rate = ev(t).agg(F.avg(F.col("y").cast("double")).alias("rate"))
    grid = rate.select("rate", F.explode(F.array(*[F.lit(p) for p in POWERS])).alias("power"))
    grid = I.sample_size(grid, "power", 0.5, 0.1, 0.05).withColumn("n_cases", F.col("n_star") / F.col("rate"))
    return rounded(M.power_at(M.monitor(applied(t), [], "date", 0.55), grid, "n_cases").select("date", "n_rt", "power"), 5)


@query("compare_rates", "M5", f"""with {CASES_SQL}, c as (select g as term, case when yr < 1999 then 'a' else 'b' end as side, sum(y) as y1, count(*) as tot from cases group by all),
k as (select term from c group by term having count(*) = 2 and min(y1) > 0)
select term, side, cast(y1 as bigint) as y1, tot, round(y1::double / tot, 6) as prop, round(y1::double / tot - {Z975} * sqrt(y1::double / tot * (1 - y1::double / tot) / tot), 6) as lb,
 round(y1::double / tot + {Z975} * sqrt(y1::double / tot * (1 - y1::double / tot) / tot), 6) as ub from c join k using (term)""")
def _(t):
    return rounded(M.compare_rates(sides(t), "term", "side", ("a", "b"), exact=False))


def sides(t):
    return cases(t).withColumn("side", F.when(F.col("yr") < 1999, "a").otherwise("b")).withColumnRenamed("g", "term")


@query("compare_rates_exact", "M5")
def _(t):
    return rounded(M.compare_rates(sides(t), "term", "side", ("a", "b")))


@query("calibration", "M6", f"""with {SCORED_SQL}, a as (select case when yr < 1999 then 'home' else 'ext' end as ds, y::double as y, score / 2e5 as preds, 0.3::double as nb from scored),
l as (select ds, 'y' as mdl, y as p from a union all select ds, 'preds', preds from a union all select ds, 'nb', nb from a),
m as (select ds, mdl, avg(p) as p, count(*) as n from l group by all)
select ds, mdl, round(p, 6) as prop, round(p - {Z975} * sqrt(p * (1 - p) / n), 6) as lb, round(p + {Z975} * sqrt(p * (1 - p) / n), 6) as ub from m""")
def _(t):
    a = scored(t).select(F.when(F.col("yr") < 1999, "home").otherwise("ext").alias("ds"), "y", (F.col("score") / 2e5).alias("preds"), F.lit(0.3).alias("nb"))
    return rounded(M.calibration(a, "ds", "y", ["preds", "nb"]))


@query("usable_groups", "M7", f"""with {CASES_SQL}, c as (select o_custkey as g, sum(1 - y) as y0, sum(y) as y1 from cases group by 1)
select g, cast(y0 as bigint) as y0, cast(y1 as bigint) as y1 from c where y0 > 0 and y1 > 0 and y0 * y1 >= 30 and y1 >= 2""")
def _(t):
    return rounded(M.usable_groups(cases(t).select(F.col("o_custkey").alias("g"), "y"), "g"))


CMP_SQL = """l as (select 'nation' as name, cast(c_nationkey as varchar) as level, 'a' as tt from customer union all select 'nation', cast(s_nationkey as varchar), 'b' from supplier
 union all select 'rich', case when c_acctbal > 4000 then 'yes' else 'no' end, 'a' from customer union all select 'rich', case when s_acctbal > 4000 then 'yes' else 'no' end, 'b' from supplier),
sh as (select name, tt, level, count(*) as n, cast(count(*) as double) / sum(count(*)) over (partition by name, tt) as share from l group by name, tt, level),
o as (select name, level, sum((tt = 'a')::int) as oa, sum((tt = 'b')::int) as ob from l group by all), q as (select name, sum(oa) as ta, sum(ob) as tb, count(*) as k from o group by name),
e as (select o.*, k, (oa + ob) * cast(ta as double) / (ta + tb) as ea, (oa + ob) * cast(tb as double) / (ta + tb) as eb from o join q using (name)),
s as (select name, sum(pow(abs(oa - ea) - case when k = 2 then least(0.5, abs(oa - ea)) else 0 end, 2) / ea + pow(abs(ob - eb) - case when k = 2 then least(0.5, abs(ob - eb)) else 0 end, 2) / eb) as stat, cast(max(k) - 1 as bigint) as dof from e group by name)"""


def cmp_tables(t):
    a = t("customer").select(F.col("c_nationkey").alias("nation"), F.when(F.col("c_acctbal") > 4000, "yes").otherwise("no").alias("rich"))
    b = t("supplier").select(F.col("s_nationkey").alias("nation"), F.when(F.col("s_acctbal") > 4000, "yes").otherwise("no").alias("rich"))
    return a, b


@query("compare_tables", "M8", f"""with {CMP_SQL} select name, tt, level, n, round(share, 6) as share, round(stat, 6) as stat, dof from sh join s using (name)""")
def _(t):
    return rounded(M.compare_tables(*cmp_tables(t), ["nation", "rich"], with_p=False))


@query("compare_tables_pvalue", "M8")
def _(t):
    return rounded(M.compare_tables(*cmp_tables(t), ["nation", "rich"]))


@query("profile_hits", "M9", f"""with {EV_SQL}, h as (select event_id from ap where yhat = 1 and y = 1 and mdl = 'preds'),
f as (select e.event_type, e.user_id % 5 as bucket from events e join h using (event_id))
select 'event_type' as name, event_type as level, count(*) as n from f group by all union all select 'bucket', cast(bucket as varchar), count(*) from f group by all""")
def _(t):
    hits = applied(t).filter("yhat = 1 and y = 1 and mdl = 'preds'")
    feats = t("events").select("event_id", "event_type", (F.col("user_id") % 5).alias("bucket"))
    return M.profile_hits(hits, feats, "event_id", ["event_type", "bucket"])


@query("duplicate_pairs", "N1", """with a as (select c_custkey, c_nationkey, c_mktsegment, round(c_acctbal, -2) as bal from customer),
d as (select count(*) over (partition by c_nationkey, c_mktsegment, bal) as k from a)
select cast(sum((k > 1)::int) as bigint) as rows, cast(floor(sum((k > 1)::int) / 2) as bigint) as pairs from d""")
def _(t):
    a = t("customer").select("c_custkey", "c_nationkey", "c_mktsegment", F.round("c_acctbal", -2).alias("bal"))
    return N.duplicate_pairs(a, ["c_custkey"])


@query("nearest_match", "N2", f"""with {NEAREST_SQL} select qid, rid, round(err, 6) as err, prop from near""")
def _(t):
    q, r = near_tables(t)
    return rounded(N.nearest_match(q, r, ["x", "z", "w"], ["c"], "qid", "rid"))


@query("suspects", "N3", f"""with {NEAREST_SQL}, s as (select * from near where prop > 0.95 and err < 60),
j as (select s.qid, s.rid, q.z as qz, r.z as rz, q.w as qw, r.w as rw, q.c as qc, r.c as rc from s join q using (qid) join r using (rid))
select qid, rid, 'c' as column_name, cast(qc as varchar) as query, cast(rc as varchar) as reference from j
union all select qid, rid, 'w', cast(qw as varchar), cast(rw as varchar) from j""")
def _(t):
    q, r = near_tables(t)
    found = N.suspects(N.nearest_match(q, r, ["x", "z", "w"], ["c"], "qid", "rid"), 0.95, 60.0)
    return N.side_by_side(found, q, r, "qid", "rid", ["c", "w"])


@query("monitor_stream", "O1", """with d as (select cast(ts as date) as date, count(*) as n, sum((event_type = 'purchase')::int) as y, sum((event_type = 'purchase' and value >= 8)::int) as tp,
  sum((event_type <> 'purchase' and value >= 8)::int) as fp from events group by 1),
fin as (select * from d where date + 1 <= (select max(ts) - interval 1 day from events)),
cu as (select date, sum(n) over (order by date) as n_rt, sum(y) over (order by date) as y, sum(tp) over (order by date) as tp, sum(fp) over (order by date) as fp from fin),
m as (select *, tp / y::double as sens, tp / nullif(tp + fp, 0)::double as prec from cu where y > 0)
select cast(date as varchar) as date, cast(n_rt as bigint) as n_rt, cast(y as bigint) as y, cast(tp as bigint) as tp, cast(fp as bigint) as fp, round(sens, 6) as sens, round(prec, 6) as prec
from m where sens > 0 and sens < 1""")
def _(t):
    e = t("events")
    folder = e.inputFiles()[0].rsplit("/", 1)[0]
    stream = (e.sparkSession.readStream.schema(e.schema).option("pathGlobFilter", "events.parquet").parquet(folder)
              .select(MS.utc_instant("ts").alias("ts"), (F.col("event_type") == "purchase").cast("bigint").alias("y"), (F.col("value") >= 8).cast("bigint").alias("yhat")))
    out = MS.monitor_stream(stream, 0.55)
    return rounded(out.select("date", "n_rt", "y", "tp", "fp", "sens", "prec"))
