"""Registered queries of section 2.I: ranking metrics, curves, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ranking as R, thresholds as T
from .registry import (CASES_SQL, MULTI_CELLS, MULTI_KEYS, MULTI_SQL, SCORED_SQL, cases, multi, multi_wide, query, rounded,
                       scored, sql_auc, sql_bits, sql_decompose)

PP = [0.0, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.99, 1.0]


@query("auc_by_period", "I1", f"""with {SCORED_SQL}, {sql_auc('scored', 'yr')}
select yr, n1, n0, round(den, 6) as den, round(auc, 6) as auc from auc_t""")
def _(t):
    return rounded(R.auc(scored(t), ["yr"]).drop("num"))


@query("auc_sampled", "I2", f"""with {CASES_SQL},
pos as (select *, row_number() over (partition by yr, y order by score, caseid) as rn from cases),
sz as (select yr, sum(y) as n1, sum(1 - y) as n0 from cases group by yr),
d as (select yr, n1, n0, i,
   {sql_bits('7', '1', 'yr', 'i')} % cast(n1 as bigint) + 1 as p1,
   {sql_bits('7', '0', 'yr', 'i')} % cast(n0 as bigint) + 1 as p0
  from sz cross join range(1, 2001) as r(i))
select d.yr, cast(max(n1) as bigint) as n1, cast(max(n0) as bigint) as n0,
  round(avg(case when a.score > b.score then 1.0::double else 0.0::double end), 6) as auc
from d join pos a on a.yr = d.yr and a.y = 1 and a.rn = d.p1
       join pos b on b.yr = d.yr and b.y = 0 and b.rn = d.p0
group by d.yr""")
def _(t):
    return rounded(R.sampled_pair_auc(cases(t), ["yr"], 2000, 7, "caseid"))


@query("auc_ordinal", "I3", """with a as (
  select cast(substr(o_orderpriority, 1, 1) as bigint) as lv, round(o_totalprice, -3) as s,
         cast(year(o_orderdate) as bigint) as yr from orders),
h as (select yr, s, lv, count(*) as c from a group by all),
p as (select h.yr, sum(h.c * cast(l.c as double) * case when h.s > l.s then 1.0 when h.s = l.s then 0.5 else 0.0 end) as num,
  sum(h.c * cast(l.c as double)) as den
  from h join h l on h.yr = l.yr and h.lv > l.lv group by h.yr)
select yr, round(num / den, 6) as auc, round(den, 6) as den from p""")
def _(t):
    a = t("orders").select(F.substring("o_orderpriority", 1, 1).cast("bigint").alias("lv"),
                           F.round("o_totalprice", -3).alias("s"),
                           F.year("o_orderdate").cast("bigint").alias("yr"))
    return rounded(R.auc_ordinal(a, ["yr"], "lv", "s", [1, 2, 3, 4, 5]))


PAIRWISE_SQL = """with l as (select label, i - 1 as c, cast(embedding[i] as double) as s from embeddings cross join range(1, 11) as r(i) where label between 0 and 9)
select cast(a.y0 as bigint) as y0, cast(a.y1 as bigint) as y1, round(a.num / a.den, 6) as auc, a.den from (
  select n.label as y0, p.label as y1,
    sum(case when p.s > n.s then 1.0::double when p.s = n.s then 0.5::double else 0.0::double end) as num, cast(count(*) as double) as den
  from l p join l n on p.c = p.label and n.c = p.label and n.label < p.label
  group by n.label, p.label) a"""


@query("auc_pairwise", "I4", PAIRWISE_SQL)
@query("auc_pairwise_all", "I4", PAIRWISE_SQL)
def _(t):
    """All ten labels, each scored by its own component."""
    e = t("embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(10)])
    return rounded(R.auc_pairwise(e, "label", {i: f"x{i}" for i in range(10)}))


@query("auc_by_group", "I5", f"""with {SCORED_SQL}, {sql_auc('scored', 'yr, g')}
select yr, g, n1, n0, round(num + cast(n1 as double) * (n1 + 1) / 2, 6) as r_s, round(den, 6) as n0n1, round(auc, 6) as auc
from auc_t where n1 > 0""")
def _(t):
    return rounded(R.auc_by_group(scored(t), ["yr"], "g"))


@query("auc_decompose", "I6", f"""with {SCORED_SQL}, {sql_decompose('scored', 'yr', 'g')}
select yr, tt, round(auc, 6) as auc, round(den, 6) as den, n1, n0 from dec""")
def _(t):
    return rounded(R.auc_decompose(scored(t), ["yr"], "g"))


@query("decompose_all", "I7", f"""with {MULTI_SQL},
{sql_decompose('multi', 'model, outcome, version, method, test_year', 'grp', 'dy', 'preds')},
{sql_decompose('multi', 'model, outcome, version, method', 'grp', 'da', 'preds')}
select model, outcome, cast(version as bigint) as version, method, cast(test_year as varchar) as test_year, tt, round(auc, 6) as auc, den, n1, n0 from dy
union all
select model, outcome, cast(version as bigint), method, 'all', tt, round(auc, 6), den, n1, n0 from da""")
def _(t):
    return rounded(R.decompose_all(multi_wide(t), MULTI_KEYS, "test_year", "grp", cells=MULTI_CELLS))


@query("auc_decompose_sampled", "I8", f"""with {CASES_SQL},
pg as (select *, row_number() over (partition by g, y order by score, caseid) as rn,
  row_number() over (partition by y order by score, caseid) as rt from cases),
sz as (select g, sum(y) as n1, sum(1 - y) as n0 from cases group by g),
d as (select g, cast(n1 as bigint) as n1, cast(n0 as bigint) as n0, i from sz cross join range(1, 1001) as r(i) where n1 > 0 and n0 > 0),
w as (select d.g, max(d.n1) * cast(max(d.n0) as double) as pairs,
   avg(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0.0::double end) as auc
  from d join pg a on a.g = d.g and a.y = 1 and a.rn = {sql_bits('11', '1', 'd.g', 'd.i')} % d.n1 + 1
         join pg b on b.g = d.g and b.y = 0 and b.rn = {sql_bits('11', '0', 'd.g', 'd.i')} % d.n0 + 1
  group by d.g),
tz as (select cast(sum(y) as bigint) as n1, cast(sum(1 - y) as bigint) as n0 from cases),
tt as (select avg(case when a.score > b.score then 1.0::double when a.score = b.score then 0.5::double else 0.0::double end) as total,
   max(tz.n1) * cast(max(tz.n0) as double) as den
  from d cross join tz
  join pg a on a.y = 1 and a.rt = {sql_bits('11', "'t1'", 'd.g', 'd.i')} % tz.n1 + 1
  join pg b on b.y = 0 and b.rt = {sql_bits('11', "'t0'", 'd.g', 'd.i')} % tz.n0 + 1),
ww as (select sum(auc * pairs) / sum(pairs) as within, sum(pairs) as den_w from w)
select round(total, 6) as total, round(within, 6) as within,
  round((total * den - within * den_w) / (den - den_w), 6) as between from tt cross join ww""")
def _(t):
    return rounded(R.auc_decompose_sampled(cases(t), "g", 1000, 11, "caseid"))


@query("avg_precision", "I9", f"""with {SCORED_SQL},
h as (select yr, score, sum(y) as p, sum(1 - y) as n from scored group by all),
c as (select *, sum(p) over (partition by yr order by score desc) as tp, sum(n) over (partition by yr order by score desc) as fp from h)
select yr, round(sum(cast(p as double) * tp / (tp + fp)) / sum(p), 6) as ap from c group by yr""")
def _(t):
    return rounded(R.avg_precision(scored(t), ["yr"]))


@query("log_loss_r2", "I9", """with a as (
  select cast(year(l_shipdate) as bigint) as yr, case when l_returnflag = 'R' then 1.0::double else 0.0::double end as y,
    0.05 + 0.9 * (l_quantity / 50.0) as p, l_quantity / 50.0 as yhat, l_discount * 10 as yc from lineitem)
select yr, round(avg(-ln(case when y = 1 then p else 1 - p end)), 6) as log_loss,
  round(1 - sum((yc - yhat) * (yc - yhat)) / (var_pop(yc) * count(*)), 6) as r2 from a group by yr""")
def _(t):
    a = t("lineitem").select(
        F.year("l_shipdate").cast("bigint").alias("yr"), (F.col("l_returnflag") == "R").cast("bigint").alias("y"),
        (0.05 + 0.9 * (F.col("l_quantity") / 50.0)).alias("score"), (F.col("l_quantity") / 50.0).alias("yhat"),
        (F.col("l_discount") * 10).alias("yc"))
    return rounded(R.log_loss(a, ["yr"]).join(R.r_squared(a, ["yr"], "yc", "yhat"), "yr"))


def _grid_sql(src: str, num: int, hi: float, tail: str) -> str:
    return f"""with {SCORED_SQL}, h as (select yr, score, sum(y) as p, sum(1 - y) as n from scored group by all),
b as (select yr, min(case when p > 0 then score end) * {tail} as lo, max(case when p > 0 then score end) * {hi} as hi, sum(p) as n1, sum(n) as n0 from h group by yr),
gr as (select b.yr, b.n1, b.n0, i as j, b.lo + i * ((b.hi - b.lo) / {num - 1}) as thresh from b cross join range(0, {num}) as r(i)),
x as (select gr.yr, gr.j, gr.thresh, gr.n1, gr.n0,
  sum(case when h.score > gr.thresh then h.p else 0 end) as p_gt, sum(case when h.score > gr.thresh then h.n else 0 end) as n_gt,
  sum(case when h.score >= gr.thresh then h.p else 0 end) as p_ge, sum(case when h.score >= gr.thresh then h.n else 0 end) as n_ge
 from gr join h on h.yr = gr.yr group by all)"""


@query("roc_grid", "I10", _grid_sql("scored", 100, 1.01, "0.99") + """
select yr, j, round(thresh, 2) as thresh, round(cast(p_gt as double) / n1, 6) as tpr, round(cast(n_gt as double) / n0, 6) as fpr from x""")
def _(t):
    return rounded(T.roc_grid(scored(t), ["yr"], 100), thresh=2)


@query("pr_grid", "I11", _grid_sql("scored", 200, 0.99, "0.99") + """
select yr, j, round(thresh, 2) as thresh, round(cast(p_gt as double) / n1, 6) as tpr,
  round(cast(p_ge as double) / nullif(p_ge + n_ge, 0), 6) as "precision" from x""")
def _(t):
    return rounded(T.pr_grid(scored(t), ["yr"], 200), thresh=2)


@query("sens_spec", "I12", f"""with {SCORED_SQL}
select yr, round(avg(case when y = 1 then (case when score > 40000 then 1.0::double else 0.0::double end) end), 6) as sens,
  round(avg(case when y = 0 then (case when score > 40000 then 0.0::double else 1.0::double end) end), 6) as spec from scored group by yr""")
def _(t):
    return rounded(T.sens_spec(scored(t), ["yr"], 40000.0))


@query("ppv_at", "I13", f"""with {SCORED_SQL}
select g, round(avg(case when score >= 40000 then cast(y as double) end), 6) as ppv from scored group by g""")
def _(t):
    return rounded(T.ppv_at(scored(t), ["g"], 40000.0))


@query("threshold_for", "I14", f"""with {SCORED_SQL}, d as (select distinct yr, score as tt from scored),
m as (select d.yr, d.tt, avg(case when y = 1 then (case when score > tt then 1.0::double else 0.0::double end) end) as sens
  from d join scored s on s.yr = d.yr group by all)
select yr, tt as thresh, round(sens, 6) as sens from m
qualify row_number() over (partition by yr order by round(abs(sens - 0.8), 12), tt) = 1""")
def _(t):
    return rounded(T.threshold_for(scored(t), ["yr"], 0.8, "sens"))


@query("threshold_for_ppv", "I15", f"""with {SCORED_SQL}, h as (select yr, score, sum(y) as p, sum(1 - y) as n from scored group by all),
b as (select yr, min(case when p > 0 then score end) as lo, max(case when p > 0 then score end) as hi from h group by yr),
cand as (select b.yr, b.lo + i * ((b.hi - b.lo) / 99) as t from b cross join range(0, 100) as r(i)
  union select yr, score from h where p > 0),
m as (select c.yr, c.t, sum(case when h.score >= c.t then h.p else 0 end) as tp, sum(case when h.score >= c.t then h.n else 0 end) as fp
  from cand c join h on h.yr = c.yr group by all),
r as (select yr, t, cast(tp as double) / nullif(tp + fp, 0) as ppv from m)
select yr, round(t, 2) as thresh, round(ppv, 6) as ppv from r where ppv is not null
qualify row_number() over (partition by yr order by round((ppv - 0.34) * (ppv - 0.34), 12), t) = 1""")
def _(t):
    return rounded(T.threshold_for_ppv(scored(t), ["yr"], 0.34, "inf"), thresh=2)


@query("threshold_balance", "I16", _grid_sql("scored", 250, 1.01, "0.99") + """
select yr, round(thresh, 2) as thresh, j from x
qualify row_number() over (partition by yr order by round(power(cast(p_gt + n_gt as double) / (n1 + n0) - cast(n1 as double) / (n1 + n0), 2), 12), j) = 1""")
def _(t):
    return rounded(T.threshold_balance(scored(t), ["yr"], 250), thresh=2)


def _edges_sql(src: str, keys: str) -> str:
    return f"""edges as (select {keys}, unnest({PP}) as pp, unnest(quantile_cont(score, {PP})) as qq from {src} group by {keys})"""


PPV_SQL = f"""{SCORED_SQL}, {_edges_sql('scored', 'yr')},
bn as (select s.yr, s.y, s.score, min(e.qq) as qq from scored s join edges e on e.yr = s.yr and e.qq >= s.score and e.pp > 0 group by all),
lo as (select yr, qq as q0 from edges where pp = 0),
cnt as (select s.yr, e.pp, sum(s.y) as y1, sum(1 - s.y) as y0 from scored s
  join (select yr, pp, qq, lag(qq) over (partition by yr order by pp) as ql from edges) e
    on e.yr = s.yr and s.score <= e.qq and s.score > e.ql
  group by all),
acc as (select yr, pp, sum(y1) over (partition by yr order by pp desc) as y1, sum(y0) over (partition by yr order by pp desc) as y0,
  sum(y1) over (partition by yr) as y1tot from cnt),
ppv_t as (select a.yr, a.pp, e.qq, cast(a.y1 as double) / (a.y1 + a.y0) as ppv, cast(a.y1 as double) / y1tot as sens
  from acc a join edges e on e.yr = a.yr and e.pp = a.pp where a.pp > {PP[1]})"""


@query("ppv_by_percentile", "I17", f"""with {PPV_SQL}
select yr, pp, round(qq, 4) as qq, 'ppv' as metric, round(ppv, 6) as value from ppv_t
union all select yr, pp, round(qq, 4), 'sens', round(sens, 6) from ppv_t""")
def _(t):
    return rounded(T.ppv_by_percentile(scored(t), ["yr"], PP), qq=4)


@query("transfer_cutoffs", "I18", f"""with {CASES_SQL},
cuts as (select g, unnest([0.5, 0.7, 0.9, 0.99]) as pp, unnest(quantile_cont(score, [0.5, 0.7, 0.9, 0.99])) as qq from cases where yr < 1999 group by g),
x as (select c.g, c.pp, sum(case when s.score >= c.qq then y else 0 end) as tp, sum(case when s.score >= c.qq then 1 - y else 0 end) as fp, sum(y) as pos
  from cuts c join cases s on s.g = c.g and s.yr >= 1999 group by all)
select g, pp, round(case when tp > 0 then cast(tp as double) / (tp + fp) end, 6) as ppv, round(cast(tp as double) / nullif(pos, 0), 6) as sens from x""")
def _(t):
    from ..operators.ordered import exact_quantiles
    c = cases(t)
    cuts = exact_quantiles(c.filter("yr < 1999"), ["g"], "score", [0.5, 0.7, 0.9, 0.99], "pp", "qq")
    return rounded(T.transfer_cutoffs(c.filter("yr >= 1999"), cuts, ["g"], "pp", "qq"))


LOOKUP_SQL = f"""{SCORED_SQL}, lk as (select s.*, n_name, r_name from scored s join supplier on s_suppkey = g
  join nation on n_nationkey = s_nationkey join region on r_regionkey = n_regionkey)"""


def looked_up(t):
    dim = (t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
           .join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
           .select(F.col("s_suppkey").alias("g"), "n_name", "r_name"))
    return dim


@query("auc_by_annotation", "I19", f"""with {LOOKUP_SQL},
lkl as (select yr, y, score, 'nation' as lvl, n_name as val from lk union all select yr, y, score, 'region', r_name from lk),
{sql_auc('lkl', 'yr, lvl, val')}
select yr, lvl, val, n1, n0, round(auc, 6) as auc from auc_t""")
def _(t):
    dim = looked_up(t).unpivot(["g"], ["n_name", "r_name"], "lvl", "val").withColumn(
        "lvl", F.when(F.col("lvl") == "n_name", "nation").otherwise("region"))
    return rounded(R.auc_by_lookup(scored(t), dim, ["g"], ["yr", "lvl", "val"]).drop("num", "den"))


@query("gain_share", "I20", f"""with {SCORED_SQL},
rates as (select g, avg(cast(y as double)) as rate from scored where yr < 1999 group by g),
te as (select s.yr, s.y, s.score, r.rate from scored s join rates r on r.g = s.g where s.yr >= 1999),
{sql_auc('te', 'yr', 'a_all')}, {sql_auc('te', 'yr', 'a_grp', 'round(rate, 9)')}
select a.yr, round(a.auc, 6) as auc_all, round(b.auc, 6) as auc_group,
  round(greatest(0.0::double, 1 - (b.auc - 0.5) / nullif(a.auc - 0.5, 0)), 4) as gain
from a_all a join a_grp b on b.yr = a.yr""")
def _(t):
    s = scored(t)
    rates = s.filter("yr < 1999").groupBy("g").agg(F.round(F.avg(F.col("y").cast("double")), 9).alias("rate"))
    te = s.filter("yr >= 1999").join(rates, "g")
    a = R.auc(te, ["yr"]).select("yr", F.col("auc").alias("auc_all"))
    b = R.auc(te, ["yr"], s="rate").select("yr", F.col("auc").alias("auc_group"))
    return rounded(a.join(b, "yr").withColumn("gain", R.gain_share(F.col("auc_all"), F.col("auc_group"))), gain=4)


@query("select_best", "I21", f"""with {MULTI_SQL}, {sql_decompose('multi', 'model, outcome, version, method', 'grp', 'dec', 'preds')},
w as (select * from dec where tt = 'within' and method = 'agg'),
bo as (select outcome, version, method from (select outcome, version, method, avg(auc) as m from w group by all)
  qualify row_number() over (partition by outcome order by -round(m, 12), version, method) = 1),
bm as (select w.outcome, w.version, w.method, w.model, sum(auc * den) / sum(den) as auc from w join bo using (outcome, version, method) group by all)
select outcome, cast(version as bigint) as version, method, model, round(auc, 6) as auc from bm
qualify row_number() over (partition by outcome, version, method order by -round(auc, 12), model) = 1""")
def _(t):
    d = R.auc_decompose(multi_wide(t), MULTI_KEYS, "grp", cells=MULTI_CELLS)
    return rounded(R.select_best(d.filter("tt = 'within' and method = 'agg'")))


@query("match_coverage", "I22", f"""with {CASES_SQL},
sub as (select distinct yr, st, caseid from cases where g in ('1-URGENT', '2-HIGH')),
m as (select c.* from cases c where exists (select 1 from sub s where s.yr = c.yr and s.st = c.st and s.caseid = c.caseid)),
{sql_auc('m', 'yr')}
select yr, n1, n0, round(auc, 6) as auc from auc_t""")
def _(t):
    c = cases(t)
    sub = c.filter(F.col("g").isin("1-URGENT", "2-HIGH"))
    return rounded(R.auc(R.match_coverage(c, sub, ["yr", "st", "caseid"]), ["yr"]).drop("num", "den"))


@query("oos_gap", "I23", f"""with {SCORED_SQL},
tg as (select case when yr < 1999 then 'train' else 'test' end as part, g, y, score from scored),
{sql_decompose('tg', 'part', 'g')}
select tt, round(max(case when part = 'train' then auc end), 6) as train, round(max(case when part = 'test' then auc end), 6) as test,
  round(max(case when part = 'train' then auc end) - max(case when part = 'test' then auc end), 6) as gap from dec group by tt""")
def _(t):
    tg = scored(t).withColumn("part", F.when(F.col("yr") < 1999, "train").otherwise("test"))
    d = R.auc_decompose(tg, ["part"], "g").groupBy("tt").agg(
        F.max(F.when(F.col("part") == "train", F.col("auc"))).alias("train"),
        F.max(F.when(F.col("part") == "test", F.col("auc"))).alias("test"))
    return rounded(d.withColumn("gap", F.col("train") - F.col("test")))


@query("auc_group_mean", "I24", f"""with {SCORED_SQL}, {sql_auc('scored', 'yr, g')}
select yr, round(avg(auc), 6) as auc_mean, round(sum(auc * n1) / sum(n1), 6) as auc_weighted, count(*) as groups
from auc_t where n1 > 0 and auc is not null group by yr""")
def _(t):
    return rounded(R.auc_group_mean(R.auc_by_group(scored(t), ["yr"], "g"), ["yr"]))


@query("compare_models", "I25", f"""with {MULTI_SQL}, {sql_auc('multi', 'outcome, version, method, model', s='preds')}
select outcome, cast(version as bigint) as version, m.mdl, round(case m.mdl when 'agg_logit' then max(case when method = 'agg' and model = 'logit' then auc end)
   when 'agg_gbt' then max(case when method = 'agg' and model = 'gbt' then auc end)
   else max(case when method = 'sub' and model = 'logit' then auc end) end, 6) as auc
from auc_t cross join (values ('agg_logit'), ('agg_gbt'), ('sub_logit')) as m(mdl) group by outcome, version, m.mdl""")
def _(t):
    a = R.auc(multi(t), ["outcome", "version", "method", "model"], "y", "preds")
    a = a.withColumn("mdl", F.concat_ws("_", "method", "model"))
    wide = a.groupBy("outcome", "version").pivot("mdl", ["agg_logit", "agg_gbt", "sub_logit"]).agg(F.max("auc"))
    return rounded(wide.unpivot(["outcome", "version"], ["agg_logit", "agg_gbt", "sub_logit"], "mdl", "auc"))
