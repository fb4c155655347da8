"""Registered queries of count tables (L22 to L24) with their oracles."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import class_tables as Ct, impute as Im
from .model_plans import MODEL_SQL, X, model_table, partly
from .registry import query, rounded, sql_auc

CATS = ["g", "seg", "yrs", "hold"]
WITH_CATS = "select *, yr::varchar as yrs, (caseid % 4)::varchar as hold from mt"


def with_cats(t):
    return model_table(t).withColumn("yrs", F.col("yr").cast("string")).withColumn("hold", (F.col("caseid") % 4).cast("string"))


def _grid(src: str, keys: str, num: int, hi: str) -> str:
    """CTE x: counts of ``src``(keys, y, score) at or above each threshold of an even grid."""
    return f"""h as (select {keys}, score, sum(y) as p, sum(1 - y) as n from {src} group by all),
sp as (select {keys}, min(case when p > 0 then score end) * 0.99 as lo, max(case when p > 0 then score end) * {hi} as hi, sum(p) as n1, sum(n) as n0 from h group by {keys} having sum(p) > 0),
gr as (select {keys}, n1, n0, i as j, lo + i * ((hi - lo) / {num - 1}) as thresh from sp, range({num}) as r(i)),
x as (select {keys}, gr.j, gr.thresh, n1, n0, sum(case when score > thresh then p else 0 end) as p_gt, sum(case when score > thresh then n else 0 end) as n_gt,
  sum(case when score >= thresh then p else 0 end) as p_ge, sum(case when score >= thresh then n else 0 end) as n_ge from gr join h using ({keys}) group by all)"""


def _long(src: str, ids: str, cats=CATS) -> str:
    return " union all ".join(f"select {ids}, '{c}' as name, {c} as level from {src}" for c in cats)


@query("impute_classes", "L24", f"""with {MODEL_SQL}, d as (select *, case when caseid % 5 <> 0 then st end as v from ({WITH_CATS})),
cl as (select v as k, count(*)::double as n, sum(count(*)) over () as tot from d where v is not null group by v),
cn as (select name, level, v as k, count(*)::double as c from ({_long('(select * from d where v is not null)', 'v')}) group by all),
tb as (select l.name, l.level, cl.k, (coalesce(c, 0) + 1) / (n + 2) as p from (select distinct name, level from cn) l cross join cl left join cn on cn.name = l.name and cn.level = l.level and cn.k = cl.k),
ba as (select cl.k, any_value(ln(n / tot)) + sum(ln(1 - p)) as b from cl join tb using (k) group by cl.k),
sc as (select caseid, k, any_value(b) + sum(ln(p / (1 - p))) as eta from ({_long('d', 'caseid')}) join tb using (name, level) join ba using (k) group by caseid, k),
po as (select caseid, k, round(exp(eta - max(eta) over w) / sum(exp(eta)) over w * exp(max(eta) over w), 9) as p from sc window w as (partition by caseid)),
src as (select k, (v = k)::int as y, p as score from po join d using (caseid) where v is not null and k <> (select min(k) from cl)),
{_grid('src', 'k', 250, '1.01')},
th as (select k, thresh from x qualify row_number() over (partition by k order by round(power(cast(p_gt + n_gt as double) / (n1 + n0) - cast(n1 as double) / (n1 + n0), 2), 12), j) = 1),
pk as (select caseid, k, p - thresh as m from po join th using (k) qualify row_number() over (partition by caseid order by p - thresh desc, k desc) = 1)
select st as truth, coalesce(v, case when m > 0 then k else (select min(k) from cl) end) as v, cast(v is null as bigint) as filled, count(*) as n from d join pk using (caseid) group by all""")
def _(t):
    """One model of all classes for a column with a fifth of its values missing."""
    d = with_cats(t).withColumn("v", F.when(F.col("caseid") % 5 != 0, F.col("st"))).withColumn("filled", F.col("v").isNull().cast("bigint"))
    out = Ct.impute_classes(d, "v", CATS)
    return rounded(out.groupBy(F.col("st").alias("truth"), "v", "filled").agg(F.count(F.lit(1)).alias("n")))


GATED = {"y": "y", "open_": "(st = 'O')::int", "rare": "(x1 > 4.5 and caseid % 2 = 0)::int"}


@query("gate_columns", "L23", f"""with {MODEL_SQL}, d as ({WITH_CATS}),
r as ({' union all '.join(f"select caseid, yr as t, {', '.join(CATS)}, '{c}' as col, {e} as y from d" for c, e in GATED.items())}),
si as (select col, t, sum(y) as n1, sum(1 - y) as n0 from r group by all),
be as (select a.col, a.t as fold, sum(b.n1)::double as n1, sum(b.n0)::double as n0 from si a join si b on a.col = b.col and b.t < a.t group by all having sum(b.n1) > 0 and sum(b.n0) > 0),
ln_ as ({_long('r', 'col, t, caseid, y')}),
cn as (select col, name, level, t, sum(y) as c1, sum(1 - y) as c0 from ln_ group by all),
tb as (select cn.col, fold, name, level, (sum(c1) + 1) / (max(n1) + 2) as p1, (sum(c0) + 1) / (max(n0) + 2) as p0 from cn join be on be.col = cn.col and t < fold group by all),
ba as (select be.col, be.fold as t, any_value(ln(n1 / n0)) + sum(ln(1 - p1) - ln(1 - p0)) as base from be join tb on tb.col = be.col and tb.fold = be.fold group by all),
on_ as (select l.col, l.t, caseid, sum(ln(p1 / (1 - p1)) - ln(p0 / (1 - p0))) as eta from ln_ l join tb on tb.col = l.col and tb.fold = l.t and tb.name = l.name and tb.level = l.level group by all),
src as (select r.col, r.t, r.y, round(1 / (1 + exp(-(base + coalesce(eta, 0)))), 9) as score from r join ba using (col, t) left join on_ using (col, t, caseid)),
{_grid('src', 'col, t', 200, '0.99')}, {sql_auc('src', 'col, t')},
gm as (select col, t, avg(cast(p_gt as double) / n1) as recall, avg(cast(p_ge as double) / nullif(p_ge + n_ge, 0)) as prec from x group by all),
me as (select col as name, avg(auc) as auc, avg(prec) as prec, avg(recall) as recall from auc_t join gm using (col, t) group by col)
select name, round(auc, 5) as auc, round(prec, 5) as "precision", round(recall, 5) as recall, cast((prec > 0.1 and recall > 0.2)::int as bigint) as impute from me""")
def _(t):
    """Three columns, every year after the first, one pass."""
    d = with_cats(t).withColumn("open_", (F.col("st") == "O").cast("int")).withColumn("rare", ((F.col("x1") > 4.5) & (F.col("caseid") % 2 == 0)).cast("int"))
    return rounded(Ct.gate_columns(d, list(GATED), "yr", CATS, "caseid"), 5)


@query("impute_quality_by_year", "L22")
def _(t):
    """AUROC and R-squared with bounds for each year and for all."""
    _, binary = Im.impute_binary(partly(t), "v", ["g", "seg"], X, "caseid", reps=20, period="yr")
    d = model_table(t).withColumn("v", F.when(F.col("caseid") % 6 != 0, F.col("x1") * 2 + F.col("x2")))
    _, numeric = Im.impute_numeric(d, "v", ["g", "seg"], X, "caseid", reps=20, period="yr")
    return rounded(binary.withColumn("metric", F.lit("auc")).unionByName(numeric.withColumn("metric", F.lit("r2"))), 4)
