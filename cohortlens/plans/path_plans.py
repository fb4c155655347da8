"""Registered queries of the penalised paths (L13, L17, L26) with their oracles: coordinate descent as a recursive CTE."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..operators import impute as Im, paths as P, ranking as R
from .model_plans import MODEL_SQL, model_table
from .registry import query, rounded

#: Numeric features of the paths; none is a combination of the others.
XS = ["x1", "x2", "x3", "urgent", "x4"]
FOLDS, COUNT, RATIO = 5, 100, 0.001
N = range(1, len(XS) + 1)

ROWS_SQL = f"""{MODEL_SQL}, d as (select caseid, cast(caseid % {FOLDS} as int) as f, cast(y as double) as y, yr,
  [x1, x2, x3, case when g = '1-URGENT' then 1.0 else 0.0 end, c_nationkey / 10.0]::double[] as x from mt where yr < 2000)"""


def path_rows(t):
    d = model_table(t).filter("yr < 2000")
    return d.withColumn("urgent", (F.col("g") == "1-URGENT").cast("double")).withColumn("x4", F.col("c_nationkey") / 10.0).withColumn("f", F.col("caseid") % FOLDS)


def _sums(source: str, key: str) -> str:
    xx = ", ".join("[" + ", ".join(f"sum(x[{i}] * x[{j}])" for j in N) + "]" for i in N)
    return (f"select {key}, cast(count(*) as double) as n, sum(y) as sy, sum(y * y) as syy, [{', '.join(f'sum(x[{i}])' for i in N)}] as sx, "
            f"[{', '.join(f'sum(x[{i}] * y)' for i in N)}] as sxy, [{xx}] as sxx from {source} group by {key}")


def _descent(holds: str, sweeps: int) -> str:
    """CTEs from d: co(h, k, lam, b1.., b0): coefficients on the original scale of penalty k without fold h (-1: all folds)."""
    soft = lambda i: f"sign(z{i}) * greatest(abs(z{i}) - lam, 0) / q[{i}][{i}]"
    step = "(select o.h, o.k, o.lam, q, c, t, " + ", ".join(f"b{i}" for i in N) + " from o join st using (h))"
    for i in N:
        z = f"c[{i}] - ({' + '.join(f'q[{i}][{j}] * b{j}' for j in N if j != i)})"
        step = f"(select * exclude (b{i}, z{i}), {soft(i)} as b{i} from (select *, {z} as z{i} from {step}))"
    var = [f"(sxx[{i}][{i}] / n - (sx[{i}] / n) * (sx[{i}] / n))" for i in N]
    q = ", ".join("[" + ", ".join(f"(sxx[{i}][{j}] / n - (sx[{i}] / n) * (sx[{j}] / n)) / (sd[{i}] * sd[{j}])" for j in N) + "]" for i in N)
    c = ", ".join(f"(sxy[{i}] / n - (sx[{i}] / n) * (sy / n)) / sd[{i}]" for i in N)
    return f"""tr as ({_sums(f"(select h, d.* from d, (select unnest({holds}) as h) where f <> h)", "h")}),
sc as (select *, [{', '.join(f'sqrt({v})' for v in var)}] as sd from tr),
st as (select h, n, sy, sx, sd, [{q}] as q, [{c}] as c from sc),
grid as (select k, exp(ln(lmax) + k * ln({RATIO}) / {COUNT - 1}) as lam from (select list_max(list_transform(c, lambda v: abs(v))) as lmax from st where h = -1), (select unnest(range({COUNT})) as k)),
o as (select h, k, lam, 0 as t, {', '.join(f'0.0::double as b{i}' for i in N)} from st, grid
  union all select h, k, lam, t + 1, {', '.join(f'b{i}' for i in N)} from {step} where t < {sweeps}),
co as (select h, k, lam, {', '.join(f'b{i} / sd[{i}] as b{i}' for i in N)}, (sy - ({' + '.join(f'b{i} / sd[{i}] * sx[{i}]' for i in N)})) / n as b0 from o join st using (h) where t = {sweeps})"""


def _error(b: str = "co", s: str = "te") -> str:
    """Sum of squared residuals from sums ``s`` under coefficients ``b``."""
    lin = " + ".join([f"{b}.b0 * {s}.sy", *(f"{b}.b{i} * {s}.sxy[{i}]" for i in N)])
    quad = " + ".join([f"{b}.b0 * {b}.b0 * {s}.n", *(f"2 * {b}.b0 * {b}.b{i} * {s}.sx[{i}]" for i in N), *(f"{b}.b{i} * {b}.b{j} * {s}.sxx[{i}][{j}]" for i in N for j in N)])
    return f"{s}.syy - 2 * ({lin}) + ({quad})"


PATH_SQL = f"""with recursive {ROWS_SQL}, {_descent(f"range(-1, {FOLDS})", 120)},
te as ({_sums("d", "f")}),
er as (select k, h, ({_error()}) / te.n as e from co join te on te.f = co.h),
cv as (select k, avg(e) as error, stddev_samp(e) / sqrt({FOLDS}::double) as se from er group by k),
be as (select error + se as bound from cv qualify row_number() over (order by error, k) = 1)
select cast(cv.k as bigint) as k, round(lam, 6) as lambda, round(error, 6) as error, round(se, 6) as se, cast({' + '.join(f'(abs(b{i}) > 1e-9)::int' for i in N)} as bigint) as nonzero,
  cast((cv.k = (select min(k) from cv, be where error <= bound))::int as bigint) as chosen, {', '.join(f'round(b{i}, 5) as b_{x}' for i, x in zip(N, XS))}, round(b0, 5) as b_0
from cv join co on co.k = cv.k and co.h = -1"""


@query("lasso_path_cv", "L13", PATH_SQL)
def _(t):
    """100 penalties on 5 folds and all rows: errors, choice within one standard error, coefficients."""
    rows = path_rows(t)
    path = P.lasso_cv(rows, XS, "y", "f", count=COUNT, ratio=RATIO)
    out = [(k, float(path.lambdas[k]), float(path.error[k]), float(path.se[k]), int((abs(path.coefs[k, 1:]) > 1e-9).sum()), int(k == path.chosen), *map(float, path.coefs[k, 1:]), float(path.coefs[k, 0]))
           for k in range(len(path.lambdas))]
    names = ["k", "lambda", "error", "se", "nonzero", "chosen", *(f"b_{x}" for x in XS), "b_0"]
    kinds = ", ".join(f"{n} {'bigint' if n in ('k', 'nonzero', 'chosen') else 'double'}" for n in names)
    return rounded(rows.sparkSession.createDataFrame(out, kinds), 6, **{n: 5 for n in names if n.startswith("b_")})


TARGET = 20.0
STOP_SQL = f"""with recursive {ROWS_SQL}, {_descent("[-1]", 120)},
te as ({_sums("(select 0 as one, d.* from d)", "one")}),
s as (select k, lam, (select n from te) * lam / sqrt({_error()}) as stat, {', '.join(f'abs(b{i}) > 1e-9 as on{i}' for i in N)} from co, te),
hit as (select min(k) as k from s where stat < {TARGET} and ({' or '.join(f'on{i}' for i in N)}))
select cast(s.k as bigint) as k, round(lam, 6) as lambda, round(stat, 4) as statistic, case when s.k = hit.k then 'target' else '' end as rule,
  case when s.k = hit.k then concat_ws(',', {', '.join(f"case when on{i} then '{x}' end" for i, x in zip(N, XS))}) else '' end as support
from s, hit where s.k <= hit.k"""


@query("sqrt_lasso_stop", "L17", STOP_SQL)
def _(t):
    """The penalties tried until the stopping rule fires, and what it keeps."""
    rows = path_rows(t)
    s = P.sqrt_lasso_stop(rows, XS, "y", TARGET, count=COUNT, ratio=RATIO)
    last = len(s.lambdas) - 1
    out = [(k, float(s.lambdas[k]), float(s.statistic[k]), s.rule if k == last else "", ",".join(s.names) if k == last else "") for k in range(last + 1)]
    return rounded(rows.sparkSession.createDataFrame(out, "k bigint, lambda double, statistic double, rule string, support string"), 6, statistic=4)


RIDGE_SQL = f"""with {MODEL_SQL}, d as (select case when yr < 1999 then 0 else 1 end as part, x1 as a, x2 as b, y::double as y from mt where yr <= 2000),
s as (select count(*)::double as n, avg(a) as ma, avg(b) as mb, avg(y) as my, var_pop(a) as va, var_pop(b) as vb, covar_pop(a, b) as ab, covar_pop(a, y) as ay, covar_pop(b, y) as cy,
  greatest(abs(avg(y)), abs(avg(a * y)), abs(avg(b * y))) / 0.1 as top from d where part = 0),
g as (select 0 as k, 0.0::double as lam union all select k + 1, exp(ln(0.01) + k * (ln(top) - ln(0.01)) / 99) from s, range(100) as r(k)),
w as (select k, lam, ((vb * (1 + lam)) * ay - ab * cy) / ((va * (1 + lam)) * (vb * (1 + lam)) - ab * ab) as wa, ((va * (1 + lam)) * cy - ab * ay) / ((va * (1 + lam)) * (vb * (1 + lam)) - ab * ab) as wb, ma, mb, my from g, s),
r as (select k, any_value(lam) as lam, any_value(wa) as wa, any_value(wb) as wb, 1 - sum(power(y - my - wa * (a - ma) - wb * (b - mb), 2)) / (count(*) * var_pop(y)) as r2 from d, w where part = 1 group by k),
h as (select *, coalesce(r2 < lag(r2) over (order by k), false) as fell from r),
e as (select coalesce(min(k) filter (fell), 100) as stop, count(*) filter (fell) as falls from h)
select cast(k as bigint) as k, round(lam, 6) as lambda, round(r2, 6) as r2, cast((k = stop - (falls > 0)::int)::int as bigint) as taken, round(wa, 5) as w_x1, round(wb, 5) as w_x2 from h, e where k <= stop"""


@query("ridge_tune", "L11", RIDGE_SQL)
def _(t):
    """The penalties tried on later years, and the one taken."""
    d = model_table(t).filter("yr <= 2000").withColumn("part", (F.col("yr") >= 1999).cast("int"))
    _, beta, history = P.ridge_tune(d, ["x1", "x2"], "y", "part")
    fell = len(history) > 1 and history[-1][1] < history[-2][1]
    parts = P.fold_moments(d, P.Design(("x1", "x2")), "y", "part")[0]
    scale = np.diag(parts.xx) / parts.n - (parts.xx[0] / parts.n) ** 2
    out = []
    for k, (lam, r2) in enumerate(history):
        w = np.linalg.solve(parts.xx / parts.n + lam * np.diag(scale), parts.xy / parts.n)
        out.append((k, lam, r2, int(k == len(history) - 1 - fell), float(w[1]), float(w[2])))
    return rounded(d.sparkSession.createDataFrame(out, "k bigint, lambda double, r2 double, taken bigint, w_x1 double, w_x2 double"), 6, w_x1=5, w_x2=5)


@query("lasso_path_mixed", "L13")
def _(t):
    """A path over numbers and one-hot levels, scored on later years."""
    train, test = path_rows(t), model_table(t).filter("yr >= 2000")
    path = P.lasso_cv(train, ["x1", "x2", "x3"], "y", "f", ["g", "seg", "st"])
    scored = path.predict(test, "preds")
    a = R.auc(scored, ["g"], "y", "preds").select("g", "n1", "n0", "auc")
    return rounded(a.withColumn("lambda", F.lit(float(path.lambdas[path.chosen]))).withColumn("nonzero", F.lit(int((path.coefs[path.chosen, 1:] != 0).sum()))), 4)


@query("lasso_impute", "L26")
def _(t):
    """Numeric and 0/1 columns filled from numbers and levels, with R-squared and AUROC on rows held out."""
    d = model_table(t).withColumn("v", (F.col("x1") * 2 + F.col("x2") + F.when(F.col("g") == "1-URGENT", 1.0).otherwise(0.0))).withColumn("f", F.col("caseid") % 5)
    train, target = d.filter("yr < 2000"), d.filter("yr >= 2000").withColumn("truth", F.col("v")).withColumn("was", F.col("y"))
    cats, nums = ["g", "seg"], ["x1", "x3"]
    filled, quality = Im.lasso_impute(train, target.withColumn("v", F.when(F.col("caseid") % 4 != 0, F.col("v"))), nums, cats, "v", "f", "caseid")
    binary, auroc = Im.lasso_impute(train, target.withColumn("y", F.lit(None).cast("bigint")), nums, cats, "y", "f", "caseid", binary=True)
    one = filled.agg(F.count("v").alias("n"), F.corr("v", "truth").alias("agreement")).withColumn("col", F.lit("v")).join(quality, "col")
    two = binary.agg(F.count("y").alias("n"), F.avg((F.col("y") == F.col("was")).cast("double")).alias("agreement")).withColumn("col", F.lit("y")).join(auroc, "col")
    return rounded(one.unionByName(two), 4)
