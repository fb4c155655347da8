"""Registered queries of section 2.L: model fits and imputation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..operators import features as K, impute as Im, inference as I, models as M, monitor as Mo, paths as P, ranking as R, windows as W
from ..session import cut_lineage
from ..streaming.monitor_stream import work_folder
from .clean_plans import DIRTY_SQL, dirty
from .inference_plans import sql_norm_cdf
from .registry import MULTI_SQL, SCORED_SQL, multi, query, rounded, scored, sql_auc, sql_logit

X = ["x1", "x2", "x3"]

MODEL_SQL = """mt as (select o_orderkey as caseid, cast(year(o_orderdate) as bigint) as yr, o_orderpriority as g, c_mktsegment as seg, o_orderstatus as st, c_nationkey,
  o_totalprice / 1e5 as x1, c_acctbal / 3000 as x2, cast((o_custkey % 10) / 5.0 as double) as x3,
  cast(case when o_totalprice / 1e5 + c_acctbal / 3000 + ((o_orderkey * 37) % 101) / 20.0 + (case when o_orderpriority = '1-URGENT' then 1.0 else 0 end) > 7.5 then 1 else 0 end as bigint) as y
  from orders join customer on c_custkey = o_custkey)"""


def model_table(t):
    """Cases with three numeric features and a planted label (x1, x2 and the urgent group carry signal)."""
    d = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    signal = (F.col("o_totalprice") / 1e5 + F.col("c_acctbal") / 3000 + ((F.col("o_orderkey") * 37) % 101) / 20.0
              + F.when(F.col("o_orderpriority") == "1-URGENT", 1.0).otherwise(0.0))
    return d.select(F.col("o_orderkey").alias("caseid"), F.year("o_orderdate").cast("bigint").alias("yr"), F.col("o_orderpriority").alias("g"),
                    F.col("c_mktsegment").alias("seg"), F.col("o_orderstatus").alias("st"), "c_nationkey", (F.col("o_totalprice") / 1e5).alias("x1"),
                    (F.col("c_acctbal") / 3000).alias("x2"), ((F.col("o_custkey") % 10) / 5.0).alias("x3"), (signal > 7.5).cast("bigint").alias("y"))


def split(t):
    d = model_table(t)
    return d.filter("yr < 2000"), d.filter("yr >= 2000")


def _auc_of(df, kind, preds="preds"):
    a = R.auc(df, ["g"], "y", preds).select("g", "n1", "n0", "auc")
    return rounded(a.withColumn("model", F.lit(kind)), 4)


@query("fit_logistic", "L1,L19")
def _(t):
    train, test = split(t)
    return _auc_of(M.score(M.fit_logistic(train, X), test), "logit")


@query("fit_forest", "L2")
def _(t):
    train, test = split(t)
    return _auc_of(M.score(M.fit_forest(train, X, depth=4, trees=10), test), "rf")


@query("fit_boosted", "L3")
def _(t):
    train, test = split(t)
    return _auc_of(M.score(M.fit_boosted(train, X, depth=3, rounds=5), test), "gbt")


def _folds_of(d):
    """The folds that expanding_folds made, a few."""
    return [r[0] for r in d.select("fold").distinct().orderBy("fold").collect()]


@query("fit_folds", "L4")
def _(t):
    d = model_table(t)
    folds = K.expanding_folds(d, "yr", "y").withColumn("urgent", (F.col("g") == "1-URGENT").cast("bigint"))
    tests, _ = M.fit_folds(folds, _folds_of(folds), ["y"], X)
    return rounded(R.auc(tests, ["outcome", "fold", "model", "method"], "y", "preds").drop("num"), 4)


@query("fit_by_group", "L5")
def _(t):
    d = K.expanding_folds(model_table(t), "yr", "y")
    s = M.fit_by_group(d, ["g"], X)
    return rounded(R.auc(s, ["fold", "g", "method"], "y", "preds").drop("num", "den"), 4)


@query("fit_by_risk_bin", "L6")
def _(t):
    d = K.expanding_folds(model_table(t), "yr", "y")
    rate = d.filter("role = 'train'").groupBy("fold", "c_nationkey").agg(
        (F.avg(F.col("y").cast("double")) + F.max("c_nationkey") * 1e-9).alias("rate"))
    bins = reduce(DataFrame.unionByName, [W.quantile_bins(rate.filter(F.col("fold") == k), "c_nationkey", "rate", 5).select("fold", "c_nationkey", "bin") for k in _folds_of(d)])
    s = M.fit_by_group(d.join(bins, ["fold", "c_nationkey"]), ["bin"], X)
    return rounded(R.auc(s, ["fold", "bin"], "y", "preds").drop("num", "den"), 4)


@query("fit_by_annotation", "L6")
def _(t):
    n = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    d = K.expanding_folds(model_table(t).join(n, "c_nationkey"), "yr", "y")
    s = M.fit_by_group(d, ["r_name"], X)
    return rounded(R.auc(s, ["fold", "r_name"], "y", "preds").drop("num", "den"), 4)


@query("grid_search", "L7")
def _(t):
    train, test = split(t)
    folds = K.kfold(train, 3, ["y"], "caseid", 5)
    model, metrics = M.grid_search(folds, X, "fold", [0.001, 0.1, 10.0], 3)
    best = max(metrics, key=lambda m: m[1])
    return _auc_of(M.score(model, test), "logit").withColumn("reg", F.lit(best[0]))


GRID = [0.001, 0.1, 10.0]


@query("grid_search_table", "L7", f"""with recursive {MODEL_SQL}, d as (select *, caseid % 3 as f from mt where yr < 2000),
tr as (select h, d.* from d, (select unnest([0, 1, 2]) as h) where f <> h),
mo as (select h, {', '.join(f'avg({x}) as m_{x}, stddev_samp({x}) as s_{x}' for x in X)} from tr group by h),
dx as materialized (select h, reg, y, [1.0, {', '.join(f'({x} - m_{x}) / s_{x}' for x in X)}]::double[] as x from tr join mo using (h), (select unnest({GRID}) as reg)),
{sql_logit('lo', 'dx', 'h, reg', 4, 'reg * n', 200, 0.5)},
sc as (select h, reg, y, list_dot_product(b, [1.0, {', '.join(f'({x} - m_{x}) / s_{x}' for x in X)}]::double[]) as preds from d join mo on d.f = mo.h join lo using (h)), {sql_auc('sc', 'h, reg', s='preds')}
select reg, round(avg(auc), 4) as auc, cast((row_number() over (order by avg(auc) desc) = 1)::int as bigint) as best from auc_t group by reg""")
def _(t):
    """Mean AUROC over three folds of each penalty."""
    train = model_table(t).filter("yr < 2000").withColumn("fold", F.col("caseid") % 3)
    _, metrics = M.grid_search(train, X, "fold", GRID, 3)
    top = max(m for _, m in metrics)
    return rounded(train.sparkSession.createDataFrame([(r, float(m), int(m == top)) for r, m in metrics], "reg double, auc double, best bigint").withColumn("auc", F.round("auc", 4)))


@query("best_params", "L8", f"""with {MULTI_SQL}, {sql_auc('multi', 'outcome, version, test_year, method, model', s='preds')}
select outcome, cast(version as bigint) as version, test_year, method, model, round(auc, 6) as auc from auc_t
qualify row_number() over (partition by outcome, version, test_year order by -round(auc, 12), method, model) = 1""")
def _(t):
    v = R.auc(multi(t), ["outcome", "version", "test_year", "method", "model"], "y", "preds")
    return rounded(M.best_params(v, ["outcome", "version", "test_year"], ["method", "model"]))


@query("naive_bayes_group", "L9", f"""with {MODEL_SQL}, tr as (select * from mt where yr < 2000), k as (select cast(sum(y) as double) as k1, cast(sum(1 - y) as double) as k0 from tr),
p as (select g, (sum(y) + 1) / (max(k1) + 2) as p1, (sum(1 - y) + 1) / (max(k0) + 2) as p0 from tr, k group by g),
b as (select sum(ln(1 - p1) - ln(1 - p0)) as off from p),
e as (select m.caseid, ln(k1 / k0) + off + ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) as eta from mt m join p using (g), k, b where m.yr >= 2000)
select caseid, round(1 / (1 + exp(-eta)), 6) as phat from e""")
def _(t):
    train, test = split(t)
    table, tot = M.bernoulli_table(train, ["g"])
    return rounded(M.bernoulli_scores(test.select("caseid", "g"), table, tot, ["g"], "phat").select("caseid", "phat"))


@query("naive_bayes_stack", "L9")
def _(t):
    train, test = split(t)
    return _auc_of(M.naive_bayes_stack(train, test, ["g", "seg", "st"], X), "nb")


UNI_SQL = f"""{MODEL_SQL}, tr as (select * from mt where yr < 2000),
ds as (select 'g=' || g as name, 1.0::double as x, y from tr union all select 'seg=' || seg, 1.0, y from tr union all select 'x1', x1, y from tr union all select 'x2', x2, y from tr union all select 'x3', x3, y from tr),
tt as (select cast(count(*) as double) as n, cast(sum(y) as double) as sy, cast(sum(y * y) as double) as syy from tr),
m as (select name, sum(x) as sx, sum(x * x) as sxx, sum(x * y) as sxy, max(n) as n, max(sy) as sy, max(syy) as syy from ds, tt group by name),
c as (select *, (n * sxy - sx * sy) / (n * sxx - sx * sx) as b1 from m), d as (select *, (sy - b1 * sx) / n as b0 from c),
f as (select *, (syy - b0 * sy - b1 * sxy) / (n - 2) as s2 from d),
r as (select *, greatest(0, 1 - s2 / (syy / n - pow(sy / n, 2))) as r2, sqrt(s2 * n / (n * sxx - sx * sx)) as se from f),
p as (select *, case when r2 > 0 then 2 * (1 - {sql_norm_cdf('abs(b1 / se)')}) else 1.0 end as pval from r),
q as (select name, b0, b1, r2, pval, row_number() over (order by pval, name) as rk, count(*) over () as m from p where r2 > 0),
z as (select name, b0, b1, r2, pval, least(1.0, min(pval * m / rk) over (order by rk desc)) as fdr from q union all select name, b0, b1, r2, pval, 1.0 from p where not r2 > 0),
uni as (select *, case when fdr < 0.1 then r2 else 0 end as weight from z)"""


@query("univariate_average", "L10", f"""with {UNI_SQL} select name, round(b0, 6) as b0, round(b1, 6) as b1, round(r2, 6) as r2, round(pval, 6) as pval, round(fdr, 6) as fdr, round(weight, 6) as weight from uni""")
def _(t):
    return rounded(M.univariate_fit(split(t)[0], ["g", "seg"], X, "y"))


@query("univariate_scores", "L10", f"""with {UNI_SQL}, w as (select sum(b0 * weight) / sum(weight) as b0 from uni),
te as (select caseid, 'g=' || g as name, 1.0::double as x from mt where yr >= 2000 union all select caseid, 'seg=' || seg, 1.0 from mt where yr >= 2000 union all select caseid, 'x1', x1 from mt where yr >= 2000
  union all select caseid, 'x2', x2 from mt where yr >= 2000 union all select caseid, 'x3', x3 from mt where yr >= 2000)
select caseid, round(sum(u.weight * (te.x * u.b1 + w.b0)) / nullif(sum(u.weight), 0), 6) as eta from te join uni u on u.name = te.name and u.weight > 0 and te.x <> 0, w group by caseid""")
def _(t):
    train, test = split(t)
    return rounded(M.univariate_scores(test.select("caseid", "g", "seg", *X), M.univariate_fit(train, ["g", "seg"], X, "y"), ["g", "seg"], X).select("caseid", "eta"))


@query("ridge_path", "L11")
def _(t):
    d = model_table(t)
    beta, history = M.ridge_path(d.filter("yr < 1999"), d.filter("yr between 1999 and 2000"), X, "y", [1e4, 1e2, 1.0, 0.0])
    s = d.filter("yr > 2000").withColumn("eta", M.linear_score(X, beta))
    return _auc_of(s, "ridge", "eta").withColumn("steps", F.lit(len(history)))


def _discriminant(t, kind, penalty=None):
    e = t("embeddings").select("vec_id", F.col("label").cast("int").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"e{i}") for i in range(64)])
    out = M.discriminant(e, e, [f"e{i}" for i in range(64)], "label", kind, penalty=penalty)
    return rounded(out.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("label")).cast("bigint")).alias("hits")))


@query("discriminant_lda", "L12")
def _(t):
    return _discriminant(t, "lda")


@query("discriminant_qda", "L12")
def _(t):
    return _discriminant(t, "qda")


@query("discriminant_qda_sparse", "L12")
def _(t):
    """Precision matrices by the graphical lasso, on all 64 components."""
    return _discriminant(t, "qda", 0.001)


def _pair_sql(kind: str) -> str:
    """Discriminant on two features in closed form."""
    cov = {"lda": "pooled", "qda": "own"}[kind]
    return f"""with {MODEL_SQL}, tr as (select * from mt where yr < 2000),
m as (select g, count(*)::double as n, avg(x1) as m1, avg(x2) as m2, covar_samp(x1, x1) as a, covar_samp(x1, x2) as b, covar_samp(x2, x2) as c from tr group by g),
t as (select sum(n) as total, sum(a * (n - 1)) / (sum(n) - count(*)) as pa, sum(b * (n - 1)) / (sum(n) - count(*)) as pb, sum(c * (n - 1)) / (sum(n) - count(*)) as pc from m),
s as (select g as cls, n, total, m1, m2, {'pa' if cov == 'pooled' else 'a'} + 1e-6 as a, {'pb' if cov == 'pooled' else 'b'} as b, {'pc' if cov == 'pooled' else 'c'} + 1e-6 as c from m, t),
d as (select caseid, mt.g, cls, ln(n / total) - 0.5 * ln(a * c - b * b) - 0.5 * (c * (x1 - m1) * (x1 - m1) - 2 * b * (x1 - m1) * (x2 - m2) + a * (x2 - m2) * (x2 - m2)) / (a * c - b * b) as logp from mt, s where yr >= 2000),
p as (select *, row_number() over (partition by caseid order by logp desc, cls desc) as k from d)
select g, count(*) as n, cast(sum((g = cls)::int) as bigint) as hits, round(avg(logp), 5) as logp from p where k = 1 group by g"""


def _pair(t, kind):
    train, test = split(t)
    out = M.discriminant(train, test, ["x1", "x2"], "g", kind)
    return rounded(out.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("pred") == F.col("g")).cast("bigint")).alias("hits"), F.avg("pred_logp").alias("logp")), 5)


@query("discriminant_lda_pair", "L12", _pair_sql("lda"))
def _(t):
    return _pair(t, "lda")


@query("discriminant_qda_pair", "L12", _pair_sql("qda"))
def _(t):
    return _pair(t, "qda")


@query("lasso_path", "L13")
def _(t):
    train, test = split(t)
    d = K.kfold(train.withColumn("y", F.col("y").cast("double")), 3, ["g"], "caseid", 5)
    path = P.lasso_cv(d, X, "y", "fold", lambdas=[0.2, 0.05, 0.01])
    s = path.predict(test, "preds")
    return _auc_of(s.select("g", "y", "preds"), "lasso").withColumn("lambda", F.lit(float(path.lambdas[path.chosen])))


@query("logit_inference", "L14")
def _(t):
    d = model_table(t)
    d = K.standardise(d, d, X)
    both = d.withColumn("bin", F.lit("all")).unionByName(d.withColumn("bin", F.col("g")))
    return rounded(M.logit_inference(both, ["bin"], X), 4)


@query("logit_inference_pair", "L14", f"""with recursive {MODEL_SQL}, st as (select avg(x1) as m, stddev_samp(x1) as s from mt),
dx as materialized (select bin, y, [1.0, (x1 - m) / s]::double[] as x from (select 'all' as bin, * from mt union all select g, * from mt), st),
{sql_logit('lo', 'dx', 'bin', 2, '0.0', 300, 0.5)},
w as (select bin, any_value(b) as b, sum(p * (1 - p)) as h11, sum(p * (1 - p) * x[2]) as h12, sum(p * (1 - p) * x[2] * x[2]) as h22
  from (select *, 1 / (1 + exp(-list_dot_product(b, x))) as p from dx join lo using (bin)) group by bin),
c as (select bin, 'intercept' as feature, b[1] as coef, sqrt(h22 / (h11 * h22 - h12 * h12)) as se from w union all select bin, 'x1', b[2], sqrt(h11 / (h11 * h22 - h12 * h12)) from w)
select bin, feature, round(coef, 5) as coef, round(se, 5) as se, round(coef / se, 4) as z, round(2 * (1 - {sql_norm_cdf('abs(coef / se)')}), 5) as pval from c""")
def _(t):
    """Coefficients and Wald p-values of one scaled feature, pooled and by bin."""
    d = model_table(t)
    d = K.standardise(d, d, ["x1"])
    both = d.withColumn("bin", F.lit("all")).unionByName(d.withColumn("bin", F.col("g")))
    return rounded(M.logit_inference(both, ["bin"], ["x1"]), 5, z=4)


def _concordance(t, scope):
    d = model_table(t)
    w, hist = M.fit_concordance(d.filter("yr < 2000"), d.filter("yr = 2000"), scope, "g", "caseid", X, [1.0, 0.001], 2000)
    s = d.filter("yr > 2000").withColumn("eta", M.linear_score(X, [0.0, *w]))
    return rounded(R.auc_decompose(s, [], "g", "y", "eta").withColumn("scope", F.lit(scope)), 3)


@query("fit_concordance_within", "L15")
def _(t):
    return _concordance(t, "within")


@query("fit_concordance_total", "L15")
def _(t):
    return _concordance(t, "total")


@query("fit_concordance_between", "L15")
def _(t):
    return _concordance(t, "between")


@query("multi_output_logit", "L16")
def _(t):
    d = model_table(t).withColumn("y2", (F.col("x1") + F.col("x3") > 4).cast("bigint"))
    s = M.multi_output_logit(d, X, ["y", "y2"], ["caseid"])
    return rounded(R.auc(s, ["label"], "y", "preds").join(s.groupBy("label").agg(F.avg("preds").alias("mean_p"), F.avg("y").alias("mean_y")), "label").drop("num", "den"), 4)


@query("multi_output_pair", "L16", f"""with recursive {MODEL_SQL}, d as (select *, cast((x1 + x3 > 4)::int as bigint) as y2 from mt),
l as (select 'y' as label, caseid, x1, x2, y from d union all select 'y2', caseid, x1, x2, y2 from d),
m as (select label, avg(x1) as m1, avg(x2) as m2, avg(y) as my, var_pop(x1) * count(*) + 1 as a, covar_pop(x1, x2) * count(*) as b, var_pop(x2) * count(*) + 1 as c, covar_pop(x1, y) * count(*) as u, covar_pop(x2, y) * count(*) as v from l group by label),
e as (select label, y, my + (x1 - m1) * (c * u - b * v) / (a * c - b * b) + (x2 - m2) * (a * v - b * u) / (a * c - b * b) as eta from l join m using (label)),
z as (select label, avg(eta) as me, stddev_pop(eta) as se from e group by label),
dx as materialized (select label, y, [1.0, (eta - me) / se]::double[] as x from e join z using (label)),
{sql_logit('lo', 'dx', 'label', 2, '0.0', 400, 0.6)},
sc as (select label, y, 1 / (1 + exp(-list_dot_product(b, x))) as preds from dx join lo using (label)), {sql_auc('sc', 'label', s='preds')}
select label, n1, n0, round(auc, 4) as auc, round(mean_p, 4) as mean_p, round(spread, 4) as spread from auc_t join (select label, avg(preds) as mean_p, stddev_pop(preds) as spread from sc group by label) using (label)""")
def _(t):
    """Two labels on shared moments of two features, each with its calibration."""
    d = model_table(t).withColumn("y2", (F.col("x1") + F.col("x3") > 4).cast("bigint"))
    s = M.multi_output_logit(d, ["x1", "x2"], ["y", "y2"], ["caseid"])
    p = s.groupBy("label").agg(F.avg("preds").alias("mean_p"), F.stddev_pop("preds").alias("spread"))
    return rounded(R.auc(s, ["label"], "y", "preds").select("label", "n1", "n0", "auc").join(p, "label"), 4)


@query("sqrt_lasso_logit", "L17")
def _(t):
    train, test = split(t)
    support, model, rule = M.sqrt_lasso_logit(train, X, "y", [0.3, 0.1, 0.03, 0.01], 3.0)
    return _auc_of(M.score(model, test), "sqrt_lasso").withColumn("support", F.lit(",".join(support))).withColumn("rule", F.lit(rule))


@query("importance_null", "L18,J20")
def _(t):
    d = cut_lineage(model_table(t).select("caseid", "y", *X))  # read by every fit
    real = M.importance(d, X, trees=8, depth=3).withColumn("k", F.lit(1))
    null = M.null_importance(d, X, "caseid", [1, 2, 3], trees=8, depth=3).withColumn("k", F.lit(1))
    return rounded(I.null_cut(real, null, ["k"], "importance", 0.95).drop("k"), 4)


@query("save_load_score", "L19")
def _(t):
    train, test = split(t)
    path = work_folder(train.sparkSession, "model")
    M.save_model(M.fit_logistic(train, X), path)
    return _auc_of(M.score(M.load_model(path), test), "logit")


IMP_SQL = """im as (select o_orderkey as caseid, cast(year(o_orderdate) as bigint) as yr, o_orderpriority as g, case when o_totalprice > 499900 then null else o_orderstatus end as few,
  case when o_custkey % 5 = 0 then null else o_orderstatus end as many, case when year(o_orderdate) = 1995 then null else o_totalprice end as bigyear from orders)"""


def imp_table(t):
    return t("orders").select(
        F.col("o_orderkey").alias("caseid"), F.year("o_orderdate").cast("bigint").alias("yr"), F.col("o_orderpriority").alias("g"),
        F.when(F.col("o_totalprice") <= 499900, F.col("o_orderstatus")).alias("few"),
        F.when(F.col("o_custkey") % 5 != 0, F.col("o_orderstatus")).alias("many"),
        F.when(F.year("o_orderdate") != 1995, F.col("o_totalprice")).alias("bigyear"))


@query("impute_mode", "L20", f"""with {IMP_SQL}, m as (select few from im where few is not null group by few order by count(*) desc, few limit 1), k as (select count(*) - count(few) as nf, count(*) - count(many) as nm from im)
select caseid, case when few is null and nf < 10 then (select few from m) else few end as few, many from im, k""")
def _(t):
    return Im.impute_mode(imp_table(t).select("caseid", "few", "many"), ["few", "many"])


@query("classify_missing", "L21", f"""with {IMP_SQL}, p as (select 'few' as name, yr, avg((few is null)::int) as s from im group by yr union all select 'many', yr, avg((many is null)::int) from im group by yr
  union all select 'bigyear', yr, avg((bigyear is null)::int) from im group by yr union all select 'g', yr, avg((g is null)::int) from im group by yr)
select name, round(max(s), 6) as worst, case when max(s) = 0 then 'complete' when max(s) < 1 then 'partial' else 'year' end as kind from p group by name""")
def _(t):
    return rounded(Im.classify_missing(imp_table(t), "yr", ["few", "many", "bigyear", "g"]))


def partly(t):
    return model_table(t).withColumn("v", F.when(F.col("caseid") % 6 != 0, F.col("y")).cast("int"))


@query("impute_binary_model", "L22")
def _(t):
    filled, quality = Im.impute_binary(partly(t), "v", ["g", "seg"], X, "caseid", reps=10)
    return rounded(filled.groupBy("v").agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("v") == F.col("y")).cast("double")).alias("hit"))
                   .withColumn("k", F.lit(1)).join(quality.withColumn("k", F.lit(1)), "k").drop("k"), 4)


@query("impute_numeric_model", "L22")
def _(t):
    d = model_table(t).withColumn("v", F.when(F.col("caseid") % 6 != 0, F.col("x1") * 2 + F.col("x2")))
    filled, quality = Im.impute_numeric(d, "v", ["g", "seg"], X, "caseid", reps=10)
    return rounded(filled.agg(F.count("v").alias("n"), F.corr("v", F.col("x1") * 2 + F.col("x2")).alias("rho"), F.lit(1).alias("k"))
                   .join(quality.withColumn("k", F.lit(1)), "k").drop("k"), 4)


@query("impute_gate", "L23")
def _(t):
    d = model_table(t).withColumn("rare", ((F.col("x1") > 4.9) & (F.col("caseid") % 2 == 0)).cast("bigint"))
    return rounded(Im.gate_by_year(d, ["y", "rare"], "yr", ["g", "seg"], X), 4)


@query("impute_multiclass", "L24")
def _(t):
    size = F.when(F.col("x1") > 3.5, "large").when(F.col("x1") > 1.5, "mid").otherwise("base")
    d = model_table(t).withColumn("true", size).withColumn("v", F.when(F.col("caseid") % 5 != 0, F.col("true")))
    out = Im.impute_multiclass(d, "v", ["base", "large", "mid"], ["g", "seg"], X, "caseid")
    return rounded(out.filter("caseid % 5 = 0").groupBy("true", "v").agg(F.count(F.lit(1)).alias("n")))


@query("lookup_impute", "L25", """with r as (select p_brand, p_size, p_retailprice as w, p_partkey from part), m as (select p_brand, avg(w) as m from r where p_partkey % 3 <> 0 group by p_brand)
select p_partkey, round(case when p_partkey % 3 = 0 then m else w end, 4) as w from r left join m using (p_brand)""")
def _(t):
    p = t("part").select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_retailprice")).alias("w"))
    return rounded(Im.lookup_impute(p, p, "p_brand", "w").select("p_partkey", "w"), 4)


@query("regression_impute", "L26")
def _(t):
    d = K.kfold(model_table(t).withColumn("v", (F.col("x1") * 2 + F.col("x2") + F.col("x3")).cast("double")), 3, [], "caseid", 5)
    target = d.filter("yr >= 2000").withColumn("truth", F.col("v")).withColumn("v", F.when(F.col("caseid") % 4 != 0, F.col("v")))
    out = Im.regression_impute(d.filter("yr < 2000"), target, X, "v", "fold", [0.1, 0.01])
    return rounded(out.agg(F.count("v").alias("n"), F.corr("v", "truth").alias("rho")), 4)


@query("regression_impute_binary", "L26")
def _(t):
    d = cut_lineage(K.kfold(model_table(t).withColumn("v", F.col("y").cast("int")), 3, [], "caseid", 5))  # read by fit, cut and result
    target = d.filter("yr >= 2000").withColumn("v", F.lit(None).cast("int"))
    out = Im.regression_impute(d.filter("yr < 2000"), target, X, "v", "fold", [0.1, 0.01], binary=True)
    return rounded(out.groupBy("v", "y").agg(F.count(F.lit(1)).alias("n")))


@query("sum_component_risks", "L27", """with a as (select l_orderkey as caseid, l_linestatus as label, avg(l_discount) as phat, max(case when l_returnflag = 'R' then 1 else 0 end) as y from lineitem group by all)
select caseid, round(sum(phat), 6) as phat, cast(least(sum(y), 1) as bigint) as y from a where label in ('F', 'O') group by caseid""")
def _(t):
    a = t("lineitem").groupBy(F.col("l_orderkey").alias("caseid"), F.col("l_linestatus").alias("label")).agg(
        F.avg("l_discount").alias("phat"), F.max((F.col("l_returnflag") == "R").cast("int")).alias("y"))
    return rounded(Mo.sum_risks(a, ["caseid"], "label", ["F", "O"], "phat", "y"))


@query("group_baseline", "L28", f"""with {SCORED_SQL}, us as (select yr, row_number() over (order by yr) as k from scored group by yr),
r as (select t.yr as fold, s.g, (sum(s.y) + 1.0::double) / (count(*) + 2) as phat from scored s join us u on u.yr = s.yr join us t on t.k >= 2 and u.k < t.k group by all),
te as (select r.fold, s.y, round(r.phat, 9) as score from scored s join r on r.fold = s.yr and r.g = s.g), {sql_auc('te', 'fold')}
select fold, n1, n0, round(auc, 6) as auc from auc_t""")
def _(t):
    s = K.expanding_folds(scored(t), "yr", "y")
    b = M.group_baseline(s, "g").withColumn("phat", F.round("phat", 9))
    return rounded(R.auc(b, ["fold"], "y", "phat").drop("num", "den"))
