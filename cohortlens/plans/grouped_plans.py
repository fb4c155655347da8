"""Registered queries of one model per group (L5, L6) on mixed columns, with their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators import grouped as G, paths as P, ranking as R
from .mixed_plans import STATES, _hot
from .model_plans import MODEL_SQL, model_table
from .registry import query, rounded, sql_auc, sql_logit

NUMS, RIDGE = ["x1", "x2"], 20.0


def _summary(tests: DataFrame, valid: DataFrame, g: str) -> DataFrame:
    a = R.auc(tests, ["fold", g], "y", "preds").select("fold", g, "n1", "n0", F.col("auc").alias("auc_test"))
    v = valid.select("fold", g, F.col("auc").alias("auc_valid"), F.col("converged").cast("bigint").alias("converged"))
    return rounded(a.join(v, ["fold", g], "left").fillna(0, ["converged"]), 4)


def _sub_sql(source: str, g: str) -> str:
    """Models by (stage, fold, group) of ``source``(mt's columns and g) at once; stage 0 is validated, stage 1 tested."""
    x = lambda p: f"[1.0, {', '.join(f'coalesce(({c} - m_{c}) / nullif(s_{c}, 0), 0)' for c in NUMS)}, {_hot('st', STATES)}]::double[]"
    return f"""with recursive {MODEL_SQL}, src as ({source}),
us as (select yr, row_number() over (order by yr) as k from src group by yr),
fo as (select s.*, u.k, t.yr as fold, t.k as tk from src s join us u using (yr) join us t on t.k >= 2),
tr as (select *, 0 as stage from fo where k < tk - 1 and tk > 2 union all select *, 1 from fo where k < tk),
mo as (select stage, fold, {g}, {', '.join(f'avg({c}) as m_{c}, stddev_pop({c}) as s_{c}' for c in NUMS)} from tr group by all having min(y) = 0 and max(y) = 1),
dx as materialized (select stage, fold, {g}, y, {x('')} as x from tr join mo using (stage, fold, {g})),
{sql_logit('lo', 'dx', f'stage, fold, {g}', 1 + len(NUMS) + len(STATES), str(RIDGE), 600, 0.8)},
te as (select *, 0 as stage from fo where k = tk - 1 and tk > 2 union all select *, 1 from fo where k = tk),
sc as (select stage, fold, {g}, y, 1 / (1 + exp(-list_dot_product(b, {x('')}))) as preds from te join mo using (stage, fold, {g}) join lo using (stage, fold, {g})),
{sql_auc('sc', f'stage, fold, {g}', s='preds')}
select fold, {g}, a.n1, a.n0, round(a.auc, 4) as auc_test, round(v.auc, 4) as auc_valid, cast(case when v.stage = 0 then 1 else 0 end as bigint) as converged
from auc_t a left join (select * from auc_t where stage = 0) v using (fold, {g}) where a.stage = 1"""


@query("fit_sub_models", "L5", _sub_sql("select * from mt", "g"))
def _(t):
    """One model for each priority and test year, validated on the year before."""
    tests, valid, _ = G.fit_sub_models(model_table(t), "yr", ["g"], NUMS, ["st"], "y", (RIDGE,))
    return _summary(tests, valid, "g")


@query("fit_sub_by_annotation", "L6", _sub_sql("select mt.*, r_name from mt join nation on n_nationkey = c_nationkey join region on n_regionkey = r_regionkey", "r_name"))
def _(t):
    """The same by an annotation that is looked up."""
    regions = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), "r_name")
    tests, valid, _ = G.fit_sub_models(model_table(t).join(regions, "c_nationkey"), "yr", ["r_name"], NUMS, ["st"], "y", (RIDGE,))
    return _summary(tests, valid, "r_name")


@query("fit_sub_wide", "L5")
def _(t):
    """700 groups and over 100 one-hot columns: models, convergence and AUROC on their own rows."""
    o = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    d = o.select((F.col("o_custkey") % 700).alias("grp"), (F.col("o_totalprice") / 1e5).alias("x1"), (F.col("c_acctbal") / 3000).alias("x2"), F.col("c_mktsegment").alias("seg"),
                 F.col("c_nationkey").cast("string").alias("nation"), F.month("o_orderdate").cast("string").alias("mon"), F.dayofmonth("o_orderdate").cast("string").alias("dom"),
                 F.dayofweek("o_orderdate").cast("string").alias("dow"), (F.col("o_orderkey") % 30).cast("string").alias("clerk"), F.col("o_orderpriority").alias("pri"),
                 ((F.col("o_totalprice") / 1e5 + F.col("c_acctbal") / 3000 + ((F.col("o_orderkey") * 37) % 101) / 20.0) > 6.5).cast("bigint").alias("y"))
    design = P.design_of(d, ["x1", "x2"], ["seg", "nation", "mon", "dom", "dow", "clerk", "pri"])
    models = G.fit_grouped(d, ["grp"], design, "y", 1.0)
    a = R.auc(G.score_groups(d, models, ["grp"], design), ["grp"], "y", "preds")
    return rounded(models.join(a.select("grp", "auc"), "grp").agg(
        F.count(F.lit(1)).alias("models"), F.sum(F.col("converged").cast("bigint")).alias("converged"), F.max("steps").alias("steps"), F.max(F.size("beta")).alias("columns"), F.avg("auc").alias("mean_auc")), 3)
