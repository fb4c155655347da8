"""Registered queries of section 2.J: uncertainty, tests, resampling."""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import functions as F

from ..functions import dist
from ..operators import inference as I, ranking as R, resample as S
from ..operators.resample import POISSON_STEPS
from .registry import (CASES_SQL, SCORED_SQL, cases, query, rounded, scored, sql_auc, sql_bits, sql_decompose)

Z975 = NormalDist().inv_cdf(0.975)


def sql_norm_cdf(x: str) -> str:
    c = dist.CDF_COEFFICIENTS
    t = f"(1.0 / (1.0 + {dist.CDF_SCALE} * abs({x})))::double"
    poly = f"({t} * ({c[0]} + {t} * ({c[1]} + {t} * ({c[2]} + {t} * ({c[3]} + {t} * {c[4]})))))"
    tail = f"(exp(-({x}) * ({x}) / 2.0) / {dist.SQRT_2PI} * {poly})"
    return f"(case when {x} >= 0 then 1.0 - {tail} else {tail} end)"


def sql_resample(src: str, strata: str, order: str, reps: int, seed: int, name: str = "rs", subreps: int = 0) -> str:
    """CTE ``name``: rows of src with rep, sub, weight."""
    ks = [k.strip() for k in strata.split(",")]
    inner = sql_bits(str(seed), "'s'", *ks, "rep", "sub", "idx_")
    return f"""{name}_n as (select *, row_number() over (partition by {strata} order by {order}) as idx_, count(*) over (partition by {strata}) as sz_ from {src}),
{name}_d as (select {strata}, rep, sub, sz_, case when sub = 0 then idx_ else {inner} % sz_ + 1 end as at_
  from {name}_n cross join range(1, {reps + 1}) as r(rep) cross join range(0, {subreps + 1}) as q(sub)),
{name}_w as (select {strata}, rep, sub, {sql_bits(str(seed), "'r'", *ks, "rep", "at_")} % sz_ + 1 as idx_, count(*) as weight from {name}_d group by all),
{name} as (select n.* exclude (idx_, sz_), w.rep, w.sub, w.weight from {name}_n n join {name}_w w on {' and '.join(f'n.{k} = w.{k}' for k in ks)} and n.idx_ = w.idx_)"""


def g_cases(t):
    return cases(t).select("caseid", "yr", "g", "y", "score")


GC_SQL = CASES_SQL


@query("resample_weights", "J0", f"""with {CASES_SQL}, {sql_resample('cases', 'g, y', 'score, caseid', 5, 42)}
select g, y, rep, cast(sum(weight) as bigint) as n, count(*) as n_distinct, cast(max(weight) as bigint) as max_weight, cast(sum(weight * caseid) as bigint) as checksum from rs group by all""")
def _(t):
    w = S.resample(g_cases(t), ["g", "y"], ["score", "caseid"], 5, 42)
    return rounded(w.groupBy("g", "y", "rep").agg(
        F.sum("weight").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.max("weight").alias("max_weight"),
        F.sum(F.col("weight") * F.col("caseid")).alias("checksum")))


STEPS = ", ".join(repr(s) for s in S.POISSON_STEPS)


@query("resample_poisson", "J0", f"""with {CASES_SQL}, u as (select g, caseid, rep, {sql_bits('42', "'p'", 'caseid', 'rep')} / {float(16**13)!r} as u from cases cross join range(1, 6) as r(rep)),
w as (select g, caseid, rep, len(list_filter([{STEPS}]::double[], lambda s: u >= s)) as weight from u)
select g, rep, cast(sum(weight) as bigint) as n, count(*) as n_distinct, cast(sum(weight * caseid) as bigint) as checksum from w where weight > 0 group by all""")
def _(t):
    w = S.resample_poisson(g_cases(t), ["caseid"], 5, 42)
    return rounded(w.groupBy("g", "rep").agg(F.sum("weight").alias("n"), F.count(F.lit(1)).alias("n_distinct"),
                                             F.sum(F.col("weight") * F.col("caseid")).alias("checksum")))


HANLEY = "sqrt((auc * (1 - auc) + (n1 - 1) * (auc / (2 - auc) - auc * auc) + (n0 - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (cast(n1 as double) * n0))"
NULLSE = "sqrt((n1 + n0 + 1) / (12 * cast(n1 as double) * n0))"


@query("auc_standard_error", "J1,J2", f"""with {SCORED_SQL}, {sql_auc('scored', 'yr, g')}
select yr, g, round({HANLEY}, 6) as se_hanley, round({NULLSE}, 6) as se_null from auc_t where n1 > 0 and n0 > 0""")
def _(t):
    a = R.auc(scored(t), ["yr", "g"]).filter("n1 > 0 and n0 > 0")
    return rounded(a.select("yr", "g", I.auc_se(F.col("auc"), F.col("n1"), F.col("n0")).alias("se_hanley"),
                            I.auc_se(F.col("auc"), F.col("n1"), F.col("n0"), "null").alias("se_null")))


SIG_SQL = f"""{SCORED_SQL}, {sql_auc('scored', 'yr, g')},
sig as (select yr, g, n1, n0, auc, {NULLSE} as se, greatest(auc - {Z975} * {NULLSE}, 0.0::double) as lb, least(auc + {Z975} * {NULLSE}, 1.0::double) as ub,
  cast(case when auc - {Z975} * {NULLSE} > 0.5 then 1 else 0 end as bigint) as is_sig from auc_t where n1 > 0 and n0 > 0)"""


def sig_table(t):
    a = R.auc(scored(t), ["yr", "g"]).filter("n1 > 0 and n0 > 0")
    a = a.withColumn("se", I.auc_se(F.col("auc"), F.col("n1"), F.col("n0"), "null"))
    return I.normal_ci(a, "auc", "se", 0.05, True, 0.5)


@query("normal_ci", "J3", f"""with {SIG_SQL} select yr, g, round(auc, 6) as auc, round(lb, 6) as lb, round(ub, 6) as ub, is_sig from sig""")
def _(t):
    return rounded(sig_table(t).select("yr", "g", "auc", "lb", "ub", "is_sig"))


def _q(col: str, p: float) -> str:
    return f"quantile_cont({col}, {p})"


@query("bootstrap_ci", "J4", f"""with {CASES_SQL}, {sql_auc('cases', 'g', 'base')}, {sql_resample('cases', 'g', 'caseid', 25, 5)},
{sql_auc('rs', 'g, rep', 'bt', w='weight')}, q as (select g, {_q('auc', 0.025)} as lo, {_q('auc', 0.975)} as hi, avg(auc) as m from bt group by g)
select g, round(auc, 6) as stat, round(lo - (m - auc), 6) as lb, round(hi - (m - auc), 6) as ub from base join q using (g)""")
def _(t):
    return rounded(I.bootstrap_ci(g_cases(t), ["g"], "auc", ["caseid"], 25, 5))


@query("bootstrap_ci_r2", "J4", f"""with a as (select o_orderkey as caseid, o_orderpriority as g, o_totalprice / 1e5 as y, o_totalprice / 1e5 * 0.7 + (o_orderkey % 10) / 10.0::double as score from orders),
bs as (select g, 1 - sum((y - score) * (y - score)) / (var_pop(y) * count(*)) as stat from a group by g), {sql_resample('a', 'g', 'caseid', 25, 6)},
bt as (select g, rep, 1 - sum(weight * (y - score) * (y - score)) / (sum(weight * y * y) - sum(weight * y) * sum(weight * y) / sum(weight)) as stat from rs group by all),
q as (select g, {_q('stat', 0.025)} as lo, {_q('stat', 0.975)} as hi, avg(stat) as m from bt group by g)
select g, round(stat, 6) as stat, round(lo - (m - stat), 6) as lb, round(hi - (m - stat), 6) as ub from bs join q using (g)""")
def _(t):
    y = F.col("o_totalprice") / 1e5
    a = t("orders").select(F.col("o_orderkey").alias("caseid"), F.col("o_orderpriority").alias("g"), y.alias("y"),
                           (y * 0.7 + (F.col("o_orderkey") % 10) / 10.0).alias("score"))
    return rounded(I.bootstrap_ci(a, ["g"], "r2", ["caseid"], 25, 6))


@query("auc_bootstrap", "J5", f"""with {CASES_SQL}, {sql_auc('cases', 'g', 'base')}, {sql_resample('cases', 'g, y', 'score, caseid', 25, 9)},
{sql_auc('rs', 'g, rep', 'bt', w='weight')}, q as (select g, {_q('auc', 0.025)} as lb, {_q('auc', 0.975)} as ub from bt group by g)
select g, round(auc, 6) as auc, round(lb, 6) as lb, round(ub, 6) as ub from base join q using (g)""")
def _(t):
    return rounded(I.auc_bootstrap(g_cases(t), ["g"], ["score", "caseid"], 25, 9))


@query("cluster_bootstrap", "J6", f"""with {SCORED_SQL}, {sql_auc('scored', 'yr, g')}, gr as (select yr, g, auc, den as n0n1 from auc_t where n1 > 0),
{sql_resample('gr', 'yr', 'g', 100, 3)},
bt as (select yr, rep, sum(auc * n0n1 * weight) / sum(n0n1 * weight) as auc from rs group by all),
q as (select yr, {_q('auc', 0.025)} as lb, {_q('auc', 0.975)} as ub from bt group by yr)
select yr, round(sum(auc * n0n1) / sum(n0n1), 6) as auc, round(max(lb), 6) as lb, round(max(ub), 6) as ub from gr join q using (yr) group by yr""")
def _(t):
    groups = R.auc_by_group(scored(t), ["yr"], "g").select("yr", "g", "auc", "n0n1")
    return rounded(I.cluster_bootstrap(groups, ["yr"], "g", 100, 3))


@query("cluster_bootstrap_total", "J6", f"""with {SCORED_SQL}, {sql_auc('scored', 'yr, g')}, gr as (select yr, g, auc, den as n0n1 from auc_t where n1 > 0),
{sql_resample('gr', 'yr', 'g', 100, 3)},
bt as (select yr, rep, sum(auc * n0n1 * weight) / sum(n0n1 * weight) as auc from rs group by all),
q as (select yr, {_q('auc', 0.025)} as lb, {_q('auc', 0.975)} as ub from bt group by yr), {sql_auc('scored', 'yr', 'tot')}
select yr, 'within' as tt, round(sum(auc * n0n1) / sum(n0n1), 6) as auc, round(max(lb), 6) as lb, round(max(ub), 6) as ub from gr join q using (yr) group by yr
union all select yr, 'total', round(auc, 6), round(auc - {Z975} * {HANLEY}, 6), round(auc + {Z975} * {HANLEY}, 6) from tot""")
def _(t):
    return rounded(I.cluster_bootstrap_total(scored(t), ["yr"], "g", 100, 3))


@query("decompose_bootstrap", "J7", f"""with {CASES_SQL}, cs as (select caseid, st as outcome, g, cast(case when yr >= 1999 then 1 else 0 end as bigint) as y, score from cases),
{sql_decompose('cs', 'outcome', 'g', 'base')}, {sql_resample('cs', 'outcome, y', 'score, caseid', 15, 4)}, {sql_decompose('rs', 'outcome, rep', 'g', 'bt', w='weight')},
q as (select outcome, tt, {_q('auc', 0.025)} as lb, {_q('auc', 0.975)} as ub from bt group by all)
select outcome, tt, round(auc, 6) as auc, round(lb, 6) as lb, round(ub, 6) as ub from base join q using (outcome, tt)""")
def _(t):
    cs = cases(t).select("caseid", F.col("st").alias("outcome"), "g", (F.col("yr") >= 1999).cast("bigint").alias("y"), "score")
    return rounded(I.decompose_bootstrap(cs, ["outcome"], "g", ["score", "caseid"], 15, 4))


def sql_poisson(seed: int, ids: str, reps: int) -> str:
    """Weights of bulk.poisson_weights as columns of ``x``: a row hash, mixed with the replicate's number, against Poisson(1) steps."""
    word = lambda v: f"cast('{v}' as uhugeint)"
    size = word(2 ** 64)
    steps = " + ".join(f"(h3 >= {word(int(min(p, 1 - 2.0 ** -53) * 2.0 ** 64))})::int" for p in POISSON_STEPS)
    return f"""h0 as (select *, cast({sql_bits(str(seed), "'b'", ids)} as uhugeint) as h from cs),
h1 as (select h0.*, rep, (h + cast(rep as uhugeint) * {word(0x9E3779B97F4A7C15)}) % {size} as x from h0, range(1, {reps + 1}) as r(rep)),
h2 as (select * replace ((xor(x, x // {word(2 ** 30)}) * {word(0xBF58476D1CE4E5B9)}) % {size} as x) from h1),
h4 as (select * replace ((xor(x, x // {word(2 ** 27)}) * {word(0x94D049BB133111EB)}) % {size} as x) from h2),
h5 as (select *, xor(x, x // {word(2 ** 31)}) as h3 from h4),
rs as (select * exclude (h, x, h3), {steps} as weight from h5)"""


@query("decompose_bootstrap_poisson", "J7", f"""with {CASES_SQL}, cs as (select caseid, st as outcome, g, cast(case when yr >= 1999 then 1 else 0 end as bigint) as y, round(score, -3) as score from cases),
{sql_decompose('cs', 'outcome', 'g', 'base')}, {sql_poisson(4, 'caseid', 40)}, {sql_decompose('rs', 'outcome, rep', 'g', 'bt', w='weight')},
q as (select outcome, tt, {_q('auc', 0.025)} as lb, {_q('auc', 0.975)} as ub from bt group by all)
select outcome, tt, round(auc, 6) as auc, round(lb, 6) as lb, round(ub, 6) as ub from base join q using (outcome, tt)""")
def _(t):
    """All replicates in one pass over rows with many ties."""
    cs = cases(t).select("caseid", F.col("st").alias("outcome"), "g", (F.col("yr") >= 1999).cast("bigint").alias("y"), F.round("score", -3).alias("score"))
    return rounded(I.decompose_bootstrap(cs, ["outcome"], "g", ["caseid"], 40, 4, scheme="poisson"))


@query("compare_bootstrap", "J8", f"""with {CASES_SQL}, cs as (select caseid, g, yr, y, score as a, score + caseid % 1000 * 400 as b from cases), {sql_resample('cs', 'g', 'caseid', 25, 8)},
{sql_auc('rs', 'g, rep', 'ta', 'a', 'weight')}, {sql_auc('rs', 'g, rep', 'tb', 'b', 'weight')},
d as (select g, ta.auc - 0.5 as agg, tb.auc - 0.5 as sub, tb.auc - ta.auc as diff from ta join tb using (g, rep) where ta.auc is not null and tb.auc is not null),
l as (select g, 'diff' as part, diff as v from d union all select g, 'agg', agg from d union all select g, 'sub', sub from d)
select g, part, round({_q('v', 0.025)}, 6) as q, round(1 - sum((round(v, 12) > 0)::int) / (count(*) + 1.0::double), 6) as p from l group by all""")
def _(t):
    cs = g_cases(t).withColumnRenamed("score", "a").withColumn("b", F.col("a") + F.col("caseid") % 1000 * 400)
    return rounded(I.compare_bootstrap(cs, ["g"], "a", "b", ["caseid"], 25, 8))


PV_SQL = f"""{SIG_SQL}, pv as (select yr, g, 2 * (1 - {sql_norm_cdf('abs((auc - 0.5) / se)')}) as p from sig)"""


def pv_table(t):
    return sig_table(t).select("yr", "g", (2 * (1 - dist.norm_cdf(F.abs((F.col("auc") - 0.5) / F.col("se"))))).alias("p"))


@query("fdr", "J9", f"""with {PV_SQL}, r as (select *, row_number() over (partition by yr order by p, g) as rk, count(*) over (partition by yr) as m from pv)
select yr, g, round(p, 6) as p, round(least(min(p * m / rk) over (partition by yr order by rk desc), 1.0), 6) as fdr from r""")
def _(t):
    return rounded(I.fdr(pv_table(t), ["yr"], "p", "g"))


CHI_SQL = f"""{CASES_SQL}, cx as (select 'priority' as name, g as level, (case when yr < 1999 then 'a' else 'b' end) as side from cases
  union all select 'is_f', cast(y as varchar), case when yr < 1999 then 'a' else 'b' end from cases),
o as (select name, level, sum((side = 'a')::int) as oa, sum((side = 'b')::int) as ob from cx group by all),
tt as (select name, sum(oa) as ta, sum(ob) as tb, count(*) as k from o group by name),
e as (select o.*, k, (oa + ob) * cast(ta as double) / (ta + tb) as ea, (oa + ob) * cast(tb as double) / (ta + tb) as eb from o join tt using (name)),
s as (select name, sum(pow(abs(oa - ea) - case when k = 2 then least(0.5, abs(oa - ea)) else 0 end, 2) / ea
   + pow(abs(ob - eb) - case when k = 2 then least(0.5, abs(ob - eb)) else 0 end, 2) / eb) as stat, cast(max(k) - 1 as bigint) as dof from e group by name)"""


def chi_input(t):
    c = cases(t).withColumn("side", F.when(F.col("yr") < 1999, "a").otherwise("b"))
    return (c.select(F.lit("priority").alias("name"), F.col("g").alias("level"), "side")
            .unionByName(c.select(F.lit("is_f").alias("name"), F.col("y").cast("string").alias("level"), "side")))


@query("chi_square", "J10", f"""with {CHI_SQL} select name, round(stat, 6) as stat, dof from s""")
def _(t):
    return rounded(I.chi_square(chi_input(t), ["name"], "level", "side", ["a", "b"], False))


@query("chi_square_pvalue", "J10")
def _(t):
    return rounded(I.chi_square(chi_input(t), ["name"], "level", "side", ["a", "b"]))


@query("mann_whitney", "J11", f"""with {CASES_SQL}, c as (select g, y, round(score, -3) as x from cases),
r as (select g, y, rank() over (partition by g order by x) + (count(*) over (partition by g, x) - 1) / 2.0::double as rk from c),
tie as (select g, sum(cast(n as double) * n * n - n) as tie from (select g, x, count(*) as n from c group by all) group by g),
a as (select g, sum(case when y = 1 then rk end) - sum(y) * (sum(y) + 1) / 2.0::double as u, cast(sum(y) as double) as na, cast(sum(1 - y) as double) as nb from r group by g),
z as (select g, u, na, nb, sign(u - na * nb / 2) * greatest(abs(u - na * nb / 2) - 0.5, 0) / sqrt(na * nb / 12 * ((na + nb + 1) - tie / ((na + nb) * (na + nb - 1)))) as z from a join tie using (g))
select g, round(u, 6) as u, na, nb, round(z, 6) as z, round(2 * (1 - {sql_norm_cdf('abs(z)')}), 6) as pval from z""")
def _(t):
    c = cases(t).select("g", "y", F.round("score", -3).alias("x"))
    return rounded(I.mann_whitney(c, ["g"], "y", (1, 0), "x"))


TERM = "exp(lgamma(n + 1.0) - lgamma(j + 1.0) - lgamma(n - j + 1.0) + j * ln({p}) + (n - j) * ln(1 - {p}))"


@query("prop_ci_exact", "J12", f"""with recursive {SCORED_SQL}, a as (select g, cast(sum(y) as bigint) as x, count(*) as n from scored group by g),
b as (select g, x, n, 0 as t, 0.0::double as l0, 1.0::double as l1, 0.0::double as u0, 1.0::double as u1 from a
  union all select g, x, n, t + 1, case when up > 0.025 then l0 else ml end, case when up > 0.025 then ml else l1 end, case when low > 0.025 then mu else u0 end, case when low > 0.025 then u1 else mu end
  from (select *, list_sum(list_transform(range(x, n + 1), lambda j: {TERM.format(p='ml')})) as up, list_sum(list_transform(range(0, x + 1), lambda j: {TERM.format(p='mu')})) as low
        from (select *, (l0 + l1) / 2 as ml, (u0 + u1) / 2 as mu from b where t < 40)))
select g, x, n, round(x / n::double, 6) as prop, round(case when x = 0 then 0 else (l0 + l1) / 2 end, 6) as lb, round(case when x = n then 1 else (u0 + u1) / 2 end, 6) as ub from b where t = 40""")
def _(t):
    """Bounds by bisection of the binomial tails in the SQL."""
    a = scored(t).groupBy("g").agg(F.sum("y").alias("x"), F.count(F.lit(1)).alias("n"))
    return rounded(I.prop_ci(a, "x", "n", "beta"))


@query("prop_ci_wald", "J13", f"""with {SCORED_SQL}, a as (select g, cast(sum(y) as bigint) as x, count(*) as n, avg(cast(y as double)) as p from scored group by g)
select g, x, n, round(p, 6) as prop, round(p - {Z975} * sqrt(p * (1 - p) / n), 6) as lb, round(p + {Z975} * sqrt(p * (1 - p) / n), 6) as ub from a""")
def _(t):
    a = scored(t).groupBy("g").agg(F.sum("y").alias("x"), F.count(F.lit(1)).alias("n"))
    return rounded(I.prop_ci(a, "x", "n"))


@query("enrichment", "J14", f"""with {PV_SQL}, f as (select n_name as term, case when p < 0.2 then 1 else 0 end as flag from pv join supplier on s_suppkey = g join nation on n_nationkey = s_nationkey),
c as (select term, cast(sum(flag) as bigint) as true1, cast(sum(1 - flag) as bigint) as false1 from f group by term),
d as (select *, cast(sum(true1) over () - true1 as bigint) as true0, cast(sum(false1) over () - false1 as bigint) as false0 from c),
x as (select *, case when true1 * false0 > 0 and true0 * false1 > 0 then ln(true1::double * false0 / (true0::double * false1)) end as lor,
  sqrt(1 / nullif(true1, 0)::double + 1 / nullif(false1, 0)::double + 1 / nullif(true0, 0)::double + 1 / nullif(false0, 0)::double) as se from d)
select term, true1, false1, true0, false0, round(lor, 6) as lor, round(se, 6) as se, round(lor / se, 6) as z, round(2 * (1 - {sql_norm_cdf('abs(lor / se)')}), 6) as pval from x""")
def _(t):
    dim = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("g"), F.col("n_name").alias("term"))
    f = pv_table(t).join(dim, "g").withColumn("flag", (F.col("p") < 0.2).cast("int"))
    return rounded(I.enrichment(f, [], "term", "flag"))


RANK_SQL = """rk as (select *, rank() over (partition by l_returnflag order by l_quantity) + (count(*) over (partition by l_returnflag, l_quantity) - 1) / 2.0::double as ra,
 rank() over (partition by l_returnflag order by l_extendedprice) + (count(*) over (partition by l_returnflag, l_extendedprice) - 1) / 2.0::double as rb from lineitem)"""


@query("spearman", "J15", f"""with {RANK_SQL} select l_returnflag, round(corr(ra, rb), 6) as rho, round(2 * sin(pi() * corr(ra, rb) / 6), 6) as rho_t from rk group by 1""")
def _(t):
    li = t("lineitem").select("l_returnflag", "l_quantity", "l_extendedprice")
    a = I.spearman(li, ["l_returnflag"], "l_quantity", "l_extendedprice")
    return rounded(a.withColumn("rho_t", 2 * F.sin(F.col("rho") * 3.141592653589793 / 6)))


def _bounds_sql(key: str, base: str) -> str:
    return f"""o as (select {key}, rep, stat as b from bt where sub = 0), i as (select {key}, rep, stddev_samp(stat) as se from bt where sub > 0 group by all),
tq as (select {key}, {_q('(b - stat) / nullif(se, 0)', 0.025)} as tl, {_q('(b - stat) / nullif(se, 0)', 0.975)} as th from o join i using ({key}, rep) join {base} using ({key}) group by {key}),
bq as (select {key}, {_q('b', 0.025)} as bl, {_q('b', 0.975)} as bh, stddev_samp(b) as sb from o group by {key})"""


def _bounds_out(key: str, base: str, stat: str) -> str:
    return " union all ".join(
        f"select {key}, round(stat, 6) as {stat}, '{tt}' as tt, round({lb}, 5) as lb, round({ub}, 5) as ub from {base} join tq using ({key}) join bq using ({key})"
        for tt, lb, ub in (("student", "stat - sb * th", "stat - sb * tl"), ("normal", f"stat - sb * {Z975}", f"stat + sb * {Z975}"), ("quant", "bl", "bh")))


ALL_PAIRS_SQL = f"""{SCORED_SQL}, {sql_auc('scored', 'yr, g')},
pairs as (select a.g as id, 'a' || a.yr || ':a' || b.yr as pair, a.auc as v1, b.auc as v2 from auc_t a join auc_t b on a.g = b.g and a.yr < b.yr where a.auc is not null and b.auc is not null),
pr as (select id, pair, rank() over (partition by pair order by v1) + (count(*) over (partition by pair, v1) - 1) / 2.0::double as ra,
  rank() over (partition by pair order by v2) + (count(*) over (partition by pair, v2) - 1) / 2.0::double as rb from pairs)"""


def all_pairs_table(t):
    """(id, pair, v1, v2): the group's AUROCs in each two years."""
    a = R.auc(scored(t), ["yr", "g"]).filter("auc is not null").select("yr", "g", "auc")
    x, y = a.alias("x"), a.alias("y")
    return x.join(y, (F.col("x.g") == F.col("y.g")) & (F.col("x.yr") < F.col("y.yr"))).select(
        F.col("x.g").alias("id"), F.concat(F.lit("a"), F.col("x.yr").cast("string"), F.lit(":a"), F.col("y.yr").cast("string")).alias("pair"),
        F.col("x.auc").alias("v1"), F.col("y.auc").alias("v2"))


SPEARMAN_SQL = f"""with {ALL_PAIRS_SQL}, base as (select pair, corr(ra, rb) as stat from pr group by pair), {sql_resample('pr', 'pair', 'id', 40, 21, 'rs', 10)},
bt as (select pair, rep, sub, (sum(weight) * sum(weight * ra * rb) - sum(weight * ra) * sum(weight * rb)) / (sqrt(sum(weight) * sum(weight * ra * ra) - pow(sum(weight * ra), 2)) * sqrt(sum(weight) * sum(weight * rb * rb) - pow(sum(weight * rb), 2))) as stat from rs group by all),
{_bounds_sql('pair', 'base')} {_bounds_out('pair', 'base', 'rho')}"""


@query("spearman_ci", "J16", SPEARMAN_SQL)
@query("spearman_ci_all", "J16", SPEARMAN_SQL)
def _(t):
    """Every two years."""
    return rounded(I.spearman_ci(all_pairs_table(t), ["pair"], "v1", "v2", "id", 40, 10, 21), lb=5, ub=5)


QLB_SQL = f"""{SCORED_SQL}, rt as (select g, max(score) as v, count(*) as n from scored where y = 1 group by g),
pos as (select g as id, case when g % 3 = 0 then 'nb' else 'preds' end as mdl, avg(score) as phat from scored where y = 1 group by g)"""


@query("quantile_lower_bound", "J17", f"""with {QLB_SQL}, base as (select mdl, {_q('phat', 0.5)} as thresh from pos group by mdl), {sql_resample('pos', 'mdl', 'id', 40, 17, 'rs', 10)},
x as (select mdl, rep, sub, phat from rs, range(weight) as k(i)),
bt as (select mdl, rep, sub, {_q('phat', 0.5)} as stat from x group by all),
o as (select mdl, rep, stat as b from bt where sub = 0), i as (select mdl, rep, stddev_samp(stat) as se from bt where sub > 0 group by all),
c as (select mdl, {_q('(b - thresh) / nullif(se, 0)', 0.95)} as crit from o join i using (mdl, rep) join base using (mdl) group by mdl),
s as (select mdl, stddev_samp(b) as se from o group by mdl)
select mdl, round(thresh, 4) as thresh, round(se, 4) as se, round(crit, 4) as crit, round(thresh - se * crit, 4) as thresh_lb from base join c using (mdl) join s using (mdl)""")
def _(t):
    pos = scored(t).filter("y = 1").groupBy(F.col("g").alias("id")).agg(F.avg("score").alias("phat")).withColumn(
        "mdl", F.when(F.col("id") % 3 == 0, "nb").otherwise("preds"))
    return rounded(I.quantile_lower_bound(pos, ["mdl"], "phat", "id", 0.5, 40, 10, 17), 4)


@query("order_threshold", "J18", f"""with {SCORED_SQL}, n as (select g, cast(sum(y) as bigint) as n from scored group by g),
l as (select g, n, unnest(range(0, n + 1)) as l from n),
p as (select g, n, l, exp(lgamma(n + 1.0) - case when l = 0 then 0 else lgamma(l + 1.0) end - case when l = n then 0 else lgamma(n - l + 1.0) end + l * ln(0.95) + (n - l) * ln(0.05)) as pdf from l),
c as (select g, n, l, coalesce(sum(pdf) over (partition by g order by l rows between unbounded preceding and 1 preceding), 0) as below from p)
select g, n, cast(greatest(max(case when below <= 0.95 then l end), 1) as bigint) as rank from c group by g, n""")
def _(t):
    n = scored(t).groupBy("g").agg(F.sum("y").alias("n"))
    return I.order_threshold(n.withColumn("k", F.lit(0.05)).withColumn("j", F.lit(0.05)), "n", "k", "j").drop("k", "j")


POWERS = [round(0.10 + 0.05 * i, 2) for i in range(11)]
PPFS = [NormalDist().inv_cdf(1 - p) for p in POWERS]


@query("sample_size", "J19", f"""with {SCORED_SQL}, r as (select yr, avg(cast(y as double)) as rate from scored group by yr), p as (select unnest({POWERS}::double[]) as power, unnest({PPFS!r}::double[]) as zb)
select yr, power, round(pow((sqrt(0.25) * zb - sqrt(0.24) * {NormalDist().inv_cdf(0.95)}) / -0.1, 2), 4) as n_star, round(pow((sqrt(0.25) * zb - sqrt(0.24) * {NormalDist().inv_cdf(0.95)}) / -0.1, 2) / rate, 3) as n_cases from r cross join p""")
def _(t):
    r = scored(t).groupBy("yr").agg(F.avg(F.col("y").cast("double")).alias("rate"))
    grid = r.select("yr", "rate", F.explode(F.array(*[F.lit(p) for p in POWERS])).alias("power"))
    out = I.sample_size(grid, "power", 0.5, 0.1, 0.05)
    return out.select("yr", "power", F.round("n_star", 4).alias("n_star"), F.round(F.col("n_star") / F.col("rate"), 3).alias("n_cases"))


@query("null_cut", "J20", f"""with {CASES_SQL}, nul as (select g, {_q('score', 0.95)} as cut from cases where yr < 1999 group by g)
select caseid, g, round(cut, 6) as cut, cast(case when score >= cut then 1 else 0 end as bigint) as is_sig from cases join nul using (g) where yr >= 1999""")
def _(t):
    c = g_cases(t)
    d = I.null_cut(c.filter("yr >= 1999").select("caseid", "g", "score"), c.filter("yr < 1999"), ["g"], "score", 0.95)
    return rounded(d.drop("score"))


@query("total_gap_bootstrap", "J21", f"""with {CASES_SQL}, cs as (select caseid, g, y, score / 1e6 as p1, 0.33::double as p2 from cases), {sql_resample('cs', 'g', 'caseid', 30, 13)},
s as (select g, rep, sum(weight * (y - p1)) as p1, sum(weight * (y - p2)) as p2 from rs group by all),
l as (select g, 'p1' as mdl, p1 as yd from s union all select g, 'p2', p2 from s)
select g, mdl, round({_q('yd', 0.025)}, 5) as yd from l group by all""")
def _(t):
    cs = g_cases(t).withColumn("p1", F.col("score") / 1e6).withColumn("p2", F.lit(0.33))
    return rounded(I.total_gap_bootstrap(cs, ["g"], ["p1", "p2"], ["caseid"], 30, 13), 5)


@query("replicate_ci", "J22", f"""with {CASES_SQL}, b as (select g, o_custkey % 40 as rep, regr_slope(score, yr) as bhat from cases group by all having min(yr) < max(yr))
select g, round({_q('bhat', 0.025)}, 3) as lb, round({_q('bhat', 0.975)}, 3) as ub, cast(case when sign({_q('bhat', 0.025)}) = sign({_q('bhat', 0.975)}) then 1 else 0 end as bigint) as is_sig from b group by g""")
def _(t):
    b = cases(t).groupBy("g", (F.col("o_custkey") % 40).alias("rep")).agg(
        F.when(F.min("yr") < F.max("yr"), F.regr_slope("score", "yr")).alias("bhat"))
    return rounded(I.replicate_ci(b, ["g"], "bhat"), 3)


@query("mann_whitney_ci", "J23", f"""with {SCORED_SQL}, gm as (select g as id, avg(score) as x, cast(case when g % 2 = 0 then 1 else 0 end as bigint) as y, 'all' as k from scored group by g),
{sql_auc('gm', 'k', 'b0', 'x')}, base as (select k, auc as stat from b0), {sql_resample('gm', 'k, y', 'id', 30, 23, 'rs', 8)}, {sql_auc('rs', 'k, rep, sub', 'b1', 'x', 'weight')},
bt as (select k, rep, sub, auc as stat from b1), {_bounds_sql('k', 'base')} {_bounds_out('k', 'base', 'stat')}""")
def _(t):
    gm = scored(t).groupBy(F.col("g").alias("id")).agg(F.avg("score").alias("x")).withColumn(
        "y", (F.col("id") % 2 == 0).cast("bigint")).withColumn("k", F.lit("all"))
    return rounded(I.mann_whitney_ci(gm, ["k"], "y", "x", "id", 30, 8, 23), lb=5, ub=5)


@query("significant_share", "J24", f"""with {SIG_SQL}, c as (select yr, sum(is_sig) as s, count(*) as n from sig group by yr)
select yr, 1::bigint as is_sig, cast(s as bigint) as n, round(cast(s as double) / n, 6) as pct from c union all select yr, 0, cast(n - s as bigint), round(1 - cast(s as double) / n, 6) from c""")
def _(t):
    return rounded(I.significant_share(sig_table(t), ["yr"], "is_sig"))
