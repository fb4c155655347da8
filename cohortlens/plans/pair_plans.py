"""Registered queries of concordance regression (L15), with the pairs, the offset and the Newton steps in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairs as C, ranking as R
from .model_plans import MODEL_SQL, model_table
from .registry import query, rounded, sql_bits, sql_decompose

FIT_SQL = """nw as (select 0 as t, 0.0::double as w1, 0.0::double as w2
  union all select t + 1, w1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12), w2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) from (
    select t, any_value(w1) as w1, any_value(w2) as w2, sum(q * (1 - q) * d1 * d1) + {lam} as h11, sum(q * (1 - q) * d1 * d2) as h12, sum(q * (1 - q) * d2 * d2) + {lam} as h22,
      sum(q * d1) - {lam} * any_value(w1) as g1, sum(q * d2) - {lam} * any_value(w2) as g2
    from (select *, 1 / (1 + exp(w1 * d1 + w2 * d2 + off)) as q from nw, prs where t < 25) group by t)),
w as (select w1, w2 from nw where t = 25)"""


def _result(w, test, g, eta):
    d = R.auc_decompose(test.withColumn("eta", eta), [], g, "y", "eta").select("tt", "auc", "n1", "n0")
    return rounded(d.withColumn("w1", F.lit(w[0])).withColumn("w2", F.lit(w[1])), 4)


@query("concordance_offset", "L15", f"""with recursive {MODEL_SQL}, tr as (select * from mt where yr < 2000),
k as (select sum(y)::double as k1, sum(1 - y)::double as k0 from tr),
p as (select g, (sum(y) + 1) / (max(k1) + 2) as p1, (sum(1 - y) + 1) / (max(k0) + 2) as p0 from tr, k group by g),
ofs as (select g, ln(k1 / k0) + (select sum(ln(1 - p1) - ln(1 - p0)) from p) + ln(p1 / (1 - p1)) - ln(p0 / (1 - p0)) as o from p, k),
r as (select y, x1, x2, o, row_number() over (partition by y order by caseid) as rn from tr join ofs using (g)),
sz as (select sum(y)::bigint as n1, sum(1 - y)::bigint as n0 from tr),
d as (select {sql_bits('1', '1', '0', 'i')} % n1 + 1 as p1, {sql_bits('1', '0', '0', 'i')} % n0 + 1 as p0 from sz, range(1, 2001) as q(i)),
prs as materialized (select a.x1 - b.x1 as d1, a.x2 - b.x2 as d2, a.o - b.o as off from d join r a on a.y = 1 and a.rn = p1 join r b on b.y = 0 and b.rn = p0),
{FIT_SQL.format(lam='1.0')},
te as (select y, mt.g, w1 * x1 + w2 * x2 + o as score from mt join ofs using (g), w where yr > 2000), {sql_decompose('te', '', 'g')}
select tt, round(auc, 4) as auc, n1, n0, round(w1, 4) as w1, round(w2, 4) as w2 from dec, w""")
def _(t):
    """Weights beside the log odds of the group, and what is gained within and between groups."""
    d = model_table(t)
    train = d.filter("yr < 2000")
    scored = C.group_offset(train, d, "g")
    w, _ = C.concordance_fit(scored.filter("yr < 2000"), scored.filter("yr = 2000"), "total", "g", "caseid", ["x1", "x2"], [1.0], offset="offset", most=2000)
    return _result(w, scored.filter("yr > 2000"), "g", F.col("x1") * w[0] + F.col("x2") * w[1] + F.col("offset"))


SMALL = 300  # groups, some with fewer pairs than MOST, some with more
MOST = 250


@query("concordance_exact", "L15", f"""with recursive {MODEL_SQL}, ca as (select *, caseid % {SMALL} as b from mt), tr as (select * from ca where yr < 2000),
r as (select b, y, x1, x2, row_number() over (partition by b, y order by caseid) as rn from tr),
sz as (select b, sum(y)::bigint as n1, sum(1 - y)::bigint as n0 from tr group by b),
d as (select b, case when n1 * n0 <= {MOST} then (i - 1) // n0 else {sql_bits('1', '1', 'b', 'i')} % n1 end + 1 as p1,
  case when n1 * n0 <= {MOST} then (i - 1) % n0 else {sql_bits('1', '0', 'b', 'i')} % n0 end + 1 as p0 from sz, range(1, {MOST + 1}) as q(i) where n1 > 0 and n0 > 0 and i <= n1 * n0),
prs as materialized (select a.x1 - c.x1 as d1, a.x2 - c.x2 as d2, 0.0 as off from d join r a on a.b = d.b and a.y = 1 and a.rn = p1 join r c on c.b = d.b and c.y = 0 and c.rn = p0),
{FIT_SQL.format(lam='0.5')},
te as (select y, b as g, w1 * x1 + w2 * x2 as score from ca, w where yr > 2000), {sql_decompose('te', '', 'g')}
select tt, round(auc, 4) as auc, n1, n0, round(w1, 4) as w1, round(w2, 4) as w2 from dec, w""")
def _(t):
    """Within small groups: every pair of a group with few, draws of the others."""
    d = model_table(t).withColumn("b", F.col("caseid") % SMALL)
    w, _ = C.concordance_fit(d.filter("yr < 2000"), d.filter("yr = 2000"), "within", "b", "caseid", ["x1", "x2"], [0.5], most=MOST)
    return _result(w, d.filter("yr > 2000"), "b", F.col("x1") * w[0] + F.col("x2") * w[1])


@query("concordance_between", "L15")
def _(t):
    """Positives of each group against the negatives of all others, the penalty chosen on a later year."""
    d = model_table(t)
    w, history = C.concordance_fit(d.filter("yr < 2000"), d.filter("yr = 2000"), "between", "g", "caseid", ["x1", "x2", "x3"], [1.0, 100.0, 10000.0], most=3000)
    out = _result(w, d.filter("yr > 2000"), "g", F.col("x1") * w[0] + F.col("x2") * w[1] + F.col("x3") * w[2])
    return out.withColumn("lambda", F.lit(max(history, key=lambda h: (h[1], h[0]))[0]))
