"""Registered queries of section 2.C: joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins as J, nearest as N
from .registry import CASES_SQL, cases, query, rounded, sql_bits


@query("join_labels_features", "C1", """select o_orderkey, o_orderstatus, c_mktsegment from orders join customer on c_custkey = o_custkey""")
def _(t):
    return J.join_on(t("orders").withColumnRenamed("o_custkey", "k"), t("customer").withColumnRenamed("c_custkey", "k"), ["k"]).select(
        "o_orderkey", "o_orderstatus", "c_mktsegment")


@query("left_lookup", "C2", """select s_suppkey, n_name, r_name from supplier left join nation on n_nationkey = s_nationkey and n_regionkey <> 2 left join region on r_regionkey = n_regionkey""")
def _(t):
    n = t("nation").filter("n_regionkey <> 2").withColumnRenamed("n_nationkey", "s_nationkey")
    a = J.join_on(t("supplier"), n, ["s_nationkey"], "left").withColumnRenamed("n_regionkey", "r_regionkey")
    return J.join_on(a, t("region"), ["r_regionkey"], "left").select("s_suppkey", "n_name", "r_name")


@query("right_join", "C3", """select d.doc_id, l.quality::double as quality from labels l right join documents d on d.doc_id = l.doc_id""")
def _(t):
    return rounded(J.join_on(t("labels").select("doc_id", F.col("quality").cast("double").alias("quality")), t("documents").select("doc_id"), ["doc_id"], "right"))


@query("natural_join", "C4", """select cast(label as bigint) as label, n, round(mean_id, 6) as mean_id from
 (select label, count(*) as n from embeddings group by label) natural join (select label, avg(vec_id) as mean_id from embeddings group by label)""")
def _(t):
    e = t("embeddings").groupBy("label")
    return rounded(J.natural_join(e.agg(F.count(F.lit(1)).alias("n")), e.agg(F.avg("vec_id").alias("mean_id"))))


@query("many_key_join", "C5", """with a as (select l_suppkey, l_returnflag, l_linestatus, l_linenumber, sum(l_quantity) as q from lineitem where l_tax < 0.04 group by all),
b as (select l_suppkey, l_returnflag, l_linestatus, l_linenumber, count(*) as n from lineitem where l_tax >= 0.04 group by all)
select a.l_suppkey, a.l_returnflag, a.l_linestatus, cast(a.l_linenumber as bigint) as l_linenumber, round(q, 6) as q, n from a join b using (l_suppkey, l_returnflag, l_linestatus, l_linenumber)""")
def _(t):
    k = ["l_suppkey", "l_returnflag", "l_linestatus", "l_linenumber"]
    li = t("lineitem")
    a = li.filter("l_tax < 0.04").groupBy(*k).agg(F.sum("l_quantity").alias("q"))
    b = li.filter("l_tax >= 0.04").groupBy(*k).agg(F.count(F.lit(1)).alias("n"))
    return rounded(J.join_on(a, b, k))


RANGES_SQL = """ranges as (select cast(p_size as bigint) * 40 as code_start, cast(p_size as bigint) * 40 + 25 as code_end, min(p_brand) as categories from part group by p_size)"""


@query("range_join", "C6", f"""with {RANGES_SQL}
select p_partkey, cast(code_start as double) as code_start, cast(code_end as double) as code_end, categories from part left join ranges on p_partkey between code_start and code_end""")
def _(t):
    size = F.col("p_size").cast("bigint") * 40
    ranges = t("part").groupBy(size.alias("code_start"), (size + 25).alias("code_end")).agg(F.min("p_brand").alias("categories"))
    out = J.range_join(t("part").select("p_partkey"), "p_partkey", ranges, "code_start", "code_end")
    return out.select("p_partkey", *[F.col(c).cast("double").alias(c) for c in ("code_start", "code_end")], "categories")


@query("range_join_widths", "C6", """with c as (select p_partkey, cast(p_partkey as bigint) * 99991 - 50000000 as code from part),
r as (select s_suppkey, cast(s_suppkey as bigint) * 1000003 - 50000000 as lo, cast(s_suppkey as bigint) * 1000003 - 50000000 + cast(pow(10, s_suppkey % 10) as bigint) - 1 as hi from supplier),
h as (select * from c left join r on code between lo and hi)
select p_partkey, cast(count(s_suppkey) as bigint) as n, cast(coalesce(sum(s_suppkey), 0) as bigint) as suppliers, cast(coalesce(min(hi - lo + 1), 0) as bigint) as narrowest from h group by p_partkey""")
def _(t):
    """Ranges from one code to a billion codes wide, codes on both sides of zero."""
    codes = t("part").select("p_partkey", (F.col("p_partkey").cast("bigint") * 99991 - 50000000).alias("code"))
    lo = F.col("s_suppkey").cast("bigint") * 1000003 - 50000000
    ranges = t("supplier").select("s_suppkey", lo.alias("lo"), (lo + F.pow(F.lit(10.0), F.col("s_suppkey") % 10).cast("bigint") - 1).alias("hi"))
    out = J.range_join(codes, "code", ranges, "lo", "hi")
    return rounded(out.groupBy("p_partkey").agg(F.count("s_suppkey").alias("n"), F.coalesce(F.sum("s_suppkey"), F.lit(0)).alias("suppliers"),
                                                F.coalesce(F.min(F.col("hi") - F.col("lo") + 1), F.lit(0)).alias("narrowest")))


@query("semi_join", "C7", """select o_orderkey from orders where o_custkey in (select c_custkey from customer where c_mktsegment = 'BUILDING')""")
def _(t):
    seg = t("customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi(t("orders"), seg, ["o_custkey"]).select("o_orderkey")


@query("anti_join", "C8", """select doc_id from documents where doc_id not in (select doc_id from labels)""")
def _(t):
    return J.anti(t("documents"), t("labels"), ["doc_id"]).select("doc_id")


@query("join_by_position", "C9", f"""with {CASES_SQL},
a as (select yr, caseid, row_number() over (partition by yr order by score, caseid) as rn from cases where st = 'F'),
b as (select yr, caseid as other, row_number() over (partition by yr order by caseid) as rn from cases where st = 'O')
select a.yr, a.caseid, b.other from a join b on a.yr = b.yr and a.rn = b.rn""")
def _(t):
    c = cases(t)
    return J.join_by_position(c.filter("st = 'F'").select("yr", "caseid", "score"),
                              c.filter("st = 'O'").select("yr", F.col("caseid").alias("other")),
                              ["yr"], ["score", "caseid"], ["other"]).drop("score")


@query("join_replicates", "C10", f"""with {CASES_SQL},
a as (select g, yr as rep, avg(score) as m_f from cases where st = 'F' group by all), b as (select g, yr as rep, avg(score) as m_o from cases where st = 'O' group by all)
select g, rep, round(m_f, 4) as m_f, round(m_o, 4) as m_o, round(m_f - m_o, 4) as diff from a join b using (g, rep)""")
def _(t):
    c = cases(t).withColumnRenamed("yr", "rep")
    a = c.filter("st = 'F'").groupBy("g", "rep").agg(F.avg("score").alias("m_f"))
    b = c.filter("st = 'O'").groupBy("g", "rep").agg(F.avg("score").alias("m_o"))
    return rounded(J.join_replicates(a, b, ["g"]).withColumn("diff", F.col("m_f") - F.col("m_o")), 4)


@query("group_aggregate_on_rows", "C11", f"""with {CASES_SQL}
select caseid, g, round(avg(score) over (partition by g), 4) as g_mean, count(*) over (partition by g) as g_n from cases""")
def _(t):
    d = J.with_group_agg(cases(t).select("caseid", "g", "score"), ["g"],
                         {"g_mean": F.avg("score"), "g_n": F.count(F.lit(1))})
    return rounded(d.drop("score"), 4)


@query("sample_pairs", "C12", f"""with {CASES_SQL},
r as (select g, y, caseid, row_number() over (partition by g, y order by caseid) as rn from cases),
sz as (select g, cast(sum(y) as bigint) as n1, cast(sum(1 - y) as bigint) as n0 from cases group by g),
d as (select g, i, {sql_bits('3', '1', 'g', 'i')} % n1 + 1 as p1, {sql_bits('3', '0', 'g', 'i')} % n0 + 1 as p0 from sz cross join range(1, 501) as x(i) where n1 > 0 and n0 > 0)
select d.g, cast(d.i as bigint) as i, a.caseid as id1, b.caseid as id0 from d
join r a on a.g = d.g and a.y = 1 and a.rn = d.p1 join r b on b.g = d.g and b.y = 0 and b.rn = d.p0""")
def _(t):
    return rounded(J.sample_pairs(cases(t).select("g", "y", "caseid"), ["g"], 500, 3, "caseid"))


NEAREST_SQL = """q as (select s_suppkey as qid, s_acctbal as x, cast(s_nationkey as double) as z, cast(s_suppkey % 50 as double) as w, cast(s_nationkey as bigint) as c from supplier),
r as (select c_custkey as rid, c_acctbal as x, cast(c_nationkey as double) as z, cast(c_custkey % 50 as double) as w, cast(c_nationkey as bigint) as c from customer),
pr as (select qid, rid, round(abs(q.x - r.x) + abs(q.z - r.z) + abs(q.w - r.w), 9) as err, case when q.c = r.c then 1.0::double else 0.0::double end as prop from q cross join r),
near as (select * from pr qualify row_number() over (partition by qid order by err, rid) = 1)"""


def near_tables(t):
    q = t("supplier").select(F.col("s_suppkey").alias("qid"), F.col("s_acctbal").alias("x"), F.col("s_nationkey").cast("double").alias("z"),
                             (F.col("s_suppkey") % 50).cast("double").alias("w"), F.col("s_nationkey").alias("c"))
    r = t("customer").select(F.col("c_custkey").alias("rid"), F.col("c_acctbal").alias("x"), F.col("c_nationkey").cast("double").alias("z"),
                             (F.col("c_custkey") % 50).cast("double").alias("w"), F.col("c_nationkey").alias("c"))
    return q, r


@query("nearest_row", "C13", f"""with {NEAREST_SQL} select qid, rid, round(err, 6) as err from near""")
def _(t):
    q, r = near_tables(t)
    return rounded(N.nearest(q, r, ["x", "z", "w"], [], "qid", "rid"))


DIMS = ["a", "b", "c", "d", "e", "f"]
DENSE_SQL = """q as (select s_suppkey as qid, case when s_suppkey % 9 = 0 then null else s_acctbal / 10000 end as a, s_nationkey / 25.0 as b, (s_suppkey % 7) / 7.0 as c, (s_suppkey % 11) / 11.0 as d, (s_suppkey % 3) / 3.0 as e, 0.5::double as f from supplier),
r as (select o_orderkey as rid, o_totalprice / 500000 as a, case when o_orderkey % 13 = 0 then null else (o_custkey % 25) / 25.0 end as b, (o_custkey % 7) / 7.0 as c, (o_orderkey % 11) / 11.0 as d, (o_orderkey % 3) / 3.0 as e, case when o_orderkey % 17 = 0 then null else (o_orderkey % 101) / 101.0 end as f from orders),
g as (select * from r where a is not null and b is not null and f is not null),
pr as (select qid, rid, round(abs(q.a - g.a) + abs(q.b - g.b) + abs(q.c - g.c) + abs(q.d - g.d) + abs(q.e - g.e) + abs(q.f - g.f), 9) as err from q join g on q.a is not null),
near as (select * from pr qualify row_number() over (partition by qid order by err, rid) = 1)"""


@query("nearest_dense", "C13,N2", f"""with {DENSE_SQL} select q.qid, coalesce(rid, -1) as rid, round(err, 6) as err from q left join near using (qid)""")
def _(t):
    """Six columns, all rows within one unit of each other, NULLs on both sides."""
    q = t("supplier").select(F.col("s_suppkey").alias("qid"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal") / 10000).alias("a"), (F.col("s_nationkey") / 25.0).alias("b"),
                             ((F.col("s_suppkey") % 7) / 7.0).alias("c"), ((F.col("s_suppkey") % 11) / 11.0).alias("d"), ((F.col("s_suppkey") % 3) / 3.0).alias("e"), F.lit(0.5).alias("f"))
    r = t("orders").select(F.col("o_orderkey").alias("rid"), (F.col("o_totalprice") / 500000).alias("a"), F.when(F.col("o_orderkey") % 13 != 0, (F.col("o_custkey") % 25) / 25.0).alias("b"),
                           ((F.col("o_custkey") % 7) / 7.0).alias("c"), ((F.col("o_orderkey") % 11) / 11.0).alias("d"), ((F.col("o_orderkey") % 3) / 3.0).alias("e"),
                           F.when(F.col("o_orderkey") % 17 != 0, (F.col("o_orderkey") % 101) / 101.0).alias("f"))
    return rounded(N.nearest(q, r, DIMS, [], "qid", "rid").fillna(-1, ["rid"]))


@query("as_of_count", "C14", """select cast(d as varchar) as d, cast(sum(n) over (order by d) as bigint) as n from (select cast(ts as date) as d, count(*) as n from events group by all)""")
def _(t):
    return rounded(J.running_count(t("events").select(F.to_date("ts").alias("d")), "d"))


@query("column_pairs", "C15", """with a as (select o_custkey as g, avg(case when o_orderstatus = 'F' then o_totalprice end) as f, avg(case when o_orderstatus = 'O' then o_totalprice end) as o,
  avg(case when o_orderstatus = 'P' then o_totalprice end) as p from orders group by all),
l as (select g, 'f' as cn, f as v from a union all select g, 'o', o from a union all select g, 'p', p from a)
select x.cn as cn1, y.cn as cn2, count(*) as n, round(corr(x.v, y.v), 6) as rho from l x join l y on x.g = y.g where x.v is not null and y.v is not null group by all""")
def _(t):
    a = t("orders").groupBy(F.col("o_custkey").alias("g")).agg(*[
        F.avg(F.when(F.col("o_orderstatus") == s.upper(), F.col("o_totalprice"))).alias(s) for s in "fop"])
    pairs = J.column_pairs(a, "g", ["f", "o", "p"])
    return rounded(pairs.groupBy("cn1", "cn2").agg(F.count(F.lit(1)).alias("n"), F.corr("v1", "v2").alias("rho")))


@query("key_overlap", "C16", f"""with {CASES_SQL}, k as (select distinct yr, o_custkey from cases)
select a.yr as p1, b.yr as p2, count(*) as n from k a join k b on a.o_custkey = b.o_custkey group by all""")
def _(t):
    return J.key_overlap(cases(t), "yr", "o_custkey")
