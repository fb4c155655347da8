"""Registered queries of section 2.A: scans, reconciliation, sinks. Files are written by Spark from the
given tables into the session's work folder and read back."""

from __future__ import annotations

import io

from pyspark.sql import functions as F

from ..sources import files as S
from ..streaming.monitor_stream import work_folder
from .registry import CASES_SQL, cases, query, rounded


def _year(t):
    return t("orders").withColumn("yr", F.year("o_orderdate").cast("bigint"))


@query("scan_tree", "A1", """select cast(year(o_orderdate) as bigint) as yr, count(*) as n, cast(sum(o_orderkey) as bigint) as checksum from orders where year(o_orderdate) between 1996 and 1999 group by 1""")
def _(t):
    o = _year(t).select("o_orderkey", "yr")
    path = work_folder(o.sparkSession, "tree")
    o.write.partitionBy("yr").csv(path)
    d = S.scan_tree(o.sparkSession, path, r"yr=199[6-9]/")
    return (d.groupBy(F.regexp_extract("_path", r"yr=(\d+)", 1).cast("bigint").alias("yr"))
            .agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("_c0").cast("bigint")).alias("checksum")))


@query("read_delim", "A2", """select o_orderkey, 'é' || o_orderpriority as prio, round(o_totalprice, 2) as price from orders""")
def _(t):
    o = t("orders").select("o_orderkey", F.concat(F.lit("é"), "o_orderpriority").alias("prio"), F.round("o_totalprice", 2).alias("price"))
    path = work_folder(o.sparkSession, "tsv")
    o.write.options(header=True, sep="\t", encoding="ISO-8859-1").csv(path)
    return rounded(S.read_delim(o.sparkSession, path, "\t", "ISO-8859-1", "o_orderkey bigint, prio string, price double"))


@query("ingest_stata", "A3", """select st, count(*) as n, cast(sum(caseid) as bigint) as checksum, round(sum(price), 1) as price from (select o_orderkey as caseid, o_orderstatus as st, o_totalprice as price from orders) group by st""")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("CaseID"), F.col("o_orderstatus").alias("ST"), F.col("o_totalprice").alias("Price"))

    def to_stata(batches):
        import pandas as pd
        for pdf in batches:
            buf = io.BytesIO()
            pdf.to_stata(buf, write_index=False)
            yield pd.DataFrame({"content": [buf.getvalue()]})

    blobs = o.mapInPandas(to_stata, "content binary")
    d = S.parse_stata(blobs, "caseid bigint, st string, price double")
    return rounded(d.groupBy("st").agg(F.count(F.lit(1)).alias("n"), F.sum("caseid").alias("checksum"), F.sum("price").alias("price")), 1)


@query("column_subset", "A4", """select l_suppkey, count(*) as n, cast(max(l_linenumber) as bigint) as top from lineitem group by 1""")
def _(t):
    return rounded(t("lineitem").select("l_suppkey", "l_linenumber").groupBy("l_suppkey").agg(F.count(F.lit(1)).alias("n"), F.max("l_linenumber").alias("top")))


@query("normalise_columns", "A5", """select o_orderkey as caseid, o_orderpriority as prio from orders""")
def _(t):
    o = t("orders").select(F.col("o_orderkey").alias("CASEID"), F.col("o_orderpriority").alias("O_OrderPriority"))
    return S.normalise_columns(o, {"o_orderpriority": "prio"})


def extracts(t):
    """Seven yearly extracts with drifting headers, types and columns."""
    o = _year(t)
    frames = []
    for yr in range(1995, 2002):
        d = o.filter(F.col("yr") == yr).select("o_orderkey", "yr", "o_orderstatus", "o_totalprice", "o_orderpriority")
        if yr % 2:
            d = d.toDF(*[c.upper() for c in d.columns])
        if yr == 1997:
            d = d.withColumn("O_TOTALPRICE", F.col("O_TOTALPRICE").cast("string"))
        if yr < 1998:
            d = d.drop("o_orderpriority", "O_ORDERPRIORITY")
        frames.append(S.normalise_columns(d, {"o_orderkey": "caseid"}))
    return frames


@query("reconcile_schema", "A6", """select 'caseid' as name, 'bigint' as dtype, 7::bigint as n_files, count(*) as n_values from orders union all
select 'yr', 'bigint', 7, count(*) from orders union all select 'o_orderstatus', 'string', 7, count(*) from orders union all
select 'o_totalprice', 'double', 7, count(*) from orders union all select 'o_orderpriority', 'string', 4, count(*) from orders where year(o_orderdate) >= 1998""")
def _(t):
    frames = extracts(t)
    kinds = S.reconcile_schema(frames)
    u = S.union_periods(frames, kinds)
    wide = u.agg(*[F.count(c).alias(c) for c in kinds])
    files = {c: sum(c in f.columns for f in frames) for c in kinds}
    out = wide.unpivot([], list(kinds), "name", "n_values")
    pick = F.create_map(*[x for c, k in kinds.items() for x in (F.lit(c), F.lit(k))])
    nf = F.create_map(*[x for c, k in files.items() for x in (F.lit(c), F.lit(k))])
    return rounded(out.select("name", pick[F.col("name")].alias("dtype"), nf[F.col("name")].alias("n_files"), "n_values"))


@query("union_periods", "A7", """select o_orderkey as caseid, cast(year(o_orderdate) as bigint) as yr, o_orderstatus, round(o_totalprice, 2) as o_totalprice, case when year(o_orderdate) >= 1998 then o_orderpriority end as o_orderpriority from orders""")
def _(t):
    return rounded(S.union_periods(extracts(t)).select("caseid", "yr", "o_orderstatus", "o_totalprice", "o_orderpriority"), 2)


@query("contract_checks", "A8", """select 'not_null:o_orderkey' as rule, 0::bigint as violations union all select 'domain:o_orderstatus', (select count(*) from orders where o_orderstatus not in ('F', 'O'))
union all select 'unique:o_orderkey', (select count(*) - count(distinct o_orderkey) from orders) union all select 'unique:o_custkey', (select count(*) - count(distinct o_custkey) from orders) union all select 'known_columns', 1
union all select 'rows_align', (select count(*) from documents where doc_id not in (select doc_id from labels))""")
def _(t):
    o = t("orders")
    a = S.check(o, [c for c in o.columns if c != "o_orderdate"], ["o_orderkey"], {"o_orderstatus": ["F", "O"]}, ["o_orderkey"])
    return a.unionByName(S.check(o, unique=["o_custkey"])).unionByName(S.row_counts_align(t("documents"), t("labels"), ["doc_id"]))


@query("write_table", "A9", """select cast(year(o_orderdate) as bigint) as yr, count(*) as n, round(sum(o_totalprice), 1) as total from orders group by 1""")
def _(t):
    o = _year(t)
    path = work_folder(o.sparkSession, "table")
    S.write_table(o, path, "yr")
    back = o.sparkSession.read.parquet(path)
    return rounded(back.groupBy(F.col("yr").cast("bigint").alias("yr")).agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 1)


@query("materialise", "A10", f"""with {CASES_SQL} select g, count(*) as n, cast(sum(y) as bigint) as events, 1::bigint as reused from cases group by g""")
def _(t):
    root = work_folder(t("orders").sparkSession, "results")

    def build(src):
        return cases(lambda _: src).groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))

    first = S.materialise(root, "by_group", t("orders"), build)
    again = S.materialise(root, "by_group", t("orders"), build)
    other = S.materialise(root, "by_group", t("orders"), lambda src: build(src.filter("o_orderkey > 5")))
    reused = sorted(first.inputFiles()) == sorted(again.inputFiles()) and not set(first.inputFiles()) & set(other.inputFiles())
    return rounded(again.withColumn("reused", F.lit(int(reused))))


@query("read_results", "A11", """select case when o_orderstatus = 'F' then 'logit' else 'gbt' end as model, lower(substr(o_orderpriority, 3)) as outcome, count(*) as n, round(sum(o_totalprice), 1) as total from orders group by all""")
def _(t):
    o = t("orders").select(F.when(F.col("o_orderstatus") == "F", "logit").otherwise("gbt").alias("model"), F.lower(F.substring("o_orderpriority", 3, 20)).alias("outcome"), "o_totalprice")
    path = work_folder(o.sparkSession, "scores")
    o.write.partitionBy("model", "outcome").options(header=True).csv(path)
    d = S.read_results(o.sparkSession, path, r"model=([^/]+)/outcome=([^/]+)", ["model", "outcome"], "o_totalprice double")
    return rounded(d.groupBy("model", "outcome").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total")), 1)


DICT_SQL = """dct as (select p_type || '_' || cast(p_size % 5 as varchar) as variable_name, p_name as variable_label, cast(p_size as bigint) as source_year, p_partkey as pos from part)"""


def dictionary(t):
    return t("part").select(F.concat("p_type", F.lit("_"), (F.col("p_size") % 5).cast("string")).alias("variable_name"),
                            F.col("p_name").alias("variable_label"), F.col("p_size").cast("bigint").alias("source_year"), F.col("p_partkey").alias("pos"))


@query("first_definition", "A12", f"""with {DICT_SQL} select * from dct qualify row_number() over (partition by variable_name order by source_year, pos) = 1""")
def _(t):
    return S.first_definition(dictionary(t), "variable_name", ["source_year", "pos"])


@query("find_vars", "A13", f"""with {DICT_SQL} select * from dct where regexp_matches(variable_name, '^(PROMO|ECO).*[13]$') or regexp_matches(variable_label, 'ring$')""")
def _(t):
    return S.find_vars(dictionary(t), ["variable_name"], "^(PROMO|ECO).*[13]$").unionByName(
        S.find_vars(dictionary(t), ["variable_label"], "ring$")).distinct()
