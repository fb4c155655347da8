"""Scans, reconciliation, sinks and reuse of results (section 2.A)."""

from __future__ import annotations

import hashlib
import io
import re
import uuid
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F


def scan_tree(spark: SparkSession, path: str, pattern: str, fmt: str = "csv", **options) -> DataFrame:
    """All files of a folder tree whose path matches the regular expression, with _path.

    The listing is distributed by the source; files that do not match are filtered on file metadata.
    """
    df = spark.read.options(recursiveFileLookup=True, **options).format(fmt).load(path)
    return df.select("*", F.col("_metadata.file_path").alias("_path")).filter(F.col("_path").rlike(pattern))


def read_delim(spark: SparkSession, path: str, sep: str = ",", encoding: str = "UTF-8", schema: str | None = None) -> DataFrame:
    """Delimited text with a header; without a schema every column is text (no extra pass to infer)."""
    reader = spark.read.options(header=True, sep=sep, encoding=encoding)
    return (reader.schema(schema) if schema else reader).csv(path)


def parse_stata(contents: DataFrame, schema: str, chunk_rows: int = 50_000) -> DataFrame:
    """Rows of Stata files from a (path, content) frame, one file per task, read in chunks."""
    names = [p.strip().split()[0] for p in schema.split(",")]

    def parse(batches):
        for pdf in batches:
            for blob in pdf["content"]:
                with pd.read_stata(io.BytesIO(bytes(blob)), chunksize=chunk_rows, convert_categoricals=False) as reader:
                    for part in reader:
                        part.columns = [c.lower() for c in part.columns]
                        for absent in [c for c in names if c not in part.columns]:
                            part[absent] = pd.Series([None] * len(part), index=part.index, dtype=object)
                        yield part[names]

    return contents.select("content").mapInPandas(parse, schema)


def ingest_stata(spark: SparkSession, path: str, schema: str, pattern: str = "*.dta") -> DataFrame:
    """Stata files below ``path`` as a table; write it to Parquet before using it more than once."""
    files = spark.read.format("binaryFile").options(pathGlobFilter=pattern, recursiveFileLookup=True).load(path)
    return parse_stata(files, schema)


def normalise_columns(df: DataFrame, renames: dict[str, str] | None = None) -> DataFrame:
    """Lower-case headers, then rename by map."""
    low = [c.lower() for c in df.columns]
    return df.toDF(*[(renames or {}).get(c, c) for c in low])


def reconcile_schema(frames: list[DataFrame]) -> dict[str, str]:
    """Most frequent type per column over the frames; ties: type name last in the alphabet.

    Schemas are plan metadata; no data is read.
    """
    votes: dict[str, dict[str, int]] = {}
    for df in frames:
        for name, kind in df.dtypes:
            votes.setdefault(name, {}).setdefault(kind, 0)
            votes[name][kind] += 1
    return {name: max(v, key=lambda k: (v[k], k)) for name, v in votes.items()}


def union_periods(frames: list[DataFrame], kinds: dict[str, str] | None = None) -> DataFrame:
    """Frames stacked by column name after casting to the reconciled types; absent columns are NULL,
    values that do not fit the type become NULL."""
    kinds = kinds or reconcile_schema(frames)
    cast = [df.select(*[F.col(c).try_cast(kinds[c]).alias(c) for c in df.columns]) for df in frames]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), cast)


def check(df: DataFrame, known: list[str] | None = None, unique: list[str] | None = None,
          domains: dict[str, list] | None = None, not_null: list[str] | None = None) -> DataFrame:
    """Contract checks: rule, violations. Column rules and domains are one aggregation, uniqueness one
    grouped count."""
    parts = []
    aggs = {}
    for c in not_null or []:
        aggs[f"not_null:{c}"] = F.sum(F.col(c).isNull().cast("bigint"))
    for c, values in (domains or {}).items():
        aggs[f"domain:{c}"] = F.sum((~F.coalesce(F.col(c).isin(*values), F.lit(False))).cast("bigint"))
    if aggs:
        wide = df.agg(*[F.coalesce(e, F.lit(0)).alias(n) for n, e in aggs.items()])
        parts.append(wide.unpivot([], [f"`{n}`" for n in aggs], "rule", "violations"))
    if unique:
        extra = df.groupBy(*unique).agg((F.count(F.lit(1)) - 1).alias("_x")).agg(F.coalesce(F.sum("_x"), F.lit(0)).alias("violations"))
        parts.append(extra.select(F.lit("unique:" + ",".join(unique)).alias("rule"), "violations"))
    if known is not None:
        strange = sorted(set(df.columns) - set(known))
        parts.append(df.sparkSession.createDataFrame([("known_columns", len(strange))], "rule string, violations bigint"))
    return reduce(DataFrame.unionByName, parts)


def row_counts_align(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys of either frame that the other lacks: rule, violations."""
    only = a.select(*keys).exceptAll(b.select(*keys)).unionByName(b.select(*keys).exceptAll(a.select(*keys)))
    return only.agg(F.count(F.lit(1)).alias("violations")).select(F.lit("rows_align").alias("rule"), "violations")


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """Parquet, by period where given. A period is spread over as many files as tasks hold it, so a large
    period is not written by one task."""
    writer = df.write.mode(mode)
    (writer.partitionBy(partition) if partition else writer).parquet(path)


def fingerprint(df: DataFrame, *extra: str) -> str:
    """Identity of what a frame reads: input files with size and time, and extra parameters.

    Only the listing is read, never file contents.
    """
    spark = df.sparkSession
    files = df.inputFiles()
    if not files:
        return re.sub(r"\W+", "_", "_".join(extra)) or "none"
    listing = spark.read.format("binaryFile").load(files).select("path", "length", "modificationTime")
    row = listing.agg(F.bit_xor(F.xxhash64("path", "length", F.unix_micros("modificationTime"))).alias("h"), F.count(F.lit(1)).alias("n")).first()
    tail = spark.range(1).select(F.xxhash64(F.lit("|".join(extra)))).first()[0] if extra else 0
    return f"{row['h'] & 0xFFFFFFFFFFFFFFFF:016x}-{row['n']}-{tail & 0xFFFFFFFFFFFFFFFF:016x}"


def plan_key(df: DataFrame) -> str:
    """Digest of what a frame computes: its analysed plan, with the ids of columns made alike."""
    plan = df._jdf.queryExecution().analyzed().canonicalized().toString()
    plain = re.sub(r"#\d+L?|plan_id=\d+|@[0-9a-f]{4,}", "#", plan)
    return hashlib.sha256(plain.encode()).hexdigest()[:32]


def materialise(root: str, name: str, source: DataFrame, builder: Callable[[DataFrame], DataFrame], *params: str) -> DataFrame:
    """Reuse the stored result of builder(source), or compute and store it.

    The address is made of the plan that the builder gives, the listing of the files it reads, name and parameters, so a
    changed filter, builder or file computes anew and an equal plan reuses. What a Python function inside the plan does is not
    part of the plan: name its version in ``params``. A source without files is refused, as nothing tells two of them
    apart. Results are written beside their address and moved there when whole, so a half-written one is never read.
    """
    spark, built = source.sparkSession, builder(source)
    if not built.inputFiles():
        raise ValueError(f"{name}: reads no files")
    path = f"{root}/{name}/{plan_key(built)}-{fingerprint(built, name, *params)}"
    java = spark._jvm.org.apache.hadoop.fs.Path
    fs = java(path).getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(java(f"{path}/_SUCCESS")):
        made = f"{path}-{uuid.uuid4().hex}"
        built.write.parquet(made)
        if not fs.rename(java(made), java(path)) and not fs.exists(java(f"{path}/_SUCCESS")):
            return spark.read.parquet(made)  # the store does not move folders: this run's own copy
    return spark.read.parquet(path)


def read_results(spark: SparkSession, path: str, pattern: str, keys: list[str], schema: str) -> DataFrame:
    """Result files whose keys stand in their path: one column per group of the pattern.

    Paths are escaped twice, as folder names and as addresses; keys come back as they were written.
    """
    df = spark.read.options(recursiveFileLookup=True, header=True).schema(schema).csv(path)
    where = F.col("_metadata.file_path")
    plain = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    return df.select("*", *[plain(plain(F.regexp_extract(where, pattern, i + 1))).alias(k) for i, k in enumerate(keys)]).filter(
        F.col(keys[0]) != "")


def first_definition(dictionary: DataFrame, var: str, order: list[str]) -> DataFrame:
    """The earliest definition of each variable."""
    rest = [c for c in dictionary.columns if c != var]
    return (dictionary.groupBy(var).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_d"))
            .select(var, *[F.col(f"_d.{c}").alias(c) for c in rest]))


def find_vars(dictionary: DataFrame, cols: list[str], pattern: str) -> DataFrame:
    """Dictionary entries with any of the columns matching the regular expression."""
    return dictionary.filter(reduce(lambda a, b: a | b, [F.col(c).rlike(pattern) for c in cols]))
