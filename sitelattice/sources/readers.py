"""Readers and writers for event files, record files and site matrices."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def files_by_header(spark: SparkSession, paths) -> dict[str, list[str]]:
    """Header line -> files that begin with it; one distributed pass over the files' lines.

    The driver holds a path per file, as it does to plan any scan of them.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line")).alias("at"))
    first = lines.groupBy("file").agg(F.min_by("value", "at").alias("header"))
    found = first.groupBy("header").agg(F.sort_array(F.collect_list("file")).alias("files")).orderBy("header")
    return {r["header"]: r["files"] for r in found.collect()}


def _by_name(spark: SparkSession, paths, wanted) -> DataFrame:
    """Files stacked by column name, those of one header read together; strings."""
    parts = []
    for files in files_by_header(spark, paths).values():
        raw = spark.read.option("header", True).option("escape", '"').csv(files)
        parts.append(raw.select(*[F.col(f"`{c}`") for c in raw.columns if wanted(c)]))
    if not parts:
        return spark.read.option("header", True).option("escape", '"').csv(paths)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_csv(spark: SparkSession, paths, columns: dict[str, str]) -> DataFrame:
    """Declared columns of CSV files with a header, matched by name and cast to declared types.

    Nothing is inferred; unparseable values become NULL, as does a column that a file lacks, and
    other columns are pruned. The files may order their columns differently.
    """
    raw = _by_name(spark, paths, lambda c: c in columns)
    return raw.select(*[(F.col(f"`{c}`") if c in raw.columns else F.lit(None).cast("string")).try_cast(t).alias(c)
                        for c, t in columns.items()])


def read_csv_with_banner(spark: SparkSession, paths, header: list[str]) -> DataFrame:
    """Same-schema files stacked, some with a notes line above the header.

    The column names are known: a line with another number of fields is a banner, a line that
    repeats the names is a header.
    """
    schema = ", ".join(f"`{h}` string" for h in header)
    fields = F.size(F.split(F.regexp_replace("value", r'"(?:[^"]|"")*"', ""), ",", -1))
    lines = spark.read.text(paths).where(fields == len(header))
    rows = lines.select(F.from_csv("value", schema, {"escape": '"'}).alias("r")).select("r.*")
    named = reduce(lambda a, b: a & b, [F.col(f"`{h}`").eqNullSafe(F.lit(h)) for h in header])
    return rows.where(~named)


def read_csv_union(spark: SparkSession, pattern: str, wanted) -> DataFrame:
    """All files of a glob by column name, keeping the columns ``wanted(name)`` accepts, as strings."""
    return _by_name(spark, pattern, wanted)


def read_delimited(spark: SparkSession, paths, names: list[str], needed: int, sep: str = "|") -> DataFrame:
    """Headerless files with positional fields; rows with fewer than ``needed`` are skipped."""
    parts = F.split(F.col("value"), "\\" + sep, -1)
    text = spark.read.text(paths).select(parts.alias("f")).where(F.size("f") >= needed)
    return text.select(*[F.when(F.size("f") > i, F.nullif(F.trim(F.col("f")[i]), F.lit(""))).alias(n)
                         for i, n in enumerate(names)])


def file_name() -> Column:
    return F.element_at(F.split(F.input_file_name(), "/"), -1)


def is_performance_file(name: Column) -> Column:
    """Monthly history files are named ``*_time_*`` or ``perf*``; the others are originations."""
    return F.lower(name).rlike("_time_|(^|/)perf[^/]*$")


def read_wide_csv(spark: SparkSession, path: str, id_cols: list[str]) -> DataFrame:
    """Numeric CSV with many columns: everything but the ids becomes DOUBLE."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(*[F.col(c) if c in id_cols else F.col(c).try_cast("double").alias(c)
                        for c in raw.columns])


def read_jobs(spark: SparkSession, path, fields: dict[str, str]) -> DataFrame:
    """Job records, one JSON object per line, with a declared schema."""
    return spark.read.schema(", ".join(f"{k} {t}" for k, t in fields.items())).json(path)


def params_key(params: dict) -> str:
    """Hash of every parameter that changes the cohort; part of the matrix's path."""
    text = json.dumps(params, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def write_site_matrix(df: DataFrame, root: str, name: str, params: dict, site: str = "site") -> str:
    """Write partitioned by site under a path that names the parameters; returns the path.

    Rows of a site may come from many tasks, so a large site is many files, not one task.
    """
    path = f"{root}/{name}/{params_key(params)}"
    df.write.mode("overwrite").partitionBy(site).parquet(path)
    return path


def catalog(spark: SparkSession, root: str) -> list[str]:
    """Names of the matrices under a root."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    return sorted(s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory())


def load_site_matrix(spark: SparkSession, root: str, name: str, params: dict) -> DataFrame:
    """Read a matrix built with exactly these parameters; a miss lists what exists."""
    path = f"{root}/{name}/{params_key(params)}"
    if params_key(params) not in catalog(spark, f"{root}/{name}"):
        raise FileNotFoundError(
            f"no matrix {name!r} with these parameters under {root}; available: {catalog(spark, root)}")
    return spark.read.parquet(path)


def write_rows(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Decision or rule rows as parquet or CSV with a header."""
    w = df.write.mode("overwrite")
    w.parquet(path) if fmt == "parquet" else w.option("header", True).csv(path)
