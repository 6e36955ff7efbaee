"""Caches and result tables: Parquet in parts for further work, CSV and JSON for readers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.sources.fields import skip_existing


def list_samples(spark: SparkSession, folder: str) -> DataFrame:
    """image_id of every sub-folder that has a folder images with a file, sorted; a missing root is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path")
    ids = files.select(F.regexp_extract("path", r"/([^/]+)/images/[^/]+$", 1).alias("image_id"))
    return ids.where("image_id <> ''").distinct().orderBy("image_id")


def write_cache(fields: DataFrame, path: str, overwrite: bool = False, limit: int = 0) -> int:
    """Append fields that the cache does not hold yet, by image_id; how many. overwrite starts it anew; limit 0: all."""
    spark = fields.sparkSession
    wanted = fields.orderBy("image_id").limit(limit) if limit else fields
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    exists = there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there)
    if exists and not overwrite:
        wanted = skip_existing(wanted, spark.read.parquet(path).select("image_id"))
    n = wanted.count()
    wanted.write.mode("overwrite" if overwrite or not exists else "append").parquet(path)
    return n


def load_cached(spark: SparkSession, path: str, ids: list | None = None) -> DataFrame:
    """The cached fields, or those with the given ids; the filter reaches the scan."""
    cached = spark.read.parquet(path)
    return cached if ids is None else cached.where(F.col("image_id").isin(ids))


def write_results(table: DataFrame, path: str, kind: str = "csv", single: bool = False) -> None:
    """A result table as csv (with a header), json or parquet; arrays in csv are joined. single: one file, for readers."""
    if kind not in ("csv", "json", "parquet"):
        raise ValueError(f"unknown kind of results {kind!r}")
    if kind == "csv":
        flat = {f.name: F.array_join(f.name, "; ") for f in table.schema.fields if f.dataType.typeName() == "array"}
        table = table.withColumns(flat) if flat else table
    out = (table.coalesce(1) if single else table).write.mode("overwrite")
    (out.option("header", True).csv if kind == "csv" else getattr(out, kind))(path)
