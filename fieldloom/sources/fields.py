"""Fields: one row per image with height, width and a row-major pixel array; the long pixel view explodes late."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_fields(spark: SparkSession, sf_dir: str, side: int = 8) -> DataFrame:
    """image_id, height, width, data (array<double>) from the vectors of the test tables, as side x side fields."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select(F.col("vec_id").alias("image_id"), F.lit(side).alias("height"), F.lit(side).alias("width"), F.col("embedding").cast("array<double>").alias("data"))


def pixels(fields: DataFrame, *columns: str) -> DataFrame:
    """image_id, y, x and the given array columns' values, one row a pixel."""
    columns = columns or ("data",)
    rows = fields.select("image_id", "width", F.posexplode(F.arrays_zip(*columns)).alias("p", "z"))
    return rows.select("image_id", F.floor(F.col("p") / F.col("width")).cast("int").alias("y"), (F.col("p") % F.col("width")).cast("int").alias("x"), *(F.col(f"z.{c}").alias(c) for c in columns))


def list_images(spark: SparkSession, folder: str) -> DataFrame:
    """Paths of images directly in a folder, sorted; suffixes tif, tiff, png, jpg, jpeg and bmp in any case."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(folder).select("path", "length", "modificationTime")
    return rows.where(F.lower("path").rlike(r"\.(tiff?|png|jpe?g|bmp)$")).orderBy("path")


def skip_existing(wanted: DataFrame, cached: DataFrame, overwrite: bool = False) -> DataFrame:
    """Rows whose image_id is not cached yet."""
    return wanted if overwrite else wanted.join(cached.select("image_id").distinct(), "image_id", "left_anti")
