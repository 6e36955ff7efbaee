"""Segment and measure cached fields: spark-submit -m fieldloom.predict CACHE OUT [--threshold otsu]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fieldloom.operators import measure as M
from fieldloom.operators import preprocess as P
from fieldloom.operators import quality as Q
from fieldloom.operators import segment as S
from fieldloom.sources.sinks import load_cached, write_results


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Objects, a summary of every field and its quality report, as folders of csv under OUT."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("cache")
    parser.add_argument("out")
    parser.add_argument("--threshold", default="otsu")
    parser.add_argument("--pixel-size", type=float)
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    fields = load_cached(spark, args.cache).select("image_id", "height", "width", "data").withColumn("raw", F.col("data"))
    labelled = S.segment_fields(P.preprocess_fields(fields), S.Classical(threshold=args.threshold))
    labelled = labelled.withColumn("data", F.col("raw")).drop("raw")  # measured as recorded
    objects = M.feature_table(labelled, pixel_size_um=args.pixel_size)
    images = labelled.select("image_id", F.size("labels").alias("n_pixels"), F.size(F.filter("labels", lambda v: v > 0)).alias("n_foreground"), F.array_max("labels").alias("n_labels"))
    write_results(objects, f"{args.out}/objects")
    write_results(Q.image_summary(images, objects), f"{args.out}/images", single=True)
    write_results(Q.report(Q.assess(Q.signals(images, objects))), f"{args.out}/quality", single=True)


if __name__ == "__main__":
    main()
