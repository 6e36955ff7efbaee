"""Evaluate the classical way on cached, labelled fields: spark-submit -m fieldloom.evaluate CACHE OUT [--robustness]."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from fieldloom.operators import evaluate as E
from fieldloom.operators import preprocess as P
from fieldloom.operators import segment as S
from fieldloom.sources.sinks import load_cached, write_results


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    """Metrics of every image, their means, and on demand the table of corruptions, as folders under OUT."""
    parser = argparse.ArgumentParser(description=__doc__)
    parser.add_argument("cache")
    parser.add_argument("out")
    parser.add_argument("--threshold", default="otsu")
    parser.add_argument("--robustness", action="store_true")
    args = parser.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    fields = load_cached(spark, args.cache)
    how = S.Classical(threshold=args.threshold)

    def segment(a):
        return S.classical_instances(P.preprocess_field(a)[0], how)

    table = E.evaluate_fields(fields, segment)
    write_results(table, f"{args.out}/per_image")
    write_results(E.summary(table), f"{args.out}/summary", "json", single=True)
    if args.robustness:
        write_results(E.evaluate_robustness(fields, segment), f"{args.out}/robustness", single=True)


if __name__ == "__main__":
    main()
