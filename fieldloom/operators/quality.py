"""Field summaries and plausibility without ground truth."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldloom.functions import arrays as A

#: Signal, kind of ramp, limit, width; what a low-foreground field is measured by is its own limit.
RULES = (
    ("foreground_high", "foreground_fraction", "above", 0.45, 0.15), ("foreground_low", "foreground_fraction", "below", 0.0005, 0.0005), ("density", "object_density_per_mp", "above", 20000.0, 10000.0),
    ("area_cv", "area_cv", "above", 1.0, 0.6), ("tiny", "tiny_fraction", "above", 0.35, 0.2), ("solidity", "median_solidity", "below", 0.88, 0.04),
    ("circularity", "median_circularity", "below", 0.60, 0.12), ("predictive", "predictive_confidence", "below", 0.72, 0.06),
)
PASS = 0.55


#: What a flag says, by rule: text with one number, and how the signal becomes that number and is written.
FLAGS = {
    "foreground_high": ("implausible foreground coverage (%.0f%% of the image)", 100, 0), "foreground_low": ("almost no foreground detected (%.3f%%)", 100, 3),
    "density": ("implausible object density (%.0f objects/megapixel)", 1, 0), "area_cv": ("object sizes vary implausibly (CV %.2f); likely fragmentation", 1, 2),
    "tiny": ("%.0f%% of objects far below median size; likely fragmentation", 100, 0), "solidity": ("low median solidity (%.2f); objects may be merged nuclei", 1, 2),
    "circularity": ("objects are unusually irregular (median circularity %.2f)", 1, 2), "predictive": ("model is uncertain (mean class probability %.2f)", 1, 2),
}
SUMMARIZED = ("area_px", "perimeter_crofton_px", "circularity", "eccentricity", "solidity")


def image_summary(images: DataFrame, objects: DataFrame, columns: tuple[str, ...] = SUMMARIZED) -> DataFrame:
    """Object count, border count, mean, population deviation and median of columns, and the mean of every column that ends
    with mean_intensity or glcm_contrast; images without objects stay."""
    aggs = [e for c in columns for e in (F.avg(c).alias(f"{c}_mean"), F.stddev_pop(c).alias(f"{c}_std"), F.expr(f"percentile({c}, 0.5)").alias(f"{c}_median"))]
    aggs += [F.avg(c).alias(f"{c}_mean") for c in objects.columns if c.endswith(("mean_intensity", "glcm_contrast"))]
    got = objects.groupBy("image_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("touches_border").alias("b"), *aggs)
    out = images.select("image_id").distinct().join(got, "image_id", "left")
    return out.select("image_id", F.coalesce("n", F.lit(0)).alias("n_objects"), F.coalesce("b", F.lit(0)).alias("n_border_objects"), *(F.col(c) for c in got.columns if c not in ("image_id", "n", "b")))


def results_table(parts: list[DataFrame]) -> DataFrame:
    """Tables of several runs as one; columns that a part lacks are null there."""
    if not parts:
        raise ValueError("no tables")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def signals(images: DataFrame, objects: DataFrame, tiny: float = 0.15) -> DataFrame:
    """Signals of every image. images: image_id, n_pixels, n_foreground, n_labels, and predictive_confidence where there are
    probabilities; objects: image_id, area_px, circularity, touches_border, solidity."""
    medians = {f"median_{c}": F.expr(f"percentile({c}, 0.5)") for c in ("area_px", "circularity", "solidity") if c in objects.columns}
    # deviation over mean from sums that are exact for pixel counts: a running deviation depends on the rows' order
    area = F.col("area_px").cast("double")
    spread = F.sqrt(F.greatest(F.count(area) * F.sum(area * area) - F.sum(area) * F.sum(area), F.lit(0.0)))
    middle = objects.groupBy("image_id").agg(*(e.alias(c) for c, e in medians.items()), F.try_divide(spread, F.sum(area)).alias("area_cv"), F.avg(F.col("touches_border").cast("double")).alias("border_fraction"))
    small = objects.select("image_id", "area_px").join(middle.select("image_id", "median_area_px"), "image_id").groupBy("image_id").agg(F.avg((F.col("area_px") < tiny * F.col("median_area_px")).cast("double")).alias("tiny_fraction"))
    out = images.join(middle, "image_id", "left").join(small, "image_id", "left")
    more = [c for c in ("median_solidity", "predictive_confidence") if c in out.columns]
    return out.select(
        "image_id", F.col("n_labels").cast("double").alias("n_objects"), A.guarded(F.col("n_foreground"), F.col("n_pixels")).alias("foreground_fraction"),
        A.guarded(F.col("n_labels") * 1e6, F.col("n_pixels")).alias("object_density_per_mp"), "median_area_px", "area_cv", "tiny_fraction", "median_circularity", "border_fraction", *more,
    )


def assess(table: DataFrame, rules=RULES) -> DataFrame:
    """Penalties by rule, their joint confidence, verdict and flags; a missing signal brings no penalty."""
    used = [r for r in rules if r[1] in set(table.columns)]
    out = table.withColumns({f"penalty_{name}": (A.ramp_above if kind == "above" else A.ramp_below)(F.col(signal), limit, width) for name, signal, kind, limit, width in used})
    product = F.lit(1.0)
    for name, *_ in used:
        product = product * (1.0 - F.col(f"penalty_{name}"))
    empty = F.col("n_objects") <= 0

    def flag(name, signal):
        text, factor, digits = FLAGS[name]
        return F.when(F.col(f"penalty_{name}") > 0, F.format_string(text, A.round_even(F.col(signal) * factor, digits)))

    flags = F.filter(F.array(*(flag(n, s) for n, s, *_ in used)), lambda x: x.isNotNull())
    out = out.withColumn("confidence", F.when(empty, F.lit(0.0)).otherwise(product))
    out = out.withColumn("flags", F.when(empty, F.array(F.lit("no objects detected"))).otherwise(flags))
    return out.withColumns({"passed": (F.col("confidence") >= PASS) & ~empty, "n_flags": F.size("flags"), "flags": F.array_join("flags", "; ")})


def report(assessed: DataFrame) -> DataFrame:
    """The assessment under the names of result tables: numbers rounded, penalties that are 0 null."""
    penalties = [c for c in assessed.columns if c.startswith("penalty_")]
    signal_columns = [c for c in assessed.columns if c not in {"image_id", "confidence", "flags", "passed", "n_flags", *penalties}]
    empty = F.col("n_objects") <= 0
    return assessed.select(
        "image_id", A.round_away(F.col("confidence"), 4).alias("qc_confidence"), F.col("passed").alias("qc_passed"), F.col("flags").alias("qc_flags"), F.col("n_flags").alias("qc_n_flags"),
        *(A.round_away(F.col(c), 5).alias(f"qc_{c}") for c in signal_columns), *(F.when(~empty & (F.col(c) > 0), A.round_away(F.col(c), 5)).alias(f"qc_{c}") for c in penalties),
    )


def validation(table: DataFrame) -> DataFrame:
    """How well the verdict tells failures: table with failed, flagged (booleans), confidence, dice and ap."""
    failed, flagged = F.col("failed"), F.col("flagged")
    n = lambda c: F.count_if(c)
    mean = lambda c, by: F.round(F.avg(F.when(by, F.col(c))), 4)
    return table.agg(
        F.count(F.lit(1)).alias("n"), n(failed).alias("n_failures"), n(flagged).alias("n_flagged"), n(failed & flagged).alias("caught"), n(failed & ~flagged).alias("missed"), n(~failed & flagged).alias("false_alarms"),
        F.round(F.try_divide(n(failed & flagged).cast("double"), n(failed).cast("double")), 4).alias("catch_rate"),
        F.round(n(~failed & flagged) / F.greatest(n(~failed), F.lit(1)), 4).alias("false_alarm_rate"), F.round(F.corr("confidence", "dice"), 4).alias("corr"),
        mean("dice", ~flagged).alias("dice_passed"), mean("dice", flagged).alias("dice_flagged"), mean("ap", ~flagged).alias("ap_passed"), mean("ap", flagged).alias("ap_flagged"),
    )
