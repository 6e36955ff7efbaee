"""Labelled fields: relabelling, per-object geometry, intensity and co-occurrence texture."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldloom.functions import arrays as A
from fieldloom.operators import kernels as K
from fieldloom.sources.fields import pixels

#: Offsets of the co-occurrence matrices: distances 1 and 3, four directions, as rounded polar steps.
OFFSETS = ((1, 0, 1), (1, 1, 1), (1, 1, 0), (1, 1, -1), (3, 0, 3), (3, 2, 2), (3, 3, 0), (3, 2, -2))


def label_fields(fields: DataFrame, above: float) -> DataFrame:
    """fields with labels (array<int>): 8-connected components of the pixels above a threshold."""
    return K.map_fields(fields, lambda a: K.label(a > above), "labels", "array<int>")


def changed_labels(fields: DataFrame, fn, column: str = "labels") -> DataFrame:
    """fields with labels changed by a kernel; no shuffle."""
    made = K.map_fields(fields, fn, "_labels", "array<int>", (column,))
    return made.withColumn(column, F.col("_labels")).drop("_labels")


def relabel(fields: DataFrame) -> DataFrame:
    return changed_labels(fields, K.relabel)


def drop_small(fields: DataFrame, least: int) -> DataFrame:
    return changed_labels(fields, lambda a: K.drop_small(a, least))


def drop_border(fields: DataFrame) -> DataFrame:
    return changed_labels(fields, K.drop_border)


def label_pixels(fields: DataFrame) -> DataFrame:
    """image_id, label, y, x, v of foreground pixels, with their field's height and width."""
    rows = fields.select("image_id", "height", "width", F.posexplode(F.arrays_zip("labels", "data")).alias("p", "z")).where("z.labels > 0")
    y, x = F.floor(F.col("p") / F.col("width")).cast("int"), (F.col("p") % F.col("width")).cast("int")
    return rows.select("image_id", F.col("z.labels").alias("label"), y.alias("y"), x.alias("x"), F.col("z.data").alias("v"), "height", "width")


def geometry(px: DataFrame) -> DataFrame:
    """Area, centroid, box, moments' ellipse, orientation and border contact of every object: one aggregate. px of
    label_pixels, with the height and width of its own field."""
    g = px.groupBy("image_id", "label").agg(
        F.count(F.lit(1)).alias("area_px"), F.avg("y").alias("centroid_y"), F.avg("x").alias("centroid_x"),
        F.min("y").alias("bbox_min_row"), F.min("x").alias("bbox_min_col"), (F.max("y") + 1).alias("bbox_max_row"), (F.max("x") + 1).alias("bbox_max_col"),
        F.var_pop("y").alias("vy"), F.var_pop("x").alias("vx"), F.covar_pop("y", "x").alias("vyx"), F.max("height").alias("height"), F.max("width").alias("width"),
        *(F.sum(F.col(a).cast("long") * (F.col(b) if b else 1)).alias(f"s{a}{b}") for a, b in (("y", ""), ("x", ""), ("y", "y"), ("x", "x"), ("y", "x"))),
    )
    box = (F.col("bbox_max_row") - F.col("bbox_min_row")) * (F.col("bbox_max_col") - F.col("bbox_min_col"))
    half, root = (F.col("vy") + F.col("vx")) / 2, F.sqrt(F.pow((F.col("vy") - F.col("vx")) / 2, F.lit(2.0)) + F.col("vyx") * F.col("vyx"))
    # in whole numbers, so that equal spreads are told from nearly equal ones
    n = F.col("area_px")
    slope, both = n * F.col("syy") - F.col("sy") * F.col("sy") - n * F.col("sxx") + F.col("sx") * F.col("sx"), n * F.col("syx") - F.col("sy") * F.col("sx")
    g = g.withColumns({"l1": half + root, "l2": F.greatest(half - root, F.lit(0.0)), "slope": slope, "both": both})
    g = g.withColumns({"major_axis_px": 4 * F.sqrt("l1"), "minor_axis_px": 4 * F.sqrt("l2"), "orientation": F.when((F.col("slope") == 0) & (F.col("both") <= 0), F.lit(-math.pi / 4)).otherwise(F.atan2((2 * F.col("both")).cast("double"), F.col("slope").cast("double")) / 2)})
    return g.select(
        "image_id", "label", F.col("area_px").cast("double").alias("area_px"), "centroid_y", "centroid_x", "bbox_min_row", "bbox_min_col", "bbox_max_row", "bbox_max_col",
        (F.col("area_px") / box).alias("extent"), F.sqrt(F.col("area_px") * (4 / math.pi)).alias("equivalent_diameter_px"), "major_axis_px", "minor_axis_px",
        F.when(F.col("l1") <= 0, F.lit(0.0)).otherwise(F.sqrt(F.greatest(1 - F.try_divide(F.col("l2"), F.col("l1")), F.lit(0.0)))).alias("eccentricity"),
        "orientation", F.degrees("orientation").alias("orientation_deg"), F.when(F.col("minor_axis_px") > 0, F.col("major_axis_px") / F.greatest("minor_axis_px", F.lit(1e-8))).otherwise(F.lit(0.0)).alias("aspect_ratio"),
        ((F.col("bbox_min_row") == 0) | (F.col("bbox_min_col") == 0) | (F.col("bbox_max_row") == F.col("height")) | (F.col("bbox_max_col") == F.col("width"))).alias("touches_border"),
    )


def intensity(px: DataFrame) -> DataFrame:
    return px.groupBy("image_id", "label").agg(
        F.avg("v").alias("mean_intensity"), F.expr("percentile(v, 0.5)").alias("median_intensity"), F.stddev_pop("v").alias("std_intensity"),
        F.min("v").alias("min_intensity"), F.max("v").alias("max_intensity"), F.sum("v").alias("integrated_intensity"),
    )


def quads(fields: DataFrame) -> DataFrame:
    """image_id, label, code, n: 2 x 2 windows of every object's mask, zero outside; code = self + 2 below + 4 right + 8 diagonal."""
    px = label_pixels(fields).select("image_id", "label", F.explode(F.array(*(F.struct((F.col("y") - dy).alias("y"), (F.col("x") - dx).alias("x"), F.lit(b).alias("b")) for dy, dx, b in ((0, 0, 1), (1, 0, 2), (0, 1, 4), (1, 1, 8))))).alias("q"))
    codes = px.groupBy("image_id", "label", "q.y", "q.x").agg(F.sum("q.b").alias("code"))
    return codes.groupBy("image_id", "label", "code").agg(F.count(F.lit(1)).alias("n"))


#: Coefficients of the four-direction Crofton perimeter, by code of the 2 x 2 window.
CROFTON = (
    0.0, math.pi / 4 * (1 + 1 / math.sqrt(2)), math.pi / (4 * math.sqrt(2)), math.pi / (2 * math.sqrt(2)), 0.0, math.pi / 4 * (1 + 1 / math.sqrt(2)), 0.0, math.pi / (4 * math.sqrt(2)),
    math.pi / 4, math.pi / 2, math.pi / (4 * math.sqrt(2)), math.pi / (4 * math.sqrt(2)), math.pi / 4, math.pi / 2, 0.0, 0.0,
)


def perimeter_euler(fields: DataFrame) -> DataFrame:
    """perimeter_crofton_px and euler_number (8-connected) of every object, from counts of 2 x 2 windows."""
    weight = F.element_at(F.array(*(F.lit(c) for c in CROFTON)), F.col("code").cast("int") + 1)
    one, three, crossed = (F.col("code").isin(*c) for c in ((1, 2, 4, 8), (7, 11, 13, 14), (6, 9)))
    euler = F.when(one, F.col("n")).when(three, -F.col("n")).when(crossed, -2 * F.col("n")).otherwise(0)
    return quads(fields).groupBy("image_id", "label").agg(F.sum(weight * F.col("n")).alias("perimeter_crofton_px"), (F.sum(euler) / 4).cast("int").alias("euler_number"))


def glcm_levels(px: DataFrame, levels: int = 32) -> DataFrame:
    """px with level: 1..levels-1 over the object's own range, 1 where it is flat."""
    own = Window.partitionBy("image_id", "label")
    low, span = F.min("v").over(own), F.max("v").over(own) - F.min("v").over(own)
    level = F.least(F.greatest(F.floor((F.col("v") - low) / span * (levels - 2)) + 1, F.lit(1)), F.lit(levels - 1))
    return px.withColumn("level", F.when(span <= 0, F.lit(1)).otherwise(level).cast("int"))


def glcm(px: DataFrame, levels: int = 32) -> DataFrame:
    """Co-occurrence features of every object, the mean over distances and directions; a direction without pairs counts
    with contrast 0 and correlation 1; objects below two pixels have zeros."""
    q = glcm_levels(px, levels).select("image_id", "label", "y", "x", "level")
    steps = F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.lit(d).alias("d"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (d, dy, dx) in enumerate(OFFSETS)))).alias("o")
    a = q.select("image_id", "label", F.col("level").alias("i"), steps, "y", "x").select("image_id", "label", "i", "o.k", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    met = a.join(q.withColumnRenamed("level", "j"), ["image_id", "label", "y", "x"])
    both = met.select("image_id", "label", "k", F.explode(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))).alias("c"))
    n = both.groupBy("image_id", "label", "k", F.col("c.i").cast("double").alias("i"), F.col("c.j").cast("double").alias("j")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    w = Window.partitionBy("image_id", "label", "k")
    p = n.withColumn("p", F.col("n") / F.sum("n").over(w))
    d2 = (F.col("i") - F.col("j")) * (F.col("i") - F.col("j"))
    each = p.groupBy("image_id", "label", "k").agg(
        F.sum(F.col("p") * d2).alias("contrast"), F.sum(F.col("p") * F.abs(F.col("i") - F.col("j"))).alias("dissimilarity"), F.sum(F.col("p") / (1 + d2)).alias("homogeneity"), F.sum(F.col("p") * F.col("p")).alias("asm"),
        F.sum(-F.col("p") * F.log2("p")).alias("entropy"), F.sum(F.col("p") * F.col("i")).alias("mi"), F.sum(F.col("p") * F.col("i") * F.col("i")).alias("ii"), F.sum(F.col("p") * F.col("i") * F.col("j")).alias("ij"),
    )
    var = F.col("ii") - F.col("mi") * F.col("mi")
    each = each.withColumn("correlation", F.when(var < 1e-12, F.lit(1.0)).otherwise((F.col("ij") - F.col("mi") * F.col("mi")) / var)).withColumn("energy", F.sqrt("asm"))
    objects = px.groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area"))
    all_ = objects.select("image_id", "label", "area", F.explode(F.sequence(F.lit(0), F.lit(len(OFFSETS) - 1))).alias("k")).join(each, ["image_id", "label", "k"], "left")
    fill = lambda c, v: F.coalesce(F.col(c), F.lit(v))
    features = {c: F.avg(fill(c, 0.0)) for c in ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "entropy")} | {"correlation": F.avg(fill("correlation", 1.0))}
    features |= {f"contrast_d{d}": F.avg(F.when(F.col("k").isin(*[k for k, o in enumerate(OFFSETS) if o[0] == d]), fill("contrast", 0.0))) for d in (1, 3)}
    out = all_.groupBy("image_id", "label").agg(*(e.alias(f"_{c}") for c, e in features.items()), F.max("area").alias("_area"), F.count("asm").alias("_pairs"))
    some = (F.col("_area") >= 2) & (F.col("_pairs") > 0)
    return out.select("image_id", "label", *(F.when(some, F.col(f"_{c}")).otherwise(F.lit(0.0)).alias(f"glcm_{c}") for c in features))


def by_object(fields: DataFrame, fn, out: str, kind: str = "array<int>") -> DataFrame:
    """image_id, label, out: of a kernel that gives one number for each of the objects 1..max; no shuffle."""
    found = K.map_fields(fields.select("image_id", "height", "width", "labels"), fn, "_made", kind, ("labels",))
    rows = found.select("image_id", F.posexplode("_made").alias("p", "n")).where("n > 0")
    return rows.select("image_id", (F.col("p") + 1).alias("label"), F.col("n").cast("double").alias(out))


def hulls(fields: DataFrame) -> DataFrame:
    return by_object(fields, K.convex_areas, "convex_area_px")


def filled(fields: DataFrame) -> DataFrame:
    return by_object(fields, K.filled_areas, "filled_area_px")


def border_perimeter(fields: DataFrame) -> DataFrame:
    return by_object(fields, K.border_perimeters, "perimeter_px", "array<double>")


def circularity(area: Column, perimeter: Column) -> Column:
    return F.when(perimeter <= 0, F.lit(0.0)).otherwise(A.clip(4 * math.pi * area / (perimeter * perimeter)))


def morphology(fields: DataFrame, pixel_size_um: float | None = None) -> DataFrame:
    """All shape columns of every object; lengths and areas in micrometres too where the pixel size is known."""
    keys = ["image_id", "label"]
    out = geometry(label_pixels(fields)).join(perimeter_euler(fields), keys).join(hulls(fields), keys).join(filled(fields), keys).join(border_perimeter(fields), keys, "left")
    out = out.withColumns({
        "solidity": F.col("area_px") / F.col("convex_area_px"), "circularity": circularity(F.col("area_px"), F.col("perimeter_crofton_px")),
        "hole_area_px": F.col("filled_area_px") - F.col("area_px"), "perimeter_px": F.coalesce("perimeter_px", F.lit(0.0)),
    })
    if not pixel_size_um:
        return out
    s = float(pixel_size_um)
    lengths = {"perimeter_um": "perimeter_crofton_px", "equivalent_diameter_um": "equivalent_diameter_px", "major_axis_um": "major_axis_px", "minor_axis_um": "minor_axis_px"}
    return out.withColumns({"area_um2": F.col("area_px") * s * s} | {k: F.col(c) * s for k, c in lengths.items()})


def feature_table(fields: DataFrame, channels: tuple[str, ...] = ("data",), pixel_size_um: float | None = None, texture: bool = True, exclude_border: bool = False) -> DataFrame:
    """Shape of every object, and intensity and texture in every channel (array columns of fields; with several, their
    names lead the columns'), joined on the object."""
    keys = ["image_id", "label"]
    out = morphology(fields.withColumn("data", F.col(channels[0])), pixel_size_um)
    for c in channels:
        px = label_pixels(fields.withColumn("data", F.col(c)))
        parts = [intensity(px), *([glcm(px)] if texture else [])]
        for part in parts:
            names = {k: f"{c}_{k}" for k in part.columns if k not in keys} if len(channels) > 1 else {}
            out = out.join(part.withColumnsRenamed(names), keys, "left")
    return out.where(~F.col("touches_border")) if exclude_border else out
