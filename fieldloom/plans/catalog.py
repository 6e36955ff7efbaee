"""All queries of the library over the test tables, and the same rows in DuckDB SQL.

Vectors stand for 8 x 8 fields, their components above 0.1 for objects; lineitem, orders, labels, documents and events stand
for object tables, paired runs, verdicts, image lists and logs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldloom.functions import arrays as A
from fieldloom.operators import augment as G
from fieldloom.operators import evaluate as E
from fieldloom.operators import kernels as K
from fieldloom.operators import measure as M
from fieldloom.operators import preprocess as P
from fieldloom.operators import quality as Q
from fieldloom.operators import segment as S
from fieldloom.operators import unet as U
from fieldloom.sources.fields import pixels, read_fields

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

ABOVE = 0.1
#: SQL of the pixel view, of objects (8-connected, numbered in raster order) and of truth and prediction masks.
PX = "px AS (SELECT vec_id AS image_id, p // 8 AS y, p % 8 AS x, p, v FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings))"
LAB = PX + """, fg AS (SELECT * FROM px WHERE v > 0.1),
reach(image_id, p, q) AS (SELECT image_id, p, p FROM fg UNION SELECT r.image_id, r.p, f.p FROM reach r JOIN fg g ON g.image_id = r.image_id AND g.p = r.q
  JOIN fg f ON f.image_id = r.image_id AND abs(f.y - g.y) <= 1 AND abs(f.x - g.x) <= 1),
root AS (SELECT image_id, p, min(q) AS root FROM reach GROUP BY image_id, p),
lab AS (SELECT fg.image_id, fg.y, fg.x, fg.p, fg.v, dense_rank() OVER (PARTITION BY fg.image_id ORDER BY root) AS label FROM fg JOIN root USING (image_id, p))"""
MASK = PX + ", m AS (SELECT image_id, y, x, v, v > 0 AS t, v > quantile_cont(v, 0.6) OVER (PARTITION BY image_id) AS s FROM px)"
COUNTS = MASK + ", c AS (SELECT image_id, count(*) FILTER (t AND s) AS tp, count(*) FILTER (NOT t AND s) AS fp, count(*) FILTER (t AND NOT s) AS fn, count(*) FILTER (NOT t AND NOT s) AS tn FROM m GROUP BY image_id)"


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _objects(spark, sf_dir):
    return M.label_fields(read_fields(spark, sf_dir), ABOVE)


def _px(fields, digits=6, column="data"):
    return pixels(fields, column).select("image_id", "y", "x", F.round(column, digits).alias("v"))


def _pointwise(column):
    return lambda spark, sf_dir: _px(read_fields(spark, sf_dir).withColumn("data", column(F.col("data"))))


def _field_sql(expression: str, extra: str = "") -> str:
    return f"WITH {PX}, s AS (SELECT *, quantile_cont(v, 0.01) OVER w AS q01, quantile_cont(v, 0.99) OVER w AS q99, quantile_cont(v, 0.02) OVER w AS q02, quantile_cont(v, 0.98) OVER w AS q98, quantile_cont(v, 0.5) OVER w AS q50, min(v) OVER w AS lo, max(v) OVER w AS hi, avg(v) OVER w AS mu, stddev_pop(v) OVER w AS sd FROM px WINDOW w AS (PARTITION BY image_id)) SELECT image_id, y::INT AS y, x::INT AS x, round({expression}, 6) AS v FROM s {extra}"


for _name, _column, _sql in (
    ("percentile_normalize", P.percentile_normalize, "CASE WHEN q99 - q01 < 1e-8 THEN 0 ELSE least(greatest((v - q01) / (q99 - q01), 0), 1) END"),
    ("stretch_contrast", lambda d: P.percentile_normalize(d, 2, 98), "CASE WHEN q98 - q02 < 1e-8 THEN 0 ELSE least(greatest((v - q02) / (q98 - q02), 0), 1) END"),
    ("minmax_normalize", P.minmax_normalize, "CASE WHEN hi - lo < 1e-8 THEN 0 ELSE (v - lo) / (hi - lo) END"),
    ("zscore_normalize", P.zscore_normalize, "CASE WHEN sd < 1e-8 THEN 0 ELSE least(greatest(((v - mu) / sd + 3) / 6, 0), 1) END"),
    ("gamma", lambda d: P.adjust_gamma(d, 0.5), "pow(least(greatest(v, 0), 1), 0.5)"),
    ("auto_invert", P.auto_invert, "CASE WHEN q99 - q01 < 1e-6 OR q50 < (q01 + q99) / 2 THEN v ELSE 1 - v END"),
    ("to_uint8", P.to_uint8, "floor(least(greatest(v * 255, 0), 255))::INT"),
    ("exposure", lambda d: F.transform(d, lambda v: A.clip(v * 1.6)), "least(greatest(v * 1.6, 0), 1)"),
    ("dtype_scale", lambda d: P.from_integers(F.transform(d, lambda v: F.floor(F.abs(v) * 4095)), 65535.0), "floor(abs(v) * 4095) / 65535.0"),
):
    QUERIES[_name] = _pointwise(_column)
    ORACLE_SQL[_name] = _field_sql(_sql)


@query(f"WITH {PX} SELECT image_id, (quantile_cont(v, 0.99) - quantile_cont(v, 0.01) < 1e-6 OR quantile_cont(v, 0.5) < (quantile_cont(v, 0.01) + quantile_cont(v, 0.99)) / 2) AS dark FROM px GROUP BY image_id")
def polarity(spark, sf_dir):
    return read_fields(spark, sf_dir).select("image_id", P.has_dark_background(F.col("data")).alias("dark"))


@query(f"WITH {PX}, d AS (SELECT *, sqrt(pow(y - 0.4 * 8, 2) + pow(x - 0.6 * 8, 2)) AS d FROM px) SELECT image_id, y::INT AS y, x::INT AS x, round(v * (1 - 0.6 * d / (max(d) OVER () + 1e-6)), 6) AS v FROM d")
def shading_field(spark, sf_dir):
    f = read_fields(spark, sf_dir)
    return _px(f.withColumn("data", F.transform("data", lambda v, p: v * P.shading(F.col("height"), F.col("width"), p, 0.6, 0.4, 0.6))))


@query(f"WITH {PX} SELECT a.image_id // 3 AS image_id, a.y::INT AS y, a.x::INT AS x, round(max(a.v), 6) AS v FROM px a GROUP BY ALL")
def max_projection(spark, sf_dir):
    px = pixels(read_fields(spark, sf_dir)).withColumn("image_id", F.floor(F.col("image_id") / 3))
    return px.groupBy("image_id", "y", "x").agg(F.round(F.max("data"), 6).alias("v"))


@query(f"WITH {PX}, b AS (SELECT image_id // 3 AS image_id, image_id % 3 AS band, var_pop(v) AS spread FROM px GROUP BY ALL), r AS (SELECT image_id, max(spread) AS hi, min(spread) AS lo, arg_max(band, spread) AS band FROM b GROUP BY image_id) SELECT image_id, CASE WHEN hi - lo > 0.15 * greatest(hi, 1e-6) THEN band ELSE -1 END::BIGINT AS band, round(hi, 6) AS spread FROM r")
def rgb_to_nuclei(spark, sf_dir):
    bands = read_fields(spark, sf_dir).select(F.floor(F.col("image_id") / 3).alias("image_id"), (F.col("image_id") % 3).alias("band"), A.variance(F.col("data")).alias("s"))
    r = bands.groupBy("image_id").agg(F.max("s").alias("hi"), F.min("s").alias("lo"), F.max_by("band", "s").alias("band"))
    pick = F.when(F.col("hi") - F.col("lo") > 0.15 * F.greatest("hi", F.lit(1e-6)), F.col("band")).otherwise(F.lit(-1)).cast("long")
    return r.select("image_id", pick.alias("band"), F.round("hi", 6).alias("spread"))


_NEAR = "n AS (SELECT a.image_id, a.y, a.x, a.v, o.dy, o.dx, b.v AS u FROM px a CROSS JOIN (SELECT unnest([-1,0,1]) AS dy) o1 CROSS JOIN (SELECT unnest([-1,0,1]) AS dx) o2 CROSS JOIN LATERAL (SELECT o1.dy AS dy, o2.dx AS dx) o JOIN px b ON b.image_id = a.image_id AND b.y = least(greatest(a.y + o.dy, 0), 7) AND b.x = least(greatest(a.x + o.dx, 0), 7))"
_MED = PX + ", " + _NEAR + ", med AS (SELECT image_id, y, x, v, median(u) AS m FROM n GROUP BY ALL)"


@query(f"WITH {_MED} SELECT image_id, y::INT AS y, x::INT AS x, round(m, 6) AS v FROM med")
def median_filter(spark, sf_dir):
    return _px(read_fields(spark, sf_dir).withColumn("data", P.median3(F.col("data"), F.col("height"), F.col("width"))))


@query(f"WITH {_MED}, c AS (SELECT *, median(v - m) OVER w AS c FROM med WINDOW w AS (PARTITION BY image_id)), s AS (SELECT *, 1.4826 * median(abs(v - m - c)) OVER (PARTITION BY image_id) AS s FROM c) SELECT image_id, y::INT AS y, x::INT AS x, round(CASE WHEN s >= 1e-6 AND abs(v - m) > 3 * s THEN m ELSE v END, 6) AS v FROM s")
def hot_pixels(spark, sf_dir):
    return _px(P.remove_hot_pixels(read_fields(spark, sf_dir), 3.0))


def _kernel(fn, kind="array<double>"):
    return lambda spark, sf_dir: _px(K.map_fields(read_fields(spark, sf_dir), fn, "made", kind), column="made")


_CROSS = "SELECT a.image_id, a.y, a.x, {f}(b.v) AS v FROM {t} a JOIN {t} b ON b.image_id = a.image_id AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY ALL"
QUERIES["grey_opening"] = _kernel(lambda a: K.opening(a, K.disc(1)))
ORACLE_SQL["grey_opening"] = f"WITH {PX}, e AS ({_CROSS.format(f='min', t='px')}), d AS ({_CROSS.format(f='max', t='e')}) SELECT image_id, y::INT AS y, x::INT AS x, round(v, 6) AS v FROM d"
_OC = ", b AS (SELECT image_id, y, x, (v > 0)::INT AS v FROM px), " + ", ".join(f"{n} AS ({_CROSS.format(f=f, t=t)})" for n, f, t in (("b1", "min", "b"), ("b2", "max", "b1"), ("b3", "max", "b2"), ("b4", "min", "b3")))
QUERIES["binary_open_close"] = _kernel(lambda a: K.closing(K.opening((a > 0), K.disc(1)), K.disc(1)).astype("int32"), "array<int>")
ORACLE_SQL["binary_open_close"] = f"WITH {PX}{_OC} SELECT image_id, y::INT AS y, x::INT AS x, v::INT AS v FROM b4"
QUERIES["edt"] = _kernel(lambda a: K.distance(a > 0))
ORACLE_SQL["edt"] = f"WITH {PX} SELECT a.image_id, a.y::INT AS y, a.x::INT AS x, round(CASE WHEN a.v > 0 THEN sqrt(min(pow(a.y - b.y, 2) + pow(a.x - b.x, 2))) ELSE 0 END, 6) AS v FROM px a JOIN px b ON b.image_id = a.image_id AND NOT b.v > 0 GROUP BY a.image_id, a.y, a.x, a.v"
_G = K.gaussian_kernel(0.5).tolist()
QUERIES["gaussian_blur"] = _kernel(lambda a: K.gaussian(a, 0.5))
_REFLECT = "CASE WHEN {c} < 0 THEN -({c}) WHEN {c} > 7 THEN 14 - ({c}) ELSE {c} END"
ORACLE_SQL["gaussian_blur"] = (
    f"WITH {PX}, k AS (SELECT unnest({list(range(-(len(_G) // 2), len(_G) // 2 + 1))}) AS o, unnest({_G}) AS w), a AS (SELECT a.image_id, a.y, a.x, sum(k.w * b.v) AS v FROM px a, k JOIN px b ON b.image_id = a.image_id AND b.x = a.x AND b.y = "
    + _REFLECT.format(c="a.y + k.o") + " GROUP BY ALL), c AS (SELECT a.image_id, a.y, a.x, sum(k.w * b.v) AS v FROM a, k JOIN a b ON b.image_id = a.image_id AND b.y = a.y AND b.x = " + _REFLECT.format(c="a.x + k.o") + " GROUP BY ALL) SELECT image_id, y::INT AS y, x::INT AS x, round(v, 6) AS v FROM c"
)


@query(_field_sql("v::DOUBLE", "WHERE v > 0.1"))
def threshold_fixed(spark, sf_dir):
    return pixels(read_fields(spark, sf_dir)).where(F.col("data") > ABOVE).select("image_id", "y", "x", F.round("data", 6).alias("v"))


_HIST = PX + ", r AS (SELECT image_id, v, min(v) OVER w AS lo, max(v) OVER w AS hi FROM px WINDOW w AS (PARTITION BY image_id)), h AS (SELECT image_id, any_value(lo) AS lo, any_value(hi) AS hi, least(floor((v - lo) / (hi - lo) * 256), 255)::INT AS b, count(*)::DOUBLE AS n FROM r WHERE hi - lo >= 1e-6 GROUP BY image_id, b)"


def _histogram(spark, sf_dir, bins=256):
    """image_id, lo, hi, b, n of the occupied bins; a flat field has none."""
    f = read_fields(spark, sf_dir).select("image_id", F.array_min("data").alias("lo"), F.array_max("data").alias("hi"), F.explode("data").alias("v")).where("hi - lo >= 1e-6")
    return f.groupBy("image_id", "lo", "hi", F.least(F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int").alias("b")).agg(F.count(F.lit(1)).cast("double").alias("n"))


@query(f"WITH {_HIST}, c AS (SELECT *, lo + (b + 0.5) * (hi - lo) / 256 AS m, sum(n) OVER (PARTITION BY image_id ORDER BY b) AS w1, sum(n) OVER (PARTITION BY image_id) AS w FROM h), d AS (SELECT *, sum(n * m) OVER (PARTITION BY image_id ORDER BY b) AS s1, sum(n * m) OVER (PARTITION BY image_id) AS s FROM c), e AS (SELECT *, round(w1 * (w - w1) * pow(s1 / w1 - (s - s1) / (w - w1), 2), 9) AS var FROM d WHERE w1 < w) SELECT image_id, round(arg_min(m, (-var, b)), 6) AS threshold FROM e GROUP BY image_id")
def threshold_otsu(spark, sf_dir):
    h = _histogram(spark, sf_dir).withColumn("m", F.col("lo") + (F.col("b") + 0.5) * (F.col("hi") - F.col("lo")) / 256)
    run, all_ = Window.partitionBy("image_id").orderBy("b"), Window.partitionBy("image_id")
    h = h.withColumns({"w1": F.sum("n").over(run), "w": F.sum("n").over(all_), "s1": F.sum(F.col("n") * F.col("m")).over(run), "s": F.sum(F.col("n") * F.col("m")).over(all_)}).where("w1 < w")
    gap = F.col("s1") / F.col("w1") - (F.col("s") - F.col("s1")) / (F.col("w") - F.col("w1"))
    h = h.withColumn("var", F.round(F.col("w1") * (F.col("w") - F.col("w1")) * gap * gap, 9))
    return h.groupBy("image_id").agg(F.round(F.min_by("m", F.struct(-F.col("var"), F.col("b"))), 6).alias("threshold"))


@query(f"WITH {_HIST.replace('256', '16').replace('255', '15')} SELECT image_id, b, n::BIGINT AS n, round(lo + b * (hi - lo) / 16, 6) AS edge FROM h")
def feature_histogram(spark, sf_dir):
    h = _histogram(spark, sf_dir, 16)
    return h.select("image_id", "b", F.col("n").cast("long").alias("n"), F.round(F.col("lo") + F.col("b") * (F.col("hi") - F.col("lo")) / 16, 6).alias("edge"))


@query(f"WITH RECURSIVE {LAB} SELECT image_id, y::INT AS y, x::INT AS x, label::INT AS v FROM lab")
def connected_components(spark, sf_dir):
    return M.label_pixels(_objects(spark, sf_dir)).select("image_id", "y", "x", F.col("label").alias("v"))


@query(f"WITH RECURSIVE {LAB}, k AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM lab) SELECT image_id, y::INT AS y, x::INT AS x, label::INT AS v FROM k WHERE n >= 3")
def drop_small_labels(spark, sf_dir):
    f = M.drop_small(_objects(spark, sf_dir), 3)
    return pixels(f, "labels").where("labels > 0").select("image_id", "y", "x", F.col("labels").alias("v"))


@query(f"WITH RECURSIVE {LAB}, k AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM lab) SELECT image_id, y::INT AS y, x::INT AS x, dense_rank() OVER (PARTITION BY image_id ORDER BY label)::INT AS v FROM k WHERE n >= 3")
def relabel_sequential(spark, sf_dir):
    f = M.relabel(M.drop_small(_objects(spark, sf_dir), 3))
    return pixels(f, "labels").where("labels > 0").select("image_id", "y", "x", F.col("labels").alias("v"))


@query(f"WITH RECURSIVE {LAB}, e AS (SELECT DISTINCT image_id, label FROM lab WHERE y IN (0, 7) OR x IN (0, 7)) SELECT image_id, y::INT AS y, x::INT AS x, dense_rank() OVER (PARTITION BY image_id ORDER BY label)::INT AS v FROM lab ANTI JOIN e USING (image_id, label)")
def remove_border_objects(spark, sf_dir):
    f = M.drop_border(_objects(spark, sf_dir))
    return pixels(f, "labels").where("labels > 0").select("image_id", "y", "x", F.col("labels").alias("v"))


@query(f"WITH RECURSIVE {LAB}, k AS (SELECT *, count(*) OVER (PARTITION BY image_id, label) AS n FROM lab) SELECT image_id, y::INT AS y, x::INT AS x FROM k WHERE n >= 4")
def remove_small(spark, sf_dir):
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: K.remove_small(a > ABOVE, 4).astype("int32"), "made", "array<int>")
    return pixels(f, "made").where("made = 1").select("image_id", "y", "x")


_HOLES = PX + """, bg AS (SELECT * FROM px WHERE NOT v > -0.1), reach(image_id, p, q) AS (SELECT image_id, p, p FROM bg UNION SELECT r.image_id, r.p, f.p FROM reach r JOIN bg g ON g.image_id = r.image_id AND g.p = r.q
  JOIN bg f ON f.image_id = r.image_id AND abs(f.y - g.y) + abs(f.x - g.x) <= 1), h AS (SELECT r.image_id, r.p, count(*) AS n, bool_or(b.y IN (0, 7) OR b.x IN (0, 7)) AS edge FROM reach r JOIN bg b ON b.image_id = r.image_id AND b.p = r.q GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_HOLES} SELECT image_id, y::INT AS y, x::INT AS x FROM px WHERE v > -0.1 UNION ALL SELECT h.image_id, (p // 8)::INT, (p % 8)::INT FROM h WHERE n <= 3 AND NOT edge")
def fill_holes(spark, sf_dir):
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: K.fill_holes(a > -0.1, 3).astype("int32"), "made", "array<int>")
    return pixels(f, "made").where("made = 1").select("image_id", "y", "x")


@query(f"WITH RECURSIVE {LAB} SELECT l.image_id, l.y::INT AS y, l.x::INT AS x, CASE WHEN bool_or(b.label IS DISTINCT FROM l.label AND n.y IS NOT NULL) THEN 2 ELSE 1 END::INT AS v FROM lab l JOIN px n ON n.image_id = l.image_id AND abs(n.y - l.y) + abs(n.x - l.x) = 1 LEFT JOIN lab b ON b.image_id = n.image_id AND b.p = n.p GROUP BY ALL")
def semantic_target(spark, sf_dir):
    f = _objects(spark, sf_dir)
    near = [(-1, 0), (1, 0), (0, -1), (0, 1)]
    rim = lambda v, p: F.exists(F.array(*(P.neighbour(F.col("labels"), p, a, b, F.col("height"), F.col("width")) for a, b in near)), lambda u: u != v)
    f = f.withColumn("target", F.transform("labels", lambda v, p: F.when(v == 0, F.lit(0)).when(rim(v, p), F.lit(2)).otherwise(F.lit(1))))
    return pixels(f, "target").where("target > 0").select("image_id", "y", "x", F.col("target").alias("v"))


@query(f"WITH RECURSIVE {LAB}, d AS (SELECT l.image_id, l.y, l.x, l.label, sqrt(min(pow(l.y - b.y, 2) + pow(l.x - b.x, 2))) AS d FROM lab l JOIN px b ON b.image_id = l.image_id AND NOT b.v > 0.1 GROUP BY ALL) SELECT image_id, y::INT AS y, x::INT AS x, round(d / max(d) OVER (PARTITION BY image_id, label), 6) AS v FROM d")
def distance_target(spark, sf_dir):
    f = K.map_fields(_objects(spark, sf_dir), lambda a: K.distance(a > 0), "far", "array<double>", ("labels",))
    px = pixels(f, "labels", "far").where("labels > 0")
    return px.select("image_id", "y", "x", F.round(F.try_divide(F.col("far"), F.max("far").over(Window.partitionBy("image_id", "labels"))), 6).alias("v"))


@query(f"WITH {PX}, m AS (SELECT image_id // 4 AS field, y, x, max(image_id % 4 + 1) AS label FROM px WHERE v > 0.15 GROUP BY ALL) SELECT field AS image_id, y::INT AS y, x::INT AS x, label::INT AS v FROM m")
def merge_masks(spark, sf_dir):
    px = pixels(read_fields(spark, sf_dir)).where("data > 0.15")
    return px.groupBy(F.floor(F.col("image_id") / 4).alias("image_id"), "y", "x").agg(F.max(F.col("image_id") % 4 + 1).cast("int").alias("v"))


@query(f"WITH {PX}, a AS (SELECT image_id // 4 AS field, image_id AS mask, y, x, count(*) OVER (PARTITION BY image_id) AS area FROM px WHERE v > 0.1), b AS (SELECT field, y, x, arg_max(mask, (-area, mask)) AS top FROM a WHERE area >= 10 GROUP BY ALL) SELECT field AS image_id, y::INT AS y, x::INT AS x, dense_rank() OVER (PARTITION BY field ORDER BY top)::INT AS v FROM b")
def masks_to_labels(spark, sf_dir):
    f = read_fields(spark, sf_dir).withColumn("area", F.size(F.filter("data", lambda v: v > ABOVE))).where("area >= 10")
    px = f.select(F.floor(F.col("image_id") / 4).alias("field"), F.col("image_id").alias("mask"), "area", F.posexplode("data").alias("p", "v")).where(F.col("v") > ABOVE)
    top = px.groupBy("field", "p").agg(F.max_by("mask", F.struct(-F.col("area"), F.col("mask"))).alias("top"))
    return top.select(F.col("field").alias("image_id"), F.floor(F.col("p") / 8).cast("int").alias("y"), (F.col("p") % 8).cast("int").alias("x"), F.dense_rank().over(Window.partitionBy("field").orderBy("top")).alias("v"))


@query(f"WITH {PX} SELECT image_id, (y - 2)::INT AS y, (x - 2)::INT AS x, round(v, 6) AS v FROM px WHERE y BETWEEN 2 AND 5 AND x BETWEEN 2 AND 5")
def center_crop(spark, sf_dir):
    px = _px(read_fields(spark, sf_dir)).where("y between 2 and 5 and x between 2 and 5")
    return px.select("image_id", (F.col("y") - 2).alias("y"), (F.col("x") - 2).alias("x"), "v")


@query(f"WITH {PX} SELECT image_id, (7 - x)::INT AS y, y::INT AS x, round(v, 6) AS v FROM px")
def dihedral(spark, sf_dir):
    px = _px(read_fields(spark, sf_dir))
    return px.select("image_id", (7 - F.col("x")).alias("y"), F.col("y").alias("x"), "v")


_VIEWS = "(a.y, a.x), (a.y, 7 - a.x), (7 - a.y, a.x), (7 - a.y, 7 - a.x), (a.x, a.y), (a.x, 7 - a.y), (7 - a.x, a.y), (7 - a.x, 7 - a.y)"


@query(f"WITH {PX}, w AS (SELECT a.image_id, a.y, a.x, unnest([{', '.join(f'({p})' for p in [x.replace(', ', ') * 8 + (', 1) for x in _VIEWS[1:-1].split('), (')])}]) AS q FROM px a) SELECT w.image_id, w.y::INT AS y, w.x::INT AS x, round(sum(b.v) / 8, 6) AS v FROM w JOIN px b ON b.image_id = w.image_id AND b.p = w.q GROUP BY ALL")
def tta_average(spark, sf_dir):
    """The mean of the eight turned and mirrored views, each turned back."""

    def turned(p):
        y, x = F.floor(p / 8), p % 8
        views = [(y, x), (y, 7 - x), (7 - y, x), (7 - y, 7 - x)]
        return [F.get("data", (a * 8 + b).cast("int")) for a, b in views + [(b, a) for a, b in views]]

    return _px(read_fields(spark, sf_dir).withColumn("data", F.transform("data", lambda v, p: sum(turned(p)[1:], turned(p)[0]) / 8)))


_GEO = ", g AS (SELECT image_id, label, count(*) AS area, avg(y) AS cy, avg(x) AS cx, min(y) AS y0, min(x) AS x0, max(y) + 1 AS y1, max(x) + 1 AS x1, var_pop(y) AS vy, var_pop(x) AS vx, covar_pop(y, x) AS vyx, count(*) * sum(y * y) - sum(y) * sum(y) - count(*) * sum(x * x) + sum(x) * sum(x) AS slope, count(*) * sum(y * x) - sum(y) * sum(x) AS both FROM lab GROUP BY image_id, label), e AS (SELECT *, (vy + vx) / 2 + sqrt(pow((vy - vx) / 2, 2) + vyx * vyx) AS l1, greatest((vy + vx) / 2 - sqrt(pow((vy - vx) / 2, 2) + vyx * vyx), 0) AS l2 FROM g)"


@query(f"WITH RECURSIVE {LAB}{_GEO} SELECT image_id, label::INT AS label, area::DOUBLE AS area_px, round(cy, 6) AS centroid_y, round(cx, 6) AS centroid_x, y0::INT AS bbox_min_row, x0::INT AS bbox_min_col, y1::INT AS bbox_max_row, x1::INT AS bbox_max_col, round(area / ((y1 - y0) * (x1 - x0)), 6) AS extent, round(sqrt(4 * area / pi()), 6) AS equivalent_diameter_px FROM e")
def object_geometry(spark, sf_dir):
    g = M.geometry(M.label_pixels(_objects(spark, sf_dir)))
    r = lambda c: F.round(c, 6).alias(c)
    return g.select("image_id", "label", "area_px", r("centroid_y"), r("centroid_x"), "bbox_min_row", "bbox_min_col", "bbox_max_row", "bbox_max_col", r("extent"), r("equivalent_diameter_px"))


@query(f"WITH RECURSIVE {LAB}{_GEO} SELECT image_id, label::INT AS label, round(4 * sqrt(l1), 4) AS major_axis_px, round(4 * sqrt(l2), 4) AS minor_axis_px, round(CASE WHEN l1 <= 0 THEN 0 ELSE sqrt(greatest(1 - l2 / l1, 0)) END, 4) AS eccentricity FROM e")
def object_moments(spark, sf_dir):
    g = M.geometry(M.label_pixels(_objects(spark, sf_dir)))
    return g.select("image_id", "label", *(F.round(c, 4).alias(c) for c in ("major_axis_px", "minor_axis_px", "eccentricity")))


_SHAPE = "CASE WHEN slope = 0 AND \"both\" <= 0 THEN -pi() / 4 ELSE atan2(2.0 * \"both\", slope) / 2 END AS orientation, CASE WHEN l2 > 1e-12 THEN sqrt(l1) / sqrt(l2) ELSE 0 END AS aspect"


@query(f"WITH RECURSIVE {LAB}{_GEO}, s AS (SELECT image_id, label, {_SHAPE} FROM e) SELECT image_id, label::INT AS label, round(orientation, 6) AS orientation, round(degrees(orientation), 4) AS orientation_deg, round(aspect, 4) AS aspect_ratio FROM s")
def object_shape(spark, sf_dir):
    g = M.geometry(M.label_pixels(_objects(spark, sf_dir)))
    aspect = F.when(F.col("minor_axis_px") > 4e-6, F.col("aspect_ratio")).otherwise(F.lit(0.0))  # beyond the noise of doubles
    return g.select("image_id", "label", F.round("orientation", 6).alias("orientation"), F.round("orientation_deg", 4).alias("orientation_deg"), F.round(aspect, 4).alias("aspect_ratio"))


_FILLED = """, bx AS (SELECT image_id, label, count(*) AS area, min(y) - 1 AS y0, max(y) + 1 AS y1, min(x) - 1 AS x0, max(x) + 1 AS x1 FROM lab GROUP BY ALL),
free AS (SELECT bx.image_id, bx.label, gy, gx, gy = y0 AND gx = x0 AS corner FROM bx, range(-1, 9) s(gy), range(-1, 9) t(gx) WHERE gy BETWEEN y0 AND y1 AND gx BETWEEN x0 AND x1 AND NOT EXISTS (SELECT 1 FROM lab l WHERE l.image_id = bx.image_id AND l.label = bx.label AND l.y = gy AND l.x = gx)),
outer_(image_id, label, gy, gx) AS (SELECT image_id, label, gy, gx FROM free WHERE corner UNION SELECT f.image_id, f.label, f.gy, f.gx FROM outer_ o JOIN free f ON f.image_id = o.image_id AND f.label = o.label AND abs(f.gy - o.gy) + abs(f.gx - o.gx) = 1),
hole AS (SELECT image_id, label, count(*) AS n FROM (SELECT image_id, label, gy, gx FROM free EXCEPT SELECT * FROM outer_) GROUP BY ALL)"""


@query(f"WITH RECURSIVE {LAB}{_FILLED} SELECT bx.image_id, bx.label::INT AS label, (area + coalesce(n, 0))::DOUBLE AS filled_area_px, coalesce(n, 0)::DOUBLE AS hole_area_px FROM bx LEFT JOIN hole USING (image_id, label)")
def object_holes(spark, sf_dir):
    f = _objects(spark, sf_dir)
    t = M.label_pixels(f).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area")).join(M.filled(f), ["image_id", "label"])
    return t.select("image_id", "label", "filled_area_px", (F.col("filled_area_px") - F.col("area")).alias("hole_area_px"))


@query(f"WITH RECURSIVE {LAB}{_GEO} SELECT image_id, label::INT AS label, round(area * 0.25, 6) AS area_um2, round(sqrt(4 * area / pi()) * 0.5, 6) AS equivalent_diameter_um FROM e")
def calibrated_sizes(spark, sf_dir):
    t = M.morphology(_objects(spark, sf_dir), 0.5)
    return t.select("image_id", "label", F.round("area_um2", 6).alias("area_um2"), F.round("equivalent_diameter_um", 6).alias("equivalent_diameter_um"))


@query(f"WITH RECURSIVE {LAB} SELECT image_id, label::INT AS label, bool_or(y IN (0, 7) OR x IN (0, 7)) AS touches_border FROM lab GROUP BY image_id, label")
def touches_border(spark, sf_dir):
    return M.geometry(M.label_pixels(_objects(spark, sf_dir))).select("image_id", "label", "touches_border")


_QUADS = ", o AS (SELECT unnest([0, 1, 0, 1]) AS dy, unnest([0, 0, 1, 1]) AS dx, unnest([1, 2, 4, 8]) AS b), k AS (SELECT image_id, label, y - dy AS y, x - dx AS x, sum(b) AS code FROM lab, o GROUP BY ALL)"


@query(f"WITH RECURSIVE {LAB}{_QUADS} SELECT image_id, label::INT AS label, round(sum(([{', '.join(map(repr, M.CROFTON))}]::DOUBLE[])[(code + 1)::INT]), 6) AS perimeter FROM k GROUP BY image_id, label")
def object_perimeter(spark, sf_dir):
    return M.perimeter_euler(_objects(spark, sf_dir)).select("image_id", "label", F.round("perimeter_crofton_px", 6).alias("perimeter"))


@query(f"WITH RECURSIVE {LAB}{_QUADS} SELECT image_id, label::INT AS label, (sum(CASE WHEN code IN (1, 2, 4, 8) THEN 1 WHEN code IN (7, 11, 13, 14) THEN -1 WHEN code IN (6, 9) THEN -2 ELSE 0 END) / 4)::INT AS euler FROM k GROUP BY image_id, label")
def object_euler(spark, sf_dir):
    return M.perimeter_euler(_objects(spark, sf_dir)).select("image_id", "label", F.col("euler_number").alias("euler"))


@query(f"WITH RECURSIVE {LAB} SELECT image_id, label::INT AS label, round(avg(v), 6) AS mean_intensity, round(median(v), 6) AS median_intensity, round(stddev_pop(v), 6) AS std_intensity, round(min(v), 6) AS min_intensity, round(max(v), 6) AS max_intensity, round(sum(v), 6) AS integrated_intensity FROM lab GROUP BY image_id, label")
def intensity_features(spark, sf_dir):
    t = M.intensity(M.label_pixels(_objects(spark, sf_dir)))
    return t.select("image_id", "label", *(F.round(c, 6).alias(c) for c in t.columns[2:]))


#: A hull of lattice points in a box is what all lattice directions of the box leave; the edge middles add max(|a|, |b|).
_HULL = (
    ", dir AS (SELECT a, b FROM range(-16, 17) s(a), range(-16, 17) t(b) WHERE gcd(a, b) = 1), sup AS (SELECT image_id, label, a, b, max(2 * (a * y + b * x)) + greatest(abs(a), abs(b)) AS h FROM lab, dir GROUP BY image_id, label, a, b),"
    " box AS (SELECT image_id, label, count(*) AS area, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM lab GROUP BY ALL), cell AS (SELECT image_id, label, area, gy, gx FROM box, range(8) s(gy), range(8) t(gx) WHERE gy BETWEEN y0 AND y1 AND gx BETWEEN x0 AND x1),"
    " ins AS (SELECT image_id, label, any_value(area) AS area, gy, gx FROM cell JOIN sup USING (image_id, label) GROUP BY image_id, label, gy, gx HAVING max(2 * (a * gy + b * gx) - h) <= 0)"
)


@query(f"WITH RECURSIVE {LAB}{_HULL} SELECT image_id, label::INT AS label, count(*)::DOUBLE AS convex_area_px, round(any_value(area) / count(*), 6) AS solidity FROM ins GROUP BY image_id, label")
def object_hull(spark, sf_dir):
    f = _objects(spark, sf_dir)
    t = M.label_pixels(f).groupBy("image_id", "label").agg(F.count(F.lit(1)).alias("area")).join(M.hulls(f), ["image_id", "label"])
    return t.select("image_id", "label", "convex_area_px", F.round(F.col("area") / F.col("convex_area_px"), 6).alias("solidity"))


_LEVEL = ", q AS (SELECT image_id, label, y, x, CASE WHEN max(v) OVER w - min(v) OVER w <= 0 THEN 1 ELSE least(greatest(floor((v - min(v) OVER w) / (max(v) OVER w - min(v) OVER w) * 30) + 1, 1), 31) END::INT AS l FROM lab WINDOW w AS (PARTITION BY image_id, label))"


@query(f"WITH RECURSIVE {LAB}{_LEVEL} SELECT image_id, label::INT AS label, y::INT AS y, x::INT AS x, l AS level FROM q")
def glcm_quantize(spark, sf_dir):
    return M.glcm_levels(M.label_pixels(_objects(spark, sf_dir))).select("image_id", "label", "y", "x", "level")


_GLCM = f""", o AS (SELECT unnest({[k for k in range(8)]}) AS k, unnest({[o[0] for o in M.OFFSETS]}) AS d, unnest({[o[1] for o in M.OFFSETS]}) AS dy, unnest({[o[2] for o in M.OFFSETS]}) AS dx),
u AS (SELECT a.image_id, a.label, k, a.l::DOUBLE AS i, b.l::DOUBLE AS j FROM q a, o JOIN q b ON b.image_id = a.image_id AND b.label = a.label AND b.y = a.y + o.dy AND b.x = a.x + o.dx),
n AS (SELECT image_id, label, k, i, j, count(*)::DOUBLE AS n FROM (SELECT * FROM u UNION ALL SELECT image_id, label, k, j, i FROM u) GROUP BY ALL),
p AS (SELECT *, n / sum(n) OVER (PARTITION BY image_id, label, k) AS p FROM n),
f AS (SELECT image_id, label, k, sum(p * (i - j) * (i - j)) AS contrast, sum(p * abs(i - j)) AS dissimilarity, sum(p / (1 + (i - j) * (i - j))) AS homogeneity, sum(p * p) AS asm, sum(-p * log2(p)) AS entropy, sum(p * i) AS mi, sum(p * i * i) AS ii, sum(p * i * j) AS ij FROM p GROUP BY ALL),
r AS (SELECT *, sqrt(asm) AS energy, CASE WHEN ii - mi * mi < 1e-12 THEN 1 ELSE (ij - mi * mi) / (ii - mi * mi) END AS correlation FROM f),
s AS (SELECT image_id, label, count(*) AS area FROM q GROUP BY ALL),
z AS (SELECT s.image_id, s.label, area, o.d, r.* EXCLUDE (image_id, label, k) FROM s CROSS JOIN o LEFT JOIN r ON r.image_id = s.image_id AND r.label = s.label AND r.k = o.k),
w AS (SELECT image_id, label, area >= 2 AND count(asm) > 0 AS ok, avg(coalesce(contrast, 0)) AS contrast, avg(coalesce(dissimilarity, 0)) AS dissimilarity, avg(coalesce(homogeneity, 0)) AS homogeneity, avg(coalesce(energy, 0)) AS energy, avg(coalesce(asm, 0)) AS asm, avg(coalesce(entropy, 0)) AS entropy, avg(coalesce(correlation, 1)) AS correlation, avg(coalesce(contrast, 0)) FILTER (d = 1) AS contrast_d1, avg(coalesce(contrast, 0)) FILTER (d = 3) AS contrast_d3 FROM z GROUP BY image_id, label, area)"""
_GLCM_COLUMNS = ("contrast", "dissimilarity", "homogeneity", "energy", "asm", "entropy", "correlation", "contrast_d1", "contrast_d3")


@query(f"WITH RECURSIVE {LAB}{_LEVEL}{_GLCM} SELECT image_id, label::INT AS label, {', '.join(f'round(CASE WHEN ok THEN {c} ELSE 0 END, 6) AS glcm_{c}' for c in _GLCM_COLUMNS)} FROM w")
def glcm_features(spark, sf_dir):
    t = M.glcm(M.label_pixels(_objects(spark, sf_dir)))
    return t.select("image_id", "label", *(F.round(f"glcm_{c}", 6).alias(f"glcm_{c}") for c in _GLCM_COLUMNS))


_TABLE = f"WITH RECURSIVE {LAB}{_GEO}{_QUADS}, per AS (SELECT image_id, label, sum(([{', '.join(map(repr, M.CROFTON))}]::DOUBLE[])[(code + 1)::INT]) AS per FROM k GROUP BY ALL), t AS (SELECT e.*, per, CASE WHEN per <= 0 THEN 0 ELSE least(greatest(4 * pi() * area / (per * per), 0), 1) END AS circ, y0 = 0 OR x0 = 0 OR y1 = 8 OR x1 = 8 AS tb FROM e JOIN per USING (image_id, label))"


_SOLID = _TABLE + _HULL + f", sol AS (SELECT image_id, label, any_value(area) / count(*) AS solidity FROM ins GROUP BY image_id, label), i AS (SELECT image_id, label, avg(v) AS mean_i, median(v) AS median_i, stddev_pop(v) AS std_i, min(v) AS min_i, max(v) AS max_i, sum(v) AS sum_i FROM lab GROUP BY ALL), full_ AS (SELECT t.*, {_SHAPE}, solidity, i.* EXCLUDE (image_id, label) FROM t JOIN sol USING (image_id, label) JOIN i USING (image_id, label))"
_FEATURES = {
    "area_px": "area", "centroid_y": "cy", "centroid_x": "cx", "extent": "area / ((y1 - y0) * (x1 - x0))", "equivalent_diameter_px": "sqrt(4 * area / pi())", "orientation": "orientation",
    "perimeter_crofton_px": "per", "circularity": "circ", "solidity": "solidity", "mean_intensity": "mean_i", "median_intensity": "median_i", "std_intensity": "std_i", "min_intensity": "min_i",
    "max_intensity": "max_i", "integrated_intensity": "sum_i",
}


@query(_SOLID + f" SELECT image_id, label::INT AS label, tb AS touches_border, {', '.join(f'round({e}, 6) AS {c}' for c, e in _FEATURES.items())} FROM full_")
def feature_table(spark, sf_dir):
    t = M.feature_table(_objects(spark, sf_dir))
    return t.select("image_id", "label", "touches_border", *(F.round(c, 6).alias(c) for c in _FEATURES))


@query(_SOLID + " SELECT image_id, label::INT AS label, round(mean_i, 6) AS data_mean_intensity, round(max_i + 0.5, 6) AS other_max_intensity FROM full_ WHERE NOT tb")
def feature_table_channels(spark, sf_dir):
    f = _objects(spark, sf_dir).withColumn("other", F.transform("data", lambda v: v + 0.5))
    t = M.feature_table(f, ("data", "other"), texture=False, exclude_border=True)
    return t.select("image_id", "label", *(F.round(c, 6).alias(c) for c in ("data_mean_intensity", "other_max_intensity")))


def _measured(spark, sf_dir):
    f = _objects(spark, sf_dir)
    return f, M.morphology(f).join(M.intensity(M.label_pixels(f)).select("image_id", "label", "mean_intensity"), ["image_id", "label"])


_SUMMARY = {"area_px": "area", "perimeter_crofton_px": "per", "circularity": "circ", "eccentricity": "CASE WHEN l1 <= 0 THEN 0 ELSE sqrt(greatest(1 - l2 / l1, 0)) END", "solidity": "solidity"}
_SUMMARY_SQL = ", ".join(f"round({f}({e}), {4 if c == 'eccentricity' else 6}) AS {c}_{n}" for c, e in _SUMMARY.items() for f, n in (("avg", "mean"), ("stddev_pop", "std"), ("median", "median")))


@query(_SOLID + f" SELECT v.vec_id AS image_id, count(t.label) AS n_objects, count(*) FILTER (tb) AS n_border_objects, {_SUMMARY_SQL}, round(avg(mean_i), 6) AS mean_intensity_mean FROM embeddings v LEFT JOIN full_ t ON t.image_id = v.vec_id GROUP BY v.vec_id")
def image_summary(spark, sf_dir):
    f, objects = _measured(spark, sf_dir)
    t = Q.image_summary(f, objects)
    return t.select("image_id", "n_objects", "n_border_objects", *(F.round(c, 4 if c.startswith("eccentricity") else 6).alias(c) for c in t.columns[3:]))


def _confidence():
    """Mean likelihood of the likeliest class over foreground, or over all of a field without any; probabilities made of
    pixel values."""

    def top(v):
        a, b = F.exp(v * 4), F.exp(-v * 4)
        return F.struct((b / (a + b + 1)).alias("p0"), F.greatest(a / (a + b + 1), b / (a + b + 1), 1 / (a + b + 1)).alias("t"))

    fg = lambda t: F.transform(F.filter(t, lambda r: r.p0 < 0.2), lambda r: r.t)
    return A.bind(F.transform("data", top), lambda t: F.coalesce(A.mean(fg(t)), A.mean(F.transform(t, lambda r: r.t))))


def _signals(spark, sf_dir):
    f, objects = _measured(spark, sf_dir)
    images = f.select("image_id", F.size("labels").alias("n_pixels"), F.size(F.filter("labels", lambda v: v > 0)).alias("n_foreground"), F.array_max("labels").alias("n_labels"), _confidence().alias("predictive_confidence"))
    return Q.signals(images, objects)


_PREDICTIVE = "pc AS (SELECT image_id, coalesce(avg(greatest(p0, p1, p2)) FILTER (p0 < 0.2), avg(greatest(p0, p1, p2))) AS predictive_confidence FROM (SELECT image_id, v, exp(v * 4) / (exp(v * 4) + exp(-v * 4) + 1) AS p1, exp(-v * 4) / (exp(v * 4) + exp(-v * 4) + 1) AS p0, 1 / (exp(v * 4) + exp(-v * 4) + 1) AS p2 FROM px) GROUP BY image_id)"
_SIGNALS = _SOLID + f""", {_PREDICTIVE}, im AS (SELECT image_id, count(*) FILTER (v > 0.1) AS nf FROM px GROUP BY image_id), m AS (SELECT image_id, median(area) AS med FROM full_ GROUP BY image_id),
sig AS (SELECT im.image_id, count(t.label)::DOUBLE AS n_objects, nf / 64.0::DOUBLE AS foreground_fraction, count(t.label) * 1e6 / 64 AS object_density_per_mp, any_value(m.med) AS median_area_px, stddev_pop(area) / avg(area) AS area_cv, avg((area < 0.15 * m.med)::INT::DOUBLE) FILTER (t.label IS NOT NULL) AS tiny_fraction, median(circ) AS median_circularity, avg(tb::INT) AS border_fraction, median(solidity) AS median_solidity, any_value(pc.predictive_confidence) AS predictive_confidence FROM im JOIN pc USING (image_id) LEFT JOIN full_ t USING (image_id) LEFT JOIN m USING (image_id) GROUP BY im.image_id, nf)"""
_SIGNAL_COLUMNS = ("n_objects", "foreground_fraction", "object_density_per_mp", "median_area_px", "area_cv", "tiny_fraction", "median_circularity", "border_fraction", "median_solidity", "predictive_confidence")


@query(_SIGNALS + f" SELECT image_id, {', '.join(f'round({c}, 6) AS {c}' for c in _SIGNAL_COLUMNS)} FROM sig")
def qc_signals(spark, sf_dir):
    return _signals(spark, sf_dir).select("image_id", *(F.round(c, 6).alias(c) for c in _SIGNAL_COLUMNS))


_PEN = ", ".join(f"coalesce(least(greatest({f'({s} - {lim}) / {wid}' if k == 'above' else f'({lim} - {s}) / {wid}'}, 0), 1), 0) AS p{i}" for i, (_, s, k, lim, wid) in enumerate(Q.RULES))
_PROD = " * ".join(f"(1 - p{i})" for i in range(len(Q.RULES)))
_FLAG_SQL = ", ".join(f"CASE WHEN p{i} > 0 THEN printf('{Q.FLAGS[r[0]][0]}', round_even({r[1]} * {Q.FLAGS[r[0]][1]}, {Q.FLAGS[r[0]][2]})) END" for i, r in enumerate(Q.RULES))
_ASSESSED = _SIGNALS + f", pen AS (SELECT *, {_PEN} FROM sig), conf AS (SELECT *, CASE WHEN n_objects <= 0 THEN 0 ELSE {_PROD} END AS conf, CASE WHEN n_objects <= 0 THEN ['no objects detected'] ELSE list_filter([{_FLAG_SQL}], lambda x: x IS NOT NULL) END AS flags FROM pen)"


@query(_ASSESSED + " SELECT image_id, round(conf, 5) AS confidence, n_objects > 0 AND conf >= 0.55 AS passed, array_to_string(flags, '; ') AS flags FROM conf")
def qc_assess(spark, sf_dir):
    t = Q.assess(_signals(spark, sf_dir))
    return t.select("image_id", F.round("confidence", 5).alias("confidence"), "passed", "flags")


@query(_ASSESSED + f" SELECT image_id, round(conf, 4) AS qc_confidence, n_objects > 0 AND conf >= 0.55 AS qc_passed, array_to_string(flags, '; ') AS qc_flags, len(flags)::INT AS qc_n_flags, {', '.join(f'round({c}, 5) AS qc_{c}' for c in _SIGNAL_COLUMNS)}, {', '.join(f'CASE WHEN n_objects > 0 AND p{i} > 0 THEN round(p{i}, 5) END AS qc_penalty_{r[0]}' for i, r in enumerate(Q.RULES))} FROM conf")
def qc_report(spark, sf_dir):
    return Q.report(Q.assess(_signals(spark, sf_dir)))


@query(_ASSESSED + " SELECT image_id, CASE WHEN n_objects <= 0 THEN 'fail' WHEN conf >= 0.55 THEN 'pass' WHEN conf >= 0.275 THEN 'review' ELSE 'fail' END AS verdict, array_to_string(flags, '; ') AS flags FROM conf")
def qc_verdict(spark, sf_dir):
    t = Q.assess(_signals(spark, sf_dir))
    verdict = F.when(F.col("n_objects") <= 0, F.lit("fail")).when(F.col("confidence") >= Q.PASS, F.lit("pass")).when(F.col("confidence") >= Q.PASS / 2, F.lit("review")).otherwise(F.lit("fail"))
    return t.select("image_id", verdict.alias("verdict"), "flags")


@query(_ASSESSED + " SELECT image_id, n_objects::BIGINT AS n_objects, round(foreground_fraction, 6) AS foreground_fraction, round(median_area_px, 6) AS median_area_px, round(conf, 5) AS confidence, n_objects > 0 AND conf >= 0.55 AS passed FROM conf")
def field_report(spark, sf_dir):
    """From pixels to the number of objects and a quality verdict of every field."""
    t = Q.assess(_signals(spark, sf_dir))
    return t.select("image_id", F.col("n_objects").cast("long").alias("n_objects"), *(F.round(c, 6).alias(c) for c in ("foreground_fraction", "median_area_px")), F.round("confidence", 5).alias("confidence"), "passed")


@query("SELECT l_suppkey AS image_id, round(least(greatest((avg(l_quantity) - 1.25) / 0.5, 0), 1), 6) AS above, round(least(greatest((25.5 - avg(l_quantity)) / 2, 0), 1), 6) AS below FROM lineitem GROUP BY l_suppkey")
def penalty_ramp(spark, sf_dir):
    t = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("image_id")).agg(F.avg("l_quantity").alias("q"))
    return t.select("image_id", F.round(A.ramp_above(F.col("q"), 1.25, 0.5), 6).alias("above"), F.round(A.ramp_below(F.col("q"), 25.5, 2.0), 6).alias("below"))


@query(f"WITH {PX}, q AS (SELECT image_id, v, exp(v * 4) / (exp(v * 4) + exp(-v * 4) + 1) AS p1, exp(-v * 4) / (exp(v * 4) + exp(-v * 4) + 1) AS p0, 1 / (exp(v * 4) + exp(-v * 4) + 1) AS p2 FROM px) SELECT image_id, round(coalesce(avg(greatest(p0, p1, p2)) FILTER (p0 < 0.2), avg(greatest(p0, p1, p2))), 6) AS confidence FROM q GROUP BY image_id")
def predictive_confidence(spark, sf_dir):
    return read_fields(spark, sf_dir).select("image_id", F.round(_confidence(), 6).alias("confidence"))


_VALID = ", ".join(f"round(avg({c}) FILTER ({'NOT ' * (v == 'passed')}flagged), 4) AS {c}_{v}" for c in ("dice", "ap") for v in ("passed", "flagged"))


@query(f"WITH j AS (SELECT quality = 0 AS failed, toxic = 1 AS flagged, n_chars::DOUBLE AS confidence, (quality + 1.0) / (1 + n_chars % 7) AS dice, n_chars % 11 / 10.0 AS ap FROM labels JOIN documents USING (doc_id)) SELECT count(*) AS n, count(*) FILTER (failed) AS n_failures, count(*) FILTER (flagged) AS n_flagged, count(*) FILTER (failed AND flagged) AS caught, count(*) FILTER (failed AND NOT flagged) AS missed, count(*) FILTER (NOT failed AND flagged) AS false_alarms, round(count(*) FILTER (failed AND flagged) / nullif(count(*) FILTER (failed), 0), 4) AS catch_rate, round(count(*) FILTER (NOT failed AND flagged) / greatest(count(*) FILTER (NOT failed), 1), 4) AS false_alarm_rate, round(corr(confidence, dice), 4) AS corr, {_VALID} FROM j")
def qc_validation(spark, sf_dir):
    j = _table(spark, sf_dir, "labels").join(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    return Q.validation(j.select(
        (F.col("quality") == 0).alias("failed"), (F.col("toxic") == 1).alias("flagged"), F.col("n_chars").cast("double").alias("confidence"),
        ((F.col("quality") + 1.0) / (1 + F.col("n_chars") % 7)).alias("dice"), (F.col("n_chars") % 11 / 10.0).alias("ap"),
    ))


def _counts(spark, sf_dir):
    f = read_fields(spark, sf_dir).withColumn("q", A.quantile(F.col("data"), 0.6))
    c = E.confusion(F.transform("data", lambda v: v > 0), F.transform("data", lambda v: v > F.col("q")))
    return f.select("image_id", *(e.alias(k) for k, e in c.items()))


@query(f"WITH {COUNTS} SELECT * FROM c")
def confusion_counts(spark, sf_dir):
    return _counts(spark, sf_dir)


_SEM = "round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS dice, round(coalesce(tp / nullif(tp + fp + fn, 0), 1), 6) AS iou"


@query(f"WITH {COUNTS} SELECT image_id, {_SEM} FROM c")
def dice_iou(spark, sf_dir):
    return E.semantic_metrics(_counts(spark, sf_dir)).select("image_id", F.round("dice", 6).alias("dice"), F.round("iou", 6).alias("iou"))


_SEM_ALL = _SEM + ", round(coalesce(tp / nullif(tp + fp, 0), 1), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 1), 6) AS recall, round(coalesce(tn / nullif(tn + fp, 0), 1), 6) AS specificity, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy"


@query(f"WITH {COUNTS} SELECT image_id, {_SEM_ALL} FROM c")
def semantic_metrics(spark, sf_dir):
    return E.semantic_metrics(_counts(spark, sf_dir)).select("image_id", *(F.round(c, 6).alias(c) for c in ("dice", "iou", "precision", "recall", "specificity", "accuracy")))


_SIX = ("dice", "iou", "precision", "recall", "specificity", "accuracy")


@query(f"WITH {COUNTS}, s AS (SELECT {_SEM_ALL} FROM c) SELECT count(*) AS n_images, {', '.join(f'round(avg({c}), 5) AS {c}' for c in _SIX)} FROM s")
def aggregate_metrics(spark, sf_dir):
    return E.summary(semantic_metrics(spark, sf_dir)).select("n_images", *(F.round(c, 5).alias(c) for c in _SIX))


@query(f"WITH {PX}, k AS (SELECT image_id, CASE WHEN v > 0.1 THEN 1 WHEN v > 0 THEN 2 ELSE 0 END AS t, CASE WHEN v > 0.08 THEN 1 WHEN v > -0.02 THEN 2 ELSE 0 END AS s FROM px), c AS (SELECT image_id, c, count(*) FILTER (t = c AND s = c) AS tp, count(*) FILTER (t <> c AND s = c) AS fp, count(*) FILTER (t = c AND s <> c) AS fn FROM k, (SELECT unnest([0, 1, 2]) AS c) GROUP BY image_id, c) SELECT image_id, c::INT AS class, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 1), 6) AS dice FROM c")
def per_class_dice(spark, sf_dir):
    cls = lambda v, a, b: F.when(v > a, F.lit(1)).when(v > b, F.lit(2)).otherwise(F.lit(0))
    f = read_fields(spark, sf_dir).select("image_id", F.transform("data", lambda v: cls(v, 0.1, 0.0)).alias("t"), F.transform("data", lambda v: cls(v, 0.08, -0.02)).alias("s"))
    f = f.withColumn("class", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    c = E.confusion(F.transform("t", lambda v: v == F.col("class")), F.transform("s", lambda v: v == F.col("class")))
    return f.select("image_id", "class", F.round(A.guarded(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"], 1.0), 6).alias("dice"))


@query(f"WITH {PX} SELECT image_id, round(coalesce(avg(abs(v - 0.1)) FILTER (v > 0), 0), 6) AS l1 FROM px GROUP BY image_id")
def masked_l1(spark, sf_dir):
    return read_fields(spark, sf_dir).select("image_id", F.round(F.coalesce(A.mean(F.transform(F.filter("data", lambda v: v > 0), lambda v: F.abs(v - 0.1))), F.lit(0.0)), 6).alias("l1"))


@query(f"WITH {PX}, s AS (SELECT image_id, sum(1 / (1 + exp(-8 * v)) * (v > 0)::INT) AS i, sum(1 / (1 + exp(-8 * v)) + (v > 0)::INT) AS u FROM px GROUP BY image_id) SELECT image_id, round((2 * i + 1) / (u + 1), 6) AS dice FROM s")
def soft_dice(spark, sf_dir):
    p, t = F.transform("data", lambda v: 1 / (1 + F.exp(-8 * v))), F.transform("data", lambda v: (v > 0).cast("double"))
    i, u = A.total(F.zip_with(p, t, lambda a, b: a * b)), A.total(F.zip_with(p, t, lambda a, b: a + b))
    return read_fields(spark, sf_dir).select("image_id", F.round((2 * i + 1) / (u + 1), 6).alias("dice"))


@query(f"WITH {MASK} SELECT image_id, y::INT AS y, x::INT AS x, CASE WHEN t AND s THEN 'TP' WHEN s THEN 'FP' WHEN t THEN 'FN' ELSE 'TN' END AS v FROM m")
def error_map(spark, sf_dir):
    f = read_fields(spark, sf_dir).withColumn("q", A.quantile(F.col("data"), 0.6))
    kind = lambda v: F.when((v > 0) & (v > F.col("q")), F.lit("TP")).when(v > F.col("q"), F.lit("FP")).when(v > 0, F.lit("FN")).otherwise(F.lit("TN"))
    return pixels(f.withColumn("v", F.transform("data", kind)), "v")


def _two_maps(spark, sf_dir):
    return K.map_fields(_objects(spark, sf_dir), lambda a: K.label(a > 0.15), "pred", "array<int>")


_LAB2 = LAB + """, fg2 AS (SELECT * FROM px WHERE v > 0.15), reach2(image_id, p, q) AS (SELECT image_id, p, p FROM fg2 UNION SELECT r.image_id, r.p, f.p FROM reach2 r JOIN fg2 g ON g.image_id = r.image_id AND g.p = r.q
  JOIN fg2 f ON f.image_id = r.image_id AND abs(f.y - g.y) <= 1 AND abs(f.x - g.x) <= 1), root2 AS (SELECT image_id, p, min(q) AS root FROM reach2 GROUP BY image_id, p),
lab2 AS (SELECT image_id, p, dense_rank() OVER (PARTITION BY image_id ORDER BY root) AS label FROM root2),
ov AS (SELECT image_id, a.label AS t, b.label AS s, count(*) AS n FROM lab a JOIN lab2 b USING (image_id, p) GROUP BY ALL), ar AS (SELECT image_id, label AS t, count(*) AS na FROM lab GROUP BY ALL), ap AS (SELECT image_id, label AS s, count(*) AS nb FROM lab2 GROUP BY ALL),
iou AS (SELECT image_id, t, s, n / (na + nb - n) AS iou FROM ov JOIN ar USING (image_id, t) JOIN ap USING (image_id, s)),
cnt AS (SELECT vec_id AS image_id, coalesce((SELECT max(label) FROM lab WHERE lab.image_id = vec_id), 0) AS nt, coalesce((SELECT max(label) FROM lab2 WHERE lab2.image_id = vec_id), 0) AS np FROM embeddings)"""


def _pairs(spark, sf_dir):
    f = _two_maps(spark, sf_dir)
    images = f.select("image_id", F.array_max("labels").alias("n_true"), F.array_max("pred").alias("n_pred"))
    return images, E.iou_pairs(pixels(f, "labels", "pred").select("image_id", F.col("labels").alias("t"), F.col("pred").alias("p")))


@query(f"WITH RECURSIVE {_LAB2} SELECT image_id, t::INT AS t, s::INT AS p, round(iou, 6) AS iou FROM iou")
def iou_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir)[1].select("image_id", "t", "p", F.round("iou", 6).alias("iou"))


#: Pairs that overlap no other object are matched; of the rest, all one-to-one choices are tried, one true object at a time.
_MATCH = _LAB2 + """, one AS (SELECT *, count(*) OVER (PARTITION BY image_id, t) + count(*) OVER (PARTITION BY image_id, s) = 2 AS alone FROM iou),
turn AS (SELECT image_id, t, row_number() OVER (PARTITION BY image_id ORDER BY t) AS k FROM (SELECT DISTINCT image_id, t FROM one WHERE NOT alone)),
pick AS (SELECT image_id, t, s, iou FROM one WHERE NOT alone UNION ALL SELECT image_id, t, 0, 0 FROM turn),
tried(image_id, k, used, total, took) AS (SELECT DISTINCT image_id, 0::BIGINT, []::BIGINT[], 0::DOUBLE, []::STRUCT(t BIGINT, s BIGINT, iou DOUBLE)[] FROM turn
  UNION ALL SELECT r.image_id, r.k + 1, list_append(r.used, p.s), r.total + p.iou, list_append(r.took, {'t': p.t, 's': p.s, 'iou': p.iou}) FROM tried r JOIN turn n ON n.image_id = r.image_id AND n.k = r.k + 1 JOIN pick p ON p.image_id = n.image_id AND p.t = n.t AND (p.s = 0 OR NOT list_contains(r.used, p.s))),
done AS (SELECT image_id, arg_max(took, total) AS took FROM tried JOIN (SELECT image_id, max(k) AS k FROM turn GROUP BY ALL) USING (image_id, k) GROUP BY image_id),
matched AS (SELECT image_id, t, s, iou FROM one WHERE alone UNION ALL SELECT image_id, x.t, x.s, x.iou FROM (SELECT image_id, unnest(took) AS x FROM done) WHERE x.s > 0),
good AS (SELECT * FROM matched WHERE iou >= 0.5 - 1e-12)"""


@query(f"""WITH RECURSIVE {_MATCH} SELECT image_id, 'match' AS kind, t::INT AS t, s::INT AS p, round(iou, 6) AS iou FROM good
UNION ALL SELECT image_id, 'miss', t::INT, NULL, NULL FROM (SELECT image_id, unnest(range(1, nt + 1)) AS t FROM cnt) ANTI JOIN good USING (image_id, t)
UNION ALL SELECT image_id, 'extra', NULL, s::INT, NULL FROM (SELECT image_id, unnest(range(1, np + 1)) AS s FROM cnt) ANTI JOIN good USING (image_id, s)""")
def match_instances(spark, sf_dir):
    """Matched pairs, missed and extra objects at an IoU of one half."""
    return E.matches_at(E.match_instances(*_pairs(spark, sf_dir))).withColumn("iou", F.round("iou", 6))


_AP = ", ".join(f"round(coalesce(count(iou) FILTER (iou >= {t} - 1e-12) / nullif(nt + np - count(iou) FILTER (iou >= {t} - 1e-12), 0), 1), 6) AS ap_{int(round(100 * t))}" for t in E.THRESHOLDS)


@query(f"WITH RECURSIVE {_MATCH} SELECT c.image_id, {_AP} FROM cnt c LEFT JOIN matched USING (image_id) GROUP BY c.image_id, nt, np")
def average_precision(spark, sf_dir):
    m = E.instance_metrics(E.match_instances(*_pairs(spark, sf_dir)))
    return m.select("image_id", *(F.round(f"ap_{int(round(100 * t))}", 6).alias(f"ap_{int(round(100 * t))}") for t in E.THRESHOLDS))


@query(f"WITH RECURSIVE {_LAB2} SELECT image_id, np::INT AS count_pred, nt::INT AS count_true, (np - nt)::INT AS count_error, abs(np - nt)::INT AS count_abs_error, round(coalesce(abs(np - nt) / nullif(nt, 0), 0), 6) AS count_rel_error FROM cnt")
def count_metrics(spark, sf_dir):
    images, pairs = _pairs(spark, sf_dir)
    t = images.select("image_id", F.col("n_pred").alias("count_pred"), F.col("n_true").alias("count_true"))
    gap = F.col("count_pred") - F.col("count_true")
    return t.select("*", gap.alias("count_error"), F.abs(gap).alias("count_abs_error"), F.round(A.guarded(F.abs(gap), F.col("count_true")), 6).alias("count_rel_error"))


_AP_MEAN = " + ".join(f"coalesce(count(iou) FILTER (iou >= {t} - 1e-12) / nullif(nt + np - count(iou) FILTER (iou >= {t} - 1e-12), 0), 1)" for t in E.THRESHOLDS)


@query(f"""WITH RECURSIVE {_MATCH}, a AS (SELECT c.image_id, nt, np, count(iou) FILTER (iou >= 0.5 - 1e-12) AS tp, coalesce(avg(iou) FILTER (iou >= 0.5 - 1e-12), 0) AS mi, ({_AP_MEAN}) / 10 AS apm FROM cnt c LEFT JOIN matched USING (image_id) GROUP BY c.image_id, nt, np),
b AS (SELECT *, coalesce(tp / nullif(np, 0), 1) AS pr, coalesce(tp / nullif(nt, 0), 1) AS re FROM a)
SELECT image_id, tp::INT AS tp, (np - tp)::INT AS fp, (nt - tp)::INT AS fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(coalesce(2 * pr * re / nullif(pr + re, 0), 0), 6) AS f1, round(mi, 6) AS mean_matched_iou, round(apm, 6) AS ap_mean, (np - nt)::INT AS count_error, abs(np - nt)::INT AS count_abs_error, round(coalesce(abs(np - nt) / nullif(nt, 0), 0), 6) AS count_rel_error FROM b""")
def instance_metrics(spark, sf_dir):
    m = E.instance_metrics(E.match_instances(*_pairs(spark, sf_dir)))
    return m.select("image_id", "tp", "fp", "fn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "mean_matched_iou", "ap_mean")), "count_error", "count_abs_error", F.round("count_rel_error", 6).alias("count_rel_error"))


@query(f"WITH {PX}, k AS (SELECT image_id, y, x, v, unnest(['none', 'x0.5', 'x1.6']) AS corruption, unnest([1.0, 0.5, 1.6]) AS f FROM px), c AS (SELECT corruption, image_id, count(*) FILTER (v > 0.1 AND v * f > 0.1) AS tp, count(*) FILTER (v > 0.1) AS t, count(*) FILTER (v * f > 0.1) AS s FROM k GROUP BY ALL), d AS (SELECT corruption, avg(coalesce(2 * tp / nullif(t + s, 0), 1)) AS dice FROM c GROUP BY corruption) SELECT d.corruption, round(d.dice, 6) AS dice, round(z.dice - d.dice, 6) AS dice_drop, round(coalesce(d.dice / nullif(z.dice, 0), 0), 6) AS retention FROM d JOIN d z ON z.corruption = 'none'")
def robustness_drop(spark, sf_dir):
    f = read_fields(spark, sf_dir).withColumn("c", F.explode(F.array(*(F.struct(F.lit(n).alias("corruption"), F.lit(x).alias("f")) for n, x in (("none", 1.0), ("x0.5", 0.5), ("x1.6", 1.6))))))
    c = E.confusion(F.transform("data", lambda v: v > ABOVE), F.transform("data", lambda v: v * F.col("c.f") > ABOVE))
    d = f.select("c.corruption", "image_id", A.guarded(2 * c["tp"], 2 * c["tp"] + c["fp"] + c["fn"], 1.0).alias("d")).groupBy("corruption").agg(F.avg("d").alias("dice"))
    clean = d.where("corruption = 'none'").select(F.col("dice").alias("z"))
    return d.join(F.broadcast(clean)).select("corruption", F.round("dice", 6).alias("dice"), F.round(F.col("z") - F.col("dice"), 6).alias("dice_drop"), F.round(A.guarded(F.col("dice"), F.col("z")), 6).alias("retention"))


_ARMS = "a AS (SELECT o_custkey AS id, o_totalprice AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey AS id, o_totalprice AS m, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders WHERE o_orderstatus = 'O'), j AS (SELECT a.id, a.m AS first, b.m AS second, a.m - b.m AS d FROM a JOIN b ON a.id = b.id AND a.r = 1 AND b.r = 1)"


def _joined(spark, sf_dir):
    o = _table(spark, sf_dir, "orders")
    arm = lambda s, n: E.keep_first(o.where(F.col("o_orderstatus") == s), "o_custkey", "o_orderkey").select(F.col("o_custkey").alias("id"), F.col("o_totalprice").alias(n))
    return arm("F", "first").join(arm("O", "second"), "id").withColumn("d", F.col("first") - F.col("second"))


@query(f"WITH {_ARMS} SELECT id, first, second, round(d, 4) AS d FROM j")
def paired_join(spark, sf_dir):
    return _joined(spark, sf_dir).withColumn("d", F.round("d", 4))


@query(f"WITH {_ARMS} SELECT count(*) AS n, round(avg(d), 3) AS mean_diff, round(median(d), 3) AS median_diff, count(*) FILTER (d > 0) AS wins FROM j")
def paired_diff(spark, sf_dir):
    return _joined(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("d"), 3).alias("mean_diff"), F.round(F.expr("percentile(d, 0.5)"), 3).alias("median_diff"), F.count_if(F.col("d") > 0).alias("wins"))


_RANKS = f"WITH {_ARMS}, r AS (SELECT round(d, 2) AS d FROM j WHERE round(d, 2) <> 0), k AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0 AS rk FROM r), w AS (SELECT count(*) AS n, sum(rk) FILTER (d > 0)::DOUBLE AS w_plus, sum(rk) FILTER (d < 0)::DOUBLE AS w_minus, least(sum(rk) FILTER (d > 0), sum(rk) FILTER (d < 0))::DOUBLE AS w FROM k)"


@query(_RANKS + " SELECT * FROM w")
def wilcoxon_w(spark, sf_dir):
    t = E.wilcoxon(_joined(spark, sf_dir).withColumn("d", F.round("d", 2)))
    return t.select("n", *(F.col(c).cast("double").alias(c) for c in ("w_plus", "w_minus", "w")))


@query(_RANKS + ", tie AS (SELECT sum(c * c * c - c) AS ties FROM (SELECT count(*) AS c FROM r GROUP BY abs(d))), z AS (SELECT (w - n * (n + 1) / 4) / sqrt((n * (n + 1) * (2 * n + 1) - ties / 2) / 24) AS z FROM w, tie), x AS (SELECT z, abs(z) / sqrt(2) AS x, 1 / (1 + 0.3275911 * abs(z) / sqrt(2)) AS t FROM z) SELECT round(z, 5) AS z, round(least(1, t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * exp(-x * x)), 6) AS p FROM x")
def wilcoxon_p(spark, sf_dir):
    t = E.wilcoxon_p(E.wilcoxon(_joined(spark, sf_dir).withColumn("d", F.round("d", 2))))
    return t.select(F.round("z", 5).alias("z"), F.round("p", 6).alias("p"))


@query()
def paired_interval(spark, sf_dir):
    """Paired report with a resampled interval; NumPy's generator has no SQL."""
    return spark.createDataFrame([E.paired_report(_joined(spark, sf_dir))], "n long, mean double, median double, low double, high double, wins long, crosses_zero boolean")


@query("WITH c AS (SELECT l_suppkey AS id, count(*) AS n FROM lineitem GROUP BY l_suppkey), r AS (SELECT id, n, row_number() OVER (ORDER BY n, id) - 1 AS k, count(*) OVER () AS t FROM c) SELECT id, n, CASE WHEN k = t // 6 THEN 'sparse' WHEN k = t // 2 THEN 'typical' ELSE 'crowded' END AS pick FROM r WHERE k IN (t // 6, t // 2, t - 2)")
def pick_examples(spark, sf_dir):
    c = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    r = c.withColumns({"k": F.row_number().over(Window.orderBy("n", "id")) - 1}).join(F.broadcast(c.agg(F.count(F.lit(1)).alias("t"))))
    pick = F.when(F.expr("k = t div 6"), "sparse").when(F.expr("k = t div 2"), "typical").otherwise("crowded")
    return r.where(F.expr("k in (t div 6, t div 2, t - 2)")).select("id", "n", pick.alias("pick"))


@query("WITH s AS (SELECT source, lang, n_chars FROM documents) SELECT source, count(DISTINCT lang) AS kinds, min(n_chars) AS least, list_sort(list(n_chars))[count(*) // 2 + 1] AS middle, max(n_chars) AS most FROM s GROUP BY source")
def dataset_profile(spark, sf_dir):
    """The upper median by counting equal values first, so that no source is gathered."""
    d = _table(spark, sf_dir, "documents")
    values = d.where("n_chars is not null").groupBy("source", "n_chars").agg(F.count(F.lit(1)).alias("c"))
    run = Window.partitionBy("source").orderBy("n_chars").rowsBetween(Window.unboundedPreceding, 0)
    middle = values.withColumns({"upto": F.sum("c").over(run), "all_": F.sum("c").over(Window.partitionBy("source"))}).where("upto > all_ div 2")
    middle = middle.groupBy("source").agg(F.min("n_chars").alias("middle"))
    return d.groupBy("source").agg(F.count_distinct("lang").alias("kinds"), F.min("n_chars").alias("least"), F.max("n_chars").alias("most")).join(middle, "source").select("source", "kinds", "least", "middle", "most")


@query("SELECT event_id, user_id, event_type FROM events ORDER BY event_id LIMIT 50 OFFSET 20")
def limit_offset(spark, sf_dir):
    return _table(spark, sf_dir, "events").select("event_id", "user_id", "event_type").orderBy("event_id").offset(20).limit(50)


@query()
def split_join(spark, sf_dir):
    """Images with their split; ids of the test tables' vectors, as many as there are fields."""
    ids = [str(r[0]) for r in read_fields(spark, sf_dir).select("image_id").collect()]
    rows = [(i, s) for s, part in E.split_ids(ids).items() for i in part]
    splits = spark.createDataFrame(rows, "id string, split string")
    return read_fields(spark, sf_dir).select("image_id").join(splits, F.col("image_id").cast("string") == F.col("id")).select("image_id", "split")


@query()
def watershed_split(spark, sf_dir):
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: K.watershed(a > 0, 1), "made", "array<int>")
    return pixels(f, "made").where("made > 0").select("image_id", "y", "x", F.col("made").alias("v"))


@query(f"WITH {_MED}, h AS (SELECT *, median(m) OVER (PARTITION BY image_id) AS c FROM med) SELECT image_id, y::INT AS y, x::INT AS x, round(least(greatest(v - m + c, 0), 1), 6) AS v FROM h")
def flatten(spark, sf_dir):
    f = read_fields(spark, sf_dir).withColumn("back", P.median3(F.col("data"), F.col("height"), F.col("width")))
    return _px(f.withColumn("data", P.flatten(F.col("data"), F.col("back"))))


_POINTWISE = f"""{_MED}, c AS (SELECT *, median(v - m) OVER w AS c FROM med WINDOW w AS (PARTITION BY image_id)), s AS (SELECT *, 1.4826 * median(abs(v - m - c)) OVER (PARTITION BY image_id) AS s FROM c),
h1 AS (SELECT image_id, y, x, CASE WHEN s >= 1e-6 AND abs(v - m) > 5 * s THEN m ELSE v END AS v FROM s),
q1 AS (SELECT *, quantile_cont(v, 0.01) OVER w AS a, quantile_cont(v, 0.99) OVER w AS b, quantile_cont(v, 0.5) OVER w AS d FROM h1 WINDOW w AS (PARTITION BY image_id)),
h2 AS (SELECT image_id, y, x, CASE WHEN b - a < 1e-6 OR d < (a + b) / 2 THEN v ELSE 1 - v END AS v FROM q1),
q2 AS (SELECT *, quantile_cont(v, 0.02) OVER w AS a, quantile_cont(v, 0.98) OVER w AS b FROM h2 WINDOW w AS (PARTITION BY image_id)),
h3 AS (SELECT image_id, y, x, CASE WHEN b - a < 1e-8 THEN 0 ELSE least(greatest((v - a) / (b - a), 0), 1) END AS v FROM q2),
q3 AS (SELECT *, avg(v) OVER w AS a, stddev_pop(v) OVER w AS b FROM h3 WINDOW w AS (PARTITION BY image_id))"""


@query(f"WITH {_POINTWISE} SELECT image_id, y::INT AS y, x::INT AS x, round(CASE WHEN b < 1e-8 THEN 0 ELSE least(greatest(((v - a) / b + 3) / 6, 0), 1) END, 6) AS v FROM q3")
def preprocess_pointwise(spark, sf_dir):
    """The chain in its fixed order, with the steps that SQL can follow."""
    return _px(P.preprocess_fields(read_fields(spark, sf_dir), P.Chain(illumination=None, denoise=None, contrast="stretch", normalize="zscore")))


@query(f"WITH {_POINTWISE}, t AS (SELECT image_id, y, x, round(CASE WHEN b < 1e-8 THEN 0 ELSE least(greatest(((v - a) / b + 3) / 6, 0), 1) END, 6) AS v FROM q3) SELECT image_id, y::INT AS y, x::INT AS x, CASE WHEN image_id % 3 = 1 THEN t.v ELSE round(px.v, 6) END AS v FROM px JOIN t USING (image_id, y, x)")
def preprocess_channels(spark, sf_dir):
    """Only the selected channel changes."""
    f = read_fields(spark, sf_dir).withColumn("channel", F.concat(F.lit("c"), F.col("image_id") % 3))
    return _px(P.preprocess_fields(f, P.Chain(illumination=None, denoise=None, contrast="stretch", normalize="zscore"), ["c1"]))


@query()
def preprocess_chain(spark, sf_dir):
    return _px(P.preprocess_fields(read_fields(spark, sf_dir)))


@query(f"WITH {_HIST}, g AS (SELECT i.image_id, i.lo, i.hi, b.b, coalesce(h.n, 0) AS n FROM (SELECT DISTINCT image_id, lo, hi FROM h) i CROSS JOIN range(256) b(b) LEFT JOIN h ON h.image_id = i.image_id AND h.b = b.b), k AS (SELECT image_id, min(b) FILTER (n > 0) AS b0, max(b) FILTER (n > 0) AS b1, arg_max(b, (n, -b)) AS top, max(n) AS most FROM g GROUP BY image_id), f AS (SELECT g.*, k.*  EXCLUDE (image_id), top - b0 < b1 - top AS flip FROM g JOIN k USING (image_id)), d AS (SELECT image_id, lo, hi, b, CASE WHEN flip THEN 255 - b ELSE b END AS x, CASE WHEN flip THEN 255 - b1 ELSE b0 END AS x0, CASE WHEN flip THEN 255 - top ELSE top END AS x1, n, most FROM f) SELECT image_id, round(arg_max(lo + (b + 0.5) * (hi - lo) / 256, (most * (x - x0) - (x1 - x0) * n, -x)), 6) AS threshold FROM d WHERE x >= x0 AND x < x1 GROUP BY image_id")
def threshold_triangle(spark, sf_dir):
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: [K.triangle_threshold(a)], "made", "array<double>")
    return f.select("image_id", F.round(F.get("made", F.lit(0)), 6).alias("threshold"))


@query(f"WITH {PX}, q AS (SELECT *, exp(v * 4) / (exp(v * 4) + exp(-v * 4) + 1) AS p1, exp(-v * 4) / (exp(v * 4) + exp(-v * 4) + 1) AS p0, 1 / (exp(v * 4) + exp(-v * 4) + 1) AS p2 FROM px) SELECT image_id, y::INT AS y, x::INT AS x, 1 - p0 > 0.5 AS foreground, p1 > 0.5 AND p1 >= p2 AND 1 - p0 > 0.5 AS seed FROM q")
def prob_seeds(spark, sf_dir):
    def classes(v):
        a, b = F.exp(v * 4), F.exp(-v * 4)
        return F.struct((a / (a + b + 1)).alias("p1"), (b / (a + b + 1)).alias("p0"), (1 / (a + b + 1)).alias("p2"))

    px = pixels(read_fields(spark, sf_dir).withColumn("data", F.transform("data", classes)))
    p0, p1, p2 = (F.col(f"data.p{k}") for k in range(3))
    return px.select("image_id", "y", "x", (1 - p0 > 0.5).alias("foreground"), ((p1 > 0.5) & (p1 >= p2) & (1 - p0 > 0.5)).alias("seed"))


def _softmax(a):
    import numpy as np

    e = np.exp(np.stack([-4 * a, 4 * a, 0 * a]))
    return e / e.sum(0)


@query()
def probability_instances(spark, sf_dir):
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: S.probabilities_to_instances(_softmax(a), None, S.Postprocess(least_seed=1, least_area=2)), "made", "array<int>")
    return pixels(f, "made").where("made > 0").select("image_id", "y", "x", F.col("made").alias("v"))


@query()
def distance_instances(spark, sf_dir):
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: S.probabilities_to_instances(_softmax(a), K.minmax_normalize(a), S.Postprocess(least_seed=1, least_area=2)), "made", "array<int>")
    return pixels(f, "made").where("made > 0").select("image_id", "y", "x", F.col("made").alias("v"))


@query()
def classical_instances(spark, sf_dir):
    how = S.Classical(opening=0, closing=0, least_area=2, spacing=1)
    f = S.segment_fields(read_fields(spark, sf_dir), how)
    return pixels(f, "labels").where("labels > 0").select("image_id", "y", "x", F.col("labels").alias("v"))


@query(ORACLE_SQL["semantic_target"])
def semantic_target_kernel(spark, sf_dir):
    """The same target by the kernel that also widens boundaries."""
    f = K.map_fields(_objects(spark, sf_dir), lambda a: S.semantic_target(a, 1), "made", "array<int>", ("labels",))
    return pixels(f, "made").where("made > 0").select("image_id", "y", "x", F.col("made").alias("v"))


_CODES = PX + """, code AS (SELECT *, CASE WHEN v > 0.12 THEN 2 WHEN v > 0.05 THEN 1 ELSE 0 END AS c FROM px), fg AS (SELECT * FROM code WHERE c > 0),
reach(image_id, p, q) AS (SELECT image_id, p, p FROM fg UNION SELECT r.image_id, r.p, f.p FROM reach r JOIN fg g ON g.image_id = r.image_id AND g.p = r.q
  JOIN fg f ON f.image_id = r.image_id AND f.c = g.c AND abs(f.y - g.y) <= 1 AND abs(f.x - g.x) <= 1),
root AS (SELECT image_id, p, min(q) AS root FROM reach GROUP BY image_id, p)"""


@query(f"WITH RECURSIVE {_CODES} SELECT fg.image_id, fg.y::INT AS y, fg.x::INT AS x, dense_rank() OVER (PARTITION BY fg.image_id ORDER BY fg.c, root)::INT AS v FROM fg JOIN root USING (image_id, p)")
def decode_colored(spark, sf_dir):
    import numpy as np

    f = K.map_fields(read_fields(spark, sf_dir), lambda a: K.label_colours(np.select([a > 0.12, a > 0.05], [2, 1], 0)), "made", "array<int>")
    return pixels(f, "made").where("made > 0").select("image_id", "y", "x", F.col("made").alias("v"))


@query(f"WITH {PX}, b AS (SELECT image_id // 3 AS field, image_id % 3 AS band, y, x, least(greatest(floor(v * 255), 0), 255)::INT AS q FROM px WHERE image_id // 3 < (SELECT count(*) // 3 FROM embeddings)), r AS (SELECT field, max(s) AS hi, min(s) AS lo, arg_max(band, (s, -band)) AS top FROM (SELECT field, band, var_pop(q) AS s FROM b GROUP BY ALL) GROUP BY field) SELECT b.field AS image_id, y::INT AS y, x::INT AS x, (CASE WHEN any_value(hi - lo) > 0.15 * greatest(any_value(hi), 1e-6) THEN max(q) FILTER (band = top) ELSE (max(q) FILTER (band = 0) * 4899 + max(q) FILTER (band = 1) * 9617 + max(q) FILTER (band = 2) * 1868 + 8192) // 16384 END)::INT AS v FROM b JOIN r USING (field) GROUP BY b.field, y, x")
def single_channel(spark, sf_dir):
    """Three bands to the one whose spread stands out, else to their luminance, on whole levels."""
    px = pixels(P_uint8(read_fields(spark, sf_dir))).withColumns({"field": F.floor(F.col("image_id") / 3), "band": F.col("image_id") % 3})
    bands = px.groupBy("field", "y", "x").agg(*(F.max(F.when(F.col("band") == k, F.col("data"))).alias(f"b{k}") for k in range(3))).where("b0 is not null and b1 is not null and b2 is not null")
    spread = bands.groupBy("field").agg(*(F.var_pop(f"b{k}").alias(f"s{k}") for k in range(3)))
    hi, lo = F.greatest("s0", "s1", "s2"), F.least("s0", "s1", "s2")
    own = F.when(F.col("s0") >= F.greatest("s1", "s2"), F.col("b0")).when(F.col("s1") >= F.col("s2"), F.col("b1")).otherwise(F.col("b2"))
    grey = F.expr("(b0 * 4899 + b1 * 9617 + b2 * 1868 + 8192) div 16384")
    v = F.when(hi - lo > 0.15 * F.greatest(hi, F.lit(1e-6)), own).otherwise(grey).cast("int")
    return bands.join(spread, "field").select(F.col("field").alias("image_id"), "y", "x", v.alias("v"))


def P_uint8(fields):
    return fields.withColumn("data", P.to_uint8(F.col("data")))


@query()
def evaluate_split(spark, sf_dir):
    """Per-image metrics of thresholded fields against their labelled objects."""
    t = E.evaluate_fields(_objects(spark, sf_dir), lambda a: K.label(a > 0.15))
    return t.select("image_id", *(F.round(c, 6).alias(c) for c in ("dice", "iou", "precision", "recall", "f1", "ap_mean", "count_error")))


@query()
def robustness_table(spark, sf_dir):
    t = E.evaluate_robustness(_objects(spark, sf_dir), lambda a: K.label(a > 0.15))
    return t.select("corruption", *(F.round(c, 5).alias(c) for c in ("dice", "ap_mean", "dice_drop", "ap_drop", "dice_retention")))


@query()
def unet_probabilities(spark, sf_dir):
    """Class probabilities and distance of a small network with seeded weights, the mean of eight views."""
    net = U.random_weights(1, 3, base=4, depth=2, distance=True, seed=5)
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: U.predict(net, a, True).ravel(), "made", "array<double>")
    return f.select("image_id", F.posexplode("made").alias("p", "v")).select("image_id", F.floor(F.col("p") / 64).cast("int").alias("map"), (F.col("p") % 64).cast("int").alias("p"), F.round("v", 6).alias("v"))


@query()
def validation_maps(spark, sf_dir):
    """Measures of the maps of a small network with seeded weights against labelled objects."""
    net = U.random_weights(1, 3, base=4, depth=2, distance=True, seed=5)
    f = K.map_fields(_objects(spark, sf_dir), lambda a: U.predict(net, a).ravel(), "maps", "array<double>")
    t = E.validate_maps(f, boundary=1)
    return t.select("image_id", *(F.round(c, 6).alias(c) for c in t.columns[1:]))


@query(f"WITH {COUNTS}, s AS (SELECT {_SEM_ALL} FROM c) SELECT 'fixed' AS backend, {', '.join(f'round(avg({c}), 5) AS {c}' for c in ('dice', 'iou', 'precision', 'recall'))}, count(*) AS n_images FROM s UNION ALL SELECT 'dice only', round(avg(dice), 5), NULL, NULL, NULL, count(*) FROM s")
def comparison_table(spark, sf_dir):
    t = E.semantic_metrics(_counts(spark, sf_dir)).select("image_id", "dice", "iou", "precision", "recall")
    made, _ = E.comparison({"fixed": t, "dice only": t.select("image_id", "dice")})
    return made.select("backend", *(F.round(c, 5).alias(c) for c in ("dice", "iou", "precision", "recall")), "n_images")


@query()
def training_items(spark, sf_dir):
    """Parts of 6 x 6 pixels of every labelled field with their targets."""
    t = G.training_items(_objects(spark, sf_dir), 6, how=P.Chain(hot_pixels=None, illumination=None, contrast=None), boundary=1, seed=3)
    rows = t.select("image_id", F.posexplode(F.arrays_zip("data", "labels", "target", "distance")).alias("p", "z"))
    return rows.select("image_id", "p", F.round("z.data", 6).alias("v"), "z.labels", "z.target", F.round("z.distance", 6).alias("distance"))


@query()
def augmented_fields(spark, sf_dir):
    return _px(G.augment_fields(_objects(spark, sf_dir), seed=3))


@query(f"WITH {PX}, o AS (SELECT unnest(range(-2, 10)) AS i) SELECT px.image_id, (a.i + 2)::INT AS y, (b.i + 2)::INT AS x, round(v, 6) AS v FROM o a, o b JOIN px ON px.y = CASE WHEN a.i < 0 THEN -a.i WHEN a.i > 7 THEN 14 - a.i ELSE a.i END AND px.x = CASE WHEN b.i < 0 THEN -b.i WHEN b.i > 7 THEN 14 - b.i ELSE b.i END")
def padded_fields(spark, sf_dir):
    """Fields padded by mirroring to 12 x 12."""
    f = K.map_fields(read_fields(spark, sf_dir), lambda a: G.padded(a, 12), "made", "array<double>")
    return _px(f.withColumns({"height": F.lit(12), "width": F.lit(12)}), column="made")
