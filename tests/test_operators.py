"""Kernels and operators against plain Python, and on fields of realistic size."""

import itertools
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from fieldloom.operators import augment as G
from fieldloom.operators import evaluate as E
from fieldloom.operators import kernels as K
from fieldloom.operators import measure as M
from fieldloom.operators import preprocess as P
from fieldloom.operators import quality as Q
from fieldloom.operators import segment as S
from fieldloom.operators import unet as U
from fieldloom.plans.catalog import ORACLE_SQL, QUERIES
from fieldloom.sources import sinks
from fieldloom.sources.synthetic import synthetic_field

from .harness import differences


def fields(spark, arrays, **more):
    rows = [(k, *a.shape, [float(x) for x in a.ravel()], *(([int(x) for x in v[k].ravel()]) for v in more.values())) for k, a in enumerate(arrays)]
    return spark.createDataFrame(rows, ", ".join(["image_id long, height int, width int, data array<double>", *(f"{c} array<int>" for c in more)]))


def discs(shape, centres, radius):
    y, x = np.indices(shape)
    return sum(((y - a) ** 2 + (x - b) ** 2 <= radius**2) for a, b in centres) > 0


def plain_label(mask, full):
    out, n = np.zeros(mask.shape, int), 0
    for y, x in zip(*np.nonzero(mask), strict=True):
        if out[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < mask.shape[0] and 0 <= b < mask.shape[1] and mask[a, b] and not out[a, b]:
                out[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1) if full or not (i and j)]
    return out


@pytest.mark.parametrize("full", [True, False])
def test_label(full):
    r = np.random.default_rng(1)
    for _ in range(80):
        m = r.random(r.integers(1, 14, 2)) < r.random()
        assert (K.label(m, full) == plain_label(m, full)).all()
    snake = np.zeros((40, 41), bool)
    snake[::2], snake[1::4, -1], snake[3::4, 0] = True, True, True
    assert (K.label(snake, full) == snake).all()


def test_labels_kernels():
    a = np.array([[0, 3, 3], [7, 7, 0], [0, 0, 9]])
    assert K.relabel(a).tolist() == [[0, 1, 1], [2, 2, 0], [0, 0, 3]]
    assert K.drop_small(a, 2).tolist() == [[0, 3, 3], [7, 7, 0], [0, 0, 0]]
    assert not K.drop_border(a).any()
    b = np.zeros((5, 5), int)
    b[0, 0], b[2, 2] = 1, 2
    assert K.drop_border(b)[2, 2] == 1 and K.drop_border(b).sum() == 1
    assert K.boxes(a) == {3: (0, 1, 1, 3), 7: (1, 2, 0, 2), 9: (2, 3, 2, 3)} and K.boxes(b * 0) == {}


def test_assign_is_best():
    r = np.random.default_rng(2)
    for _ in range(200):
        s = np.round(r.random(r.integers(1, 5, 2)), 2)
        got = K.assign(s)
        small, large = sorted(s.shape)
        best = max(sum(s[(k, c) if s.shape[0] <= s.shape[1] else (c, k)] for k, c in enumerate(p)) for p in itertools.permutations(range(large), small))
        assert len(got) == small and abs(sum(s[x] for x in got) - best) < 1e-12
        assert len({a for a, _ in got}) == len({b for _, b in got}) == small


def test_assignment_beats_a_filter():
    pairs = [(1, 1, 0.5), (1, 2, 1 / 3), (2, 1, 1 / 3)]
    assert [(t, p) for t, p, _ in E.assigned(pairs)] == [(1, 2), (2, 1)]
    r = np.random.default_rng(3)
    for _ in range(100):
        n, m = r.integers(1, 5, 2)
        pairs = [(t, p, float(r.random())) for t in range(n) for p in range(m) if r.random() < 0.5]
        best = max((sum(v for _, _, v in c) for k in range(len(pairs) + 1) for c in itertools.combinations(pairs, k) if len({t for t, _, _ in c}) == len({p for _, p, _ in c}) == k), default=0)
        assert abs(sum(v for *_, v in E.assigned(pairs)) - best) < 1e-9


def test_watershed_splits_touching_discs():
    mask = discs((80, 140), [(40, 52), (40, 88)], 25)
    out = K.watershed(mask)
    assert out.max() == 2 and ((out > 0) == mask).all()
    assert out[40, 40] != out[40, 100] and abs((out == 1).sum() - (out == 2).sum()) < 100
    left, right = (np.nonzero(out == out[40, x])[1] for x in (40, 100))
    assert left.max() <= 72 and right.min() >= 68  # the cut runs along the neck
    assert K.watershed(np.zeros((4, 4), bool)).max() == 0


def test_flood_takes_every_pixel_over_the_lowest_pass():
    """Every pixel belongs to a marker from which a path of the smallest possible highest point leads to it."""
    r = np.random.default_rng(4)
    for _ in range(30):
        surface = r.random((6, 6))
        markers = np.zeros((6, 6), int)
        for k, p in enumerate(r.choice(36, 3, replace=False), 1):
            markers.ravel()[p] = k
        out = K.flood(surface, markers, np.ones((6, 6), bool))
        pass_ = {}
        for k in (1, 2, 3):
            best = np.where(markers == k, surface, np.inf)
            for _ in range(36):
                for dy, dx in K.neighbours(False):
                    moved = np.full((6, 6), np.inf)
                    ys, xs = slice(max(dy, 0), 6 + min(dy, 0)), slice(max(dx, 0), 6 + min(dx, 0))
                    yt, xt = slice(max(-dy, 0), 6 + min(-dy, 0)), slice(max(-dx, 0), 6 + min(-dx, 0))
                    moved[ys, xs] = best[yt, xt]
                    best = np.minimum(best, np.maximum(moved, surface))
            pass_[k] = best
        for y, x in np.ndindex(6, 6):
            if not markers[y, x]:
                assert pass_[out[y, x]][y, x] <= min(p[y, x] for p in pass_.values()) + 1e-12


def test_probability_instances():
    inside = discs((80, 140), [(40, 52), (40, 88)], 22)
    foreground = discs((80, 140), [(40, 52), (40, 88)], 25)
    target = np.where(inside & (np.abs(np.arange(140) - 70) > 2)[None], 1, np.where(foreground, 2, 0))
    probs = np.stack([target == k for k in range(3)]) * 0.9 + 0.1 / 3
    out = S.probabilities_to_instances(probs)
    assert out.max() == 2 and ((out > 0) == foreground).all()
    two = np.stack([~foreground, foreground]).astype(float)
    assert S.probabilities_to_instances(two).max() == 2
    y, x = np.indices((80, 140))
    far = np.clip(1 - np.minimum(np.hypot(y - 40, x - 52), np.hypot(y - 40, x - 88)) / 25, 0, 1)
    assert S.probabilities_to_instances(probs, far).max() == 2 and S.probabilities_to_instances(probs, far[None]).max() == 2
    assert S.probabilities_to_instances(np.stack([np.ones((9, 9)), np.zeros((9, 9)), np.zeros((9, 9))])).max() == 0
    dim = np.stack([np.where(foreground, 0.3, 0.9), np.where(foreground, 0.3, 0.05), np.where(foreground, 0.4, 0.05)])
    assert S.probabilities_to_instances(dim).max() == 2  # no interior wins: the mask's own peaks
    for bad in (lambda: S.probabilities_to_instances(probs[0]), lambda: S.probabilities_to_instances(probs, far[:5])):
        with pytest.raises(ValueError):
            bad()


def test_thresholds_and_cleanup():
    r = np.random.default_rng(5)
    a = np.clip(discs((64, 64), [(20, 20), (44, 40)], 9) * 0.6 + 0.2 + r.normal(0, 0.02, (64, 64)), 0, 1)
    truth = a > 0.5
    for method in ("otsu", "li", "triangle", "fixed", "adaptive"):
        mask = S.threshold_mask(a, S.Classical(threshold=method))
        assert (mask == truth).mean() > (0.8 if method == "adaptive" else 0.97), method
    assert not S.threshold_mask(np.full((9, 9), 0.4)).any()
    with pytest.raises(ValueError):
        S.threshold_mask(a, S.Classical(threshold="median"))
    bridge = discs((40, 60), [(20, 15), (20, 44)], 9)
    bridge[19:21, 15:44] = True
    assert K.label(bridge).max() == 1 and K.label(S.cleanup(bridge, S.Classical(opening=2))).max() == 2
    holed = np.zeros((40, 40), bool)
    holed[5:35, 5:35], holed[10:13, 10:13] = True, False
    assert S.cleanup(holed, S.Classical(opening=0, closing=0))[11, 11] and not S.cleanup(holed, S.Classical(opening=0, closing=0, most_hole=0))[11, 11]
    assert S.classical_instances(a).max() == 2
    b, values = a.ravel(), np.unique(np.linspace(a.min(), a.max(), 257)[1:-1])
    spread = [((b <= t).mean() * (b > t).mean() * (b[b <= t].mean() - b[b > t].mean()) ** 2) for t in values]
    assert abs(K.otsu_threshold(a) - values[int(np.argmax(spread))]) < 0.05


def test_targets():
    labels = np.zeros((12, 12), int)
    labels[2:9, 2:9], labels[2:9, 9:11] = 1, 2
    t = S.semantic_target(labels, 1)
    assert t[4, 4] == 1 and t[2, 4] == 2 and t[4, 8] == 2 and t[4, 9] == 2 and t[0, 0] == 0
    wide = S.semantic_target(labels, 2)
    assert (wide[t == 2] == 2).all() and wide[3, 4] == 2 and wide[0, 0] == 0 and wide[5, 5] == 1
    d = S.distance_target(labels)
    assert d.max() == 1 and d[5, 5] == 1 and d[2, 2] == 0 and not d[labels == 2].any()


def test_chain():
    r = np.random.default_rng(6)
    bright = np.clip(discs((96, 96), [(30, 30), (60, 70)], 12) * 0.5 + 0.2 + r.normal(0, 0.01, (96, 96)), 0, 1)
    out, stages, inverted = P.preprocess_field(1 - bright)
    assert inverted and list(stages) == ["raw", "hot pixels", "inverted", "illumination", "denoised", "contrast", "normalized"]
    assert 0 <= out.min() and out.max() <= 1 and out[30, 30] > out[5, 5]
    out, stages, inverted = P.preprocess_field(bright, P.Chain(hot_pixels=None, illumination=None, denoise="none", contrast=None, normalize="none"))
    assert (out == bright).all() and not inverted and list(stages) == ["raw", "normalized"]
    for how in ({"denoise": "x"}, {"contrast": "x"}, {"illumination": "x"}, {"normalize": "x"}):
        with pytest.raises(ValueError):
            P.preprocess_field(bright, P.Chain(**how))
    for method in P.DENOISE:
        small = bright[:32, :32]
        assert abs(P.denoise(small, method) - small).mean() < 0.05, method
    for method in ("none", "clahe", "gamma", "stretch", "unsharp"):
        assert P.enhance_contrast(bright, method).shape == bright.shape


def test_backgrounds():
    y, x = np.indices((128, 128)) / 127
    slope = 0.2 + 0.3 * x + 0.1 * y
    a = np.clip(slope + 0.3 * discs((128, 128), [(40, 40), (90, 80)], 8), 0, 1)
    near = K.opening(a, K.disc(30))
    assert abs(K.morphological_background(a, 30) - near).mean() < 0.05 and (K.morphological_background(a, 5) == K.opening(a, K.disc(5))).all()
    for method in P.BACKGROUND:
        assert abs(P.estimate_background(a, method, 24) - slope).mean() < 0.06, method
    flat = K.flatten(a, K.morphological_background(a, 30))
    assert flat[:, :5].mean() > a[:, :5].mean() and abs(flat[:, :5].mean() - flat[:, -5:].mean()) < 0.1


def test_statistics_of_large_fields_are_fast(spark):
    r = np.random.default_rng(7)
    a = r.random((256, 256))
    f = fields(spark, [a], labels=[K.label(a > 0.9)])
    f.count()
    steps = {
        "percentile": (P.percentile_normalize(F.col("data")), K.percentile_normalize(a)), "zscore": (P.zscore_normalize(F.col("data")), K.zscore_normalize(a)),
        "stretch": (P.percentile_normalize(F.col("data"), 2, 98), K.percentile_normalize(a, 2, 98)), "minmax": (P.minmax_normalize(F.col("data")), K.minmax_normalize(a)),
        "flatten": (P.flatten(F.col("data"), F.col("data")), K.flatten(a, a)), "invert": (P.auto_invert(F.col("data")), a if K.has_dark_background(a) else 1 - a),
    }
    for name, (column, want) in steps.items():
        began = time.time()
        got = np.array(f.select(column.alias("v")).first().v).reshape(a.shape)
        assert time.time() - began < 20, name
        assert abs(got - want).max() < 1e-9, name
    got = np.array(P.remove_hot_pixels(f, 2.0).first().data).reshape(a.shape)
    assert abs(got - K.remove_hot_pixels(a, 2.0)).max() < 1e-9
    began = time.time()
    kept = M.drop_border(M.relabel(M.drop_small(f, 3))).select("labels").first().labels
    assert time.time() - began < 10 and len(set(kept)) > 2


def test_shapes(spark):
    y, x = np.indices((40, 60))
    labels = np.zeros((40, 60), int)
    labels[5:15, 5:25] = 1
    labels[8:11, 10:13] = 0
    labels[(((y - 30) - (x - 40) * 0.5) ** 2 <= 9) & (y >= 20)] = 2
    t = {r.label: r for r in M.feature_table(fields(spark, [labels * 0.5], labels=[labels]), pixel_size_um=0.5).collect()}
    one = t[1]
    assert (one.area_px, one.filled_area_px, one.hole_area_px, one.area_um2, one.convex_area_px) == (191, 200, 9, 47.75, 200)
    assert abs(one.orientation_deg) > 89 and one.aspect_ratio > 1.8 and not one.touches_border and t[2].touches_border
    assert abs(np.tan(t[2].orientation) - 2) < 0.8 and one.perimeter_px > 2 * (9 + 19)
    assert (one.mean_intensity, one.std_intensity, one.glcm_contrast) == (0.5, 0, 0)


def test_plain_perimeter():
    square = np.zeros((12, 12), int)
    square[2:9, 2:9] = 1
    assert K.border_perimeters(square)[0] == 24  # along the middles of its border pixels


def test_quality(spark):
    images = spark.createDataFrame([(1, 64, 0, 0), (2, 64, 40, 2)], "image_id long, n_pixels int, n_foreground int, n_labels int")
    objects = spark.createDataFrame([(2, 20.0, 0.5, False, 0.8), (2, 20.0, 0.55, True, 0.9)], "image_id long, area_px double, circularity double, touches_border boolean, solidity double")
    got = {r.image_id: r for r in Q.report(Q.assess(Q.signals(images, objects))).collect()}
    assert (got[1].qc_confidence, got[1].qc_passed, got[1].qc_flags, got[1].qc_n_flags) == (0, False, "no objects detected", 1)
    assert "implausible foreground coverage (62% of the image)" in got[2].qc_flags and "low median solidity (0.85); objects may be merged nuclei" in got[2].qc_flags
    assert got[2].qc_median_solidity == 0.85 and got[2].qc_penalty_area_cv is None and got[2].qc_n_flags == 4


#: Areas of objects and what they vary by, exactly: the limit of the flag, and half-way cases of its text.
VARIED = (((1, 1, 1, 1, 12), 1.375), ((1, 1, 2, 4, 14, 17), 1.0))


def test_area_variation_in_any_order(spark):
    cases = [(list(order), cv) for areas, cv in VARIED for order in sorted(set(itertools.permutations(areas)))]
    images = spark.createDataFrame([(k, 64, 20, 5) for k in range(len(cases))], "image_id long, n_pixels int, n_foreground int, n_labels int")
    rows = [(k, float(a), 1.0, False, 1.0) for k, (areas, _) in enumerate(cases) for a in areas]
    objects = spark.createDataFrame(rows, "image_id long, area_px double, circularity double, touches_border boolean, solidity double").repartition(3)
    got = {r.image_id: r for r in Q.assess(Q.signals(images, objects)).collect()}
    for k, (_, cv) in enumerate(cases):
        assert got[k].area_cv == cv and ("(CV 1.38)" in got[k].flags) == ("CV" in got[k].flags) == (cv > 1)


def test_flags_round_as_sql(spark):
    solidity = [0.545, 0.575, 0.5 * 0.6 + 0.5 * 0.75, 0.5 * 0.84 + 0.5 * 0.85, 0.875, 0.865]
    t = spark.createDataFrame([(k, 3.0, s) for k, s in enumerate(solidity)], "image_id long, n_objects double, median_solidity double")
    got = [r.flags for r in Q.assess(t).orderBy("image_id").collect()]
    want = [duckdb.execute("SELECT printf('%.2f', round_even(?::DOUBLE, 2))", [s]).fetchone()[0] for s in solidity]
    assert got == [f"low median solidity ({w}); objects may be merged nuclei" for w in want]


def test_report_rounds_as_sql(spark):
    solidity = [0.303125, 0.611875, 0.5 * 0.46875 + 0.5 * 0.86, 0.5 * 0.65625 + 0.5 * 0.84, 0.859375, 0.65]
    t = spark.createDataFrame([(k, 3.0, s) for k, s in enumerate(solidity)], "image_id long, n_objects double, median_solidity double")
    got = [r.qc_median_solidity for r in Q.report(Q.assess(t)).orderBy("image_id").collect()]
    assert got == [duckdb.execute("SELECT round(?::DOUBLE, 5)", [s]).fetchone()[0] for s in solidity]


def varied_fields(folder):
    """A table of 8 x 8 vectors: one block and four single pixels above the threshold, the block at several places."""
    rows = []
    for (h, w), (r, c), _ in itertools.product(((3, 4), (3, 2)), ((0, 0), (0, 4), (3, 0), (5, 0), (5, 4), (2, 2)), range(8)):
        a = np.full((8, 8), -0.5)
        a[r : r + h, c : c + w] = 0.5
        free = [(y, x) for y in range(0, 8, 2) for x in range(0, 8, 2) if not (a[max(y - 1, 0) : y + 2, max(x - 1, 0) : x + 2] > 0).any()]
        for y, x in free[:: max(len(free) // 4, 1)][:4]:
            a[y, x] = 0.4
        rows.append((len(rows), a.ravel().tolist()))
    table = pa.table({"vec_id": pa.array([k for k, _ in rows], pa.int64()), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))})
    pq.write_table(table, f"{folder}/embeddings.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{folder}/embeddings.parquet')")
    return db


@pytest.mark.parametrize("name", ["qc_assess", "qc_report", "qc_verdict"])
def test_assessment_of_varied_fields(spark, tmp_path, name):
    db = varied_fields(tmp_path)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # one field's objects in several tasks, as in large tables
    try:
        assert not differences(QUERIES[name](spark, str(tmp_path)), db, ORACLE_SQL[name])
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_convolution_network():
    r = np.random.default_rng(8)
    x, w = r.random((2, 5, 6)), r.random((3, 2, 3, 3))
    want = np.zeros((3, 5, 6))
    for o, i, y, z, dy, dx in itertools.product(range(3), range(2), range(5), range(6), range(3), range(3)):
        if 0 <= y + dy - 1 < 5 and 0 <= z + dx - 1 < 6:
            want[o, y, z] += w[o, i, dy, dx] * x[i, y + dy - 1, z + dx - 1]
    assert np.allclose(U.convolve(x, w), want)
    g = r.random((2, 3, 2, 2))
    grown = U._grown(x, g, np.zeros(3))
    assert grown.shape == (3, 10, 12) and np.isclose(grown[1, 5, 8], sum(x[c, 2, 4] * g[c, 1, 1, 0] for c in range(2)))
    net = U.random_weights(1, 3, base=4, depth=2, distance=True)
    a = r.random((13, 18))
    out = U.predict(net, a, views=True)
    assert out.shape == (4, 13, 18) and np.allclose(out[:3].sum(0), 1) and (0 < out[3]).all() and (out[3] < 1).all()
    square = r.random((16, 16))
    assert np.allclose(U.predict(net, np.rot90(square), True), np.rot90(U.predict(net, square, True), axes=(1, 2)))
    assert not np.allclose(U.predict(net, square), U.predict(net, square, True))


def test_augmentation(spark):
    a = np.random.default_rng(9).random((32, 32))
    labels = K.label(a > 0.8)
    for seed in range(12):
        x, y = G.augmented(a, labels, np.random.default_rng(seed))
        assert x.shape == y.shape == (32, 32) and 0 <= x.min() and x.max() <= 1 and set(np.unique(y)) <= set(np.unique(labels))
    x, y = G.turned(a, labels, np.random.default_rng(0))
    assert sorted(x.ravel()) == sorted(a.ravel()) and (K.label(x > 0.8) > 0).sum() == (y > 0).sum()
    places = np.indices((32, 32)).astype(float)
    assert np.allclose(G.sampled(a, *places), a) and (G.sampled(labels, *places, nearest=True) == labels).all()
    assert G.sampled(a, np.array([[-1.0]]), np.array([[33.0]]))[0, 0] == a[1, 29]
    assert G.cropped(a, 40).shape == (40, 40) and (G.cropped(a, 8) == a[12:20, 12:20]).all() and G.padded(labels, 34, True)[0, 0] == 0
    f = G.augment_fields(fields(spark, [a, a], labels=[labels, labels]), seed=1)
    one, two = f.orderBy("image_id").collect()
    again = G.augment_fields(fields(spark, [a, a], labels=[labels, labels]), seed=1).orderBy("image_id").first()
    assert one.data == again.data and one.data != two.data and f.columns == ["image_id", "height", "width", "data", "labels"]


def test_evaluation_and_sinks(spark, tmp_path):
    made = [synthetic_field(96, 6, (7.0, 10.0), seed=k) for k in range(3)]
    images, truth = [m[0] for m in made], [m[1] for m in made]
    f = fields(spark, images, labels=truth)
    cache = str(tmp_path / "cache")
    assert sinks.write_cache(f, cache, limit=2) == 2 and sinks.write_cache(f, cache) == 1 and sinks.write_cache(f, cache) == 0
    assert sinks.load_cached(spark, cache, [1]).count() == 1 and sinks.load_cached(spark, cache).count() == 3
    table = E.evaluate_fields(sinks.load_cached(spark, cache), lambda a: S.classical_instances(K.percentile_normalize(a)))
    assert table.count() == 3 and E.summary(table).first().dice > 0.7
    drops = {r.corruption: r for r in E.evaluate_robustness(f, lambda a: S.classical_instances(a, S.Classical(threshold="fixed", fixed=0.3)), ("heavy_noise", "low_exposure")).collect()}
    assert drops["none"].dice_drop == 0 and drops["none"].dice_retention == 1 and drops["low_exposure"].dice_drop > 0
    from fieldloom import evaluate, predict

    predict.main([cache, str(tmp_path / "found")], spark)
    assert spark.read.option("header", True).csv(str(tmp_path / "found/images")).count() == 3
    assert "qc_confidence" in spark.read.option("header", True).csv(str(tmp_path / "found/quality")).columns
    evaluate.main([cache, str(tmp_path / "scores")], spark)
    assert spark.read.json(str(tmp_path / "scores/summary")).first().n_images == 3
    for k in ("a", "b"):
        (tmp_path / "set" / k / "images").mkdir(parents=True)
        (tmp_path / "set" / k / "images" / "x.png").write_bytes(b"x")
    (tmp_path / "set" / "c").mkdir()
    (tmp_path / "set" / "c" / "y.png").write_bytes(b"x")
    assert [r.image_id for r in sinks.list_samples(spark, str(tmp_path / "set")).collect()] == ["a", "b"]
    with pytest.raises(Exception):
        sinks.list_samples(spark, str(tmp_path / "none")).count()
    stale = spark.createDataFrame([("train", 1), ("train", 9), ("val", 8)], "split string, image_id long")
    assert [r.image_id for r in E.unknown_training_ids(stale, f).collect()] == [9]


def test_paired_statistics(spark):
    d = spark.createDataFrame([(float(x),) for x in (1, 2, -3, 4, 5, 6, -7, 8, 9, 10)], "d double")
    r = E.paired_report(d)
    assert (r["n"], r["mean"], r["wins"], r["crosses_zero"]) == (10, 3.5, 8, False) and r["low"] < 3.5 < r["high"]
    with pytest.raises(ValueError):
        E.paired_report(d.where("false"))
    w = E.wilcoxon_p(E.wilcoxon(d)).first()
    import math

    assert w.w == 10 and abs(w.p - math.erfc(abs(w.z) / math.sqrt(2))) < 2e-7


def test_flat_fields_have_no_threshold(spark, tmp_path):
    from fieldloom.plans import catalog

    rows = spark.createDataFrame([(k, [0.25] * 64 if k else [float(i % 7) for i in range(64)], 0) for k in range(3)], "vec_id long, embedding array<float>, label int")
    rows.write.parquet(str(tmp_path / "embeddings.parquet"))
    for name in ("threshold_otsu", "threshold_triangle", "feature_histogram", "percentile_normalize", "zscore_normalize", "preprocess_pointwise"):
        if name != "threshold_triangle":
            assert catalog.QUERIES[name](spark, str(tmp_path)).count() > 0
    assert {r.image_id for r in catalog.QUERIES["threshold_otsu"](spark, str(tmp_path)).collect()} == {0}


def test_field_precision_is_that_of_instance_metrics(spark):
    rng = np.random.default_rng(8)
    truth = [K.label(rng.random((24, 24)) > 0.7) for _ in range(3)] + [np.zeros((24, 24), int), np.zeros((24, 24), int)]
    pred = [K.label(rng.random((24, 24)) > 0.7), K.label(truth[1] > 1), truth[2], np.zeros((24, 24), int), truth[0]]
    f = fields(spark, truth, labels=truth, pred=pred)
    images = f.select("image_id", F.array_max("labels").alias("n_true"), F.array_max("pred").alias("n_pred"))
    px = f.select("image_id", F.explode(F.arrays_zip("labels", "pred")).alias("z")).select("image_id", F.col("z.labels").alias("t"), F.col("z.pred").alias("p"))
    want = {r.image_id: r.ap_mean for r in E.instance_metrics(E.match_instances(images, E.iou_pairs(px))).collect()}
    got = [E.field_precision(t, p) for t, p in zip(truth, pred, strict=True)]
    assert np.allclose(got, [want[k] for k in range(5)]) and got[2] == 1 and got[3] == 1 and got[4] == 0


def test_validation_of_maps(spark):
    labels = K.label(discs((40, 40), [(10, 10), (28, 27)], 7))
    target = S.semantic_target(labels, 2)
    good = np.concatenate([np.stack([target == k for k in range(3)]).astype(float), S.distance_target(labels)[None]])
    bad = np.stack([np.ones(labels.shape), np.zeros(labels.shape), np.zeros(labels.shape)])
    rows = [(k, 40, 40, labels.ravel().tolist(), m.ravel().tolist()) for k, m in enumerate((good, bad))]
    f = spark.createDataFrame(rows, "image_id long, height int, width int, labels array<int>, maps array<double>")
    a, b = E.validate_maps(f).orderBy("image_id").collect()
    assert (a.dice, a.dice_background, a.dice_interior, a.dice_boundary, a.distance_mae, a.ap_mean) == (1, 1, 1, 1, 0, 1)
    assert b.dice == b.dice_interior == b.ap_mean == 0 and 0 < b.dice_background < 1 and b.distance_mae is None
    assert E.validate_maps(f.limit(0)).count() == 0


def test_comparison_of_runs(spark):
    a = spark.createDataFrame([(1, 0.5, 3.0, 0.25), (2, 1.0, 5.0, 0.75)], "image_id long, ap_mean double, extra double, dice double")
    table, skipped = E.comparison({"x": a, "y": a.select("image_id", "dice")}, {"x": "not skipped", "z": "no weights"})
    assert table.columns[:3] == ["backend", "dice", "ap_mean"] and skipped == {"z": "no weights"}
    rows = {r.backend: r for r in table.collect()}
    assert rows["x"].dice == 0.5 and rows["x"].extra == 4 and rows["y"].ap_mean is None and rows["y"].n_images == 2
    with pytest.raises(ValueError):
        E.comparison({})


def test_training_items(spark):
    image, labels = synthetic_field(n_objects=6, seed=4)
    f = fields(spark, [image, image], labels=[labels, labels])
    plain = P.preprocess_field(image.astype(float))[0]
    rows = G.training_items(f, 48, train=False).orderBy("image_id").collect()
    for r in rows:
        want = G.cropped(labels, 48, zeros=True)
        assert np.allclose(np.reshape(r.data, (48, 48)), G.cropped(plain, 48)) and np.array_equal(np.reshape(r.labels, (48, 48)), want)
        assert np.array_equal(np.reshape(r.target, (48, 48)), S.semantic_target(want, 2)) and np.allclose(np.reshape(r.distance, (48, 48)), S.distance_target(want))
    first, again = (G.training_items(f, 48, seed=1).orderBy("image_id").collect() for _ in range(2))
    assert first == again and first[0].data != first[1].data and all(len(r.data) == len(r.labels) == 48 * 48 for r in first)
