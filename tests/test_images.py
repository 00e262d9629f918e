import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.functions import stencil
from lumiray.operators import images as I
from lumiray.plans import flows


def frame(spark, images):
    return spark.createDataFrame([(k, [int(v) for v in im.reshape(-1)]) for k, im in enumerate(images)], "id int, image array<int>")


def cleaned(spark, images, **kw):
    out = I.clean_images(frame(spark, images), **kw).orderBy("id").collect()
    side = images[0].shape[0]
    return [np.array(r.image).reshape(side, side) for r in out]


def brute_aperture(image, nsb):
    """The signal test sub-pixel by sub-pixel."""
    side, n = image.shape[0], K.SUBPIXELS
    fine = np.kron(image, np.ones((n, n)))
    keep = np.zeros(image.shape, bool)
    for u in range(side * n):
        for v in range(side * n):
            total = weight = 0.0
            for du in range(-2, 3):
                for dv in range(-2, 3):
                    if 0 <= u + du < side * n and 0 <= v + dv < side * n:
                        w = K.APERTURE_OVERLAP[abs(du), abs(dv)] / n**2
                        total += w * fine[u + du, v + dv]
                        weight += w
            if total > 7 * np.sqrt(weight * (100 + nsb)):
                keep[u // n, v // n] = True
    return np.where(keep, image, 0)


@pytest.mark.parametrize("spot", [(16, 16), (0, 7), (31, 31)])
def test_lone_pixel_threshold(spark, spot):
    images = []
    for adu in (99, 100):
        im = np.zeros((32, 32), int)
        im[spot] = adu
        images.append(im)
    below, above = cleaned(spark, images, isolated=False, min_pixels=0)
    assert below.sum() == 0 and above.sum() == 100


def test_aperture_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    images = [rng.integers(-60, 140, (12, 12)) for _ in range(6)] + [rng.integers(0, 2, (12, 12)) * 95]
    got = cleaned(spark, images, isolated=False, min_pixels=0)
    for im, out in zip(images, got):
        assert (np.maximum(brute_aperture(im, K.NSB_DATA_ADU), 0) == out).all()


def test_only_diagonal_neighbours_count(spark):
    edge, corner = np.zeros((8, 8), int), np.zeros((8, 8), int)
    edge[3, 3] = edge[3, 4] = 500
    corner[3, 3] = corner[4, 4] = 500
    out = cleaned(spark, [edge, corner], min_pixels=0)
    assert out[0].sum() == 0 and out[1].sum() == 1000


def test_minimum_pixels(spark):
    two, three = np.zeros((8, 8), int), np.zeros((8, 8), int)
    two[3, 3] = two[4, 4] = 500
    three[3, 3] = three[4, 4] = three[5, 5] = 500
    out = cleaned(spark, [two, three])
    assert out[0].sum() == 0 and out[1].sum() == 1500


def test_two_level_keeps_border_pixels(spark):
    im = np.zeros((8, 8), int)
    im[2, 2], im[3, 3], im[4, 4], im[6, 1] = 300, 120, 50, 120
    (out,) = cleaned(spark, [im], mode="two_level", image_level=200, border_level=100, isolated=False, min_pixels=0)
    assert out[2, 2] == 300 and out[3, 3] == 120 and out[4, 4] == 0 and out[6, 1] == 0


def test_null_image_passes_through(spark):
    df = spark.createDataFrame([(0, None), (1, [500] * 16)], "id int, image array<int>")
    out = {r.id: r.image for r in I.clean_images(df).collect()}
    assert out[0] is None and sum(out[1]) == 8000


def test_pedestals_cut_toward_zero(spark):
    events = spark.createDataFrame(
        [("a", 1, [10, 10, 3, 5]), ("a", 0, [9, 9, 9, 9])], "file string, scope_id int, pix array<smallint>"
    )
    peds = spark.createDataFrame([("a", 1, [9.5, 10.5, 5.9, 5.0], [0.0] * 4)], "file string, scope_id int, peds array<double>, pedvars array<double>")
    out = {r.scope_id: r.image for r in I.subtract_pedestals(events, peds).collect()}
    assert out[1] == [0, 0, -2, 0] and out[0] == [0, 0, 0, 0]
    shuffled = I.subtract_pedestals(events, peds, max_bytes=0)
    assert {r.scope_id: r.image for r in shuffled.collect()} == out


def test_images_and_pixels_are_inverse(spark):
    cells = [(1, 1, 3, 4, 70), (1, 1, 31, 31, 5), (1, 2, 0, 0, -9)]
    df = spark.createDataFrame(cells, "event bigint, telescope int, px int, py int, adu int")
    back = I.pixels_from_images(I.images_from_pixels(df)).collect()
    assert sorted(tuple(r) for r in back) == sorted(cells)


def test_photon_on_axis_lands_in_the_centre(spark):
    az, ze = 40.0, 20.0
    turned = np.pi - (np.radians(az) - np.pi) + np.radians(K.MAGNETIC_DECLINATION_DEG)
    ux, uy = np.sin(np.radians(ze)) * np.sin(turned), np.sin(np.radians(ze)) * np.cos(turned)
    photons = spark.createDataFrame([(1, 1, float(uy), float(-ux))], "event bigint, telescope int, cx double, cy double")
    truth = spark.createDataFrame([(1, az, ze)], "event bigint, az double, ze double")
    r = I.project_photons(photons, truth).first()
    assert abs(r.x) < 1e-9 and abs(r.y) < 1e-9


def test_binning_drops_photons_off_camera(spark):
    df = spark.createDataFrame(
        [(1, 1, -4.95, -4.95), (1, 1, 4.95, 0.0), (1, 1, 0.01, 0.01), (1, 1, 0.02, 0.02)],
        "event bigint, telescope int, x double, y double",
    )
    out = sorted(tuple(r)[2:] for r in I.bin_photons(df).collect())
    assert out == [(0, 0, 16), (16, 16, 32)]


def test_trigger_needs_one_bright_pixel(spark):
    df = spark.createDataFrame(
        [(1, 1, 0, 0, 103), (1, 1, 5, 5, 50), (2, 1, 0, 0, 104), (2, 1, 9, 9, 16)],
        "event bigint, telescope int, px int, py int, adu int",
    )
    assert {r.event for r in I.triggered_pixels(df).collect()} == {2}
    images = I.trigger_images(I.images_from_pixels(df)).withColumn("lit", I.is_lit(F.col("image")))
    assert {(r.event, r.lit) for r in images.collect()} == {(1, False), (2, True)}


def test_aperture_weights_total():
    weights = stencil.aperture_weights()
    full = sum(K.APERTURE_OVERLAP[abs(a), abs(b)] for a in range(-2, 3) for b in range(-2, 3)) / 25
    assert np.allclose(weights.sum(axis=1), full)


def test_pedestals_by_whole_images(spark):
    """No function is called for each pixel; missing lists and values, lists of two lengths, telescopes without a map."""
    rows = [("a", 1, [15, 9, -3]), ("a", 0, [15, 9, -3]), ("a", None, [1]), ("b", 2, [4, 4, 4]), ("b", -1, None), ("c", 3, [7, None, 9]), ("c", 4, [5, 6]), ("c", 5, None), ("c", 3, [])]
    events = spark.createDataFrame(rows, "file string, scope_id int, pix array<smallint>")
    peds = spark.createDataFrame([("a", 1, [10.5, 10.5, -1.5]), ("c", 3, [1.5, 2.0, 9.9]), ("c", 4, [0.5]), ("c", 5, [1.0])], "file string, scope_id int, peds array<double>")
    want = [[4, -1, -1], [0, 0, 0], [0], None, None, [5, None, 0], [4, None], None, [None, None, None]]
    for parts in (1, len(rows)):
        images = I.subtract_pedestals(events.repartition(parts, "pix"), peds)
        key = lambda r: str((r[0], r[1], r[2]))
        got = {key(r): r.image for r in images.select("file", "scope_id", "pix", "image").collect()}
        assert got == {key(r): w for r, w in zip(rows, want, strict=True)}
    plan = images._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "ArrowEvalPython" in plan


def test_trigger_and_lit_cells_by_batches(spark):
    """Missing images and pixels, images of several lengths, the level itself, negative pixels."""
    rows = [(1, [103, 5, 0, -7]), (2, [104, None, 0, -7]), (3, None), (4, []), (5, [None, None]), (6, [0, 200]), (7, [None, 3]), (8, [0, 0, 0])]
    df = spark.createDataFrame(rows, "event int, image array<int>")
    for parts in (1, len(rows)):
        got = {r.event: r.image for r in I.trigger_images(df.repartition(parts, "event"), 104).collect()}
        assert got == {1: [0] * 4, 2: [104, None, 0, -7], 3: None, 4: [], 5: [0, 0], 6: [0, 200], 7: [0, 0], 8: [0] * 3}
        cells = I.pixels_from_images(df.repartition(parts, "event"), ("event",), side=2)
        assert cells.dtypes == [("event", "int"), ("px", "int"), ("py", "int"), ("adu", "int")]
        want = [(k, c // 2, c % 2, v) for k, image in rows for c, v in enumerate(image or []) if v]
        assert sorted(map(tuple, cells.collect())) == sorted(want)
    halves = spark.createDataFrame([(1, [0.0, 0.5, None])], "event int, image array<double>")
    assert [tuple(r) for r in I.pixels_from_images(halves, ("event",), side=2).collect()] == [(1, 0, 1, 0.5)]
    assert I.trigger_images(halves, 0.5).first().image == [0.0, 0.5, None]


def test_cleaning_skips_only_images_that_end_empty():
    rng = np.random.default_rng(5)
    images = np.where(rng.random((200, 8, 8)) < rng.random((200, 1, 1)) / 4, rng.integers(-40, 300, (200, 8, 8)), 0).astype(np.int32)
    column = pa.ListArray.from_arrays(pa.array(np.arange(201, dtype=np.int32) * 64), pa.array(images.reshape(-1)))
    for options in ({"mode": "aperture"}, {"mode": "two_level", "image_level": 100, "border_level": 30}, {"mode": "flat", "image_level": 60, "isolated": False}, {"mode": "none"}):
        plain = stencil.cleaner(1.0, min_pixels=0, **options).func(column).to_pylist()
        want = [p if np.count_nonzero(p) >= 3 else [0] * 64 for p in plain]
        assert any(map(any, want)) and stencil.cleaner(1.0, min_pixels=3, **options).func(column).to_pylist() == want


def test_simulated_images_are_made_once_in_one_step(spark):
    """Spark must neither make them a second time to ask their size nor hand whole images from step to step."""
    photons = spark.createDataFrame([(1, 1, 0.0, 0.0, 9)], "event bigint, telescope int, cx double, cy double, photons bigint")
    truth = spark.createDataFrame([(1, 40.0, 20.0)], "event bigint, az double, ze double")
    cells = I.pixels_from_images(flows.sim_images(photons, truth, F.col("photons") * K.ADU_PER_PHOTON))
    plan = cells._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "posexplode" not in plan
