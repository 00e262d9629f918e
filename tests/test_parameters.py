import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.operators import images as I
from lumiray.operators import parameters as P
from lumiray.operators import pointing

DDL = "event bigint, telescope int, px int, py int, adu int"
SPOT = [(20, 12, 200), (21, 13, 300), (22, 14, 250), (21, 14, 150), (22, 13, 120)]
EXPECTED = dict(
    MeanX=1.753125, StdX=0.225450, MeanY=-0.712776, StdY=0.229395, Phi=45.657101, Size=1020, Length=0.301386,
    Width=0.112322, Miss=1.751977, Distance=1.892484, Azwidth=0.282224, Alpha=67.782501,
)


def pixels(spark, spots):
    return spark.createDataFrame([(e, 1, *p) for e, ps in enumerate(spots) for p in ps], DDL)


def test_known_image(spark):
    row = P.image_parameters(P.raw_moments(pixels(spark, [SPOT]))).first().asDict()
    for k, v in EXPECTED.items():
        assert row[k] == pytest.approx(v, abs=2e-6), k


def test_array_path_equals_pixel_path(spark):
    df = pixels(spark, [SPOT, [(0, 0, 5)], [(3, 9, 70), (30, 1, 20), (12, 12, 41)]])
    a = P.image_parameters(P.raw_moments(df)).orderBy("Event").collect()
    b = P.image_parameters(P.raw_moments_from_images(I.images_from_pixels(df))).orderBy("Event").collect()
    assert a == b


def test_empty_image(spark):
    df = spark.createDataFrame([(1, 1, [0] * 1024)], "event bigint, telescope int, image array<int>")
    r = P.image_parameters(P.raw_moments_from_images(df)).first()
    for c in ("Size", "MeanX", "MeanY", "StdX", "StdY", "Length", "Width", "Distance"):
        assert r[c] == 0
    for c in ("Phi", "Miss", "Azwidth", "Alpha"):
        assert r[c] is None


def test_against_direct_formulas(spark):
    rng = np.random.default_rng(3)
    spots = [[(int(a), int(b), int(w)) for a, b, w in zip(*rng.integers(0, 32, (2, 20)), rng.integers(1, 500, 20))] for _ in range(30)]
    got = P.image_parameters(P.raw_moments(pixels(spark, spots)), digits=None).orderBy("Event").collect()
    for ps, r in zip(spots, got):
        i, j, w = np.array(ps, float).T
        x, y = (K.CAMERA_MIN_DEG + (v + 0.5) * K.PIXEL_DEG for v in (i, j))
        mx, my = np.average(x, weights=w), np.average(y, weights=w)
        cov = np.cov(np.stack([x, y]), aweights=w, ddof=0)
        big = np.linalg.eigvalsh(cov)
        axis = np.array([np.cos(np.radians(r.Phi)), np.sin(np.radians(r.Phi))])
        assert r.Length == pytest.approx(np.sqrt(big[1])) and r.Width == pytest.approx(np.sqrt(big[0]))
        assert np.allclose(cov @ axis, big[1] * axis)
        assert r.Miss == pytest.approx(abs(-axis[1] * mx + axis[0] * my))
        assert r.Distance == pytest.approx(np.hypot(mx, my))
        assert r.Alpha == pytest.approx(np.degrees(np.arcsin(r.Miss / r.Distance)))


def test_rotation_keeps_shape_and_shift_moves_centroid(spark):
    raw = P.raw_moments(pixels(spark, [SPOT]))
    turned = raw.withColumns({"rot": F.radians(F.lit(37.0)), "dx": F.lit(2), "dy": F.lit(-1)})
    a = P.image_parameters(raw, None).first()
    b = P.image_parameters(turned, None).first()
    for c in ("Length", "Width", "Size"):
        assert a[c] == pytest.approx(b[c])
    co, si = np.cos(np.radians(37)), np.sin(np.radians(37))
    assert b.MeanX == pytest.approx(a.MeanX * co - a.MeanY * si - 2 * K.PIXEL_DEG)
    assert b.MeanY == pytest.approx(a.MeanX * si + a.MeanY * co + K.PIXEL_DEG)


def test_correction_lookup_edges(spark):
    times = [92327, 110000, 113559, 113600]
    images = spark.createDataFrame([("1030", 2, t, 1730286555.0) for t in times], "night string, telescope int, file_time int, pcap_time double")
    out = pointing.attach_corrections(images, pointing.correction_table(spark)).orderBy("file_time").collect()
    assert [r.t_initial for r in out] == [1730275403.0, 1730286555.0, 1730286555.0, 1730288167.0]
    assert [r.rotation_deg for r in out] == [90.0, 180.0, 180.0, 180.0]


def test_drift_is_cut_to_whole_pixels(spark):
    df = spark.createDataFrame(
        [(100.0, 0.0, -1.9, 0.0, 0.019, -0.029, 0.0)],
        "pcap_time double, t_initial double, x_initial double, y_initial double, vx double, vy double, rotation_deg double",
    )
    r = pointing.with_offsets(df).first()
    assert (r.dx, r.dy) == (0, -2)


def test_file_time(spark):
    # six characters starting 28 from the end
    name = "runA_" + "113559" + "x" * 22
    df = spark.createDataFrame([(name,)], "n string")
    assert df.select(pointing.file_time(F.col("n")).alias("t")).first().t == 113559
