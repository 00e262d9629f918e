import itertools

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.functions import angles
from lumiray.operators import stereo

DDL = "Event bigint, Telescope int, Size double, MeanX double, MeanY double, Phi double, Length double, Width double"


def by_slopes(images):
    """Weighted mean crossing with slopes, the textbook way."""
    sx = sy = sw = 0.0
    for (s1, x1, y1, p1, l1, w1), (s2, x2, y2, p2, l2, w2) in itertools.combinations(images, 2):
        m1, m2 = np.tan(np.radians(p1)), np.tan(np.radians(p2))
        w = (1 / (1 / s1 + 1 / s2) * (1 - w1 / l1) * (1 - w2 / l2) * abs(np.sin(np.arctan(m2) - np.arctan(m1)))) ** 2
        xs = ((y2 - m2 * x2) - (y1 - m1 * x1)) / (m1 - m2)
        sx, sy, sw = sx + w * xs, sy + w * (m1 * (xs - x1) + y1), sw + w
    return sx / sw, sy / sw


def test_known_direction(spark):
    images = [(800, 1, 0.5, 30, 0.4, 0.15), (600, -0.5, 1.2, 100, 0.5, 0.2), (900, 0.2, -1, 170, 0.45, 0.1)]
    df = spark.createDataFrame([(1, t, *map(float, im)) for t, im in enumerate(images, 1)], DDL)
    r = stereo.directions(df).first()
    assert r.Xoffset == pytest.approx(-0.478735, abs=1e-6) and r.Yoffset == pytest.approx(-0.701309, abs=1e-6)


def test_random_events_against_slopes(spark):
    rng = np.random.default_rng(11)
    events, want = [], {}
    for e in range(200):
        tels = sorted(rng.choice([1, 2, 3], rng.integers(1, 4), replace=False))
        images = [(rng.uniform(50, 900), *rng.normal(0, 2, 2), rng.uniform(0, 360), 0.5, rng.uniform(0.05, 0.4)) for _ in tels]
        events += [(e, int(t), *map(float, im)) for t, im in zip(tels, images)]
        if len(tels) > 1:
            want[e] = by_slopes(images)
    got = {r.Event: (r.Xoffset, r.Yoffset) for r in stereo.directions(spark.createDataFrame(events, DDL)).collect()}
    assert got.keys() == want.keys()
    for e in want:
        assert got[e] == pytest.approx(want[e], rel=1e-7, abs=1e-7)


def test_parallel_axes_give_no_direction(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 0.0, 0.0, 90.0, 0.4, 0.1), (1, 2, 100.0, 1.0, 0.0, 270.0, 0.4, 0.1)], DDL)
    assert stereo.directions(df).count() == 0


def test_repeated_telescope_is_refused_side_by_side(spark):
    df = spark.createDataFrame([(1, 1, 100.0, 0.0, 0.0, 90.0, 0.4, 0.1)] * 2, DDL)
    with pytest.raises(PySparkException, match="two images of one telescope"):
        stereo.directions(df, unique=True).collect()


def test_any_number_of_images(spark):
    rng = np.random.default_rng(12)
    events, want = [], {}
    for e in range(60):
        images = [(rng.uniform(50, 900), *rng.normal(0, 2, 2), rng.uniform(0, 360), 0.5, rng.uniform(0.05, 0.4)) for _ in range(rng.integers(1, 8))]
        events += [(e, int(rng.integers(1, 6)), *map(float, im)) for im in images]
        if len(images) > 1:
            want[e] = by_slopes(images)
    got = {r.Event: (r.Xoffset, r.Yoffset) for r in stereo.directions(spark.createDataFrame(events, DDL)).collect()}
    assert got.keys() == want.keys()
    for e in want:
        assert got[e] == pytest.approx(want[e], rel=1e-7, abs=1e-7)


def test_both_ways_agree(spark):
    rng = np.random.default_rng(13)
    rows = [(e, t, *map(float, (rng.uniform(50, 900), *rng.normal(0, 2, 2), rng.uniform(0, 360), 0.5, rng.uniform(0.05, 0.4)))) for e in range(80) for t in (1, 2, 3) if rng.random() < 0.8]
    df = spark.createDataFrame(rows, DDL)
    columns = ["Event", "n_images", "Xoffset", "Yoffset", "MeanAngle"]
    a, b = ([tuple(r) for r in stereo.directions(df, unique=u).select(*columns).orderBy("Event").collect()] for u in (True, False))
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert x == pytest.approx(y, rel=1e-9, abs=1e-9)


def test_mean_angle(spark):
    df = spark.createDataFrame(
        [(1, 1, 100.0, 0.0, 0.0, 10.0, 0.4, 0.1), (1, 2, 100.0, 1.0, 0.0, 30.0, 0.4, 0.1),
         (2, 1, 100.0, 0.0, 0.0, 10.0, 0.4, 0.1), (2, 2, 100.0, 1.0, 0.0, 30.0, 0.4, 0.1), (2, 3, 100.0, 0.0, 1.0, 120.0, 0.4, 0.1)], DDL)
    got = {r.Event: r.MeanAngle for r in stereo.directions(df).collect()}
    assert got[1] == pytest.approx(-20) and got[2] == pytest.approx((20 + 70 + 90) / 3)


def test_known_sky_positions(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 2.0), (-3.0, 0.5)], "Xoffset double, Yoffset double")
    got = [(r.RA, r.DEC) for r in stereo.with_radec(df, 86.133333, 22.0175).collect()]
    want = [(86.133333, 22.0175), (83.961704, 23.002588), (85.605197, 19.019487)]
    for a, b in zip(got, want):
        assert a == pytest.approx(b, abs=1e-6)


def test_core_of_three_lines(spark):
    values = {}
    for t, w in zip((1, 2, 3), (1.0, 2.0, 3.0)):
        x, y, _ = K.DATA_TELESCOPES[t]
        gap = np.array([30 - x, -20 - y])
        ux, uy = gap / np.hypot(*gap)
        values |= {f"lx_{t}": x, f"ly_{t}": y, f"ux_{t}": float(ux), f"uy_{t}": float(uy), f"lw_{t}": w}
    r = stereo.core_fit(spark.createDataFrame([values])).first()
    assert (r.xfit, r.yfit, r.stdP) == pytest.approx((30, -20, 0), abs=1e-9)


def test_core_comes_back_to_the_ground(spark):
    """Images that point exactly along the lines to a core must give that core."""
    az, ze, core = 140.0, 25.0, (35.0, -60.0)
    based = spark.createDataFrame([(az, ze)], "az double, ze double")
    xc, yc = angles.direction_cosines(F.col("az"), F.col("ze"))
    axes = angles.shower_axes(xc, yc)
    places = {t: angles.in_frame(axes, tuple(F.lit(v) for v in K.DATA_TELESCOPES[t])) for t in K.TELESCOPES}
    places["core"] = angles.in_frame(axes, (F.lit(core[0]), F.lit(core[1]), F.lit(0.0)))
    cols = [p[k].alias(f"{n}_{k}") for n, p in places.items() for k in range(2)]
    flat = based.select(*cols).first().asDict()
    row = {"Event": 1, "TrueAz": az, "TrueZe": ze, "Az": az, "Ze": ze, "Xoffset": 0.0, "Yoffset": 0.0}
    for t in K.TELESCOPES:
        gx, gy = flat["core_0"] - flat[f"{t}_0"], flat["core_1"] - flat[f"{t}_1"]
        row |= {f"Size_{t}": 500.0, f"MeanX_{t}": gx / 100, f"MeanY_{t}": -gy / 100, f"Length_{t}": 0.4, f"Width_{t}": 0.1}
    got = stereo.core_reconstruction(spark.createDataFrame([row]), K.DATA_TELESCOPES).first()
    # the height correction uses the tangent of the elevation, so compare in the fit plane
    assert (got.xfit, got.yfit) == pytest.approx((flat["core_0"], flat["core_1"]), abs=1e-3)
    assert got.stdP == pytest.approx(0, abs=1e-6) and got.core_valid


def test_tangent_plane_round_trip(spark):
    df = spark.createDataFrame([(0.02, -0.03)], "xi double, eta double")
    lon, lat = angles.tangent_to_sphere(F.col("xi"), F.col("eta"), F.lit(1.0), F.lit(0.4))
    r = df.select(lon.alias("a"), lat.alias("d")).first()
    den = np.sin(r.d) * np.sin(0.4) + np.cos(r.d) * np.cos(0.4) * np.cos(r.a - 1.0)
    xi = np.cos(r.d) * np.sin(r.a - 1.0) / den
    eta = (np.sin(r.d) * np.cos(0.4) - np.cos(r.d) * np.sin(0.4) * np.cos(r.a - 1.0)) / den
    assert (xi, eta) == pytest.approx((0.02, -0.03))


def test_site_distances_and_separation(spark):
    d = angles.site_distance(*[F.lit(float(v)) for v in (0, 0, 0, 0, 1, 0)])
    s = angles.separation(*[F.lit(float(v)) for v in (0, 0, 90, 0)])
    r = spark.range(1).select(d.alias("d"), s.alias("s")).first()
    assert r.d == pytest.approx(6371000 * np.pi / 180) and r.s == pytest.approx(90)


def test_a_crowded_event_in_blocks(spark):
    """4,000 images of one event, eight million pairs, beside events of two and three; copies count as images."""
    rng = np.random.default_rng(12)
    n = 4000
    rows = [(1, int(rng.integers(1, 4)), *map(float, (rng.uniform(100, 900), rng.normal(0, 1), rng.normal(0, 1), rng.uniform(-90, 90), rng.uniform(0.4, 0.9), rng.uniform(0.1, 0.3)))) for _ in range(n - 2)]
    rows += [rows[0]] * 2 + [(2, *r[1:]) for r in rows[:2]] + [(3, *r[1:]) for r in rows[:3]] + [(4, *rows[5][1:])]
    df = spark.createDataFrame(rows, "Event long, Telescope int, Size double, MeanX double, MeanY double, Phi double, Length double, Width double")
    found = stereo.directions_of_pairs(df)
    assert "Window" not in found._jdf.queryExecution().executedPlan().toString()
    got = {r.Event: r for r in found.collect()}
    assert {e: r.n_images for e, r in got.items()} == {1: n, 2: 2, 3: 3}
    for e, r in got.items():
        own = np.array([x[2:] for x in rows if x[0] == e])
        size, x, y, phi, length, width = own.T
        f = np.radians(spark.createDataFrame([(float(p),) for p in phi], "p double").select(angles.axis_angle(F.col("p"))).toPandas().iloc[:, 0].to_numpy())
        w = sx = sy = 0.0
        for k in range(len(own) - 1):
            j = slice(k + 1, None)
            sine = np.sin(f[j] - f[k])
            strength = size[k] * size[j] / (size[k] + size[j]) * (1 - width[k] / length[k]) * (1 - width[j] / length[j])
            reach = (x[j] - x[k]) * np.sin(f[j]) - (y[j] - y[k]) * np.cos(f[j])
            pull = strength**2 * sine
            w += (pull * sine).sum()
            sx += (pull * (x[k] * sine + reach * np.cos(f[k]))).sum()
            sy += (pull * (y[k] * sine + reach * np.sin(f[k]))).sum()
        assert (r.Xoffset, r.Yoffset) == pytest.approx((sx / w, sy / w), rel=1e-6, abs=1e-9)
    small = stereo.paired_images(df, stereo.IMAGE_COLUMNS, block=3).groupBy("Event").count().collect()
    assert {r.Event: r["count"] for r in small} == {1: n * (n - 1) // 2, 2: 1, 3: 3}
