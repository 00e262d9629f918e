import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from lumiray.operators import performance, psf, stats


def column(spark, values, name="v"):
    return spark.createDataFrame([(float(v),) for v in values], f"{name} double")


def test_histogram_known(spark, rows):
    out = rows(stats.histogram(column(spark, [0.1, 0.2, 0.2, 1.5, 1.5, 2.0]), "v", 0.0, 1.5, 80), "bin")
    assert len(out) == 80
    assert {r["bin"]: r["n"] for r in out if r["n"]} == {5: 1, 10: 2, 79: 2}


def test_histogram_equals_numpy_on_edges(spark, rows):
    values = np.concatenate([np.linspace(0, 1, 81), np.random.default_rng(0).uniform(-0.2, 1.2, 500)])
    out = rows(stats.histogram(column(spark, values), "v", 0.0, 1.0, 80, density=True), "bin")
    assert [r["n"] for r in out] == np.histogram(values, 80, (0, 1))[0].tolist()
    assert sum(r["density"] for r in out) / 80 == pytest.approx(1)


def test_own_range_histogram(spark, rows):
    values = np.random.default_rng(1).normal(0, 3, 300)
    n, edges = np.histogram(values, 10)
    out = rows(stats.histogram_own_range(column(spark, values), "v", 10), "bin")
    assert [r["n"] for r in out] == n.tolist()
    assert [r["left"] for r in out] == pytest.approx(edges[:-1].tolist())
    same = rows(stats.histogram_own_range(column(spark, [4, 4, 4]), "v", 10), "bin")
    assert sum(r["n"] for r in same) == 3 and same[0]["left"] == 3.5


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(4)
    frames = {"a": rng.exponential(5, 997), "b": np.repeat(3.25, 50), "c": np.array([1, 2, 4, 10.0]), "d": np.array([7.0])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in frames.items() for v in vs] + [("c", None)], "k string, v double")
    got = {(r.k, r.prob): (r.quantile, r.n) for r in stats.exact_quantiles(df, "v", (0.0, 0.25, 0.68, 1.0), "k").collect()}
    for k, vs in frames.items():
        for p in (0.0, 0.25, 0.68, 1.0):
            assert got[k, p][0] == pytest.approx(np.quantile(vs, p)) and got[k, p][1] == len(vs)
    assert got["c", 0.68][0] == pytest.approx(4.24)
    assert stats.exact_quantiles(df, "v", (0.5,)).first().n == sum(len(v) for v in frames.values())


def test_describe_equals_pandas(spark):
    x = pd.DataFrame({"a": np.random.default_rng(6).normal(5, 2, 101), "b": np.arange(101.0)})
    got = {r["column"]: r for r in stats.describe(spark.createDataFrame(x), ["a", "b"]).collect()}
    for c in x:
        d = x[c].describe()
        r = got[c]
        assert (r["count"], r["mean"], r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]) == pytest.approx(tuple(d))


def test_event_maximum_only_on_its_row(spark, rows):
    df = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (1, 3, 3.0), (2, 1, 1.0)], "Event bigint, Telescope int, Distance double")
    out = rows(stats.event_maximum(df), "Event", "Telescope")
    assert [r["MaxDistance"] for r in out] == [None, 3.0, 3.0, 1.0]


def test_rates_have_empty_buckets(spark, rows):
    times = [100.0, 150.0, 199.99, 400.0]
    df = spark.createDataFrame([(1, t, 1.0, 10.0) for t in times], "Telescope int, Timestamp double, Width double, Size double")
    out = rows(stats.event_rate(df), "bucket")
    assert [(r["bucket"], r["n"], r["rate"]) for r in out] == [(100, 3, 0.03), (200, 0, 0.0), (300, 0, 0.0), (400, 1, 0.01)]
    means = rows(stats.bucket_means(df), "bucket")
    assert [r["mean_Width"] for r in means] == [1.0, None, None, 1.0] and means[0]["log10_mean_Size"] == 1.0


def test_mean_scaled(spark, rows):
    data = [(1, 0.1, 0.3), (1, 0.3, 0.5), (2, 0.2, 0.9), (3, 0.5, 0.2), (3, 0.6, 0.4)]
    df = spark.createDataFrame([("g", *r) for r in data], "class string, Event bigint, Width double, Length double")
    w = pd.DataFrame(data, columns=["e", "w", "l"])
    z = (w.w - w.w.mean()) / w.w.std(ddof=0)
    out = rows(stats.mean_scaled(df), "Event")
    assert [r["Event"] for r in out] == [1, 3]
    assert [r["MSCW"] for r in out] == pytest.approx([z[:2].mean(), z[3:].mean()])


def test_spot_size(spark):
    rng = np.random.default_rng(8)
    y, x = np.mgrid[0:15, 0:15]
    image = (1000 * np.exp(-((x - 7.3) ** 2 + (y - 6.6) ** 2) / 8) + rng.integers(0, 5, (15, 15))).astype(int)
    df = spark.createDataFrame([(1, int(a), int(b), int(image[b, a])) for a in range(15) for b in range(15)], "image_id bigint, x int, y int, flux bigint")
    cx, cy = (image * x).sum() / image.sum(), (image * y).sum() / image.sum()
    r = np.hypot(x - cx, y - cy).ravel()
    order = np.argsort(r)
    want = r[order][np.searchsorted(np.cumsum(image.ravel()[order]), 0.9 * image.sum())]
    assert psf.containment_radius(df).first().radius == pytest.approx(want)
    py, px = np.unravel_index(image.argmax(), image.shape)
    bright = image >= 0.5 * image.max()
    assert psf.full_width_half_maximum(df).first().fwhm == pytest.approx(2 * np.median(np.hypot(x - px, y - py)[bright]))
    profile = {p.x: p.relative for p in psf.peak_row_profile(df).collect()}
    assert profile == pytest.approx({k: image[py, k] / image.max() for k in range(15)})


def test_polynomials_equal_numpy(spark):
    x = np.linspace(300, 900, 40)
    y = 1e-9 * x**4 - 2e-6 * x**3 + 0.5 * x + 3
    df = spark.createDataFrame([("a", float(a), float(b)) for a, b in zip(x, y)] + [("b", 1.0, 2.0)], "k string, x double, y double")
    for degree in (1, 2, 4):
        got = {r.k: r.coefficients for r in psf.polynomial_fit(df, "x", "y", "k", degree).collect()}
        assert got["a"] == pytest.approx(np.polyfit(x, y, degree).tolist(), rel=1e-6)
        assert got["b"] is None


def test_resolution_and_area(spark, rows):
    ddl = ("Event bigint, Telescope int, Alpha double, Az double, Ze double, Xcore double, Ycore double, TrueAz double, TrueZe double, "
           "TrueXcore double, TrueYcore double, TrueEnergy double")
    data = []
    for e in range(1, 41):
        tels = (1, 2, 3) if e % 2 else (1, 2)
        reco = (10.0, 20.0 + e / 100, 3.0 + e, 4.0) if e % 5 else (None,) * 4
        data += [(e, t, None if (t == 3 and e % 3 == 0) else 5.0, *reco, 10.0, 20.0, 3.0, 4.0, 5000.0 * e) for t in tels]
    df = spark.createDataFrame(data, ddl)
    out = {(r["selection"], r["error"]): r for r in rows(performance.resolution(df, 10000.0))}
    two = [e for e in range(3, 41) if e % 5]
    three = [e for e in two if e % 2 and e % 3]
    assert out["two_plus", "angle_error"]["n"] == len(two) and out["three", "angle_error"]["n"] == len(three)
    assert out["two_plus", "angle_error"]["q68"] == pytest.approx(np.quantile([e / 100 for e in two], 0.68), abs=1e-9)
    area = rows(performance.effective_area(df), "bin")
    seen = [5.0 * e for e in range(1, 41) if e % 5]
    assert [a["triggered"] for a in area] == np.histogram(seen, 10)[0].tolist()
    assert [a["simulated"] for a in area] == np.histogram([5.0 * e for e in range(1, 41)], 10)[0].tolist()


def test_sliding_means_over_block_edges(spark):
    rng = np.random.default_rng(9)
    n = 500
    t = np.sort(rng.uniform(0, 40000, n))
    x = rng.normal(0, 1, n)
    df = spark.createDataFrame([("f", 1, int(k), float(a), float(b)) for k, (a, b) in enumerate(zip(t, x))], "File string, Telescope int, Event bigint, Timestamp double, MeanX double")
    want = [x[max(0, k - 6) : k + 6].mean() for k in range(n)]
    for block in (6, 37, 10_000):
        out = stats.sliding_means(df, ["MeanX"], before=6, after=5, block=block).orderBy("Event").collect()
        assert [r.sliding_MeanX for r in out] == pytest.approx(want)


def test_crowded_event_stays_exact(spark):
    """One event holds a third of all rows."""
    data = [(1 if k % 3 == 0 else k, k, float(k % 101)) for k in range(3000)]
    df = spark.createDataFrame(data, "Event bigint, Telescope int, Distance double")
    out = stats.event_maximum(df).collect()
    assert len(out) == 3000
    assert {r.MaxDistance for r in out if r.Event == 1} == {None, 100.0}


@pytest.mark.parametrize("kind", ["outlier", "infinite", "dominant", "spread", "equal"])
def test_quantiles_of_any_distribution(spark, kind, monkeypatch):
    rng = np.random.default_rng(3)
    values = rng.normal(0, 1, 4000)
    if kind == "outlier":
        values[7] = 1e12
    elif kind == "infinite":
        values[:9], values[9:12] = np.inf, -np.inf
    elif kind == "dominant":
        values[:3000] = 0.25
    elif kind == "spread":
        values = 10.0 ** rng.uniform(-300, 300, 4000)
    else:
        values[:] = 3.0
    probs = (0.0, 0.1, 0.5, 0.68, 1.0)
    df = spark.createDataFrame([(float(v),) for v in values] + [(None,), (float("nan"),)], "v double")
    got = {r.prob: (r.quantile, r.n) for r in stats.exact_quantiles(df, "v", probs, bins=16).collect()}
    ordered = np.sort(values)
    for p in probs:
        h = (len(values) - 1) * p
        low, high = ordered[int(h)], ordered[min(int(h) + 1, len(values) - 1)]
        want = low if low == high else low + (high - low) * (h - int(h))
        assert got[p][0] == pytest.approx(want, rel=1e-12) and got[p][1] == len(values)


def test_no_window_sees_more_than_the_cells(spark):
    """However the values lie, ranking windows hold counts of cells, never values."""
    values = [(float(v),) for v in range(3000)] + [(1e12,)]
    seen = []
    plain = stats.small_table

    def watched(df):
        done = plain(df)
        if "part" in done.columns:
            seen.append(done.count())
        return done

    stats.small_table, before = watched, plain
    try:
        stats.exact_quantiles(spark.createDataFrame(values, "v double"), "v", (0.5,), bins=8).collect()
    finally:
        stats.small_table = before
    assert len(seen) >= 2 and max(seen) <= 8


def test_own_range_refuses_infinities(spark):
    from pyspark.errors import PySparkException

    df = spark.createDataFrame([(1.0,), (2.0,), (float("inf"),), (float("nan"),)], "v double")
    with pytest.raises(PySparkException, match="infinite"):
        stats.histogram_own_range(df, "v", 4).collect()
    assert sum(r.n for r in stats.histogram_own_range(df.filter("v < 3"), "v", 4).collect()) == 2


def test_spines_longer_than_a_chunk(spark):
    df = spark.createDataFrame([(0, 10_000)], "a int, b int")
    got = [r.k for r in stats._spread(df, F.col("a"), F.col("b"), F.lit(1), "k", chunk=64).collect()]
    assert sorted(got) == list(range(10_001))


def test_containment_of_large_images_and_negative_flux(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n = 20_000
    x, y = rng.integers(0, 400, n), rng.integers(0, 400, n)
    flux = rng.integers(0, 50, n) + (1000 * np.exp(-((x - 200.0) ** 2 + (y - 180.0) ** 2) / 500)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({"image_id": np.arange(n) % 3, "x": x, "y": y, "flux": flux}))
    want = {r.image_id: r.radius for r in psf.containment_radius(df).collect()}
    monkeypatch.setattr(psf, "TASK_PIXELS", 100)
    found = psf.containment_radius(df)
    assert {r.image_id: r.radius for r in found.collect()} == want and len(want) == 3
    # weights below zero: the sum passes the wanted place, falls back, and passes it again
    v = np.arange(60.0)
    w = np.where(v == 7, 30.0, np.where(v == 9, -25.0, 1.0))
    rows = [(1, float(a), float(b), 30.0) for a, b in zip(v, w)] + [(2, float(a), 1.0, 5.0) for a in v] + [(3, 4.0, 2.0, 9.0), (4, 4.0, 9.0, 9.0)]
    got = stats.weighted_quantile(spark.createDataFrame(rows, "k int, v double, w double, wanted double"), "k", bins=3)
    assert {r.k: r.v for r in got.collect()} == {1: float(v[np.argmax(np.cumsum(w) >= 30)]), 2: 4.0, 4: 4.0}


@pytest.mark.parametrize("accuracy, by", [(20, ()), (2000, ("g",))])
def test_wide_quantiles_equal_numpy(spark, accuracy, by):
    rng = np.random.default_rng(5)
    n = 3000
    frame = pd.DataFrame({
        "g": rng.integers(0, 2, n), "normal": rng.normal(0, 1, n), "ties": rng.integers(0, 3, n).astype(float), "one": np.full(n, 7.0),
        "gaps": np.where(rng.random(n) < 0.7, np.nan, rng.normal(5, 1, n)), "none": np.full(n, np.nan),
        "ends": np.where(rng.random(n) < 0.4, -np.inf, np.where(rng.random(n) < 0.5, np.inf, rng.normal(0, 1, n))),
    })
    names = [c for c in frame.columns if c != "g"]
    df = spark.createDataFrame(frame)
    probs = (0.0, 0.5, 0.9)
    got = {(*[r[c] for c in by], r["column"], r["prob"]): (r["quantile"], r["n"]) for r in stats.wide_quantiles(df, names, probs, by, accuracy).collect()}
    want = {}
    for key, part in [((), frame)] if not by else [((int(k),), p) for k, p in frame.groupby("g")]:
        for c in names:
            v = np.sort(part[c].dropna().to_numpy())
            for p in probs if len(v) else ():
                h = (len(v) - 1) * p
                a, b = v[int(h)], v[min(int(h) + 1, len(v) - 1)]
                want[(*key, c, p)] = (a if a == b else a + (b - a) * (h - int(h)), len(v))
    assert got.keys() == want.keys()
    for k, (q, m) in want.items():
        assert got[k][1] == m and (got[k][0] == pytest.approx(q, rel=1e-12) or np.isnan(q) and (got[k][0] is None or np.isnan(got[k][0]))), k
