import math

import pytest
from pyspark.sql import functions as F

from lumiray.functions.numeric import first_step_above
from lumiray.operators import quality, selection
from lumiray.sources import sinks, tables

NAN, INF = float("nan"), float("inf")


def test_missing_before_width(spark):
    cols = ["Length", "Width", "Miss", "Distance", "Azwidth", "Alpha"]
    df = spark.createDataFrame([(1.0, NAN, 1.0, 1.0, 1.0, 1.0), (1.0, 0.0, 1.0, 1.0, 1.0, 1.0), (1.0, 2.0, 1.0, 1.0, 1.0, None), (1.0,) * 6], cols)
    assert quality.positive_width(quality.drop_missing(df)).count() == 1


def test_dedupe_keeps_the_first_and_is_idempotent(spark):
    ddl = "File string, In_file_Index bigint, Event bigint, Telescope int, Size double, Phi double"
    df = spark.createDataFrame([("a", 4, 4, 2, 9.0, None), ("a", 3, 3, 1, 9.0, None), ("b", 3, 8, 1, 9.0, None), ("a", 5, 5, 1, 7.0, 1.0)], ddl)
    one = quality.dedupe_for_sky(df)
    assert sorted((r.File, r.Event) for r in one.collect()) == [("a", 3), ("a", 5), ("b", 8)]
    assert sorted(quality.dedupe_for_sky(one).collect()) == sorted(one.collect())
    two = quality.dedupe_for_histograms(df)
    assert sorted((r.File, r.Event) for r in two.collect()) == [("a", 3), ("a", 4), ("a", 5)]


def test_event_numbers_over_files(spark):
    df = spark.createDataFrame([("n/f1", 1), ("n/f1", 1), ("n/f1", 2), ("n/f2", 1), ("n/f3", 5)], "path string, Event bigint")
    got = sorted((r.File, r.In_file_Index, r.Event) for r in quality.global_event_ids(df, "path", F.col("path")).collect())
    assert got == [("n/f1", 1, 1), ("n/f1", 1, 1), ("n/f1", 2, 2), ("n/f2", 1, 4), ("n/f3", 5, 9)]


def test_provenance(spark):
    df = spark.createDataFrame([("/x/y/run_Crab.corrected.csv",)], "p string")
    assert df.select(quality.provenance(F.col("p")).alias("f")).first().f == "run_Crab.corrected.csv"[:-16]


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_renumber(spark, chunk):
    data = [("b", i, t, 0) for i in range(4) for t in (2, 1)] + [("a", i, 1, 0) for i in (9, 2)]
    df = spark.createDataFrame(data, "File string, In_file_Index bigint, Telescope int, Event bigint")
    got = [r.Event for r in quality.renumber(df, chunk).orderBy("File", "In_file_Index", "Telescope").collect()]
    assert got == list(range(1, 11))


def test_multiplicity_and_first_row(spark):
    df = spark.createDataFrame([(1, 2, 5.0), (1, 1, 6.0), (2, 1, 7.0)], "Event bigint, Telescope int, Size double")
    assert {r.Event for r in quality.min_images(df, 2).collect()} == {1}
    assert sorted(tuple(r) for r in quality.first_row_per_event(df).collect()) == [(1, 1, 6.0), (2, 1, 7.0)]


def test_sectors_are_open(spark):
    df = spark.createDataFrame([(1, -4.96, 0.1, 0.1), (1, -4.0, -4.0, 0.1), (1, 0.0, 1.0, 0.1), (1, 4.95, 4.95, 0.1)], "Telescope int, MeanX double, MeanY double, Width double")
    assert sorted((r.sx, r.sy) for r in quality.camera_sector(df).collect()) == [(0, 0), (3, 3)]


def test_first_step_above_is_exact(spark):
    step = 3.0 / 10000
    values = [i * step for i in range(0, 10001, 7)] + [0.0, 2.99999, 1e-12, 5.0]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double")
    for r in df.select("v", first_step_above(F.col("v"), step).alias("i")).collect():
        if r.v is None:
            assert r.i is None
        else:
            assert r.i * step > r.v and (r.i == 0 or (r.i - 1) * step <= r.v)


def test_scans_equal_brute_force(spark):
    data = [("gamma", e, 0.3 * (e % 11), (e % 13) ** 2 / 400) for e in range(60)] + [("proton", e, 0.25 * (e % 9) + 0.1, (e % 7) / 30) for e in range(60, 100)]
    data.append(("proton", 100, 0.5, None))
    df = spark.createDataFrame(data, "class string, Event bigint, Distance double, ThetaSquare double")
    for scan, upper, value in ((selection.max_distance_scan, 3.0, lambda r, c: r[2] < c), (selection.theta_scan, 1.0, lambda r, c: r[3] is not None and r[3] < c * c)):
        out = scan(df, upper, 100).orderBy("i").collect()
        assert len(out) == 101
        for r in out:
            cut = r.i * (upper / 100)
            g = sum(value(d, cut) for d in data if d[0] == "gamma")
            p = sum(value(d, cut) for d in data if d[0] == "proton")
            assert (r.n_gamma, r.n_proton) == (g, p)
            assert (r.Q is None) if p == 0 else r.Q == pytest.approx((g / 60) / math.sqrt(p / 41))


def test_parameter_files_round_trip(spark, tmp_path):
    shape = {c: 1.5 for c in tables.DATA_COLUMNS[3:]}
    row = {"Event": 7, "Telescope": 2, "Timestamp": 1730444400.25, **shape, "Width": None, "Size": 0.1234567}
    df = spark.createDataFrame([row], ", ".join(f"{c} {'bigint' if c == 'Event' else 'int' if c == 'Telescope' else 'double'}" for c in tables.DATA_COLUMNS))
    sinks.write_data_parameters(df, str(tmp_path / "x_Crab.corrected.csv"))
    sinks.write_data_parameters(df, str(tmp_path / "x_Other.corrected.csv"))
    got = tables.read_parameter_csv(spark, [str(tmp_path / "*")], contains=("Crab", "corrected")).collect()
    assert len(got) == 1
    assert got[0].Width is None and got[0].Size == 0.123457 and got[0].Event == 7 and got[0].Timestamp == 1730444400.25


def test_text_to_numbers(spark):
    raw = spark.createDataFrame([("nan",), ("-nan",), ("inf",), ("-inf",), ("2.5",)], "Width string")
    assert [r.Width for r in tables.parse_parameters(raw, ["Width"]).collect()] == [None, None, INF, -INF, 2.5]


def test_pixel_matrix(spark):
    df = spark.createDataFrame([(2, [0, 1, 2, 3]), (2, [0] * 4), (1, [9] * 4)], "telescope int, image array<int>")
    assert [tuple(r) for r in sinks.pixel_matrix(df, side=2).collect()] == [(0, 1, 2, 3)]


@pytest.mark.parametrize("share", [0.0, 0.3, 0.7, 1.0])
def test_exact_sample(spark, share):
    rows = [(k, t, float(k % 3)) for k in range(500) for t in (1, 2)] + [(7, 1, 9.0)] * 200 + [(None, 1, 1.0)] * 3
    df = spark.createDataFrame(rows, "Event long, Telescope int, Size double")
    one = sorted(map(str, quality.exact_sample(df, share).collect()))
    assert len(one) == math.floor(share * len(rows) + 0.5)
    assert sorted(map(str, quality.exact_sample(df.repartition(7, "Size"), share).collect())) == one
    assert quality.exact_sample(df.limit(0), share).count() == 0


def test_first_rows_need_no_sort(spark):
    rows = [(e % 7 - 3 if e % 5 else None, t if e % 3 else None, float(e % 4), e) for e in range(120) for t in (3, 1, 2)]
    df = spark.createDataFrame(rows, "Event long, Telescope int, Size double, In_file_Index long")
    order = lambda r: tuple((v is not None, v or 0) for v in r[:2])
    found = quality.first_of_copies(df, ["Telescope", "Event", "In_file_Index"], ["Event", "Telescope"])
    best = {size: min(order(r) for r in rows if r[2] == size) for size in {r[2] for r in rows}}
    assert {r["Size"]: order(r) for r in found.collect()} == best
    assert all(tuple(r) in rows for r in found.collect())
    first = quality.first_row_per_event(df)
    least = {e: min((r[1] is not None, r[1] or 0) for r in rows if r[0] == e) for e in {r[0] for r in rows}}
    assert {r["Event"]: (r["Telescope"] is not None, r["Telescope"] or 0) for r in first.collect()} == least
    assert all(tuple(r) in rows for r in first.collect())
    for df in (found, first):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "HashAggregate" in plan and "SortAggregate" not in plan
    far = spark.createDataFrame([((1 << 62), 5, 1.0, 1), ((1 << 62) - 1, 2147483647, 1.0, 2), (-(1 << 61), -7, 2.0, 3)], df.schema)
    assert {tuple(r) for r in quality.first_of_copies(far, ["Telescope", "Event", "In_file_Index"], ["Event", "Telescope"]).collect()} == {((1 << 62) - 1, 2147483647, 1.0, 2), (-(1 << 61), -7, 2.0, 3)}
