import numpy as np
import pytest
from pyspark.sql import functions as F

from lumiray import constants as K
from lumiray.operators import classify, pointing
from lumiray.plans import flows
from lumiray.streaming.rates import rate_stream


def track(seed):
    rng = np.random.default_rng(seed)
    im = rng.integers(-3, 4, (32, 32))
    x0, y0 = rng.integers(8, 24, 2)
    for k in range(4):
        im[x0 + k, y0 + k] += 900 - 100 * k
        im[x0 + k + 1, y0 + k] += 300
    return im


def test_array_events_to_parameters(spark):
    rows = [("f", e, t, 0, 10 + t if t else 0, 1730286600.0 + e, [int(v) + 100 for v in track(e * 3 + t).reshape(-1)]) for e in range(3) for t in (1, 2, 3)]
    rows.append(("f", 9, 1, 0, 0, 1730286600.0, [500] * 1024))
    events = spark.createDataFrame(rows, "file string, event bigint, telescope int, tel_event int, scope_id int, pcap_time double, pix array<smallint>")
    peds = spark.createDataFrame([("f", 10 + t, [100.0] * 1024, [1.0] * 1024) for t in (1, 2, 3)], "file string, scope_id int, peds array<double>, pedvars array<double>")
    timed = events.withColumns({"night": F.lit("1030"), "file_time": F.lit(120000)})
    out = {(r.Event, r.Telescope): r for r in flows.data_parameters(timed, peds, pointing.correction_table(spark)).collect()}
    assert len(out) == 10 and out[9, 1].Size == 0 and out[9, 1].Phi is None
    plain = {(r.Event, r.Telescope): r for r in flows.data_parameters(events, peds).collect()}
    for key, r in plain.items():
        assert out[key].Size == r.Size and out[key].Length == pytest.approx(r.Length, abs=2e-6)
        # telescope 1: half a turn, then one pixel to the left
        if key[1] == 1 and r.Size:
            assert out[key].MeanX == pytest.approx(-r.MeanX + K.PIXEL_DEG, abs=2e-6)


def test_plan_of_the_image_job_has_no_shuffle(spark, tmp_path):
    events = spark.createDataFrame([("f", 1, 1, 0, 11, 1.0, [100] * 1024)], "file string, event bigint, telescope int, tel_event int, scope_id int, pcap_time double, pix array<smallint>")
    peds = spark.createDataFrame([("f", 11, [100.0] * 1024, [1.0] * 1024)], "file string, scope_id int, peds array<double>, pedvars array<double>")
    plan = flows.data_parameters(events, peds)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_sim_table_keeps_every_image(spark):
    shape = "Size double, MeanX double, StdX double, MeanY double, StdY double, Phi double, Length double, Width double, Miss double, Distance double, Azwidth double, Alpha double"
    rng = np.random.default_rng(0)

    def image(e, t):
        return (e, t, 500.0, *map(float, rng.normal(0, 1, 4)), float(rng.uniform(0, 360)), 0.5, 0.2, 0.1, 1.0, 0.3, 20.0)

    rows = [image(1, 1), image(1, 2), image(1, 3), image(2, 2), image(3, 1), (3, 2, 0.0, 0.0, 0.0, 0.0, 0.0, None, 0.0, 0.0, None, 0.0, None, None)]
    params = spark.createDataFrame(rows, "Event bigint, Telescope int, " + shape)
    truth = spark.createDataFrame([(e, 100.0, 15.0, 10.0, 20.0, 30000.0) for e in (1, 2, 3)], "Event bigint, TrueAz double, TrueZe double, TrueXcore double, TrueYcore double, TrueEnergy double")
    out = flows.sim_parameters(params, truth, K.DATA_TELESCOPES).orderBy("Event", "Telescope").collect()
    assert [(r.Event, r.Telescope) for r in out] == [(1, 1), (1, 2), (1, 3), (2, 2), (3, 1), (3, 2)]
    assert all(r.Az is not None for r in out[:3]) and all(r.Az is None and r.stdP is None for r in out[3:])
    assert out[5].Size == 0.0 and out[5].Phi is None
    alone = flows.reconstruct(params, truth.select("Event", "TrueAz", "TrueZe"), K.DATA_TELESCOPES).first()
    assert (alone.Az, alone.Ze, alone.Xcore, alone.Ycore, alone.stdP) == pytest.approx((out[0].Az, out[0].Ze, out[0].Xcore, out[0].Ycore, out[0].stdP))


def test_boosted_trees_learn(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(600):
        gamma = e % 2 == 0
        w = rng.normal(0.2 if gamma else 0.35, 0.05)
        rows.append((e, 1, float(rng.uniform(100, 900)), float(abs(w) * 2), float(abs(w)), float(rng.uniform(0, 3)), "gamma" if gamma else "proton"))
    df = spark.createDataFrame(rows, "Event bigint, Telescope int, Size double, Length double, Width double, Distance double, class string")
    train, test = classify.train_test_split(classify.assemble(classify.feature_table(df)))
    assert train.count() + test.count() == 600 and 0.6 < train.count() / 600 < 0.74
    model = classify.fit_boosted_trees(train, rounds=4, depth=3, checkpoint_every=2)
    judged = model.transform(test)
    assert len(model.trees) == 4 and classify.accuracy(judged) > 0.85
    assert sum(v for _, v in model.feature_importance()) == pytest.approx(1)
    matrix = classify.confusion_matrix(judged).collect()
    assert sum(r.n for r in matrix) == test.count()
    right, wrong = classify.judged_rows(judged)
    assert right.count() + wrong.count() == test.count()


def test_a_model_in_parts_scores_as_a_whole_one(spark, monkeypatch):
    rng = np.random.default_rng(3)
    rows = [(k, *map(float, rng.normal(3, 1, 5)), int(rng.integers(1, 3))) for k in range(300)]
    df = spark.createDataFrame(rows, ["Event", *classify.FEATURES, "Classification"])
    table = classify.assemble(df)
    whole = classify.fit_boosted_trees(table, rounds=5, depth=6)
    monkeypatch.setattr(classify, "PART_NODES", 20)
    monkeypatch.setattr(classify, "PIECE_BYTES", 100)
    parts = classify.fit_boosted_trees(table, rounds=5, depth=6)
    # the driver holds the nodes of the last trees alone
    assert len(parts.written) > 1 and sum(t.nodes is not None for t in parts.trees) <= 1
    scores = [{r.Event: (r.score, r.prediction) for r in m.transform(table).collect()} for m in (whole, parts)]
    assert scores[0] == scores[1] and parts.feature_importance() == whole.feature_importance()


def test_rate_stream(spark, tmp_path):
    ddl = "Telescope int, Timestamp double"
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, 100.0), (1, 199.0), (2, 250.0), (1, 5000.0)], ddl).coalesce(1).write.parquet(src)
    stream = rate_stream(spark.readStream.schema(ddl).parquet(src), late="1 second")
    q = stream.writeStream.format("memory").queryName("rates").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(tuple(r) for r in spark.table("rates").collect())
    assert got[:2] == [(1, 100, 2, 0.02), (2, 200, 1, 0.01)]
