"""A part of the catalogue against its SQL on the smallest tables; all of it with CATALOG=all."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SOME = [
    "mom2_mom7_image_parameters", "dir1_axis_intersection", "sky10_significance_map", "img3_img6_full_cleaning", "img9_trigger",
    "cor4_corrected_parameters", "core5_ground_core", "red1_dedupe_for_sky", "agg4_describe", "qf1_qf2_max_distance_scan", "tim1_event_rate",
    "dir1_repeated_telescopes", "snk3_repeated_telescopes", "snk4_pixel_matrix", "snk5_centroid_triples", "flow_data_parameters",
    "src1_capture_files", "src1_ng_capture_files", "ml3_ml4_boosted_stumps", "sky9_li_ma", "sky6_sky7_on_off_at_positions", "core5_ground_core", "sample_of_rows", "img_shift",
    "cor2_time_of_file_name", "src10_headers_by_file", "his4_weighted_centroid_map", "psf1_containment_radius",
]
ORACLES = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="tables not there")


@pytest.fixture(scope="module")
def engine():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return con


def plain(rows):
    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return "missing"
        return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    return sorted(tuple(cell(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("CATALOG") == "all" else SOME)
def test_query_equals_sql(spark, engine, name):
    df = entry_points.queries()[name](spark, FOLDER)
    names = sorted(df.columns)
    ours = df.select(*[f"`{c}`" for c in names]).collect()
    cursor = engine.execute(ORACLES[name])
    at = [[d[0] for d in cursor.description].index(c) for c in names]
    theirs = [[r[k] for k in at] for r in cursor.fetchall()]
    assert len(names) == len(cursor.description)
    assert plain(ours) == plain(theirs)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(entry_points.queries())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="tables not there")
def test_nearly_parallel_lines_have_a_core(spark):
    found = {r["Event"]: r for r in entry_points.queries()["core1_core4_core_fit"](spark, "/root/testdata/sf0.01").collect()}
    assert all(r["xfit"] is not None for r in found.values())
    assert any(abs(r["xfit"]) > 1e7 for r in found.values())


def test_boosted_trees_run_at_full_size(spark, monkeypatch):
    import inspect

    from lumiray import constants as K
    from lumiray.operators import classify
    from lumiray.plans import catalog

    fit, seen = classify.fit_boosted_trees, []

    def noted(*args, **named):
        bound = inspect.signature(fit).bind(*args, **named)
        bound.apply_defaults()
        model = fit(*args, **named)
        seen.append((bound.arguments["rounds"], bound.arguments["depth"], max(t.depth for t in model.trees)))
        return model

    monkeypatch.setattr(catalog.classify, "fit_boosted_trees", noted)
    n = entry_points.queries()["ml3_ml4_boosted_trees"](spark, FOLDER).first()["n"]
    assert n > 0 and seen[0][:2] == (K.CLASSIFIER_TREES, K.CLASSIFIER_DEPTH) == (200, 50) and seen[0][2] > 6


def test_entry(spark):
    assert entry_points.entry(spark).count() == 2500
