import pytest

from lumiray.schemas import DATA_COLUMNS, SIM_COLUMNS
from lumiray.sources import sinks, tables


def write(path, names, rows):
    path.write_text("\n".join([",".join(names), *[",".join(map(str, r)) for r in rows]]) + "\n")


def test_columns_are_found_by_name(spark, tmp_path):
    names = list(reversed(DATA_COLUMNS))
    row = dict(zip(DATA_COLUMNS, range(1, len(DATA_COLUMNS) + 1)))
    write(tmp_path / "a_Crab.csv", names, [[row[n] for n in names]])
    write(tmp_path / "b_other.csv", ["x", *names], [[0, *[row[n] for n in names]]])
    got = tables.read_parameter_csv(spark, str(tmp_path), contains=("Crab",)).collect()
    assert len(got) == 1 and [got[0][c] for c in DATA_COLUMNS] == [row[c] for c in DATA_COLUMNS]
    nights = tables.read_parameter_csv(spark, [str(tmp_path / "a_Crab.csv"), str(tmp_path / "b_other.csv")]).collect()
    assert [[r[c] for c in DATA_COLUMNS] for r in nights] == [[row[c] for c in DATA_COLUMNS]] * 2


def test_files_of_one_folder_may_order_their_columns_otherwise(spark, tmp_path):
    n = len(DATA_COLUMNS)
    orders = {"a b.csv": list(DATA_COLUMNS), "b[1].csv": [*DATA_COLUMNS[1:], DATA_COLUMNS[0]], "c.csv": ["note", *reversed(DATA_COLUMNS)], "d.csv": list(DATA_COLUMNS)}
    for k, (name, names) in enumerate(orders.items()):
        row = {c: 100 * k + i for i, c in enumerate(DATA_COLUMNS)} | {"note": f"seen by {DATA_COLUMNS[3]}"}
        write(tmp_path / name, names, [[row[c] for c in names]] * 2)
    (tmp_path / "empty.csv").write_text("")
    got = tables.read_parameter_csv(spark, str(tmp_path)).collect()
    assert sorted([r[c] for c in DATA_COLUMNS] for r in got) == sorted([100 * k + i for i in range(n)] for k in range(4) for _ in range(2))
    assert len({r["path"] for r in got}) == 4
    few = tables.read_parameter_csv(spark, str(tmp_path), contains=("c.csv",)).collect()
    assert [r[DATA_COLUMNS[0]] for r in few] == [200, 200]


def test_a_file_without_header_is_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", DATA_COLUMNS, [range(len(DATA_COLUMNS))])
    (tmp_path / "b.csv").write_text(",".join(map(str, range(len(DATA_COLUMNS)))) + "\n")
    with pytest.raises(ValueError, match="b.csv"):
        tables.read_parameter_csv(spark, str(tmp_path))


def test_another_header_is_an_error_where_one_is_promised(spark, tmp_path):
    write(tmp_path / "a.csv", DATA_COLUMNS, [range(len(DATA_COLUMNS))])
    write(tmp_path / "b.csv", [*DATA_COLUMNS[1:], DATA_COLUMNS[0]], [range(len(DATA_COLUMNS))])
    with pytest.raises(Exception, match="(?i)header"):
        tables.read_parameter_csv(spark, str(tmp_path), one_header=True).collect()


def test_missing_column_is_an_error(spark, tmp_path):
    write(tmp_path / "a.csv", DATA_COLUMNS[:-1], [range(len(DATA_COLUMNS) - 1)])
    with pytest.raises(ValueError, match=DATA_COLUMNS[-1]):
        tables.read_parameter_csv(spark, str(tmp_path))


def test_simulation_files_with_another_order(spark, tmp_path):
    row = {c: float(k) for k, c in enumerate(SIM_COLUMNS)} | {"Event": 7, "Telescope": 2, "Width": None}
    ddl = ", ".join(f"`{c}` {tables.INTEGER_COLUMNS.get(c, 'double')}" for c in SIM_COLUMNS)
    df = spark.createDataFrame([tuple(row[c] for c in SIM_COLUMNS)], ddl)
    sinks.write_sim_parameters(df, str(tmp_path / "sim"))
    back = tables.read_parameter_csv(spark, str(tmp_path / "sim"), columns=list(reversed(SIM_COLUMNS))).first()
    assert {c: back[c] for c in SIM_COLUMNS} == row


def test_strong_images_are_counted_by_telescope(spark):
    ddl = "Event bigint, Telescope int, Size double, MeanX double, MeanY double, Phi double"
    rows = [(1, 1, 200.0, 0.0, 0.0, 90.0), (1, 1, 300.0, 0.0, 0.0, 90.0), (1, 2, 200.0, 0.0, 0.0, 90.0)]
    rows += [(2, t, 150.0, 1.0, 2.0, 180.0) for t in (1, 2, 3)] + [(3, t, 50.0 * t, 1.0, 2.0, 0.0) for t in (1, 2, 3)]
    assert [r.Event for r in sinks.centroid_triples(spark.createDataFrame(rows, ddl)).collect()] == [2]


def test_seven_rows_in_seven_rows_out(spark):
    from lumiray import constants as K
    from lumiray.plans import flows
    from lumiray.schemas import SHAPE_COLUMNS, TRUTH_COLUMNS

    ddl = "Event bigint, Telescope int, " + ", ".join(f"{c} double" for c in SHAPE_COLUMNS)
    image = lambda e, t, k: (e, t, *[{"Phi": 40.0 * k, "Length": 0.5, "Width": 0.1, "Size": 100.0 + k}.get(c, 0.1 * k + n) for n, c in enumerate(SHAPE_COLUMNS)])
    rows = [image(1, 1, 1), image(1, 1, 2), image(1, 2, 3), image(1, 4, 4), image(2, 1, 1), image(2, 2, 3), image(9, 3, 1)]
    truth = spark.createDataFrame([(1, 10.0, 20.0, 0.0, 0.0, 1e4), (2, 10.0, 20.0, 0.0, 0.0, 1e4)], "Event bigint, " + ", ".join(f"{c} double" for c in TRUTH_COLUMNS))
    got = flows.sim_parameters(spark.createDataFrame(rows, ddl), truth, K.DATA_TELESCOPES).collect()
    assert sorted((r.Event, r.Telescope, r.Size, r.MeanX) for r in got) == sorted((r[0], r[1], r[2 + SHAPE_COLUMNS.index("Size")], r[2]) for r in rows)
    assert all((r.Az is not None) == (r.Event != 9) for r in got)
