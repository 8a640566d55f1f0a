import colorsys
import json

import numpy as np

from textloom.functions import colors
from textloom.sources import viz


def test_palette(spark):
    for r in colors.palette(spark, 23).collect():
        assert np.allclose((r.r, r.g, r.b), colorsys.hsv_to_rgb(r.idx / 24.0, 1.0, 0.8))


def test_color_index(spark):
    values = [0.0, 0.1, 0.25, 0.5, 0.74, 0.75, 1.0]
    got = colors.color_index(spark.createDataFrame([(v,) for v in values], "v double"), "v", 5)
    assert {r.v: r.color_idx for r in got.collect()} == {v: int(np.argmax(np.linspace(0, 1, 5) >= v)) for v in values}
    assert {r.color_idx for r in colors.color_index(spark.createDataFrame([(2.0,), (2.0,)], "v double"), "v").collect()} == {0}


def test_records_there_and_back(spark, tmp_path):
    docs = spark.createDataFrame([(1, "one"), (2, "two"), (3, 'th"ree')], "doc_id long, text string")
    labels = spark.createDataFrame([(1, "x"), (2, "y"), (3, "x")], "doc_id long, category string")
    at = lambda *ids: spark.createDataFrame([(i, float(i), -float(i)) for i in ids], "doc_id long, x double, y double")
    records = viz.viz_records(docs, at(1, 2), labels, test_coords=at(3))
    assert {r.id: (r.title, r.color) for r in records.collect()} == {1: ("1 (x)", "rgb(204,0,0)"), 2: ("2 (y)", "rgb(0,204,0)"), 3: ("3 (x) - TEST POINT", "rgb(204,0,0)")}
    viz.write_json_array(records, f"{tmp_path}/array.json")
    viz.write_json_lines(records, f"{tmp_path}/lines")
    listed = json.loads((tmp_path / "array.json").read_text())
    assert [x["id"] for x in listed] == [1, 2, 3] and set(listed[0]) == {"id", "x", "y", "title", "description", "color"}
    viz.write_json_array(records.limit(0), f"{tmp_path}/none.json")
    assert json.loads((tmp_path / "none.json").read_text()) == []
    for back in (viz.read_json(spark, f"{tmp_path}/array.json"), viz.read_json_lines(spark, f"{tmp_path}/lines")):
        assert {(r.id, r.x, r.description, r.category) for r in back.collect()} == {("1", 1.0, "one", "x"), ("2", 2.0, "two", "y"), ("3", 3.0, 'th"ree', "x")}
    spec = viz.plot_spec(at(1, 2), labels, test_coords=at(3)).collect()
    assert {(r.series, r.category, r.alpha, r.x_low, r.x_high) for r in spec} == {(0, "x", 0.6, 1.0, 2.0), (1, "y", 0.6, 1.0, 2.0), (0, "x", 1.0, 1.0, 2.0)}


def test_records_to_plot(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(6)], "doc_id long, category int")
    coords = spark.createDataFrame([(i, float(i), float(-i)) for i in range(6)], "doc_id long, x double, y double")
    names = spark.createDataFrame([(0, "good"), (1, "bad")], "category int, name string")
    path = f"{tmp_path}/records.json"
    viz.write_json_array(viz.viz_records(docs, coords, labels, names), path)
    spec = viz.json_to_plot(spark, path).collect()
    assert sorted((r.series, r.category, r.x) for r in spec) == [(0, "bad", 1.0), (0, "bad", 3.0), (0, "bad", 5.0), (1, "good", 0.0), (1, "good", 2.0), (1, "good", 4.0)]
    spec = viz.json_to_plot(spark, path, names=["good", "other", "bad"]).collect()
    assert {(r.series, r.category) for r in spec} == {(0, "good"), (2, "bad")} and len(spec) == 6
    try:
        import matplotlib  # noqa: F401
    except ImportError:
        return
    viz.json_to_plot(spark, path, f"{tmp_path}/plot.png", "title")
    assert (tmp_path / "plot.png").stat().st_size > 1000
