"""Layout and export: invariants on a seeded graph, packing and pushes on literals."""

import json
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioforge.operators import canvas, export, graph, layout

TYPES = ["paper", "author", "venue", "year", "citedwork", "concept", "method", "dataset", "metric", "organization", "Other Thing"]


@pytest.fixture(scope="module")
def drawn(spark):
    rng = random.Random(7)
    names = [f"Node {i:03d}" for i in range(130)]
    pairs = {(min(i, j), max(i, j)) for i, j in [(i, rng.randrange(i)) for i in range(1, 125)] + [(rng.randrange(125), rng.randrange(125)) for _ in range(40)] if i != j}
    nodes = spark.createDataFrame([(n, TYPES[i % 11], f"About {n}. " * (i % 40), "a.md<SEP>b.md" if i % 3 else "unknown_source") for i, n in enumerate(names)], "id string, entity_type string, description string, file_path string")
    edges = spark.createDataFrame([(names[a], names[b], "cites<SEP>uses", f"'{names[b]}' cites {names[a]}") for a, b in sorted(pairs)], "src string, tgt string, keywords string, description string")
    return nodes, edges


def test_canvas(spark, drawn, tmp_path):
    path = f"{tmp_path}/sub/g.canvas"
    text = export.write_canvas(*drawn, path)
    assert open(path, encoding="utf-8").read() == text and text.endswith("}\n")
    assert canvas.verify(spark.createDataFrame([("g", text)], "path string, content string")).count() == 0
    document = json.loads(text)
    assert len(document["nodes"]) == 130 and len(document["edges"]) == drawn[1].count()
    assert all(isinstance(n[c], int) and n[c] % 20 == 0 and n[c] >= 0 for n in document["nodes"] for c in "xy")
    assert [n["text"].split("\n")[0] for n in document["nodes"]] == [f"# Node {i:03d}" for i in range(130)]
    assert "color" not in document["nodes"][10] and document["nodes"][0]["color"] == "6"
    by_id = {n["id"]: n for n in document["nodes"]}
    for e in document["edges"]:
        a, b = by_id[e["fromNode"]], by_id[e["toNode"]]
        dx, dy = (b["x"] + b["width"] / 2) - (a["x"] + a["width"] / 2), (b["y"] + b["height"] / 2) - (a["y"] + a["height"] / 2)
        want = (("right", "left") if dx >= 0 else ("left", "right")) if abs(dx) >= abs(dy) else (("bottom", "top") if dy >= 0 else ("top", "bottom"))
        assert (e["fromSide"], e["toSide"]) == want and e["label"] == "cites, uses" and (e["fromEnd"], e["toEnd"]) == ("none", "arrow")
    again = export.write_canvas(drawn[0].repartition(5), drawn[1].repartition(3).selectExpr("tgt as src", "src as tgt", "keywords", "description"), path)
    assert again == text


def test_pruned(spark, drawn, tmp_path):
    document = json.loads(export.write_canvas(*drawn, f"{tmp_path}/g.canvas", 20, layout.Settings(algorithm=layout.ATLAS)))
    top = [r["id"] for r in graph.degrees(*drawn).orderBy(F.desc("degree"), "id").limit(20).collect()]
    assert {n["text"].split("\n")[0][2:] for n in document["nodes"]} == set(top)


def test_pushes():
    n = 40
    x, y = [0.0] * n, [float(i % 3) for i in range(n)]
    layout.push_apart([f"n{i}" for i in range(n)], x, y, [400] * n, [200] * n, [i % 4 for i in range(n)], layout.Settings())
    assert not any(abs(x[i] - x[j]) < 440 and abs(y[i] - y[j]) < 240 for i in range(n) for j in range(i))
    x, y = [0.0, 100.0], [0.0, 0.0]
    layout.push_apart(["hub", "leaf"], x, y, [400, 400], [200, 200], [9, 0], layout.Settings())
    assert abs(y[0]) < abs(y[1]) and x == [0.0, 100.0]
    few, at = layout.Settings(passes=0), ([0.0, 10.0, 450.0], [0.0, 0.0, 0.0])
    layout.push_apart(["a", "b", "c"], *at, [400] * 3, [200] * 3, [0, 0, 0], few)
    assert at[0] == [0.0, 441.0, 882.0]


def test_scale_and_turn():
    at = np.array([[0.0, 0.0], [1.0, 3.0]])
    assert layout.landscape(at).tolist() == [[0, 0], [3, 1]] and layout.landscape(at[:, ::-1]).tolist() == [[0, 0], [3, 1]]
    width, height = np.array([400, 400]), np.array([160, 260])
    area = 2.2 * (440 * 200 + 440 * 300)
    assert layout.pixel_scale(at, width, height, layout.Settings()) == pytest.approx((area / 3) ** 0.5)
    assert layout.pixel_scale(at * [1, 0], width, height, layout.Settings()) == pytest.approx(area**0.5)
    assert layout.pixel_scale(at[:1], width[:1], height[:1], layout.Settings()) == 0
    unit = layout.forces(30, np.array([[i, i + 1] for i in range(29)]), layout.Settings())
    assert np.abs(unit).max() == pytest.approx(1) and (unit == layout.forces(30, np.array([[i, i + 1] for i in range(29)]), layout.Settings())).all()
    for bad in ({"grid": 50}, {"algorithm": "circle"}):
        with pytest.raises(ValueError):
            layout.Settings(**bad)


def test_shelves(spark):
    boxes = pd.DataFrame({"component": ["a", "b", "c", "d"], "width": [100.0, 300.0, 100.0, 100.0], "height": [100.0, 200.0, 100.0, 50.0]})
    got = layout.shelves(boxes, 10).set_index("component")
    assert got.loc["b"].tolist() == [0, 0] and got.loc["a"].tolist() == [0, 210] and got.loc["c"].tolist() == [110, 210] and got.loc["d"].tolist() == [220, 210]
    assert sorted(map(tuple, layout.pack(spark.createDataFrame(boxes), 10).collect())) == [("a", 0, 210), ("b", 0, 0), ("c", 110, 210), ("d", 220, 210)]


def test_salted(spark):
    keys = spark.createDataFrame([(k, i) for i, k in enumerate(["aa", "ab", "b", "ac"])], "key string, rank int")
    first = lambda c: F.concat(F.left(c, F.lit(1)), F.coalesce(F.regexp_extract(c, "#(.*)", 1), F.lit("")))
    assert {r["key"]: r["id"] for r in layout.salted_ids(keys, first).collect()} == {"aa": "a", "ab": "a1", "ac": "a2", "b": "b"}
