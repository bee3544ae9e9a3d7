"""Overlaps of boxes against plain loops, with cells that are dealt into chunks."""

import random

import pytest

from folioforge.operators import graph


@pytest.mark.parametrize("by", [(), ("path",)])
def test_box_overlaps(spark, by, monkeypatch):
    monkeypatch.setattr(graph, "CHUNK_BOXES", 3)
    monkeypatch.setattr(graph, "STRIP", 2)
    rng = random.Random(4)
    rows = [(rng.choice("pq"), f"n{i}", float(rng.randint(-60, 300)), float(rng.randint(-60, 200)), float(rng.randint(0, 90)), float(rng.randint(0, 90))) for i in range(120)]
    rows += [("p", "n5", 10.0, 10.0, 50.0, 50.0), (None, "m", 0.0, 0.0, 90.0, 90.0), ("q", None, 0.0, 0.0, 90.0, 90.0), ("q", "z", None, 0.0, 90.0, 90.0)]
    frame = spark.createDataFrame(rows, "path string, id string, x double, y double, width double, height double")
    got = graph.box_overlaps(frame, cell=70, gap=5, by=by)
    assert got.columns == [*by, "a", "b"] and got.schema["a"].dataType == frame.schema["id"].dataType
    meets = lambda p, q: all(v is not None for v in (p[1], q[1], p[2], q[2])) and p[1] < q[1] and (not by or p[0] == q[0] is not None) and all(p[k] < q[k] + q[k + 2] + 5 and q[k] < p[k] + p[k + 2] + 5 for k in (2, 3))
    expected = sorted((*((p[0],) if by else ()), p[1], q[1]) for p in rows for q in rows if meets(p, q))
    assert sorted(map(tuple, got.collect())) == expected and len(expected) > 300
    assert not graph.box_overlaps(frame.limit(0), by=by).collect()
