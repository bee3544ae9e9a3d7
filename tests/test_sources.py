"""Canvas checks, files, GraphML and streaming ingestion on small literals."""

import json

import pytest
from pyspark.sql import functions as F

from folioforge.operators import canvas, catalogue
from folioforge.sources.files import read_canvases, read_documents, read_graphml
from folioforge.sources.pdf import pdf_text
from folioforge.streaming.ingest import ingest

ID = ("a" * 16, "b" * 16, "c" * 16)


def good():
    box = lambda i, x: {"id": i, "type": "text", "text": "t", "x": x, "y": 0, "width": 400, "height": 200, "color": "1"}
    return {"nodes": [box(ID[0], 0), box(ID[1], 400)], "edges": [{"id": ID[2], "fromNode": ID[0], "toNode": ID[1], "fromSide": "right", "toEnd": "arrow", "label": "x", "color": "4"}]}


def faulty():
    def case(change, *rules):
        c = good()
        change(c)
        return json.dumps(c), sorted(rules)

    node, edge = lambda **k: lambda c: c["nodes"][1].update(k), lambda **k: lambda c: c["edges"][0].update(k)
    yield json.dumps(good()), []
    yield "no json", ["unreadable"]
    yield None, ["unreadable"]
    yield "[1]", ["not_object"]
    yield "{}", ["edges_not_array", "nodes_not_array"]
    yield '{"nodes": {"a": 1}, "edges": []}', ["edges_empty", "nodes_not_array"]
    yield '{"nodes": [], "edges": [3]}', ["nodes_empty", "not_object"]
    yield case(node(id=ID[0]), "id_duplicate", "toNode_unknown")
    yield case(node(id=7), "id_missing", "toNode_unknown")
    yield case(node(id=""), "id_missing", "toNode_unknown")
    yield case(node(type=["text"]), "type_invalid")
    yield case(node(x=400.0), "x_not_integer")
    yield case(node(y=True), "y_not_integer")
    yield case(node(width=0), "width_not_positive")
    yield case(node(height=-1), "height_not_positive")
    yield case(node(text=None), "text_missing")
    yield case(node(type="link"), "url_missing")
    yield case(node(color=None))
    yield case(node(color="#12345"), "color_invalid")
    yield case(node(x=399), "overlap")
    yield case(edge(id=ID[0]), "id_duplicate")
    yield case(edge(id="e1"), "id_not_hex16")
    yield case(edge(toNode=None), "toNode_not_string")
    yield case(edge(fromNode="x"), "fromNode_unknown")
    yield case(edge(fromSide="middle", toSide=None), "fromSide_invalid", "toSide_invalid")
    yield case(edge(color=None, label=3), "color_invalid", "label_not_string")


def test_canvas(spark):
    cases = list(faulty())
    files = spark.createDataFrame([(str(i), c) for i, (c, _) in enumerate(cases)], "path string, content string")
    got = {}
    for r in canvas.verify(files).collect():
        got.setdefault(int(r["path"]), []).append(r["rule"])
    assert {i: sorted(got.get(i, [])) for i in range(len(cases))} == dict(enumerate(rules for _, rules in cases))
    loose = canvas.verify(files, require_hex16=False, forbid_overlap=False)
    assert loose.where("rule = 'id_not_hex16'").count() == 0 and loose.where("rule = 'overlap'").first()["severity"] == "warning"
    assert canvas.verify(files.limit(0)).count() == 0


def test_candidates(spark):
    record = [(1, "Graph Attention for Scholarly Knowledge", 2020, ["Elena Marchetti"])]
    cases = [("Graph Attention for Scholarly Knowledges", 2020, ["Marchetti, E."], True), ("Another Title Altogether", 2020, ["Elena Marchetti"], False), (record[0][1], 2020, ["Ada Lovelace"], False), (record[0][1], 2010, [], False), (record[0][1], 2010, ["E. Marchetti"], True), (record[0][1], None, None, True)]
    for i, (title, year, authors, fits) in enumerate(cases):
        found = spark.createDataFrame([(1, i, title, year, authors)], "record_id int, ordinal int, title string, year int, authors array<string>")
        assert catalogue.pick_candidates(spark.createDataFrame(record, "record_id int, title string, year int, authors array<string>"), found).count() == fits, title


def test_broken_works(spark):
    rows = spark.createDataFrame([(1, None), (2, "no json"), (3, "{}")], "k int, json string")
    for parse in (catalogue.open_works, catalogue.deposit_works):
        assert [(r["title"], r["authors"], r["author_ids"]) for r in parse(rows).collect()] == [("", [], {})] * 3


@pytest.fixture
def folder(tmp_path):
    at = tmp_path / "in"
    at.mkdir()
    (at / "a.txt").write_bytes(b"one\r\ntwo \xff")
    (at / "b.MD").write_text("three")
    (at / "c.md").write_text(" \n")
    (at / "d.bin").write_text("x")
    return at


def test_documents(spark, folder):
    got = {r["path"][-5:]: (r["text"], r["status"]) for r in read_documents(spark, str(folder)).collect()}
    assert got == {"a.txt": ("one\ntwo �", "ok"), "/b.MD": ("three", "ok"), "/c.md": (" \n", "empty"), "d.bin": (None, "unsupported")}


def test_ingest(spark, folder, tmp_path):
    held = []
    for extra in (None, "three", "four"):
        if extra:
            (folder / f"{extra}.txt").write_text(extra)
        query = ingest(spark, str(folder), str(tmp_path / "ledger"), str(tmp_path / "state"))
        query.awaitTermination()
        assert query.exception() is None
        held.append(spark.read.parquet(str(tmp_path / "ledger")).select("doc_id").count())
    assert held == [2, 2, 3]


def test_graphml(spark, tmp_path):
    (tmp_path / "g.graphml").write_text('<graphml><key id="d0" for="node" attr.name="entity_type" attr.type="string"/><key id="d1" for="edge" attr.name="weight" attr.type="double"/><graph edgedefault="undirected"><node id="A"><data key="d0">Paper</data></node><node id="B"/><edge source="A" target="B"><data key="d1">2.0</data></edge></graph></graphml>')
    nodes, edges = read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: r["attributes"] for r in nodes.collect()} == {"A": {"entity_type": "Paper"}, "B": {}}
    assert [tuple(r) for r in edges.select("src", "tgt", F.col("attributes")["weight"]).collect()] == [("A", "B", "2.0")]


def pdf(*pages, flate=True):
    import zlib

    out, kids, number = [b"%PDF-1.4\n"], [], 10
    for text in pages:
        shown = b"BT /F1 12 Tf 72 700 Td (" + text.encode("cp1252").replace(b"(", b"\\(").replace(b")", b"\\)") + b") Tj ET" if text is not None else b""
        data = zlib.compress(shown) if flate else shown
        out.append(b"%d 0 obj << /Length %d %s >> stream\n%s\nendstream endobj\n" % (number + 1, len(data), b"/Filter /FlateDecode" if flate else b"", data))
        out.append(b"%d 0 obj << /Type /Page /Parent 2 0 R /Contents %d 0 R >> endobj\n" % (number, number + 1))
        kids.append(number)
        number += 2
    out.append(b"2 0 obj << /Type /Pages /Kids [%s] /Count %d >> endobj\n" % (b" ".join(b"%d 0 R" % k for k in kids[::-1]), len(kids)))
    return b"".join([*out, b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj\ntrailer << /Root 1 0 R >>\n%%EOF"])


def test_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf("Second (page)", None, "First é page", flate=True))
    (tmp_path / "b.PDF").write_bytes(pdf("Plain", flate=False))
    (tmp_path / "c.pdf").write_bytes(b"no pdf at all")
    (tmp_path / "d.pdf").write_bytes(pdf(None))
    (tmp_path / "e.txt").write_text("text")
    rows = read_documents(spark, str(tmp_path)).collect()
    assert [(r["path"][-5:], r["text"], r["status"]) for r in rows] == [("a.pdf", "First é page\n\nSecond (page)", "ok"), ("b.PDF", "Plain", "ok"), ("c.pdf", None, "unreadable"), ("d.pdf", "", "empty"), ("e.txt", "text", "ok")]
    assert pdf_text(b"%PDF-1.4 /Encrypt") is None and pdf_text(b"%PDF-1.5\n5 0 obj << /Type /Pages /Kids [6 0 R] >> endobj 6 0 obj << /Type /Page /Contents 7 0 R >> endobj 7 0 obj << >> stream\nBT <48656C6C6F> Tj T* [(wo) -20 (rld)] TJ ET\nendstream endobj") == "Hello\nworld"


def test_missing_folder(spark, tmp_path):
    with pytest.warns(UserWarning, match="no folder"):
        assert read_documents(spark, f"{tmp_path}/nowhere").count() == 0


def test_graphml_again(spark, tmp_path):
    """A node in two files and parallel edges: what is said last holds."""
    head = '<graphml><key id="d0" for="node" attr.name="entity_type"/><key id="d1" for="edge" attr.name="weight"/><graph>'
    (tmp_path / "a.graphml").write_text(head + '<node id="A"><data key="d0">Paper</data></node><edge source="A" target="B"><data key="d1">1</data></edge><edge source="A" target="B"><data key="d1">2</data></edge></graph></graphml>')
    (tmp_path / "b.graphml").write_text(head + '<node id="A"><data key="d0">Author</data></node><node id="B"/></graph></graphml>')
    nodes, edges = read_graphml(spark, str(tmp_path))
    assert {r["id"]: r["attributes"] for r in nodes.collect()} == {"A": {"entity_type": "Author"}, "B": {}}
    assert [r["attributes"] for r in edges.collect()] == [{"weight": "2"}]


def test_canvas_files(spark, tmp_path):
    (tmp_path / "good.canvas").write_text(json.dumps(good()))
    (tmp_path / "bad.canvas").write_bytes(b"\xff\xfe")
    found = canvas.verify(read_canvases(spark, str(tmp_path))).collect()
    assert [(r["path"][-10:], r["rule"]) for r in found] == [("bad.canvas", "unreadable")]
