"""A working folder from documents to a canvas, by the session and by the command line."""

import json

import pytest

from folioforge.__main__ import looks_up, parser, run
from folioforge.functions import sql
from folioforge.session import Config, Session

LONG = "Sparse Attention Routing for Retrieval-Augmented Generation"
A = f"""Title: {LONG}
Authors: Elena Marchetti, Kwame Mensah
Year: 2024
Venue: EMNLP 2024
DOI: 10.0000/synthetic.2024.001
Affiliations: Politecnico di Torino
References: Attention Is All You Need

Sparse Attention Routing was evaluated on NarrativeQA.
"""
B = f"""Title: Routing Ablations for Retrieval-Augmented Generation
Authors: E. Marchetti, Sofia Lindqvist
Venue: emnlp 2024
References: {LONG} (2024); Attention is all you need (2017)

This note revisits Sparse Attention Routing.
"""
WORDS = (("Sparse Attention Routing", "Method", "A routing method"), ("NarrativeQA", "Dataset", "A dataset"))
RELATIONS = (("Sparse Attention Routing", "NarrativeQA", "evaluated on", "Sparse Attention Routing was evaluated on NarrativeQA"),)


@pytest.fixture(scope="module")
def work(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("work")
    data = at / "data"
    data.mkdir()
    (data / "a.md").write_text(A)
    (data / "c.bin").write_text("x")
    session = Session(spark, Config(str(at / "store"), str(data), str(at / "g.canvas")), dictionary=WORDS, relations=RELATIONS)
    first = session.ingest()
    (data / "b.md").write_text(B)
    (data / "copy.md").write_text(A)
    return at, session, first, session.ingest()


def test_ingest(work):
    _, session, first, second = work
    assert (first.ingested, first.skipped, first.known) == (["a.md"], [("c.bin", "unsupported")], 0)
    assert second.ingested == ["b.md"] and second.known == 2
    nodes = {r["id"]: r for r in session.table("nodes").collect()}
    assert nodes[LONG]["entity_type"] == "paper" and f"{LONG} (2024)" not in nodes and "E. Marchetti" not in nodes and "emnlp 2024" not in nodes
    assert nodes["NarrativeQA"]["entity_type"] == "Dataset" and nodes["Kwame Mensah"]["description"] == f"Author of '{LONG}'."
    edges = {frozenset((r["src"], r["tgt"])): r["keywords"] for r in session.table("edges").collect()}
    b = "Routing Ablations for Retrieval-Augmented Generation"
    assert edges[frozenset((b, LONG))] == "cites" and edges[frozenset((b, "Elena Marchetti"))] == "authored_by" and edges[frozenset(("Sparse Attention Routing", "NarrativeQA"))] == "evaluated on"
    assert all(e <= set(nodes) for e in edges)
    known = {r["name"]: r for r in session.table("registry").collect()}
    assert known[LONG]["aliases"] == [f"{LONG} (2024)"] and "E. Marchetti" in known["Elena Marchetti"]["aliases"]


def test_query_and_export(spark, work, capsys):
    at, session, _, _ = work
    lines = session.query(["Who worked on Sparse Attention Routing?"], ["hybrid", "mix"])
    assert lines[0] == "=== mode=hybrid ok=True ===" and lines[1].startswith("Q: Who") and lines[7].endswith("chunks") and not lines[7].endswith(" 0 chunks")
    flags = ["--working-dir", str(at / "store"), "--data-dir", str(at / "data")]
    assert run(spark, [*flags, "export", "--out", str(at / "x.canvas"), "--max-nodes", "8"]) == 0
    assert "OK: 0 error(s)" in capsys.readouterr().out and len(json.loads((at / "x.canvas").read_text())["nodes"]) == 8
    (at / "bad.canvas").write_text('{"nodes": [], "edges": [1]}')
    assert run(spark, ["verify", str(at / "bad.canvas")]) == 1
    assert run(spark, [*flags, "reconcile"]) == 0 and "merges applied: 0" in capsys.readouterr().out
    with pytest.raises(SystemExit):
        run(spark, ["--backend", "live", "ingest"])


def test_settings(monkeypatch):
    monkeypatch.setenv("DATA_DIR", "elsewhere")
    monkeypatch.setenv("METADATA_LOOKUP", "0")
    config = Config().with_overrides(working_dir="w", canvas_path=None)
    assert (config.data_dir, config.working_dir, config.canvas_path) == ("elsewhere", "w", "./output/knowledge_graph.canvas")
    assert [looks_up(b, c, config) for b, c in (("live", "auto"), ("stub", "on"), ("live", "off"))] == [False, True, False]
    assert parser().parse_args(["all", "Why?", "--mode", "mix"]).question == ["Why?"]


def test_sql_functions(spark):
    sql.register(spark)
    row = spark.sql("select norm_doi('See https://doi.org/10.1000/ABC.)') as d, norm_title_ascii('A  Title (2017)!') as t, canvas_id('node:x') as c, person_compatible(struct(p.family, p.folded), struct(q.family, q.folded)) as fits from (select parse_person('E. Marchetti') as p, parse_person('Elena Marchetti') as q)").first()
    assert (row["d"], row["t"], row["fits"]) == ("10.1000/abc", "a title", True) and len(row["c"]) == 16
    assert [r[0] for r in spark.sql("select * from title_words('a b')").collect()] == ["a", "b"]
