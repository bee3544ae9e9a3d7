"""Profiles, look-ups with their cache, and the policy of enrichment, on literals."""

import json

from folioforge.operators import enrich, kg

ATTENTION, DOI = "Attention Is All You Need", "10.5555/attention"


def work(number, title, doi=None, year=2017, authors=("Ashish Vaswani", "Noam Shazeer"), refs=()):
    people = [{"author": {"id": f"https://openalex.org/a{i}", "display_name": a}, "institutions": [{"id": "https://openalex.org/i1", "display_name": "Google (United States)"}]} for i, a in enumerate(authors)]
    return json.dumps({"id": f"https://openalex.org/W{number}", "doi": doi and f"https://doi.org/{doi}", "title": title, "publication_year": year, "authorships": people, "primary_location": {"source": {"display_name": "NIPS"}}, "referenced_works": [f"https://openalex.org/W{r}" for r in refs]})


def deposit(title, doi, family="Marchetti"):
    return json.dumps({"DOI": doi, "title": [title], "author": [{"given": "Elena", "family": family}], "issued": {"date-parts": [[2020]]}, "reference": [{"article-title": "Old Work", "DOI": "10.5555/old"}]})


def record(doc, title, authors=(), doi=None, references=(), houses=(), year=None, dois=None):
    return (doc, 1, f"{doc}.md", title, list(authors), year, None, doi, list(houses), list(references), None, None, None, dois, None, None)


def frames(spark, records, a, b=()):
    return spark.createDataFrame(records, kg.RECORD), spark.createDataFrame([(x,) for x in a], "json string"), spark.createDataFrame([(x,) for x in b], "json string")


def test_policy(spark):
    given = record("d", "Attention is all you need", ["A. Vaswani"], DOI.upper(), ["Long short-term memory", "Some In-Text Reference", "attention is ALL you need"], ["Google"])
    nmt = "Neural Machine Translation by Jointly Learning to Align and Translate"
    records, a, b = frames(spark, [given], [work(1, ATTENTION, DOI, refs=(3, 2, 9, 4)), work(2, "Long Short-Term Memory", "10.5555/lstm"), work(3, nmt, "10.5555/nmt"), work(4, "One Too Many")])
    works, cache = enrich.resolve(records, a, b)
    r = enrich.enrich(records, works, most=3).first()
    assert r["title"] == ATTENTION and r["authors"] == ["Ashish Vaswani", "Noam Shazeer"] and (r["year"], r["doi"], r["venue"]) == (2017, DOI, "NIPS")
    assert r["affiliations"] == ["Google", "Google (United States)"] and [tuple(x) for x in r["author_affiliations"]][0] == ("Ashish Vaswani", ["Google (United States)"])
    assert r["references"] == ["Long short-term memory", "Some In-Text Reference", nmt]
    assert r["reference_dois"] == {"Long short-term memory": "10.5555/lstm", nmt: "10.5555/nmt"}
    assert (r["catalogue_id"], r["metadata_source"]) == ("W1", "openalex") and r["author_ids"]["Noam Shazeer"] == ["openalex:A1"]
    assert [tuple(c)[:2] for c in cache.collect()] == [(f"doi:{DOI}", True)]


def test_forced_above_the_cap(spark):
    own = [f"Own work number {i}" for i in range(5)]
    records, a, b = frames(spark, [record("d", ATTENTION, doi=DOI, references=own, dois={own[1]: "10.5555/one"})], [work(1, ATTENTION, DOI, refs=(2, 3)), work(2, "own WORK number 4", "10.5555/four"), work(3, "Another")])
    r = enrich.enrich(records, enrich.resolve(records, a, b)[0], most=3).first()
    assert r["references"] == own and r["reference_dois"] == {own[1]: "10.5555/one", own[4]: "10.5555/four"}


def test_fallback_and_cache(spark):
    records, a, b = frames(
        spark,
        [record("a", "Graph Attention for Scholars", ["Elena Marchetti"]), record("b", "Nowhere To Be Found"), record("c", ATTENTION, ["Noam Shazeer"], year=2017), record("e", "Another Title", doi="10.5555/GRAPH")],
        [work(1, ATTENTION, DOI), work(2, ATTENTION, None, 1999, ("Someone Else",))],
        [deposit("Graph attention for scholars.", "10.5555/graph")],
    )
    works, cache = enrich.resolve(records, a, b)
    got = {r["doc_id"]: r["work"] for r in works.collect()}
    assert set(got) == {"a", "c", "e"} and got["a"]["source"] == "crossref" and got["a"]["matched_by"] == "title" and got["c"]["work_id"] == "W1" and got["e"]["matched_by"] == "doi"
    assert [tuple(x) for x in got["a"]["references"]] == [("Old Work", "10.5555/old")]
    assert {r["key"]: r["found"] for r in cache.collect()} == {"title:graph attention for scholars": True, "title:nowhere to be found": False, "title:attention is all you need": True, "doi:10.5555/graph": True}
    nothing = spark.createDataFrame([], "json string")
    again, after = enrich.resolve(records, nothing, nothing, cache)
    assert {r["doc_id"] for r in again.collect()} == set(got) and after.count() == 4
    kept = {r["doc_id"]: r for r in enrich.enrich(records, works).collect()}
    assert kept["e"]["title"] == "Graph attention for scholars." and tuple(kept["b"]) == tuple(records.where("doc_id = 'b'").first())
    weak = works.where("doc_id = 'a'").selectExpr("doc_id", "named_struct('title', 'Graph Attention', " + ", ".join(f"'{c}', work.{c}" for c in works.schema["work"].dataType.names[1:]) + ") as work")
    assert enrich.enrich(records.where("doc_id = 'a'"), weak).first()["title"] == "Graph Attention for Scholars"


def test_profile(spark):
    said = [
        ('{"title": " \'A Study\' ", "authors": ["Ada Lovelace", "ada lovelace", "", null, "Alan Turing"], "year": "Published in 2024.", "affiliations": "MIT", "references": ["A Study", "a study", "X", "x"]}', "t"),
        ('```json\n{"title": "B", "year": 1200, "authors": {"a": 1}, "venue": 7}\n```', "t"),
        ('Here it is: {"year": true, "references": [1, 2.5]} as asked', "# Heading\nrest"),
        ("no json", "\n\n"), (None, "First line"), ("[1]", "Line"), ('{"year": 1999, "doi": " 10.1/x "}', "q"),
    ]
    rows = enrich.profile(spark.createDataFrame([(i, j, t, f"file{i}.md") for i, (j, t) in enumerate(said)], "i int, json string, text string, file_path string")).orderBy("i").collect()
    a = rows[0]
    assert (a["title"], a["authors"], a["year"], a["affiliations"], a["references"]) == ("A Study", ["Ada Lovelace", "Alan Turing"], 2024, ["MIT"], ["X"])
    assert (rows[1]["title"], rows[1]["year"], rows[1]["authors"], rows[1]["venue"]) == ("B", None, [], "7")
    assert (rows[2]["title"], rows[2]["year"], rows[2]["references"]) == ("Heading", None, ["1", "2.5"])
    assert [r["title"] for r in rows[3:6]] == ["file3", "First line", "Line"] and (rows[6]["year"], rows[6]["doi"]) == (1999, "10.1/x")
