"""Every query with SQL, side by side with DuckDB over the smallest tables; and fixed literals."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.components import connected_components
from folioforge.plans.registry import ORACLES, QUERIES, WITHOUT_SQL

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(SF):
        con.execute(f"create view {name.split('.')[0]} as select * from '{SF}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(WITHOUT_SQL)))
def test_query(spark, duck, tmp_path, name):
    QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    assert name in ORACLES
    columns = ", ".join(f'"{c[0]}"' for c in sorted(duck.execute(f"describe select * from '{tmp_path}/out/*.parquet'").fetchall()))
    ours, theirs = f"select {columns} from '{tmp_path}/out/*.parquet'", f"select {columns} from ({ORACLES[name]})"
    for a, b in ((ours, theirs), (theirs, ours)):
        assert duck.execute(f"select count(*) from (({a}) except all ({b}))").fetchall() == [(0,)]


def test_literals(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    for said, doi in (("https://doi.org/10.1000/ABC.123.", "10.1000/abc.123"), ("doi:10.1000/xyz", "10.1000/xyz"), ("Some title. 10.1000/in-text)", "10.1000/in-text"), ("no doi here", None), (None, None)):
        assert value(T.normalize_doi(F.lit(said).cast("string"))) == doi
    assert value(T.normalize_text(F.lit("Müller, Ｇraph—RAG"))) == "m ller graph rag"
    assert value(T.normalize_title(F.lit("Attention Is All You Need (2017)."))) == "attention is all you need"
    assert value(T.clean_string(F.lit(" 'A Study' "))) == "A Study"
    assert value(T.clean_list(F.array(*map(F.lit, ["Ada Lovelace", "ada lovelace", "", "Alan Turing"])))) == ["Ada Lovelace", "Alan Turing"]
    assert value(T.coerce_year(F.lit("Published in 2024."))) == 2024 and value(T.coerce_year(F.lit("1200"))) is None
    assert value(T.header_fields(F.lit("**Title:** A b \nYear: 1\nYear: 2"))) == {"title": "A b", "year": "2"}


def test_people(spark):
    assert T.person_parts("Marchetti, Elena")["person_key"] == T.person_parts("Elena Marchetti")["person_key"]
    assert T.person_parts("E.M. Marchetti")["given"] == ["E", "M"] and T.person_parts("Ludwig van Beethoven")["family"] == "van beethoven"
    assert T.person_parts("Plato")["given"] == [] and T.person_parts("") is None and T.person_parts("John Smith (Other University)")["family"] == "smith"
    names = spark.createDataFrame([("E. M. Marchetti", "Elena Marchetti", True), ("Eva Marchetti", "Elena Marchetti", False), ("K. Marchetti", "E. Marchetti", False)], "a string, b string, fits boolean")
    got = names.select("fits", T.parse_person("a").alias("pa"), T.parse_person("b").alias("pb"))
    assert all(r[0] == r[1] for r in got.select("fits", T.persons_compatible(F.col("pa"), F.col("pb"))).collect())


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 200), (200, 300), (7, 7), (None, 3)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100}
