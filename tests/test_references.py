"""Merged references side by side with a plain version of JON-07."""

import duckdb

from folioforge.functions import text as T
from folioforge.operators import catalogue
from folioforge.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"


def merged(title, own, more, most):
    out, seen = [], {T.fold_text(title), ""}
    for labels, force in ((own, True), (more, False)):
        for label in labels:
            norm = T.fold_text(label)
            if norm not in seen and (force or len(out) < most):
                seen.add(norm)
                out.append(label)
    return out


def test_ref_merge_cap(spark):
    rows = duckdb.sql(f"select o_orderkey, o_custkey, l_linenumber, p_name from '{SF}/orders.parquet' left join '{SF}/lineitem.parquet' on l_orderkey = o_orderkey left join '{SF}/part.parquet' on p_partkey = l_partkey order by 1, 3, 4").fetchall()
    own, works = {}, {}
    for order, customer, _, part in rows:
        own.setdefault((order, customer), [])
        if part is not None and f"part:{part}" not in own[order, customer]:
            own[order, customer].append(f"part:{part}")
    for (order, customer), refs in own.items():
        works.setdefault(customer, []).append((order, refs))
    want = {}
    for (order, customer), refs in own.items():
        want[f"doc-{order}"] = merged(f"order:{order}", refs, [x for o, other in works[customer] if o != order for x in other], 5)
    got = {r["doc_id"]: (r["references"], r["n"]) for r in QUERIES["ref_merge_cap"](spark, SF).collect()}
    assert got == {k: ("|".join(v), len(v)) for k, v in want.items()} and max(n for _, n in got.values()) > 5


def test_merge_references(spark):
    records = [("a", "k", "A Title", ["One", "a title!", "two", "ONE.", "", "Three", "four", "five", "six"]), ("b", "k", "Zwei", ["Two"]), ("c", "none", "x", ["y"]), ("d", None, "x", [])]
    works = [("k", i, label) for i, label in enumerate(["zwei", "TWO", "Seven (2001)", "seven", "eight", "-", "nine", "ten", "eleven"])]
    got = catalogue.merge_references(spark.createDataFrame(records, "doc_id string, key string, title string, references array<string>"), spark.createDataFrame(works, "key string, place int, label string")).collect()
    assert {r["doc_id"]: r["references"] for r in got} == {"a": ["One", "two", "Three", "four", "five", "six"], "b": ["Two", "Seven (2001)", "eight", "nine", "ten"], "c": ["y"], "d": []}
