"""Canvas documents: checks of their structure, identifiers, geometry and references.

A document is parsed to a VARIANT, which tells 1 from 1.0 and true, and an absent key from null. Nodes
and edges of all documents are rows, so that one large document is checked in parallel, too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.graph import box_overlaps

# fixed values of the canvas format
NODE_TYPES = ("text", "file", "link", "group")
SIDES = ("top", "right", "bottom", "left")
ENDS = ("none", "arrow")
COLOR = r"^([1-6]|#[0-9A-Fa-f]{6})$"
HEX16 = r"^[0-9a-f]{16}$"
GEOMETRY = ("x", "y", "width", "height")
CONTENT = {"text": "text", "file": "file", "link": "url"}


def _get(name: str, at: str = "value") -> Column:
    return F.try_variant_get(at, f"$.{name}", "variant")


def _is(name: str, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(_get(name)) == kind, F.lit(False))


def _text(name: str) -> Column:
    return F.when(_is(name, "STRING"), F.try_variant_get("value", f"$.{name}", "string"))


def _number(name: str) -> Column:
    return F.when(_is(name, "BIGINT"), F.try_variant_get("value", f"$.{name}", "long"))


def _bad_text(name: str, fits: Column) -> Column:
    """The key is there and has no string that fits."""
    return _get(name).isNotNull() & ~F.coalesce(fits, F.lit(False))


def _items(docs: DataFrame, name: str) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.where(F.startswith(F.schema_of_variant(_get(name, "v")), F.lit("ARRAY")))
    rows = rows.lateralJoin(spark.tvf.variant_explode(F.try_variant_get(F.col("v").outer(), f"$.{name}", "variant")))
    return rows.select("path", F.col("pos").cast("long").alias("pos"), "value", F.coalesce(F.startswith(F.schema_of_variant("value"), F.lit("OBJECT")), F.lit(False)).alias("object"))


def _report(rows: DataFrame, part: str, rules: dict[str, Column]) -> DataFrame:
    broken = F.array_compact(F.array(*(F.when(when, F.lit(rule)) for rule, when in rules.items())))
    found = F.when(F.col("object"), broken).otherwise(F.array(F.lit("not_object")))
    return rows.select("path", F.lit(part).alias("part"), "pos", F.explode(found).alias("rule"))


def verify(files: DataFrame, require_hex16: bool = True, forbid_overlap: bool = True) -> DataFrame:
    """Violations in canvas documents ``files`` (path, content): path, part (document, nodes or edges), pos
    (null for the document), rule, severity (error or warning) and n, 1 but for overlaps: the number of pairs.

    Text that is no JSON, or null, is one error. Of rows with one id the later ones are duplicates; an
    edge may not have a node's id either. Paths should be distinct."""
    docs = files.select("path", F.try_parse_json("content").alias("v"))
    top = F.schema_of_variant("v")
    is_object = F.coalesce(F.startswith(top, F.lit("OBJECT")), F.lit(False))
    listed = lambda name: F.coalesce(F.startswith(F.schema_of_variant(_get(name, "v")), F.lit("ARRAY")), F.lit(False))
    none = lambda name: listed(name) & _get(f"{name}[0]", "v").isNull()
    whole = F.when(F.col("v").isNull(), F.array(F.lit("unreadable"))).when(~is_object, F.array(F.lit("not_object"))).otherwise(F.array_compact(F.array(*(F.when(~listed(n), F.lit(f"{n}_not_array")) for n in ("nodes", "edges")), *(F.when(none(n), F.lit(f"{n}_empty")) for n in ("nodes", "edges")))))
    report = docs.select("path", F.lit("document").alias("part"), F.lit(None).cast("long").alias("pos"), F.explode(whole).alias("rule"))

    nodes = _items(docs, "nodes").withColumn("id", F.nullif(_text("id"), F.lit("")))
    nodes = nodes.withColumn("before", F.row_number().over(Window.partitionBy("path", "id").orderBy("pos")))
    kind = _text("type")
    rules = {"id_missing": F.col("id").isNull(), "id_duplicate": F.col("id").isNotNull() & (F.col("before") > 1)}
    rules |= {"id_not_hex16": ~F.col("id").rlike(HEX16)} if require_hex16 else {}
    rules["type_invalid"] = ~F.coalesce(kind.isin(*NODE_TYPES), F.lit(False))
    rules |= {f"{g}_not_integer": ~_is(g, "BIGINT") for g in GEOMETRY}
    rules |= {f"{g}_not_positive": _number(g) <= 0 for g in ("width", "height")}
    rules |= {f"{field}_missing": (kind == of) & ~_is(field, "STRING") for of, field in CONTENT.items()}
    rules["color_invalid"] = _bad_text("color", _text("color").rlike(COLOR)) & ~_is("color", "VOID")
    report = report.unionByName(_report(nodes, "nodes", rules))

    edges = _items(docs, "edges").withColumn("id", F.nullif(_text("id"), F.lit("")))
    edges = edges.withColumn("before", F.row_number().over(Window.partitionBy("path", "id").orderBy("pos")))
    ids = nodes.where("id is not null").select("path", "id").distinct()
    for column, name in (("id", "id"), ("fromNode", "start"), ("toNode", "end")):
        # an empty endpoint names no node, so that null stands for both
        edges = edges.withColumn(name, F.nullif(_text(column), F.lit(""))).join(ids.select("path", F.col("id").alias(name), F.lit(True).alias(f"{name}_known")), ["path", name], "left")
    known = lambda name: F.coalesce(F.col(f"{name}_known"), F.lit(False))
    rules = {"id_missing": F.col("id").isNull(), "id_duplicate": F.col("id").isNotNull() & ((F.col("before") > 1) | known("id"))}
    rules |= {"id_not_hex16": ~F.col("id").rlike(HEX16)} if require_hex16 else {}
    for field, name in (("fromNode", "start"), ("toNode", "end")):
        rules |= {f"{field}_not_string": ~_is(field, "STRING"), f"{field}_unknown": _is(field, "STRING") & ~known(name)}
    rules |= {f"{field}_invalid": _bad_text(field, _text(field).isin(*fits)) for field, fits in (("fromSide", SIDES), ("toSide", SIDES), ("fromEnd", ENDS), ("toEnd", ENDS))}
    rules |= {"color_invalid": _bad_text("color", _text("color").rlike(COLOR)), "label_not_string": _get("label").isNotNull() & ~_is("label", "STRING")}
    report = report.unionByName(_report(edges, "edges", rules))
    severity = F.when(F.col("rule").isin("nodes_empty", "edges_empty"), "warning").otherwise("error")
    report = report.withColumns({"severity": severity, "n": F.lit(1).cast("long")})

    boxes = nodes.where(F.col("object") & _is("id", "STRING")).select("path", F.col("pos").alias("id"), *(_number(g).alias(g) for g in GEOMETRY)).dropna()
    pairs = box_overlaps(boxes, by=("path",)).groupBy("path").agg(F.count(F.lit(1)).alias("n"))
    return report.unionByName(pairs.select("path", F.lit("document").alias("part"), F.lit(None).cast("long").alias("pos"), F.lit("overlap").alias("rule"), F.lit("error" if forbid_overlap else "warning").alias("severity"), "n"))
