"""A graph as a canvas document: cards with texts, colours and places, and oriented edges between their sides."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.functions.text import canvas_id
from folioforge.operators.graph import degrees, node_text, prune, style_edges
from folioforge.operators.layout import Settings, place_nodes, salted_ids
from folioforge.plans.storage import cut, write_text

MAX_NODES = 500


def build(nodes: DataFrame, edges: DataFrame, most: int = MAX_NODES, settings: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Cards (id, type, x, y, width, height, text, color, and name) and edges (id, fromNode, fromSide, fromEnd, toNode, toSide, toEnd,
    color, label) of the ``most`` nodes of highest degree among ``nodes`` (id, entity_type, description, file_path) and of the
    ``edges`` (src, tgt, keywords, description) between them. Ids hang on names only."""
    kept, inner = prune(nodes, edges, most)
    inner = cut(inner, "canvas-edges")
    cards = cut(degrees(node_text(kept.drop("degree")), inner), "canvas-cards")
    boxes = place_nodes(cards, inner, settings)
    styled = cut(style_edges(kept, inner), "canvas-styles")
    keys = cards.select(F.concat(F.lit("node:"), F.col("id")).alias("key"), F.struct(F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit("").alias("b")).alias("rank"))
    keys = keys.unionByName(styled.select(F.concat(F.lit("edge:"), "from_node", F.lit("->"), "to_node").alias("key"), F.struct(F.lit(1).alias("kind"), F.col("from_node").alias("a"), F.col("to_node").alias("b")).alias("rank")))
    ids = salted_ids(keys, canvas_id).select("key", F.col("id").alias("canvas"))
    named = cards.join(boxes.select("id", "x", "y"), "id").withColumn("key", F.concat(F.lit("node:"), "id")).join(ids, "key")
    named = cut(named.select(F.col("canvas").alias("id"), F.lit("text").alias("type"), "x", "y", F.col("width").cast("long"), F.col("height").cast("long"), "text", "color", F.col("id").alias("name")), "canvas-nodes")
    end = lambda side: named.select(F.col("name").alias(f"{side}_node"), F.col("id").alias(f"{side}Node"), (F.col("x") + F.col("width") / 2).alias(f"{side}_x"), (F.col("y") + F.col("height") / 2).alias(f"{side}_y"))
    joined = styled.withColumn("key", F.concat(F.lit("edge:"), "from_node", F.lit("->"), "to_node")).join(ids, "key").join(end("from"), "from_node").join(end("to"), "to_node")
    dx, dy = F.col("to_x") - F.col("from_x"), F.col("to_y") - F.col("from_y")
    side = lambda right, left, down, up: F.when(F.abs(dx) >= F.abs(dy), F.when(dx >= 0, right).otherwise(left)).otherwise(F.when(dy >= 0, down).otherwise(up))
    drawn = joined.select(F.col("canvas").alias("id"), "fromNode", side("right", "left", "bottom", "top").alias("fromSide"), F.lit("none").alias("fromEnd"), "toNode", side("left", "right", "top", "bottom").alias("toSide"), F.lit("arrow").alias("toEnd"), "color", "label", "from_node", "to_node")
    return named, drawn


def write_canvas(nodes: DataFrame, edges: DataFrame, path: str, most: int = MAX_NODES, settings: Settings = Settings()) -> str:
    """Writes :func:`build` as one JSON file, cards by name and edges by the names of their ends, and returns its text. ``most`` nodes
    and their edges go through the driver."""
    cards, drawn = build(nodes, edges, most, settings)
    full = lambda row, gone: {k: v for k, v in row.asDict().items() if v is not None and k not in gone}
    document = {"nodes": [full(r, ("name",)) for r in cards.orderBy("name").collect()], "edges": [full(r, ("from_node", "to_node")) for r in drawn.orderBy("from_node", "to_node").collect()]}
    text = json.dumps(document, indent=2, ensure_ascii=False) + "\n"
    write_text(nodes.sparkSession, path, text)
    return text
