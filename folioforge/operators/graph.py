"""Operators on a graph of nodes (id and attributes) and undirected edges (src, tgt and attributes)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from folioforge.functions.text import normalize_type, split_list
from folioforge.operators.components import connected_components
from folioforge.operators.kg import color_of, edge_color
from folioforge.plans.storage import cut

#: Boxes of a chunk, about; rows of one chunk that are compared with another at a time.
CHUNK_BOXES, STRIP = 2048, 256

def rebuild(nodes: DataFrame, edges: DataFrame, order: str = "ordinal") -> tuple[DataFrame, DataFrame]:
    """Nodes with an id; edges between two of them that are no loops, one for each pair, the last by ``order``."""
    nodes = nodes.where("id is not null")
    ids = nodes.select("id")
    kept = edges.where("src <> tgt").join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "tgt"), "tgt", "left_semi")
    rest = F.struct(*edges.columns)
    pair = [F.least("src", "tgt").alias("a"), F.greatest("src", "tgt").alias("b")]
    return nodes, kept.groupBy(*pair).agg(F.max_by(rest, F.struct(order, "src")).alias("r")).select("r.*")


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes with their number of edge ends; 0 where there is none."""
    ends = edges.select(F.explode(F.array("src", "tgt")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))
    return nodes.join(ends, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0).cast("long")))


def prune(nodes: DataFrame, edges: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The ``most`` nodes of highest degree (then by id) and the edges among them."""
    top = cut(degrees(nodes, edges).orderBy(F.desc("degree"), "id").limit(most), "graph-top")
    few = F.broadcast(top.select("id"))  # ``most`` rows
    return top, edges.join(few.withColumnRenamed("id", "src"), "src", "left_semi").join(few.withColumnRenamed("id", "tgt"), "tgt", "left_semi").select(edges.columns)


def leads(text: Column, name: Column) -> Column:
    """The text starts with the quoted name, or with the name and a space."""
    return F.startswith(text, F.concat(F.lit("'"), name, F.lit("'"))) | F.startswith(text, F.concat(name, F.lit(" ")))


def style_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges with from, to, color and label. The end that the description starts with is the subject;
    else a paper is; else the first by name. An edge with a bibliographic end has its colour."""
    kinds = nodes.select("id", "entity_type")
    joined = edges.join(kinds.select(F.col("id").alias("src"), F.col("entity_type").alias("src_type")), "src").join(kinds.select(F.col("id").alias("tgt"), F.col("entity_type").alias("tgt_type")), "tgt")
    a, b = F.least("src", "tgt"), F.greatest("src", "tgt")
    first = F.coalesce(F.get(split_list(F.col("description")), F.lit(0)), F.lit(""))
    a_leads, b_leads = leads(first, a), leads(first, b)
    paper = lambda end: normalize_type(F.when(F.col("src") == end, F.col("src_type")).otherwise(F.col("tgt_type"))) == "paper"
    start = F.when(a_leads & ~b_leads, a).when(b_leads & ~a_leads, b).when(paper(a) & ~paper(b), a).when(paper(b) & ~paper(a), b).otherwise(a)
    label = F.left(F.array_join(split_list(F.col("keywords")), ", "), F.lit(60))
    return joined.select(start.alias("from_node"), F.when(start == a, b).otherwise(a).alias("to_node"), edge_color(F.col("src_type"), F.col("tgt_type")).alias("color"), F.nullif(label, F.lit("")).alias("label"))


def node_text(nodes: DataFrame) -> DataFrame:
    """Nodes with text, width, height and color as a card shows them."""
    told = F.array_join(split_list(F.col("description")), " ")
    told = F.when(F.length(told) > 350, F.concat(F.rtrim(F.substr(told, F.lit(1), F.lit(349))), F.lit("…"))).otherwise(told)
    source = F.filter(split_list(F.col("file_path")), lambda x: x != "unknown_source")
    kind = F.coalesce(F.nullif(normalize_type(F.col("entity_type")), F.lit("")), F.lit("unknown"))
    text = F.concat_ws("\n\n", F.concat(F.lit("# "), F.col("id")), F.concat(F.lit("**Type:** "), kind), F.nullif(told, F.lit("")), F.concat(F.lit("_Source: "), F.get(source, F.lit(0)), F.lit("_")))
    lines = F.aggregate(F.split(F.col("text"), "\n"), F.lit(0).cast("long"), lambda n, x: n + F.greatest(F.lit(1).cast("long"), F.ceil(F.length(x) / 44).cast("long")))
    return nodes.withColumn("text", text).withColumn("width", F.lit(400)).withColumn("height", F.greatest(F.lit(160), F.least(F.lit(520), 60 + 24 * lines)).cast("int")).withColumn("color", color_of(F.col("entity_type")))


def resolve_plans(nodes: DataFrame, plans: DataFrame) -> DataFrame:
    """(source, target) of merges, where the target is where a chain of plans ends. Plans of which an end is missing
    or both are one have no effect; of plans of one source that with the least target holds; a ring ends in its least id."""
    ids = nodes.select("id")
    live = plans.where("source <> target").join(ids.withColumnRenamed("id", "source"), "source", "left_semi").join(ids.withColumnRenamed("id", "target"), "target", "left_semi")
    live = cut(live.groupBy("source").agg(F.min("target").alias("target")), "merge-plans")
    groups = connected_components(live, "source", "target")
    ends = groups.join(live.select(F.col("source").alias("node")), "node", "left_anti").groupBy("root").agg(F.min("node").alias("end"))
    return groups.join(ends, "root", "left").select(F.col("node").alias("source"), F.coalesce("end", "root").alias("target")).where("source <> target")


def merge_nodes(nodes: DataFrame, edges: DataFrame, plans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph after each ``source`` of ``plans`` became its ``target`` (see :func:`resolve_plans`). A target keeps its own
    type; what else nodes say in text is listed, its own first. Edges are turned over to targets; loops go,
    parallel edges are one."""
    live = cut(resolve_plans(nodes, plans), "merge-live")
    moved = nodes.join(live.select(F.col("source").alias("id"), F.col("target").alias("__to")), "id", "left").withColumn("__to", F.coalesce("__to", "id"))
    held = live.select(F.col("target").alias("__to")).distinct()
    text = [f.name for f in nodes.schema if f.dataType.simpleString() == "string" and f.name not in ("id", "entity_type")]
    listed = lambda c: F.array_join(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct((F.col("id") != F.col("__to")).alias("late"), F.col("id"), F.col(c).alias("v")))), lambda x: split_list(x["v"])))), "<SEP>")
    own = lambda c: F.max(F.when(F.col("id") == F.col("__to"), F.col(c)))
    told = [(F.nullif(listed(c), F.lit("")) if c in text else own(c)).alias(c) for c in nodes.columns if c != "id"]
    folded = moved.join(held, "__to", "left_semi").groupBy("__to").agg(*told).withColumnRenamed("__to", "id")
    rest = moved.join(held, "__to", "left_anti")
    for end in ("src", "tgt"):
        edges = edges.join(live.select(F.col("source").alias(end), F.col("target").alias("__to")), end, "left").withColumn(end, F.coalesce("__to", end)).drop("__to")
    pair = [F.least("src", "tgt").alias("src"), F.greatest("src", "tgt").alias("tgt")]
    joined = [F.array_join(F.array_sort(F.collect_set(c)), "<SEP>").alias(c) for c in edges.columns if c not in ("src", "tgt", "weight")]
    return rest.select(nodes.columns).unionByName(folded.select(nodes.columns)), edges.where("src <> tgt").groupBy(*pair).agg(*joined, F.sum("weight").alias("weight"))


def type_histogram(nodes: DataFrame, key: str = "entity_type") -> DataFrame:
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def box_overlaps(boxes: DataFrame, cell: int = 520, gap: int = 0, by: tuple[str, ...] = ()) -> DataFrame:
    """Pairs (a, b) of boxes (id, x, y, width, height) that overlap, among those that agree in ``by``; touching
    is no overlap. A box is put into every cell of a grid that it reaches, and pairs are met in the cell of
    their common corner. A full cell is dealt by a hash into chunks; a task compares two chunks, or one with itself."""
    reach = lambda at, end: F.sequence(F.floor(at / cell), F.floor(F.col(end) / cell))
    cells = boxes.select(*by, "id", "x", "y", (F.col("x") + F.col("width") + gap).alias("__right"), (F.col("y") + F.col("height") + gap).alias("__bottom")).dropna(subset=["id", *by])
    cells = cells.select("*", F.explode(reach(F.col("x"), "__right")).alias("__cx")).select("*", F.explode(reach(F.col("y"), "__bottom")).alias("__cy"))
    cells = cells.select("*", F.floor(F.col("x") / cell).alias("__hx"), F.floor(F.col("y") / cell).alias("__hy"))
    where = [*by, "__cx", "__cy"]
    full = cells.groupBy(*where).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*where, F.ceil(F.col("n") / CHUNK_BOXES).cast("int").alias("__m"))
    placed = cells.join(full, where).withColumn("__c", F.pmod(F.xxhash64("id", "x", "y"), F.col("__m")).cast("int"))
    c = F.col("__c")
    tasks = F.transform(F.sequence(F.lit(0), F.col("__m") - 1), lambda o: F.struct(F.least(c, o).alias("__lo"), F.greatest(c, o).alias("__hi"), (o < c).alias("__second")))
    dealt = placed.select(*where, "id", "x", "y", "__right", "__bottom", "__hx", "__hy", F.explode(tasks).alias("__t")).select("*", "__t.*").drop("__t")
    kinds = {f.name: f.dataType for f in boxes.schema}
    schema = StructType([*(StructField(k, kinds[k]) for k in by), StructField("a", kinds["id"]), StructField("b", kinds["id"])])
    return dealt.groupBy(*where, "__lo", "__hi").applyInArrow(_overlapping(by), schema)


def _overlapping(by: tuple[str, ...]):
    """Rows of one chunk of a cell and of another, or of one alone; the pairs of them that overlap."""

    def compare(table: pa.Table) -> pa.Table:
        rank = pc.rank(table.column("id"), tiebreaker="min").to_numpy()
        x, y, right, bottom, hx, hy = (table.column(c).to_numpy() for c in ("x", "y", "__right", "__bottom", "__hx", "__hy"))
        cx, cy, lo, hi = (table.column(c)[0].as_py() for c in ("__cx", "__cy", "__lo", "__hi"))
        second = table.column("__second").to_numpy()
        rows, columns = (np.arange(len(rank)),) * 2 if lo == hi else (np.flatnonzero(~second), np.flatnonzero(second))
        ids, one = table.column("id").combine_chunks(), table.select(list(by)).slice(0, 1)
        said = {c: one.column(c).combine_chunks() for c in by}
        parts = []
        for at in range(0, len(rows), STRIP):
            i, j = rows[at : at + STRIP, None], columns[None]
            meets = rank[i] < rank[j] if lo == hi else rank[i] != rank[j]
            meets &= x[i] < right[j]
            meets &= x[j] < right[i]
            meets &= y[i] < bottom[j]
            meets &= y[j] < bottom[i]
            meets &= np.maximum(hx[i], hx[j]) == cx
            meets &= np.maximum(hy[i], hy[j]) == cy
            i, j = np.nonzero(meets)
            i, j = rows[i + at], columns[j]
            turned = rank[i] > rank[j]
            i, j = np.where(turned, j, i), np.where(turned, i, j)
            of = {c: v.take(pa.array(np.zeros(len(i), np.int64))) for c, v in said.items()}
            parts.append(pa.table({**of, "a": ids.take(pa.array(i)), "b": ids.take(pa.array(j))}))
        return pa.concat_tables(parts) if parts else pa.table({**{c: v.slice(0, 0) for c, v in said.items()}, "a": ids.slice(0, 0), "b": ids.slice(0, 0)})

    return compare
