"""A working folder: documents go in, and a graph that can be asked, reconciled and exported comes out.

Tables are Parquet below the folder, each version in a folder of its own; a small file names those that hold, and is
replaced last, so that a run that is lost leaves the tables of the run before.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators import canvas, enrich, export, graph, kg, layout, merges, reconcile, retrieve
from folioforge.plans.storage import cut, remove, write_text
from folioforge.sources.files import read_canvases, read_documents


def _setting(name: str, default: str) -> str:
    return os.environ.get(name, default)


@dataclass(frozen=True)
class Config:
    """Folders and bounds; each comes from the environment variable of its name where that is set."""

    working_dir: str = field(default_factory=lambda: _setting("WORKING_DIR", "./rag_storage"))
    data_dir: str = field(default_factory=lambda: _setting("DATA_DIR", "./data"))
    canvas_path: str = field(default_factory=lambda: _setting("CANVAS_PATH", "./output/knowledge_graph.canvas"))
    cosine_threshold: float = field(default_factory=lambda: float(_setting("COSINE_THRESHOLD", str(retrieve.OFFLINE_SCORE))))
    reconcile_graph: bool = field(default_factory=lambda: _setting("RECONCILE_GRAPH", "1").lower() in ("1", "true", "yes"))
    metadata_lookup: bool = field(default_factory=lambda: _setting("METADATA_LOOKUP", "1").lower() in ("1", "true", "yes"))
    max_references: int = field(default_factory=lambda: int(_setting("METADATA_MAX_REFERENCES", str(enrich.MAX_REFERENCES))))

    def with_overrides(self, **overrides) -> Config:
        return replace(self, **{k: v for k, v in overrides.items() if v is not None})


_TABLES = {
    "documents": "doc_id string, file_path string, text string",
    "records": f"{kg.RECORD}, existing array<string>, linked_papers array<string>, new_cited_works array<string>",
    "registry": merges.REGISTRY,
    "nodes": "id string, entity_type string, description string, source_id string, file_path string",
    "edges": "src string, tgt string, keywords string, description string, source_id string, file_path string, weight double",
    "cache": enrich.CACHE,
}


def header_profile(docs: DataFrame) -> DataFrame:
    """Records (kg.RECORD without ordinal) from the header lines of documents (doc_id, file_path, text); of one without a title, the first line."""
    f = F.col("f")
    rows = docs.withColumn("f", T.header_fields(F.col("text")))
    listed = lambda name, by: T.clean_list(T.split_list(f[name], by))
    told = f["title"].isNotNull()
    title = F.coalesce(T.clean_string(f["title"]), T.fallback_title(F.col("text"), F.col("file_path")))
    when = lambda c: F.when(told, c)
    none = F.array().cast("array<string>")
    rows = rows.withColumn("title", title)
    ids = "map<string,array<string>>"
    return rows.select(
        "doc_id", "file_path", "title", F.coalesce(when(listed("authors", ",")), none).alias("authors"), when(T.coerce_year(f["year"])).alias("year"), when(T.clean_string(f["venue"])).alias("venue"), when(T.clean_string(f["doi"])).alias("doi"),
        F.coalesce(when(listed("affiliations", ",")), none).alias("affiliations"), F.coalesce(when(F.filter(listed("references", ";"), lambda r: r != F.col("title"))), none).alias("references"),
        F.lit(None).cast("array<struct<author:string,institutions:array<string>>>").alias("author_affiliations"), F.lit(None).cast(ids).alias("author_ids"), F.lit(None).cast(ids).alias("institution_ids"),
        F.lit(None).cast("map<string,string>").alias("reference_dois"), F.lit(None).cast("string").alias("catalogue_id"), F.lit(None).cast("string").alias("metadata_source"),
    )


@dataclass
class Report:
    ingested: list[str] = field(default_factory=list)
    skipped: list[tuple[str, str]] = field(default_factory=list)
    known: int = 0
    merges: list[tuple[str, str, str]] = field(default_factory=list)

    def lines(self) -> list[str]:
        out = [f"Ingested {len(self.ingested)} document(s), {self.known} known before; skipped {len(self.skipped)}"]
        out += [f"  skipped {path}: {why}" for path, why in self.skipped]
        return out + merge_lines(self.merges)


def merge_lines(plans: list[tuple[str, str, str]]) -> list[str]:
    return [f"Entity merges applied: {len(plans)}"] + [f"  {source} -> {target} ({reason})" for source, target, reason in plans]


class Session:
    """The engine over one working folder. ``profile`` turns new documents into records; ``catalogues`` are the JSON tables of the
    first and the second catalogue, or nothing; ``dictionary`` has the (name, type, description) that texts are searched for, and
    ``relations`` their (src, tgt, keywords, description)."""

    def __init__(self, spark: SparkSession, config: Config = Config(), profile: Callable[[DataFrame], DataFrame] = header_profile, catalogues: tuple[DataFrame, DataFrame] | None = None, dictionary: tuple = (), relations: tuple = ()):
        self.spark, self.config, self.profile, self.catalogues = spark, config, profile, catalogues
        self.dictionary, self.relations = list(dictionary), list(relations)

    # tables

    def _index(self) -> dict[str, str]:
        rows = self.spark.createDataFrame([], "value string")
        try:
            rows = self.spark.read.text(f"{self.config.working_dir}/tables.json", wholetext=True)
            return json.loads(rows.first()["value"])
        except Exception:  # noqa: BLE001  no folder yet, or an index that cannot be read: nothing is known
            return {}

    def table(self, name: str) -> DataFrame:
        path = self._index().get(name)
        return self.spark.read.schema(_TABLES[name]).parquet(f"{self.config.working_dir}/{path}") if path else self.spark.createDataFrame([], _TABLES[name])

    def _save(self, **tables: DataFrame) -> None:
        index, old = self._index(), []
        for name, rows in tables.items():
            path = f"{name}-{uuid.uuid4().hex}"
            columns = [f.name for f in self.spark.createDataFrame([], _TABLES[name]).schema]
            (rows.orderBy("name") if name == "registry" else rows).select(columns).write.parquet(f"{self.config.working_dir}/{path}")
            old += [index[name]] if name in index else []
            index[name] = path
        write_text(self.spark, f"{self.config.working_dir}/tables.json", json.dumps(index))
        for path in old:
            remove(self.spark, f"{self.config.working_dir}/{path}")

    # steps

    def ingest(self) -> Report:
        """Documents of the data folder that are not known yet, by path: profiled, enriched, reconciled, and made part of the graph."""
        found = cut(read_documents(self.spark, self.config.data_dir).withColumn("file_path", F.element_at(F.split("path", "/"), -1)), "session-found")
        report = Report(skipped=[(r["file_path"], r["status"]) for r in found.where("status <> 'ok'").orderBy("path").collect()])
        fresh = found.where("status = 'ok'")
        known = self.table("documents")
        first = fresh.groupBy("doc_id").agg(F.min_by(F.struct("file_path", "text", "path"), "path").alias("d")).select("doc_id", "d.*")
        new = cut(first.join(known.select("doc_id"), "doc_id", "left_anti"), "session-new")
        report.ingested = [r["file_path"] for r in new.select("file_path").orderBy("file_path").collect()]
        report.known = fresh.count() - len(report.ingested)
        if not report.ingested:
            return report
        start = self.table("records").agg(F.coalesce(F.max("ordinal"), F.lit(-1))).first()[0] + 1
        ordinal = new.select("doc_id", (F.row_number().over(_by_path()) - 1 + start).cast("long").alias("ordinal"))
        records = cut(self.profile(new.select("doc_id", "file_path", "text")).join(ordinal, "doc_id"), "session-records")
        saved = {}
        if self.catalogues is not None:
            works, saved["cache"] = enrich.resolve(records, *self.catalogues, self.table("cache"), most=self.config.max_references)
            records = enrich.enrich(records, works, self.config.max_references)
        records = records.select([f.name for f in self.spark.createDataFrame([], kg.RECORD).schema])
        settled, plans, registry = reconcile.reconcile(records, self.table("registry"))
        settled, plans = cut(settled, "session-settled"), cut(plans, "session-plans")
        nodes, edges = self._with(kg.prepared(settled), settled, new)
        nodes, edges = graph.merge_nodes(nodes, edges, plans.select("source", "target"))
        self._save(documents=known.unionByName(new.select(known.columns)), records=self.table("records").unionByName(settled), registry=registry, nodes=nodes, edges=edges, **saved)
        report.merges = [(r["source"], r["target"], r["reason"]) for r in plans.orderBy("ordinal", "source").collect()]
        if self.config.reconcile_graph:
            report.merges += self.reconcile()
        return report

    def _with(self, emitted: DataFrame, settled: DataFrame, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
        """The graph and what new records and texts say: records overwrite, but for names that they found there; texts add."""
        held, joined = kg.upsert(emitted)
        known = settled.select(F.explode("existing").alias("id")).distinct().join(self.table("nodes").select("id"), "id", "left_semi")
        own = held.where(f"entity_type = '{kg.PAPER}'").unionByName(held.where(f"entity_type <> '{kg.PAPER}'").join(known, "id", "left_anti"))
        columns, ends = ["id", "entity_type", "description", "source_id", "file_path"], ["keywords", "description", "source_id", "file_path", "weight"]
        nodes = self.table("nodes").join(own.select("id"), "id", "left_anti").select(columns).unionByName(own.select(columns))
        pair = lambda rows: rows.withColumns({"a": F.least("src", "tgt"), "b": F.greatest("src", "tgt")})
        new = pair(joined)
        edges = pair(self.table("edges")).join(new.select("a", "b"), ["a", "b"], "left_anti").select("src", "tgt", *ends).unionByName(new.select("src", "tgt", *ends))
        if self.dictionary:
            about = {n: d for n, _, d in self.dictionary}
            source = docs.select("doc_id", "text", "file_path")
            tagged = cut(retrieve.tag_entities(source, [(n, t) for n, t, _ in self.dictionary]), "session-tags")
            told = tagged.join(source.select("doc_id", "file_path"), "doc_id")
            said = F.create_map(*(F.lit(x) for p in about.items() for x in p))[F.col("id")]
            texts = told.groupBy(F.col("name").alias("id")).agg(F.first("type").alias("entity_type"), F.array_join(F.array_sort(F.collect_set("doc_id")), "<SEP>").alias("source_id"), F.array_join(F.array_sort(F.collect_set("file_path")), "<SEP>").alias("file_path")).withColumn("description", said)
            nodes = nodes.unionByName(texts.join(nodes.select("id"), "id", "left_anti").select(columns))
            if self.relations:
                links = retrieve.tag_relations(tagged, self.relations).join(source.select("doc_id", "file_path"), "doc_id")
                links = links.groupBy("src", "tgt").agg(F.first("keywords").alias("keywords"), F.first("description").alias("description"), F.array_join(F.array_sort(F.collect_set("doc_id")), "<SEP>").alias("source_id"), F.array_join(F.array_sort(F.collect_set("file_path")), "<SEP>").alias("file_path"), F.count(F.lit(1)).cast("double").alias("weight"))
                edges = edges.unionByName(pair(links).join(pair(edges).select("a", "b"), ["a", "b"], "left_anti").select("src", "tgt", *ends))
        return cut(nodes, "session-nodes"), cut(edges, "session-edges")

    def reconcile(self) -> list[tuple[str, str, str]]:
        """Merges of all nodes that are one entity, carried out in the graph and in the registry: (source, target, reason)."""
        nodes, registry = self.table("nodes"), self.table("registry")
        plans = cut(merges.plan_merges(nodes, registry), "session-merges")
        done = [(r["source"], r["target"], r["reason"]) for r in plans.orderBy("target", "source").collect()]
        if done:
            nodes, edges = graph.merge_nodes(nodes, self.table("edges"), plans.select("source", "target"))
            self._save(nodes=nodes, edges=edges, registry=merges.absorb(registry, plans))
        return done

    def retrieve(self, questions: DataFrame, modes: list[str], k: int = 10) -> DataFrame:
        """(query_id, mode, kind, id) of what each mode finds for ``questions`` (query_id, text)."""
        embed = lambda rows, *extra: rows.join(retrieve.embed(rows, "id", "text"), "id").select("id", *extra, "v")
        nodes, edges = self.table("nodes"), self.table("edges")
        entities = embed(nodes.select("id", F.concat_ws(" ", "id", "description").alias("text")))
        relations = embed(edges.select(F.concat_ws("|", "src", "tgt").alias("id"), "src", "tgt", F.concat_ws(" ", "keywords", "src", "tgt", "description").alias("text")), "src", "tgt")
        parts = embed(retrieve.chunks(self.table("documents")).select(F.concat_ws("-", "doc_id", "chunk_order_index").alias("id"), F.col("content").alias("text")))
        vectors = cut(retrieve.question_vectors(questions, [n for n, _, _ in self.dictionary] or ["overview"]), "session-questions")
        return retrieve.retrieve(vectors, entities, relations, parts, modes, k, self.config.cosine_threshold)

    def query(self, questions: list[str], modes: list[str]) -> list[str]:
        """For each question and mode, what was found and the answer, as lines."""
        asked = self.spark.createDataFrame(list(enumerate(questions)), "query_id long, text string")
        found = cut(self.retrieve(asked, modes), "session-answers")
        counts = {(r["query_id"], r["mode"], r["kind"]): r["n"] for r in found.groupBy("query_id", "mode", "kind").agg(F.count(F.lit(1)).alias("n")).collect()}
        named = {(r["query_id"], r["mode"]): r["names"] for r in found.where("kind = 'entity'").groupBy("query_id", "mode").agg(F.slice(F.array_sort(F.collect_set("id")), 1, 8).alias("names")).collect()}
        out = []
        for i, question in enumerate(questions):
            for mode in modes:
                n = [counts.get((i, mode, kind), 0) for kind in ("entity", "relation", "chunk")]
                names = named.get((i, mode), [])
                said = f"Stub answer: grounded in {', '.join(names) or 'the retrieved knowledge base'}." if any(n) else retrieve.FAILED_ANSWER
                ok = any(n) and retrieve.FAILED_ANSWER not in said
                out += [f"=== mode={mode} ok={ok} ===", f"Q: {question}", f"A: {said}", f"{n[0]} entities, {n[1]} relationships, {n[2]} chunks"]
        return out

    def export(self, path: str | None = None, most: int | None = None, algorithm: str = layout.SPRING) -> str:
        """Writes the canvas and returns its path."""
        path = path or self.config.canvas_path
        export.write_canvas(self.table("nodes"), self.table("edges"), path, most or export.MAX_NODES, layout.Settings(algorithm=algorithm))
        return path


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")


def verify_lines(spark: SparkSession, path: str, allow_overlap: bool = False) -> tuple[bool, list[str]]:
    """Whether canvas files have no errors, and what is found, as lines; overlapping pairs are named, the first twenty."""
    files = read_canvases(spark, path)
    rows = canvas.verify(files, forbid_overlap=not allow_overlap).orderBy("severity", "part", "pos", "rule").collect()
    out = [f"{r['severity']}: {r['part']}{'' if r['pos'] is None else '[%d]' % r['pos']} {r['rule']}{' x%d' % r['n'] if r['n'] > 1 else ''}" for r in rows]
    errors = sum(r["severity"] == "error" for r in rows)
    return errors == 0, [*out, f"{'OK' if not errors else 'FAILED'}: {errors} error(s), {len(rows) - errors} warning(s)"]
