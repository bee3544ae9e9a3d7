"""Records enriched from two bibliographic catalogues, and the profiles that they begin as.

A record's work is looked for by DOI and then by title in the first catalogue, then in the second. What was found before,
or found missing, comes from a cache. Catalogues are tables of JSON; a live one is a table that a job
has fetched, in requests of :data:`IDS_PER_REQUEST`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.functions import text as T
from folioforge.operators.catalogue import deposit_works, open_works, pick_candidates
from folioforge.plans.storage import cut

# fixed values: bounds of requests and of what is taken over
MAX_REFERENCES, CANDIDATES, IDS_PER_REQUEST, REPLACE_TITLE = 40, 10, 50, 0.95
OPEN, DEPOSIT = "openalex", "crossref"

_IDS = "map<string,array<string>>"
WORK = f"title string, doi string, year int, venue string, authors array<string>, author_affiliations {_IDS}, author_ids {_IDS}, institution_ids {_IDS}, references array<struct<title:string,doi:string>>, work_id string, source string, matched_by string"
CACHE = f"key string, found boolean, work struct<{WORK.replace(' ', ':').replace(',:', ',')}>"


def profile(raw: DataFrame, json_col: str = "json", text_col: str = "text", name_col: str = "file_path") -> DataFrame:
    """Records from what a profiler said of documents, as JSON in ``json_col``, fenced or not; other columns stay.

    Strings are cleaned, single values become lists, years come out of text; what is no JSON object says
    nothing. A title is the fallback title of the text where there is none; the own title is no reference."""
    said = F.try_parse_json(T.strip_code_fence(F.col(json_col)))
    inner = F.try_parse_json(F.regexp_extract(F.col(json_col), r"(?s)\{.*\}", 0))
    rows = raw.withColumn("__v", F.coalesce(said, inner))
    get = lambda name, kind: F.try_variant_get("__v", f"$.{name}", kind)
    kind = lambda name: F.coalesce(F.schema_of_variant(get(name, "variant")), F.lit("VOID"))
    plain = lambda name: F.when(kind(name).isin("OBJECT", "VOID") | F.startswith(kind(name), F.lit("ARRAY")) | F.startswith(kind(name), F.lit("OBJECT")), F.lit(None).cast("string")).otherwise(get(name, "string"))
    listed = lambda name: T.clean_list(F.when(F.startswith(kind(name), F.lit("ARRAY")), get(name, "array<string>")).when(kind(name) == "STRING", F.array(get(name, "string"))))
    year = F.when(kind("year") == "BIGINT", F.when(get("year", "long").between(1500, 2099), get("year", "int"))).when(kind("year") == "BOOLEAN", F.lit(None).cast("int")).otherwise(T.coerce_year(plain("year")))
    title = F.coalesce(T.clean_string(plain("title")), T.fallback_title(F.col(text_col), F.col(name_col)))
    rows = rows.withColumn("title", title)
    out = rows.select(*(c for c in raw.columns if c != "title"), "title", listed("authors").alias("authors"), year.alias("year"), T.clean_string(plain("venue")).alias("venue"), T.clean_string(plain("doi")).alias("doi"), listed("affiliations").alias("affiliations"), F.filter(listed("references"), lambda r: r != F.col("title")).alias("references"))
    return out.withColumns({"author_affiliations": F.lit(None).cast("array<struct<author:string,institutions:array<string>>>"), "author_ids": F.lit(None).cast(_IDS), "institution_ids": F.lit(None).cast(_IDS), "reference_dois": F.lit(None).cast("map<string,string>"), "catalogue_id": F.lit(None).cast("string"), "metadata_source": F.lit(None).cast("string")})


def lookup_key(title: Column, doi: Column) -> Column:
    own = T.normalize_doi(doi)
    return F.when(own.isNotNull(), F.concat(F.lit("doi:"), own)).otherwise(F.concat(F.lit("title:"), T.normalize_title(title)))


def same_title(records: DataFrame, works: DataFrame) -> DataFrame:
    """Search results of a catalogue that is a table: its works of the record's normalised title, the first CANDIDATES by work_id."""
    wanted = records.select("doc_id", T.normalize_title("title").alias("norm")).where("norm <> ''")
    by_id = lambda x, y: F.when(x["work_id"] < y["work_id"], -1).when(x["work_id"] > y["work_id"], 1).otherwise(0)
    held = works.withColumn("norm", T.normalize_title("title")).groupBy("norm").agg(F.slice(F.array_sort(F.collect_list(F.struct(*works.columns)), by_id), 1, CANDIDATES).alias("w"))
    return wanted.join(held, "norm").select("doc_id", F.posexplode("w").alias("ordinal", "w")).select("doc_id", "ordinal", "w.*")


def _work(source: str, matched_by: str | Column, references: Column) -> Column:
    fields = {"author_affiliations": None, "author_ids": None, "institution_ids": None}
    own = [F.col(c) for c in ("title", "doi", "year", "venue", "authors", *fields)]
    return F.struct(*own, references.alias("references"), "work_id", F.lit(source).alias("source"), (F.lit(matched_by) if isinstance(matched_by, str) else matched_by).alias("matched_by"))


def _found(records: DataFrame, works: DataFrame, source: str, search: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
    """(doc_id, matched_by, w) of the catalogue ``works`` for each record: by DOI, else the best search result."""
    held = works.select(F.struct(*works.columns).alias("w"))
    by_doi = records.select("doc_id", T.normalize_doi(F.col("doi")).alias("doi")).where("doi is not null").join(held.where("w.doi is not null").groupBy(F.col("w.doi").alias("doi")).agg(F.min_by("w", "w.work_id").alias("w")), "doi").select("doc_id", F.lit("doi").alias("matched_by"), "w")
    rest = cut(records.join(by_doi.select("doc_id"), "doc_id", "left_anti"), "not-by-doi")
    results = cut(search(rest, works), "search-results")
    picked = pick_candidates(rest.select("doc_id", "title", "year", "authors"), results.select("doc_id", "ordinal", "title", "year", "authors"), "doc_id")
    best = results.join(picked.select("doc_id", "ordinal"), ["doc_id", "ordinal"]).select("doc_id", F.struct(*works.columns).alias("w"))
    return by_doi.unionByName(best.select("doc_id", F.lit("title").alias("matched_by"), "w"))


def resolve(records: DataFrame, open_json: DataFrame, deposit_json: DataFrame, cache: DataFrame | None = None, search: Callable[[DataFrame, DataFrame], DataFrame] = same_title, most: int = MAX_REFERENCES) -> tuple[DataFrame, DataFrame]:
    """(doc_id, work) for each of ``records`` that a catalogue or the cache has, and the cache after it, which has misses too.

    ``open_json`` and ``deposit_json`` have a column json. Of records with one key the first by doc_id is asked for. References of the first
    catalogue are looked up by id, ``most`` of them, in the order in which the record lists them."""
    keyed = cut(records.withColumn("key", lookup_key(F.col("title"), F.col("doi"))), "keyed-records")
    known = cache if cache is not None else records.sparkSession.createDataFrame([], CACHE)
    asked = keyed.join(known.select("key"), "key", "left_anti")
    asked = cut(asked.join(asked.groupBy("key").agg(F.min("doc_id").alias("doc_id")), ["key", "doc_id"]), "asked-records")
    first = open_works(open_json).drop("json")
    found = cut(_found(asked, first, OPEN, search), "found-first")
    wanted = found.select("doc_id", F.posexplode(F.slice("w.reference_ids", 1, most)).alias("at", "id"))
    told = wanted.join(first.where("title <> ''").groupBy(F.col("work_id").alias("id")).agg(F.min_by(F.struct("title", "doi"), "title").alias("r")), "id").groupBy("doc_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "r"))), lambda x: x["r"]).alias("refs"))
    none = F.array().cast("array<struct<title:string,doi:string>>")
    a = found.join(told, "doc_id", "left").select("doc_id", "refs", "matched_by", "w.*").select("doc_id", _work(OPEN, F.col("matched_by"), F.coalesce("refs", none)).alias("work"))
    second = deposit_works(deposit_json).drop("json").withColumn("institution_ids", F.lit(None).cast(_IDS))
    b = _found(asked.join(found.select("doc_id"), "doc_id", "left_anti"), second, DEPOSIT, search).select("doc_id", "matched_by", "w.*").select("doc_id", _work(DEPOSIT, F.col("matched_by"), F.col("references")).alias("work"))
    now = cut(asked.select("key", "doc_id").join(a.unionByName(b), "doc_id", "left").select("key", F.col("work").isNotNull().alias("found"), "work"), "looked-up")
    after = known.unionByName(now)
    return keyed.select("doc_id", "key").join(after.where("found"), "key").select("doc_id", "work"), after


def enrich(records: DataFrame, works: DataFrame, most: int = MAX_REFERENCES) -> DataFrame:
    """``records`` (kg.RECORD; distinct doc_id) with what ``works`` (doc_id, work) say of them. What a work has of authors, year, venue and DOI
    holds, and its title if it was found by DOI or is nearly the same. Own references all stay and come first; the work's follow
    while there are fewer than ``most``. A DOI goes to the spelling that stays. Records without a work stay as they are."""
    joined = records.join(works, "doc_id", "left").withColumn("__t", F.struct(T.normalize_title("title").alias("a"), T.normalize_title(F.col("work.title")).alias("b")))
    near = F.when(F.col("work.matched_by") == "doi", 1.0).otherwise(T.title_similarity(F.col("__t.a"), F.col("__t.b")))
    title = F.when((F.col("work.title") != "") & (near >= REPLACE_TITLE), F.col("work.title")).otherwise(F.col("title"))
    joined = cut(joined.withColumn("title", title).drop("__t"), "with-works")

    told = joined.where("work is not null")
    own = told.select("doc_id", "title", F.lit(0).alias("side"), F.posexplode("references").alias("at", "label"), "reference_dois").select("doc_id", "title", "side", "at", "label", F.col("reference_dois")[F.col("label")].alias("doi"))
    more = told.select("doc_id", "title", F.lit(1).alias("side"), F.posexplode("work.references").alias("at", "r")).select("doc_id", "title", "side", "at", F.col("r.title").alias("label"), "r.doi")
    rows = own.unionByName(more).withColumns({"norm": T.normalize_title("label"), "own_title": T.normalize_title("title")}).where("norm <> '' and norm <> own_title")
    spelled = rows.groupBy("doc_id", "norm").agg(F.min(F.struct("side", "at", "label")).alias("first"), F.min(F.when(F.col("doi").isNotNull(), F.struct("side", "at", "doi"))).alias("d"))
    merged = spelled.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("first.side", "first.at", "first.label", "d.doi"))).alias("r"))
    forced = F.size(F.filter("r", lambda x: x["side"] == 0))
    merged = merged.select("doc_id", F.slice("r", F.lit(1), F.greatest(forced, F.lit(most))).alias("r"))
    out = joined.join(merged, "doc_id", "left")

    w = lambda c: F.col(f"work.{c}")
    has = F.col("work").isNotNull()
    pick = lambda when, c: F.when(has & when, w(c)).otherwise(F.col(c))
    none = F.array().cast("array<string>")
    refs = F.coalesce("r", F.array().cast("array<struct<side:int,at:int,label:string,doi:string>>"))
    given = F.filter(F.coalesce(F.map_entries("reference_dois"), F.array().cast("array<struct<key:string,value:string>>")), lambda e: ~F.exists(refs, lambda x: (x["label"] == e["key"]) & x["doi"].isNotNull()))
    dois = F.map_from_entries(F.concat(given, F.transform(F.filter(refs, lambda x: x["doi"].isNotNull()), lambda x: F.struct(x["label"].alias("key"), x["doi"].alias("value")))))
    houses = F.coalesce(F.flatten(F.map_values(w("author_affiliations"))), none)
    changed = {
        "authors": pick(F.size(w("authors")) > 0, "authors"),
        "year": pick(F.coalesce(w("year"), F.lit(0)) != 0, "year"),
        "venue": pick(F.coalesce(w("venue"), F.lit("")) != "", "venue"),
        "doi": pick(F.coalesce(w("doi"), F.lit("")) != "", "doi"),
        "affiliations": F.when(has, F.filter(F.array_distinct(F.concat(F.coalesce("affiliations", none), houses)), lambda x: x.isNotNull() & (x != ""))).otherwise(F.col("affiliations")),
        "references": F.when(has, F.transform(refs, lambda x: x["label"])).otherwise(F.col("references")),
        "reference_dois": F.when(has, dois).otherwise(F.col("reference_dois")),
        "author_affiliations": F.when(has, F.transform(F.map_entries(w("author_affiliations")), lambda e: F.struct(e["key"].alias("author"), e["value"].alias("institutions")))).otherwise(F.col("author_affiliations")),
        "author_ids": pick(F.lit(True), "author_ids"),
        "institution_ids": pick(F.lit(True), "institution_ids"),
        "catalogue_id": F.when(has & (w("source") == OPEN), w("work_id")).otherwise(F.col("catalogue_id")),
        "metadata_source": F.when(has, w("source")).otherwise(F.col("metadata_source")),
    }
    return out.select(*(changed[c].alias(c) if c in changed else F.col(c) for c in records.columns))
