"""Works of two bibliographic catalogues: nested JSON to records, and the choice among search results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.functions import text as T

# fixed values: the fields that are read of either catalogue's JSON
OPEN_SCHEMA = "id string, doi string, title string, display_name string, publication_year int, authorships array<struct<author: struct<id: string, display_name: string, orcid: string>, institutions: array<struct<id: string, display_name: string, ror: string>>, raw_author_name: string>>, primary_location struct<source: struct<display_name: string>>, referenced_works array<string>"
_DATES = ("issued", "published-print", "published-online", "created")
DEPOSIT_SCHEMA = "DOI string, title array<string>, author array<struct<given: string, family: string, name: string, ORCID: string, affiliation: array<struct<name: string>>>>, `container-title` array<string>, reference array<struct<DOI: string, `article-title`: string, `volume-title`: string, unstructured: string>>, " + ", ".join(f"`{d}` struct<`date-parts`: array<array<int>>>" for d in _DATES)
MAX_REFERENCES = 5
YEAR_FIT, YEAR_MISS, AUTHOR_SHARE = 0.05, 0.1, 0.1

_NONE = "array<struct<name: string, ids: array<string>>>"


def _grouped(pairs: Column) -> Column:
    """A map of name to the distinct ids of all ``pairs`` of that name, in order; names without ids are left out."""
    pairs = F.filter(F.coalesce(pairs, F.array().cast(_NONE)), lambda p: p["name"].isNotNull() & (F.size(p["ids"]) > 0))
    names = F.array_distinct(F.transform(pairs, lambda p: p["name"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.array_distinct(F.flatten(F.transform(F.filter(pairs, lambda p: p["name"] == n), lambda p: p["ids"])))))


def _pair(name: Column, *ids: Column) -> Column:
    return F.struct(name.alias("name"), F.array_compact(F.array(*ids)).alias("ids"))


def _names(people: Column) -> Column:
    return F.coalesce(F.array_distinct(F.filter(people, lambda n: n.isNotNull())), F.array().cast("array<string>"))


def _first_full(*c: Column) -> Column:
    return F.coalesce(*(F.when(x != "", x) for x in c))


def open_works(rows: DataFrame, column: str = "json") -> DataFrame:
    """Works of the first catalogue from JSON text; other columns stay. Text that is no JSON gives nulls and empty lists."""
    w = F.from_json(column, OPEN_SCHEMA)
    parsed = rows.withColumn("w", w)
    w = F.col("w")
    who = lambda a: F.coalesce(T.squeeze(a["author"]["display_name"]), T.squeeze(a["raw_author_name"]))
    places = lambda a: F.transform(F.coalesce(a["institutions"], F.array().cast("array<struct<id: string, display_name: string, ror: string>>")), lambda i: T.squeeze(i["display_name"]))
    authors = w["authorships"]
    named = F.filter(authors, lambda a: who(a).isNotNull())
    houses = F.flatten(F.transform(named, lambda a: F.coalesce(a["institutions"], F.array().cast("array<struct<id: string, display_name: string, ror: string>>"))))
    return parsed.select(
        *rows.columns, T.short_id(w["id"]).alias("work_id"), F.coalesce(T.squeeze(_first_full(w["title"], w["display_name"])), F.lit("")).alias("title"),
        T.normalize_doi(w["doi"]).alias("doi"), T.valid_year(w["publication_year"]).alias("year"), T.squeeze(w["primary_location"]["source"]["display_name"]).alias("venue"),
        _names(F.transform(authors, who)).alias("authors"),
        _grouped(F.transform(named, lambda a: F.struct(who(a).alias("name"), F.array_compact(places(a)).alias("ids")))).alias("author_affiliations"),
        _grouped(F.transform(named, lambda a: _pair(who(a), T.catalogue_identifier(a["author"]["id"]), T.orcid_identifier(a["author"]["orcid"])))).alias("author_ids"),
        _grouped(F.transform(houses, lambda i: _pair(T.squeeze(i["display_name"]), T.catalogue_identifier(i["id"]), T.ror_identifier(i["ror"])))).alias("institution_ids"),
        F.coalesce(F.transform(w["referenced_works"], T.short_id), F.array().cast("array<string>")).alias("reference_ids"),
    )


def deposit_works(rows: DataFrame, column: str = "json") -> DataFrame:
    """Works of the second catalogue from JSON text; other columns stay. The year is the first valid one of
    four dates; a reference without a title goes by its DOI."""
    parsed = rows.withColumn("w", F.from_json(column, DEPOSIT_SCHEMA))
    w = F.col("w")
    who = lambda a: F.coalesce(T.squeeze(F.concat_ws(" ", _first_full(a["given"]), _first_full(a["family"]))), T.squeeze(a["name"]))
    named = F.filter(w["author"], lambda a: who(a).isNotNull())
    places = lambda a: F.transform(F.coalesce(a["affiliation"], F.array().cast("array<struct<name: string>>")), lambda p: T.squeeze(p["name"]))
    year = F.coalesce(*(T.valid_year(F.get(F.get(w[d]["date-parts"], F.lit(0)), F.lit(0))) for d in _DATES))
    said = lambda r: F.left(T.squeeze(_first_full(r["article-title"], r["volume-title"], r["unstructured"])), F.lit(200))
    refs = F.transform(w["reference"], lambda r: F.struct(F.coalesce(said(r), T.normalize_doi(r["DOI"])).alias("title"), T.normalize_doi(r["DOI"]).alias("doi")))
    title, doi = F.coalesce(T.squeeze(F.get(w["title"], F.lit(0))), F.lit("")), T.normalize_doi(w["DOI"])
    return parsed.select(
        *rows.columns, F.coalesce(doi, title).alias("work_id"), title.alias("title"), doi.alias("doi"), year.alias("year"), T.squeeze(F.get(w["container-title"], F.lit(0))).alias("venue"),
        _names(F.transform(w["author"], who)).alias("authors"),
        _grouped(F.transform(named, lambda a: F.struct(who(a).alias("name"), F.array_compact(places(a)).alias("ids")))).alias("author_affiliations"),
        _grouped(F.transform(named, lambda a: _pair(who(a), T.orcid_identifier(a["ORCID"])))).alias("author_ids"),
        F.coalesce(F.filter(refs, lambda r: r["title"].isNotNull()), F.array().cast("array<struct<title: string, doi: string>>")).alias("references"),
    )


def pick_candidates(records: DataFrame, candidates: DataFrame, key: str = "record_id") -> DataFrame:
    """For each record (key, title, year, authors) the best of its candidates (key, ordinal, title, year,
    authors): key, ordinal, score; records without a fitting one have no row.

    Titles must match, and where both name authors, a family name. A year that is off by more than one
    rules a candidate out unless an author speaks for it. Ties go to the lower ordinal."""
    side = lambda rows, at: rows.select(key, T.normalize_title("title").alias(f"{at}_title"), F.col("year").alias(f"{at}_year"), T.family_names("authors").alias(f"{at}_family"), F.coalesce(F.size("authors") > 0, F.lit(False)).alias(f"{at}_named"), *(["ordinal"] if at == "c" else []))
    both = side(records, "r").join(side(candidates, "c"), key)
    sure = T.titles_match_natively(F.col("r_title"), F.col("c_title"), T.CANDIDATE_THRESHOLD)
    both = both.withColumn("sure", sure).where("sure is null or sure").withColumn("score", T.title_similarity(F.col("r_title"), F.col("c_title"))).where(F.col("sure") | (F.col("score") >= T.CANDIDATE_THRESHOLD))
    wanted = F.size("r_family") > 0
    share = F.when(wanted & F.col("c_named"), F.size(F.array_intersect("r_family", "c_family")) / F.size("r_family"))
    both = both.withColumn("share", share).where("share is null or share > 0")
    apart = F.when((F.col("r_year") != 0) & (F.col("c_year") != 0), F.abs(F.col("r_year") - F.col("c_year")))
    both = both.withColumn("apart", apart).where("apart is null or apart <= 1 or share > 0")
    score = F.col("score") + AUTHOR_SHARE * F.coalesce("share", F.lit(0.0)) + F.when(F.col("apart") == 0, YEAR_FIT).when(F.col("apart") > 1, -YEAR_MISS).otherwise(0.0)
    best = both.withColumn("score", score).where("score > 0").groupBy(key).agg(F.max_by(F.struct("ordinal", "score"), F.struct("score", -F.col("ordinal"))).alias("b"))
    return best.select(key, "b.*")


def merge_references(records: DataFrame, catalogue: DataFrame, most: int = MAX_REFERENCES, id_col: str = "doc_id") -> DataFrame:
    """``id_col`` and references of each of ``records`` (``id_col``, key, title, references), whose ids are distinct: its own, all of them,
    then those of the ``catalogue`` (key, place, label) under its key, in the order of place and label, while there are fewer than ``most``.
    References are told apart by normalised title, the first spelling holds; the record's own title and empty ones are left out."""
    own = records.select(id_col, F.posexplode("references").alias("place", "label"))
    labels = own.select("label").union(catalogue.select("label")).distinct().withColumn("norm", T.normalize_title(F.col("label"))).where("norm <> ''")
    first = lambda rows, key: rows.join(labels, "label").groupBy(key, "norm").agg(F.min(F.struct("place", "label")).alias("at"))
    listed = lambda rows, key, name: rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at.place", "at.label", "norm"))).alias(name))
    # a record that has room holds fewer than `most`; they and its title are all that it can pass over
    rank = F.row_number().over(Window.partitionBy("key").orderBy("at"))
    near = first(catalogue, "key").withColumn("rank", rank).where(F.col("rank") <= most + 1)
    rows = records.select(id_col, "key", T.normalize_title(F.col("title")).alias("title")).join(listed(first(own, id_col), id_col, "own"), id_col, "left").join(listed(near, "key", "more"), "key", "left")
    none = lambda place: F.array().cast(f"array<struct<place:{place},label:string,norm:string>>")
    usable = lambda c, none: F.filter(F.coalesce(c, none), lambda x: x["norm"] != F.col("title"))
    rows = rows.select(id_col, F.transform(usable("own", none("int")), lambda x: F.struct(x["label"].alias("label"), x["norm"].alias("norm"))).alias("own"), F.transform(usable("more", none(catalogue.schema["place"].dataType.simpleString())), lambda x: F.struct(x["label"].alias("label"), x["norm"].alias("norm"))).alias("more"))
    fresh = F.filter("more", lambda x: ~F.exists("own", lambda o: o["norm"] == x["norm"]))
    return rows.select(id_col, F.transform(F.concat("own", F.slice(fresh, F.lit(1), F.greatest(F.lit(most) - F.size("own"), F.lit(0)))), lambda x: x["label"]).alias("references"))
