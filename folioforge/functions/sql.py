"""The functions that SQL has no name for, as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from folioforge.functions import text as T


@udtf(returnType="part string")
class TitleWords:
    """The words of a normalised title, a row each."""

    def eval(self, title: str):
        for word in (title or "").split():
            yield (word,)


def register(spark: SparkSession) -> None:
    """norm_doi, norm_title_ascii, orcid_id, ror_id and excerpt_of as SQL expressions; parse_person, canvas_id and fold_text as
    Arrow functions; title_words as a table function."""
    spark.udf.register("parse_person", T.parse_person)
    spark.udf.register("canvas_id", T.canvas_id)
    spark.udf.register("fold_text", T._fold_any)
    spark.udtf.register("title_words", TitleWords)
    quoted = T.DOI_PATTERN.replace("\\", "\\\\").replace("'", "\\'")
    for name, arguments, kind, body in (
        ("norm_doi", "s string", "string", f"nullif(lower(regexp_replace(regexp_extract(s, '{quoted}', 1), '[.,;:)\\\\]}}]+$', '')), '')"),
        ("norm_title_ascii", "s string", "string", "trim(regexp_replace(lower(regexp_replace(coalesce(s, ''), '\\\\(\\\\s*(?:1[5-9]|20)\\\\d{2}[a-z]?\\\\s*\\\\)', ' ')), '[^0-9a-z]+', ' '))"),
        ("person_compatible", "a struct<family:string,folded:array<string>>, b struct<family:string,folded:array<string>>", "boolean", "a.family <> '' and a.family = b.family and forall(zip_with(slice(a.folded, 1, least(size(a.folded), size(b.folded))), slice(b.folded, 1, least(size(a.folded), size(b.folded))), (x, y) -> if(length(x) > 1 and length(y) > 1, x = y, left(x, 1) = left(y, 1))), f -> f)"),
    ):
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {kind} return {body}")
