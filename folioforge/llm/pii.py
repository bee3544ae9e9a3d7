"""Information-theoretic sanitisation of personal data.

Patterns find the protected entities: e-mail and IP addresses, payment cards and telephone numbers.
Co-occurrence over the whole corpus then tells how strongly the words of its documents reveal an entity.
With document frequencies over N documents, an entity e has the information content
IC(e) = log2(N / df(e)), and a word t gives away PMI(e; t) = log2(N df(e, t) / (df(e) df(t))) of it.
A word of a document of e whose PMI reaches ``generalise_at`` of IC(e) is replaced, wherever it stands in
that document, by what kind of word it is; one that reaches ``remove_at`` goes. Words seen with e in fewer
than ``support`` documents prove nothing and stay, and so do the words of an entity of fewer documents.

Shuffles move the words, as numbers, of documents with an entity of ``support`` documents, partial counts
of their pairs with it, and one partial count for each distinct word of an input task; texts never move.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import words
from folioforge.plans.storage import cut

KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: A text without this has no match of the kind.
_NEEDS = {"ip": re.compile(r"[0-9]\.[0-9]"), "card": re.compile(r"[0-9][\x20-]?[0-9]"), "phone": re.compile(r"\+[0-9]")}
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_NOT_ALNUM = re.compile(r"[^0-9a-z\x80-\U0010ffff]+")

SUPPORT = 3
GENERALISE_AT = 0.8
REMOVE_AT = 0.95

_SPAN = "array<struct<kind:string,start:int,end:int>>"
_WORDS = "array<struct<term:long,start:int,end:int>>"
#: Words that a task holds before it hands rows on.
_HELD = 200_000


def luhn(digits: str) -> bool:
    values = [int(d) for d in reversed(digits)]
    return (sum(values[::2]) + sum(sum(divmod(2 * d, 10)) for d in values[1::2])) % 10 == 0


def _valid(kind: str, text: str) -> bool:
    if kind == "email":
        return True
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in text.split("."))
    digits = "".join(c for c in text if "0" <= c <= "9")
    return 9 <= len(digits) <= 15 if kind == "phone" else 13 <= len(digits) <= 19 and luhn(digits)


_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """What PATTERNS["email"] matches, in time linear in the text: from each @ and its domain back
    over the local part, which ends at the match before."""
    floor = 0
    for m in _DOMAIN.finditer(text):
        start = m.start()
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            yield start, m.end()
            floor = m.end()


#: What PATTERNS["ip"] matches, in time linear in the text: a match begins and ends with whole runs of digits.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The protected entities of a text: by kind, then by start; code points, end exclusive.
    Matches of a kind are leftmost and do not overlap; those that fail its test are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    for kind in KINDS[1:]:
        if _NEEDS[kind].search(text):
            pattern = _IP if kind == "ip" else PATTERNS[kind]
            out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if _valid(kind, m.group())]
    return out


def _words(text: str, spans: list[tuple[str, int, int]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Terms, starts and ends of the words of a text that touch no span."""
    found = list(_WORD.finditer(text))
    starts = np.array([m.start() for m in found], np.int32)
    ends = np.array([m.end() for m in found], np.int32)
    free = np.ones(len(found), bool)
    for _, a, b in spans:
        free[np.searchsorted(ends, a, "right") : np.searchsorted(starts, b, "left")] = False
    terms = [_NOT_ALNUM.sub("", _fold(m.group())) if f else "" for m, f in zip(found, free)]
    free &= np.array([t != "" for t in terms], bool)
    return [t for t in terms if t], starts[free], ends[free]


_FOLD = {c: c + 32 for c in range(65, 91)}


def _fold(text: str) -> str:
    return text.translate(_FOLD)


def _term_hashes(terms: list[str]) -> list[int]:
    return words.hash_words(terms).view(np.int64).tolist() if terms else []


def _finder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of columns id, row, text: entities and, of texts that have any, all words beside them."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        first, held, bases, entities, found, counts = 0, 0, [], [], [], []
        for i, text in enumerate(batch.column(2)):
            text = text.as_py() or ""
            spans = base_spans(text)
            bases.append([{"kind": k, "start": a, "end": b} for k, a, b in spans])
            terms, starts, ends = _words(text, spans) if spans else ([], np.zeros(0, np.int32), np.zeros(0, np.int32))
            ids = _term_hashes([f"{k}:{_fold(text[a:b])}" for k, a, b in spans] + terms)
            entities.append(sorted(set(ids[: len(spans)])))
            found.append((np.array(ids[len(spans) :], np.int64), starts, ends))
            counts.append(len(terms))
            held += len(terms)
            if held > _HELD or i + 1 == batch.num_rows:
                offsets = pa.array(np.concatenate(([0], np.cumsum(counts))).astype(np.int32))
                words_ = pa.StructArray.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found)], ["term", "start", "end"])
                many = len(bases)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, many), batch.column(1).slice(first, many), pa.array(bases, span), pa.ListArray.from_arrays(offsets, words_), pa.array(entities, pa.list_(pa.int64()))], ["id", "row", "base", "words", "entities"])
                first, held, bases, entities, found, counts = first + many, 0, [], [], [], []


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of this batch in which a term occurs, for each term."""
    for batch in batches:
        seen = []
        for scan in words.scans(batch.column(0)):
            h = words.hashes(scan, keep=words.ALNUM)
            docs = scan.docs.astype(np.uint64)
            order = np.lexsort((docs, h))
            h, docs = h[order], docs[order]
            first = np.ones(len(h), bool)
            first[1:] = (h[1:] != h[:-1]) | (docs[1:] != docs[:-1])
            seen.append(h[first])
        terms, n = np.unique(np.concatenate(seen or [np.zeros(0, np.uint64)]), return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n.astype(np.int64))], ["term", "n"])


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", support: int = SUPPORT, generalise_at: float = GENERALISE_AT, remove_at: float = REMOVE_AT) -> DataFrame:
    """One row for each row of ``docs``: its id, ``base`` (entities) and ``terms`` (revealing words),
    both arrays of (kind, start, end) in code points, in the order of kinds and starts. The kind of
    a term is ``term_generalise`` or ``term_remove``.

    A null text is empty and has no spans. Rows with a null id are kept. Repeated rows each count
    as a document and each get their spans. Columns of ``docs`` other than the two named are not
    looked at. An empty table gives an empty result.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    keyed = texts.select("id", F.xxhash64("id", "text").alias("row"), "text")
    found = cut(keyed.mapInArrow(_finder, f"id long, row long, base {_SPAN}, words {_WORDS}, entities array<long>"), "pii-found")
    many = found.count()
    alone = found.where("size(entities) > 0").select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    # no pair has more documents than its entity
    often = cut(alone.where(F.col("df_entity") >= support), "pii-entities")
    held = found.where("size(words) > 0").select("row", F.explode("entities").alias("entity")).distinct().join(often, "entity").groupBy("row").agg(F.collect_list("entity").alias("held"))
    beside = cut(found.where("size(words) > 0").select("row", "words").join(held, "row"), "pii-words")
    pairs = beside.select(F.explode("held").alias("entity"), F.array_distinct("words.term").alias("terms")).select("entity", F.explode("terms").alias("term"))
    together = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("df_both")).where(F.col("df_both") >= support)
    terms = texts.select("text").mapInArrow(_count_terms, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term"))
    told = together.join(often, "entity").join(terms, "term")
    n = F.lit(float(many))
    told = told.withColumn("ic", F.log2(n / F.col("df_entity"))).withColumn("pmi", F.log2(n * F.col("df_both") / (F.col("df_entity") * F.col("df_term"))))
    told = told.where((F.col("ic") > 0) & (F.col("pmi") >= generalise_at * F.col("ic")))
    told = told.select("entity", "term", F.when(F.col("pmi") >= remove_at * F.col("ic"), "term_remove").otherwise("term_generalise").alias("kind"))
    told = cut(told, "pii-told")
    spots = beside.select("row", F.explode("held").alias("entity"), "words").select("row", "entity", F.explode("words").alias("x")).select("row", "entity", "x.term", "x.start", "x.end")
    spans = spots.join(told, ["entity", "term"]).groupBy("row").agg(F.array_sort(F.collect_set(F.struct("kind", "start", "end"))).alias("terms"))
    # a word beside two entities may be told both ways: the stronger way holds
    spans = spans.select("row", F.filter("terms", lambda t: (t["kind"] == "term_remove") | ~F.exists("terms", lambda o: (o["kind"] == "term_remove") & (o["start"] == t["start"]))).alias("terms"))
    none = F.array().cast(_SPAN)
    return found.join(spans, "row", "left").select(F.col("id").alias(id_col), "base", F.coalesce("terms", none).alias("terms"))


_MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def mask(text: str | None, base: list, terms: list) -> str | None:
    """The text with entities replaced by their kind, generalised words by what they are (a number,
    a name, a word) and removed words left out. Of spans that overlap, the first and then the
    longest holds."""
    if text is None:
        return None
    out, at = [], 0
    for start, end, kind in sorted(((s["start"], s["end"], s["kind"]) for s in (*base, *terms)), key=lambda s: (s[0], -s[1])):
        if start < at:
            continue
        word = text[start:end]
        kept = _MASKS.get(kind, "" if kind == "term_remove" else "[NUMBER]" if any(c.isdigit() for c in word) else "[NAME]" if word[:1].isupper() else "[WORD]")
        out += [text[at:start], kept]
        at = end
    return "".join([*out, text[at:]])


def sanitise(docs: DataFrame, found: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``text_col`` masked. ``found`` is a result of :func:`find_personal_data` over the
    same rows; ids must be distinct. Rows with a null id lose their base entities only."""
    found = find_personal_data(docs, id_col, text_col, **options) if found is None else found
    columns = docs.columns
    kept = found.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("key"), "base", "terms")
    rows = docs.select(F.col(id_col).alias("key"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    joined = rows.join(kept, "key", "left").select(F.col(f"row.`{text_col}`").alias("text"), "base", "terms", "row")
    at = columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, base, terms = (batch.column(i).to_pylist() for i in range(3))
            own = [[{"kind": k, "start": a, "end": e} for k, a, e in base_spans(t or "")] if b is None else b for t, b in zip(texts, base)]
            clean = pa.array([mask(t, b, x or []) for t, b, x in zip(texts, own, terms)], pa.string())
            fields = batch.column(3).flatten()
            yield pa.RecordBatch.from_arrays([clean if i == at else f for i, f in enumerate(fields)], columns)

    return joined.mapInArrow(run, docs.schema)


def span_list(spans) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
