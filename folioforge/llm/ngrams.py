"""Near duplicates by an exact Jaccard join on word shingles.

Candidates come from the pigeonhole principle over a partition of the universe. Two sets of a size
band whose Jaccard similarity reaches the threshold differ in at most k tokens. Token hashes are
split into ranges that are worth k + 1 together. A range worth 1 is indexed by the hash of its tokens. A
range worth 2 must meet under one difference, too: it is indexed by each choice of three of its four
quarters, or by its tokens and those with one left out. If all ranges were to miss, the sets would differ
in more than k tokens. Which ranges a band has is decided by cost: the signatures to be written against
the rows of the band that would meet by chance.

Sets that share a signature, after each has left out its commonest as far as it has units to spare, are
candidates; their connected groups are compared exactly in blocks,
by integer arithmetic on the whole sets. So the cost of a large group of near copies is that of
matrix products, and no list of its pairs is made. Equal sets are one candidate.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.llm import words
from folioforge.operators.blocks import compare_blocks, local_roots
from folioforge.operators.components import connected_components
from folioforge.plans.storage import cut, drop

SHINGLE_WORDS = 3
#: Two sets link when 100 * intersection >= PERCENT * union.
PERCENT = 90
#: Sets of a chunk; a task compares two chunks.
CHUNK_SETS = 256
#: Tokens of a tile of a matrix product.
TILE = 4096
#: What a chance candidate costs, in signatures.
CHANCE_COST = 50.0
_MASK_BITS = 23
#: Bits of the bitmap (16 MB) that leaves most signatures of one set out before they are joined.
SIGN_BITS = 27
_MULTIPLIERS = np.random.default_rng(77).integers(1, 2**63, size=64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


SINGLE, QUARTERS, DELETIONS = 0, 1, 2


@dataclass(frozen=True)
class Scheme:
    """Bands of sizes, the units (each bears a difference, and one is left) that each band's ranges are worth,
    and the kind of its ranges: SINGLE, or two units each as QUARTERS or DELETIONS.

    Band i has the sizes edges[i] to edges[i + 1] - 1; sets that link lie in the same band or in
    neighbours. Scheme i serves pairs of which the larger lies in band i, so that a set writes
    signatures of the scheme of its band and of the next."""

    edges: np.ndarray
    units: np.ndarray
    spare: np.ndarray
    kinds: np.ndarray


@lru_cache(maxsize=8)
def _edges(percent: int, most: int) -> tuple[int, ...]:
    edges = [1]
    while edges[-1] <= most:
        e = edges[-1]
        edges.append(max(e + 1, (e - 1) * 100 // percent + 1))
    return (*edges, edges[-1] * 100 // percent + 2, edges[-1] * 10000 // percent**2 + 4)


def scheme(percent: int, most: int, population: dict[int, int] | None = None) -> Scheme:
    """``most``: the largest size; ``population``: about how many sets have a size in
    [2**i, 2**(i + 1)), for the cost."""
    edges = np.array(_edges(percent, most))
    upper = edges[1:] - 1
    # |a xor b| <= (100 - p) / (100 + p) * (|a| + |b|)
    differences = 2 * upper * (100 - percent) // (100 + percent)
    kinds = np.zeros(len(upper), np.int64)
    for i, k in enumerate(differences):
        u = edges[i] / (k + 1)  # tokens of a unit
        width = (edges[i + 1] - edges[i]) / max(1, edges[i])
        chance = CHANCE_COST * (population or {}).get(int(np.log2(edges[i])), 0) * min(1.0, width)
        # signatures of a unit and rows that meet it by having no token there; single ranges without tokens
        # are indexed by sets only that have more of them than spare ones, about one in a hundred
        cost = [1.1 + 1.5 * np.exp(-u) + 1e-4 * chance * np.exp(-2 * u), 2 + chance * 2 * np.exp(-3 * u), u + 1 + chance * (1 + 4 * u) / 2 * np.exp(-4 * u)]
        kinds[i] = int(np.argmin(cost))
    return Scheme(edges, *units_for(edges, differences, kinds), kinds)


def units_for(edges: np.ndarray, differences: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Units and spare ones of each band. One unit more than the differences is needed, and an even number
    where ranges take two; 0 where only equal sets link. Single ranges get spare units, a tenth of all and
    half as many again as will have no token: sets that link share one range more than are spare. So a set
    with no more empty ranges than that need not index them, and of the others it can leave out as many as are left."""
    units = differences + 1
    spare = np.where(kinds == SINGLE, np.ceil(1.5 * units * np.exp(-edges[:-1] / units)).astype(np.int64) + 1 + units // 10, 0)
    none = differences == 0
    return np.where(none, 0, np.where(kinds == SINGLE, units + spare, units + units % 2)), np.where(none, 0, spare)


def shingle_sets(column: pa.Array, size: int = SHINGLE_WORDS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of each slice of the column: the distinct shingle hashes of its texts, in order, and their bounds.
    A text of fewer words has its whole sequence as the only one; one without words has none."""
    for s in words.scans(column):
        h = words.hashes(s)
        n = len(h) - size + 1
        grams = np.zeros(max(n, 0), np.uint64)
        for j in range(size):
            grams += words.mix(h[j : j + max(n, 0)] + _MULTIPLIERS[20]) * _MULTIPLIERS[j]
        counts = s.counts
        starts = np.arange(max(n, 0))
        whole = starts + size <= s.bounds[np.searchsorted(s.bounds, starts, "right")]
        short = np.flatnonzero((counts > 0) & (counts < size))
        docs = np.concatenate([s.docs[: max(n, 0)][whole], short])
        few = []
        for d in short:
            parts = words.mix(h[s.bounds[d] : s.bounds[d + 1]] + _MULTIPLIERS[20 + int(counts[d])])
            few.append(int(np.sum(parts * _MULTIPLIERS[10 : 10 + len(parts)], dtype=np.uint64)))
        grams = words.mix(np.concatenate([grams[whole], np.array(few, np.uint64)]))
        order = np.lexsort((grams, docs))
        docs, grams = docs[order], grams[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (grams[1:] != grams[:-1])
        yield grams[new], np.searchsorted(docs[new], np.arange(s.rows + 1))


def signatures(grams: np.ndarray, bounds: np.ndarray, plan: Scheme) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Under the scheme of the set's band and under the next: set numbers, their signatures, and for
    each set how many of its signatures it can do without. Sets are given by sorted distinct hashes and bounds."""
    sizes = np.diff(bounds)
    docs = np.repeat(np.arange(len(sizes)), sizes)
    band = np.searchsorted(plan.edges, sizes, "right") - 1
    salted = words.mix(grams + _MULTIPLIERS[40])
    total = np.zeros(len(grams) + 1, np.uint64)
    np.cumsum(salted, out=total[1:])
    for upper in (0, 1):
        rows, signs = [], []
        at = np.maximum(band + upper, 0)
        units, kinds = np.where(sizes > 0, plan.units[at], 0), plan.kinds[at]
        groups = np.where(kinds == SINGLE, units, units // 2)
        first = np.concatenate(([0], np.cumsum(4 * groups)))  # four quarters of each range
        quarter = ((grams >> np.uint64(32)) * (4 * groups)[docs].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
        real = (units > 0)[docs]
        held = np.bincount((first[docs] + quarter)[real], minlength=int(first[-1]))
        # tokens are in the order of their hashes, so a quarter is a run of them
        owner = np.repeat(np.arange(len(sizes)), 4 * groups)
        before = np.concatenate(([0], np.cumsum(held)))
        skipped = np.concatenate(([0], np.cumsum(np.where(units > 0, 0, sizes))))
        begin = before[:-1] + skipped[owner]
        parts = (total[begin + held] - total[begin]).reshape(-1, 4)
        sums, owner = parts.sum(axis=1, dtype=np.uint64), owner[::4]
        number = np.arange(len(owner)) - first[owner] // 4
        key = words.mix((at[owner] * (1 << 24) + number).astype(np.uint64) + _MULTIPLIERS[41])
        bare = held.reshape(-1, 4).sum(axis=1) == 0
        empties = np.bincount(owner[bare], minlength=len(sizes))
        few = (kinds == SINGLE) & (empties <= plan.spare[at])
        skip = bare & few[owner]
        whole = (kinds[owner] != QUARTERS) & ~skip
        rows.append(owner[whole])
        signs.append(words.mix(sums[whole] + key[whole]))
        split = kinds[owner] == QUARTERS
        for j in range(4):
            rows.append(owner[split])
            signs.append(words.mix(sums[split] - parts[split, j] + words.mix(key[split] + _MULTIPLIERS[42 + j])))
        less = real & (kinds == DELETIONS)[docs]
        g = (first[docs] + quarter)[less] // 4
        rows.append(docs[less])
        signs.append(words.mix(sums[g] - salted[less] + key[g]))
        yield np.concatenate(rows), np.concatenate(signs), np.where(few, plan.spare[at] - empties, 0)


_SKETCH = "id long, n long, h1 long, h2 long, signs array<long>, spare int, next_signs array<long>, next_spare int"


def _packed(rows: np.ndarray, values: np.ndarray, sets: int) -> tuple[np.ndarray, np.ndarray]:
    """The values in the order of their sets, and how many each set has."""
    return values[np.argsort(rows, kind="stable")], np.bincount(rows, minlength=sets)


def _sketcher(plan: Scheme, size: int):
    """Columns id, text: the columns of ``_SKETCH``, with the set's size n, its hash (h1, h2) and what
    :func:`signatures` gives. Of equal sets of a batch only the one with the least id has signatures, and none without an id."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = np.asarray(batch.column(0).is_valid())
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            # slice by slice, as packed lists: the working space of a slice is many times what is kept of it
            n, h1, h2, slices = [], [], [], []
            for grams, bounds in shingle_sets(batch.column(1), size):
                sums = lambda v: (lambda c: c[bounds[1:]] - c[bounds[:-1]])(np.concatenate((np.zeros(1, np.uint64), np.cumsum(v, dtype=np.uint64))))  # noqa: B023, E731
                n.append(np.diff(bounds))
                h1.append(sums(words.mix(grams + _MULTIPLIERS[50])))
                h2.append(sums(words.mix(grams + _MULTIPLIERS[51])))
                slices.append([(*_packed(rows, signs, len(bounds) - 1), spare.astype(np.int32)) for rows, signs, spare in signatures(grams, bounds, plan)])
            starts = np.cumsum([0, *map(len, n)])
            n, h1, h2 = (np.concatenate(v or [np.zeros(0, np.int64)]) for v in (n, h1, h2))
            # of equal sets, the one with the least id stands for all; rows without an id only where there is no other
            order = np.lexsort((ids, ~known, h2, h1, n))
            lead = np.ones(len(order), bool)
            lead[1:] = (n[order][1:] != n[order][:-1]) | (h1[order][1:] != h1[order][:-1]) | (h2[order][1:] != h2[order][:-1])
            stands = np.zeros(len(ids), bool)
            stands[order[lead]] = True
            stands &= known
            slices.reverse()
            for a, b in zip(starts[:-1], starts[1:]):
                columns = [batch.column(0).slice(a, b - a), *(pa.array(v[a:b].astype(np.int64)) for v in (n, h1.view(np.int64), h2.view(np.int64)))]
                for signs, counts, spare in slices.pop():
                    signs, counts = signs[np.repeat(stands[a:b], counts)], np.where(stands[a:b], counts, 0)
                    ends = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                    columns += [pa.ListArray.from_arrays(pa.array(ends), pa.array(signs.view(np.int64))), pa.array(spare)]
                yield pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _SKETCH.split(", ")])

    return sketch


def candidate_edges(sets: DataFrame) -> DataFrame:
    """``(id, low)`` from each set to the least one that shares a signature with it.

    Sets that link share more signatures than either has spare. So each leaves as many as it has spare out,
    those that most sets have first; of the signatures two linked sets share, both keep at least the
    rarest. Passages that many documents repeat so join none, and nor does a set that shares no more than it
    has spare. The order is one for all, by count and signature."""
    # as one number, for narrow rows: the spare ones, and the last bit for the scheme
    sign = sets.select("id", (F.col("spare") * 2).alias("tag"), F.explode("signs").alias("sign"))
    sign = sign.unionByName(sets.select("id", (F.col("next_spare") * 2 + 1).alias("tag"), F.explode("next_signs").alias("sign")))
    often = cut(sign.groupBy("sign").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "ngram-often")
    shared = sets.sparkSession.sparkContext.broadcast(np.packbits(_bitmap(F.col("sign").bitwiseAND((1 << SIGN_BITS) - 1) + 1, often, SIGN_BITS), bitorder="little"))

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, mask = shared.value, np.uint64((1 << SIGN_BITS) - 1)
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for last in (0, 1):
                signs, spare = batch.column(1 + 2 * last), batch.column(2 + 2 * last).to_numpy().astype(np.int64)
                values = signs.flatten().to_numpy().view(np.uint64)
                at = values & mask
                keep = np.flatnonzero(bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1)
                row = np.repeat(np.arange(len(ids)), np.diff(signs.offsets.to_numpy()))[keep]
                yield pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(2 * spare[row] + last), pa.array(values[keep].view(np.int64))], ["id", "tag", "sign"])

    sign = sets.select("id", "signs", "spare", "next_signs", "next_spare").mapInArrow(repeated, "id long, tag long, sign long")
    # a set's own signatures: as many as its text makes
    rank = F.row_number().over(Window.partitionBy("id", "tag").orderBy(F.desc("times"), "sign"))
    kept = cut(sign.join(often, "sign").withColumn("rank", rank).where("rank > shiftright(tag, 1)").select("id", "sign"), "ngram-kept")
    low = kept.groupBy("sign").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("sign", "low")
    return kept.join(low, "sign").where("id <> low").select("id", "low")


def compare_sets(percent: int):
    """For :func:`compare_blocks`: rows with id and tokens (sorted distinct hashes as bytes)."""

    def compare(left: pa.Table, right: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        tables = [left] if right is None else [left, right]
        ids = np.concatenate([t.column("id").to_numpy() for t in tables])
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for t in tables for x in t.column("tokens")]
        sizes, n_left = np.array([len(s) for s in sets]), left.num_rows
        tokens, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(tokens, kind="stable")
        tokens, owner = tokens[order], owner[order]
        first = np.ones(len(tokens), bool)
        first[1:] = tokens[1:] != tokens[:-1]
        count = np.diff(np.append(np.flatnonzero(first), len(tokens)))
        shared = np.repeat(count > 1, count)  # a token of one set is in no intersection
        owner, column = owner[shared], np.cumsum(first[shared]) - 1
        n_right = n_left if right is None else len(sets) - n_left
        common = np.zeros((n_left, n_right), np.float32)
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, TILE):
            lo, hi = np.searchsorted(column, [start, start + TILE])
            tile = np.zeros((len(sets), TILE), np.float32)
            tile[owner[lo:hi], column[lo:hi] - start] = 1
            common += tile[:n_left] @ (tile if right is None else tile[n_left:]).T
        common = common.astype(np.int64)
        pair = sizes[:n_left, None] + (sizes[None, :] if right is None else sizes[None, n_left:])
        link = (100 + percent) * common >= percent * pair
        if right is None:
            np.fill_diagonal(link, False)
        a, b = np.nonzero(link)
        b = b if right is None else b + n_left
        ends = a if right is None else np.concatenate((a, b))  # a chunk with itself has each link both ways
        return ids, local_roots(ids, a, b), np.bincount(ends, minlength=len(ids))

    return compare


def _bitmap(at: Column, rows: DataFrame, bits: int) -> np.ndarray:
    """Which of the numbers from 1 to 2**bits ``at`` takes: a bitmap of fixed size, to leave most other rows out before
    a join."""
    parts = rows.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")).collect()
    out = np.zeros(1 << bits, bool)
    for r in parts:
        out[(r["bucket"] - 1) << 15 : r["bucket"] << 15] = np.unpackbits(np.frombuffer(r["bits"], np.uint8), bitorder="little")
    return out


def _residue(col):
    return F.pmod(F.xxhash64(col), F.lit(1 << _MASK_BITS)) + 1


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """One row for each row of ``docs``: its id, n_shingles and component_id, the least id that it
    reaches by links, itself included.

    Texts are compared with A-Z in lower case, by the set of their distinct shingles; a text with fewer
    words has its whole sequence as the one shingle. Texts that are null or have no words link with
    nothing. A row with a null id links with nothing and has a null component. Ids should be
    distinct; rows that repeat an id and a text are alike, rows that share an id and not the text are
    compared by their own text. Other columns are not read. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    # for the cost only: sizes by the length of the text, at six bytes a word
    spread = texts.select(F.floor(F.log2(F.greatest(F.octet_length("text") / 6, F.lit(1)))).cast("int").alias("bits"), F.octet_length("text").alias("bytes")).where("bytes > 0").groupBy("bits").agg(F.count(F.lit(1)).alias("n"), F.max("bytes").alias("most")).collect()
    plan = scheme(percent, max([1, *(r["most"] // 2 + 1 for r in spread)]), {r["bits"]: r["n"] for r in spread})
    wide = cut(texts.mapInArrow(_sketcher(plan, shingle_words), _SKETCH), "ngram-signatures")
    alike = ["n", "h1", "h2"]
    sketch = cut(wide.select("id", *alike), "ngram-sketch")
    edges = candidate_edges(wide.where("n > 0 and id is not null"))
    candidates = connected_components(edges, "id", "low")
    drop(wide)
    sets = sketch.where("n > 0 and id is not null")
    copies = cut(sets.groupBy(*alike).agg(F.min("id").alias("lead"), F.max("id").alias("last")).where("lead <> last").drop("last"), "ngram-copies")
    leads = sets.join(copies, alike, "left").where("lead is null or lead = id").select("id").distinct()
    members = cut(leads.join(candidates.select(F.col("node").alias("id"), F.col("root").alias("grp")), "id"), "ngram-members")
    shared = spark.sparkContext.broadcast(_bitmap(_residue(F.col("id")), members, _MASK_BITS))

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(shared.value[np.asarray(batch.column(0)) - 1]))
            if not batch.num_rows:
                continue
            values = [grams[a:b].tobytes() for grams, bounds in shingle_sets(batch.column(2), shingle_words) for a, b in zip(bounds[:-1], bounds[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(values, pa.binary())], ["id", "tokens"])

    held = texts.where("id is not null").select(_residue(F.col("id")).alias("at"), "id", "text").mapInArrow(tokens, "id long, tokens binary")
    held = held.dropDuplicates(["id"]).join(members, "id")
    rows = held.withColumn("size", (F.octet_length("tokens") / 8).cast("long"))
    band = F.floor(F.log("size") / float(np.log(100 / percent) + 1e-6)).cast("long")  # a ratio at the threshold spans less than a cell
    links = compare_blocks(rows.select("id", "grp", band.alias("cell"), "tokens"), compare_sets(percent), CHUNK_SETS)
    roots = connected_components(links.select("id", "root"), "id", "root")
    out = sketch.select("id", *alike).join(copies, alike, "left").withColumn("lead", F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("lead", "id")))
    out = out.join(roots.select(F.col("node").alias("lead"), "root"), "lead", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("root", "lead", "id").alias("component_id"))
