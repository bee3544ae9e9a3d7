"""Toxicity by gradient-boosted trees over dense features.

Features of a text: how dense words of a lexicon are, also when written with look-alike signs; how
near they stand to the second person; rates of capitals, of shouted words and of punctuation. The
lexicon is a short fixed list and the words that a sample of labelled rows shows to be toxic. Trees
of fixed depth are grown on histograms with logistic loss, and an isotonic regression on rows that
grew no tree turns their sum into a probability. All of it is numpy; scoring is one scan, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm import words
from folioforge.plans.storage import cut

#: Labelled rows that the model is fitted on, about: a hash of the id decides which.
SAMPLE_ROWS = 20_000
#: Learnt words of the lexicon at most, the documents that must show one, and its least log-odds.
LEARNT_WORDS, LEARNT_DOCS, LEARNT_ODDS = 256, 8, 2.5
THRESHOLD = 0.3
#: Words between a word of the lexicon and the second person.
NEAR = 5

#: Insults, and words for the person spoken to.
INSULTS = "idiot idiots moron morons stupid loser losers scum trash garbage pathetic worthless disgusting clown fool dumb imbecile cretin bastard bitch asshole shit fuck fucking hate kill vermin filth parasite pig rat retard freak idioten dumm blöd abschaum arschloch scheiße hure trottel idiote idiots connard salope ordure stupide débile merde crétin idiota estúpido imbécil basura puta mierda cabrón".split()
SECOND_PERSON = "you your yours yourself youre u ur du dich dir dein deine deinen ihr euch euer tu te toi ton ta tes vous votre vos ti tú tus usted ustedes vosotros".split()
FEATURES = ("insults", "insult_hits", "log_words", "lexicon", "lexicon_hits", "learnt", "learnt_hits", "disguised", "disguised_hits", "near_you", "second_person", "capitals", "shouted", "exclamations", "questions", "punctuation", "punctuation_runs", "mixed_words", "single_letters")

_SAME = np.arange(256, dtype=np.uint8)
_LETTER = words.byte_set((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_UPPER = words.byte_set((0x41, 0x5A))
_DIGIT = words.byte_set((0x30, 0x39))
_PUNCT = words.byte_set((0x21, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7E))
#: Look-alike signs and the letters they stand for.
_LOOK_ALIKE = words.LOWER.copy()
for _sign, _letter in zip("0134578@$!|+", "oieastbasiit"):
    _LOOK_ALIKE[ord(_sign)] = ord(_letter)


def held_out(doc_id: Column) -> Column:
    """Rows that labels are never learnt from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(h), bool)
    return table[np.minimum(np.searchsorted(table, h), len(table) - 1)] == h


def features(column: pa.Array, lexicon: np.ndarray, learnt: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; ``lexicon`` and ``learnt`` are sorted hashes of words."""
    second = np.sort(words.hash_words(SECOND_PERSON))
    both = np.union1d(lexicon, learnt)
    out = []
    for s in words.scans(column, words.SPACED, _SAME):
        plain = words.hashes(s, words.ALNUM, words.LOWER)
        disguise = words.hashes(s, _LETTER, _LOOK_ALIKE)
        n = np.maximum(s.counts, 1).astype(float)
        row = lambda values: words.per_row(values, s.bounds)
        base, own, you = _among(plain, lexicon), _among(plain, learnt), _among(plain, second)
        hidden = _among(disguise, both) & ~base & ~own
        toxic = base | own | hidden
        spots, yous, docs = np.flatnonzero(toxic), np.flatnonzero(you), s.docs
        near = np.zeros(len(plain), bool)
        if len(spots) and len(yous):
            after = np.minimum(np.searchsorted(yous, spots), len(yous) - 1)
            for k in (after, np.maximum(after - 1, 0)):
                near[spots] |= (np.abs(yous[k] - spots) <= NEAR) & (docs[yous[k]] == docs[spots])
        chars = np.maximum(np.diff(s.offsets), 1).astype(float)
        by_byte = lambda table: words.per_row(table[s.data], s.offsets)
        lens = s.ends - s.starts
        total = lambda table: np.concatenate(([0], np.cumsum(table[s.data], dtype=np.int64)))
        inside = lambda table: (lambda c: c[s.ends] - c[s.starts])(total(table))
        uppers, letters = inside(_UPPER), inside(_LETTER)
        marks = _PUNCT[s.data]
        runs = np.zeros(len(marks), bool)
        runs[1:] = marks[1:] & marks[:-1]
        runs[s.offsets[:-1][s.offsets[:-1] < len(runs)]] = False  # not across texts
        out.append(np.column_stack([
            row(toxic) / n, np.minimum(row(toxic), 20), np.log1p(s.counts), row(base) / n, np.minimum(row(base), 20), row(own) / n, np.minimum(row(own), 20), row(hidden) / n, np.minimum(row(hidden), 20), row(near) / n, row(you) / n,
            by_byte(_UPPER) / np.maximum(by_byte(_LETTER), 1), row((uppers == lens) & (lens > 2)) / n,
            words.per_row(s.data == 0x21, s.offsets) / chars, words.per_row(s.data == 0x3F, s.offsets) / chars, by_byte(_PUNCT) / chars, words.per_row(runs, s.offsets) / chars,
            row((inside(_DIGIT) > 0) & (letters > 0)) / n, row(lens == 1) / n,
        ]))
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Trees:
    """Boosted trees of one depth. ``feature`` and ``cut`` have a row of inner nodes for each tree,
    in heap order, ``leaf`` its leaves; ``steps`` and ``values`` are the isotonic calibration."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    start: float
    steps: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.full(len(x), self.start), np.arange(len(x))
        inner = self.feature.shape[1]
        for f, c, leaf in zip(self.feature, self.cut, self.leaf):
            node = np.zeros(len(x), np.int64)
            while node.size and node[0] < inner:
                node = 2 * node + 1 + (x[rows, f[node]] > c[node])
            total += leaf[node - inner] if node.size else 0
        return total

    def score(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability; the raw one breaks ties within a step."""
        m = self.margin(x)
        calibrated = np.interp(m, self.steps, self.values) if len(self.steps) else 1 / (1 + np.exp(-m))
        return np.clip(0.99 * calibrated + 0.01 / (1 + np.exp(-m)), 0, 1)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators: the rising step function nearest to ``y``, at the ends of its steps."""
    at, index = np.unique(x, return_inverse=True)  # equal ones are one
    blocks: list[list[float]] = []  # sum, weight, least x, greatest x
    for v, total, many in zip(at, np.bincount(index, y, len(at)), np.bincount(index, minlength=len(at))):
        blocks.append([total, many, v, v])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            s, w, _, hi = blocks.pop()
            blocks[-1][0] += s
            blocks[-1][1] += w
            blocks[-1][3] = hi
    return np.array([v for b in blocks for v in (b[2], b[3])]), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


def fit(x: np.ndarray, y: np.ndarray, calibrate: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.2, bins: int = 64, l2: float = 1.0) -> Trees:
    """Trees on rows outside ``calibrate``, and their calibration on the rows inside."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins)[1:-1])) if len(c) else np.zeros(1) for c in x.T]
    # most rows have no insult at all: a bin for zero alone, and quantiles of what is above it
    edges = [np.unique(np.concatenate([e, [0.0], np.quantile(c[c > 0], np.linspace(0, 1, bins // 2)[:-1]) if (c > 0).any() else [0.0]])) for e, c in zip(edges, x.T)]
    tx, ty = x[~calibrate], y[~calibrate].astype(float)
    rate_of = np.clip(ty.mean() if len(ty) else 0.5, 1e-4, 1 - 1e-4)
    start = float(np.log(rate_of / (1 - rate_of)))
    binned = np.column_stack([np.searchsorted(e, c, "left") for e, c in zip(edges, tx.T)])
    width, inner = max(len(e) for e in edges) + 1, 2**depth - 1
    margin, features_, cuts, leaves = np.full(len(tx), start), [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - ty, p * (1 - p)
        node, feature, cut_at = np.zeros(len(tx), np.int64), np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for f in range(tx.shape[1]):
                slot = (node - first) * width + binned[:, f]
                gs, hs = (np.bincount(slot, w, n * width).reshape(n, width).cumsum(axis=1) for w in (g, h))
                gt, ht = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + l2) + (gt - gs) ** 2 / (ht - hs + l2) - gt**2 / (ht + l2)
                gain = np.where((hs > 0.5) & (ht - hs > 0.5), gain, -1)[:, : len(edges[f])]
                at = gain.argmax(axis=1)
                better = gain[np.arange(n), at] > best
                best = np.where(better, gain[np.arange(n), at], best)
                feature[first : first + n][better] = f
                cut_at[first : first + n][better] = edges[f][at[better]]
            node = 2 * node + 1 + (tx[np.arange(len(tx)), feature[node]] > cut_at[node])
        gl, hl = np.bincount(node - inner, g, inner + 1), np.bincount(node - inner, h, inner + 1)
        leaf = -rate * gl / (hl + l2)
        margin += leaf[node - inner]
        features_.append(feature)
        cuts.append(cut_at)
        leaves.append(leaf)
    trees = Trees(np.array(features_), np.array(cuts), np.array(leaves), start, np.zeros(0), np.zeros(0))
    if calibrate.any():
        trees.steps, trees.values = isotonic(trees.margin(x[calibrate]), y[calibrate].astype(float))
    return trees


@dataclass
class Model:
    lexicon: np.ndarray
    learnt: np.ndarray
    trees: Trees | None

    def score(self, column: pa.Array) -> np.ndarray:
        """0 for every text where there was no label to learn from."""
        if self.trees is None:
            return np.zeros(len(column))
        return self.trees.score(features(column, self.lexicon, self.learnt))


def _word_labels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each word: the toxic and the other texts of this batch that have it."""
    for batch in batches:
        toxic = np.asarray(batch.column(1)).astype(np.int64)
        found = [np.zeros((3, 0), np.uint64)]
        for s in words.scans(batch.column(0)):  # a text is in one slice, so the counts of slices add up
            h = words.hashes(s, words.ALNUM)
            pairs = np.unique(np.column_stack([h, (s.docs + s.first).astype(np.uint64)]), axis=0)
            word, at = np.unique(pairs[:, 0], return_inverse=True)
            n1 = np.bincount(at, toxic[pairs[:, 1].astype(np.int64)], len(word))
            found.append(np.stack([word, n1.astype(np.uint64), np.bincount(at, minlength=len(word)).astype(np.uint64)]))
        found = np.concatenate(found, axis=1)
        word, at = np.unique(found[0], return_inverse=True)
        n1, n = (np.bincount(at, v, len(word)) for v in found[1:])
        yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n1.astype(np.int64)), pa.array((n - n1).astype(np.int64))], ["word", "toxic", "other"])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = SAMPLE_ROWS) -> Model:
    """A model of the labelled rows of ``docs`` that are not held out. Of labels that repeat an id the
    greatest holds; null ids and labels are left out, and so are null and empty texts' words, for there are none. Other columns
    are not read."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").where(~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    many = known.count()
    # by a share of all hashes, which is never rounded to none
    sample = known.where(F.abs(F.xxhash64("id").cast("double")) <= min(1.0, sample_rows / max(1, many)) * 2.0**63)
    sample = sample.withColumn("calibrate", F.pmod(F.xxhash64(F.lit("calibrate"), "id"), F.lit(4)) == 0)
    texts = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = cut(texts.join(F.broadcast(sample), "id"), "toxicity-sample")  # about sample_rows narrow rows
    # what calibrates has no part in the lexicon, nor in the trees
    counts = texts.where("not calibrate").select("text", "toxic").mapInArrow(_word_labels, "word long, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    sizes = texts.groupBy().agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("n1")).first()
    lexicon = np.unique(words.hash_words(INSULTS))
    if not sizes["n1"] or sizes["n1"] == sizes["n"]:
        return Model(lexicon, np.zeros(0, np.uint64), None)
    base = sizes["n1"] / (sizes["n"] - sizes["n1"])
    odds = F.log((F.col("toxic") + 0.5) / ((F.col("other") + 0.5) * base))
    learnt = counts.where(F.col("toxic") >= LEARNT_DOCS).withColumn("odds", odds).where(F.col("odds") >= LEARNT_ODDS).orderBy(F.desc("toxic"), "word").limit(LEARNT_WORDS).collect()
    learnt = np.sort(np.array([r["word"] for r in learnt], np.int64).view(np.uint64))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1), lexicon, learnt)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *(pa.array(c) for c in x.T)], ["id", "toxic", "calibrate", *FEATURES])

    fields = ", ".join(f"{f} double" for f in FEATURES)
    rows = texts.select("id", "text", "toxic", "calibrate").mapInArrow(measure, f"id {texts.schema['id'].dataType.simpleString()}, toxic int, calibrate boolean, {fields}").toPandas()  # the bounded sample
    rows = rows.sort_values(list(rows.columns)).reset_index(drop=True)
    return Model(lexicon, learnt, fit(rows[list(FEATURES)].to_numpy(), rows["toxic"].to_numpy(), rows["calibrate"].to_numpy().astype(bool)))


def _scored(docs: DataFrame, shared, text_at: int, schema: str, keep_below: float | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = shared.value.score(batch.column(text_at))
            if keep_below is not None:
                yield batch.filter(pa.array(score < keep_below))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["id", "score"])

    return docs.mapInArrow(run, schema)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``docs``: its id, held_out, score (0 to 1) and predicted (1 from
    ``threshold`` on). Only the text makes the score; a null text scores as an empty one. Other
    columns are not read, repeated rows score alike."""
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    out = _scored(texts, docs.sparkSession.sparkContext.broadcast(model), 1, f"id {kind}, score double", None)
    return out.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with all their columns. A null text scores as an empty one,
    a null id is of no account, repeated rows are all kept or all gone."""
    return _scored(docs, docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), docs.schema, threshold)
