"""Mixing sources to target weights by subset-sum budget fitting.

Of each source, documents are counted by exact length. Whole rounds over the source come first; what
its target has left after them is a subset-sum problem over (length, count): lengths are taken in
proportion, the rest is filled from the longest down, and a bounded-knapsack dynamic program closes
the last gap, exactly where lengths allow it. Which documents of a length are taken is decided by a
seeded hash, so a rerun takes the same.

The dynamic program of a source sees one row for each distinct length, never its documents. Ranks
within a length are counted in slices of the hash, so a length that a third of all rows share is
ranked by many tasks.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.storage import cut

WEIGHTS = (3.0, 1.0, 2.0)
SHARE = 1.5
MOST_TIMES = 2
SEED = 20240501
#: Rows of a hash slice, about, in which the documents of a length are ranked; and the least number of slices.
SLICE_ROWS, SLICES = 1 << 17, 512
#: Words that the dynamic program looks at, at most: what no length above leaves open it closes as far as lengths allow.
GAP = 1 << 16


def word_count(text) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def fill_targets(sizes: list[float], weights: list[float], budget: float, most_times: float) -> list[float]:
    """Shares of ``budget`` by weight; a share stops at ``most_times`` its size, and what it gives
    up is shared again among the others, by weight, until none is above."""
    targets, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(budget)
    while free:
        total = sum(weights[i] for i in free)
        share = {i: left * weights[i] / total if total else 0.0 for i in free}
        full = {i for i in free if share[i] > most_times * sizes[i]}
        if not full:
            for i in free:
                targets[i] = share[i]
            break
        for i in full:
            targets[i] = float(most_times * sizes[i])
            left -= targets[i]
        free -= full
    return targets


def fit_subset(lengths: np.ndarray, counts: np.ndarray, goal: int, gap: int = GAP) -> np.ndarray:
    """How many of each length to take so that their sum comes near to ``goal``: from below, or from
    above, by leaving out what comes near to the rest. ``lengths`` are distinct and above 0."""
    below = _fit_below(lengths, counts, goal, gap)
    short = goal - int((below * lengths).sum())
    if short <= 0:
        return below
    out = _fit_below(lengths, counts, int((lengths * counts).sum()) - goal, gap)
    above = counts.astype(np.int64) - out
    return above if int((above * lengths).sum()) - goal < short else below


def _fit_below(lengths: np.ndarray, counts: np.ndarray, goal: int, gap: int) -> np.ndarray:
    order = np.argsort(-lengths, kind="stable")
    size, most = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    total = int((size * most).sum())
    if goal >= total:
        return counts.astype(np.int64).copy()
    if goal <= 0:
        return np.zeros(len(lengths), np.int64)
    took = (most.astype(object) * goal // total).astype(np.int64)
    left = goal - int((took * size).sum())
    limit = min(gap, max(1024, 4 * int(size[len(size) // 2])))
    for i in range(len(size)):
        if left <= limit:
            break
        more = min(int(most[i] - took[i]), (left - limit) // int(size[i]))
        took[i] += more
        left -= more * int(size[i])
    if left > limit:  # only lengths above the gap are left
        for i in range(len(size) - 1, -1, -1):
            more = min(int(most[i] - took[i]), left // int(size[i]))
            took[i] += more
            left -= more * int(size[i])
    # give some of each length back, so that the program has something to choose from
    for i in range(len(size) - 1, -1, -1):
        back = min(int(took[i]), -(-(limit - left) // (int(size[i]) * (i + 1)))) if left < limit else 0
        back = min(back, (limit - left) // int(size[i]))
        took[i] -= back
        left += back * int(size[i])
    # bounded knapsack: bit b of the state says that b words can be made of the parts so far; ``by`` which part made it first
    mask, state, parts, by = (1 << (left + 1)) - 1, 1, [], np.full(left + 1, -1, np.int32)
    for i in range(len(size)):
        spare, lot = int(most[i] - took[i]), 1
        while spare > 0 and not state >> left & 1 and size[i] <= left:
            lot = min(lot, spare)
            if lot * int(size[i]) > left:
                lot = left // int(size[i])
                spare = lot
            new = (state << lot * int(size[i])) & mask & ~state
            if new:
                bits = np.unpackbits(np.frombuffer(new.to_bytes(left // 8 + 1, "little"), np.uint8), bitorder="little")
                by[np.flatnonzero(bits)] = len(parts)
                parts.append((i, lot))
                state |= new
            spare -= lot
            lot *= 2
    made = state.bit_length() - 1
    while made:  # what was left before a part made it, earlier parts had made
        i, lot = parts[by[made]]
        took[i] += lot
        made -= lot * int(size[i])
    out = np.zeros(len(lengths), np.int64)
    out[order] = took
    return out


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    """Columns src, size, n, target of one source: of each length, ``rounds`` for every document and ``extra``
    documents once more."""
    target, sizes, counts = float(pdf["target"].iloc[0]), pdf["size"].to_numpy(), pdf["n"].to_numpy()
    total = int((sizes * counts).sum())
    rounds = int(target // total) if total else 0
    extra = fit_subset(sizes, counts, round(target - rounds * total))
    return pd.DataFrame({"src": pdf["src"], "size": sizes, "rounds": rounds, "extra": extra})


def _sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    src = F.struct(F.col(source_col).isNull().alias("none"), F.coalesce(F.col(source_col), F.lit("")).alias("name"))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), F.col(id_col), src.alias("src"), word_count(F.col(text_col)).alias("size"), F.xxhash64(F.col(id_col), F.lit(seed)).alias("slice_hash"), F.xxhash64(*columns).alias("tie"))


def _numbered(sources: DataFrame) -> DataFrame:
    """With ``place``, the number of each row in the order of ``src``: rows are numbered in ranges, and ranges by their counts."""
    ranged = cut(sources.repartitionByRange("src").withColumn("range", F.spark_partition_id()), "mix-ranges")
    counts = sorted(ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect())  # one row for each partition
    starts = dict(zip((r["range"] for r in counts), np.cumsum([0, *(r["n"] for r in counts)]).tolist()))
    first = F.create_map(*(F.lit(int(x)) for pair in starts.items() for x in pair))[F.col("range")] if starts else F.lit(0)
    return ranged.withColumn("place", first + F.row_number().over(Window.partitionBy("range").orderBy("src")) - 1).drop("range")


def _with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, most_times: float) -> DataFrame:
    """``sources`` (src, words) with source_size and target as :func:`fill_targets` gives it, worked out by sums over all sources."""
    weight = F.get(F.array(*(F.lit(float(w)) for w in weights)), (F.col("place") % len(weights)).cast("int"))
    rows = cut(_numbered(sources).withColumn("weight", weight), "mix-sources")
    left = share * float(rows.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0])
    rows = rows.withColumn("full_at", F.lit(None).cast("int"))
    number = 0
    while True:
        free = F.col("full_at").isNull()
        total = rows.where(free).agg(F.coalesce(F.sum("weight"), F.lit(0.0))).first()[0]
        each = F.lit(left) * F.col("weight") / F.lit(total) if total else F.lit(0.0)
        full = free & (each > most_times * F.col("words"))
        gone = rows.where(full).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("words"), F.lit(0)).alias("words")).first()
        if not gone["n"]:
            break
        rows = cut(rows.withColumn("full_at", F.when(full, number).otherwise(F.col("full_at"))), "mix-sources")
        left -= float(most_times * gone["words"])
        number += 1
    target = F.when(free, each).otherwise((most_times * F.col("words")).cast("double"))
    return rows.select("src", F.col("words").alias("source_size"), target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most_times: int = MOST_TIMES, seed: int = SEED, carry: bool = False) -> DataFrame:
    """One row for each row of ``docs``: ``id_col``, size (words of the text; null: 0), source_size,
    target (of its source) and taken (words that the mix takes of it: its size times the number of
    repeats, at most ``most_times``).

    Sources, ordered by code point with null last, get ``weights`` in turn and together ``share`` of
    all words. A document without words takes none. Repeated rows and ids are documents of their
    own. Extra columns are not read, unless ``carry`` asks for the whole row as a struct ``row``. An
    empty table gives an empty result.
    """
    sized = _sized(docs, id_col, text_col, source_col, seed).drop("row", "tie")
    sized = cut(sized, "mix-sizes")
    slices = max(SLICES, -(-sized.count() // SLICE_ROWS))
    slice_ = F.pmod("slice_hash", F.lit(slices)).cast("int").alias("slice")
    counted = cut(sized.groupBy("src", "size", slice_).agg(F.count(F.lit(1)).alias("n")), "mix-counts")
    sources = counted.groupBy("src").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    goal = cut(_with_targets(sources, weights, share, most_times), "mix-goals")  # one row for each source
    lengths = counted.where("size > 0").groupBy("src", "size").agg(F.sum("n").alias("n"))
    plan = lengths.join(goal, "src").select(F.to_json("src").alias("name"), "src", "size", "n", "target")
    plan = plan.groupBy("name").applyInPandas(_plan, "src struct<none:boolean,name:string>, size long, rounds long, extra long")
    before = F.coalesce(F.sum("n").over(Window.partitionBy("src", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = counted.select("src", "size", "slice", before.alias("before")).join(plan, ["src", "size"], "left").join(goal, "src")
    tie = []
    if carry:  # whole rows are ranked: texts move once
        sized, tie = _sized(docs, id_col, text_col, source_col, seed), ["tie"]
    rank = F.row_number().over(Window.partitionBy("src", "size", "slice").orderBy("slice_hash", id_col, *tie))
    sized = sized.withColumn("slice", slice_)
    ranked = sized.select(id_col, *(["row"] if carry else []), "src", "size", "slice", rank.alias("rank")).join(parts, ["src", "size", "slice"], "left")
    times = F.coalesce(F.col("rounds") + F.when(F.col("before") + F.col("rank") <= F.col("extra"), 1).otherwise(0), F.lit(0))
    return ranked.select(id_col, *(["row"] if carry else []), "size", "source_size", "target", (F.col("size") * F.least(times, F.lit(most_times))).cast("long").alias("taken"))
