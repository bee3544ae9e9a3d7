"""Benchmark decontamination by suffix arrays.

The words of documents and benchmark items become numbers of the benchmark's vocabulary. Each shard
of documents (a batch of a task) gets an array of its suffixes, sorted by all their words up to the first that
no item has. Every suffix of the items is looked up in it by binary search: the range of document suffixes that
begin with its window are its occurrences, and of the neighbours of its own place in the order, the one that
agrees with it longest is its longest verbatim match, with place and length.

A document suffix begins with one window, whatever the number of items that hold it, so what is marked grows
with the text; items that hold the same windows are one class, and a document has a class once.

The benchmark is the query set. It is sent to executors in blocks of bounded size, and documents never
move: a block costs one scan and no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.llm import words

WINDOW = 10
#: Bytes of benchmark text in a block that is broadcast.
BLOCK_BYTES = 16 << 20
#: Document suffixes of a shard, about.
SHARD_SUFFIXES = 400_000
#: Entries of lists of items that a task hands on at a time, about.
LISTED = 1 << 18
_MATCH = "array<struct<item:string,start:int,length:int,item_start:int>>"
_SPAN = "array<struct<start:int,end:int>>"


def _table(number: np.ndarray, begin: np.ndarray, end: np.ndarray, window: int) -> np.ndarray:
    """The first ``window`` numbers from each of ``begin`` on, 0 from ``end`` and from the first 0 on."""
    spot = begin[:, None] + np.arange(window)
    table = np.where(spot < end[:, None], number[np.minimum(spot, max(len(number) - 1, 0))], 0) if len(begin) else np.zeros((0, window), np.int64)
    return table * np.cumprod(table > 0, axis=1)


def _keys(table: np.ndarray) -> np.ndarray:
    table = np.ascontiguousarray(table.astype(">u4"))
    return table.view(f"S{4 * table.shape[1]}").ravel()


class Benchmark:
    """Windows of a block of items, ready to be looked up.

    ``number`` has the words of all items, with a 0 behind each; ``table`` the distinct windows, 0 where a short item
    has ended, and ``classes`` of each the set of items that have it: the items [bounds[c], bounds[c + 1]) of
    ``members``. ``suffix`` are the places in ``number`` that begin a window, ``window_of`` the window of each."""

    def __init__(self, ids: list[str | None], texts: list[str | None], window: int = WINDOW):
        self.window, self.ids = window, ids
        lists, item = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        first = 0
        for scan in words.scans(pa.array(texts, pa.string()), words.ALNUM):
            lists.append(words.hashes(scan))
            item.append(scan.docs + first)
            first += scan.rows
        h, item = np.concatenate(lists), np.concatenate(item)
        self.vocabulary = np.unique(h)
        counts = np.bincount(item, minlength=len(ids))
        self.ends = np.cumsum(counts + 1) - 1  # the 0 behind each item
        self.starts = self.ends - counts
        self.number = np.zeros(int(counts.sum()) + len(ids), np.int64)
        at = np.arange(len(h)) + item
        self.number[at] = np.searchsorted(self.vocabulary, h) + 1
        left = self.ends[item] - at
        begins = (left >= window) | (at == self.starts[item])  # a shorter item is one window
        self.suffix, self.item_of = at[begins], item[begins]
        table = _table(self.number, self.suffix, self.ends[self.item_of], window)
        order = np.lexsort(table.T[::-1])
        table, new = table[order], np.ones(len(table), bool)
        new[1:] = (table[1:] != table[:-1]).any(axis=1)
        self.table, number = table[new], np.cumsum(new) - 1
        self.window_of = np.empty(len(order), np.int64)
        self.window_of[order] = number
        self.sizes = (self.table > 0).sum(axis=1)
        # windows of the same items are one class
        pairs = np.unique(np.column_stack([self.window_of, self.item_of]), axis=0) if len(order) else np.zeros((0, 2), np.int64)
        cuts = np.searchsorted(pairs[:, 0], np.arange(len(self.table) + 1))
        known: dict[bytes, int] = {}
        self.classes = np.array([known.setdefault(pairs[a:b, 1].tobytes(), len(known)) for a, b in zip(cuts[:-1], cuts[1:])], np.int64)
        members = [np.frombuffer(k, np.int64) for k in known]
        self.members = np.concatenate(members or [np.zeros(0, np.int64)])
        self.bounds = np.concatenate(([0], np.cumsum([len(m) for m in members]))).astype(np.int64)
        full = self.sizes == window
        self.any_full = bool(full.any())
        #: by first word, the least size of a window shorter than the others
        self.short = np.full(len(self.vocabulary) + 1, 1 << 30)
        np.minimum.at(self.short, self.table[~full, 0], self.sizes[~full])

    def numbers(self, scan: words.Scan) -> tuple[np.ndarray, np.ndarray]:
        """Word numbers of a slice (0: no word of the benchmark), a 0 behind each text; and places from which on, without
        a 0, there are as many words as a window needs, or that follow such a place."""
        h = words.hashes(scan)
        at = np.minimum(np.searchsorted(self.vocabulary, h), max(len(self.vocabulary) - 1, 0))
        number = np.zeros(len(h) + scan.rows, np.int64)
        if len(h) and len(self.vocabulary):
            number[np.arange(len(h)) + scan.docs] = np.where(self.vocabulary[at] == h, at + 1, 0)
        stop = np.flatnonzero(number == 0)
        place = np.flatnonzero(number)
        end = stop[np.searchsorted(stop, place)] if len(place) else place
        may = end - place >= self.short[number[place]]
        if self.any_full:
            # the whole run, to its last word: shorter suffixes order the longer ones before them
            begin = np.concatenate(([-1], stop))[np.searchsorted(stop, place)] + 1 if len(place) else place
            may |= end - begin >= self.window
        return number, place[may]

    def items(self, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The items of each class, one list after another, and how many each has."""
        many = self.bounds[classes + 1] - self.bounds[classes]
        at = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        return self.members[np.repeat(self.bounds[classes], many) + at], many


def suffix_order(number: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the suffixes of ``number`` from ``places`` (rising) on, by all words up to a 0, and their first
    words as sorted keys. Ranks by ``window`` words are doubled until all differ or end."""
    stop = np.append(np.flatnonzero(number == 0), len(number))
    keys = _keys(_table(number, places, stop[np.searchsorted(stop, places)] if len(places) else places, window))
    order = np.argsort(keys, kind="stable")
    rank, reach = _ranks(keys[order], order), window
    while len(order) and rank.max() + 1 < len(order):
        later = places + reach
        at = np.minimum(np.searchsorted(places, later), len(places) - 1)
        # a suffix that has ended comes first; what is no listed place behind a listed one is an end
        after = np.where(places[at] == later, rank[at] + 1, 0)
        after[_ended(stop, places, reach)] = 0
        if not after.any():
            break
        order = np.lexsort((after, rank))
        pair = np.column_stack([rank[order], after[order]])
        now = np.empty(len(order), np.int64)
        now[order] = np.concatenate(([0], np.cumsum((pair[1:] != pair[:-1]).any(axis=1))))
        if now.max() == rank.max():
            break
        rank, reach = now, 2 * reach
    return order, keys[order]


def _ranks(keys: np.ndarray, order: np.ndarray) -> np.ndarray:
    rank = np.empty(len(order), np.int64)
    rank[order] = np.concatenate(([0], np.cumsum(keys[1:] != keys[:-1]))) if len(order) else 0
    return rank


def _ended(stop: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    return stop[np.searchsorted(stop, places)] <= places + reach


def shared_length(a: np.ndarray, at: np.ndarray, b: np.ndarray, bt: np.ndarray) -> np.ndarray:
    """How many words agree from places ``at`` of ``a`` and ``bt`` of ``b`` on, up to a 0."""
    length, open_ = np.zeros(len(at), np.int64), np.arange(len(at))
    a, b, step = np.append(a, np.zeros(32, np.int64)), np.append(b, np.zeros(32, np.int64)), np.arange(32)
    while len(open_):
        x, y = a[(at + length)[open_][:, None] + step], b[(bt + length)[open_][:, None] + step]
        same = np.cumprod((x == y) & (x > 0), axis=1).sum(axis=1)
        length[open_] += same
        open_ = open_[same == len(step)]
    return length


def find_windows(bench: Benchmark, number: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a shard: the order of its suffixes, and for each window of the benchmark that occurs its number and the
    range of the order that begins with it."""
    order, keys = suffix_order(number, places, bench.window)
    upper = bench.table.copy()
    upper[upper == 0] = 0xFFFFFFFF
    lo, hi = np.searchsorted(keys, _keys(bench.table), "left"), np.searchsorted(keys, _keys(upper), "right")
    hit = np.flatnonzero(hi > lo)
    return order, hit, lo[hit], hi[hit]


def longest_matches(bench: Benchmark, number: np.ndarray, places: np.ndarray, hit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each suffix of the items whose window is among ``hit``: its index, the place of its longest verbatim match in the
    shard and its length. The suffixes are sorted in among those of the shard; the longest match is a neighbour."""
    chosen = np.flatnonzero(np.isin(bench.window_of, hit))
    if not len(chosen):
        return chosen, chosen, chosen
    # the runs of items in which these suffixes lie, behind the shard
    both = np.concatenate((number, [0], bench.number))
    shift = len(number) + 1
    runs = np.unique(bench.item_of[chosen])
    inner = np.concatenate([np.arange(bench.starts[i], bench.ends[i]) for i in runs]) + shift
    joint = np.concatenate((places, inner))
    order, _ = suffix_order(both, joint, bench.window)
    where = joint[order]
    own = where < shift
    spot = np.empty(len(joint), np.int64)
    spot[order] = np.arange(len(order))
    mine = spot[len(places) + np.searchsorted(inner, bench.suffix[chosen] + shift)]
    index = np.flatnonzero(own)
    after = np.searchsorted(index, mine)
    best, length = np.zeros(len(chosen), np.int64), np.full(len(chosen), -1, np.int64)
    for near in (np.maximum(after - 1, 0), np.minimum(after, len(index) - 1)):
        at = where[index[near]]
        now = shared_length(number, at, bench.number, bench.suffix[chosen])
        better = now > length
        best, length = np.where(better, at, best), np.where(better, now, length)
    return chosen, best, length


def shards(bench: Benchmark, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each shard: its first row, the words of each row, the place at which each starts, and its numbers and places."""
    held, at, many, first = [], 0, 0, 0

    def done():
        counts, starts, number, places = (np.concatenate(x) for x in zip(*held))
        return first, counts, starts, number, places

    for scan in words.scans(column, words.ALNUM):
        number, places = bench.numbers(scan)
        held.append((scan.counts, scan.bounds[:-1] + np.arange(scan.rows) + at, number, places + at))
        at += len(number)
        many += len(places)
        if many >= SHARD_SUFFIXES:
            yield done()
            held, at, many, first = [], 0, 0, scan.first + scan.rows
    if held:
        yield done()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str, block_bytes: int, window: int) -> Iterator[Benchmark]:
    items = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // block_bytes))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).collect()  # a block of bounded size
        yield Benchmark([r["id"] for r in rows], [r["text"] for r in rows], window)


def find(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row for each row of ``docs``: its id, n_words, n_hit (words inside an occurrence of a window), items (ids with
    an occurring window, sorted as strings) and matches (item, start and length in words, item_start): of the suffixes of
    items, those whose longest verbatim match in the shard lies in this row.

    A window is ``window`` consecutive words of an item; an item of fewer words is one whole. Null and wordless
    texts match nothing. Items with a null id mark words, but are in no list of items. Other columns are not read;
    repeated rows are each reported.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = []
    for bench in _blocks(benchmark, item_col, item_text_col, block_bytes, window):
        schema = f"id {texts.schema['id'].dataType.simpleString()}, row long, n_words long, spans {_SPAN}, items array<string>, matches {_MATCH}"
        parts.append(texts.select("id", F.xxhash64("id", "text").alias("row"), "text").mapInArrow(_finder(spark.sparkContext.broadcast(bench)), schema))
    found = parts[0]
    lists = ("spans", "items", "matches")
    for more in parts[1:]:
        # the matches of repeated rows may lie in one of them only: any row's lists of hits are the same
        more = more.where("size(spans) > 0").groupBy("row").agg(*(F.max_by(c, F.size("matches")).alias(f"more_{c}") for c in lists))
        both = (F.concat(c, F.coalesce(f"more_{c}", F.array().cast(found.schema[c].dataType))).alias(c) for c in lists)
        found = found.join(more, "row", "left").select("id", "row", "n_words", *both)
    zero = F.lit(0).cast("long")
    hit = F.aggregate(F.sort_array("spans"), F.struct(zero.alias("n"), zero.alias("upto")), lambda a, s: F.struct((a["n"] + F.greatest(zero, s["end"] - F.greatest(a["upto"], s["start"].cast("long")))).alias("n"), F.greatest(a["upto"], s["end"].cast("long")).alias("upto")), lambda a: a["n"])
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.sort_array(F.array_distinct("items")).alias("items"), "matches")


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench: Benchmark = shared.value
        ids = np.array([*bench.ids, None], object)
        named = np.array([i is not None for i in bench.ids], bool)
        lists = lambda bounds, values: pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), values)
        for batch in batches:
            for first, counts, starts, number, places in shards(bench, batch.column(2)):
                order, hit, lo, hi = find_windows(bench, number, places)
                many = hi - lo
                at = places[order[np.repeat(lo, many) + np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)]] if len(hit) else hit
                row_of = lambda at: np.searchsorted(starts, at, "right") - 1  # noqa: B023, E731
                # words inside: how many windows are open at each place
                cover = np.bincount(at, minlength=len(number) + 1) - np.bincount(at + np.repeat(bench.sizes[hit], many), minlength=len(number) + 1)
                covered = np.cumsum(cover) > 0
                edge = np.flatnonzero(np.diff(np.concatenate(([False], covered, [False])).astype(np.int8)))
                begin, end = edge[::2], edge[1::2]
                row = row_of(begin)
                spans = pa.StructArray.from_arrays([pa.array((x - starts[row]).astype(np.int32)) for x in (begin, end)], ["start", "end"])
                span_bounds = np.searchsorted(row, np.arange(len(counts) + 1))
                kinds = np.unique(np.column_stack([row_of(at), np.repeat(bench.classes[hit], many)]), axis=0) if len(at) else np.zeros((0, 2), np.int64)
                suffix, place, length = longest_matches(bench, number, places, hit)
                by_row = np.lexsort((place, row_of(place)))
                suffix, place, length = suffix[by_row], place[by_row], length[by_row]
                row = row_of(place)
                item = bench.item_of[suffix]
                matches = pa.StructArray.from_arrays([pa.array(ids[item], pa.string()), *(pa.array(x.astype(np.int32)) for x in (place - starts[row], length, bench.suffix[suffix] - bench.starts[item]))], ["item", "start", "length", "item_start"])
                match_bounds = np.searchsorted(row, np.arange(len(counts) + 1))
                part = batch.slice(first, len(counts))
                # rows in turn, so that lists of items never pile up
                weight = np.bincount(kinds[:, 0], bench.bounds[kinds[:, 1] + 1] - bench.bounds[kinds[:, 1]], len(counts)).cumsum()
                a = 0
                while a < len(counts):
                    b = max(a + 1, int(np.searchsorted(weight, (weight[a - 1] if a else 0) + LISTED)))
                    own = kinds[slice(*np.searchsorted(kinds[:, 0], [a, b]))]
                    member, size = bench.items(own[:, 1])
                    pair = np.unique(np.column_stack([np.repeat(own[:, 0], size), member]), axis=0)
                    pair = pair[named[pair[:, 1]]] if len(pair) else pair
                    items = lists(np.searchsorted(pair[:, 0], np.arange(a, b + 1)), pa.array(ids[pair[:, 1]], pa.string()))
                    cut = lambda bounds, values: lists(bounds[a : b + 1] - bounds[a], values.slice(bounds[a], bounds[b] - bounds[a]))  # noqa: B023, E731
                    rows = part.slice(a, b - a)
                    yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(counts[a:b].astype(np.int64)), cut(span_bounds, spans), items, cut(match_bounds, matches)], ["id", "row", "n_words", "spans", "items", "matches"])
                    a = b

    return run


def remove_affected(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of ``docs`` whose text has no occurrence of a window (see :func:`find`), with all their columns."""
    spark, at = docs.sparkSession, docs.columns.index(text_col)
    for bench in _blocks(benchmark, item_col, item_text_col, block_bytes, window):
        docs = docs.mapInArrow(_keeper(spark.sparkContext.broadcast(bench), at), docs.schema)
    return docs


def _keeper(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = np.ones(batch.num_rows, bool)
            for first, _, starts, number, places in shards(shared.value, batch.column(at)):
                order, hit, lo, hi = find_windows(shared.value, number, places)
                touched = np.zeros(len(order) + 1, np.int64)
                np.add.at(touched, lo, 1)
                np.add.at(touched, hi, -1)
                place = places[order[np.cumsum(touched)[:-1] > 0]]
                keep[first + np.searchsorted(starts, place, "right") - 1] = False
            yield batch.filter(pa.array(keep))

    return run
