"""Embedding near-duplicates by a PCA-ordered tiled comparison.

Vectors are brought to length 1 and turned onto the principal axes of all of them, which keeps their
cosines. Two vectors with a cosine of t lie at most sqrt(2 - 2t) apart on every axis, so cells of that
width along the first axis need comparing with themselves and their neighbours only. Tiles of vectors
are compared leading axes first: after each stretch of axes, the product so far plus the product of
what is left of both lengths bounds the cosine, and a tile stops once no pair can reach the threshold.
Pairs that come through are decided by their cosine in double precision from the vectors as given.

Equal vectors are compared once, with their number. Tasks hold two tiles and report links as counts
and components, never as pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioforge.operators.blocks import compare_blocks, local_roots
from folioforge.operators.components import connected_components
from folioforge.plans.storage import cut

THRESHOLD = 0.93
#: Vectors of a tile.
TILE_ROWS = 1024
#: Axes after which the bound is asked, besides the last.
STRETCHES = (8, 16, 32)
#: Rounding error that a bound may hold.
SLACK = 1e-4


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _units(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square over- or underflows
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of products of components over each run of vectors of one dimension."""
    for batch in batches:
        dims = np.diff(batch.column(0).offsets.to_numpy())
        for dim in np.unique(dims):
            x = _units(_matrix(batch.column(0).filter(pa.array(dims == dim))))
            m = x.T @ x
            yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, dim, np.int64)), pa.array(np.arange(m.size)), pa.array(m.ravel())], ["dim", "at", "value"])


def principal_axes(vectors: DataFrame) -> dict[int, np.ndarray]:
    """By number of components, the principal axes of all vectors as columns, by falling share."""
    sums = vectors.select("v").mapInArrow(_moments, "dim long, at long, value double").groupBy("dim", "at").agg(F.sum("value").alias("value")).toPandas()  # a row for each pair of components
    out = {}
    for dim, part in sums.groupby("dim"):
        m = np.zeros(dim * dim)
        m[part["at"].to_numpy()] = part["value"].to_numpy()
        share, axes = np.linalg.eigh(m.reshape(dim, dim))
        out[int(dim)] = axes[:, np.argsort(-share, kind="stable")]
    return out


def link_tiles(a: np.ndarray, b: np.ndarray, axes: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of rows whose cosine reaches ``threshold``."""
    ua, ub = _units(a), _units(b)
    ra, rb = (ua @ axes).astype(np.float32), (ub @ axes).astype(np.float32)
    dim = ra.shape[1]
    rest_a, rest_b = (np.sqrt(np.maximum(np.cumsum((r * r)[:, ::-1], axis=1)[:, ::-1], 0)) for r in (ra, rb))
    left, right = np.arange(len(ra)), np.arange(len(rb))
    so_far, start = np.zeros((len(ra), len(rb)), np.float32), 0
    for stop in (*(s for s in STRETCHES if s < dim), dim):
        so_far += ra[left, start:stop] @ rb[right, start:stop].T
        bound = so_far if stop == dim else so_far + rest_a[left, stop][:, None] * rest_b[right, stop][None, :]
        open_ = bound >= threshold - SLACK
        rows, columns = open_.any(axis=1), open_.any(axis=0)
        if not rows.any():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        if rows.mean() * columns.mean() < 0.5:  # go on with the rows that are still open only
            left, right, so_far, open_ = left[rows], right[columns], so_far[np.ix_(rows, columns)], open_[np.ix_(rows, columns)]
        start = stop
    i, j = np.nonzero(open_)
    i, j = left[i], right[j]
    sure = np.concatenate([np.einsum("ij,ij->i", ua[i[k : k + 100_000]], ub[j[k : k + 100_000]]) >= threshold for k in range(0, len(i), 100_000)])
    return i[sure], j[sure]


def compare_tiles(axes: dict[int, np.ndarray], threshold: float):
    """For :func:`compare_blocks`: rows with id, v and n (the number of equal vectors)."""

    def compare(left: pa.Table, right: pa.Table | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = _matrix(left.column("v"))
        ids, n = left.column("id").to_numpy(), left.column("n").to_numpy()
        if right is None:
            i, j = link_tiles(a, a, axes[a.shape[1]], threshold)
            other = i != j
            i, j = i[other], j[other]
            return ids, local_roots(ids, i, j), np.bincount(i, n[j], len(ids)).astype(np.int64)
        i, j = link_tiles(a, _matrix(right.column("v")), axes[a.shape[1]], threshold)
        j = j + len(ids)
        ids, n = np.concatenate((ids, right.column("id").to_numpy())), np.concatenate((n, right.column("n").to_numpy()))
        return ids, local_roots(ids, i, j), (np.bincount(i, n[j], len(ids)) + np.bincount(j, n[i], len(ids))).astype(np.int64)

    return compare


def near_duplicates(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", threshold: float = THRESHOLD) -> DataFrame:
    """One row for each row of ``rows``: its id, n_links (other vectors that it links with directly),
    component_id (the least id it reaches by links, itself included) and kept (it has that id).

    Only vectors with the same label and number of components are compared, and link when their cosine
    reaches ``threshold`` (above 0). A null label, and a vector that is null, empty, zero or has a null
    or non-finite component, links with nothing. A row with a null id links with nothing, has a null
    component and is kept. Ids should be distinct; a row that repeats another whole counts as one more vector equal
    to it. Other columns are not read. An empty table gives an empty result.
    """
    v = F.col("v")
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    given = given.withColumn("ok", F.coalesce(F.col("id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & fine, F.lit(False)))
    good = given.where("ok").select("id", F.concat_ws(":", F.size("v").cast("string"), "label").alias("grp"), "v")
    classes = cut(good.groupBy("grp", "v").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n")), "vector-classes")
    axes = principal_axes(classes)
    first = {d: x[:, 0] for d, x in axes.items()}
    width = float(np.sqrt(2 - 2 * threshold)) + SLACK

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = np.diff(batch.column(2).offsets.to_numpy())
            at = np.zeros(batch.num_rows)
            for dim in np.unique(dims):
                own = dims == dim
                at[own] = _units(_matrix(batch.column(2).filter(pa.array(own)))) @ first[int(dim)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.floor(at / width).astype(np.int64))], ["grp", "id", "v", "n", "cell"])

    placed = classes.select("grp", "id", "v", "n").mapInArrow(cells, "grp string, id long, v array<double>, n long, cell long")
    links = cut(compare_blocks(placed, compare_tiles(axes, threshold), TILE_ROWS), "vector-links")
    counts = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = connected_components(links.select("id", "root"), "id", "root")
    told = cut(classes.where("n > 1").select("grp", "v", F.col("id").alias("lead"), "n"), "vector-copies")
    out = given.select("id", "ok", F.concat_ws(":", F.size("v").cast("string"), "label").alias("grp"), "v").join(told, ["grp", "v"], "left")
    lead = F.when(F.col("ok"), F.coalesce("lead", "id"))
    out = out.select("id", lead.alias("lead"), F.when(F.col("ok"), F.coalesce("n", F.lit(1)) - 1).otherwise(0).alias("copies"))
    out = out.join(counts.withColumnRenamed("id", "lead"), "lead", "left").join(roots.select(F.col("node").alias("lead"), "root"), "lead", "left")
    component = F.coalesce("root", "lead", "id")
    return out.select(F.col("id").alias(id_col), (F.col("copies") + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))
