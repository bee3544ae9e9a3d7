"""Where the nodes of a graph stand on a canvas.

Every connected component is laid out by itself, in parallel: forces, a turn to landscape, a scale by the area of its
cards, and pushes until no two cards overlap. Components are then packed into shelves, of which only their sizes
are needed, and everything snaps to a grid. The time of a component is quadratic in its nodes, its
memory is not; graphs are pruned to what a person can look at first.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.operators.components import connected_components
from folioforge.operators.graph import box_overlaps
from folioforge.plans.storage import cut

SPRING, ATLAS = "fruchterman_reingold", "forceatlas2"
_BLOCK = 1024


@dataclass(frozen=True)
class Settings:
    """Of a layout, in pixels where it is a length. A grid wider than the gap would let cards snap onto each other."""

    gap: int = 40
    iterations: int = 200
    seed: int = 42
    passes: int = 100
    widen_every: int = 8
    widen: float = 1.15
    density: float = 2.2
    grid: int = 20
    between: int = 160
    algorithm: str = SPRING

    def __post_init__(self):
        if self.grid > self.gap:
            raise ValueError(f"a grid of {self.grid} lets cards with a gap of {self.gap} overlap")
        if self.algorithm not in (SPRING, ATLAS):
            raise ValueError(f"{self.algorithm!r} is no layout; there are {SPRING} and {ATLAS}")


def _pushes(at: np.ndarray, strength: np.ndarray, power: int) -> np.ndarray:
    """Sum over all others of the way from them, by ``strength`` of both over its length to the ``power``; in blocks of rows."""
    out = np.zeros_like(at)
    for i in range(0, len(at), _BLOCK):
        way = at[i : i + _BLOCK, None] - at[None]
        far = np.maximum(np.sqrt((way**2).sum(axis=2)), 0.01)
        out[i : i + _BLOCK] = (way * (strength[i : i + _BLOCK, None] * strength[None] / far**power)[:, :, None]).sum(axis=1)
    return out


def forces(n: int, links: np.ndarray, settings: Settings) -> np.ndarray:
    """Positions of ``n`` nodes within one unit around their middle; ``links`` has a row for each edge."""
    if n == 1:
        return np.zeros((1, 2))
    at = np.random.default_rng(settings.seed).random((n, 2))
    a, b = links[:, 0], links[:, 1]
    degree = np.bincount(links.ravel(), minlength=n) + 1.0
    ideal = 2.5 / math.sqrt(n)
    heat = 0.1 * max(np.ptp(at[:, 0]), np.ptp(at[:, 1]), 1e-3)
    for step in range(settings.iterations):
        way = at[a] - at[b]
        far = np.maximum(np.sqrt((way**2).sum(axis=1)), 0.01)[:, None]
        if settings.algorithm == SPRING:
            move, pull = _pushes(at, np.full(n, ideal), 2), way * far / ideal
        else:  # pushes grow with degrees, and a pull to the middle with the distance from it
            move, pull = _pushes(at, degree, 2) * 0.01 - (at - at.mean(axis=0)) * degree[:, None], way
        for end, sign in ((a, -1), (b, 1)):
            np.add.at(move, end, sign * pull)
        size = np.maximum(np.sqrt((move**2).sum(axis=1)), 0.01)[:, None]
        at = at + move / size * np.minimum(size, heat * (1 - step / (settings.iterations + 1)))
    at -= at.mean(axis=0)
    return at / max(np.abs(at).max(), 1e-9)


def landscape(at: np.ndarray) -> np.ndarray:
    """Turned over the diagonal if it is taller than wide."""
    return at[:, ::-1] if len(at) > 1 and np.ptp(at[:, 1]) > np.ptp(at[:, 0]) else at


def pixel_scale(at: np.ndarray, width: np.ndarray, height: np.ndarray, settings: Settings) -> float:
    """Pixels of a unit, so that the layout covers ``density`` times the area of its cards with their gaps."""
    area = settings.density * float(((width + settings.gap) * (height + settings.gap)).sum())
    x, y = np.ptp(at[:, 0]), np.ptp(at[:, 1])
    if x * y > 1e-9:
        return math.sqrt(area / (x * y))
    return math.sqrt(area) / max(x, y) if max(x, y) > 1e-9 else 0.0


def _collisions(x, y, w, h, order, gap: float):
    """Pairs of cards, the first before the second in ``order`` (by x), that are nearer than ``gap``; as they are when met."""
    for k, i in enumerate(order):
        for j in order[k + 1 :]:
            if x[j] >= x[i] + w[i] + gap:
                break
            if x[i] < x[j] + w[j] + gap and y[i] < y[j] + h[j] + gap and y[j] < y[i] + h[i] + gap:
                yield i, j


def push_apart(names: list[str], x: list[float], y: list[float], w: list[int], h: list[int], degree: list[int], settings: Settings) -> None:
    """Moves cards until none is nearer than the gap to another. Of two, the one with fewer edges moves more, along the
    shorter way out; where that does not end, all are spread around their middle, and at last moved to the right."""
    gap, heavy = settings.gap, [1 / (1 + d) for d in degree]
    by_x = lambda: sorted(range(len(x)), key=lambda i: (x[i], y[i], names[i]))
    for number in range(1, settings.passes + 1):
        calm = True
        for i, j in _collisions(x, y, w, h, by_x(), gap):
            calm = False
            share = heavy[i] / (heavy[i] + heavy[j])
            over_x = x[i] + w[i] + gap - x[j]
            over_y = min(y[i] + h[i], y[j] + h[j]) + gap - max(y[i], y[j])
            if over_x <= over_y:
                x[i] -= (over_x + 1) * share
                x[j] += (over_x + 1) * (1 - share)
            else:
                up = 1 if y[i] + h[i] / 2 <= y[j] + h[j] / 2 else -1
                y[i] -= up * (over_y + 1) * share
                y[j] += up * (over_y + 1) * (1 - share)
        if calm:
            return
        if number % settings.widen_every == 0 and next(_collisions(x, y, w, h, by_x(), gap), None):
            for at, size in ((x, w), (y, h)):
                middle = sum(p + s / 2 for p, s in zip(at, size)) / len(at)
                at[:] = [middle + (p + s / 2 - middle) * settings.widen - s / 2 for p, s in zip(at, size)]
    for _ in range(10):
        calm = True
        order = by_x()
        for k, i in enumerate(order):  # a card that was moved to the right may have passed others
            for j in order[k + 1 :]:
                if x[i] < x[j] + w[j] + gap and x[j] < x[i] + w[i] + gap and y[i] < y[j] + h[j] + gap and y[j] < y[i] + h[i] + gap:
                    calm, x[j] = False, x[i] + w[i] + gap + 1
        if calm:
            return


def _component(settings: Settings):
    def run(nodes: pd.DataFrame, links: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("id").reset_index(drop=True)
        place = {name: i for i, name in enumerate(nodes["id"])}
        ends = sorted({(min(a, b), max(a, b)) for a, b in zip(links["src"].map(place), links["tgt"].map(place))})
        w, h = nodes["width"].to_numpy(), nodes["height"].to_numpy()
        at = landscape(forces(len(nodes), np.array(ends, np.int64).reshape(-1, 2), settings))
        scale = pixel_scale(at, w, h, settings)
        x, y = (at[:, 0] * scale - w / 2).tolist(), (at[:, 1] * scale - h / 2).tolist()
        push_apart(nodes["id"].tolist(), x, y, w.tolist(), h.tolist(), nodes["degree"].tolist(), settings)
        return pd.DataFrame({"component": nodes["component"], "id": nodes["id"], "x": x, "y": y, "width": w, "height": h})

    return run


def shelves(boxes: pd.DataFrame, gap: float) -> pd.DataFrame:
    """Columns component, width, height: with x and y of each, in rows from the largest area to the least, ties by component. A
    row ends before what would pass 1.3 times the side of a square of all areas, or the widest."""
    rows = boxes.assign(area=boxes["width"] * boxes["height"]).sort_values(["area", "component"], ascending=[False, True])
    limit = max(1.3 * math.sqrt(rows["area"].sum()), rows["width"].max()) if len(rows) else 0.0
    x, y, tall, spots = 0.0, 0.0, 0.0, []
    for width, height in zip(rows["width"], rows["height"]):
        if x > 0 and x + width > limit:
            x, y, tall = 0.0, y + tall + gap, 0.0
        spots.append((x, y))
        x, tall = x + width + gap, max(tall, height)
    return rows[["component"]].assign(x=[float(s[0]) for s in spots], y=[float(s[1]) for s in spots])


def pack(components: DataFrame, gap: float) -> DataFrame:
    """(component, x, y) of each of ``components`` (component, width, height); the cursor goes over their sizes in one task."""
    return components.select("component", "width", "height", F.lit(0).alias("one")).groupBy("one").applyInPandas(lambda pdf: shelves(pdf, gap), "component string, x double, y double")


def place_nodes(nodes: DataFrame, edges: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """x and y (long, at least 0, on the grid) of each of ``nodes`` (id, width, height, degree), joined by ``edges`` (src, tgt):
    id, x, y, width, height. No two cards overlap, or it raises RuntimeError. The same graph gives the same places."""
    groups = connected_components(edges, "src", "tgt").select(F.col("node").alias("id"), F.col("root").alias("component"))
    held = cut(nodes.select("id", "width", "height", "degree").join(groups, "id", "left").withColumn("component", F.coalesce("component", "id")), "layout-nodes")
    links = edges.select("src", "tgt").join(groups.withColumnRenamed("id", "src"), "src")
    laid = cut(held.groupBy("component").cogroup(links.groupBy("component")).applyInPandas(_component(settings), "component string, id string, x double, y double, width int, height int"), "layout-components")
    sizes = laid.groupBy("component").agg(F.min("x").alias("left"), F.min("y").alias("top"), (F.max(F.col("x") + F.col("width")) - F.min("x")).alias("width"), (F.max(F.col("y") + F.col("height")) - F.min("y")).alias("height"))
    sizes = cut(sizes, "layout-sizes")
    spots = pack(sizes, settings.between).withColumnsRenamed({"x": "at_x", "y": "at_y"}).join(sizes.select("component", "left", "top"), "component")
    moved = cut(laid.join(spots, "component").select("id", (F.col("x") + F.col("at_x") - F.col("left")).alias("x"), (F.col("y") + F.col("at_y") - F.col("top")).alias("y"), "width", "height"), "layout-packed")
    least = moved.agg(F.min("x").alias("x"), F.min("y").alias("y")).first()
    snap = lambda c: (F.bround((F.col(c) - F.lit(least[c] or 0.0)) / settings.grid, 0) * settings.grid).cast("long").alias(c)
    placed = cut(moved.select("id", snap("x"), snap("y"), "width", "height"), "layout-placed")
    overlaps = box_overlaps(placed).count()
    if overlaps:
        raise RuntimeError(f"{overlaps} pairs of cards overlap")
    return placed


def salted_ids(keys: DataFrame, of) -> DataFrame:
    """``keys`` (key, and columns that order them) with ``id``, which ``of`` makes of the key. Of keys that make one id, the first by
    ``rank`` keeps it; others get a number behind the key, until all differ."""
    rows = keys.withColumn("id", of(F.col("key"))).withColumn("salt", F.lit(0))
    while True:
        rows = cut(rows, "salted")
        again = F.row_number().over(Window.partitionBy("id").orderBy("salt", "rank", "key")) - 1
        numbered = rows.withColumn("again", again)
        if numbered.where("again > 0").isEmpty():
            return rows.drop("salt")
        salt = F.when(F.col("again") > 0, F.col("salt") + F.col("again")).otherwise(F.col("salt"))
        rows = numbered.withColumn("salt", salt).withColumn("id", F.when(F.col("again") > 0, of(F.concat("key", F.lit("#"), F.col("salt").cast("string")))).otherwise(F.col("id"))).drop("again")
