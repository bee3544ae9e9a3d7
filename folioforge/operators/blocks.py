"""All pairs of a group, in blocks of bounded size.

Rows of a group lie in numbered cells, and only rows of the same or of neighbouring cells can match.
A cell is dealt by a hash into chunks of about ``chunk_rows``; a task compares two chunks, or one with
itself. So a group that holds a third of all rows becomes many equal tasks, and no task grows with it.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.storage import cut

TASK = ("grp", "lo_cell", "lo_chunk", "hi_cell", "hi_chunk")
LINKS = "id long, root long, links long"


def compare_blocks(rows: DataFrame, compare: Callable[[pa.Table, pa.Table | None], tuple[np.ndarray, np.ndarray, np.ndarray]], chunk_rows: int) -> DataFrame:
    """``rows`` has id (long, distinct), grp, cell (long) and columns for ``compare``, which gets the
    rows of one chunk and of another (None: the first with itself) and returns ids, a root and a number
    of links for each of them. The result has ``id, root, links`` from every task, of linked rows only."""
    spread = rows.groupBy("grp", "cell").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("grp").orderBy("cell")
    chunks = F.ceil(F.col("n") / chunk_rows).cast("long")
    spread = spread.withColumn("m", chunks)
    near = lambda column, by: F.when(by(F.col("cell")).over(w) == F.col("cell") + (1 if by is F.lead else -1), by(column).over(w))
    spread = spread.select("grp", "cell", "n", "m", F.coalesce(near("m", F.lag), F.lit(0).cast("long")).alias("m_lo"), F.coalesce(near("m", F.lead), F.lit(0).cast("long")).alias("m_hi"))
    spread = cut(spread.where("n > 1 or m_lo > 0 or m_hi > 0").drop("n"), "block-cells")
    placed = rows.join(spread, ["grp", "cell"]).withColumn("c", F.pmod(F.xxhash64("id"), F.col("m")))
    count = lambda n: F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))
    task = lambda lo_cell, lo, hi_cell, hi, side: F.struct(lo_cell.alias("lo_cell"), lo.alias("lo_chunk"), hi_cell.alias("hi_cell"), hi.alias("hi_chunk"), side.cast("int").alias("side"))
    cell, c = F.col("cell"), F.col("c")
    tasks = F.concat(
        F.transform(count(F.col("m")), lambda o: task(cell, F.least(c, o), cell, F.greatest(c, o), F.when(o < c, 1).otherwise(0))),
        F.transform(count(F.col("m_hi")), lambda o: task(cell, c, cell + 1, o, F.lit(0))),
        F.transform(count(F.col("m_lo")), lambda o: task(cell - 1, o, cell, c, F.lit(1))),
    )
    columns = [x for x in rows.columns if x not in ("grp", "cell")]
    dealt = placed.select("grp", *columns, F.explode(tasks).alias("t")).select("grp", *columns, "t.*")

    def run(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        same = table.column("lo_cell")[0].as_py() == table.column("hi_cell")[0].as_py() and table.column("lo_chunk")[0].as_py() == table.column("hi_chunk")[0].as_py()
        left, right = table.filter(pa.array(side == 0)), None if same else table.filter(pa.array(side == 1))
        if right is not None and not (left.num_rows and right.num_rows) or left.num_rows < 2 and same:
            ids, roots, links = (np.zeros(0, np.int64) for _ in range(3))
        else:
            ids, roots, links = compare(left, right)
        keep = links > 0
        return pa.table({"id": ids[keep].astype(np.int64), "root": roots[keep].astype(np.int64), "links": links[keep].astype(np.int64)})

    return dealt.groupBy(*TASK).applyInArrow(run, LINKS)


def local_roots(ids: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least id that each of ``ids`` reaches by links between positions ``a`` and ``b``."""
    roots = ids.copy()
    while len(a):
        low = np.minimum(roots[a], roots[b])
        before = roots.copy()
        np.minimum.at(roots, a, low)
        np.minimum.at(roots, b, low)
        if (before == roots).all():
            break
    return roots
