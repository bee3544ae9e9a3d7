"""Sharding by extendible hashing.

A directory is indexed by the leading bits of a document's hash. It starts as deep as equal shares
would need; then only buckets above the byte limit split on their next bit, until each fits. Sizes
are summed by the index a few bits further down, and splitting works on those sums alone; what is still too large
there is summed again by the bits below, as often as it takes. Documents look their shard up in the directory.

The hash of the key goes on with a hash of the whole row, so that rows of one key, however many they are, split like
any others. Only rows that are equal in all columns cannot: they fill numbered pages of their bucket, by their number.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioforge.plans.storage import cut

SHARD_BYTES = 1 << 20
#: Bits that a level of the directory looks at beyond those that are settled.
LEVEL_BITS = 8
_HASH_BITS = 60


def key_hash(key: Column) -> Column:
    """The leading 60 bits of the MD5 of the key as text (null: empty)."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15), 16, 10).cast("long")


def _bits(value: Column, n: int | Column) -> Column:
    """The lowest ``n`` bits of a number, as text."""
    return F.right(F.lpad(F.bin(value), 64, "0"), n if isinstance(n, Column) else F.lit(n))


def _next(taken: Column) -> Column:
    """The next LEVEL_BITS bits of the two hashes behind the ``taken`` ones; the second begins where the first has no more."""
    own = lambda h, at: F.call_function("shiftright", F.col(h), F.lit(_HASH_BITS - LEVEL_BITS) - at).bitwiseAND((1 << LEVEL_BITS) - 1)
    return F.when(taken < _HASH_BITS, own("h1", taken)).otherwise(own("h2", taken - _HASH_BITS))


def _after(taken: Column) -> Column:
    """Bits taken after a level: where the first hash has fewer than a level left, the second goes on."""
    done = taken + LEVEL_BITS
    return F.when((taken < _HASH_BITS) & (done > _HASH_BITS - LEVEL_BITS), F.lit(_HASH_BITS)).otherwise(done)


def _level(sized: DataFrame, shard_bytes: int, settled: bool) -> DataFrame:
    """The directory of rows (parent, taken, cell, bytes): for each cell the bucket that holds it, which is the shallowest
    around it that fits; ``settled``: the parent itself is known not to."""
    cells = sized.groupBy("parent", "taken", "cell").agg(F.sum("bytes").alias("cell_bytes"), F.count(F.lit(1)).alias("rows"), (F.min("h1") == F.max("h1")).alias("same_key"))
    cells = cells.repartition("parent")  # one shuffle serves all windows
    depth = F.lit(None).cast("int")
    for j in range(int(settled), LEVEL_BITS):
        around = Window.partitionBy("parent", F.shiftright(F.col("cell"), LEVEL_BITS - j))
        cells = cells.withColumn(f"at{j}", F.sum("cell_bytes").over(around))
        depth = F.coalesce(depth, F.when(F.col(f"at{j}") <= shard_bytes, F.lit(j)))
    cells = cells.withColumn("depth", F.coalesce(depth, F.lit(LEVEL_BITS)))
    cells = cells.withColumn("bucket", F.call_function("shiftright", F.col("cell"), F.lit(LEVEL_BITS) - F.col("depth")))
    cells = cells.withColumn("held", F.sum("cell_bytes").over(Window.partitionBy("parent", "depth", "bucket")))
    name = F.concat("parent", _bits(F.col("bucket"), F.col("depth")))
    over = (F.col("held") > shard_bytes) & (F.col("rows") > 1)
    return cut(cells.select("parent", "cell", name.alias("name"), "depth", "held", over.alias("over"), "same_key"), "shard-directory")


def assign(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """``docs`` with bytes (of the text in UTF-8; null: 0), shard (its name), depth (bits of its
    bucket), page (among the pages of equal rows, else 0) and shard_bytes.

    No shard exceeds ``shard_bytes``, but for a document that does so alone, which shares its shard
    with no other. Rows of one id share a bucket as long as they fit into one; a null id is one, too. Columns
    of ``docs`` that bear a result's name are replaced. Rows are kept as often as they occur. An empty table gives
    an empty result.
    """
    names = ("bytes", "shard", "depth", "page", "shard_bytes")
    given = [F.col(f"`{c}`") for c in docs.columns if c not in names]
    row_hash = F.shiftrightunsigned(F.xxhash64(*given), 4)
    sized = docs.select(F.struct(*given).alias("row"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes"), key_hash(F.col(id_col)).alias("h1"), row_hash.alias("h2"))
    total = sized.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    start = min(max(0, math.ceil(math.log2(max(1, total / shard_bytes)))), _HASH_BITS - LEVEL_BITS)
    rows = sized.withColumn("parent", _bits(F.shiftright("h1", _HASH_BITS - start), start)).withColumn("taken", F.lit(start))
    out, settled, level = None, False, 0
    while True:
        rows = rows.withColumn("cell", _next(F.col("taken")))
        directory = _level(rows.select("parent", "taken", "cell", "bytes", "h1"), shard_bytes, settled)
        # a cell holds few rows: the directory grows with the documents and is never broadcast
        placed = rows.join(directory.hint("merge"), ["parent", "cell"])
        shard = F.when(F.col("name") == "", "all").otherwise(F.col("name"))
        fits = placed.where("not over").select("row", "bytes", shard.alias("shard"), (F.col("taken") + F.col("depth")).cast("int").alias("depth"), F.lit(0).cast("long").alias("page"), F.col("held").alias("shard_bytes"))
        out = fits if out is None else out.unionByName(fits)
        over = directory.where("over")
        if over.isEmpty():
            break
        # of one key, no further bit of its hash parts the rows
        taken = F.when(F.col("same_key") & (F.col("taken") < _HASH_BITS), F.lit(_HASH_BITS)).otherwise(_after(F.col("taken")))
        rows = cut(placed.where("over").select("row", "bytes", "h1", "h2", F.col("name").alias("parent"), taken.alias("taken")), "shard-rows")
        equal = rows.where(F.col("taken") >= 2 * _HASH_BITS - LEVEL_BITS + 1)
        out = out.unionByName(_pages(equal, shard_bytes))
        rows, settled, level = rows.where(F.col("taken") < 2 * _HASH_BITS - LEVEL_BITS + 1), True, level + 1
    return out.select("row.*", "bytes", "shard", "depth", "page", "shard_bytes")


def _pages(rows: DataFrame, shard_bytes: int) -> DataFrame:
    """Rows that agree in both hashes: counted first, then dealt to pages by their number."""
    alike = rows.groupBy("parent", "h1", "h2", "bytes", F.to_json("row").alias("said")).agg(F.first("row").alias("row"), F.count(F.lit(1)).alias("n"), F.first("taken").alias("taken"))
    each = F.greatest(F.lit(1), F.floor(F.lit(shard_bytes) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    each = F.when(F.col("bytes") == 0, F.col("n")).otherwise(each)
    before = F.coalesce(F.sum("pages").over(Window.partitionBy("parent").orderBy("h1", "h2", "said").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    alike = alike.withColumn("each", each).withColumn("pages", F.ceil(F.col("n") / F.col("each")).cast("long")).withColumn("before", before)
    # pages are spread before their rows are written out
    paged = alike.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("pages") - 1)).alias("p")).repartition("parent", "p")
    held = F.least(F.col("each"), F.col("n") - F.col("p") * F.col("each")).cast("int")
    page = F.col("before") + F.col("p")
    return paged.select("row", "bytes", F.concat_ws("-", "parent", page.cast("string")).alias("shard"), F.col("taken").cast("int").alias("depth"), page.cast("long").alias("page"), (held * F.col("bytes")).cast("long").alias("shard_bytes"), F.explode(F.array_repeat(F.lit(0), held)).alias("copy")).drop("copy")


def write(assigned: DataFrame, path: str) -> None:
    """A folder ``shard=<name>`` of Parquet files below ``path`` for each shard of :func:`assign`."""
    assigned.repartition("shard").write.partitionBy("shard").parquet(path)
