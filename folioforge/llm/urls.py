"""URL rules by a sort-merge range join.

The labels of a host are reversed and each ended by a dot, so that a host and all its subdomains
are one interval of keys: ``example.com`` is ``com.example.`` and covers [``com.example.``,
``com.example/``), "/" being the byte after ".". Intervals of rules are nested or apart. They cut
the line of keys into segments, each with the stack of rules active there.

Distinct URLs are dealt to sweeps of equal size without regard to their host, so a host that holds a third
of all rows is spread over all. Each sweep sorts its URLs and the segments' borders together, and
one pass carries the last border's stack to each URL; of the stack, the longest rule whose path
starts the URL's path wins. Every sweep has all borders, so there are only as many sweeps as keep the
copies of borders below the number of URLs. Rows look their URL's verdict up by a join, which adaptive execution splits
where many rows have one URL. Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from folioforge.plans.storage import cut

RULE_SCHEMA = "host string, path string, verdict string"
#: URLs of a sweep at most, about; there are four sweeps for each shuffle partition, where rules are few enough.
SWEEP_ROWS = 200_000
_AZ, _az = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _AZ, _az), F.lit(""))


def path_of(url: Column) -> Column:
    """What stands after the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host_key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _borders(rules: DataFrame) -> DataFrame:
    """(key, stack): from ``key`` on, up to the next, ``stack`` has the rules that fit the host."""
    own = rules.where("host is not null and path is not null and verdict is not null").distinct()
    own = own.select(host_key(F.col("host")).alias("key"), F.struct(F.length(F.concat("host", "path")).alias("size"), F.length("host").alias("host_size"), F.concat("host", "path").alias("rule"), "path", "verdict").alias("r"))
    hosts = own.groupBy("key").agg(F.collect_list("r").alias("rules"))
    labels = F.split(F.col("key"), r"\.", -1)
    above = hosts.select("key", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("upper"))
    stacks = above.join(hosts.select(F.col("key").alias("upper"), F.col("rules").alias("held")), "upper")
    inside = stacks.groupBy("key").agg(F.flatten(F.collect_list("held")).alias("stack"))
    after = stacks.where("upper <> key").groupBy("key").agg(F.flatten(F.collect_list("held")).alias("stack"))
    after = hosts.select("key").join(after, "key", "left")
    ends = after.select(F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"), F.coalesce("stack", F.array().cast("array<struct<size:int,host_size:int,rule:string,path:string,verdict:string>>")).alias("stack"))
    return inside.unionByName(ends)


def judge(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (host and path of the rule that decides, else null)
    and ``verdict`` (the rule's, else ``default``).

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the URL's path
    starts with its path; of those that fit, the longest host and path together wins, then the longest
    host, then the greatest rule and verdict. Rules with a null are left out; without rules every URL
    gets the default. A null URL, or one without ``://``, has an empty host and path. Columns of
    ``pages`` that bear a result's name are replaced; repeated rows are each judged.
    """
    seen = Observation()
    urls = cut(pages.select(F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url")).distinct().observe(seen, F.count(F.lit(1)).alias("n")), "urls")
    cuts = cut(_borders(rules), "url-borders")
    n, many = seen.get["n"], cuts.count()
    sweeps = max(4 * int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // sweep_rows))
    sweeps = max(1, min(sweeps, n // max(1, many)), -(-n // (100 * sweep_rows)))
    keyed = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    keyed = keyed.select("*", host_key(F.col("host")).alias("key"), F.lit(1).alias("kind"), F.pmod(F.xxhash64("url"), F.lit(sweeps).cast("long")).alias("sweep"))
    borders = cuts.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(sweeps - 1).cast("long"))).alias("sweep"), "key", "stack", F.lit(0).alias("kind"))
    both = keyed.unionByName(borders, allowMissingColumns=True)
    along = Window.partitionBy("sweep").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = both.select("url", "host", "path", "kind", F.last("stack", ignorenulls=True).over(along).alias("stack")).where("kind = 1")
    best = F.array_max(F.filter("stack", lambda r: F.startswith(F.col("path"), r["path"])))
    judged = swept.select("url", F.struct("host", "path", best.alias("best")).alias("told"))
    given = [F.col(f"`{c}`") for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    rows = pages.select(F.struct(*given).alias("row"), F.coalesce(F.col(f"`{url_col}`"), F.lit("")).alias("url")).join(judged, "url")
    return rows.select("row.*", "told.host", "told.path", F.col("told.best.rule").alias("rule"), F.coalesce("told.best.verdict", F.lit(default)).alias("verdict"))
