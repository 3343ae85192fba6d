"""URL filtering by a sort-merge range join with nested rules.

A rule (host, path) covers its host, all subdomains, and the paths that start with its path.  With the
host's labels reversed, ``com.example.www.``, a rule host is a prefix of the hosts that it covers, and a
prefix is an interval of byte strings.  Two sweeps over sorted keys find the rules of a url:

1. The distinct hosts are swept together with the rule hosts.  Running depth and the last start at each
   depth are the stack of open intervals; so each host gets its chain of rule hosts.
2. Each host's rules become path intervals of that host.  The urls are swept with these, by host.

Sweeps run in groups of about ``GROUP`` rows: the hosts are dealt out over as many groups as that takes,
each with a copy of the rule hosts, and a host with more urls than a group's is dealt out likewise with its
few intervals.  A group holds at least a ``GROUPS``-th of all rows, so at most ``GROUPS`` hosts are split, and
their list, which is broadcast, has that many rows.

Of the open rules the longest host and path wins; of rules with equal host and path, ``block``.  A url
that is null or has no ``://`` has an empty host and path.  Urls without a rule get the default verdict.
Empty tables give empty results; rows repeat as they occur.  Other columns stay, but those that are named
like a result column (in either case) give way to it.  Only DataFrame functions are used.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.plans.iterate import cut

#: Rows of a sweep's group, and groups that one table is dealt out over, at most.
GROUP, GROUPS = 2000, 4096


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a url."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels reversed, each with a dot behind it; a host's subdomains start with its key."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")).cast("binary")


def _events(intervals: DataFrame) -> DataFrame:
    """Starts and ends of prefix intervals; 0xFF, which is in no UTF-8 text, ends a prefix."""
    starts = intervals.withColumn("kind", F.lit(0))
    ends = intervals.withColumn("key", F.concat("key", F.unhex(F.lit("FF")))).withColumn("kind", F.lit(2))
    return starts.unionByName(ends)


def _depth(groups: list[str]) -> Column:
    w = Window.partitionBy(*groups).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    return F.sum(F.when(F.col("kind") == 0, 1).when(F.col("kind") == 2, -1).otherwise(0)).over(w)


def _deepest(intervals: DataFrame, groups: list[str]) -> int:
    return _events(intervals).withColumn("depth", _depth(groups)).agg(F.max("depth")).first()[0] or 0


def sweep(points: DataFrame, intervals: DataFrame, groups: list[str], payload: str, deepest: int) -> DataFrame:
    """``points`` with ``open``: the payloads of the intervals that hold their key, outermost first.

    Both have ``key`` and the ``groups`` columns; intervals of a group are nested or apart.
    """
    kind = intervals.schema[payload].dataType
    events = _events(intervals.select(*groups, "key", payload)).unionByName(points.withColumn("kind", F.lit(1)).withColumn(payload, F.lit(None).cast(kind)), allowMissingColumns=True)
    events = events.withColumn("depth", _depth(groups))
    w = Window.partitionBy(*groups).orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, 0)
    stack = F.array(*(F.when(F.col("depth") >= k, F.last(F.when((F.col("kind") == 0) & (F.col("depth") == k), F.col(payload)), ignorenulls=True).over(w)) for k in range(1, deepest + 1))) if deepest else F.array().cast(f"array<{kind.simpleString()}>")
    return events.withColumn("open", F.array_compact(stack)).where("kind = 1").drop("kind", "depth", payload)


def _nested(roots: DataFrame) -> int:
    """The most rule hosts that one host can lie in: rule hosts among a rule host's own suffixes."""
    above = roots.select("root", F.explode(F.expr("transform(sequence(1, size(split(root, '[.]'))), i -> array_join(slice(split(root, '[.]'), i, size(split(root, '[.]'))), '.'))")).alias("up"))
    met = above.join(roots.select(F.col("root").alias("up")), "up").groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    return met.agg(F.max("n")).first()[0] or 0


def filter_urls(pages: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow", group: int = GROUP, groups: int = GROUPS) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``; ``rules (host, path, verdict)``."""
    named = {c: f"_in{k}" for k, c in enumerate(pages.columns) if c == url_col or c.lower() not in ("host", "path", "rule", "verdict")}
    urls = pages.select(*(F.col(f"`{c}`").alias(n) for c, n in named.items()))
    host, path = split_url(F.col(named[url_col]))
    urls = urls.withColumn("host", host).withColumn("path", path)
    rules = rules.select(F.lower("host").alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host <> '' and verdict is not null")
    rules = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # 'block' is after 'allow'

    often = cut(urls.groupBy("host").agg(F.count(F.lit(1)).alias("n")))
    n_hosts, n_urls = often.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    deals = n_hosts // max(group, n_hosts // groups) + 1
    most = max(group, n_urls // groups)
    hot = F.broadcast(often.where(F.col("n") > most).select("host", F.ceil(F.col("n") / most).cast("int").alias("deals")))  # at most ``groups`` rows

    roots = cut(rules.select("host").distinct().select(host_key(F.col("host")).alias("key"), F.col("host").alias("root")))
    hosts = often.select("host", host_key(F.col("host")).alias("key"), F.pmod(F.xxhash64("host"), F.lit(deals)).cast("int").alias("salt"))
    chains = sweep(hosts, roots.select("key", "root", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("salt")), ["salt"], "root", _nested(roots))
    owned = chains.select("host", F.explode("open").alias("root"))

    own = rules.select(F.col("host").alias("root"), "path", "verdict")
    whole = F.struct(F.length(F.concat("root", "path")).alias("size"), F.length("root").alias("host_size"), F.concat("root", "path").alias("rule"), "verdict")
    intervals = owned.join(own, "root").select("host", F.encode("path", "UTF-8").alias("key"), whole.alias("found"))
    # Rules of two rule hosts can have one path; the longer one stands for both.
    intervals = cut(intervals.groupBy("host", "key").agg(F.max("found").alias("found")))
    salt = F.coalesce("deals", F.lit(1))
    points = urls.join(hot, "host", "left").withColumn("key", F.encode("path", "UTF-8")).withColumn("salt", F.pmod(F.xxhash64(*named.values()), salt).cast("int")).drop("deals")
    dealt = intervals.join(hot, "host", "left").select("host", "key", "found", F.explode(F.sequence(F.lit(0), salt - 1)).alias("salt"))
    swept = sweep(points, dealt, ["host", "salt"], "found", _deepest(intervals, ["host"]))
    best = F.array_max("open")
    return swept.select(*(F.col(n).alias(c) for c, n in named.items()), "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))
