"""URL filter rules by a sorted sweep over nested intervals; DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from airgrid.session import cut_lineage

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CLOSE, OPEN, POINT = 0, 1, 2


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to ``/``, ``?``, ``#`` or end, A-Z lower-cased) and path (then up to ``?``, ``#`` or end).

    Both are empty for a null url or one without ``://``.
    """
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    """``www.example.org`` as ``org.example.www.``: a host and all its subdomains share a prefix."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def with_stack(rules: DataFrame, key: str, group: str, prefixes: Column) -> DataFrame:
    """Adds ``stack``: the keys of the rows of the same group that are prefixes of this one, shortest first, itself last."""
    found = (
        rules.select(group, key, F.explode(F.array_distinct(prefixes)).alias("prefix_"))
        .join(rules.select(group, F.col(key).alias("prefix_")), [group, "prefix_"])
        .groupBy(group, key)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct(F.length("prefix_").alias("n"), "prefix_"))), lambda x: x["prefix_"]).alias("stack"))
    )
    return rules.join(found, [group, key])


def sweep(points: DataFrame, intervals: DataFrame, tie: str) -> DataFrame:
    """Each point with ``stack``, the intervals around it from the outermost to the innermost (null or empty: none).

    ``points``: ``key`` BINARY and any payload, of which the column ``tie`` tells points with one key apart. ``intervals``:
    ``key`` BINARY and ``stack`` as above; an interval holds all keys that begin with its key, so two of them are nested or
    apart. All are put in one order and swept: an opening rule leaves its own stack on top, a closing one its parent's. The
    order is cut into ranges, also inside a frequent key; a range starts with the stack that the range before it ended with.
    """
    payload = [c for c in points.columns if c not in ("key",)]
    types = dict(points.dtypes)
    stack_type = dict(intervals.dtypes)["stack"]
    depth = F.size("stack")
    rules = intervals.select(
        F.explode(F.array(
            F.struct(F.col("key"), F.lit(OPEN).alias("kind"), F.lit(0).alias("depth"), F.col("stack").alias("top")),
            # No text holds the byte FF, so this is behind all keys with the prefix.
            F.struct(F.concat("key", F.unhex(F.lit("FF"))).alias("key"), F.lit(CLOSE).alias("kind"), (-depth).alias("depth"), F.slice("stack", F.lit(1), depth - 1).alias("top")),
        )).alias("e"),
    ).select("e.*", *[F.lit(None).cast(types[c]).alias(c) for c in payload])
    events = points.select("key", F.lit(POINT).alias("kind"), F.lit(0).alias("depth"), F.lit(None).cast(stack_type).alias("top"), *payload).unionByName(rules)
    spark = points.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = cut_lineage(events.repartitionByRange(ranges, "key", "kind", "depth", tie).withColumn("range", F.spark_partition_id()))
    order = ["key", "kind", "depth"]
    ends = placed.filter("top IS NOT NULL").groupBy("range").agg(F.max_by("top", F.struct(*order)).alias("end"))
    start = (  # one row per range
        spark.range(ranges).select(F.col("id").cast("int").alias("range")).join(ends, "range", "left")
        .select("range", F.last("end", ignorenulls=True).over(Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)).alias("start"))
    )
    so_far = Window.partitionBy("range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    swept = placed.withColumn("own", F.last("top", ignorenulls=True).over(so_far)).filter(F.col("kind") == POINT)
    return swept.join(start, "range", "left").select("key", *payload, F.coalesce("own", "start").alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", page_id: str = "page_id", url: str = "url") -> DataFrame:
    """``page_id, url, host, path, rule, verdict`` of every row of ``pages``.

    ``rules``: host STRING, path STRING, verdict STRING (``allow`` or ``block``), any number of rows. A rule fits its host and
    all subdomains if the page's path begins with its path; of the fitting rules the one with the longest text wins, then the
    one with the longer host. Where none fits, ``rule`` is null and the verdict is ``default``. Of rules with equal host and
    path ``block`` wins; rules with a null or empty host or a null path fit nothing. Repeated rows are kept, a null or
    malformed url has an empty host and path and gets the default, an empty table gives an empty table. Only the two named
    columns are read, so other columns may have any name.

    First the distinct hosts are swept over the rules' hosts, which gives each host its stack of nested rule hosts; then the
    pages of hosts with a stack are swept over the paths of each of these.
    """
    host, path = host_path(F.col("url"))
    rows = (
        pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"))
        .groupBy("page_id", "url").agg(F.count(F.lit(1)).alias("copies"))
        .withColumns({"host": host, "path": path})
    )
    given = (
        rules.select("host", "path", "verdict").filter("host <> '' AND path IS NOT NULL")
        .withColumn("host", F.translate("host", UPPER, LOWER)).groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("node", host_key(F.col("host")))
    )
    labels = F.split(F.rtrim(F.col("node"), F.lit(".")), r"\.")
    node_prefixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(F.array_join(F.slice(labels, F.lit(1), i), "."), F.lit(".")))
    nodes = with_stack(given.select("node", F.lit(0).alias("all")).distinct(), "node", "all", node_prefixes)
    hosts = rows.select("host").distinct().filter("host <> ''")
    found_hosts = sweep(
        hosts.select(host_key(F.col("host")).cast("binary").alias("key"), "host"),
        nodes.select(F.col("node").cast("binary").alias("key"), "stack"), "host",
    ).filter(F.size("stack") > 0).select("host", F.explode("stack").alias("node"))

    path_prefixes = F.transform(F.sequence(F.lit(0), F.length("path")), lambda i: F.substring(F.col("path"), F.lit(1), i))
    path_rules = with_stack(given.select("node", "path"), "path", "node", path_prefixes)
    key = F.concat(F.col("node").cast("binary"), F.unhex(F.lit("00")), F.col("path").cast("binary"))
    fits = sweep(
        rows.join(found_hosts, "host").select(key.alias("key"), "page_id", "url", "host", "path", "copies", "node"),
        path_rules.select(key.alias("key"), "stack"), "page_id",
    ).filter(F.size("stack") > 0).select("page_id", "url", "node", F.element_at("stack", -1).alias("rule_path"))
    texts = given.select(
        "node", F.col("path").alias("rule_path"),
        F.struct(F.length(F.concat("host", "path")).alias("n"), F.length("host").alias("h"), F.concat("host", "path").alias("rule"), "verdict").alias("rule"),
    )
    best = fits.join(texts, ["node", "rule_path"]).groupBy("page_id", "url").agg(F.max("rule").alias("best"))
    # Pages without a rule need no partner, so both sides meet in an aggregate that also takes null ids and urls.
    together = rows.select("page_id", "url", "host", "path", "copies", F.lit(None).cast(dict(best.dtypes)["best"]).alias("best")).unionByName(best, allowMissingColumns=True)
    return (
        together.groupBy("page_id", "url")
        .agg(*[F.max(c).alias(c) for c in ("host", "path", "copies", "best")])
        .select(
            "page_id", "url", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"),
            F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"),
        )
        .drop("copy")
    )
