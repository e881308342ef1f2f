"""URL rules by a sort-merge range join.

A rule names a host and the beginning of a path; it fits the host, all its subdomains
and every path that begins so. With the host's labels reversed, rule and url have
canonical keys: a rule is the interval of all keys that begin with its own, and a url
is a point for each of its parent hosts. Rules nest like brackets, so a sweep over
sorted rules and points keeps the stack of open rules; the top one fits the point best.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.llm import ranges

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BREAK = "\u0000"  # between host and path: sorts below all that a host can hold
AFTER = "\U0010ffff"  # closes a rule's interval
OPEN, POINT, CLOSE = 0, 1, 2
POINTS_PER_RANGE = 4096


def url_host(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z in lower case; else empty."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def url_path(url: Column) -> Column:
    """From the end of the host up to ``?``, ``#`` or the end; else empty."""
    rest = _after_scheme(url)
    return F.regexp_extract(F.regexp_replace(rest, "^[^/?#]*", ""), "^[^?#]*", 0)


def _after_scheme(url: Column) -> Column:
    at = F.locate("://", url)
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _key(labels: Column, path: Column) -> Column:
    return F.concat(F.array_join(labels, "."), F.lit(BREAK), path)


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """Columns host, path, rule and verdict beside page_id, for every row of ``pages`` (page_id, url).

    ``rules`` has host, path and verdict. Of the rules that fit, the one with the
    longest host and path together wins, of equally long ones that with the longer
    host; without one, ``rule`` is null and ``verdict`` the default. Of rules with the
    same host and path, ``block`` counts. A null url, or one without ``://``, has an
    empty host and path. Repeated pages stay repeated; extra columns are left out.
    """
    # a page listed twice is judged once and counted twice
    urls = (
        pages.groupBy("page_id", "url").agg(F.count("*").alias("copies"))
        .select("page_id", "url", "copies", url_host(F.col("url")).alias("host"), url_path(F.col("url")).alias("path"))
    )
    intervals = (
        rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
        .withColumn("labels", F.reverse(F.split("host", r"\.", -1)))
        .withColumn("key", _key(F.col("labels"), F.col("path")))
    )
    most_labels = intervals.agg(F.max(F.size("labels"))).first()[0]
    best = None
    if most_labels:
        # no rule has more labels, so longer suffixes of a host need no point
        labels = F.reverse(F.split("host", r"\.", -1))
        points = urls.select(
            "page_id", "url",
            F.explode(F.transform(
                F.sequence(F.lit(1), F.least(F.size(labels), F.lit(most_labels))),
                lambda n: _key(F.slice(labels, F.lit(1), n), F.col("path")),
            )).alias("key"),
        )
        best = _sweep(points, intervals)
    if best is None:
        found = urls.withColumn("fit", F.lit(None).cast("struct<length:int,host:int,rule:string,verdict:string>"))
    else:
        same = [F.col("page_id").eqNullSafe(F.col("_page")), F.col("url").eqNullSafe(F.col("_url"))]
        found = urls.join(best, same, "left")
    return (
        found.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
        .select("page_id", "host", "path", F.col("fit.rule").alias("rule"),
                F.coalesce("fit.verdict", F.lit(default)).alias("verdict"))
    )


def _sweep(points: DataFrame, intervals: DataFrame) -> DataFrame | None:
    """The best rule of each (page_id, url) that has one."""
    # a hot key is several splitters: its points are spread over the ranges between them, and rules reach all of these
    rows = points.count()
    wanted = ranges.count_ranges(rows, POINTS_PER_RANGE)
    key = F.col("key")
    drawn = ranges.sample(points, key, [F.col("page_id"), F.col("url"), key], F.lit(1.0), rows, wanted * ranges.SAMPLES_PER_RANGE)
    cuts = ranges.splitters(drawn, wanted)
    first, last = ranges.below(key, cuts), ranges.upto(key, cuts)
    placed = points.select(
        (first + F.pmod(F.xxhash64("page_id", "url"), (last - first + 1).cast("long"))).cast("int").alias("range"),
        "key", F.lit(POINT).alias("kind"), "page_id", "url",
    )
    name = F.concat("host", "path")
    closing = F.concat(key, F.lit(AFTER))
    brackets = (
        intervals.select(
            "key", F.struct(F.length(name).alias("length"), F.length("host").alias("host"), name.alias("rule"), "verdict").alias("rule"),
            F.explode(F.sequence(ranges.below(key, cuts), ranges.upto(closing, cuts))).alias("range"),
        )
        .select(F.col("range").cast("int").alias("range"), "rule",
                F.inline(F.array(F.struct(key.alias("key"), F.lit(OPEN).alias("kind")), F.struct(closing.alias("key"), F.lit(CLOSE).alias("kind")))))
    )
    swept = Window.partitionBy("range").orderBy("key", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    depth = F.sum(step).over(swept).cast("int")
    deepest = brackets.withColumn("depth", depth).agg(F.max("depth")).first()[0]
    if not deepest:
        return None
    events = placed.withColumn("rule", F.lit(None).cast(brackets.schema["rule"].dataType)).unionByName(
        brackets.select("range", "key", "kind", F.lit(None).cast(points.schema["page_id"].dataType).alias("page_id"),
                        F.lit(None).cast("string").alias("url"), "rule")
    )
    opened = lambda level: F.when((F.col("kind") == OPEN) & (F.col("depth") == level), F.col("rule"))
    stack = F.array(*[F.last(opened(level), ignorenulls=True).over(swept) for level in range(1, deepest + 1)])
    return (
        events.withColumn("depth", depth)
        .withColumn("top", F.when((F.col("kind") == POINT) & (F.col("depth") > 0), F.get(stack, F.col("depth") - 1)))
        .where(F.col("top").isNotNull())
        .groupBy(F.col("page_id").alias("_page"), F.col("url").alias("_url"))
        .agg(F.max("top").alias("fit"))
    )
