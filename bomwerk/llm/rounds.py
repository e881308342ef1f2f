"""Classes of similar nodes from buckets in which they meet.

No bucket is paired off with itself. In rounds, all members of a bucket are compared
with a few hubs; then the hubs go, and with them every member that, by the triangle
inequality, cannot be similar to a member still unlinked. A bucket of near-copies is
done after one round, and no link between classes is lost.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bomwerk.llm.tables import stored
from bomwerk.operators.lookup import join_on_key

SHORT = 1 << 17  # edges that one task joins
MOST_HUBS = 64  # of a bucket in one round; rounds go on as long as they must


def _draw(node: str) -> Column:
    """A fixed random order of nodes, the same in all buckets, so that few nodes are hubs."""
    return F.struct(F.xxhash64(F.lit(7), F.col(node)), F.col(node))


def links(members: DataFrame, judge: Callable[[DataFrame], DataFrame], slack: float) -> DataFrame:
    """Links (node, other) that join all classes of similar nodes.

    ``members`` (bucket, node) has every pair of similar nodes in some bucket. ``judge``
    adds to pairs (node, hub) how ``near`` they are and whether they are ``linked``. A
    constant minus ``near`` must be a distance, and two nodes of which one is nearer to
    a third node than the other by more than ``slack`` must not be linked.
    """
    shared = members.groupBy("bucket").agg(F.count("*").alias("_n")).where(F.col("_n") > 1).select("bucket")
    active = stored(join_on_key(members, shared, {"bucket": "bucket"}, "inner"), "near-members")
    found, hubs = None, 1
    while True:
        first = Window.partitionBy("bucket").orderBy(_draw("node"))
        chosen = active.withColumn("_place", F.row_number().over(first)).where(F.col("_place") <= hubs)
        per_bucket = chosen.groupBy("bucket").agg(F.collect_list("node").alias("hubs"))  # at most ``hubs`` of them
        met = join_on_key(active, per_bucket, {"bucket": "bucket"}, "inner").select(
            "bucket", "node", F.array_contains("hubs", F.col("node")).alias("is_hub"), F.explode("hubs").alias("hub")
        )
        met = stored(met.where(_draw("node") > _draw("hub")), "near-met")
        judged = stored(judge(met.select("node", "hub").distinct()).select("node", "hub", "near", "linked"), "near-judged")
        linked = judged.where("linked").select("node", F.col("hub").alias("other"))
        found = linked if found is None else found.unionByName(linked)
        # who is left: members without a link to a hub, and those that may still resemble one of them
        rest = met.where(~F.col("is_hub")).join(judged, ["node", "hub"]).groupBy("bucket", "node")
        rest = stored(rest.agg(F.max("near").alias("best"), F.bool_or("linked").alias("linked")), "near-rest")
        unlinked = F.when(~F.col("linked"), F.col("best"))
        reach = rest.groupBy("bucket").agg(
            F.max(unlinked).alias("reach"), F.count(unlinked).alias("open"), F.min(F.when(F.col("linked"), F.col("best"))).alias("nearest")
        )
        # a single unlinked member with nobody to compare is done
        reach = reach.where((F.col("open") > 1) | (F.col("open") == 1) & (F.col("nearest") <= F.col("reach") + slack))
        after = join_on_key(rest, reach, {"bucket": "bucket"}, "inner").where(~F.col("linked") | (F.col("best") <= F.col("reach") + slack))
        active = stored(after.select("bucket", "node"), "near-members")
        if active.isEmpty():
            return found
        hubs = min(2 * hubs, MOST_HUBS)


def _apart(edges: DataFrame) -> DataFrame:
    """Each pair of different nodes once."""
    return edges.where(F.col("node") != F.col("other")).select(F.greatest("node", "other").alias("node"), F.least("node", "other").alias("other")).distinct()


def _united(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a bounded number of edges: the root is its component's lowest node."""
    up: dict[int, int] = {}

    def top(node: int) -> int:
        while (above := up.setdefault(node, node)) != node:
            up[node] = up[above]
            node = above
        return node

    for batch in parts:
        for node, other in zip(batch.column("node").to_pylist(), batch.column("other").to_pylist(), strict=True):
            low, high = sorted((top(node), top(other)))
            up[high] = low
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([top(node) for node in up], pa.int64())], names=["node", "root"])


def components(edges: DataFrame, short: int = SHORT) -> DataFrame:
    """(node, root) for every node of ``edges`` (node, other): the root is its component's lowest node.

    While there are more than ``short`` edges, each node joins the first of its neighbours
    and itself in an order drawn anew, and edges go on between those; a constant share of
    the nodes vanishes each time. Only minima are aggregated, so a node with very many
    neighbours costs little. The rest, at most ``short`` edges, is joined in one task.
    """
    edges = stored(_apart(edges), "near-edges")
    hooks: list[DataFrame] = []
    while edges.count() > short:
        draw = lambda name, turn=len(hooks): F.struct(F.xxhash64(F.lit(turn), F.col(name)).alias("draw"), F.col(name).alias("id"))
        both = edges.unionByName(edges.select(F.col("other").alias("node"), F.col("node").alias("other")))
        hook = both.groupBy("node").agg(F.min(draw("other")).alias("to")).select("node", F.least("to", draw("node")).getField("id").alias("to"))
        hook = stored(hook, "near-hooks")
        hooks.append(hook)
        moved = join_on_key(edges, hook.withColumnRenamed("to", "_node"), {"node": "node"}, "inner")
        moved = join_on_key(moved, hook.withColumnRenamed("to", "_other"), {"other": "node"}, "inner")
        edges = stored(_apart(moved.select(F.col("_node").alias("node"), F.col("_other").alias("other"))), "near-edges")
    found = stored(edges.repartition(1).mapInArrow(_united, "node long, root long"), "near-roots")
    for hook in reversed(hooks):
        placed = join_on_key(hook, found, {"to": "node"}).select("node", F.coalesce("root", "to").alias("root"))
        # a node that was joined to has a row of its own among the hooks
        found = stored(placed, "near-roots")
    if not hooks:
        return found
    lowest = found.groupBy("root").agg(F.min("node").alias("low"))
    return stored(join_on_key(found, lowest, {"root": "root"}, "inner").select("node", F.col("low").alias("root")), "near-roots")


def joined(roots: DataFrame, edges: DataFrame) -> DataFrame:
    """``roots`` (node, root) after ``edges`` (node, other) between roots, or nodes without one, were added."""
    more = components(edges)
    renamed = join_on_key(roots, more.withColumnRenamed("root", "_root"), {"root": "node"}).select("node", F.coalesce("_root", "root").alias("root"))
    return renamed.unionByName(more).groupBy("node").agg(F.min("root").alias("root"))
