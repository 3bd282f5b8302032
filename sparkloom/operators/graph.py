"""Graph analytics by repeated joins; edges are (a, b) with a < b, undirected."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from sparkloom.functions.exprs import ratio, rnd
from sparkloom.session import cut_lineage, stored_round


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.inline(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))))


def page_rank(edges: DataFrame, rounds: int = 10, damping: float = 0.85) -> DataFrame:
    """Ranks that add up to one; a hub's contributions are summed on the map side."""
    arcs = cut_lineage(both_ways(edges))
    out = arcs.groupBy("src").agg(F.count("*").alias("out"))
    n = out.count()
    ranks = out.select(F.col("src").alias("node"), "out", F.lit(1.0 / max(n, 1)).alias("rank"))
    for i in range(rounds):
        sent = arcs.join(ranks.select(F.col("node").alias("src"), (F.col("rank") / F.col("out")).alias("part")), "src").groupBy(F.col("dst").alias("node")).agg(F.sum("part").alias("got"))
        ranks = out.withColumnRenamed("src", "node").join(sent, "node", "left").select("node", "out", (F.lit((1 - damping) / max(n, 1)) + damping * F.coalesce("got", F.lit(0.0))).alias("rank"))
        if i % 4 == 3:
            ranks = stored_round(ranks)
    return ranks.select("node", "rank")


def components(edges: DataFrame) -> DataFrame:
    """Smallest node id of each node's component: neighbour minimum, handed on to the node that one's label names, then a jump to the label's label, until nothing changes.

    As a whole tree of labels moves when one of its nodes meets a smaller label, rounds follow the logarithm of the nodes, not the longest path.
    """
    arcs = stored_round(both_ways(edges))
    labels = stored_round(arcs.groupBy(F.col("src").alias("node")).agg(F.least(F.min("src"), F.min("dst")).alias("label")))
    while True:
        near = arcs.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("label").alias("_m"))
        step = labels.join(near, "node").select("node", "label", F.least("label", "_m").alias("_l"))
        # what a node has found goes to itself and to the node its label names
        told = step.select(F.inline(F.array(F.struct("node", "label", "_l"), F.struct(F.col("label").alias("node"), F.col("label").alias("label"), "_l"))))
        step = told.groupBy("node").agg(F.min("label").alias("label"), F.min("_l").alias("_l"))
        jump = step.join(labels.select(F.col("node").alias("_l"), F.col("label").alias("_ll")), "_l", "left")
        new = stored_round(jump.select("node", "label", F.least("_l", F.coalesce("_ll", "_l")).alias("_new")))
        moved = new.where("_new <> label").limit(1).count()
        labels = new.select("node", F.col("_new").alias("label"))
        if not moved:
            return labels


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """(node, d) of the k-core, d the degree in it: nodes of lower degree go until none is left."""
    left = stored_round(edges)
    size = left.count()
    while True:
        degree = both_ways(left).groupBy("src").agg(F.count("*").alias("d"))
        keep = degree.where(F.col("d") >= k)
        nxt = stored_round(left.join(keep.select(F.col("src").alias("a")), "a", "left_semi").join(keep.select(F.col("src").alias("b")), "b", "left_semi").select("a", "b"))
        now = nxt.count()
        if now == size:
            return degree.select(F.col("src").alias("node"), "d")
        left, size = nxt, now


def core_numbers(edges: DataFrame) -> DataFrame:
    """(node, core): the largest k whose k-core holds the node.

    Starting from its degree, a node takes the largest h such that h neighbours have at least h, until no node changes. A hub's neighbours
    are counted by their number before they are shuffled, and numbers above its own count as its own, so a node has few rows.
    """
    arcs = cut_lineage(both_ways(edges))
    now = arcs.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("core"))
    down = W.partitionBy("node").orderBy(F.desc("v"))
    while True:
        own = now.select(F.col("node").alias("src"), F.col("core").alias("mine"))
        near = arcs.join(now.select(F.col("node").alias("dst"), "core"), "dst").join(own, "src")
        counts = near.groupBy(F.col("src").alias("node"), "mine", F.least("core", "mine").alias("v")).agg(F.count("*").alias("n"))
        reach = counts.withColumn("at_least", F.sum("n").over(down))
        new = stored_round(reach.groupBy("node", "mine").agg(F.max(F.least("v", "at_least")).alias("core")))
        moved = new.where("core <> mine").limit(1).count()
        now = new.select("node", "core")
        if not moved:
            return now


def triangles(edges: DataFrame) -> DataFrame:
    """Triangles and clustering per node.

    Arcs point from lower to higher degree, so a node has at most sqrt(2 x edges) outgoing arcs and
    hubs never pair up their neighbours.
    """
    degree = both_ways(edges).groupBy("src").agg(F.count("*").alias("d"))
    da, db = degree.select(F.col("src").alias("a"), F.col("d").alias("da")), degree.select(F.col("src").alias("b"), F.col("d").alias("db"))
    e = edges.join(da, "a").join(db, "b")
    up = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    arcs = cut_lineage(e.select(F.when(up, F.col("a")).otherwise(F.col("b")).alias("u"), F.when(up, F.col("b")).otherwise(F.col("a")).alias("v")))
    wedges = arcs.select("u", "v").join(arcs.select("u", F.col("v").alias("w")), "u").where("v < w")
    closed = wedges.join(edges.select(F.col("a").alias("v"), F.col("b").alias("w")), ["v", "w"])
    per = closed.select(F.explode(F.array("u", "v", "w")).alias("node")).groupBy("node").agg(F.count("*").alias("triangles"))
    d = degree.withColumnRenamed("src", "node")
    return d.join(per, "node", "left").select("node", F.col("d").alias("degree"), F.coalesce("triangles", F.lit(0)).alias("triangles"),
                                              rnd(F.coalesce(ratio(2 * F.coalesce("triangles", F.lit(0)), F.col("d") * (F.col("d") - 1)), F.lit(0.0)), 6).alias("clustering"))


def communities(edges: DataFrame, rounds: int = 5) -> DataFrame:
    """Label propagation: the most frequent label among neighbours, the smallest on ties."""
    arcs = cut_lineage(both_ways(edges))
    labels = arcs.select(F.col("src").alias("node")).distinct().withColumn("label", F.col("node"))
    for _ in range(rounds):
        votes = arcs.join(labels.select(F.col("node").alias("dst"), "label"), "dst").groupBy(F.col("src").alias("node"), "label").agg(F.count("*").alias("n"))
        labels = stored_round(votes.groupBy("node").agg(F.min_by("label", F.struct(-F.col("n"), F.col("label"))).alias("label")))
    return labels
