"""Strongly connected components of a large edge table: trees are trimmed and chains contracted, the rest is labelled forward and backward.

Each round drops the nodes without edges in or out, and takes nodes out of the middle of chains, no two of them neighbours, whose one edge in and one edge out become one edge. So
a chain or a ring of n nodes takes about log n rounds instead of n. A node taken out is of its neighbours' component if they share one. Labels take shortcuts over the labels
of labels, so wide graphs of long diameter take few rounds too.
"""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame, eager: bool = True) -> DataFrame:
    """df with its lineage cut in the folder of spark.checkpoint.dir; where that is unset, in a temporary one in local mode (tests), else an error."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lodegrain-"))
    return df.checkpoint(eager)


def _least_reachable(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, label): the least node from which each can be reached, itself included.

    A round takes the least label over edges, and then the label of the label, as what reaches a node's label reaches the node. So labels go over
    paths that grow by a factor each round. Of the second step only labels that have a better one are sent, once each.
    """
    labels = _cut(nodes.select("node", F.col("node").alias("label")))
    while True:
        sent = edges.join(labels, edges["src"] == labels["node"]).groupBy("dst").agg(F.min("label").alias("_l"))
        near = _cut(labels.join(sent, labels["node"] == sent["dst"], "left").select("node", F.least("label", F.coalesce("_l", "label")).alias("label"), (F.col("_l") < F.col("label")).alias("_moved")))
        if near.where("_moved").isEmpty():
            return near.select("node", "label")
        better = near.select("label").distinct().join(near.select(F.col("node").alias("label"), F.col("label").alias("_far")), "label").where("_far < label")
        labels = _cut(near.join(better, "label", "left").select("node", F.coalesce("_far", "label").alias("label")))


def _shrunk(left: DataFrame) -> tuple[DataFrame, list[DataFrame]]:
    """Edges without trees and chains, and the nodes (node, u, w) that were taken out of chains, by rounds. Edges are distinct and join two nodes."""
    taken, size = [], left.count()
    while size:
        into = left.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("ins"), F.min("src").alias("u"))
        out = left.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("outs"), F.min("dst").alias("w"))
        nodes = _cut(into.join(out, "node"))
        height = lambda c: F.xxhash64(c, F.lit(len(taken)))
        tops = _cut(nodes.where((F.col("ins") == 1) & (F.col("outs") == 1) & (height("node") > height("u")) & (height("node") > height("w"))).select("node", "u", "w"))
        alive = nodes.select("node").join(tops, "node", "left_anti")
        kept = left.join(alive.select(F.col("node").alias("src")), "src", "left_semi").join(alive.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")
        spliced = tops.select(F.col("u").alias("src"), F.col("w").alias("dst")).where("src <> dst")
        new = _cut(kept.union(spliced).distinct())
        now = new.count()
        if now == size:
            return new, taken
        if not tops.isEmpty():
            taken.append(tops)
        left, size = new, now
    return left, taken


def components(edges: DataFrame) -> DataFrame:
    """edges(src, dst) to (node, component): the strongly connected components of two nodes or more, named by their least node.

    On what is left of trees and chains, the nodes that the least label reaches both ways form a component; edges
    between different labels are dropped and the rest goes round again. Edges from a node to itself and null ends don't count.
    """
    left = _cut(edges.select("src", "dst").where("src is not null and dst is not null and src <> dst").distinct())
    done, taken = None, []
    while True:
        left, more = _shrunk(left)
        taken += more
        if left.isEmpty():
            break
        nodes = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        forward = _least_reachable(left, nodes)
        backward = _least_reachable(left.select(F.col("dst").alias("src"), F.col("src").alias("dst")), nodes)
        both = _cut(forward.withColumnRenamed("label", "f").join(backward.withColumnRenamed("label", "b"), "node"))
        found = both.where("f = b").select("node", F.col("f").alias("component"))
        done = found if done is None else done.union(found)
        rest = both.where("f <> b")
        of = lambda x: rest.select(F.col("node").alias(x), F.col("f").alias("f_" + x), F.col("b").alias("b_" + x))
        left = _cut(left.join(of("src"), "src").join(of("dst"), "dst").where("f_src = f_dst and b_src = b_dst").select("src", "dst"))
    if done is None and not taken:
        return edges.select(F.col("src").alias("node"), F.col("src").alias("component")).limit(0)
    done = done if done is not None else taken[0].select("node", F.col("node").alias("component")).limit(0)
    for tops in reversed(taken):
        name = lambda x: done.select(F.col("node").alias(x), F.col("component").alias("_" + x))
        placed = tops.join(name("u"), "u", "left").join(name("w"), "w", "left").withColumn("component", F.coalesce("_u", "u")).where(F.col("component") == F.coalesce("_w", "w"))
        done = _cut(done.union(placed.select("node", "component")).union(placed.select("u", "component")).distinct())
    sizes = done.groupBy("component").agg(F.count(F.lit(1)).alias("_n"), F.min("node").alias("_least")).where("_n > 1")
    return done.join(sizes, "component").select("node", F.col("_least").alias("component"))


def cycles(edges: DataFrame) -> DataFrame:
    """(component, node, length): the nodes of each component with their number. A component may be of any size, so its nodes are rows."""
    nodes = components(edges)
    return nodes.join(nodes.groupBy("component").agg(F.count(F.lit(1)).cast("int").alias("length")), "component").select("component", "node", "length")
