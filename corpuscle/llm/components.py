"""Connected components of an edge table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .scratch import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """Label every node of ``edges(a, b)`` with the smallest node it can reach: ``(node, label)``.

    Each round hooks every node that has a smaller neighbour onto the smallest one, follows the hooks to their roots,
    and contracts the edges, so the graph shrinks by a factor each round and no node's edges are ever gathered: a hub
    of any degree is a min-aggregate with map-side combining. Nodes without edges don't appear. Nothing comes to the
    driver but one emptiness flag a step. Null ends are ignored; loops and repeated edges are harmless.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = scratch.keep(e, "cc-edges")
    labels = None
    while not e.isEmpty():
        # every larger end hooks to its smallest neighbour; ends that are nobody's larger end stay roots
        hook = scratch.keep(e.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label")), "cc-hook")
        while True:
            up = hook.select(F.col("node").alias("label"), F.col("label").alias("above"))
            jumped = scratch.keep(hook.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"), F.col("above").isNotNull().alias("moved")), "cc-jump")
            moved = not jumped.where("moved").isEmpty()
            scratch.drop(hook)
            hook = jumped
            if not moved:
                break
        step = hook.select("node", "label")
        if labels is None:
            merged = step
        else:
            up = step.select(F.col("node").alias("label"), F.col("label").alias("above"))
            old = labels.join(up, "label", "left").select("node", F.coalesce("above", "label").alias("label"))
            merged = old.unionByName(step.join(labels.select("node"), "node", "left_anti"))
        merged = scratch.keep(merged, "cc-labels")
        to = step.select(F.col("node").alias("a"), F.col("label").alias("la"))
        down = step.select(F.col("node").alias("b"), F.col("label").alias("lb"))
        nxt = e.join(to, "a", "left").join(down, "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
        nxt = scratch.keep(nxt.where("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct(), "cc-edges")
        scratch.drop(e, hook, *([labels] if labels is not None else []))
        labels, e = merged, nxt
    scratch.drop(e)
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("label")).where("false")
    roots = labels.select(F.col("label").alias("node")).distinct().withColumn("label", F.col("node"))
    return labels.unionByName(roots.join(labels.select("node"), "node", "left_anti"))
