"""Connected components by shuffled joins: neither links nor components are gathered anywhere."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fundtrace.llm.store import checked_broadcast, counted, written

#: Steps along a chain of nodes that one pass makes.
STEPS = 3


def components(links: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """(node, component) of every node of links (a, b: long) and of `before`, an earlier result; the component is its smallest node.

    In each round a node takes the smallest node around it, such chains of nodes are followed to their ends, and links are
    rewritten as links between ends. A link inside a component is gone then, and many become one, so rounds work on
    ever fewer links; stars need one round. All tables are written to the shared folder.
    """
    def ends(edges: DataFrame, labels: DataFrame, n: int | None) -> DataFrame:
        to = lambda k: checked_broadcast(labels.select(F.col("node").alias(k), F.col("component").alias(f"{k}_end")), n)
        moved = edges.join(to("a"), "a", "left").join(to("b"), "b", "left").select(F.coalesce("a_end", "a").alias("p"), F.coalesce("b_end", "b").alias("q"))
        return moved.filter("p != q").select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()

    edges, seen = counted(ends(links, before, None) if before is not None else links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if before is None and not seen["n"]:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    found = before
    while seen["n"]:
        up = edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("component"))
        first = edges.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
        labels = written(up.unionByName(first).groupBy("node").agg(F.min("component").alias("component")), "labels")
        while True:
            ahead = checked_broadcast(labels.filter("node != component").select(F.col("node").alias("component"), F.col("component").alias("next")), 2 * seen["n"])
            step = labels.withColumn("moved", F.lit(False))
            for _ in range(STEPS):
                step = step.join(ahead, "component", "left").select("node", F.coalesce("next", "component").alias("component"), F.col("next").isNotNull().alias("moved"))
            step, chains = counted(step, "labels", moved=F.count_if("moved"))
            labels = step.select("node", "component")
            if not chains["moved"]:
                break
        if found is None:
            found = labels
        else:
            to = checked_broadcast(labels.select(F.col("node").alias("component"), F.col("component").alias("end")), 2 * seen["n"])
            moved = found.join(to, "component", "left").select("node", F.coalesce("end", "component").alias("component"))
            found = written(moved.unionByName(labels.join(found.select("node"), "node", "left_anti")), "found")
        edges, seen = counted(ends(edges, labels, 2 * seen["n"]), "edges")
    return found
