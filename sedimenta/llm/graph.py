"""Connected components of an edge table by distributed hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimenta.session import scratch, written


def components(edges: DataFrame, a: str = "a", b: str = "b", folder: str | None = None) -> DataFrame:
    """(node, root) for every node of edges: root is one node of its component, the same for all of it.

    Each round hooks every node to its least smaller neighbour, jumps twice along the hooks and contracts the edges,
    so chains shrink by halves. A node with very many edges is only ever met by partial aggregates and by joins that
    adaptive execution can split. Rounds are cut by written tables, which survive lost executors. Null nodes and
    self-loops are ignored; no edges give no rows.
    """
    folder = folder or scratch(edges.sparkSession, "components")
    x, y = F.col(a), F.col(b)
    kept = edges.where(x.isNotNull() & y.isNotNull() & (x != y)).select(F.greatest(x, y).alias("a"), F.least(x, y).alias("b")).distinct()
    live = written(kept, f"{folder}/edges-0")
    roots = written(live.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), f"{folder}/roots-0")
    k = 0
    while not live.isEmpty():
        k += 1
        hooks = written(live.groupBy("a").agg(F.min("b").alias("up")), f"{folder}/hooks-{k}")
        over = hooks.select(F.col("a").alias("up"), F.col("up").alias("top"))
        jumps = written(hooks.join(over, "up", "left").select("a", F.coalesce("top", "up").alias("to")), f"{folder}/jumps-{k}")
        at_a = jumps.select("a", F.col("to").alias("na"))
        at_b = jumps.select(F.col("a").alias("b"), F.col("to").alias("nb"))
        moved = live.join(at_a, "a", "left").join(at_b, "b", "left").select(F.coalesce("na", "a").alias("p"), F.coalesce("nb", "b").alias("q"))
        live = written(moved.where("p != q").select(F.greatest("p", "q").alias("a"), F.least("p", "q").alias("b")).distinct(), f"{folder}/edges-{k}")
        at_root = jumps.select(F.col("a").alias("root"), F.col("to").alias("nr"))
        roots = written(roots.join(at_root, "root", "left").select("node", F.coalesce("nr", "root").alias("root")), f"{folder}/roots-{k}")
    return roots
