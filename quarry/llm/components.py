"""Connected components of an edge table, by alternating large-star and small-star steps (Kiveris et al., 2014).

Every step is a written table in the shared folder, and the step before is then deleted; nothing is gathered on the driver
but a count and a checksum.  The edges of a hub are not dealt to one task: ``shared.join_counted`` splits it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, join_counted, written

STEPS = 60


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for each node of ``edges`` (a, b: long); root is the smallest node reachable, itself included.

    Self-links, repeated and reversed edges don't matter; edges with a null are dropped; no edges give no rows.
    """
    lower, upper = F.least("a", "b"), F.greatest("a", "b")
    edges = edges.where("a is not null and b is not null and a <> b").select(upper.alias("u"), lower.alias("v")).distinct()
    edges, seen = written(edges, "edges"), None
    for _ in range(STEPS):
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == seen or not now[0]:
            break
        seen = now
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        large = join_counted(both, least, "u", "n", 2 * now[0]).where("v > u and v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # now every edge has u > v; small-star joins the smaller neighbours of u to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = join_counted(large, least, "u", "n", 2 * now[0]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(least.select("u", "m"))
        last, edges = edges, written(small.where("u <> v").distinct(), "edges")
        discard(last)
    else:
        raise RuntimeError(f"components did not settle in {STEPS} steps")
    roots = edges.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
