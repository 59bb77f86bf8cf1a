"""Connected components by label propagation with pointer jumping, all in DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, stage


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of the edges (a, b); component is the smallest id that is reachable.

    Each round takes the smallest label among the neighbours (a partial minimum
    before the shuffle, so a hub is no hot task) and then the label of one's
    label, which halves the depth of the trees. Each round's labels are written
    into the shared folder; only a count of changes comes to the driver. Loops
    and repeated edges are allowed; an empty table gives an empty result.
    """
    pairs = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).filter("a <> b")
    both = stage(pairs.select("a", "b").union(pairs.select("b", "a")).distinct(), "edges")
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("c")), "labels")
    while True:
        near = both.join(labels, both["b"] == labels["id"]).groupBy("a").agg(F.min("c").alias("m"))
        hooked = stage(labels.join(near, labels["id"] == near["a"], "left").select("id", F.col("c").alias("old"), F.least("c", "m").alias("c")), "hooked")
        jump = hooked.select(F.col("id").alias("p"), F.col("c").alias("pc"))
        new = stage(hooked.join(jump, hooked["c"] == jump["p"]).select("id", "old", F.least("c", "pc").alias("c")), "labels")
        drop(labels, hooked)
        changed = new.filter("c <> old").limit(1).count()
        labels = new
        if not changed:
            drop(both)
            return labels.select("id", F.col("c").alias("component"))
