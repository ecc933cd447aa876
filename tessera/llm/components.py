"""Connected components over links, for the near-duplicate operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import store


def components(links: DataFrame) -> DataFrame:
    """links (src, dst) to (id, component) for all ids that have a link to another; component is the least id reachable.

    Each round gives every id the least label around it and then its label's label, so a chain of n ids takes about log n rounds.
    Links whose ends have one label already are spent; the rest go on between labels, so they dwindle. Hubs do no harm: minima combine
    before the shuffle, and their joins may be split. Every round ends in stored tables, of which the labels are put together at last, and
    nothing is collected."""
    edges = store(links.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "links")
    n = edges.count()
    labels = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct().withColumn("label", F.col("id"))
    while n:
        both = edges.union(edges.select("dst", "src"))  # between labels: src and dst are labels themselves
        least = both.groupBy("src").agg(F.min("dst").alias("low")).select(F.col("src").alias("old"), F.least("src", "low").alias("new"))
        # Labels that point to labels that moved too: follow them once more, so chains halve.
        hop = least.select(F.col("old").alias("new"), F.col("new").alias("far"))
        moved = least.join(hop, "new", "left").select("old", F.coalesce("far", "new").alias("new")).where("old <> new")
        moved = store(moved, "moved", 2 * n)
        labels = labels.join(moved, labels["label"] == moved["old"], "left").select("id", F.coalesce("new", "label").alias("label"))
        a, b = moved.select(F.col("old").alias("src"), F.col("new").alias("s")), moved.select(F.col("old").alias("dst"), F.col("new").alias("d"))
        again = edges.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("s", "src").alias("x"), F.coalesce("d", "dst").alias("y"))
        edges = store(again.where("x <> y").select(F.least("x", "y").alias("src"), F.greatest("x", "y").alias("dst")).distinct(), "links", n)
        n = edges.count()
    return store(labels.select("id", F.col("label").alias("component")), "labels")
