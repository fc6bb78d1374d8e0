"""Connected components of a table of links, by least labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_small, join_counted, materialize


def connected_components(links: DataFrame) -> DataFrame:
    """node, component (its least node) for every end of a link (a, b); no links, no rows.

    Each round takes the least label of all neighbours (combined before the shuffle), then the label of the label,
    and writes the labels to the shared folder. Where there are many links, a hub's links and a large component's
    nodes are salted in the joins. Null ends and links of a node with itself are left out; repeated links count once.
    """
    both = materialize(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "cc-links")
    few = is_small(both)
    first = both.groupBy("a").agg(F.min("b").alias("least"), F.count("*").alias("degree"))
    labels = materialize(first.select(F.col("a").alias("b"), F.least("a", "least").alias("component"), "degree"), "cc-labels")
    while True:
        met = both.join(labels, "b") if few else join_counted(both, labels, ["b"], "degree")
        seen = met.groupBy("a").agg(F.min("component").alias("least"))
        near = labels.join(seen, labels["b"] == seen["a"], "left").select("b", "degree", F.least("component", "least").alias("now"), F.col("component").alias("was"))
        up = labels.select(F.col("b").alias("now"), F.col("component").alias("top"))
        if few:
            after = near.join(up, "now", "left")
        else:
            near = materialize(near, "cc-near")
            after = join_counted(near, up.join(near.groupBy("now").agg(F.count("*").alias("times")), "now"), ["now"], "times", "left")
        after = materialize(after.select("b", F.least("now", "top").alias("component"), "degree", "was"), "cc-labels")
        labels = after.select("b", "component", "degree")
        if after.where("component <> was").isEmpty():
            return labels.select(F.col("b").alias("node"), "component")


def merged(parts: DataFrame, links: DataFrame) -> DataFrame:
    """parts (node, component) after links (a, b) of their nodes join components: only components are looked at, not nodes."""
    few, ends = is_small(links), links.select("a", "b")
    for c in ("a", "b"):
        side = parts.select(F.col("node").alias(c), F.col("component").alias(f"c_{c}"))
        times = links.groupBy(c).agg(F.count("*").alias("times"))
        ends = ends.join(side, c) if few else join_counted(ends, side.join(times, c), [c], "times").drop("times")
    pairs = materialize(ends.where("c_a <> c_b").select(F.col("c_a").alias("a"), F.col("c_b").alias("b")).distinct(), "cc-pairs")
    if pairs.isEmpty():
        return parts
    new = connected_components(pairs).select(F.col("node").alias("component"), F.col("component").alias("now"))
    if is_small(parts):
        out = parts.join(new, "component", "left")
    else:
        sizes = parts.groupBy("component").agg(F.count("*").alias("times"))
        out = join_counted(parts, new.join(sizes, "component"), ["component"], "times", "left")
    return materialize(out.select("node", F.coalesce("now", "component").alias("component")), "cc-parts")
