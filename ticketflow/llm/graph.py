"""Connected components of link tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketflow.llm.text import cut, join_hint


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(a, b) links -> node, component: the smallest node that can be reached; nodes without a link have no row.

    Each round takes the smallest label among the neighbours and then the label of the label, so
    that long chains fold up in a logarithmic number of rounds. A hot node's neighbours are
    reduced by partial aggregation before the shuffle.
    """
    pairs = links.select("a", "b").filter("a <> b")
    both = cut(pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = cut(both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("node"), F.least("a", "least").alias("component")))
    hint = join_hint(labels)
    for _ in range(rounds):
        near = both.join(labels.hint(hint), F.col("b") == F.col("node")).groupBy("a").agg(F.min("component").alias("least"))
        stepped = labels.join(near.hint(hint), F.col("node") == F.col("a")).select("node", F.col("component").alias("was"), F.least("component", "least").alias("component"))
        up = stepped.select(F.col("node").alias("via"), F.col("component").alias("up"))
        jumped = stepped.join(up.hint(hint), F.col("component") == F.col("via"), "left").select("node", "was", F.least("component", "up").alias("component"))
        new = cut(jumped)
        labels = new.select("node", "component")
        if new.filter("was <> component").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {rounds} rounds")
