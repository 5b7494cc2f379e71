"""Connected components of a distributed graph, by contraction towards least nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import discard, materialize

#: Rounds in which any graph that a run can hold is contracted; each round removes all but local minima.
MOST_ROUNDS = 200


def components(edges: DataFrame, left: str = "a", right: str = "b", most_rounds: int = MOST_ROUNDS) -> DataFrame:
    """(node, component) for every node of an edge; component is the least node reachable. Nulls and loops are dropped.

    Each round every node moves to its least smaller neighbour, and on to where that one moved; edges are rewritten, and
    only those between different nodes stay, so a round's edges are few after the first. Rounds are tables in the shared
    folder, which go once the next round is there. Minima combine before the shuffle, so a hub costs no more than its
    edges; no edges give no rows. Edges left after most_rounds are an error, never a wrong answer.
    """
    a, b = F.col(left), F.col(right)
    real = edges.filter(a.isNotNull() & b.isNotNull() & (a != b))
    down = materialize(real.select(F.greatest(a, b).alias("high"), F.least(a, b).alias("low")).distinct(), "edges")
    labels = None
    rounds = 0
    while not down.isEmpty():
        if rounds == most_rounds:
            raise RuntimeError(f"components of the graph are not contracted after {most_rounds} rounds")
        rounds += 1
        to_least = down.groupBy("high").agg(F.min("low").alias("to"))
        beyond = to_least.select(F.col("high").alias("to"), F.col("to").alias("further"))
        moves = materialize(to_least.join(beyond, "to", "left").select(F.col("high").alias("node"), F.coalesce("further", "to").alias("to")), "moves")
        old_labels, old_down = labels, down
        if labels is None:
            nodes = down.select(F.col("high").alias("node")).union(down.select(F.col("low").alias("node"))).distinct()
            labels = nodes.select("node", F.col("node").alias("component"))
        now = moves.select(F.col("node").alias("component"), "to")
        labels = materialize(labels.join(now, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
        high, low = moves.select(F.col("node").alias("high"), F.col("to").alias("high_to")), moves.select(F.col("node").alias("low"), F.col("to").alias("low_to"))
        moved = down.join(high, "high").join(low, "low", "left").select("high_to", F.coalesce("low_to", "low").alias("low_to"))
        # where a node's goal has itself moved, the two stay connected
        chained = moves.select(F.col("to").alias("high_to")).join(moves.select(F.col("node").alias("high_to"), F.col("to").alias("low_to")), "high_to")
        both = moved.union(chained).filter("high_to != low_to")
        down = materialize(both.select(F.greatest("high_to", "low_to").alias("high"), F.least("high_to", "low_to").alias("low")).distinct(), "edges")
        discard(old_labels, old_down, moves)
    if labels is None:
        return down.select(F.col("high").alias("node"), F.col("low").alias("component"))
    discard(down)
    return labels
