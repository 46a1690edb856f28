"""Graphs as edge tables (src, dst): degrees, components, closures, cycles, ranks.

Loops run joins over edge tables and cut their lineage in the shared folder;
closures have a bounded depth, the others stop when nothing changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.staging import stage

DEEPEST = 5


def file_edges(calls: DataFrame, src: str, dst: str) -> DataFrame:
    """Edges between different nodes with the number of calls."""
    return calls.where(F.col(src) != F.col(dst)).groupBy(F.col(src).alias("src"), F.col(dst).alias("dst")).agg(F.count("*").alias("n"))


def degrees(edges: DataFrame) -> DataFrame:
    """fan_in and fan_out of every node."""
    e = edges.select("src", "dst").distinct()
    ends = e.select(F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o")).unionByName(
        e.select(F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"))
    )
    return ends.groupBy("node").agg(F.sum("i").alias("fan_in"), F.sum("o").alias("fan_out"))


def entrypoints(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that nothing points to."""
    return nodes.join(edges.select(F.col("dst").alias("node")), "node", "left_anti")


def components(edges: DataFrame, component: Column, other: Column) -> DataFrame:
    """Per component: edges inside, out and in, and cohesion (inside / (inside + out))."""
    e = edges.select(component.alias("a"), other.alias("b"))
    out = e.groupBy(F.col("a").alias("component")).agg(F.count_if(F.col("a") == F.col("b")).alias("internal"), F.count_if(F.col("a") != F.col("b")).alias("outgoing"))
    into = e.where("a <> b").groupBy(F.col("b").alias("component")).agg(F.count("*").alias("incoming"))
    both = out.join(into, "component", "full_outer").na.fill(0)
    total = F.col("internal") + F.col("outgoing")
    return both.withColumn("cohesion", F.when(total == 0, 0.0).otherwise(F.floor(F.col("internal") / total * 1000 + 0.5) / 1000))


def closure(edges: DataFrame, start: DataFrame, depth: int, backwards: bool = False) -> DataFrame:
    """Nodes reached from ``start`` (node) in at most ``depth`` steps (1 to 5), with the first step that reaches them."""
    depth = max(1, min(DEEPEST, depth))
    a, b = ("dst", "src") if backwards else ("src", "dst")
    e = edges.select(F.col(a).alias("node"), F.col(b).alias("next")).distinct()
    seen = start.select("node", F.lit(0).alias("level"))
    frontier = seen
    for level in range(1, depth + 1):
        step = frontier.join(e, "node").select(F.col("next").alias("node")).distinct()
        frontier = stage(step.join(seen, "node", "left_anti").withColumn("level", F.lit(level)), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen.where("level > 0")


def strong_components(edges: DataFrame) -> DataFrame:
    """node, component (its smallest node) of strongly connected components with more than one node.

    Forward-backward colouring: trimmed nodes leave; each round the smallest label spreads forward, and nodes that
    reach their colour's root backward inside the colour form a component.
    """
    e = stage(edges.select("src", "dst").where("src <> dst").distinct(), "scc")
    done = None
    while not e.isEmpty():
        # nodes without an edge in or out are components of one
        while True:
            kept = e.join(e.select(F.col("dst").alias("src")).distinct(), "src", "left_semi").join(
                e.select(F.col("src").alias("dst")).distinct(), "dst", "left_semi"
            ).select("src", "dst")
            kept = stage(kept, "scc")
            same = kept.count() == e.count()
            e = kept
            if same:
                break
        if e.isEmpty():
            break
        colour = e.select(F.col("src").alias("node")).union(e.select("dst")).distinct().withColumn("colour", F.col("node"))
        while True:
            spread = e.join(colour, e.src == colour.node).groupBy(F.col("dst").alias("node")).agg(F.min("colour").alias("got"))
            new = stage(colour.join(spread, "node", "left").select("node", F.least("colour", "got").alias("now"), F.col("colour").alias("was")), "scc")
            moved = not new.where("now < was").isEmpty()
            colour = new.select("node", F.col("now").alias("colour"))
            if not moved:
                break
        inside = (
            e.join(colour.select(F.col("node").alias("src"), F.col("colour").alias("c1")), "src")
            .join(colour.select(F.col("node").alias("dst"), F.col("colour").alias("c2")), "dst")
            .where("c1 = c2")
            .select("src", "dst", F.col("c1").alias("colour"))
        )
        inside = stage(inside, "scc")
        reached = stage(inside.select(F.col("colour").alias("node"), "colour").distinct(), "scc")
        frontier = reached
        while True:
            back = inside.join(frontier.select(F.col("node").alias("dst"), "colour"), ["dst", "colour"]).select(F.col("src").alias("node"), "colour").distinct()
            frontier = stage(back.join(reached, ["node", "colour"], "left_anti"), "scc")
            if frontier.isEmpty():
                break
            reached = stage(reached.unionByName(frontier), "scc")
        done = reached if done is None else done.unionByName(reached)
        gone = reached.select("node")
        e = stage(
            e.join(gone.withColumnRenamed("node", "src"), "src", "left_anti").join(gone.withColumnRenamed("node", "dst"), "dst", "left_anti").select("src", "dst"), "scc"
        )
    if done is None:
        return edges.sparkSession.createDataFrame([], edges.select(F.col("src").alias("node"), F.col("src").alias("component")).schema)
    sized = done.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
    return done.join(sized, "colour").select("node", F.col("colour").alias("component"))


def cycle_edges(edges: DataFrame) -> DataFrame:
    """The edges inside strongly connected components."""
    c = strong_components(edges)
    return (
        edges.join(c.select(F.col("node").alias("src"), F.col("component").alias("c")), "src")
        .join(c.select(F.col("node").alias("dst"), F.col("component").alias("d")), "dst")
        .where("c = d and src <> dst")
        .select("src", "dst")
    )


def layer_violations(edges: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges from a layer to one it may not use: layers (node, layer), rules (layer, forbidden)."""
    return (
        edges.join(layers.select(F.col("node").alias("src"), "layer"), "src")
        .join(layers.select(F.col("node").alias("dst"), F.col("layer").alias("forbidden")), "dst")
        .join(rules, ["layer", "forbidden"], "left_semi")
    )


def personal_rank(edges: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 30, every: int = 5) -> DataFrame:
    """Personalised rank over undirected edges, a fixed number of rounds, divided by the largest."""
    pairs = edges.select("src", "dst").where("src <> dst")
    both = stage(pairs.union(pairs.select("dst", "src")).distinct(), "rank")
    nodes = both.select(F.col("src").alias("node")).distinct()
    degree = both.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("deg"))
    n_seeds = seeds.select("node").distinct().join(nodes, "node", "left_semi").count() or 1
    start = F.when(F.col("seed"), 1.0 / n_seeds).otherwise(0.0)
    base = stage(
        nodes.join(seeds.select("node").distinct().withColumn("seed", F.lit(True)), "node", "left").join(degree, "node").select("node", "deg", start.alias("home")), "rank"
    )
    rank = base.select("node", F.coalesce("home", F.lit(0.0)).alias("rank"))
    for i in range(rounds):
        give = base.join(rank, "node").select("node", (F.col("rank") / F.col("deg")).alias("give"))
        got = both.join(give, both.src == give.node).groupBy(F.col("dst").alias("node")).agg(F.sum("give").alias("got"))
        rank = base.join(got, "node", "left").select(
            "node", (F.coalesce("home", F.lit(0.0)) * (1 - damping) + damping * F.coalesce("got", F.lit(0.0))).alias("rank")
        )
        if (i + 1) % every == 0:
            rank = stage(rank, "rank")
    top = rank.agg(F.max("rank").alias("top"))
    return rank.join(F.broadcast(top)).select("node", F.when(F.col("top") > 0, F.col("rank") / F.col("top")).otherwise(0.0).alias("rank"))
