"""Reachability in lineage graphs with cycles: strong components first, then the acyclic rest."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from recordloom.operators.joins import distinct_keys
from recordloom.session import scratch_path, stage


def _staged(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """``df``, written down, and its number of rows, told by the write."""
    seen = Observation()
    written = stage(df.observe(seen, F.count(F.lit(1)).alias("n")), name)
    return written, seen.get["n"]


def _without_ends(edges: DataFrame, n: int) -> tuple[DataFrame, int]:
    """Edges ``a, b`` that may lie on a cycle: without those from a node that nothing leads to, or to one that leads nowhere.

    Taken off layer by layer; each layer reads the edges that are left. An acyclic graph vanishes.
    """
    while n:
        before = n
        ins, outs = edges.select(F.col("b").alias("a")), edges.select(F.col("a").alias("b"))
        left = edges.join(distinct_keys(ins, ["a"]), "a", "left_semi").join(distinct_keys(outs, ["b"]), "b", "left_semi")
        edges, n = _staged(left.select("a", "b"), "inner-edges")
        if n == before:
            break
    return edges, n


def _largest_reaching(edges: DataFrame) -> DataFrame:
    """``node, color``: the largest node that reaches each node. Each turn sends the colors that changed along the edges."""
    nodes = edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()
    colors, n = _staged(nodes.select("node", F.col("node").alias("color"), F.lit(True).alias("changed")), "colors")
    while n:
        sent = colors.where("changed").join(edges, F.col("node") == F.col("a")).groupBy("b").agg(F.max("color").alias("sent"))
        after = colors.join(sent, F.col("node") == F.col("b"), "left")
        larger = F.coalesce(F.col("sent") > F.col("color"), F.lit(False))
        seen = Observation()
        after = after.select("node", F.greatest("color", "sent").alias("color"), larger.alias("changed"))
        colors = stage(after.observe(seen, F.count_if("changed").alias("n")), "colors")
        n = seen.get["n"]
    return colors.select("node", "color")


def _levels(first: DataFrame, step, name: str, again: bool) -> DataFrame:
    """All rows that ``step`` leads to from ``first``, written level by level; a step gets the last level.

    With ``again`` a row that an earlier level holds is not followed a second time, as cycles need it.
    """
    spark, path, depth, level = first.sparkSession, scratch_path(first.sparkSession, name), 0, first.distinct()
    schema = first.schema
    while True:
        seen = Observation()
        level.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/level={depth}")
        if not seen.get["n"]:
            return spark.read.schema(schema).option("basePath", path).parquet(f"{path}/level=*").select(*schema.names)
        last = spark.read.schema(schema).parquet(f"{path}/level={depth}")
        level = step(last).select(*schema.names).distinct()
        if again:
            known = spark.read.schema(schema).option("basePath", path).parquet(f"{path}/level=*").select(*schema.names)
            level = level.join(known.hint("merge"), schema.names, "left_anti")
        depth += 1


def strong_components(edges: DataFrame) -> DataFrame:
    """``node, component`` of nodes that lie on a cycle of ``edges`` (``a, b``); others are components of their own.

    ``component`` is the component's largest node. Nodes from which nothing comes back are taken off first. Then every
    node takes the largest node that reaches it as its color, and what of its color leads back to
    that node is its component. Edges between colors lie on no cycle; the rest goes on until no edge is left.
    """
    edges, n = _staged(edges.select("a", "b").dropna().where("a <> b").distinct(), "edges")
    found = []
    edges, n = _without_ends(edges, n)
    while n:
        colors = _largest_reaching(edges)
        left, right = (colors.toDF(end, f"color_{end}") for end in ("a", "b"))
        same = stage(edges.join(left, "a").join(right, "b").where("color_a = color_b").select("a", "b", F.col("color_a").alias("color")), "one-color")
        roots = colors.where("node = color")
        back = lambda level, same=same: level.join(same, (F.col("node") == F.col("b")) & (level["color"] == same["color"])).select(F.col("a").alias("node"), level["color"])
        members = _levels(roots, back, "members", again=True)
        found.append(members)
        gone = stage(members.select("node"), "found")
        rest = same.join(gone.toDF("a"), "a", "left_anti").join(gone.toDF("b"), "b", "left_anti").select("a", "b")
        edges, n = _without_ends(*_staged(rest, "edges"))
    if not found:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    both = reduce(DataFrame.unionByName, found).select("node", F.col("color").alias("component"))
    sizes = both.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    return stage(both.join(sizes, "component").select("node", "component"), "components")


def reachable(edges: DataFrame, starts: DataFrame, direction: str = "downstream") -> DataFrame:
    """``(start_id, dataset_id)``: the other datasets that each start reaches, whatever cycles there are.

    Nodes of a strong component reach the same, so each counts as one node. The rest is acyclic: a level of
    pairs leads to the next one and needs no look at earlier levels, since nothing comes back for ever.
    Repeated edges and loops count once, edges without one end not at all. A start without edges reaches nothing.
    """
    source, target = ("upstream", "downstream") if direction == "downstream" else ("downstream", "upstream")
    pairs = stage(edges.select(F.col(f"{source}_dataset_id").alias("a"), F.col(f"{target}_dataset_id").alias("b")).dropna().distinct(), "pairs")
    members = strong_components(pairs)
    named = pairs.join(members.toDF("a", "from"), "a", "left").join(members.toDF("b", "to"), "b", "left")
    acyclic = stage(named.select(F.coalesce("from", "a").alias("node"), F.coalesce("to", "b").alias("next")).where("node <> next").distinct(), "acyclic")
    starts = starts.select(F.col("dataset_id").alias("start_id")).dropna().distinct()
    first = starts.join(members.toDF("start_id", "component"), "start_id", "left").select("start_id", F.coalesce("component", "start_id").alias("node"))
    # a broadcast a level would send the driver all pairs in the end
    follow = lambda level: level.join(acyclic.hint("merge"), "node").select("start_id", F.col("next").alias("node"))
    found = _levels(first, follow, "reached", again=False).distinct()
    whole = found.join(members.toDF("dataset_id", "node"), "node", "left")
    return whole.select("start_id", F.coalesce("dataset_id", "node").alias("dataset_id")).where("start_id <> dataset_id")
