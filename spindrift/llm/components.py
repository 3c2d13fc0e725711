"""Connected components of a link table, without gathering links or components anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, discard, scope


def components(links: DataFrame, outer: int = 0) -> DataFrame:
    """``node`` and ``component``, its smallest reachable node, for every node in ``links`` (a, b: long).

    Alternates the large-star and small-star steps of Kiveris et al., "Connected Components in
    MapReduce and Beyond" (2014), until nothing changes. Each round is written to the shared folder.
    Least neighbours are sums over keys with a partial step, and joins bring one row per node to
    the links; they are written before, as a join straight above an aggregation on its key can't be
    split, and so a node with very many links is split like any skewed join key. Links with a
    null end are left out; a link of a node to itself makes it a component of its own; repeated
    links count once, and no links give no nodes.

    The result is a table of the open scope, or of one around it as ``outer`` says for ``cut``.
    """
    with scope():
        both = links.select(F.col("a").cast("long"), F.col("b").cast("long")).where("a is not null and b is not null")
        both = cut(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
        edges = both.where("u <> v")
        state = _state(edges)
        while state[0]:
            ends = edges.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(edges.select(F.col("v").alias("x"), F.col("u").alias("y")))
            least = cut(ends.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("m")), "least")
            large = edges.join(least, "v").select("u", F.col("m").alias("v")).distinct()
            large, used = cut(large, "large-star"), least
            least = cut(large.groupBy("u").agg(F.min("v").alias("m")), "least")
            small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("u").alias("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").where("u <> v").distinct()
            old, edges = edges, cut(small, "small-star")
            discard(large, used, least, *([old] if hasattr(old, "shared_path") else []))
            before, state = state, _state(edges)
            if before == state:
                break
        roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
        linked = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
        alone = both.where("u = v").select(F.col("u").alias("node")).distinct().join(linked, "node", "left_anti")
        return cut(linked.unionByName(alone.select("node", F.col("node").alias("component"))), "components", outer=1 + outer)


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]
