"""Typed graphs from sections: nodes, containment, citations, tags and rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def structural_nodes(rows: DataFrame, levels: list[str], pos: str, qualified: bool = False) -> DataFrame:
    """One node per (level, number); the first heading by position wins.

    Numbers are not qualified by their parents, so equal numbers of two parents share a node, unless
    ``qualified`` puts the parents' numbers before them.
    """
    out = None
    for i, level in enumerate(levels):
        key = F.concat_ws(".", *[F.col(x).cast("string") for x in (levels[: i + 1] if qualified else [level])])
        part = rows.where(F.col(level).isNotNull()).groupBy(key.alias("number")).agg(F.min_by(F.col(f"{level}_heading"), F.col(pos)).alias("heading"))
        part = part.select(F.concat(F.lit(f"{level.capitalize()}:"), "number").alias("id"), F.lit(level.capitalize()).alias("label"), "number", "heading")
        out = part if out is None else out.unionByName(part)
    return out


def contains_edges(rows: DataFrame, levels: list[str], leaf: Column, distinct: bool = False) -> DataFrame:
    """src, dst, type of the containment chain; a missing level is skipped.

    A container without one above it has no edge, a leaf without any hangs on ``root``. Container
    edges come once per row, as they are met, or once each with ``distinct``.
    """
    node = lambda c: F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c.capitalize()}:"), F.col(c).cast("string")))
    pairs = []
    for i, level in enumerate(levels):
        if i:
            above = F.coalesce(*[node(c) for c in reversed(levels[:i])])
            pairs.append(F.when(F.col(level).isNotNull() & above.isNotNull(), F.struct(above.alias("src"), node(level).alias("dst"))))
    pairs.append(F.struct(F.coalesce(*[node(c) for c in reversed(levels)], F.lit("root")).alias("src"), leaf.alias("dst")))
    edges = rows.select(F.explode(F.array_compact(F.array(*pairs))).alias("e")).select("e.src", "e.dst", F.lit("CONTAINS").alias("type"))
    return edges.distinct() if distinct else edges


def cites_edges(rows: DataFrame, ident: str, cited: Column, known: DataFrame) -> DataFrame:
    """src, dst, type, resolved: each distinct citation, and whether the cited id is one of ``known`` (id)."""
    pairs = rows.select(F.col(ident).cast("string").alias("src"), F.explode(cited).alias("dst")).where("src <> dst")
    ids = known.select(F.col("id").cast("string").alias("dst"), F.lit(True).alias("there")).distinct()
    return pairs.distinct().join(ids, "dst", "left").select("src", "dst", F.lit("CITES").alias("type"), F.coalesce("there", F.lit(False)).alias("resolved"))


def tag_edges(rows: DataFrame, ident: str, tags: Column, kind: str = "HAS_PENALTY") -> DataFrame:
    return rows.select(F.col(ident).cast("string").alias("src"), F.explode(tags).alias("dst"), F.lit(kind).alias("type"))


def rule_edges(rules: DataFrame, corpus: DataFrame, verified_only: bool = False) -> DataFrame:
    """src, dst, type, rule, scope, verified: every general section of a rule to every target of its scope.

    ``rules`` has label, general_sections, scope, verified, targets; ``corpus`` has id and ``scopes``,
    the scopes whose targets it belongs to. General sections and listed targets must exist; a section
    doesn't apply to itself; ``needs_review`` makes no edges.
    """
    some = rules.where("scope <> 'needs_review'")
    some = some.where("verified") if verified_only else some
    ids = corpus.select(F.col("id").alias("src"))
    general = some.select("label", "scope", "verified", "targets", F.explode("general_sections").alias("src")).join(ids, "src", "left_semi")
    members = corpus.select(F.explode("scopes").alias("scope"), F.col("id").alias("dst"))
    by_scope = general.where("scope <> 'specific'").select("src", "label", "scope", "verified").join(members, "scope")
    listed = general.where("scope = 'specific'").select("src", "label", "scope", "verified", F.explode("targets").alias("dst")).join(ids.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return by_scope.unionByName(listed).where("src <> dst").select("src", "dst", F.lit("APPLIES_TO").alias("type"), F.col("label").alias("rule"), "scope", "verified")


def rule_stats(rules: DataFrame, edges: DataFrame) -> DataFrame:
    """label, scope, verified, n; rules without edges have 0."""
    counts = edges.groupBy(F.col("rule").alias("label")).agg(F.count("*").alias("n"))
    return rules.select("label", "scope", "verified").join(counts, "label", "left").withColumn("n", F.coalesce("n", F.lit(0)).cast("long"))


def review_queue(rules: DataFrame) -> DataFrame:
    return rules.where("scope = 'needs_review'").select(F.explode("general_sections").alias("general_section_id"), F.col("label").alias("rule"), F.lit("").alias("applies_to_section_id"), F.coalesce("note", F.lit("")).alias("note"))


def bad_targets(rules: DataFrame, corpus: DataFrame) -> DataFrame:
    """rule, kind (general or target) and id of what a rule names but the corpus lacks."""
    ids = corpus.select("id").distinct()
    general = rules.where("scope <> 'needs_review'").select(F.col("label").alias("rule"), F.lit("general").alias("kind"), F.explode("general_sections").alias("id"))
    targets = rules.where("scope = 'specific'").select(F.col("label").alias("rule"), F.lit("target").alias("kind"), F.explode("targets").alias("id"))
    return general.unionByName(targets).join(ids, "id", "left_anti").select("rule", "kind", "id")


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst in both directions, each once."""
    return edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def degrees(adjacency: DataFrame) -> DataFrame:
    return adjacency.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


def edge_counts(edges: DataFrame) -> DataFrame:
    return edges.groupBy("type").agg(F.count("*").alias("n"))


def _quoted(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.replace(c.cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'"))


def cypher_nodes(nodes: DataFrame, label: str, ident: str, props: list[str]) -> DataFrame:
    """One MERGE statement per node; null properties are left out, quotes and backslashes escaped."""
    sets = F.concat_ws(", ", *[F.when(F.col(p).isNotNull(), F.concat(F.lit(f"n.{p} = "), _quoted(F.col(p)))) for p in props])
    head = F.concat(F.col(label), F.lit(" {id: "), _quoted(F.col(ident)), F.lit("})"))
    return nodes.select(F.concat(F.lit("MERGE (n:"), head, F.when(sets != "", F.concat(F.lit(" SET "), sets)).otherwise(""), F.lit(";")).alias("value"))


def cypher_edges(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat(F.lit("MATCH (a {id: "), _quoted(F.col("src")), F.lit("}), (b {id: "), _quoted(F.col("dst")), F.lit("}) MERGE (a)-[:"), F.col("type"), F.lit("]->(b);")).alias("value"))


def one_each(edges: DataFrame) -> DataFrame:
    """Parallel edges merged, with their number."""
    return edges.groupBy("src", "dst", "type").agg(F.count("*").alias("n"))


def capped_neighbours(adjacency: DataFrame, most: int = 20) -> DataFrame:
    order = Window.partitionBy("src").orderBy("dst")
    return adjacency.withColumn("nb", F.row_number().over(order)).where(F.col("nb") <= most)
