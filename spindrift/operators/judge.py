"""Checks on answers: contexts, citations, refusals, verdicts, audits and agreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ranking as m
from ..functions.text import NO_CONTEXT, REFUSALS, contains_any, portable_hash
from ..sources.shared import cut
from .ordering import summed_before


def contexts(ranked: DataFrame, docs: DataFrame, k: int = 5, empty: str = NO_CONTEXT, queries: DataFrame | None = None) -> DataFrame:
    """query_id, context: the texts of the first k known items in rank order, a blank line between them.

    With ``queries``, those without any known item have ``empty``.
    """
    rows = ranked.where(F.col("rank") <= k).join(docs.select("item_id", "text"), "item_id")
    parts = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n")
    made = rows.groupBy("query_id").agg(parts.alias("context"))
    return made if queries is None else queries.select("query_id").join(made, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(empty)))


def context_ids(arm: Column, gold: Column, supporting: Column, ranked: Column, k: int) -> Column:
    """What an arm's answer is based on: nothing (C0), gold and supporting (C1), or its first k."""
    return F.when(arm == "C0", F.array().cast("array<string>")).when(arm == "C1", F.array_union(gold, supporting)).otherwise(F.slice(ranked, 1, k))


def prompt(question: Column, context: Column) -> Column:
    return F.concat(F.lit("[Context]\n"), context, F.lit("\n\n[Question]\n"), question)


def is_refusal(answer: Column, cues: list[str] | None = None) -> Column:
    return contains_any(answer, REFUSALS if cues is None else cues)


def citation_flags(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """key, cited, hard, soft and their rates of rows (key, cited, retrieved), each key in one row.

    ``known`` holds the ids (``id``) of the whole corpus, in any number: cited ids are rows that
    are joined to them, and gathered again by key.
    """
    cites = rows.select(key, F.explode("cited").alias("id"))
    there = cites.join(known.select("id").distinct(), "id").groupBy(key).agg(F.collect_list("id").alias("__k"))
    judged = rows.join(there, key, "left")
    h = m.hallucination(F.col("cited"), F.coalesce("__k", F.array().cast("array<string>")), F.col("retrieved"))
    return judged.select(key, h.alias("h")).select(key, "h.*")


def confusion(rows: DataFrame, should: Column, did: Column, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn with precision, recall and f1; each is null where it is undefined, f1 also without hits."""
    n = lambda c, name: F.count_if(c).alias(name)
    counts = rows.groupBy(*(by or [])).agg(n(should & did, "tp"), n(~should & did, "fp"), n(should & ~did, "fn"), n(~should & ~did, "tn"))
    ratio = lambda a, b: F.when(F.col(a) + F.col(b) > 0, F.col("tp") / (F.col(a) + F.col(b)))
    rated = counts.withColumns({"precision": ratio("tp", "fp"), "recall": ratio("tp", "fn")})
    return rated.withColumn("f1", F.when(F.col("precision") + F.col("recall") > 0, 2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def audit_sample(rows: DataFrame, ident: str, by: list[str], fraction: float = 0.2, seed: int = 20260729) -> DataFrame:
    """Of each group the share ``fraction``, rounded half to even, one at least, by a portable hash."""
    h = portable_hash(F.lit(seed), F.col(ident))
    group = Window.partitionBy(*by)
    chosen = rows.withColumn("nth", F.row_number().over(group.orderBy(h, F.col(ident)))).withColumn("size", F.count("*").over(group))
    return chosen.where(F.col("nth") <= F.greatest(F.lit(1), F.bround(F.col("size") * F.lit(float(fraction)), 0).cast("long"))).drop("nth", "size")


def kappa(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n and Cohen's kappa of two labellings; 1 where chance agreement is certain, null without rows."""
    cells = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(F.col(a).cast("string").alias("x"), F.col(b).cast("string").alias("y")).agg(F.count("*").alias("c"))
    sides = cells.select(F.col("x").alias("v"), F.col("c").alias("l"), F.lit(0).cast("long").alias("r")).unionByName(cells.select(F.col("y").alias("v"), F.lit(0).cast("long").alias("l"), F.col("c").alias("r")))
    chance = sides.groupBy("v").agg(F.sum("l").alias("l"), F.sum("r").alias("r")).agg(F.sum(F.col("l").cast("double") * F.col("r")).alias("e"))
    seen = cells.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("x") == F.col("y"), F.col("c"))), F.lit(0)).alias("same"))
    both = seen.crossJoin(chance)  # one row each
    po, pe = F.try_divide(F.col("same"), F.col("n")), F.try_divide("e", F.col("n").cast("double") * F.col("n"))
    return both.select("n", F.when(F.col("n") == 0, None).when(pe == 1, F.lit(1.0)).otherwise(F.try_divide(po - pe, 1 - pe)).alias("kappa"))


def average_ranks(cells: DataFrame, v: str, n: str = "c") -> DataFrame:
    """v and rank: of each value, whose rows ``n`` counts, the 1-based rank, the mean over ties."""
    values = cells.groupBy(v).agg(F.sum(n).alias("__n"))
    return summed_before(values, [v], F.col("__n"), "__b").select(v, (F.col("__b") + (F.col("__n") + 1) / 2.0).alias("rank"))


def spearman(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """n and Spearman's rho: Pearson's correlation of average ranks, null where one side is constant.

    Equal pairs are counted first, and ranks are sums over distinct values.
    """
    full = pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull())
    cells = cut(full.groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("c")), "cells")
    ranks = cells.join(average_ranks(cells, "a").withColumnRenamed("rank", "x"), "a").join(average_ranks(cells, "b").withColumnRenamed("rank", "y"), "b")
    c = lambda e: F.sum(F.col("c") * e)
    x, y = F.col("x"), F.col("y")
    s = ranks.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), c(x).alias("sx"), c(y).alias("sy"), c(x * x).alias("xx"), c(y * y).alias("yy"), c(x * y).alias("xy"))
    n = F.col("n")
    vx, vy = n * F.col("xx") - F.col("sx") * F.col("sx"), n * F.col("yy") - F.col("sy") * F.col("sy")
    return s.select("n", F.when((vx > 0) & (vy > 0), (n * F.col("xy") - F.col("sx") * F.col("sy")) / F.sqrt(vx * vy)).alias("rho"))
