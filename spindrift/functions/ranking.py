"""Ranking metrics over arrays: ``ranked`` best first, ``gold`` the right ids. Null where gold is empty."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _or_null(gold: Column, value: Column) -> Column:
    return F.when(F.size(gold) > 0, value)


def top(ranked: Column, k: int) -> Column:
    return F.slice(ranked, 1, k)


def recall(ranked: Column, gold: Column, k: int) -> Column:
    """Share of gold entries, repeated ones counted each, within the first k."""
    return _or_null(gold, F.size(F.filter(gold, lambda g: F.array_contains(top(ranked, k), g))) / F.size(gold))


def hit(ranked: Column, gold: Column, k: int) -> Column:
    return _or_null(gold, F.arrays_overlap(top(ranked, k), gold).cast("double"))


def reciprocal_rank(ranked: Column, gold: Column) -> Column:
    """1 over the place of the first right id, 0 without one."""
    places = F.transform(ranked, lambda x, i: F.when(F.array_contains(gold, x), i + 1))
    return _or_null(gold, F.coalesce(F.lit(1.0) / F.array_min(places), F.lit(0.0)))


def average_precision(ranked: Column, gold: Column) -> Column:
    """Precision at each right id, summed and divided by the number of distinct gold ids."""
    total = F.aggregate(ranked, F.struct(F.lit(0).alias("i"), F.lit(0).alias("n"), F.lit(0.0).alias("s")), lambda a, x: F.struct((a["i"] + 1).alias("i"), (a["n"] + F.array_contains(gold, x).cast("int")).alias("n"), (a["s"] + F.when(F.array_contains(gold, x), (a["n"] + 1) / (a["i"] + 1)).otherwise(0.0)).alias("s")), lambda a: a["s"])
    return _or_null(gold, total / F.size(F.array_distinct(gold)))


def coverage(ranked: Column, wanted: Column, k: int) -> Column:
    """1 if the first k hold all wanted ids."""
    return _or_null(wanted, (F.size(F.array_except(wanted, top(ranked, k))) == 0).cast("double"))


def hallucination(cited: Column, known: Column, retrieved: Column) -> Column:
    """hard: cited but in no corpus; soft: in the corpus but not retrieved (none if that is unknown); and their rates."""
    none = F.array().cast("array<string>")
    hard = F.array_except(cited, known)
    soft = F.coalesce(F.array_except(F.array_intersect(cited, known), retrieved), none)
    rate = lambda x: F.when(F.size(cited) > 0, F.size(x) / F.size(cited)).otherwise(0.0)
    return F.struct(cited.alias("cited"), hard.alias("hard"), soft.alias("soft"), rate(hard).alias("hard_rate"), rate(soft).alias("soft_rate"))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
