"""Paired statistics: bootstrap intervals, exact McNemar, sign flips, Holm, a mixed-effects logistic fit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ..functions.text import portable_hash
from ..sources.shared import cut
from . import draws
from .ordering import numbered

SEED, RESAMPLES = 20260729, 10_000


#: Values that the driver and every executor get, so that draws meet them where they are made; more are joined.
MOST_SENT = 4_000_000
IDS_A_TASK = 20_000  # of sign flips


def _sent_means(values: DataFrame, by: list[str], sizes: list[int], resamples: int, seed: int) -> DataFrame:
    """__g, b and m, the mean of resample ``b`` of group ``__g`` (groups with ``sizes`` values, in order of ``by``).

    A draw's hash is the same for all groups, so it is made once. The driver gets the values, sorted,
    and the executors get them from it.
    """
    column = values.orderBy(*by, "id").select(F.col("v").cast("double").alias("v")).toArrow()["v"]
    known = column.is_valid().to_numpy()
    points, ends = np.where(known, column.fill_null(0.0).to_numpy(), 0.0), np.cumsum(sizes)
    points = [points[e - n : e] for n, e in zip(sizes, ends, strict=True)]
    known = None if known.all() else [known[e - n : e] for n, e in zip(sizes, ends, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, end in batch.select(["start", "end"]).to_pandas().itertuples(index=False):
                sums = np.zeros((len(points), end - start))
                counts = np.zeros_like(sums)
                for low, high, digits in draws.numbers(0, max(sizes, default=0)):
                    tails = np.concatenate([np.full((high - low, 1), 45, np.uint8), digits], axis=1)
                    for i, j, heads in draws.heads(seed, start, end, high - low):
                        hashed, places = draws.hashes(heads, tails), {}
                        for g, n in enumerate(sizes):
                            if n > low:
                                if n not in places:  # the quotient by a number is quicker than the rest
                                    own = hashed[:, : n - low]
                                    places = {n: own - own // np.uint32(n) * np.uint32(n)}
                                sums[g, i - start : j - start] += points[g][places[n]].sum(axis=1)
                                counts[g, i - start : j - start] += places[n].shape[1] if known is None else known[g][places[n]].sum(axis=1)
                for g in range(len(points)):
                    some = counts[g] > 0
                    m = pa.array(np.divide(sums[g], counts[g], out=np.zeros(end - start), where=some), mask=~some)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(end - start, g, np.int32)), pa.array(np.arange(start, end)), m], names=["__g", "b", "m"])

    spark = values.sparkSession
    tasks = spark.sparkContext.defaultParallelism * 2
    ranges = spark.range(0, tasks, 1, tasks).select((F.col("id") * resamples / tasks).cast("long").alias("start"), ((F.col("id") + 1) * resamples / tasks).cast("long").alias("end"))
    return ranges.where("start < end").mapInArrow(run, "__g int, b long, m double")


def _joined_means(values: DataFrame, by: list[str], groups: DataFrame, resamples: int, seed: int) -> DataFrame:
    """As ``_sent_means``, of any number of values: draws are shuffled to the values' places. ``groups`` has __g and n."""
    same = [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]
    named = groups.select("__g", *[F.col(c).alias(f"__by_{c}") for c in by])
    points = numbered(values.select(*by, "id", "v"), ["id"], "i", by)
    points = (points.join(F.broadcast(named), same) if by else points.crossJoin(F.broadcast(named))).select("__g", F.col("i").cast("int").alias("i"), "v")
    spark = values.sparkSession
    drawn = spark.range(0, resamples, 1, spark.sparkContext.defaultParallelism * 2).select(F.col("id").alias("b"))
    drawn = drawn.crossJoin(F.broadcast(groups.select("__g", "n")))  # a row per group
    drawn = drawn.withColumn("j", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    drawn = drawn.select("__g", "b", F.pmod(portable_hash(F.lit(seed), F.col("b"), F.col("j")), F.col("n")).cast("int").alias("i"))
    return drawn.join(points, ["__g", "i"]).groupBy("__g", "b").agg(F.avg("v").alias("m"))


def bootstrap(values: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, by: list[str] | None = None) -> DataFrame:
    """n, mean, lo and hi of a column ``v`` per group: resampled means at places int(.025 B) and int(.975 B), from 0.

    A resample's j-th draw is a portable hash of (seed, resample, j), n * ``resamples`` of them by
    definition. They are made by resample, once for all groups, and summed there. Null values are in no mean.
    """
    by = by or []
    base = values.groupBy(*by).agg(F.count("*").alias("n"), F.avg("v").alias("mean"))
    base = base.orderBy(*by) if by else base
    found = [r for r in base.collect() if r["n"]]  # a row per group
    groups = values.sparkSession.createDataFrame([(g, *r) for g, r in enumerate(found)], StructType([StructField("__g", IntegerType()), *base.schema.fields]))
    sizes = [r["n"] for r in found]
    means = _sent_means(values, by, sizes, resamples, seed) if sum(sizes) <= MOST_SENT else _joined_means(values, by, groups, resamples, seed)
    order = Window.partitionBy("__g").orderBy(F.round("m", 9).asc_nulls_last(), "b")  # as many rows as resamples
    places = means.withColumn("r", F.row_number().over(order) - 1)
    at = lambda q: F.max(F.when(F.col("r") == int(q * resamples), F.col("m")))
    ends = places.groupBy("__g").agg(at(0.025).alias("lo"), at(0.975).alias("hi"))
    if not found and not by:
        return base.crossJoin(ends.select("lo", "hi").unionByName(ends.sparkSession.createDataFrame([(None, None)], "lo double, hi double")))  # no values: one row
    return groups.join(ends, "__g", "left").drop("__g")


def binomial_two_sided(wins: Column, n: Column) -> Column:
    """min(1, 2 P(Binomial(n, 1/2) <= min(wins, n - wins))), summed from logarithms of its terms."""
    k = F.least(wins, n - wins)
    start = F.struct((-n * F.log(F.lit(2.0))).alias("t"), F.lit(0.0).alias("s"))
    step = lambda a, i: F.struct((a["t"] + F.log((n - i) / (i + 1.0))).alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))
    tail = F.aggregate(F.sequence(F.lit(0).cast("long"), F.greatest(k, F.lit(0).cast("long"))), start, lambda a, i: F.when(i < n, step(a, i)).otherwise(F.struct(a["t"].alias("t"), (a["s"] + F.exp(a["t"])).alias("s"))), lambda a: a["s"])
    return F.when(n == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), 2 * tail))


def mcnemar(pairs: DataFrame, a: str = "a", b: str = "b", by: list[str] | None = None) -> DataFrame:
    """a_wins, b_wins, exact p and the paired odds ratio: infinite without b_wins, null without either."""
    wins = pairs.groupBy(*(by or [])).agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).alias("a_wins"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).alias("b_wins"))
    odds = F.when(F.col("b_wins") > 0, F.col("a_wins") / F.col("b_wins")).when(F.col("a_wins") > 0, F.lit(float("inf")))
    return wins.withColumns({"p": binomial_two_sided(F.col("a_wins"), F.col("a_wins") + F.col("b_wins")), "odds_ratio": odds})


def _drawn_sums(rows: DataFrame, resamples: int, seed: int) -> DataFrame:
    """__g, b and s, partial sums of ``v`` of rows (id, __g, v), each with the sign that flip ``b`` draws for its id.

    Rows of an id are brought together, as the draw is the same for all groups.
    """
    owned = rows.groupBy("id").agg(F.collect_list("__g").alias("g"), F.collect_list("v").alias("v")).withColumn("id", F.concat(F.lit("-"), F.col("id").cast("string")))
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism * 2, -(-rows.count() // IDS_A_TASK))

    def add(table: pa.Table, sums: dict[int, np.ndarray]) -> None:
        ids, g, v = (table.column(c).combine_chunks() for c in ("id", "g", "v"))
        of = np.repeat(np.arange(len(ids)), g.value_lengths().to_numpy())
        g, v = g.flatten().to_numpy(), v.flatten().to_numpy()
        place = np.zeros(len(ids), np.int64)
        for places, tails in draws.same_lengths(ids.fill_null("")):  # a null adds nothing to the message
            place[:] = -1
            place[places] = np.arange(len(places))
            mine = place[of]
            groups = [(sums.setdefault(x, np.zeros(resamples)), mine[at := (mine >= 0) & (g == x)], v[at]) for x in np.unique(g[mine >= 0]).tolist()]
            for i, j, heads in draws.heads(seed, 0, resamples, len(places)):
                signs = (draws.hashes(heads, tails) & np.uint32(1)) * 2.0 - 1.0
                for total, at, value in groups:
                    total[i:j] += (signs[:, at] * value).sum(axis=1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            kept.append(batch)
            if sum(b.num_rows for b in kept) >= draws.AT_ONCE:
                add(pa.Table.from_batches(kept), sums)
                kept = []
        if sum(b.num_rows for b in kept):
            add(pa.Table.from_batches(kept), sums)
        for x, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(resamples, x, np.int32)), pa.array(np.arange(resamples)), pa.array(s)], names=["__g", "b", "s"])

    return owned.repartition(tasks).mapInArrow(run, "__g int, b long, s double")


def permutation(differences: DataFrame, resamples: int = RESAMPLES, seed: int = SEED, exact: int = 13, by: list[str] | None = None) -> DataFrame:
    """n, m (not zero), mean and p of a sign-flip test on a column ``v``, per group of ``by``.

    All 2^m flips where m is at most ``exact``, else ``resamples`` draws by a portable hash of seed,
    flip and id. p is the share of flips whose sum is at least as far from 0, and can be 0. A row
    meets every flip where it is; sums per flip are partial before they are shuffled.
    """
    by = by or []
    base = differences.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("v") != 0).alias("m"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"), F.coalesce(F.sum("v"), F.lit(0.0)).cast("double").alias("total"))
    base = base.orderBy(*by) if by else base
    found = base.collect()  # a row per group
    groups = differences.sparkSession.createDataFrame([(g, *r) for g, r in enumerate(found)], StructType([StructField("__g", IntegerType()), *base.schema.fields]))
    groups = groups.withColumn("flips", F.when(F.col("m") <= exact, F.expr("shiftleft(1L, cast(m as int))")).otherwise(F.lit(resamples).cast("long")))
    named = F.broadcast(groups.select("__g", "m", "flips", *[F.col(c).alias(f"__by_{c}") for c in by]))
    rows = differences.where("v <> 0")
    rows = rows.join(named, [F.col(c).eqNullSafe(F.col(f"__by_{c}")) for c in by]) if by else rows.crossJoin(named)
    rows = rows.select("id", "__g", "m", "flips", F.col("v").cast("double").alias("v"))
    nth = (F.row_number().over(Window.partitionBy("__g").orderBy("id")) - 1).cast("int")
    few = rows.where(F.col("m") <= exact).withColumn("i", nth).withColumn("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("flips") - 1)))  # ``exact`` rows a group
    sign = F.when(F.call_function("shiftright", F.col("b"), F.col("i")).bitwiseAND(F.lit(1)) == 1, 1.0).otherwise(-1.0)
    sums = few.select("__g", "b", (sign * F.col("v")).alias("s"))
    if any(r["m"] > exact for r in found):
        sums = sums.unionByName(_drawn_sums(rows.where(F.col("m") > exact).select("id", "__g", "v"), resamples, seed))
    sums = sums.groupBy("__g", "b").agg(F.sum("s").alias("s")).join(F.broadcast(groups.select("__g", "total", "flips")), "__g")
    far = sums.groupBy("__g").agg((F.count_if(F.abs("s") >= F.abs("total") - 1e-12) / F.max("flips")).alias("p"))
    return groups.join(far, "__g", "left").select(*by, "n", "m", "mean", F.when(F.col("m") == 0, F.lit(1.0)).otherwise(F.col("p")).alias("p"))


def sign_flips(differences: DataFrame) -> DataFrame:
    """As ``permutation``, over all 2^m flips for any m, of differences that are null, 0, 1 or -1.

    The flipped sum is 2 K - m with K ~ Binomial(m, 1/2), so nothing is enumerated. Other
    differences raise an error.
    """
    v = F.col("v")
    odd = F.when(~v.isin(0.0, 1.0, -1.0), F.raise_error(F.lit("a difference is not 0, 1 or -1"))).otherwise(v)
    base = differences.select(odd.cast("double").alias("v")).agg(F.count("*").alias("n"), F.count_if(v != 0).alias("m"), F.count_if(v > 0).alias("up"), F.coalesce(F.avg("v"), F.lit(0.0)).alias("mean"))
    return base.select("n", "m", "mean", binomial_two_sided(F.col("up"), F.col("m")).alias("p"))


def holm(tests: DataFrame, alpha: float = 0.05, p: str = "p", name: str = "name") -> DataFrame:
    """Step-down adjusted p values and rejections over one family of tests; ties keep the order of names."""
    order = Window.orderBy(p, name)
    nth = tests.withColumn("__r", F.row_number().over(order) - 1).withColumn("__m", F.count("*").over(Window.partitionBy()))
    raw = F.least(F.lit(1.0), (F.col("__m") - F.col("__r")) * F.col(p))
    out = nth.withColumn("p_adj", F.max(raw).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return out.withColumn("reject", F.col("p_adj") <= alpha).drop("__r", "__m")


def paired(outcomes: DataFrame, a: str, b: str) -> DataFrame:
    """id, a, b of items that both arms have, from long outcomes (arm, id, v)."""
    left = outcomes.where(F.col("arm") == a).select("id", F.col("v").alias("a"))
    return left.join(outcomes.where(F.col("arm") == b).select("id", F.col("v").alias("b")), "id")


def four_way(outcomes: DataFrame, arms: tuple[str, str, str, str]) -> DataFrame:
    """id and one column per arm, of items that all four have."""
    wide = outcomes.where(F.col("arm").isin(*arms)).groupBy("id").agg(*[F.max(F.when(F.col("arm") == x, F.col("v"))).alias(x) for x in arms])
    return wide.dropna(subset=list(arms))


def contrasts(outcomes: DataFrame, pairs: list[tuple[str, str, str]], alpha: float = 0.05, test: str = "mcnemar", resamples: int = RESAMPLES) -> DataFrame:
    """name, n, delta with its interval lo to hi, test and p, adjusted p and rejection for (name, arm a, arm b).

    Contrasts with an absent arm are skipped, and pairs without a value on one side don't count.
    ``test`` is mcnemar, for outcomes of 0 and 1, with wins and odds ratio, or permutation, for any
    outcome, with both null.
    """
    spark = outcomes.sparkSession
    family = spark.createDataFrame(pairs, "name string, arm_a string, arm_b string")
    a = outcomes.where("v is not null").select(F.col("arm").alias("arm_a"), "id", F.col("v").alias("a"))
    b = outcomes.where("v is not null").select(F.col("arm").alias("arm_b"), "id", F.col("v").alias("b"))
    rows = F.broadcast(family).join(a, "arm_a").join(b, ["arm_b", "id"])
    rows = cut(rows.select("name", "id", "a", "b", (F.col("a") - F.col("b")).alias("v")), "contrasts")
    size = bootstrap(rows.select("name", "id", "v"), resamples, by=["name"]).withColumnRenamed("mean", "delta").withColumn("test", F.lit(test))
    if test == "mcnemar":
        tested = mcnemar(rows, by=["name"])
    else:
        tested = permutation(rows, resamples, by=["name"]).select("name", F.lit(None).cast("long").alias("a_wins"), F.lit(None).cast("long").alias("b_wins"), "p", F.lit(None).cast("double").alias("odds_ratio"))
    return holm(size.join(tested, "name"), alpha)


def fit_mixed_logistic(y: np.ndarray, x: np.ndarray, item: np.ndarray, prior: float = 2.0, rounds: int = 60, times: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Fixed effects and the items' standard deviation: Newton steps on the joint posterior mode.

    Fixed effects have a normal prior of deviation ``prior``, item effects one of deviation sigma;
    sigma is re-estimated from the effects and their curvature. An item counts as ``times`` items
    with the same rows, whose effects are equal (1 without it).
    """
    n_items, p = int(item.max()) + 1, x.shape[1]
    times = np.ones(n_items) if times is None else times.astype(float)
    beta, u, sigma = np.zeros(p), np.zeros(n_items), 1.0
    for _ in range(rounds):
        mu = 1 / (1 + np.exp(-(x @ beta + u[item])))
        w = np.maximum(mu * (1 - mu), 1e-9)
        d = np.bincount(item, w, n_items) + 1 / sigma**2
        c = np.stack([np.bincount(item, w * x[:, j], n_items) for j in range(p)], axis=1)
        gb = x.T @ (times[item] * (y - mu)) - beta / prior**2
        gu = np.bincount(item, y - mu, n_items) - u / sigma**2
        h = (x * (times[item] * w)[:, None]).T @ x + np.eye(p) / prior**2 - (c * (times / d)[:, None]).T @ c
        step = np.linalg.solve(h, gb - c.T @ (times * gu / d))
        beta, u = beta + step, u + (gu - c @ step) / d
        sigma = float(np.sqrt(max(1e-4, np.average(u**2 + 1 / d, weights=times))))
        if np.abs(step).max() < 1e-9:
            break
    return beta, sigma


def mixed_effects(wide: DataFrame, arms: tuple[str, str, str, str]) -> DataFrame:
    """Terms of a 2x2 logistic model with item effects: base, extension and their interaction.

    ``arms`` are (neither, extension, base, both). The fit is one task: identical items are pooled
    beforehand, so what it reads is bounded by the 16 outcome patterns. Each weighs as many items
    as it has.
    """
    cells = wide.groupBy(*[F.col(a).cast("int").alias(f"y{i}") for i, a in enumerate(arms)]).agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        y = pdf[[f"y{i}" for i in range(4)]].to_numpy()
        design = np.array([[1, 0, 0, 0], [1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 1, 1]], float)
        beta, sigma = fit_mixed_logistic(y.ravel().astype(float), np.tile(design, (len(y), 1)), np.repeat(np.arange(len(y)), 4), times=pdf["n"].to_numpy())
        return pd.DataFrame({"term": ["intercept", "base", "extension", "interaction", "item_sd"], "estimate": [*beta, sigma]})

    return cells.withColumn("g", F.lit(0)).groupBy("g").applyInPandas(lambda pdf: fit(pdf.sort_values([f"y{i}" for i in range(4)])), "term string, estimate double")
