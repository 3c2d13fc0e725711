"""Retrievers as plans over long rankings: (query_id, rank, item_id, score), ties broken by id."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import dot
from ..functions.text import word_tokens
from ..sources.shared import cut

POOL = int(os.environ.get("RAG_POOL", "50"))
#: Queries that are sent to every executor; more are dealt in blocks of this many.
QUERY_BLOCK = 10_000


def top_k(scored: DataFrame, k: int, score: str = "score", digits: int = 6) -> DataFrame:
    """The best k per query. Scores are compared rounded, so engines and partitions agree on ties."""
    order = Window.partitionBy("query_id").orderBy(F.round(score, digits).desc(), F.col("item_id"))
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def exploded(tokenized: DataFrame, *keep: str | Column) -> DataFrame:
    """A row per token of a column ``t``. An outer explode: for an inner one the optimizer adds a filter
    on the tokens' number, which splits every text a second time."""
    return tokenized.select(*keep, F.explode_outer("t").alias("term")).where("term is not null")


def term_frequencies(docs: DataFrame, tokens: Callable[[Column], Column] = word_tokens, only: DataFrame | None = None) -> DataFrame:
    """item_id, term, f. With ``only`` (a column ``term``), other terms are dropped before they are shuffled."""
    terms = exploded(docs.select("item_id", tokens(F.col("text")).alias("t")), "item_id")
    terms = terms.join(only, "term", "left_semi") if only is not None else terms
    return terms.groupBy("item_id", "term").agg(F.count("*").alias("f"))


def document_lengths(docs: DataFrame, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    return docs.select("item_id", F.size(tokens(F.col("text"))).cast("long").alias("dl"))


def inverse_frequencies(tf: DataFrame, n_docs: Column) -> Column:
    """ln(1 + (N - n + 0.5) / (n + 0.5)) for a column ``df``."""
    return F.log(1 + (n_docs - F.col("df") + 0.5) / (F.col("df") + 0.5))


def bm25(docs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, tokens: Callable[[Column], Column] = word_tokens) -> DataFrame:
    """query_id, item_id, score for every document that shares a term with the query.

    Only the queries' terms reach the shuffle; a term counts once per query. The average length
    includes documents without tokens. Texts are read twice: for the totals, and for the terms,
    which bring their document's length along.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("text")))).alias("term"))
    corpus = document_lengths(docs, tokens).agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(0.0)).alias("avgdl"))
    terms = exploded(docs.select("item_id", tokens(F.col("text")).alias("t")), "item_id", F.size("t").alias("dl"))
    tf = terms.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("item_id", "dl", "term").agg(F.count("*").alias("f"))
    # counted over f, so that this reads the same columns as the join below and shares its shuffle
    df = tf.groupBy("term").agg(F.count_if(F.col("f") > 0).alias("df"))
    idf = df.crossJoin(F.broadcast(corpus)).select("term", "avgdl", inverse_frequencies(tf, F.col("n_docs")).alias("idf"))  # one row of totals
    f = F.col("f")
    weight = F.col("idf") * f * (k1 + 1) / (f + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    weighted = tf.join(idf, "term").select("item_id", "term", weight.alias("w"))
    return wanted.join(weighted, "term").groupBy("query_id", "item_id").agg(F.sum("w").alias("score"))


def query_blocks(vectors: DataFrame) -> list[DataFrame]:
    """The stated query set in parts that are small enough for every executor."""
    n = max(1, -(-vectors.count() // QUERY_BLOCK))
    return [vectors] if n == 1 else [vectors.where(F.pmod(F.xxhash64("query_id"), F.lit(n)) == i) for i in range(n)]


def dense(items: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, item_id, score: inner products of every query (query_id, vector) with every item (item_id, vector)."""
    out = None
    for block in query_blocks(queries):
        part = items.join(F.broadcast(block.withColumnRenamed("vector", "q"))).select("query_id", "item_id", dot(F.col("q"), F.col("vector")).alias("score"))
        out = part if out is None else out.unionByName(part)
    return out


def ends_of(scored: DataFrame) -> DataFrame:
    """query_id, lo and span of the scores of each query; a span of 0 counts as 1."""
    ends = scored.groupBy("query_id").agg(F.min("score").alias("lo"), F.max("score").alias("hi"))
    return ends.select("query_id", "lo", F.coalesce(F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)), F.lit(1.0)).alias("span"))


def normalized(scored: DataFrame, name: str = "norm", ends: DataFrame | None = None) -> DataFrame:
    """Scores to 0..1 within their query; equal scores are all 0. One row per query goes to the scores."""
    ends = ends_of(scored) if ends is None else ends
    return scored.join(ends, "query_id").select("query_id", "item_id", ((F.col("score") - F.col("lo")) / F.col("span")).alias(name))


def fused_pool(sparse: DataFrame, items: DataFrame, queries: DataFrame, alpha: float = 0.5, pool: int = POOL) -> DataFrame:
    """The best ``pool`` by a mix of both rankings, each normalised over what it scored; what one lacks counts 0.

    ``sparse`` has scores of the items that match, ``items`` and ``queries`` have vectors. Every query
    meets every item, but such scores aren't shuffled: their ends are partial sums, and an item that
    doesn't match can only be in the pool if it is among the best by vectors alone, of which each
    partition gives its first. Items that match get their vectors' score where the two meet.
    """
    some = lambda c: F.coalesce(c, F.lit(0.0))
    ends = cut(ends_of(dense(items, queries)), "dense-ends")  # a row per query
    by_vector = normalized(dense(items, queries), "d", F.broadcast(ends))
    best = top_k(by_vector.withColumn("score", alpha * F.col("d")), pool).select("query_id", "item_id", "d")
    matched = normalized(sparse, "s")
    asked = queries.select("query_id", F.col("vector").alias("q")).join(F.broadcast(ends), "query_id")
    asked = F.broadcast(asked) if queries.count() <= QUERY_BLOCK else asked
    met = matched.join(items, "item_id", "left").join(asked, "query_id", "left")
    met = met.select("query_id", "item_id", "s", ((dot(F.col("q"), F.col("vector")) - F.col("lo")) / F.col("span")).alias("d"))
    mixed = met.select("query_id", "item_id", (alpha * some(F.col("d")) + (1 - alpha) * F.col("s")).alias("score"))
    first = top_k(mixed, pool).select("query_id", "item_id", "score")
    # of the best by vectors, those that match are scored above, and are here with too little
    rest = best.select("query_id", "item_id", (alpha * F.col("d")).alias("score"))
    both = first.unionByName(rest).groupBy("query_id", "item_id").agg(F.max("score").alias("score"))
    return top_k(both, pool)


def overlap_score(query_tokens: Column, option_tokens: Column) -> Column:
    """How many tokens of an option, repeats counted, the query has."""
    return F.size(F.filter(option_tokens, lambda t: F.array_contains(query_tokens, t)))


def scored_candidates(candidates: DataFrame, queries: DataFrame, docs: DataFrame, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """query_id, item_id, place (its rank so far) and score of distinct candidates, null where the id is unknown.

    The score is a model's of (query, document) text; without a model, the share of the query's terms
    that the document has, whose terms are found once however many queries want it.
    """
    place = F.min("rank" if "rank" in candidates.columns else F.lit(0)).alias("place")
    pairs = candidates.groupBy("query_id", "item_id").agg(place)
    q = queries.select("query_id", F.col("text").alias("q_text"))
    if score is not None:
        met = pairs.join(docs.select("item_id", F.coalesce("text", F.lit("")).alias("text")), "item_id", "left").join(q, "query_id")
        return met.select("query_id", "item_id", "place", F.when(F.col("text").isNotNull(), score(F.col("q_text"), F.col("text"))).alias("score"))
    some = docs.select("item_id", "text").join(pairs.select("item_id").distinct(), "item_id", "left_semi")
    terms = some.select("item_id", F.array_distinct(word_tokens(F.col("text"))).alias("t"))
    met = pairs.join(terms, "item_id", "left").join(q.select("query_id", F.array_distinct(word_tokens(F.col("q_text"))).alias("q")), "query_id")
    share = F.size(F.array_intersect("q", "t")) / F.greatest(F.size("q"), F.lit(1))
    return met.select("query_id", "item_id", "place", F.when(F.col("t").isNotNull(), share).alias("score"))


def ranked_candidates(scored: DataFrame, k: int) -> DataFrame:
    """The best k by score, ties by id descending. Unknown ids are dropped, but candidates of which
    none is known stay as they were ranked."""
    lost = F.col("score").isNull()
    order = Window.partitionBy("query_id").orderBy(lost, F.round("score", 6).desc(), F.when(lost, F.col("place")), F.col("item_id").desc())
    ranked = scored.withColumn("rank", F.row_number().over(order)).withColumn("__any", F.max(~lost).over(Window.partitionBy("query_id")))
    return ranked.where((F.col("rank") <= k) & (~lost | ~F.col("__any"))).select("query_id", "item_id", F.coalesce("score", F.lit(0.0)).alias("score"), "rank")


def rerank(candidates: DataFrame, queries: DataFrame, docs: DataFrame, k: int, score: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """Candidates (query_id, item_id, and rank if they have one) in the order of ``scored_candidates``."""
    return ranked_candidates(scored_candidates(candidates, queries, docs, score), k)


def expand(seeds: DataFrame, adjacency: DataFrame, most: int = 20) -> DataFrame:
    """query_id, item_id, rank: seeds in order, then each seed's first ``most`` neighbours; first place counts.

    ``adjacency`` has src and dst in both directions; neighbours come in id order.
    """
    nth = Window.partitionBy("src").orderBy("dst")
    near = adjacency.select("src", "dst").distinct().withColumn("nb", F.row_number().over(nth)).where(F.col("nb") <= most)
    hops = seeds.join(near, seeds["item_id"] == near["src"]).select("query_id", F.col("dst").alias("item_id"), F.lit(1).alias("tier"), F.col("rank").alias("a"), F.col("nb").alias("b"))
    both = seeds.select("query_id", "item_id", F.lit(0).alias("tier"), F.col("rank").alias("a"), F.lit(0).alias("b")).unionByName(hops)
    return ordered_union(both, ["tier", "a", "b"])


def ordered_union(rows: DataFrame, order: list[str], k: int | None = None) -> DataFrame:
    """Each item of a query once, at its first place by ``order``."""
    first = rows.groupBy("query_id", "item_id").agg(F.min(F.struct(*order)).alias("place"))
    out = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("place", "item_id"))).drop("place")
    return out.where(F.col("rank") <= k) if k else out


def reserved(primary: DataFrame, tail: DataFrame, k: int, reserve: int = 1) -> DataFrame:
    """The first k - reserve of ``primary``, then the best of ``tail`` that they lack, then ``primary`` again."""
    head = primary.where(F.col("rank") <= k - reserve)
    new = tail.join(head.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
    new = new.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= reserve)
    tiers = [x.select("query_id", "item_id", F.lit(i).alias("tier"), "rank") for i, x in enumerate((head, new, primary))]
    return ordered_union(tiers[0].unionByName(tiers[1]).unionByName(tiers[2]).withColumnRenamed("rank", "r"), ["tier", "r"], k)


def additive(pool: DataFrame, more: DataFrame) -> DataFrame:
    """Ordered union of two rankings, the first one first."""
    rows = pool.select("query_id", "item_id", F.lit(0).alias("tier"), F.col("rank").alias("r")).unionByName(more.select("query_id", "item_id", F.lit(1).alias("tier"), F.col("rank").alias("r")))
    return ordered_union(rows, ["tier", "r"])


def select_options(options: DataFrame, most: int) -> DataFrame:
    """Per (query_id, node): the ``most`` options of greatest overlap above 0, ties to the later one; the last option if none overlaps."""
    w = Window.partitionBy("query_id", "node").orderBy(F.col("overlap").desc(), F.col("pos").desc())
    ranked = options.withColumn("choice", F.row_number().over(w))
    return ranked.where((F.col("choice") <= most) & ((F.col("overlap") > 0) | (F.col("choice") == 1)))


def descend(tree: DataFrame, queries: DataFrame, k: int, width: int = 5, depth: int = 5, tokens: Callable[[Column], Column] = word_tokens, select: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Beam descent: from the root, every beam node gives its leaves as candidates and at most ``width``
    of its containers to the next beam; then the best k candidates.

    ``tree`` has node, parent (null for the root), pos (among siblings), is_leaf, display and item_id.
    Levels are joins on the parent, ``depth`` of them; nothing is collected. A level's beam, a few
    nodes per query, is kept in the shared folder for the two steps that start from it. ``select``
    may choose by other means than word overlap: it gets query_id, text, node, pos and display of
    the options and gives the chosen ones with their place, ``choice``.
    """
    select = select or select_options
    q = queries.select("query_id", "text", F.array_distinct(tokens(F.col("text"))).alias("q"))
    children = tree.where("parent is not null").select("node", "parent", "pos", "is_leaf", "item_id", "display", tokens(F.col("display")).alias("t"))
    root = tree.where("parent is null").select(F.col("node"))
    beam, found = q.select("query_id").crossJoin(F.broadcast(root)).select("query_id", "node", F.array(F.lit(0)).alias("path")), None
    for level in range(depth):
        here = beam.select("query_id", F.col("node").alias("parent"), "path").join(children, "parent").join(q, "query_id")
        here = here.select("query_id", "text", F.col("parent"), "node", "pos", "is_leaf", "item_id", "display", "path", overlap_score(F.col("q"), F.col("t")).alias("overlap"))
        leaves = here.where("is_leaf").select("query_id", "text", "item_id", "display", "path", "pos", "overlap")
        found = leaves if found is None else found.unionByName(leaves)
        if level == depth - 1:
            break
        chosen = select(here.where("not is_leaf").withColumnRenamed("node", "child").withColumnRenamed("parent", "node"), width)
        beam = cut(chosen.select("query_id", F.col("child").alias("node"), F.concat("path", F.array(-F.col("overlap"), -F.col("pos"))).alias("path")).dropDuplicates(["query_id", "node"]), "beam")
    # candidates stand in the order of the descent: by depth, then by the beam's order, then among siblings
    place = Window.partitionBy("query_id").orderBy(F.size("path"), "path", "pos")
    options = found.withColumn("pos", F.row_number().over(place)).withColumn("node", F.lit(0))
    picked = select(options, k)
    return picked.select("query_id", "item_id", F.col("overlap").cast("double").alias("score"), F.col("choice").alias("rank"))


#: The arms' ids by label, and older names of the same.
ARMS = {"keyword": "R0", "dense": "R1", "hybrid": "A1", "hybrid+kg": "A2", "pi": "A3", "pi+kg": "A4", "hybrid+pi+kg": "A4B", "hybrid+pi": "A5", "closed": "C0", "oracle": "C1"}


def arm_id(name: str) -> str:
    """An arm's id by label or id; an unknown name is left as it is."""
    return ARMS.get(name, name)


class Context:
    """What arms are made of: docs (item_id, text), queries (query_id, text), vectors, a tree and an
    adjacency; a score of (query, document) for reranking, a ``TreeNavigator`` and a tokenizer. The
    environment variable RAG_POOL sets the pool's size where it isn't given."""

    def __init__(self, docs: DataFrame, queries: DataFrame, item_vectors: DataFrame | None = None, query_vectors: DataFrame | None = None, tree: DataFrame | None = None, adjacency: DataFrame | None = None, pool: int = POOL, reserve: int = 1, width: int = 5, depth: int = 5, score: Callable[[Column, Column], Column] | None = None, navigator=None, tokens: Callable[[Column], Column] = word_tokens):
        self.navigator, self.tokens, self.depth = navigator, tokens, depth
        self.docs, self.queries, self.item_vectors, self.query_vectors = docs, queries, item_vectors, query_vectors
        self.tree, self.adjacency, self.pool, self.reserve, self.width, self.score = tree, adjacency, pool, reserve, width, score
        self._sparse, self._pool, self._picks = None, None, {}

    def sparse(self) -> DataFrame:
        """BM25 scores of all matches, kept likewise: the ranking, the pool and its ends read them."""
        if self._sparse is None:
            self._sparse = cut(bm25(self.docs, self.queries, tokens=self.tokens), "sparse")
        return self._sparse

    def hybrid_pool(self) -> DataFrame:
        """The fused pool; made once and kept in the shared folder, as several steps of an arm read it."""
        if self._pool is None:
            self._pool = cut(fused_pool(self.sparse(), self.item_vectors, self.query_vectors, pool=self.pool), "pool")
        return self._pool

    def tree_picks(self, k: int) -> DataFrame:
        """The descent's picks, kept likewise."""
        if k not in self._picks:
            walked = self.navigator.navigate(self.tree, self.queries, k) if self.navigator else descend(self.tree, self.queries, k, self.width, self.depth, self.tokens)
            self._picks[k] = cut(walked, "picks")
        return self._picks[k]

    def reranked(self, rows: DataFrame, k: int) -> DataFrame:
        return rerank(rows, self.queries, self.docs, k, self.score)


#: Retrievers of one's own by name: each makes a ranking of a context and k.
RETRIEVERS: dict[str, Callable[[Context, int], DataFrame]] = {}


def build_arm(name: str, ctx: Context, k: int = 5) -> DataFrame:
    """The ranking of an arm, as a plan: one of ``ARMS`` or of ``RETRIEVERS``. Generation-only and
    unknown names raise ValueError."""
    arm = arm_id(name)
    if arm in RETRIEVERS:
        return RETRIEVERS[arm](ctx, k)
    if arm == "R0":
        return top_k(ctx.sparse(), k)
    if arm == "R1":
        return top_k(dense(ctx.item_vectors, ctx.query_vectors), k)
    if arm == "A1":
        return ctx.reranked(ctx.hybrid_pool(), k)
    if arm == "A2":
        return ctx.reranked(expand(ctx.reranked(ctx.hybrid_pool(), ctx.pool), ctx.adjacency), k)
    if arm == "A3":
        return ctx.tree_picks(k)
    if arm == "A4":
        return ctx.reranked(expand(ctx.tree_picks(ctx.pool), ctx.adjacency), k)
    if arm in ("A5", "A4B"):
        seed = cut(additive(ctx.hybrid_pool(), ctx.tree_picks(ctx.pool)), "seed")
        if arm == "A5":
            return ctx.reranked(seed, k)
        # the expansion holds the seed; both are scored once and told apart afterwards
        scored = scored_candidates(expand(seed, ctx.adjacency), ctx.queries, ctx.docs, ctx.score)
        known = seed.select("query_id", "item_id", F.lit(True).alias("__seed"))
        scored = cut(scored.join(known, ["query_id", "item_id"], "left"), "scored")
        primary = ranked_candidates(scored.where("__seed"), 2 * ctx.pool)
        return reserved(primary, ranked_candidates(scored.where("__seed is null"), k), k, ctx.reserve)
    raise ValueError(f"no retriever for arm {name!r}")
