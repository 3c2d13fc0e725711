"""Indexes, retrievers, arms and ranking metrics on the driver's tables.

Documents are the corpus, benchmark items the queries; a document that contains an item's text is
gold for it. ``vec_id`` doubles as document id and, for the queries' vectors, as item id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as m
from ..operators import retrieval as r
from ..operators.graph import symmetric
from ..operators.hierarchy import snippets, tree_from_paths
from ..sources.io import table
from ..sources.shared import cut
from .registry import query

TOK = "list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9๐-๙]+'), lambda w: lower(w))"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), "text", "source", "lang")


def questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def gold_pairs(spark: SparkSession, d: str) -> DataFrame:
    """query_id, item_id: the benchmark, a stated query set, is sent to the documents in checked blocks."""
    docs, out = corpus(spark, d), None
    for block in r.query_blocks(questions(spark, d).withColumnRenamed("text", "q")):
        part = docs.join(F.broadcast(block), F.col("text").contains(F.col("q"))).select("query_id", "item_id")
        out = part if out is None else out.unionByName(part)
    return out


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(spark, d, "embeddings")
    items = v.join(table(spark, d, "documents").select(F.col("doc_id").alias("vec_id")), "vec_id", "left_semi")
    asked = v.join(table(spark, d, "benchmark").select(F.col("item_id").alias("vec_id")), "vec_id", "left_semi")
    return items.select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector")), asked.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    return df.withColumns({c: F.round(c, 6) for c in cols})


TF = f"""
toks AS (SELECT doc_id AS item_id, {TOK} AS tok FROM documents),
tf AS (SELECT item_id, term, count(*) AS f FROM (SELECT item_id, unnest(tok) AS term FROM toks) GROUP BY ALL),
dl AS (SELECT item_id, len(tok)::BIGINT AS dl FROM toks),
q AS (SELECT DISTINCT item_id AS query_id, unnest({TOK}) AS term FROM benchmark)"""
BM25 = TF + """,
stat AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
bm25 AS (
  SELECT query_id, item_id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * f * 2.5::DOUBLE / (f + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS score
  FROM q JOIN tf USING (term) JOIN df USING (term) JOIN dl USING (item_id), stat GROUP BY query_id, item_id)"""


def ranked_sql(name: str, source: str, k: int, order: str = "round(score, 6) DESC, item_id") -> str:
    return f"{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order})::INT AS rank FROM {source}) WHERE rank <= {k})"


DENSE = """
dense AS (
  SELECT b.vec_id AS query_id, a.vec_id AS item_id, list_dot_product(b.embedding::DOUBLE[], a.embedding::DOUBLE[]) AS score
  FROM embeddings a, embeddings b WHERE a.vec_id IN (SELECT doc_id FROM documents) AND b.vec_id IN (SELECT item_id FROM benchmark))"""


def norm_sql(source: str) -> str:
    return f"SELECT query_id, item_id, (score - min(score) OVER w) / coalesce(nullif(max(score) OVER w - min(score) OVER w, 0), 1) AS v FROM {source} WINDOW w AS (PARTITION BY query_id)"


FUSED = BM25 + "," + DENSE + f""",
fused AS (
  SELECT query_id, item_id, 0.5::DOUBLE * coalesce(x.v, 0) + 0.5::DOUBLE * coalesce(y.v, 0) AS score
  FROM ({norm_sql('dense')}) x FULL JOIN ({norm_sql('bm25')}) y USING (query_id, item_id)),
{ranked_sql('pool', 'fused', 50)}"""
SHARES = f"""
qt AS (SELECT item_id AS query_id, list_distinct({TOK}) AS q FROM benchmark),
dt AS (SELECT doc_id AS item_id, list_distinct({TOK}) AS t FROM documents)"""


def rerank_sql(name: str, source: str, k: int) -> str:
    scored = f"(SELECT query_id, item_id, len(list_intersect(q, t))::DOUBLE / greatest(len(q), 1) AS score FROM (SELECT DISTINCT query_id, item_id FROM {source}) JOIN dt USING (item_id) JOIN qt USING (query_id))"
    return ranked_sql(name, scored, k, "round(score, 6) DESC, item_id DESC")


def out(ctes: str, source: str, cols: str = "query_id, rank, item_id, round(score, 6) AS score") -> str:
    return f"WITH {ctes} SELECT {cols} FROM {source}"


def listed(df: DataFrame, score: bool = True) -> DataFrame:
    out = df.select("query_id", "rank", "item_id", *(["score"] if score else []))
    return rounded(out, "score") if score else out


@query(out(TF, "tf", "item_id, term, f"))
def term_freq(spark: SparkSession, d: str) -> DataFrame:
    return r.term_frequencies(corpus(spark, d))


@query(out(BM25, "df, stat", "term, df, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)), 6) AS idf"))
def doc_freq_idf(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    tf = r.term_frequencies(docs)
    n = docs.agg(F.count("*").alias("n"))
    df = tf.groupBy("term").agg(F.count("*").alias("df")).crossJoin(F.broadcast(n))  # one row
    return df.select("term", "df", F.round(r.inverse_frequencies(tf, F.col("n")), 6).alias("idf"))


@query(out(BM25, "stat", "n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT max(dl) FROM dl) AS longest"))
def doc_length(spark: SparkSession, d: str) -> DataFrame:
    return r.document_lengths(corpus(spark, d)).agg(F.count("*").alias("n_docs"), F.round(F.avg("dl"), 6).alias("avgdl"), F.max("dl").alias("longest"))


@query(out(BM25, "bm25", "query_id, item_id, round(score, 6) AS score"))
def bm25_scores(spark: SparkSession, d: str) -> DataFrame:
    return rounded(r.bm25(corpus(spark, d), questions(spark, d)), "score")


@query(out(BM25 + "," + ranked_sql("top", "bm25", 5), "top"))
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.top_k(r.bm25(corpus(spark, d), questions(spark, d)), 5))


@query(out(DENSE + "," + ranked_sql("top", "dense", 5), "top"))
def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.top_k(r.dense(*vectors(spark, d)), 5))


@query(out(DENSE, f"({norm_sql('dense')})", "query_id, item_id, round(v, 6) AS norm"))
def minmax_norm(spark: SparkSession, d: str) -> DataFrame:
    return rounded(r.normalized(r.dense(*vectors(spark, d))), "norm")


def flat_context(spark: SparkSession, d: str) -> r.Context:
    """For arms without a tree or a graph."""
    items, asked = vectors(spark, d)
    return r.Context(corpus(spark, d), questions(spark, d), items, asked)


def context(spark: SparkSession, d: str) -> r.Context:
    docs, (items, asked) = corpus(spark, d), vectors(spark, d)
    tree = cut(doc_tree(spark, d), "doc-tree")  # each level of a descent reads it
    return r.Context(docs, questions(spark, d), items, asked, tree, doc_graph(spark, d), depth=3)


@query(out(FUSED, "pool"))
def hybrid_fused_pool(spark: SparkSession, d: str) -> DataFrame:
    return listed(flat_context(spark, d).hybrid_pool())


@query(out(BM25 + "," + SHARES + "," + ranked_sql("first", "bm25", 50) + "," + rerank_sql("top", "first", 5), "top"))
def rerank_lexical(spark: SparkSession, d: str) -> DataFrame:
    docs, q = corpus(spark, d), questions(spark, d)
    return listed(r.rerank(r.top_k(r.bm25(docs, q), 50), q, docs, 5))


@query(out(FUSED + "," + SHARES + "," + rerank_sql("top", "pool", 5), "top"))
def hybrid_rerank(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.build_arm("hybrid", flat_context(spark, d)))


# --- trees and graphs over documents: source, then language; neighbours share source, language and id / 8


def doc_tree(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d)
    leaves = docs.select("source", "lang", "item_id", F.col("lang").alias("heading"), "text")
    tree = tree_from_paths(docs, ["source", "lang"], "item_id", F.col("text"))
    upper = snippets(leaves.withColumn("node", F.concat(F.lit("root.S"), "source")), "node", ["lang", "item_id"])
    lower = snippets(leaves.withColumn("node", F.concat(F.lit("root.S"), "source", F.lit(".L"), "lang")), "node", ["item_id"])
    return tree.join(upper.unionByName(lower), "node", "left").withColumn("display", F.when(F.col("is_leaf"), F.col("display")).otherwise(F.concat("display", F.lit(" :: "), F.coalesce("snippet", F.lit(""))))).drop("snippet")


def doc_graph(spark: SparkSession, d: str) -> DataFrame:
    docs = corpus(spark, d).select("item_id", (F.col("item_id") + 1).alias("dst"), (F.col("item_id") % 8).alias("m"))
    known = docs.select(F.col("item_id").alias("dst"))
    return symmetric(docs.where("m < 7").select(F.col("item_id").alias("src"), "dst").join(known, "dst", "left_semi"))


SNIP = """
bits AS (SELECT source, lang, doc_id AS item_id, concat_ws(' ', lang, substr(text, 1, 80)) AS bit FROM documents),
s1 AS (SELECT source, lang, item_id, bit, coalesce(sum(length(bit)) OVER (PARTITION BY source ORDER BY lang, item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b1,
  coalesce(sum(length(bit)) OVER (PARTITION BY source, lang ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b2 FROM bits),
up AS (SELECT source, source || ' :: ' || substr(string_agg(bit, ' ' ORDER BY lang, item_id), 1, 400) AS display, row_number() OVER (ORDER BY source) - 1 AS pos FROM s1 WHERE b1 < 400 GROUP BY source),
low AS (SELECT source, lang, lang || ' :: ' || substr(string_agg(bit, ' ' ORDER BY item_id), 1, 400) AS display, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 AS pos FROM s1 WHERE b2 < 400 GROUP BY source, lang)"""


def tok_of(c: str) -> str:
    return f"list_transform(regexp_extract_all({c}, '[A-Za-z0-9๐-๙]+'), lambda w: lower(w))"


def overlap_sql(c: str) -> str:
    return f"len(list_filter({tok_of(c)}, lambda t: list_contains(q, t)))"


def descent_sql(k: int, name: str = "pi") -> str:
    choose = lambda part: f"row_number() OVER (PARTITION BY {part} ORDER BY ov DESC, pos DESC)"
    return f"""
c1 AS (SELECT * FROM (SELECT *, {choose('query_id')} AS c FROM (SELECT query_id, q, source, pos, {overlap_sql('display')} AS ov FROM qt, up)) WHERE c <= 5 AND (ov > 0 OR c = 1)),
c2 AS (SELECT * FROM (SELECT *, {choose('query_id, source')} AS c FROM (SELECT query_id, q, source, c1.ov AS ov1, c1.pos AS pos1, low.lang, low.pos, {overlap_sql('low.display')} AS ov FROM c1 JOIN low USING (source))) WHERE c <= 5 AND (ov > 0 OR c = 1)),
c3 AS (SELECT query_id, doc_id AS item_id, {overlap_sql('substr(text, 1, 120)')} AS ov, row_number() OVER (PARTITION BY query_id ORDER BY -ov1, -pos1, -c2.ov, -pos, doc_id) AS pos FROM c2 JOIN documents USING (source, lang)),
{name} AS (SELECT query_id, item_id, ov::DOUBLE AS score, c::INT AS rank FROM (SELECT *, {choose('query_id')} AS c FROM c3) WHERE c <= {k} AND (ov > 0 OR c = 1))"""


ADJ = """
adj AS (SELECT DISTINCT src, dst FROM (
  SELECT doc_id AS src, doc_id + 1 AS dst FROM documents WHERE doc_id % 8 < 7 AND doc_id + 1 IN (SELECT doc_id FROM documents)
  UNION ALL SELECT doc_id + 1, doc_id FROM documents WHERE doc_id % 8 < 7 AND doc_id + 1 IN (SELECT doc_id FROM documents)))"""


def expand_sql(name: str, seeds: str) -> str:
    return f"""
{name} AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(p), item_id)::INT AS rank FROM (
  SELECT query_id, item_id, [0, rank, 0] AS p FROM {seeds}
  UNION ALL SELECT query_id, dst, [1, rank, nb] FROM {seeds} JOIN (SELECT src, dst, row_number() OVER (PARTITION BY src ORDER BY dst) AS nb FROM adj) n ON item_id = src AND nb <= 20) GROUP BY query_id, item_id)"""


TREE = f"""
SELECT 'root' AS node, NULL AS parent, 0 AS depth, false AS is_leaf, 0 AS pos
UNION ALL SELECT 'root.S' || source, 'root', 1, false, row_number() OVER (ORDER BY source) - 1 FROM (SELECT DISTINCT source FROM documents)
UNION ALL SELECT 'root.S' || source || '.L' || lang, 'root.S' || source, 2, false, row_number() OVER (PARTITION BY source ORDER BY lang) - 1 FROM (SELECT DISTINCT source, lang FROM documents)
UNION ALL SELECT 'root.S' || source || '.L' || lang || '.S' || doc_id, 'root.S' || source || '.L' || lang, 3, true, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) - 1 FROM documents"""


@query(f"SELECT node, parent, depth, is_leaf, pos::INT AS pos FROM ({TREE})")
def tree_adjacency(spark: SparkSession, d: str) -> DataFrame:
    return tree_from_paths(corpus(spark, d), ["source", "lang"], "item_id", F.col("text")).select("node", "parent", "depth", "is_leaf", "pos")


@query(f"WITH {SNIP} SELECT 'root.S' || source AS node, display FROM up UNION ALL SELECT 'root.S' || source || '.L' || lang, display FROM low")
def subtree_snippet(spark: SparkSession, d: str) -> DataFrame:
    return doc_tree(spark, d).where("not is_leaf and parent is not null").select("node", "display")


@query(out(SHARES + "," + SNIP + "," + descent_sql(5), "pi"))
def beam_descent(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.build_arm("pi", context(spark, d)))


@query(out(BM25 + "," + ranked_sql("top", "bm25", 5) + "," + ADJ + "," + expand_sql("hop", "top"), "hop", "query_id, rank, item_id"))
def one_hop_expand(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.expand(r.top_k(r.bm25(corpus(spark, d), questions(spark, d)), 5), doc_graph(spark, d)), score=False)


ALL = FUSED + "," + SHARES + "," + SNIP + "," + ADJ


@query(out(ALL + "," + rerank_sql("first", "pool", 50) + "," + expand_sql("hop", "first") + "," + rerank_sql("top", "hop", 5), "top"))
def arm_hybrid_kg(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.build_arm("hybrid+kg", context(spark, d)))


@query(out(ALL + "," + descent_sql(50) + "," + expand_sql("hop", "pi") + "," + rerank_sql("top", "hop", 5), "top"))
def arm_pi_kg(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.build_arm("pi+kg", context(spark, d)))


SEED = ALL + "," + descent_sql(50) + """,
seed AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(p), item_id)::INT AS rank FROM (
  SELECT query_id, item_id, [0, rank] AS p FROM pool UNION ALL SELECT query_id, item_id, [1, rank] FROM pi) GROUP BY query_id, item_id)""" + "," + rerank_sql("prime", "seed", 100)
FULL = SEED + "," + expand_sql("hop", "seed") + "," + rerank_sql("tail", "(SELECT query_id, item_id FROM hop ANTI JOIN seed USING (query_id, item_id))", 5) + """,
head AS (SELECT * FROM prime WHERE rank <= 4),
extra AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS rank FROM tail ANTI JOIN head USING (query_id, item_id)),
final AS (SELECT query_id, item_id, row_number() OVER (PARTITION BY query_id ORDER BY min(p), item_id)::INT AS rank FROM (
  SELECT query_id, item_id, [0, rank] AS p FROM head UNION ALL SELECT query_id, item_id, [1, rank] FROM extra WHERE rank <= 1
  UNION ALL SELECT query_id, item_id, [2, rank] FROM prime) GROUP BY query_id, item_id)"""


@query(out(SEED, "prime WHERE rank <= 5"))
def arm_hybrid_pi(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.build_arm("hybrid+pi", context(spark, d)))


@query(out(FULL, "final WHERE rank <= 5", "query_id, rank, item_id"))
def arm_full_reserved(spark: SparkSession, d: str) -> DataFrame:
    return listed(r.build_arm("hybrid+pi+kg", context(spark, d)), score=False)


# --- metrics

GOLD = "gold AS (SELECT b.item_id AS query_id, doc_id AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)), golds AS (SELECT query_id, count(*) AS n FROM gold GROUP BY query_id)"


def wide(rankings: DataFrame, gold: DataFrame) -> DataFrame:
    """query_id, ranked, gold; items without gold are left out, unanswered ones have an empty ranking."""
    lists = rankings.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("ranked"))
    right = gold.groupBy("query_id").agg(F.array_sort(F.collect_set("item_id")).alias("gold"))
    return right.join(lists, "query_id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<bigint>")))


def per_item_sql(source: str, k: int) -> str:
    return f"""
per AS (SELECT g.query_id, n, count(r.item_id) FILTER (rank <= {k}) AS hits, min(rank) FILTER (r.item_id IS NOT NULL) AS first,
  FROM gold g JOIN golds USING (query_id) LEFT JOIN {source} r USING (query_id, item_id) GROUP BY g.query_id, n)"""


def scored(spark: SparkSession, d: str, k: int = 5) -> DataFrame:
    return wide(r.top_k(r.bm25(corpus(spark, d), questions(spark, d)), 10), gold_pairs(spark, d))


TOP10 = BM25 + "," + ranked_sql("top", "bm25", 10) + "," + GOLD


@query(out(TOP10 + "," + per_item_sql("top", 5), "per", "query_id, round(hits / n, 6) AS recall, (hits > 0)::DOUBLE AS hit"))
def recall_hit_at_k(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("query_id", F.round(m.recall(F.col("ranked"), F.col("gold"), 5), 6).alias("recall"), m.hit(F.col("ranked"), F.col("gold"), 5).alias("hit"))


@query(out(TOP10 + "," + per_item_sql("top", 10), "per", "query_id, round(coalesce(1.0::DOUBLE / first, 0), 6) AS rr"))
def mrr_at_k(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("query_id", F.round(m.reciprocal_rank(F.col("ranked"), F.col("gold")), 6).alias("rr"))


@query(out(TOP10 + """, hits AS (SELECT query_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS nth FROM top JOIN gold USING (query_id, item_id))""", "golds LEFT JOIN hits USING (query_id) GROUP BY query_id, n", "query_id, round(coalesce(sum(nth::DOUBLE / rank), 0) / n, 6) AS ap"))
def map_at_k(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("query_id", F.round(m.average_precision(F.col("ranked"), F.col("gold")), 6).alias("ap"))


@query(out(TOP10 + "," + per_item_sql("top", 5), "per", "query_id, (hits = n)::DOUBLE AS coverage"))
def coverage_at_k(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("query_id", m.coverage(F.col("ranked"), F.col("gold"), 5).alias("coverage"))


@query(out(TOP10 + ", sup AS (SELECT query_id, item_id + 1 AS item_id FROM gold), sups AS (SELECT query_id, count(*) AS n FROM sup GROUP BY query_id)", "sup JOIN sups USING (query_id) LEFT JOIN (SELECT * FROM top WHERE rank <= 5) r USING (query_id, item_id) GROUP BY query_id, n", "query_id, round(count(r.item_id) / n, 6) AS support_recall"))
def support_recall(spark: SparkSession, d: str) -> DataFrame:
    supporting = F.transform("gold", lambda g: g + 1)
    return scored(spark, d).select("query_id", F.round(m.recall(F.col("ranked"), supporting, 5), 6).alias("support_recall"))


ARM_TOPS = FUSED + "," + GOLD + "," + SHARES + "," + ", ".join([ranked_sql("t0", "bm25", 5), ranked_sql("t1", "dense", 5), rerank_sql("t2", "pool", 5)]) + """,
arms AS (SELECT 'R0' AS arm, query_id, item_id, rank FROM t0 UNION ALL SELECT 'R1', query_id, item_id, rank FROM t1 UNION ALL SELECT 'A1', query_id, item_id, rank FROM t2),
names(arm) AS (VALUES ('R0'), ('R1'), ('A1')),
per AS (SELECT arm, query_id, n, (length(b.text) % 3) AS kind, count(rank) AS hits, min(rank) AS first
  FROM (SELECT * FROM names, gold) g JOIN golds USING (query_id) JOIN (SELECT item_id AS query_id, text FROM benchmark) b USING (query_id) LEFT JOIN arms r USING (arm, query_id, item_id) GROUP BY arm, query_id, n, kind)"""
MEANS = "count(*) AS n, round(avg(hits / n), 6) AS recall, round(avg((hits > 0)::DOUBLE), 6) AS hit, round(avg(coalesce(1.0::DOUBLE / first, 0)), 6) AS mrr, round(avg((hits = n)::DOUBLE), 6) AS coverage"


def arm_items(spark: SparkSession, d: str) -> DataFrame:
    """arm, query_id, kind and the metrics of every answerable item in three arms."""
    ctx, gold = flat_context(spark, d), cut(gold_pairs(spark, d), "gold")
    kinds = questions(spark, d).select("query_id", (F.length("text") % 3).alias("kind"))
    x, g = F.col("ranked"), F.col("gold")
    parts = [wide(r.build_arm(a, ctx), gold).withColumn("arm", F.lit(a)) for a in ("R0", "R1", "A1")]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return rows.join(kinds, "query_id").select("arm", "query_id", "kind", m.recall(x, g, 5).alias("recall"), m.hit(x, g, 5).alias("hit"), m.reciprocal_rank(x, g).alias("mrr"), m.coverage(x, g, 5).alias("coverage"))


def means() -> list:
    return [F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in ("recall", "hit", "mrr", "coverage")]]


@query(out(ARM_TOPS, "per GROUP BY arm", "arm, " + MEANS))
def metrics_by_arm(spark: SparkSession, d: str) -> DataFrame:
    return arm_items(spark, d).groupBy("arm").agg(*means())


@query(out(ARM_TOPS, "per GROUP BY ROLLUP (arm, kind)", "arm, kind::INT AS kind, " + MEANS))
def metrics_rollup_type(spark: SparkSession, d: str) -> DataFrame:
    return arm_items(spark, d).rollup("arm", "kind").agg(*means())


@query(out(TOP10 + ", ks AS (SELECT unnest([1, 3, 5, 10]) AS k), per AS (SELECT k, g.query_id, n, count(r.item_id) FILTER (rank <= k) AS hits FROM ks, gold g JOIN golds USING (query_id) LEFT JOIN top r USING (query_id, item_id) GROUP BY ALL)", "per GROUP BY k", "k, round(avg(hits / n), 6) AS recall, round(avg((hits = n)::DOUBLE), 6) AS coverage"))
def k_sweep(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    x, g = F.col("ranked"), F.col("gold")
    swept = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("k"), m.recall(x, g, k).alias("recall"), m.coverage(x, g, k).alias("coverage")) for k in (1, 3, 5, 10)])).alias("s")).select("s.*")
    return swept.groupBy("k").agg(*[F.round(F.avg(c), 6).alias(c) for c in ("recall", "coverage")])


@query(out(GOLD, "(SELECT query_id, item_id FROM gold UNION SELECT query_id, item_id + 1 FROM gold)", "query_id, count(*) AS n, sum(item_id)::BIGINT AS total") + " GROUP BY query_id")
def arm_oracle_context(spark: SparkSession, d: str) -> DataFrame:
    rows = gold_pairs(spark, d).groupBy("query_id").agg(F.collect_set("item_id").alias("g"))
    both = rows.withColumn("c", F.array_union("g", F.transform("g", lambda x: x + 1)))
    return both.select("query_id", F.size("c").cast("long").alias("n"), F.aggregate("c", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))

