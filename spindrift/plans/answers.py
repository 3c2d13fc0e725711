"""Checks on answers, on the driver's tables: assistant turns are answers, the turn before is the question."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import word_tokens
from ..operators import judge as j
from ..operators import retrieval as r
from ..operators.models import LexicalJudge
from ..sources.io import table
from .registry import query
from .retrieval import BM25, corpus, out, questions, ranked_sql

CUES = ["tion the", "onandhe", "stupid"]
ANSWERS = """
a AS (SELECT conv_id * 1000 + turn AS id, conv_id % 4 AS arm, text AS answer, conv_id % 3 = 0 AS unanswerable,
  contains(text, 'tion the') OR contains(text, 'onandhe') OR contains(text, 'stupid') AS refused FROM conversations WHERE role = 'assistant')"""


def answers(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").where("role = 'assistant'")
    return rows.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), (F.col("conv_id") % 4).alias("arm"), F.col("text").alias("answer"), (F.col("conv_id") % 3 == 0).alias("unanswerable"))


@query(f"""
WITH {ANSWERS}, c AS (SELECT arm, count(*) FILTER (unanswerable AND refused) AS tp, count(*) FILTER (NOT unanswerable AND refused) AS fp,
  count(*) FILTER (unanswerable AND NOT refused) AS fn, count(*) FILTER (NOT unanswerable AND NOT refused) AS tn FROM a GROUP BY arm),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS q FROM c)
SELECT arm, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, CASE WHEN p + q > 0 THEN round(2 * p * q / (p + q), 6) END AS f1 FROM r""")
def refusal_prf(spark: SparkSession, d: str) -> DataFrame:
    c = j.confusion(answers(spark, d), F.col("unanswerable"), j.is_refusal(F.col("answer"), CUES), ["arm"])
    return c.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


FLAGS = """
x AS (SELECT doc_id, list_distinct(regexp_extract_all(coalesce(text, ''), '[A-Za-z]*([0-9]+)', 1)) AS cited, [(doc_id % 10)::VARCHAR, '3', '1'] AS retrieved FROM documents),
found AS (SELECT y.doc_id, list(c) AS k FROM (SELECT doc_id, unnest(cited) AS c FROM x) y JOIN (SELECT DISTINCT doc_id::VARCHAR AS c FROM documents) USING (c) GROUP BY y.doc_id),
f AS (SELECT doc_id, cited, list_filter(cited, lambda c: NOT list_contains(coalesce(k, []), c)) AS hard, list_filter(cited, lambda c: list_contains(coalesce(k, []), c) AND NOT list_contains(retrieved, c)) AS soft FROM x LEFT JOIN found USING (doc_id))"""


def flags(spark: SparkSession, d: str) -> DataFrame:
    """Citations of every document, judged against every document."""
    docs = table(spark, d, "documents")
    cited = F.array_distinct(F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit("[A-Za-z]*([0-9]+)"), F.lit(1)))
    retrieved = F.array((F.col("doc_id") % 10).cast("string"), F.lit("3"), F.lit("1"))
    return j.citation_flags(docs.select("doc_id", cited.alias("cited"), retrieved.alias("retrieved")), docs.select(F.col("doc_id").cast("string").alias("id")), "doc_id")


@query(f"""
WITH {FLAGS} SELECT doc_id, len(cited)::INT AS n_cited, len(hard)::INT AS n_hard, len(soft)::INT AS n_soft,
  CASE WHEN len(cited) > 0 THEN round(len(hard) / len(cited), 6) ELSE 0 END AS hard_rate, CASE WHEN len(cited) > 0 THEN round(len(soft) / len(cited), 6) ELSE 0 END AS soft_rate FROM f""")
def hallucination_flags(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).select("doc_id", F.size("cited").alias("n_cited"), F.size("hard").alias("n_hard"), F.size("soft").alias("n_soft"), F.round("hard_rate", 6).alias("hard_rate"), F.round("soft_rate", 6).alias("soft_rate"))


@query(f"""
WITH {FLAGS} SELECT (doc_id % 5)::INT AS arm, count(*) AS n, round(avg(CASE WHEN len(cited) > 0 THEN len(hard) / len(cited) ELSE 0 END), 6) AS hard,
  round(avg(CASE WHEN len(cited) > 0 THEN len(soft) / len(cited) ELSE 0 END), 6) AS soft FROM f GROUP BY 1""")
def hallucination_means(spark: SparkSession, d: str) -> DataFrame:
    return flags(spark, d).groupBy((F.col("doc_id") % 5).cast("int").alias("arm")).agg(F.count("*").alias("n"), F.round(F.avg("hard_rate"), 6).alias("hard"), F.round(F.avg("soft_rate"), 6).alias("soft"))


@query(out(BM25 + "," + ranked_sql("top", "bm25", 3), "top JOIN documents ON doc_id = item_id GROUP BY query_id", "query_id, md5(string_agg(text, chr(10) || chr(10) ORDER BY rank)) AS digest"))
def context_build(spark: SparkSession, d: str) -> DataFrame:
    docs, q = corpus(spark, d), questions(spark, d)
    made = j.contexts(r.top_k(r.bm25(docs, q), 3), docs, 3)
    return made.select("query_id", F.md5(F.col("context").cast("binary")).alias("digest"))


@query("""
SELECT item_id AS id, array_to_string(CASE WHEN item_id % 4 = 0 THEN [] WHEN item_id % 4 = 1 THEN list_value((item_id % 10)::VARCHAR, '77') ELSE ['5', '4'] END, ',') AS ids FROM benchmark""")
def context_ids(spark: SparkSession, d: str) -> DataFrame:
    arm = F.when(F.col("item_id") % 4 == 0, "C0").when(F.col("item_id") % 4 == 1, "C1").otherwise("A1")
    gold = F.array((F.col("item_id") % 10).cast("string"))
    ranked = F.array(*map(F.lit, ("5", "4", "3")))
    return table(spark, d, "benchmark").select(F.col("item_id").alias("id"), F.array_join(j.context_ids(arm, gold, F.array(F.lit("77")), ranked, 2), ",").alias("ids"))


WORDS = "list_transform(regexp_extract_all(coalesce({}, ''), '[A-Za-z0-9๐-๙]+'), lambda w: lower(w))"


@query(f"""
WITH p AS (SELECT a.conv_id, a.turn, a.text AS answer, b.text AS question FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn = b.turn + 1 WHERE a.role = 'assistant'),
t AS (SELECT conv_id, turn, list_distinct({WORDS.format('question')}) AS q, list_distinct({WORDS.format('answer')}) AS w FROM p)
SELECT conv_id, turn, len(list_filter(q, lambda x: list_contains(w, x))) = len(q) AS grounded, (1 + round_even(len(list_intersect(q, w)) / greatest(len(q), 1) * 4, 0))::INT AS score FROM t""")
def claim_grounding(spark: SparkSession, d: str) -> DataFrame:
    turns = table(spark, d, "conversations")
    before = turns.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("question"))
    pairs = turns.where("role = 'assistant'").join(before, ["conv_id", "turn"])
    judge = LexicalJudge()
    return pairs.select("conv_id", "turn", judge.ground(F.array("question"), F.col("text"))[0].alias("grounded"), judge.correctness(F.col("text"), F.col("question")).alias("score"))


@query("""
WITH h AS (SELECT conv_id * 1000 + turn AS id, role, ('0x' || substr(md5('20260729-' || (conv_id * 1000 + turn)), 1, 8))::BIGINT AS h FROM conversations),
n AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY h, id) AS nth, count(*) OVER (PARTITION BY role) AS size FROM h)
SELECT id, role FROM n WHERE nth <= greatest(1, round_even(size * 0.2::DOUBLE, 0))""")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role")
    return j.audit_sample(rows, "id", ["role"])


@query("""
WITH p AS (SELECT quality AS x, toxic AS y FROM labels), n AS (SELECT count(*) AS n, count(*) FILTER (x = y) AS same FROM p),
c AS (SELECT sum(l::DOUBLE * r) AS e FROM (SELECT x AS v, count(*) AS l FROM p GROUP BY x) JOIN (SELECT y AS v, count(*) AS r FROM p GROUP BY y) USING (v))
SELECT n, round((same / n - e / (n::DOUBLE * n)) / (1 - e / (n::DOUBLE * n)), 6) AS kappa FROM n, c""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return j.kappa(table(spark, d, "labels"), "quality", "toxic").withColumn("kappa", F.round("kappa", 6))


@query("""
WITH p AS (SELECT n_chars AS a, len(string_split(text, chr(10))) AS b FROM documents),
k AS (SELECT rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0::DOUBLE AS x, rank() OVER (ORDER BY b) + (count(*) OVER (PARTITION BY b) - 1) / 2.0::DOUBLE AS y FROM p)
SELECT count(*) AS n, round(corr(x, y), 6) AS rho FROM k""")
def spearman(spark: SparkSession, d: str) -> DataFrame:
    pairs = table(spark, d, "documents").select(F.col("n_chars").alias("a"), F.size(F.split("text", "\n")).alias("b"))
    return j.spearman(pairs, "a", "b").withColumn("rho", F.round("rho", 6))


@query("""SELECT event_type, count(*) AS calls, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS tokens FROM events GROUP BY event_type""")
def cost_rollup(spark: SparkSession, d: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.sum(k).alias("tokens"))


@query("SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    q = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95)))
    return table(spark, d, "events").groupBy("event_type").agg(q.alias("q")).select("event_type", F.round(F.col("q")[0], 6).alias("p50"), F.round(F.col("q")[1], 6).alias("p95"))


@query(f"SELECT role, count(*) AS n, sum(len({WORDS.format('text')}))::BIGINT AS words FROM conversations GROUP BY role")
def generation_summary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.sum(F.size(word_tokens(F.col("text")))).alias("words"))
