"""Building and checking evaluation sets on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evalset as e
from ..sources.io import table
from .registry import query

HASH = "('0x' || substr(md5('1-' || {}), 1, 8))::BIGINT"


def picked_sql(name: str, pool: str, ident: str, stratum: str, n: int) -> str:
    return f"""
{name}_n AS (SELECT *, row_number() OVER (PARTITION BY {stratum} ORDER BY {HASH.format(ident)}, {ident}) AS round, {HASH.format(stratum)} AS so FROM {pool}),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (ORDER BY round, so, {stratum}, {ident})::INT AS picked FROM {name}_n) WHERE picked <= {n})"""


def pool(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("n_chars > 500").select("doc_id", "source")


POOL = "pool AS (SELECT doc_id, source FROM documents WHERE n_chars > 500)"


@query(f"WITH {POOL}, {picked_sql('p', 'pool', 'doc_id', 'source', 75)} SELECT doc_id, source, picked FROM p")
def stratified_pick(spark: SparkSession, d: str) -> DataFrame:
    return e.stratified(pool(spark, d), "doc_id", "source", 75).select("doc_id", "source", "picked")


@query("SELECT CASE WHEN lang IN ('en', 'de') THEN 'lookup' ELSE 'other' END AS pool, count(*) AS n, count(*) FILTER (contains(text, ' is ')) AS definition, count(*) FILTER (contains(text, '!!')) AS exception FROM documents GROUP BY 1")
def pools(spark: SparkSession, d: str) -> DataFrame:
    name = F.when(F.col("lang").isin("en", "de"), "lookup").otherwise("other")
    return table(spark, d, "documents").groupBy(name.alias("pool")).agg(F.count("*").alias("n"), F.count_if(F.col("text").contains(" is ")).alias("definition"), F.count_if(F.col("text").contains("!!")).alias("exception"))


PROVISIONS = ["attempt", "joint", "repeat", "excuse"]


def multi_hop(spark: SparkSession, d: str, n: int = 45) -> DataFrame:
    options = spark.createDataFrame(list(enumerate(PROVISIONS)), "o long, provision string")
    offences = e.stratified(pool(spark, d), "doc_id", "source", n).withColumn("i", F.col("picked") - 1)
    return e.cycled(offences, options, len(PROVISIONS)).select("doc_id", "i", "provision")


MULTI = f"{POOL}, {picked_sql('p', 'pool', 'doc_id', 'source', 45)}, multi AS (SELECT doc_id, picked - 1 AS i, ['attempt', 'joint', 'repeat', 'excuse'][(picked - 1) % 4 + 1] AS provision FROM p)"


@query(f"WITH {MULTI} SELECT doc_id, i, provision FROM multi")
def multihop_pairs(spark: SparkSession, d: str) -> DataFrame:
    return multi_hop(spark, d)


@query("SELECT i::INT AS i, ['tax', 'family', 'labour'][i % 3 + 1] AS topic FROM (SELECT unnest(range(35)) AS i)")
def cycled_topics(spark: SparkSession, d: str) -> DataFrame:
    options = spark.createDataFrame(list(enumerate(("tax", "family", "labour"))), "o long, topic string")
    return e.cycled(spark.range(35).select(F.col("id").cast("int").alias("i")), options, 3).select("i", "topic")


TOPUP = f"{POOL}, {picked_sql('p', 'pool', 'doc_id', 'source', 45)}, rest AS (SELECT * FROM pool WHERE doc_id NOT IN (SELECT doc_id FROM p)), {picked_sql('t', 'rest', 'doc_id', 'source', 30)}"


@query(f"WITH {TOPUP} SELECT doc_id, source, picked FROM t")
def topup_antijoin(spark: SparkSession, d: str) -> DataFrame:
    used = e.stratified(pool(spark, d), "doc_id", "source", 45).select("doc_id")
    return e.stratified(pool(spark, d).join(used, "doc_id", "left_anti"), "doc_id", "source", 30).select("doc_id", "source", "picked")


def tasks(spark: SparkSession, d: str) -> DataFrame:
    lookup = e.stratified(pool(spark, d), "doc_id", "source", 75).select(F.lit("lookup").alias("question_type"), F.col("doc_id").alias("ref"))
    more = multi_hop(spark, d).select(F.lit("multi_hop").alias("question_type"), F.col("doc_id").alias("ref"))
    none = spark.range(35).select(F.lit("unanswerable").alias("question_type"), F.col("id").alias("ref"))
    return lookup.unionByName(more).unionByName(none)


TASKS = f"{POOL}, {picked_sql('a', 'pool', 'doc_id', 'source', 75)}, {picked_sql('p', 'pool', 'doc_id', 'source', 45)}, tasks AS (SELECT 'lookup' AS question_type, doc_id AS ref FROM a UNION ALL SELECT 'multi_hop', doc_id FROM p UNION ALL SELECT 'unanswerable', unnest(range(35)))"


@query(f"WITH {TASKS}, g AS (SELECT question_type, count(*) AS planned FROM tasks GROUP BY 1) SELECT question_type, target, coalesce(planned, 0) AS planned, coalesce(planned, 0) < target AS short FROM (VALUES ('lookup', 75), ('multi_hop', 45), ('penalty', 55), ('unanswerable', 35)) t(question_type, target) LEFT JOIN g USING (question_type)")
def plan_report(spark: SparkSession, d: str) -> DataFrame:
    targets = spark.createDataFrame([("lookup", 75), ("multi_hop", 45), ("penalty", 55), ("unanswerable", 35)], "question_type string, target int")
    return e.plan_report(tasks(spark, d), targets)


@query(f"WITH {TASKS} SELECT question_type, ref, 'q-' || lpad((row_number() OVER (ORDER BY question_type, ref) + 9)::VARCHAR, 4, '0') AS id FROM tasks")
def assign_ids(spark: SparkSession, d: str) -> DataFrame:
    return e.with_ids(tasks(spark, d), ["question_type", "ref"], "q", 10)


def items(spark: SparkSession, d: str) -> DataFrame:
    """Conversation turns as items, some of them wrong in one way or another."""
    rows = table(spark, d, "conversations")
    kind = F.element_at(F.array(*map(F.lit, ("lookup", "penalty", "unanswerable", "riddle"))), (F.col("turn") % 4 + 1).cast("int"))
    gold = F.when(F.col("conv_id") % 3 == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("conv_id") * 40).cast("string")))
    return rows.select((F.col("conv_id") * 100 + F.floor(F.col("turn") / 2)).cast("string").alias("id"), (F.col("conv_id") * 100 + F.col("turn")).alias("pos"), F.col("text").alias("question"), kind.alias("question_type"), gold.alias("gold"), F.array(F.col("turn").cast("string")).alias("supporting"))


ITEMS = """
i AS (SELECT (conv_id * 100 + turn // 2)::VARCHAR AS id, conv_id * 100 + turn AS pos, substr(text, 1, 7) AS question, ['lookup', 'penalty', 'unanswerable', 'riddle'][turn % 4 + 1] AS question_type,
  CASE WHEN conv_id % 3 = 0 THEN []::VARCHAR[] ELSE [(conv_id * 40)::VARCHAR] END AS gold, [turn::VARCHAR] AS supporting FROM conversations)"""


@query(f"""
WITH {ITEMS}, n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pos) AS nth FROM i),
v AS (SELECT id, 'missing question' AS rule FROM n WHERE coalesce(length(question), 0) < 5
UNION ALL SELECT id, 'bad type' FROM n WHERE question_type = 'riddle' UNION ALL SELECT id, 'duplicate id' FROM n WHERE nth > 1
UNION ALL SELECT id, 'unanswerable with gold' FROM n WHERE question_type = 'unanswerable' AND len(gold) > 0
UNION ALL SELECT id, 'no gold' FROM n WHERE question_type <> 'unanswerable' AND len(gold) = 0
UNION ALL SELECT id, 'unknown section ' || ref FROM (SELECT id, unnest(list_concat(gold, supporting)) AS ref FROM n) WHERE ref NOT IN (SELECT doc_id::VARCHAR FROM documents))
SELECT id, rule FROM v""")
def validate_violations(spark: SparkSession, d: str) -> DataFrame:
    return e.violations(items(spark, d), table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query(f"WITH {ITEMS} SELECT question_type, count(*) AS n, min(pos) AS first FROM i GROUP BY 1")
def type_distribution(spark: SparkSession, d: str) -> DataFrame:
    return e.type_distribution(items(spark, d))
