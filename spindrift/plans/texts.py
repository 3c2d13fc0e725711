"""Scans, projections and scalar functions on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..sources.io import lines_of, report, split_articles, table
from .registry import query

THAI = "translate({}, '0123456789', '๐๑๒๓๔๕๖๗๘๙')"


@query("""
WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9๐-๙]+'), lambda w: lower(w)) AS tok FROM documents)
SELECT doc_id, len(tok)::INT AS n_tokens, len(list_distinct(tok))::INT AS n_distinct, md5(array_to_string(tok, ' ')) AS digest FROM t""")
def tok_alnum(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "documents").select("doc_id", fn.tokenizer("word")(F.col("text")).alias("tok"))
    return t.select("doc_id", F.size("tok").alias("n_tokens"), F.size(F.array_distinct("tok")).alias("n_distinct"), F.md5(F.array_join("tok", " ").cast("binary")).alias("digest"))


@query("""
WITH runs AS (SELECT item_id, unnest(regexp_extract_all(text, '[A-Za-z]+')) AS w FROM benchmark),
grams AS (SELECT item_id, unnest(CASE WHEN length(w) <= 3 THEN [w] ELSE list_transform(range(1, length(w) - 1), lambda i: substr(w, i, 3)) END) AS g FROM runs)
SELECT item_id, g AS gram, count(*) AS n FROM grams GROUP BY item_id, g""")
def tok_char_ngram(spark: SparkSession, d: str) -> DataFrame:
    grams = table(spark, d, "benchmark").select("item_id", F.explode(fn.ngrams_of_runs(F.col("text"), "[A-Za-z]+")).alias("gram"))
    return grams.groupBy("item_id", "gram").agg(F.count("*").alias("n"))


@query("SELECT doc_id, md5(coalesce(source, '') || chr(10) || coalesce(text, '')) AS digest FROM documents")
def content_projection(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(fn.content(F.col("source"), F.col("text")).cast("binary")).alias("digest"))


@query(r"""
WITH h AS (SELECT doc_id, text, regexp_extract(text, '^(?:[^.\n]{1,60}\.)') AS m FROM documents)
SELECT doc_id, CASE WHEN trim(regexp_replace(m, '[ \t\r\n]+', ' ', 'g'), ' ') <> '' THEN trim(regexp_replace(m, '[ \t\r\n]+', ' ', 'g'), ' ') ELSE 'Section ' || doc_id END AS heading,
  length(trim(CASE WHEN trim(m, ' ') <> '' THEN substr(text, length(m) + 1) ELSE text END, ' '))::INT AS n_body FROM h""")
def heading_split(spark: SparkSession, d: str) -> DataFrame:
    heading, body = fn.split_heading(F.col("text"), r"[^.\n]{1,60}\.", F.concat(F.lit("Section "), F.col("doc_id").cast("string")))
    return table(spark, d, "documents").select("doc_id", heading.alias("heading"), F.length(body).alias("n_body"))


@query(f"SELECT event_id, {THAI.format('event_id::VARCHAR')} AS thai, event_id::VARCHAR AS arabic FROM events")
def digit_translate(spark: SparkSession, d: str) -> DataFrame:
    thai = F.translate(F.col("event_id").cast("string"), fn.DIGITS, fn.THAI_DIGITS)
    return table(spark, d, "events").select("event_id", thai.alias("thai")).withColumn("arabic", fn.to_arabic(F.col("thai")))


@query("""
SELECT doc_id, source IN ('src1', 'src2') AS lookup, contains(text, 'stupid') AND source IN ('src1', 'src2') AS penalty,
  doc_id = 1 OR contains(text, ' is ') OR contains(text, 'Licensed') AS definition,
  contains(text, ' not ') OR contains(text, '###') OR contains(text, '!!') AS exception, contains(text, 'stupid') AND source = 'src2' AS multi_hop FROM documents""")
def keyword_flags(spark: SparkSession, d: str) -> DataFrame:
    text, book = F.col("text"), F.col("source")
    offence = fn.contains_any(text, ["stupid"])
    flags = {"lookup": book.isin("src1", "src2"), "penalty": offence & book.isin("src1", "src2"), "definition": (F.col("doc_id") == 1) | fn.contains_any(text, [" is ", "Licensed"]), "exception": fn.contains_any(text, [" not ", "###", "!!"]), "multi_hop": offence & (book == "src2")}
    return table(spark, d, "documents").select("doc_id", *[c.alias(n) for n, c in flags.items()])


METALS = [("tin", "TIN"), ("nickel", "NICKEL"), ("steel", "STEEL"), ("standard", "STANDARD"), ("small", "SMALL")]
PICKED = ", ".join(f"CASE WHEN contains(upper(p_type), '{w}') THEN '{n}' END" for n, w in METALS)


@query(f"SELECT p_partkey, array_to_string(list_filter([{PICKED}], lambda x: x IS NOT NULL), ',') AS classes FROM part")
def keyword_classes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", F.array_join(fn.classes(F.upper("p_type"), METALS), ",").alias("classes"))


@query("""
SELECT c_custkey, 'B' || r_regionkey || CASE WHEN c_custkey % 7 <> 0 THEN '.T' || n_nationkey ELSE '' END || '.S' || replace(c_custkey || '/' || n_nationkey, '/', '_') AS node_id
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def node_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    title = F.when(F.col("c_custkey") % 7 != 0, F.col("n_nationkey").cast("string"))
    leaf = F.concat_ws("/", F.col("c_custkey").cast("string"), F.col("n_nationkey").cast("string"))
    return rows.select("c_custkey", fn.node_path([("B", F.col("r_regionkey").cast("string")), ("T", title)], leaf).alias("node_id"))


@query("SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, regexp_extract(props, '(?s)\\{.*\\}') AS block FROM events")
def json_field(spark: SparkSession, d: str) -> DataFrame:
    noisy = F.concat(F.lit("<think>{ \n }</think> answer: "), F.col("props"), F.lit(" end"))
    block = table(spark, d, "events").select("event_id", fn.json_block(noisy).alias("block"))
    return block.select("event_id", F.get_json_object("block", "$.k").cast("long").alias("k"), "block")


@query("SELECT event_id, list_slice(list_distinct_ordered, 1, 3) AS chosen FROM (SELECT event_id, [(event_id % 4)::INT, ((event_id + 1) % 4)::INT] AS list_distinct_ordered FROM events)")
def chosen_options(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat_ws(" ", F.lit("99, pick"), (F.col("event_id") % 4).cast("string"), F.lit("then"), ((F.col("event_id") + 1) % 4).cast("string"), F.lit("and"), (F.col("event_id") % 4).cast("string"))
    return table(spark, d, "events").select("event_id", fn.chosen_numbers(answer, 4, 3).alias("chosen"))


@query("""
SELECT doc_id, (i - 1)::INT AS line_no, lines[i] AS line FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i
FROM (SELECT doc_id, string_split_regex(text, '\\r\\n|[\\n\\r]') AS lines FROM documents))""".replace("\\\\", "\\"))
def lines_explode(spark: SparkSession, d: str) -> DataFrame:
    return lines_of(table(spark, d, "documents").select("doc_id", "text"), "text")


@query("""
WITH c AS (SELECT conv_id, turn, CASE WHEN turn % 5 = 0 THEN 'intro' || conv_id WHEN turn % 7 = 3 THEN ' NULL ' ELSE role END AS a, trim(coalesce(text, ''), ' ') AS t FROM conversations)
SELECT CASE WHEN starts_with(trim(a, ' '), 'intro') THEN 'intro' ELSE 'article' END AS part, trim(a, ' ') AS article, count(*) AS n
FROM c WHERE trim(a, ' ') <> '' AND t <> '' AND lower(trim(a, ' ')) <> 'null' GROUP BY ALL""")
def junk_filter_split(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    article = F.when(F.col("turn") % 5 == 0, F.concat(F.lit("intro"), F.col("conv_id").cast("string"))).when(F.col("turn") % 7 == 3, F.lit(" NULL ")).otherwise(F.col("role"))
    articles, intro = split_articles(rows, article, F.col("text"), "intro")
    both = articles.withColumn("part", F.lit("article")).unionByName(intro.withColumn("part", F.lit("intro")))
    return both.groupBy("part", "article").agg(F.count("*").alias("n"))


@query("""SELECT '{"r_regionkey":' || r_regionkey || ',"r_name":"' || r_name || '"}' AS value FROM region""")
def json_report(spark: SparkSession, d: str) -> DataFrame:
    return report(table(spark, d, "region").select("r_regionkey", "r_name"))


@query("""
WITH n AS (SELECT conv_id, turn, regexp_extract_all(text, 'th[ ]*([a-z]+)', 1) AS w FROM conversations)
SELECT conv_id, turn, (conv_id % 5)::INT AS n_claims, array_to_string(list_transform(list_slice(list_concat([len(w) > 0, turn % 2 = 0], [false, false, false, false, false]), 1, conv_id % 5), lambda b: CASE WHEN b THEN 'true' ELSE 'false' END), ',') AS verdicts FROM n""")
def verdict_padding(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "conversations")
    given = F.array(F.size(F.regexp_extract_all("text", F.lit("th[ ]*([a-z]+)"), F.lit(1))) > 0, F.col("turn") % 2 == 0)
    n = (F.col("conv_id") % 5).cast("int")
    return rows.select("conv_id", "turn", n.alias("n_claims"), F.array_join(fn.padded_verdicts(given, n).cast("array<string>"), ",").alias("verdicts"))
