"""The commands and the functions for Thai statutes as they are shipped, on statutes made from the driver's parts.

A part is a section: its number, a penalty or a definition, citations with ordinal words and ranges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as fn
from ..operators import hierarchy as h
from ..operators import judge as j
from ..sources.io import table
from . import commands as c
from .registry import query

PHRASES = ["ต้องระวางโทษจำคุก", "ต้องระวางโทษปรับ", "ต้องระวางโทษประหารชีวิต หรือจำคุกตลอดชีวิต", "หมายความว่า", "ศาลจะไม่ลงโทษ กักขัง"]
WORDS = ["", *fn.ORDINALS]
THAI = f"translate({{}}, '{fn.DIGITS}', '{fn.THAI_DIGITS}')"


def pick(values: list[str], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))


def listed(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def statutes(spark: SparkSession, d: str) -> DataFrame:
    """section_id, pos, heading, text, and book, title and chapter as structs."""
    key, size = F.col("p_partkey"), F.col("p_size")
    thai = lambda x: F.translate(x.cast("string"), fn.DIGITS, fn.THAI_DIGITS)
    low = key * 3 % 900
    span = F.when(size % 5 == 0, F.concat(F.lit(" และมาตรา "), low.cast("string"), F.lit(" ถึงมาตรา "), thai(low + size % 60))).otherwise("")
    text = F.concat(F.lit("ผู้ใด"), pick(PHRASES, size % 5), F.lit(" ตามมาตรา "), thai(key * 7 % 2200), F.lit(" "), pick(WORDS, key % 12), span, F.lit(" Act of "), F.col("p_type"), F.lit("."))
    unit = lambda n, word: F.when(n > 0, F.struct(n.cast("string").alias("number"), F.concat(F.lit(f"{word} "), n.cast("string")).alias("heading")))
    return table(spark, d, "part").select(key.cast("string").alias("section_id"), key.alias("pos"), F.col("p_name").alias("heading"), text.alias("text"), unit(size % 3 + 1, "b").alias("book"), unit(size % 7, "t").alias("title"), unit(key % 4, "c").alias("chapter"))


STATUTES = f"""
s AS (SELECT p_partkey::VARCHAR AS section_id, p_partkey AS pos, p_name AS heading,
  'ผู้ใด' || {listed(PHRASES)}[p_size % 5 + 1] || ' ตามมาตรา ' || {THAI.format('(p_partkey * 7 % 2200)::VARCHAR')} || ' ' || {listed(WORDS)}[p_partkey % 12 + 1]
  || CASE WHEN p_size % 5 = 0 THEN ' และมาตรา ' || (p_partkey * 3 % 900) || ' ถึงมาตรา ' || {THAI.format('(p_partkey * 3 % 900 + p_size % 60)::VARCHAR')} ELSE '' END || ' Act of ' || p_type || '.' AS text,
  (p_size % 3 + 1)::VARCHAR AS book, CASE WHEN p_size % 7 > 0 THEN (p_size % 7)::VARCHAR END AS title, CASE WHEN p_partkey % 4 > 0 THEN (p_partkey % 4)::VARCHAR END AS chapter FROM part)"""


def citations_sql(words: list[str], ranges: bool) -> str:
    """section_id and c, every citation of s; the ordinal words stand for their numbers."""
    single = rf"'มาตรา[ \t\r\n]*([0-9๐-๙]+(?:/[0-9๐-๙]+)?)[ \t\r\n]*({'|'.join(words)})?'"
    number = " ".join(f"WHEN '{w}' THEN '/{n}'" for w, n in fn.ORDINALS.items())
    arabic = f"translate({{}}, '{fn.THAI_DIGITS}', '{fn.DIGITS}')"
    span = r"'มาตรา[ \t\r\n]*([0-9๐-๙]+)[ \t\r\n]*ถึง[ \t\r\n]*(?:มาตรา[ \t\r\n]*)?([0-9๐-๙]+)'"
    more = f"UNION ALL SELECT section_id, unnest(range(lo, hi + 1))::VARCHAR FROM (SELECT section_id, unnest(list_transform(regexp_extract_all(text, {span}, 1), lambda x: {arabic.format('x')}::BIGINT)) AS lo, unnest(list_transform(regexp_extract_all(text, {span}, 2), lambda x: {arabic.format('x')}::BIGINT)) AS hi FROM s) WHERE hi > lo AND hi - lo < 50" if ranges else ""
    return f"SELECT section_id, CASE WHEN contains(n, '/') THEN n ELSE n || CASE w {number} ELSE '' END END AS c FROM (SELECT section_id, {arabic.format('unnest(regexp_extract_all(text, ' + single + ', 1))')} AS n, unnest(regexp_extract_all(text, {single}, 2)) AS w FROM s) {more}"


@query(f"WITH {STATUTES}, c AS (SELECT DISTINCT section_id, c FROM ({citations_sql(fn.STATUTE_ORDINALS, True)}) WHERE c <> section_id) SELECT section_id, coalesce(string_agg(c, ',' ORDER BY c), '') AS cited FROM s LEFT JOIN c USING (section_id) GROUP BY section_id")
def statute_citations(spark: SparkSession, d: str) -> DataFrame:
    return statutes(spark, d).select("section_id", F.array_join(F.array_sort(fn.statute_citations(F.col("text"), F.col("section_id"))), ",").alias("cited"))


@query(f"WITH {STATUTES}, c AS (SELECT DISTINCT section_id, c FROM ({citations_sql(list(fn.ORDINALS), False)})) SELECT section_id, coalesce(string_agg(c, ',' ORDER BY c), '') AS cited FROM s LEFT JOIN c USING (section_id) GROUP BY section_id")
def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    return statutes(spark, d).select("section_id", F.array_join(F.array_sort(fn.answer_citations(F.col("text"))), ",").alias("cited"))


PENALTIES = ", ".join(f"CASE WHEN contains(text, '{word}') THEN '{name}' END" for name, word in fn.PENALTIES)


@query(f"WITH {STATUTES} SELECT section_id, array_to_string(list_filter([{PENALTIES}], lambda x: x IS NOT NULL), ',') AS classes FROM s")
def statute_penalties(spark: SparkSession, d: str) -> DataFrame:
    return statutes(spark, d).select("section_id", F.array_join(fn.penalty_classes(F.col("text")), ",").alias("classes"))


@query(f"""
WITH {STATUTES}, t AS (SELECT section_id, list_concat(
  flatten(list_transform(regexp_extract_all(text, '[\\x{{0E00}}-\\x{{0E7F}}]+'), lambda r: CASE WHEN length(r) <= 3 THEN [r] ELSE list_transform(range(1, length(r) - 1), lambda i: substr(r, i, 3)) END)),
  list_transform(regexp_extract_all(text, '[A-Za-z0-9๐-๙]+'), lambda w: lower(w))) AS tok FROM s)
SELECT section_id, len(tok)::INT AS n, md5(array_to_string(tok, ' ')) AS digest FROM t""")
def statute_tokens(spark: SparkSession, d: str) -> DataFrame:
    tok = fn.tokenizer("char_ngram")(F.col("text"))
    return statutes(spark, d).select("section_id", tok.alias("tok")).select("section_id", F.size("tok").alias("n"), F.md5(F.array_join("tok", " ").cast("binary")).alias("digest"))


@query(f"""
WITH {STATUTES}, cites AS (SELECT DISTINCT section_id, c FROM ({citations_sql(fn.STATUTE_ORDINALS, True)}) WHERE c <> section_id),
p AS (SELECT section_id, unnest(list_filter([{PENALTIES}], lambda x: x IS NOT NULL)) AS p FROM s)
SELECT 'CITES' AS type, count(*) AS n, count(*) FILTER (c NOT IN (SELECT section_id FROM s)) AS lost, count(DISTINCT c) AS ends FROM cites
UNION ALL SELECT 'HAS_PENALTY', count(*), 0, count(DISTINCT p) FROM p
UNION ALL SELECT 'CONTAINS', count(*) + count(title) + count(chapter), 0, count(DISTINCT section_id) + count(DISTINCT title) + count(DISTINCT chapter) FROM s""")
def statute_graph(spark: SparkSession, d: str) -> DataFrame:
    """Edges of the graph command by type, with citations of unknown sections and distinct ends."""
    edges = c.build_graph(statutes(spark, d))["edges"]
    return edges.groupBy("type").agg(F.count("*").alias("n"), F.count_if(~F.coalesce("resolved", F.lit(True))).alias("lost"), F.count_distinct("dst").alias("ends"))


@query(f"""
WITH {STATUTES} SELECT 'Book' AS label, count(DISTINCT book) AS n, 0 AS with_text FROM s UNION ALL SELECT 'Title', count(DISTINCT title), 0 FROM s UNION ALL SELECT 'Chapter', count(DISTINCT chapter), 0 FROM s
UNION ALL SELECT 'Section', count(*), count(text) FROM s UNION ALL SELECT 'Penalty', count(DISTINCT p), 0 FROM (SELECT unnest(list_filter([{PENALTIES}], lambda x: x IS NOT NULL)) AS p FROM s)""")
def statute_nodes(spark: SparkSession, d: str) -> DataFrame:
    return c.build_graph(statutes(spark, d))["nodes"].groupBy("label").agg(F.count("*").alias("n"), F.count("text").alias("with_text"))


RULES = [("general", ["1", "2", "x"], "all_offences", True), ("book", ["3"], "book2", False), ("petty", ["4"], "book3_lahu", True), ("hand", ["5"], "needs_review", False)]


@query(f"""
WITH {STATUTES}, r(label, ids, scope) AS (VALUES ('general', ['1', '2', 'x'], 'all_offences'), ('book', ['3'], 'book2'), ('petty', ['4'], 'book3_lahu')),
g AS (SELECT label, scope, i FROM (SELECT label, scope, unnest(ids) AS i FROM r) JOIN s ON s.section_id = i)
SELECT label AS rule, count(*) AS n FROM g JOIN s ON section_id <> i AND contains(text, '{fn.OFFENCE_CUE}') AND CASE scope WHEN 'book2' THEN book = '2' WHEN 'book3_lahu' THEN book = '3' ELSE book IN ('2', '3') END GROUP BY label""")
def statute_rules(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame([(*r, None, None) for r in RULES], "label string, general_sections array<string>, scope string, verified boolean, targets array<string>, note string")
    flat = statutes(spark, d).withColumn("book", F.col("book.number"))
    return c.expand_rules(flat, rules)["edges"].groupBy("rule").agg(F.count("*").alias("n"))


CUES = "(" + " OR ".join(f"contains(answer, '{cue}')" for cue in fn.REFUSALS) + ")"
REFUSED = [fn.REFUSALS[0], fn.REFUSALS[3], fn.REFUSALS[-1], "", " "]


@query(f"""
WITH a AS (SELECT (p_partkey % 3)::INT AS arm, p_size % 4 = 0 AS should, 'คำตอบ' || {listed(REFUSED)}[p_partkey % 5 + 1] || p_name AS answer FROM part), f AS (SELECT arm, should, {CUES} AS did FROM a),
n AS (SELECT arm, count(*) FILTER (should AND did) AS tp, count(*) FILTER (NOT should AND did) AS fp, count(*) FILTER (should AND NOT did) AS fn, count(*) FILTER (NOT should AND NOT did) AS tn FROM f GROUP BY arm),
r AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS q FROM n)
SELECT arm, tp, fp, fn, tn, round(p, 6) AS precision, round(q, 6) AS recall, CASE WHEN p + q > 0 THEN round(2 * p * q / (p + q), 6) END AS f1 FROM r""")
def statute_refusals(spark: SparkSession, d: str) -> DataFrame:
    answer = F.concat(F.lit("คำตอบ"), pick(REFUSED, F.col("p_partkey") % 5), F.col("p_name"))
    rows = table(spark, d, "part").select((F.col("p_partkey") % 3).cast("int").alias("arm"), (F.col("p_size") % 4 == 0).alias("should"), answer.alias("answer"))
    found = j.confusion(rows, F.col("should"), j.is_refusal(F.col("answer")), ["arm"])
    return found.withColumns({x: F.round(x, 6) for x in ("precision", "recall", "f1")})


@query(f"""
SELECT 'doc' AS doc_id, p_partkey || CASE WHEN p_size % 3 = 0 THEN ' ทวิ' ELSE '' END AS section_id, p_name || chr(10) || p_type AS text, (p_partkey // 50)::VARCHAR AS title, 'หัวข้อ ' || (p_partkey // 50) AS title_heading FROM part""")
def statute_lines(spark: SparkSession, d: str) -> DataFrame:
    """Raw lines with Thai markers and numbers: a title for every fifty sections, two lines of text in each."""
    key = F.col("p_partkey")
    thai = lambda x: F.translate(x.cast("string"), fn.DIGITS, fn.THAI_DIGITS)
    at = lambda extra: (key * 10 + extra).cast("long").alias("line_no")
    parts, n = table(spark, d, "part"), F.floor(key / 50)
    titles = parts.groupBy(n.alias("n")).agg(F.min("p_partkey").alias("p_partkey"))
    lines = titles.select(at(-5), F.concat(F.lit("  ลักษณะ "), thai(F.col("n"))).alias("line")).unionByName(titles.select(at(-4), F.concat(F.lit("หัวข้อ "), F.col("n").cast("string")).alias("line")))
    head = F.concat(F.lit("มาตรา "), thai(key), F.when(F.col("p_size") % 3 == 0, F.lit(" ทวิ ")).otherwise(F.lit(" ")), F.col("p_name"))
    lines = lines.unionByName(parts.select(at(0), head.alias("line"))).unionByName(parts.select(at(1), F.lit("   ").alias("line"))).unionByName(parts.select(at(2), F.col("p_type").alias("line")))
    found = h.parse_lines(lines.withColumn("doc_id", F.lit("doc")), *h.text_patterns())
    return found.select("doc_id", "section_id", "text", F.col("title.number").alias("title"), F.col("title.heading").alias("title_heading"))


SET = """
r AS (SELECT item_id::VARCHAR AS id, ('A' || (item_id % 2 + 1)) AS arm, [(item_id % 5)::VARCHAR, (item_id % 7)::VARCHAR, 'x', (item_id % 3)::VARCHAR] AS ranked, [(item_id % 4)::VARCHAR] AS gold, CASE WHEN item_id % 3 = 0 THEN [(item_id % 6)::VARCHAR] ELSE []::VARCHAR[] END AS supporting FROM benchmark)"""


def rankings(spark: SparkSession, d: str) -> DataFrame:
    at = lambda n: (F.col("item_id") % n).cast("string")
    return table(spark, d, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.concat(F.lit("A"), (F.col("item_id") % 2 + 1).cast("string")).alias("arm"), F.array(at(5), at(7), F.lit("x"), at(3)).alias("ranked"), F.array(at(4)).alias("gold"), F.when(F.col("item_id") % 3 == 0, F.array(at(6))).otherwise(F.array().cast("array<string>")).alias("supporting"))


@query(f"WITH {SET}, w AS (SELECT arm, id, list_distinct(list_concat(gold, supporting)) AS wanted, ranked[1:3] AS top, gold FROM r) SELECT arm, id, list_has_any(top, gold)::DOUBLE AS hit, (len(list_intersect(wanted, top)) = len(wanted))::DOUBLE AS coverage FROM w")
def command_outcomes(spark: SparkSession, d: str) -> DataFrame:
    rows = rankings(spark, d)
    of = lambda metric: c.outcomes(rows, metric, 3).withColumnRenamed("v", metric)
    return of("hit").join(of("coverage"), ["arm", "id"])


@query(f"""
WITH {SET}, w AS (SELECT arm, ranked[1:3] AS top, gold, supporting, list_distinct(list_concat(gold, supporting)) AS wanted FROM r)
SELECT arm, count(*) AS n, count(*) FILTER (len(supporting) > 0) AS n_multihop, round(avg(list_has_any(top, gold)::DOUBLE), 6) AS hit, round(avg((len(list_intersect(wanted, top)) = len(wanted))::DOUBLE), 6) AS coverage,
  round(avg(CASE WHEN len(supporting) > 0 THEN list_has_any(top, supporting)::DOUBLE END), 6) AS support_recall FROM w GROUP BY arm""")
def command_scores(spark: SparkSession, d: str) -> DataFrame:
    return c.score_rankings(rankings(spark, d), 3).select("arm", "n", "n_multihop", *[F.round(x, 6).alias(x) for x in ("hit", "coverage", "support_recall")])


@query(f"""
WITH {STATUTES}, x AS (SELECT *, contains(text, '{fn.OFFENCE_CUE}') AS offence FROM s)
SELECT section_id, 'B' || book || '.T' || coalesce(title, '-') AS stratum, array_to_string(list_filter([CASE WHEN book IN ('2', '3') THEN 'lookup' END, CASE WHEN offence AND book IN ('2', '3') THEN 'penalty' END,
  CASE WHEN section_id = '1' OR contains(text, 'หมายความว่า') OR contains(text, 'หมายความรวมถึง') THEN 'definition' END, CASE WHEN {' OR '.join(f"contains(text, '{w}')" for w in fn.EXCEPTION_CUES)} THEN 'exception' END, CASE WHEN offence AND book = '2' THEN 'multi_hop' END], lambda p: p IS NOT NULL), ',') AS pools FROM x""")
def statute_pools(spark: SparkSession, d: str) -> DataFrame:
    flat = statutes(spark, d).withColumns({"book": F.col("book.number"), "title": F.col("title.number")})
    return c.section_pools(flat).select("section_id", "stratum", F.array_join("pools", ",").alias("pools"))
