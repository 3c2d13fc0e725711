"""Hierarchies, graphs and rules on the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import classes, contains_any, numbers_cited
from ..operators import graph as g
from ..operators import hierarchy as h
from ..sources.io import clean_edges, table
from .registry import query

UNITS = """
n AS (SELECT count(*) AS n FROM events),
units AS (SELECT event_id AS unit, (event_id // 97) % 4 AS level_rank, event_id AS p0 FROM events WHERE event_id % 97 = 0),
spans AS (SELECT u.*, coalesce((SELECT min(v.p0) FROM units v WHERE v.p0 > u.p0 AND v.level_rank <= u.level_rank) - 1, n - 1) AS p1 FROM units u, n)"""


def spans(spark: SparkSession, d: str) -> DataFrame:
    events = table(spark, d, "events")
    units = events.where("event_id % 97 = 0").select(F.col("event_id").alias("unit"), F.expr("(event_id div 97) % 4").alias("level_rank"), F.col("event_id").alias("p0"))
    n = events.agg(F.count("*").alias("n"))
    return h.unit_spans(units.crossJoin(F.broadcast(n)), F.col("n")).select("unit", "level_rank", "p0", "p1")  # one row


@query(f"WITH {UNITS} SELECT unit, level_rank, p0, p1 FROM spans")
def unit_spans(spark: SparkSession, d: str) -> DataFrame:
    return spans(spark, d)


@query(f"WITH {UNITS} SELECT e.event_id AS pos, level_rank, min_by(unit, p0) AS unit FROM events e JOIN spans ON e.event_id BETWEEN p0 AND p1 GROUP BY ALL")
def unit_at_range_join(spark: SparkSession, d: str) -> DataFrame:
    return h.unit_at(table(spark, d, "events").select(F.col("event_id").alias("pos")), spans(spark, d))


MARKED = {"book": "^BOOK ([0-9]+)$", "title": "^TITLE ([0-9]+)$"}


@query("""
SELECT r_regionkey AS doc_id, c_custkey::VARCHAR AS section_id, 'SEC ' || c_custkey AS heading, 'of ' || c_name || chr(10) || 'in ' || c_mktsegment AS text,
  n_nationkey::VARCHAR AS title, n_name AS title_heading, r_name AS book_heading
FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")
def line_state_machine(spark: SparkSession, d: str) -> DataFrame:
    """Regions as documents: a marker and heading for each region and nation, customers as two-line sections."""
    regions, nations, people = (table(spark, d, t) for t in ("region", "nation", "customer"))
    at = lambda *parts: sum((F.col(c).cast("long") * w if c else F.lit(w) for c, w in parts), F.lit(0).cast("long"))
    line = lambda rows, doc, no, text: rows.select(F.col(doc).alias("doc_id"), no.alias("line_no"), text.alias("line"))
    inside = people.join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    key = [("n_nationkey", 10**9), ("c_custkey", 10)]
    parts = [
        line(regions, "r_regionkey", F.lit(-9).cast("long"), F.concat(F.lit(" BOOK "), F.col("r_regionkey").cast("string"))),
        line(regions, "r_regionkey", F.lit(-8).cast("long"), F.lit("  ")),
        line(regions, "r_regionkey", F.lit(-7).cast("long"), F.col("r_name")),
        line(nations, "n_regionkey", at(("n_nationkey", 10**9), ("", -3)), F.concat(F.lit("TITLE "), F.col("n_nationkey").cast("string"))),
        line(nations, "n_regionkey", at(("n_nationkey", 10**9), ("", -2)), F.col("n_name")),
        line(inside, "n_regionkey", at(*key), F.concat(F.lit("SEC "), F.col("c_custkey").cast("string"), F.lit(" of "), F.col("c_name"))),
        line(inside, "n_regionkey", at(*key, ("", 1)), F.concat(F.lit("  in "), F.col("c_mktsegment"))),
    ]
    lines = parts[0]
    for p in parts[1:]:
        lines = lines.unionByName(p)
    found = h.parse_lines(lines, MARKED, "^SEC ([0-9]+(?:/[0-9]+)?)[ ]*(bis)?", heading_word="SEC")
    return found.select("doc_id", "section_id", "heading", "text", F.col("title.number").alias("title"), F.col("title.heading").alias("title_heading"), F.col("book.heading").alias("book_heading"))


@query("""
SELECT count(*) AS n_rows, count(b) AS with_b, count(t) AS with_t,
  (SELECT list(doc_id ORDER BY doc_id) FROM (SELECT doc_id FROM documents WHERE doc_id % 90 = 0 ORDER BY doc_id LIMIT 20)) AS missing_b,
  (SELECT list(doc_id ORDER BY doc_id) FROM (SELECT doc_id FROM documents WHERE doc_id % 70 = 0 ORDER BY doc_id LIMIT 20)) AS missing_t
FROM (SELECT doc_id, CASE WHEN doc_id % 90 <> 0 THEN source END AS b, CASE WHEN doc_id % 70 <> 0 THEN lang END AS t FROM documents)""")
def integrity_report(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    rows = docs.select("doc_id", F.when(F.col("doc_id") % 90 != 0, F.col("source")).alias("b"), F.when(F.col("doc_id") % 70 != 0, F.col("lang")).alias("t"))
    return h.integrity(rows, ["b", "t"], "doc_id")


def sections(spark: SparkSession, d: str) -> DataFrame:
    """Customers with two levels, of which some lack the second."""
    rows = table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    number = F.when(F.col("c_custkey") % 6 != 0, F.col("n_nationkey") % 7)
    return rows.select(F.col("c_custkey").alias("pos"), F.col("r_regionkey").alias("book"), F.col("r_name").alias("book_heading"), number.alias("title"), F.col("n_name").alias("title_heading"))


SECTIONS = """
s AS (SELECT c_custkey AS pos, r_regionkey AS book, r_name AS book_heading, CASE WHEN c_custkey % 6 <> 0 THEN n_nationkey % 7 END AS title, n_name AS title_heading
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""


@query(f"""
WITH {SECTIONS} SELECT 'Book:' || book AS id, 'Book' AS label, book::VARCHAR AS number, min_by(book_heading, pos) AS heading FROM s GROUP BY book
UNION ALL SELECT 'Title:' || title, 'Title', title::VARCHAR, min_by(title_heading, pos) FROM s WHERE title IS NOT NULL GROUP BY title""")
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return g.structural_nodes(sections(spark, d), ["book", "title"], "pos")


@query(f"""
WITH {SECTIONS}, e AS (SELECT 'Book:' || book AS src, 'Title:' || title AS dst FROM s WHERE title IS NOT NULL AND book IS NOT NULL
UNION ALL SELECT coalesce('Title:' || title, 'Book:' || book, 'root'), 'Section:' || pos FROM s) SELECT src, dst, 'CONTAINS' AS type, count(*) AS n FROM e GROUP BY ALL""")
def kg_contains(spark: SparkSession, d: str) -> DataFrame:
    return g.one_each(g.contains_edges(sections(spark, d), ["book", "title"], F.concat(F.lit("Section:"), F.col("pos").cast("string"))))


CITED = """
c AS (SELECT page_id, unnest(list_distinct(list_concat(regexp_extract_all(html, '/([0-9]+)', 1), [((page_id * 7) % 300)::VARCHAR]))) AS dst FROM pages),
e AS (SELECT DISTINCT page_id::VARCHAR AS src, dst, dst IN (SELECT page_id::VARCHAR FROM pages) AS resolved FROM c WHERE page_id::VARCHAR <> dst)"""


def cites(spark: SparkSession, d: str) -> DataFrame:
    pages = table(spark, d, "pages")
    ids = F.array_distinct(F.concat(F.regexp_extract_all("html", F.lit("/([0-9]+)"), F.lit(1)), F.array(((F.col("page_id") * 7) % 300).cast("string"))))
    return g.cites_edges(pages, "page_id", ids, pages.select(F.col("page_id").alias("id")))


@query(f"WITH {CITED} SELECT src, dst, 'CITES' AS type, resolved FROM e")
def kg_cites_resolved(spark: SparkSession, d: str) -> DataFrame:
    return cites(spark, d)


@query(f"WITH {CITED} SELECT count(*) AS n, count(*) FILTER (NOT resolved) AS dangling, count(DISTINCT dst) FILTER (NOT resolved) AS dangling_ids FROM e")
def kg_dangling(spark: SparkSession, d: str) -> DataFrame:
    lost = ~F.col("resolved")
    return cites(spark, d).agg(F.count("*").alias("n"), F.count_if(lost).alias("dangling"), F.count_distinct(F.when(lost, F.col("dst"))).alias("dangling_ids"))


TAGS = [("urgent", "1-URGENT"), ("high", "HIGH"), ("low", "LOW"), ("medium", "MEDIUM"), ("any", "-")]


@query("SELECT o_orderkey::VARCHAR AS src, t.tag AS dst, 'HAS_PENALTY' AS type FROM orders JOIN (VALUES ('urgent', '1-URGENT'), ('high', 'HIGH'), ('low', 'LOW'), ('medium', 'MEDIUM'), ('any', '-')) t(tag, word) ON contains(o_orderpriority, t.word)")
def kg_penalty_tags(spark: SparkSession, d: str) -> DataFrame:
    return g.tag_edges(table(spark, d, "orders"), "o_orderkey", classes(F.col("o_orderpriority"), TAGS))


ADJ = """
adj AS (SELECT DISTINCT src, dst FROM (SELECT 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem UNION ALL SELECT 'p' || l_partkey, 's' || l_suppkey FROM lineitem))"""


def supply(spark: SparkSession, d: str) -> DataFrame:
    pair = table(spark, d, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("src"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("dst"))
    return g.symmetric(pair)


@query(f"WITH {ADJ} SELECT src, dst FROM adj")
def adjacency_symmetric(spark: SparkSession, d: str) -> DataFrame:
    return supply(spark, d)


@query(f"WITH {ADJ} SELECT src AS id, count(*) AS degree FROM adj GROUP BY src")
def kg_degree(spark: SparkSession, d: str) -> DataFrame:
    return g.degrees(supply(spark, d))


@query(f"WITH {ADJ} SELECT src, dst, nb FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY dst)::INT AS nb FROM adj) WHERE nb <= 20")
def neighbours_capped(spark: SparkSession, d: str) -> DataFrame:
    return g.capped_neighbours(supply(spark, d))


RULES = [
    ("names", ["1", "2"], "needs_review", False, None, "by hand"),
    ("all", ["3", "4", "99999999"], "all_offences", True, None, None),
    ("small", ["5"], "book2", False, None, None),
    ("large", ["6", "7"], "book3_lahu", True, None, None),
    ("grade", ["8"], "by_penalty", False, None, None),
    ("listed", ["9", "10"], "specific", True, ["9", "11", "12", "88888888"], None),
    ("empty", ["13"], "specific", False, [], None),
]
RULE_SQL = """
rules(label, general_sections, scope, verified, targets, note) AS (VALUES
  ('names', ['1', '2'], 'needs_review', false, NULL, 'by hand'), ('all', ['3', '4', '99999999'], 'all_offences', true, NULL, NULL),
  ('small', ['5'], 'book2', false, NULL, NULL), ('large', ['6', '7'], 'book3_lahu', true, NULL, NULL), ('grade', ['8'], 'by_penalty', false, NULL, NULL),
  ('listed', ['9', '10'], 'specific', true, ['9', '11', '12', '88888888'], NULL), ('empty', ['13'], 'specific', false, []::VARCHAR[], NULL)),
parts AS (SELECT p_partkey::VARCHAR AS id, contains(p_type, 'A') AND p_size <= 25 AS b2, contains(p_type, 'A') AND p_size > 25 AS b3 FROM part),
general AS (SELECT r.*, s AS src FROM (SELECT *, unnest(general_sections) AS s FROM rules WHERE scope <> 'needs_review') r JOIN parts ON s = id),
edges AS (
  SELECT src, id AS dst, label, scope, verified FROM general, parts WHERE src <> id AND CASE scope WHEN 'book2' THEN b2 WHEN 'book3_lahu' THEN b3 WHEN 'specific' THEN false ELSE b2 OR b3 END
  UNION ALL SELECT src, t, label, scope, verified FROM (SELECT *, unnest(targets) AS t FROM general WHERE scope = 'specific') JOIN parts ON t = id WHERE src <> t)"""


def rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "label string, general_sections array<string>, scope string, verified boolean, targets array<string>, note string")


def ruled_parts(spark: SparkSession, d: str) -> DataFrame:
    offence = contains_any(F.col("p_type"), ["A"])
    small = F.col("p_size") <= 25
    scopes = F.when(offence & small, F.array(*map(F.lit, ("all_offences", "by_penalty", "book2")))).when(offence, F.array(*map(F.lit, ("all_offences", "by_penalty", "book3_lahu")))).otherwise(F.array().cast("array<string>"))
    return table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("id"), scopes.alias("scopes"))


@query(f"WITH {RULE_SQL} SELECT src, dst, 'APPLIES_TO' AS type, label AS rule, scope, verified FROM edges")
def scope_rules_edges(spark: SparkSession, d: str) -> DataFrame:
    return g.rule_edges(rules(spark), ruled_parts(spark, d))


@query(f"WITH {RULE_SQL} SELECT label, scope, verified, (SELECT count(*) FROM edges e WHERE e.label = rules.label AND verified) AS n FROM rules")
def scope_rules_stats(spark: SparkSession, d: str) -> DataFrame:
    return g.rule_stats(rules(spark), g.rule_edges(rules(spark), ruled_parts(spark, d), verified_only=True))


@query(f"WITH {RULE_SQL} SELECT unnest(general_sections) AS general_section_id, label AS rule, '' AS applies_to_section_id, coalesce(note, '') AS note FROM rules WHERE scope = 'needs_review'")
def review_queue(spark: SparkSession, d: str) -> DataFrame:
    return g.review_queue(rules(spark))


@query(f"""
WITH {RULE_SQL} SELECT rule, kind, id FROM (SELECT label AS rule, 'general' AS kind, unnest(general_sections) AS id FROM rules WHERE scope <> 'needs_review'
UNION ALL SELECT label, 'target', unnest(targets) FROM rules WHERE scope = 'specific') WHERE id NOT IN (SELECT id FROM parts)""")
def bad_targets(spark: SparkSession, d: str) -> DataFrame:
    return g.bad_targets(rules(spark), ruled_parts(spark, d))


@query(f"WITH {RULE_SQL}, {CITED} SELECT 'APPLIES_TO' AS type, count(*) AS n FROM edges UNION ALL SELECT 'CITES', count(*) FROM e")
def edge_type_counts(spark: SparkSession, d: str) -> DataFrame:
    applies = g.rule_edges(rules(spark), ruled_parts(spark, d)).select("src", "dst", "type")
    return g.edge_counts(applies.unionByName(cites(spark, d).select("src", "dst", "type")))


@query(f"WITH {RULE_SQL} SELECT src, dst FROM edges WHERE verified")
def verified_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = g.rule_edges(rules(spark), ruled_parts(spark, d)).withColumn("src", F.concat(F.lit("Section:"), "src"))
    return clean_edges(edges, ["APPLIES_TO"], verified_only=True).select("src", "dst")


@query(r"""SELECT 'MERGE (n:Part {id: ''' || p_partkey || '''}) SET n.p_name = ''' || replace(replace(p_name, '\', '\\'), '''', '\''') || ''', n.p_size = ''' || p_size || ''';' AS value FROM part""")
def cypher_lines(spark: SparkSession, d: str) -> DataFrame:
    return g.cypher_nodes(table(spark, d, "part").withColumn("label", F.lit("Part")), "label", "p_partkey", ["p_name", "p_size"])


@query(r"""SELECT doc_id, list_distinct_kept AS cited FROM (SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), 'CC[ ]*BY|.[ ]*([0-9]+)', 1))), ',') AS list_distinct_kept FROM documents)""".replace("'CC[ ]*BY|.[ ]*([0-9]+)'", "'[A-Za-z]+[ ]*([0-9]+)'"))
def cited_ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(numbers_cited(F.col("text"), "[A-Za-z]+")), ",").alias("cited"))
