"""Readers and writers with explicit schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

LEVELS = ("book", "title", "chapter", "part")
UNIT = "struct<number:string,heading:string>"
SECTION = f"section_id string, node_id string, heading string, text string, {', '.join(f'{x} {UNIT}' for x in LEVELS)}, amendment_note string"
ITEM = "id string, question string, question_type string, gold_sections array<string>, supporting_sections array<string>, reference_answer string, answer_claims array<string>, applicable_version_date string, difficulty string, annotator string, notes string"
RANKING = "id string, ranked array<string>, gold array<string>, supporting array<string>, meta map<string,string>"
RULES = "rules array<struct<label:string,general_sections:array<string>,scope:string,verified:boolean,targets:array<string>,note:string>>"
HIERARCHY = "level string, number string, heading string, start string"
PLAN = "targets map<string,int>, general_provisions array<struct<section_id:string,label:string>>, unanswerable_topics array<string>, id_prefix string, id_start int"
EDGE = "src string, dst string, type string, resolved boolean, rule string, scope string, verified boolean"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def read_sections(spark: SparkSession, path: str) -> DataFrame:
    """Sections from JSON lines: blank lines skipped, levels flattened to their numbers, absent text empty."""
    raw = spark.read.schema(SECTION).json(path)
    text = [F.coalesce(c, F.lit("")).alias(c) for c in ("section_id", "node_id", "heading", "text")]
    return raw.select(*text, *[F.col(f"{x}.number").alias(x) for x in LEVELS])


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation items; absent lists are empty."""
    raw = spark.read.schema(ITEM).json(path)
    none = F.array().cast("array<string>")
    lists = {c: F.coalesce(c, none) for c in ("gold_sections", "supporting_sections", "answer_claims")}
    return raw.withColumns(lists | {"applicable_version_date": F.try_to_date("applicable_version_date")})


def read_rankings(spark: SparkSession, path: str) -> DataFrame:
    """Ranking files of many arms, ``arm`` from the file's name."""
    return spark.read.schema(RANKING).json(path).withColumn("arm", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.jsonl$", 1))


def read_articles(spark: SparkSession, path: str, intro: str = "intro") -> tuple[DataFrame, DataFrame]:
    """(articles, introduction) of a CSV with a header; cells trimmed, junk rows dropped."""
    raw = spark.read.schema("article string, text string, notes string").option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return split_articles(raw, F.col("article"), F.col("text"), intro)


def split_articles(rows: DataFrame, article: Column, text: Column, intro: str) -> tuple[DataFrame, DataFrame]:
    """Rows with a trimmed article (not ``null`` in any case) and text, in two parts by the article's beginning."""
    clean = rows.withColumns({"article": F.trim(F.coalesce(article, F.lit(""))), "text": F.trim(F.coalesce(text, F.lit("")))})
    clean = clean.where((F.col("article") != "") & (F.col("text") != "") & (F.lower("article") != "null"))
    return clean.where(~F.col("article").startswith(intro)), clean.where(F.col("article").startswith(intro))


def read_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that is one array of objects."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_tree(spark: SparkSession, path: str, depth: int = 6) -> DataFrame:
    """A nested tree as an adjacency table: node, parent, depth, pos (among siblings), is_leaf, display, item_id.

    A file holds one node with ``nodes`` below it, ``depth`` levels at most; display is the heading,
    or heading and text of a section.
    """
    fields = "node_type string, number string, heading string, text string, node_id string, section_id string, node string, display string"
    kind = f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))}>"
    for _ in range(depth):
        kind = f"struct<{', '.join(f.replace(' ', ':', 1) for f in fields.split(', '))},nodes:array<{kind}>>"
    level = spark.read.option("multiLine", True).schema(T.StructType.fromDDL(f"root {kind}")["root"].dataType).json(path)
    here = level.select(F.struct("*").alias("x"), F.lit(None).cast("string").alias("parent"), F.lit(0).alias("pos"))
    out = None
    for at in range(depth + 1):
        x = F.col("x")
        name = F.coalesce(x["node_id"], x["node"], F.when(F.col("parent").isNull(), "root"), F.concat("parent", F.lit("."), F.col("pos").cast("string")))
        here = here.withColumn("name", name)
        shown = F.coalesce(x["display"], F.concat_ws(" ", x["heading"], F.when(x["section_id"].isNotNull(), x["text"])))
        part = here.select(F.col("name").alias("node"), "parent", F.lit(at).alias("depth"), "pos", x["section_id"].isNotNull().alias("is_leaf"), shown.alias("display"), x["section_id"].alias("item_id"))
        out = part if out is None else out.unionByName(part)
        if at < depth:
            here = here.select(F.posexplode(x["nodes"]).alias("pos", "x"), F.col("name").alias("parent"))
    return out


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(RULES).option("multiLine", True).json(path).select(F.posexplode("rules").alias("rule_pos", "r")).select("rule_pos", "r.*")


def read_edges(spark: SparkSession, path: str, kinds: list[str], verified_only: bool = False) -> DataFrame:
    """Edges of the given types without their label prefix; a path that isn't there has none."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], EDGE)
    return clean_edges(spark.read.schema(EDGE).json(path), kinds, verified_only)


def clean_edges(edges: DataFrame, kinds: list[str], verified_only: bool = False) -> DataFrame:
    edges = edges.where(F.col("type").isin(kinds))
    edges = edges.where("coalesce(verified, true)") if verified_only else edges
    bare = lambda c: F.regexp_replace(c, "^[A-Za-z]+:", "")
    return edges.withColumns({"src": bare("src"), "dst": bare("dst")})


def lines_of(texts: DataFrame, text: str = "value") -> DataFrame:
    """Numbered lines, in order, of whole texts."""
    rest = [c for c in texts.columns if c != text]
    return texts.select(*rest, F.posexplode(F.split(text, "\r\n|[\n\r]")).alias("line_no", "line"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines_of(spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value"))


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").text(path)


def report(df: DataFrame) -> DataFrame:
    """Rows as JSON objects, one column ``value``."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("value"))
