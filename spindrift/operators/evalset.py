"""Building and checking evaluation sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import json_block, portable_hash
from .ordering import numbered

#: The question types of an item.
TYPES = ("lookup", "penalty", "definition", "exception", "multi_hop", "unanswerable")


def stratified(pool: DataFrame, ident: str, stratum: str, n: int, seed: int = 1) -> DataFrame:
    """n rows dealt round-robin over strata, strata and rows in portable random order; round and order are kept."""
    row, group = portable_hash(F.lit(seed), F.col(ident)), portable_hash(F.lit(seed), F.col(stratum))
    nth = F.row_number().over(Window.partitionBy(stratum).orderBy(row, F.col(ident)))
    dealt = pool.withColumn("round", nth).withColumn("stratum_order", group).where(F.col("round") <= n)
    top = dealt.orderBy("round", "stratum_order", F.col(stratum), F.col(ident)).limit(n)  # n is the feature
    return top.withColumn("picked", F.row_number().over(Window.orderBy("round", "stratum_order", stratum, ident)))


def cycled(rows: DataFrame, options: DataFrame, n_options: int) -> DataFrame:
    """Each row (i from 0) with option number i modulo ``n_options`` (column ``o``).

    Rows or options may be as many as the corpus has; the optimizer broadcasts what it knows is small.
    """
    return rows.withColumn("o", F.pmod(F.col("i"), F.lit(n_options))).join(options, "o")


def with_ids(rows: DataFrame, order: list[str], prefix: str, start: int = 1) -> DataFrame:
    return numbered(rows, order).withColumn("id", F.concat(F.lit(f"{prefix}-"), F.lpad((F.col("i") + start).cast("string"), 4, "0"))).drop("i")


def plan_report(tasks: DataFrame, targets: DataFrame) -> DataFrame:
    """question_type, target, planned, short."""
    got = tasks.groupBy("question_type").agg(F.count("*").alias("planned"))
    return targets.join(got, "question_type", "left").select("question_type", "target", F.coalesce("planned", F.lit(0)).cast("long").alias("planned")).withColumn("short", F.col("planned") < F.col("target"))


def violations(items: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """id and rule of everything wrong with items (id, pos, question, question_type, gold, supporting)."""
    none = F.array().cast("array<string>")
    gold, supporting = F.coalesce("gold", none), F.coalesce("supporting", none)
    earlier = F.row_number().over(Window.partitionBy("id").orderBy("pos"))
    rules: list[tuple[str, Column]] = [
        ("missing id", F.col("id").isNull()),
        ("missing question", F.coalesce(F.length("question"), F.lit(0)) < 5),
        ("bad type", ~F.coalesce(F.col("question_type").isin(*TYPES), F.lit(False))),
        ("duplicate id", (F.col("nth") > 1) & F.col("id").isNotNull()),
        ("unanswerable with gold", (F.col("question_type") == "unanswerable") & (F.size(gold) > 0)),
        ("no gold", (F.col("question_type") != "unanswerable") & (F.size(gold) == 0)),
    ]
    checked = items.withColumn("nth", earlier)
    out = checked.select("id", F.explode(F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in rules]))).alias("rule"))
    if known is not None:
        named = items.select("id", F.explode(F.concat(gold, supporting)).alias("ref"))
        lost = named.join(known.select(F.col("id").cast("string").alias("ref")).distinct(), "ref", "left_anti")
        out = out.unionByName(lost.select("id", F.concat(F.lit("unknown section "), "ref").alias("rule")))
    return out


#: The fields of an item and their types, those it must have, and what some may hold.
FIELDS = {"id": "string", "question": "string", "question_type": "string", "gold_sections": "array", "supporting_sections": "array", "reference_answer": "string", "answer_claims": "array", "applicable_version_date": "string", "difficulty": "string", "annotator": "string", "notes": "string"}
REQUIRED = ("id", "question", "question_type", "gold_sections", "reference_answer")
DIFFICULTIES = ("easy", "medium", "hard")


def schema_violations(lines: DataFrame) -> DataFrame:
    """pos and rule of everything in JSON lines (pos, value) that the schema of items doesn't allow.

    A line must be an object with the required fields and no other than the known ones, each of its
    type; a question has five characters at least, types and difficulties are from their lists.
    """
    field = F.from_json("value", "map<string,string>")
    rows = lines.where(F.trim(F.coalesce("value", F.lit(""))) != "").select("pos", "value", F.json_object_keys("value").alias("keys"), field.alias("f"))
    known = F.array(*map(F.lit, FIELDS))
    of = lambda name: F.try_element_at("f", F.lit(name))
    raw = lambda name: F.get_json_object("value", f"$.{name}")
    shape = lambda name: F.try_variant_get(F.try_parse_json("value"), f"$.{name}", "variant")
    rules: list[tuple[Column, Column]] = [(F.col("keys").isNull(), F.lit("not an object"))]
    for name in REQUIRED:
        rules.append((~F.array_contains("keys", name), F.lit(f"missing {name}")))
    for name, kind in FIELDS.items():
        there = F.array_contains("keys", name)
        made = F.schema_of_variant(shape(name))
        right = made.rlike("^ARRAY<(STRING|VOID)>$") if kind == "array" else made == "STRING"
        rules.append((there & ~F.coalesce(right, F.lit(False)), F.lit(f"{name} is no {'list of strings' if kind == 'array' else 'string'}")))
    rules += [
        (F.array_contains("keys", "question") & (F.length(raw("question")) < 5), F.lit("short question")),
        (F.array_contains("keys", "question_type") & ~F.coalesce(of("question_type").isin(*TYPES), F.lit(False)), F.lit("bad type")),
        (F.array_contains("keys", "difficulty") & ~F.coalesce(of("difficulty").isin(*DIFFICULTIES), F.lit(False)), F.lit("bad difficulty")),
    ]
    found = F.array_compact(F.array(*[F.when(c, text) for c, text in rules]))
    extra = F.transform(F.array_except(F.coalesce("keys", F.array().cast("array<string>")), known), lambda k: F.concat(F.lit("unknown field "), k))
    return rows.select("pos", F.explode(F.concat(found, extra)).alias("rule"))


def assembled(drafts: DataFrame, label: str, prefix: str, start: int = 1) -> DataFrame:
    """Items of drafts (pos, question_type, gold, supporting, answer), numbered in their order.

    An answer is a model's text with a JSON object in it. Drafts without a question or a reference
    answer are left out; unanswerable items have no claims; the difficulty is medium unless given.
    """
    made = F.from_json(json_block(F.col("answer")), "question string, reference_answer string, answer_claims array<string>, difficulty string")
    rows = drafts.withColumn("d", made).where("d.question is not null and d.reference_answer is not null")
    none = F.array().cast("array<string>")
    claims = F.when(F.col("question_type") == "unanswerable", none).otherwise(F.coalesce("d.answer_claims", none))
    items = rows.select("pos", F.trim("d.question").alias("question"), "question_type", F.col("gold").alias("gold_sections"), F.col("supporting").alias("supporting_sections"), F.trim("d.reference_answer").alias("reference_answer"), claims.alias("answer_claims"), F.coalesce("d.difficulty", F.lit("medium")).alias("difficulty"), F.lit(f"llm-drafted:{label}").alias("annotator"))
    return with_ids(items, ["pos"], prefix, start).select("id", *[c for c in items.columns if c != "pos"])


def type_distribution(items: DataFrame) -> DataFrame:
    return items.groupBy("question_type").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
