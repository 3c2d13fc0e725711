"""One function per command: files or tables in, plans or files out. Nothing runs before it is read or written."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranking as m
from ..functions import text as fn
from ..operators import evalset, graph, hierarchy, judge, ordering, retrieval, stats
from ..operators.models import Drafter, EchoGenerator, LexicalJudge
from ..sources import io

LEVELS = list(hierarchy.LEVELS)
#: Pairs of arms that are compared, and the arms of the interaction.
RETRIEVAL_CONTRASTS = [("tree vs hybrid", "A3", "A1"), ("graph on hybrid", "A2", "A1"), ("graph on tree", "A4", "A3"), ("dense vs keyword", "R1", "R0"), ("hybrid vs dense", "A1", "R1"), ("full vs hybrid", "A4", "A1")]
ANSWER_CONTRASTS = [("keyword vs closed", "R0", "C0"), ("dense vs keyword", "R1", "R0"), ("hybrid vs dense", "A1", "R1"), ("full vs hybrid", "A4", "A1"), ("hybrid vs closed", "A1", "C0"), ("full vs closed", "A4", "C0"), ("oracle vs closed", "C1", "C0")]
INTERACTION = ("A1", "A2", "A3", "A4")
BINARY = ("hit", "coverage")
RETRIEVAL_METRICS = ("hit", "coverage", "recall")


def ingest_articles(spark: SparkSession, csv: str, units: str, heading: str = f"{fn.SECTION_WORD} [^ ]+") -> dict[str, DataFrame]:
    """Sections with their units, the introduction, the tree, the integrity report and units without a start."""
    articles, intro = io.read_articles(spark, csv)
    placed = ordering.in_file_order(articles, "pos")
    head, body = fn.split_heading(F.col("text"), heading, F.concat(F.lit(f"{fn.SECTION_WORD} "), F.col("article")))
    sections = placed.select(F.col("article").alias("section_id"), "pos", head.alias("heading"), body.alias("text"))
    full, lost = hierarchy.units_of(sections, io.read_array(spark, units, io.HIERARCHY))
    path = fn.node_path([(hierarchy.INITIALS[x], F.col(f"{x}.number")) for x in LEVELS], F.col("section_id"))
    full = full.withColumn("node_id", path)
    numbered = full.select("section_id", "pos", "heading", "text", *[F.col(f"{x}.number").alias(x) for x in LEVELS])
    tree = hierarchy.tree_from_paths(numbered, LEVELS, "pos", F.concat_ws(" ", "heading", "text"))
    return {"sections": full, "introduction": intro, "tree": tree, "report": hierarchy.integrity(numbered, LEVELS[:3], "section_id"), "lost_units": lost}


def ingest_text(spark: SparkSession, path: str) -> DataFrame:
    """Sections of raw statute texts, a document per file."""
    return hierarchy.parse_lines(io.read_lines(spark, path).withColumnRenamed("path", "doc_id"), *hierarchy.text_patterns())


def build_graph(sections: DataFrame, qualified: bool = False, dedupe: bool = False) -> dict[str, DataFrame]:
    """Nodes and edges of sections (section_id, pos, heading, text, levels as structs); counts by type."""
    flat = sections.select("section_id", "pos", "heading", "text", *[F.col(f"{x}.number").alias(x) for x in LEVELS[:3]], *[F.col(f"{x}.heading").alias(f"{x}_heading") for x in LEVELS[:3]])
    named = lambda c: F.concat(F.lit("Section:"), c)
    contains = graph.contains_edges(flat, LEVELS[:3], named(F.col("section_id")), dedupe)
    cites = graph.cites_edges(flat, "section_id", fn.statute_citations(F.col("text"), F.col("section_id")), flat.select(F.col("section_id").alias("id")))
    tags = graph.tag_edges(flat, "section_id", fn.penalty_classes(F.col("text"))).withColumns({"src": named(F.col("src")), "dst": F.concat(F.lit("Penalty:"), "dst")})
    edges = contains.unionByName(cites.withColumns({"src": named(F.col("src")), "dst": named(F.col("dst"))}), allowMissingColumns=True).unionByName(tags, allowMissingColumns=True)
    leaves = flat.select(named(F.col("section_id")).alias("id"), F.lit("Section").alias("label"), F.col("heading"), "section_id", "text", *LEVELS[:3])
    penalties = tags.select(F.col("dst").alias("id"), F.lit("Penalty").alias("label"), F.regexp_extract("dst", "^Penalty:(.*)$", 1).alias("class")).distinct()
    nodes = graph.structural_nodes(flat, LEVELS[:3], "pos", qualified).unionByName(leaves, allowMissingColumns=True).unionByName(penalties, allowMissingColumns=True)
    return {"nodes": nodes, "edges": edges, "counts": graph.edge_counts(edges)}


def expand_rules(sections: DataFrame, rules: DataFrame, verified_only: bool = False) -> dict[str, DataFrame]:
    """Edges of scope rules over sections (section_id, text, book number), statistics, review queue and problems."""
    offence, book = F.col("text").contains(fn.OFFENCE_CUE), F.col("book")
    names = lambda *x: F.array(*map(F.lit, x))
    scopes = F.when(offence & (book == "2"), names("all_offences", "by_penalty", "book2")).when(offence & (book == "3"), names("all_offences", "by_penalty", "book3_lahu")).otherwise(F.array().cast("array<string>"))
    corpus = sections.select(F.col("section_id").alias("id"), scopes.alias("scopes"))
    edges = graph.rule_edges(rules, corpus, verified_only)
    return {"edges": edges, "stats": graph.rule_stats(rules, edges), "review": graph.review_queue(rules), "problems": graph.bad_targets(rules, corpus)}


def run_retrieval(ctx: retrieval.Context, items: DataFrame, arms: list[str], k: int = 5) -> dict[str, DataFrame]:
    """Rankings of arms as lists, and their mean metrics; items have id, question_type, gold, supporting.

    Items marked unanswerable aren't run; items without gold aren't scored.
    """
    asked = items.where("question_type <> 'unanswerable'")
    out = None
    for arm in arms:
        rows = retrieval.build_arm(arm, ctx, k).groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "item_id"))), lambda x: x["item_id"]).alias("ranked"))
        part = asked.join(rows.withColumnRenamed("query_id", "id"), "id", "left").withColumn("arm", F.lit(retrieval.arm_id(arm)))
        out = part if out is None else out.unionByName(part)
    ranked = out.withColumn("ranked", F.coalesce("ranked", F.array().cast(out.schema["gold"].dataType)))
    return {"rankings": ranked, "metrics": score_rankings(ranked, k)}


def score_rankings(rankings: DataFrame, k: int = 5) -> DataFrame:
    """n, means of recall, hit, mrr, map and coverage, and recall of supporting ids where there are any, per arm."""
    r, g = F.col("ranked"), F.col("gold")
    wanted = F.array_union(g, F.coalesce("supporting", F.array().cast(rankings.schema["gold"].dataType)))
    per = rankings.where(F.size("gold") > 0).select("arm", m.recall(r, g, k).alias("recall"), m.hit(r, g, k).alias("hit"), m.reciprocal_rank(r, g).alias("mrr"), m.average_precision(r, g).alias("map"), m.coverage(r, wanted, k).alias("coverage"), m.recall(r, F.col("supporting"), k).alias("support_recall"))
    names = [c for c in per.columns if c != "arm"]
    return per.groupBy("arm").agg(F.count("*").alias("n"), F.count("support_recall").alias("n_multihop"), *[F.avg(c).alias(c) for c in names])


def run_generation(rankings: DataFrame, docs: DataFrame, questions: DataFrame, k: int = 5, generator=None) -> DataFrame:
    """id, arm, context_ids and answer of every ranked item; questions have id and question, docs item_id and text."""
    ids = judge.context_ids(F.col("arm"), F.col("gold"), F.col("supporting"), F.col("ranked"), k)
    rows = rankings.join(questions.select("id", "question"), "id").withColumn("context_ids", ids)
    parts = rows.select("id", "arm", F.posexplode("context_ids").alias("rank", "item_id")).join(docs.select("item_id", "text"), "item_id")
    texts = parts.groupBy("id", "arm").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda x: x["text"]), "\n\n").alias("context"))
    full = rows.join(texts, ["id", "arm"], "left").withColumn("context", F.coalesce("context", F.lit(fn.NO_CONTEXT)))
    return full.withColumn("answer", (generator or EchoGenerator()).answer(judge.prompt(F.col("question"), F.col("context"))))


def claim_rate() -> Column:
    """The share of an answer's claims that are grounded, null without claims."""
    return F.when(F.size("grounded") > 0, F.size(F.filter("grounded", lambda x: x)) / F.size("grounded"))


def run_judge(answers: DataFrame, known: DataFrame, references: DataFrame, cited: Callable[[Column], Column] = fn.answer_citations, model=None) -> dict[str, DataFrame]:
    """Verdicts on answers, and means per arm. References have id, reference_answer, answer_claims; known has id.

    Whether a cited id is known is looked up by a join, so the corpus may have any size. Claims are
    held against the context of an answer (column ``context``, else the answer itself); unanswerable
    items have neither claims nor a score, and without a reference answer there is no score.
    """
    model = model or LexicalJudge()
    none = F.array().cast("array<string>")
    rows = answers.withColumn("cited", cited(F.col("answer")))
    there = rows.select("id", "arm", F.explode("cited").alias("c")).join(known.select(F.col("id").cast("string").alias("c")).distinct(), "c", "left_semi")
    there = there.groupBy("id", "arm").agg(F.collect_list("c").alias("known"))
    rows = rows.join(there, ["id", "arm"], "left").join(references, "id", "left")
    flags = m.hallucination(F.col("cited"), F.coalesce("known", none), F.col("context_ids").cast("array<string>"))
    claims = F.when(F.col("question_type") == "unanswerable", none).otherwise(F.coalesce("answer_claims", none))
    rows = rows.withColumn("answer_claims", claims)
    grounded = fn.padded_verdicts(model.ground(F.col("answer_claims"), F.col("context" if "context" in answers.columns else "answer")), F.size("answer_claims"))
    verdicts = rows.select("id", "arm", "question_type", "answer", flags.alias("hallucination"), grounded.alias("grounded"), F.when((F.col("question_type") != "unanswerable") & F.col("reference_answer").isNotNull(), model.correctness(F.col("answer"), F.col("reference_answer"))).alias("score"), judge.is_refusal(F.col("answer")).alias("refused"))
    share = claim_rate()
    means = verdicts.groupBy("arm").agg(F.count("*").alias("n"), F.avg("hallucination.hard_rate").alias("hard"), F.avg("hallucination.soft_rate").alias("soft"), F.avg(share).alias("claim_rate"), F.avg((F.col("score") >= 4).cast("int")).alias("correct"), F.avg("score").alias("score"))
    return {"verdicts": verdicts, "means": means, "refusals": judge.confusion(verdicts, F.col("question_type") == "unanswerable", F.col("refused"), ["arm"])}


def outcomes(rows: DataFrame, metric: str, k: int = 5) -> DataFrame:
    """arm, id, v of a metric: of rankings for items with gold, or of verdicts as ``run_judge`` gives them.

    Coverage wants gold and supporting ids, each once. A verdict without a score or a claim has no
    value for that metric and is left out.
    """
    if metric in RETRIEVAL_METRICS:
        r, g = F.col("ranked"), F.col("gold")
        wanted = F.array_union(g, F.coalesce("supporting", F.array().cast(rows.schema["gold"].dataType)))
        value = {"hit": m.hit(r, g, k), "coverage": m.coverage(r, wanted, k), "recall": m.recall(r, g, k)}[metric]
        return rows.where(F.size("gold") > 0).select("arm", "id", value.alias("v"))
    values = {"correct": (F.col("score") >= 4).cast("double"), "claim_grounding": claim_rate(), "hallucination_hard": F.col("hallucination.hard_rate"), "hallucination_soft": F.col("hallucination.soft_rate")}
    if metric not in values:
        raise ValueError(f"no metric named {metric!r}; there are {', '.join((*RETRIEVAL_METRICS, *values))}")
    return rows.select("arm", "id", values[metric].alias("v")).where("v is not null")


def analyse(values: DataFrame, metric: str, resamples: int = stats.RESAMPLES) -> dict[str, DataFrame]:
    """Intervals per arm, the family of contrasts with Holm's correction, and the interaction with its interval.

    Hits and coverage are compared by McNemar's test, all other outcomes by sign flips. The
    mixed-effects model is for outcomes of 0 and 1; rates have none.
    """
    family, test = (RETRIEVAL_CONTRASTS, "mcnemar") if metric in BINARY else (ANSWER_CONTRASTS, "permutation")
    wide = stats.four_way(values, INTERACTION)
    a1, a2, a3, a4 = (F.col(x) for x in INTERACTION)
    report = {
        "per_arm": stats.bootstrap(values, resamples, by=["arm"]),
        "contrasts": stats.contrasts(values, family, test=test, resamples=resamples),
        "interaction": stats.bootstrap(wide.select("id", ((a4 - a3) - (a2 - a1)).alias("v")), resamples),
    }
    return report | ({"mixed_effects": stats.mixed_effects(wide, INTERACTION)} if metric in (*BINARY, "correct") else {})


def section_pools(sections: DataFrame) -> DataFrame:
    """Sections (section_id, text, book, title numbers) with the pools that they belong to and their stratum."""
    text, book = F.col("text"), F.col("book")
    penalty = text.contains(fn.OFFENCE_CUE)
    pools = {"lookup": book.isin("2", "3"), "penalty": penalty & book.isin("2", "3"), "definition": (F.col("section_id") == "1") | fn.contains_any(text, fn.DEFINITION_CUES), "exception": fn.contains_any(text, fn.EXCEPTION_CUES), "multi_hop": penalty & (book == "2")}
    stratum = F.concat(F.lit("B"), F.coalesce("book", F.lit("?")), F.lit(".T"), F.coalesce("title", F.lit("-")))
    return sections.withColumns({"stratum": stratum, "pools": F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in pools.items()]))})


def draft_tasks(sections: DataFrame, targets: dict[str, int], provisions: list[str], topics: list[str], floor: int = 255, seed: int = 1, limit: int = 0) -> DataFrame:
    """question_type, gold, supporting, topic of planned items: strata dealt round-robin, pairs and topics cycled, lookups topped up.

    With ``limit``, the first so many tasks in the order of their types, gold ids and topics.
    """
    spark = sections.sparkSession
    pools = section_pools(sections)
    of = lambda name: pools.where(F.array_contains("pools", name))
    empty = F.array().cast("array<string>")
    shape = lambda df, kind, supporting=empty, topic=None: df.select(F.lit(kind).alias("question_type"), F.array("section_id").alias("gold"), supporting.alias("supporting"), F.lit(topic).cast("string").alias("topic"))
    pick = lambda rows, n: evalset.stratified(rows, "section_id", "stratum", n, seed)
    lookups = pick(of("lookup"), targets.get("lookup", 0))
    parts = [shape(lookups, "lookup")] + [shape(pick(of(t), targets.get(t, 0)), t) for t in ("penalty", "exception")]
    words = ordering.numbered(of("definition").select("section_id"), ["section_id"], "o")
    n = max(1, words.count())
    parts.append(shape(evalset.cycled(spark.range(targets.get("definition", 0)).select(F.col("id").alias("i")), words, n), "definition"))
    options = spark.createDataFrame(list(enumerate(provisions)), "o long, provision string")
    hops = evalset.cycled(pick(of("multi_hop"), targets.get("multi_hop", 0)).withColumn("i", F.col("picked") - 1), options, max(1, len(provisions)))
    known = hops.join(sections.select(F.col("section_id").alias("provision")), "provision", "left_semi")
    parts.append(shape(known, "multi_hop", F.array("provision")))
    themes = spark.createDataFrame(list(enumerate(topics)), "o long, topic string")
    none = evalset.cycled(spark.range(targets.get("unanswerable", 0)).select(F.col("id").alias("i")), themes, max(1, len(topics)))
    parts.append(none.select(F.lit("unanswerable").alias("question_type"), empty.alias("gold"), empty.alias("supporting"), "topic"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    short = max(0, floor - out.count())
    more = pick(of("lookup").join(lookups.select("section_id"), "section_id", "left_anti"), short)
    tasks = out.unionByName(shape(more, "lookup"))
    return tasks.orderBy("question_type", "gold", "topic").limit(limit) if limit else tasks


def draft_items(tasks: DataFrame, sections: DataFrame, drafter: Drafter, label: str, prefix: str = "item", start: int = 1) -> DataFrame:
    """Evaluation items that a model drafts for tasks; what can't be read of its answers is left out."""
    ids = F.transform(F.concat("gold", "supporting"), lambda x: x)
    planned = ordering.numbered(tasks, ["question_type", "gold", "topic"], "pos")
    parts = planned.select("pos", F.posexplode(ids).alias("n", "section_id")).join(sections.select("section_id", "heading", "text"), "section_id")
    texts = parts.groupBy("pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", fn.content(F.col("heading"), F.col("text")).alias("t")))), lambda x: x["t"]), "\n\n").alias("context"))
    rows = planned.join(texts, "pos", "left")
    prompt = F.concat_ws("\n", F.concat(F.lit("[Type] "), F.col("question_type")), F.concat(F.lit("[Topic] "), F.col("topic")), F.concat(F.lit("[Sections]\n"), F.coalesce("context", F.lit(fn.NO_CONTEXT))))
    return evalset.assembled(rows.withColumn("answer", drafter.draft(prompt)), label, prefix, start)


def audit_worksheet(answers: DataFrame, fraction: float = 0.2, seed: int = stats.SEED) -> DataFrame:
    """A share of all answers, one at least, with empty columns for a person's judgement."""
    rows = answers.withColumns({"__key": F.concat_ws("/", "id", "arm"), "__all": F.lit(0)})
    picked = judge.audit_sample(rows, "__key", ["__all"], fraction, seed)
    return picked.select("id", "arm", "question", "answer", *[F.lit("").alias(c) for c in ("human_correct_1to5", "human_correct_bool", "notes")])


def audit_agreement(worksheet: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One row: how many filled rows have a verdict, kappa of right and wrong, and rho of the scores."""
    met = worksheet.join(verdicts.where("score is not null").select("id", "arm", "score"), ["id", "arm"])
    said, scored = F.trim("human_correct_bool"), F.trim("human_correct_1to5")
    flags = met.where(said.isin("0", "1")).select(said.cast("int").alias("human"), (F.col("score") >= 4).cast("int").alias("judge"))
    scores = met.where(scored.rlike("^[0-9]+$")).select(scored.cast("int").alias("human"), F.col("score").alias("judge"))
    return judge.kappa(flags, "human", "judge").withColumnRenamed("n", "n_binary").crossJoin(judge.spearman(scores, "human", "judge").withColumnRenamed("n", "n_scores"))  # one row each


def chart_frames(rankings: DataFrame | None = None, verdicts: DataFrame | None = None, k: int = 5) -> dict[str, DataFrame]:
    """What the charts show: arm, measure and value of rankings and of verdicts."""
    long = lambda df, names: df.select("arm", F.explode(F.array(*[F.struct(F.lit(n).alias("measure"), F.col(n).cast("double").alias("value")) for n in names])).alias("x")).select("arm", "x.measure", "x.value")
    out = {}
    if rankings is not None:
        out["retrieval"] = long(score_rankings(rankings, k), ["recall", "coverage", "support_recall"])
    if verdicts is not None:
        means = verdicts.groupBy("arm").agg(F.avg((F.col("score") >= 4).cast("int")).alias("correct"), F.avg(claim_rate()).alias("claim_grounding"))
        out["answers"] = long(means, ["correct", "claim_grounding"])
    return out


def gate(items: DataFrame, known: DataFrame | None = None) -> tuple[bool, DataFrame]:
    """Whether an evaluation set is free of violations, and those it has."""
    found = evalset.violations(items, known)
    return found.isEmpty(), found
