"""Command lines: ``python -m spindrift.cli <command>``. Each reads files, runs a plan and writes its tables.

Outputs are folders of part files, as Spark writes them; reports and charts are small and go to one
file. ``check`` ends with status 1 if an evaluation set has violations, and so does any command whose
input is not there.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as fn
from .operators import evalset, graph, models, ordering
from .operators import retrieval as r
from .operators.hierarchy import nested, tree_from_paths
from .plans import commands as c
from .sources import charts, io

ALL_ARMS = ("R0", "R1", "A1", "A2", "A3", "A4", "A4B", "A5")
ALL_ANALYSED = ("C0", "C1", "R0", "R1", "A1", "A2", "A3", "A4")
METRICS = ("hit", "coverage", "correct", "claim_grounding", "hallucination_hard")
BATCHED = {"embedder": models.BatchedEmbedder, "reranker": models.BatchedReranker, "generator": models.BatchedGenerator, "judge": models.BatchedJudge, "drafter": models.BatchedDrafter}


def read_text(spark: SparkSession, path: str) -> str:
    """One small file, wherever Spark can read it."""
    found = spark.read.text(path, wholetext=True).first()
    if found is None:
        raise FileNotFoundError(path)
    return found[0]


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """One small file, wherever Spark can write."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def config(spark: SparkSession, path: str | None) -> dict:
    return json.loads(read_text(spark, path)) if path else {}


def backend(cfg: dict, slot: str, default=None):
    """The model of a slot: a class by ``module:Class`` whose methods get batches, the default, or one that isn't set."""
    spec = cfg.get("backends", {}).get(slot)
    if spec and slot in BATCHED:
        return BATCHED[slot](spec)
    return models.load(spec, default if default is not None else models.Unset(slot))


def sections_of(spark: SparkSession, path: str) -> DataFrame:
    """Sections with their levels as they were written, in the files' order."""
    return ordering.in_file_order(spark.read.schema(io.SECTION).json(path), "pos")


def items_of(spark: SparkSession, path: str) -> DataFrame:
    return io.read_items(spark, path).withColumnsRenamed({"gold_sections": "gold", "supporting_sections": "supporting"})


def ingest_csv(spark: SparkSession, a: argparse.Namespace) -> int:
    out = c.ingest_articles(spark, a.csv, a.hierarchy)
    full = out["sections"].select("section_id", "node_id", "heading", "text", *c.LEVELS)
    io.write_jsonl(full, f"{a.out_dir}/sections.jsonl")
    io.write_jsonl(out["introduction"], f"{a.out_dir}/introduction.jsonl")
    io.write_lines(nested(out["tree"], len(c.LEVELS) + 1), f"{a.out_dir}/tree.json")
    io.write_lines(io.report(out["report"]), f"{a.out_dir}/report")
    lost = [x["start"] for x in out["lost_units"].select("start").limit(20).collect()]
    print(*[f"unit without a section: {x}" for x in lost], f"wrote {a.out_dir}/sections.jsonl", sep="\n")
    return 0


def ingest_text(spark: SparkSession, a: argparse.Namespace) -> int:
    found = c.ingest_text(spark, a.input)
    io.write_jsonl(found, f"{a.out_dir}/sections.jsonl")
    flat = found.select(F.col("pos"), "section_id", "heading", "text", *[F.col(f"{x}.number").alias(x) for x in c.LEVELS])
    tree = tree_from_paths(ordering.numbered(flat, ["pos", "section_id"], "nr"), c.LEVELS, "nr", F.concat_ws(" ", "heading", "text"))
    io.write_lines(nested(tree, len(c.LEVELS) + 1), f"{a.out_dir}/tree.json")
    return 0


def build_graph(spark: SparkSession, a: argparse.Namespace) -> int:
    out = c.build_graph(sections_of(spark, a.sections), a.qualified, a.dedupe)
    io.write_jsonl(out["nodes"], f"{a.out_dir}/kg_nodes.jsonl")
    io.write_jsonl(out["edges"], f"{a.out_dir}/kg_edges.jsonl")
    io.write_lines(graph.cypher_nodes(out["nodes"], "label", "id", ["number", "heading"]), f"{a.out_dir}/kg_nodes.cypher")
    print(*[f"{x['type']}: {x['n']}" for x in out["counts"].orderBy("type").collect()], sep="\n")  # a row per type
    return 0


def expand_rules(spark: SparkSession, a: argparse.Namespace) -> int:
    flat = sections_of(spark, a.sections).withColumn("book", F.col("book.number"))
    out = c.expand_rules(flat, io.read_rules(spark, a.rules), a.verified_only)
    named = {x: F.concat(F.lit("Section:"), x) for x in ("src", "dst")}
    io.write_jsonl(out["edges"].withColumns(named), f"{a.out_dir}/applies_to_edges.jsonl")
    io.write_csv(out["review"], f"{a.out_dir}/applies_to_review.csv")
    print(*[f"{x['label']}: {x['n']}" for x in out["stats"].collect()], sep="\n")  # a row per rule
    print(*[f"not in the corpus: {x['id']} ({x['rule']})" for x in out["problems"].limit(100).collect()], sep="\n")
    return 0


def context(spark: SparkSession, cfg: dict, items: DataFrame) -> r.Context:
    full = sections_of(spark, cfg["sections_path"])
    flat = full.select("section_id", "pos", "heading", "text", *[F.col(f"{x}.number").alias(x) for x in c.LEVELS])
    docs = full.select(F.col("section_id").alias("item_id"), fn.content(F.col("heading"), F.col("text")).alias("text"))
    asked = items.where("question_type <> 'unanswerable'").select(F.col("id").alias("query_id"), F.col("question").alias("text"))
    edges = None
    for name, kinds in (("cites_edges_path", ["CITES"]), ("applies_to_edges_path", ["APPLIES_TO"])):
        if cfg.get(name):
            part = io.read_edges(spark, cfg[name], kinds, cfg.get("verified_applies_to_only", False)).select("src", "dst")
            edges = part if edges is None else edges.unionByName(part)
    tree = tree_from_paths(flat, c.LEVELS, "pos", F.concat_ws(" ", "heading", "text")).drop("item_id")
    tree = tree.join(flat.select(F.concat(F.lit(".S"), F.col("pos").cast("string")).alias("__end"), F.col("section_id").alias("item_id")), F.col("is_leaf") & (F.regexp_extract("node", r"(\.S[0-9]+)$", 1) == F.col("__end")), "left").drop("__end")
    embed = backend(cfg, "embedder", models.HashEmbedder()).encode
    rerank = cfg.get("backends", {}).get("reranker")
    vectors = lambda df, key: df.select(key, embed(F.col("text")).alias("vector"))
    return r.Context(docs, asked, vectors(docs, "item_id"), vectors(asked, "query_id"), tree, graph.symmetric(edges) if edges is not None else spark.createDataFrame([], "src string, dst string"), reserve=cfg.get("reserve", 1), width=cfg.get("beam", 5), score=models.BatchedReranker(rerank).score if rerank else None, navigator=backend(cfg, "navigator", models.Descent(cfg.get("beam", 5))), tokens=fn.tokenizer(cfg.get("tokenizer", "char_ngram")))


def retrieve(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg, items = config(spark, a.config), items_of(spark, a.eval)
    arms = list(ALL_ARMS) if a.arms == "all" else [r.arm_id(x.strip()) for x in a.arms.split(",")]
    out = c.run_retrieval(context(spark, cfg, items), items, arms, cfg.get("k", 5))
    for arm in arms:
        rows = out["rankings"].where(F.col("arm") == arm).select("id", "ranked", "gold", "supporting", F.create_map(F.lit("arm"), F.col("arm")).alias("meta"))
        io.write_jsonl(rows, f"{a.out_dir}/{arm}.jsonl")
    io.write_lines(io.report(out["metrics"]), f"{a.out_dir}/metrics")
    return 0


def read_arms(spark: SparkSession, folder: str, arms: list[str], schema: str) -> DataFrame:
    """Rows of an arm's folder or file each, with ``arm``."""
    out = None
    for arm in arms:
        part = spark.read.schema(schema).json(f"{folder}/{arm}.jsonl").withColumn("arm", F.lit(arm))
        out = part if out is None else out.unionByName(part)
    return out


ANSWER = "id string, arm string, question string, question_type string, context_ids array<string>, context string, answer string, gold array<string>, supporting array<string>"
VERDICT = "id string, question_type string, answer string, hallucination struct<cited:array<string>,hard:array<string>,soft:array<string>,hard_rate:double,soft_rate:double>, grounded array<boolean>, score int, refused boolean"


def generate(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg, items = config(spark, a.config), items_of(spark, a.eval)
    docs = sections_of(spark, cfg["sections_path"]).select(F.col("section_id").alias("item_id"), fn.content(F.col("heading"), F.col("text")).alias("text"))
    for arm in a.arms.split(","):
        arm = r.arm_id(arm.strip())
        asked = items.select("id", "question_type", "gold", "supporting").withColumn("arm", F.lit(arm))
        if arm in ("C0", "C1"):
            ranked = asked.withColumn("ranked", F.array().cast("array<string>"))
        else:
            ranked = asked.join(spark.read.schema(io.RANKING).json(f"{a.results_dir}/{arm}.jsonl").select("id", "ranked"), "id", "left").withColumn("ranked", F.coalesce("ranked", F.array().cast("array<string>")))
        answers = c.run_generation(ranked, docs, items, cfg.get("k", 5), backend(cfg, "generator", models.EchoGenerator()))
        io.write_jsonl(answers.select(*[x.split()[0] for x in ANSWER.split(", ")]), f"{a.out_dir}/{arm}.jsonl")
    return 0


def judged(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg, items = config(spark, a.config), items_of(spark, a.eval)
    known = sections_of(spark, cfg["sections_path"]).select(F.col("section_id").alias("id"))
    references = items.select("id", "reference_answer", "answer_claims")
    for arm in a.arms.split(","):
        arm = r.arm_id(arm.strip())
        answers = spark.read.schema(ANSWER).json(f"{a.answers_dir}/{arm}.jsonl")
        out = c.run_judge(answers, known, references, model=backend(cfg, "judge", models.LexicalJudge()))
        io.write_jsonl(out["verdicts"], f"{a.out_dir}/{arm}.jsonl")
        print(*[json.dumps(x.asDict()) for x in out["means"].collect()], sep="\n")  # a row per arm
    return 0


def audit(spark: SparkSession, a: argparse.Namespace) -> int:
    if a.make:
        io.write_csv(c.audit_worksheet(spark.read.schema(ANSWER).json(f"{a.answers_dir}/*.jsonl"), a.frac), a.worksheet)
        return 0
    schema = "id string, arm string, question string, answer string, human_correct_1to5 string, human_correct_bool string, notes string"
    sheet = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(a.worksheet)
    verdicts = spark.read.schema(f"{VERDICT}, arm string").json(f"{a.verdicts_dir}/*.jsonl")
    print(json.dumps(c.audit_agreement(sheet, verdicts).first().asDict()))
    return 0


def analyse(spark: SparkSession, a: argparse.Namespace) -> int:
    wanted = list(ALL_ANALYSED) if a.arms == "all" else [r.arm_id(x.strip()) for x in a.arms.split(",")]
    retrieval = a.metric in c.BINARY
    folder = a.results_dir if retrieval else a.verdicts_dir
    there = [x for x in wanted if exists(spark, f"{folder}/{x}.jsonl")]
    if not there:
        print(f"no outputs of arms in {folder}", file=sys.stderr)
        return 1
    rows = read_arms(spark, folder, there, io.RANKING if retrieval else VERDICT)
    out = c.analyse(c.outcomes(rows, a.metric, a.k), a.metric, a.resamples)
    lists = {name: [x.asDict() for x in df.collect()] for name, df in out.items() if a.glmm or name != "mixed_effects"}  # a row per arm, contrast or term
    write_text(spark, f"{a.out_dir}/report.{a.metric}.json", json.dumps({"metric": a.metric, "k": a.k, **lists}, indent=1, ensure_ascii=False))
    return 0


def draw(spark: SparkSession, a: argparse.Namespace) -> int:
    found = lambda folder, schema: spark.read.schema(schema).json(f"{a.run}/{folder}/*.jsonl").withColumn("arm", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.jsonl", 1)) if exists(spark, f"{a.run}/{folder}") else None
    for name, frame in c.chart_frames(found("retrieval", io.RANKING), found("verdicts", VERDICT), a.k).items():
        write_text(spark, f"{a.run}/figs/{name}.svg", charts.bar_chart(frame, name))
    return 0


def draft(spark: SparkSession, a: argparse.Namespace) -> int:
    cfg = config(spark, a.config)
    full = sections_of(spark, a.sections)
    flat = full.withColumns({"book": F.col("book.number"), "title": F.col("title.number")})
    topics = [x if isinstance(x, str) else str(x) for x in cfg.get("unanswerable_topics", [])]
    tasks = c.draft_tasks(flat, cfg["targets"], [x["section_id"] for x in cfg.get("general_provisions", [])], topics, cfg.get("floor", 255), limit=a.limit)
    targets = spark.createDataFrame(sorted(cfg["targets"].items()), "question_type string, target int")
    for x in evalset.plan_report(tasks, targets).orderBy("question_type").collect():  # a row per type
        print(f"{x['question_type']}: {x['planned']} of {x['target']}{' (short)' if x['short'] else ''}")
    if not a.dry_run:
        spec = cfg.get("backends", {}).get("drafter")
        io.write_jsonl(c.draft_items(tasks, full, backend(cfg, "drafter"), spec or "unset", cfg.get("id_prefix", "item"), cfg.get("id_start", 1)), a.out)
    return 0


def check(spark: SparkSession, a: argparse.Namespace) -> int:
    lines = ordering.in_file_order(spark.read.text(a.eval_set), "pos")
    items = ordering.in_file_order(io.read_items(spark, a.eval_set), "pos").withColumnsRenamed({"gold_sections": "gold", "supporting_sections": "supporting"})
    known = sections_of(spark, a.sections).select(F.col("section_id").alias("id")) if a.sections else None
    good, found = c.gate(items, known)
    shape = evalset.schema_violations(lines)
    for x in shape.orderBy("pos", "rule").limit(100).collect():
        print(f"line {x['pos'] + 1}: {x['rule']}")
    for x in found.orderBy("id", "rule").limit(100).collect():
        print(f"{x['id']}: {x['rule']}")
    for x in evalset.type_distribution(items).orderBy("question_type").collect():  # a row per type
        print(f"{x['question_type']}: {x['n']}")
    return 0 if good and shape.isEmpty() else 1


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spindrift")
    add = top.add_subparsers(dest="command", required=True).add_parser

    def command(name: str, run: Callable, *args: tuple[str, dict]) -> None:
        p = add(name)
        p.set_defaults(handler=run)
        for flag, options in args:
            p.add_argument(flag, **options)

    flag, out = {"action": "store_true"}, ("--out-dir", {"default": "data"})
    command("ingest-csv", ingest_csv, ("csv", {}), ("--hierarchy", {"required": True}), out)
    command("ingest-text", ingest_text, ("input", {}), out)
    command("graph", build_graph, ("sections", {}), out, ("--qualified", flag), ("--dedupe", flag))
    command("rules", expand_rules, ("sections", {}), ("--rules", {"required": True}), out, ("--verified-only", flag))
    command("retrieve", retrieve, ("--config", {"required": True}), ("--eval", {"required": True}), ("--arms", {"default": "R0"}), ("--out-dir", {"default": "retrieval"}))
    command("generate", generate, ("--config", {"required": True}), ("--eval", {"required": True}), ("--arms", {"default": "C1"}), ("--results-dir", {"default": "retrieval"}), ("--out-dir", {"default": "answers"}))
    command("judge", judged, ("--config", {"required": True}), ("--eval", {"required": True}), ("--arms", {"default": "C1"}), ("--answers-dir", {"default": "answers"}), ("--out-dir", {"default": "verdicts"}))
    command("audit", audit, ("--make", flag), ("--agreement", flag), ("--answers-dir", {"default": "answers"}), ("--verdicts-dir", {"default": "verdicts"}), ("--worksheet", {"default": "audit_worksheet.csv"}), ("--frac", {"type": float, "default": 0.2}))
    command("analyse", analyse, ("--metric", {"choices": METRICS, "default": "hit"}), ("--k", {"type": int, "default": 5}), ("--arms", {"default": "all"}), ("--results-dir", {"default": "retrieval"}), ("--verdicts-dir", {"default": "verdicts"}), ("--out-dir", {"default": "analysis"}), ("--glmm", flag), ("--resamples", {"type": int, "default": 10_000}))
    command("charts", draw, ("--run", {"required": True}), ("--k", {"type": int, "default": 5}))
    command("draft", draft, ("--config", {"required": True}), ("--sections", {"required": True}), ("--out", {"default": "eval_set.generated.jsonl"}), ("--dry-run", flag), ("--limit", {"type": int, "default": 0}))
    command("check", check, ("eval_set", {}), ("--sections", {"default": None}))
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    top = parser()
    args = top.parse_args(argv)
    if args.command == "audit" and args.make == args.agreement:
        top.error("choose --make or --agreement")
    session = spark or SparkSession.builder.appName(f"spindrift {args.command}").getOrCreate()
    return args.handler(session, args)


if __name__ == "__main__":
    sys.exit(main())
