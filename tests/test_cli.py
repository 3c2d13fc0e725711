"""The command lines one after another on a small statute, and models behind slots."""

import csv
import json

import pytest
from pyspark.sql import functions as F

from spindrift import cli
from spindrift.functions import text as fn
from spindrift.operators import evalset, models, retrieval
from spindrift.plans import commands as c


def lines(folder):
    return [json.loads(x) for part in sorted(folder.glob("part-*.json")) for x in part.read_text().splitlines() if x]


@pytest.fixture(scope="module")
def place(tmp_path_factory):
    p = tmp_path_factory.mktemp("cli")
    rows = [("intro", "Act of one"), ("1", "มาตรา 1 apple หมายความว่า a fruit"), ("2", "มาตรา 2 ต้องระวางโทษจำคุก for pears, มาตรา 1"), ("3", "มาตรา 3 ต้องระวางโทษปรับ for plums มาตรา 2 ถึง 3"), ("4", "มาตรา 4 ศาลจะไม่ลงโทษ grapes"), ("null", "junk")]
    with open(p / "a.csv", "w", newline="") as f:
        w = csv.writer(f)
        w.writerow(["article", "text", "notes"])
        w.writerows([*r, ""] for r in rows)
    unit = lambda level, n, start: {"level": level, "number": n, "heading": f"{level} {n}", "start": start}
    (p / "u.json").write_text(json.dumps([unit("book", "1", "1"), unit("book", "2", "2"), unit("title", "1", "3"), unit("part", "9", "none")]))
    (p / "rules.json").write_text(json.dumps({"rules": [{"label": "all", "general_sections": ["1", "77"], "scope": "all_offences", "verified": True}, {"label": "hand", "general_sections": ["4"], "scope": "needs_review", "verified": False, "note": "n"}]}))
    (p / "plan.json").write_text(json.dumps({"targets": {"lookup": 2, "penalty": 1, "definition": 1, "exception": 1, "multi_hop": 1, "unanswerable": 1}, "general_provisions": [{"section_id": "1", "label": "x"}], "unanswerable_topics": ["tax"], "id_prefix": "t", "id_start": 5, "floor": 6, "backends": {"drafter": "tests.fake_models:Drafter"}}))
    (p / "run.json").write_text(json.dumps({"sections_path": f"{p}/data/sections.jsonl", "k": 2, "cites_edges_path": f"{p}/data/kg_edges.jsonl", "applies_to_edges_path": f"{p}/data/applies_to_edges.jsonl", "backends": {"embedder": "tests.fake_models:Vectors", "reranker": "tests.fake_models:Scores", "generator": "tests.fake_models:Upper", "judge": "tests.fake_models:Judge"}}))
    return p


def test_commands_in_turn(spark, place, capsys):
    run = lambda *a: cli.main([str(x) for x in a], spark)
    data = place / "data"
    assert run("ingest-csv", place / "a.csv", "--hierarchy", place / "u.json", "--out-dir", data) == 0
    sections = {s["section_id"]: s for s in lines(data / "sections.jsonl")}
    assert sorted(sections) == ["1", "2", "3", "4"] and sections["3"]["node_id"] == "B2.T1.S3" and "unit without a section: none" in capsys.readouterr().out
    assert run("graph", data / "sections.jsonl", "--out-dir", data) == 0
    nodes = {n["id"]: n for n in lines(data / "kg_nodes.jsonl")}
    assert {"Book:1", "Book:2", "Title:1", "Section:4", "Penalty:fine", "Penalty:imprisonment"} == {*nodes} - {"Section:1", "Section:2", "Section:3"} and nodes["Penalty:fine"]["class"] == "fine"
    assert run("rules", data / "sections.jsonl", "--rules", place / "rules.json", "--out-dir", data, "--verified-only") == 0
    assert "not in the corpus: 77 (all)" in capsys.readouterr().out
    assert {(e["src"], e["dst"]) for e in lines(data / "applies_to_edges.jsonl")} == {("Section:1", "Section:2"), ("Section:1", "Section:3")}
    assert run("draft", "--config", place / "plan.json", "--sections", data / "sections.jsonl", "--dry-run") == 0
    assert "multi_hop: 1 of 1" in capsys.readouterr().out and not (place / "set.jsonl").exists()
    assert run("draft", "--config", place / "plan.json", "--sections", data / "sections.jsonl", "--out", place / "set.jsonl") == 0
    items = lines(place / "set.jsonl")
    assert [i["id"] for i in items] == [f"t-{5 + n:04d}" for n in range(len(items))] and len(items) >= 6 and items[0]["difficulty"] == "medium"
    assert all(i["answer_claims"] == ([] if i["question_type"] == "unanswerable" else ["a", "b"]) for i in items)
    assert run("check", place / "set.jsonl", "--sections", data / "sections.jsonl") == 0
    (place / "bad.jsonl").write_text(json.dumps(items[0] | {"more": 1, "difficulty": "odd", "gold_sections": ["404"]}) + "\n" + json.dumps({"id": 3, "question": "why"}) + "\n[1]\n")
    assert run("check", place / "bad.jsonl", "--sections", data / "sections.jsonl") == 1
    said = capsys.readouterr().out
    for text in ("line 1: unknown field more", "line 1: bad difficulty", "line 2: missing gold_sections", "line 2: id is no string", "line 2: short question", "line 3: not an object", "unknown section 404"):
        assert text in said, text
    assert run("retrieve", "--config", place / "run.json", "--eval", place / "set.jsonl", "--arms", "R0,A1,A2,pi,hybrid+pi+kg", "--out-dir", place / "retrieval") == 0
    for arm in ("R0", "A1", "A2", "A3", "A4B"):
        rows = lines(place / "retrieval" / f"{arm}.jsonl")
        assert len(rows) == sum(i["question_type"] != "unanswerable" for i in items) and all(len(x["ranked"]) <= 2 and x["meta"] == {"arm": arm} for x in rows), arm
    assert any(x["ranked"] for x in lines(place / "retrieval" / "A3.jsonl"))
    for arms in ("C0,C1", "hybrid,R0"):
        assert run("generate", "--config", place / "run.json", "--eval", place / "set.jsonl", "--arms", arms, "--results-dir", place / "retrieval", "--out-dir", place / "answers") == 0
        assert run("judge", "--config", place / "run.json", "--eval", place / "set.jsonl", "--arms", arms, "--answers-dir", place / "answers", "--out-dir", place / "verdicts") == 0
    answers = lines(place / "answers" / "C1.jsonl")
    assert len(answers) == len(items) and all(x["answer"].startswith("[CONTEXT]") for x in answers)
    capsys.readouterr()
    assert run("audit", "--make", "--answers-dir", place / "answers", "--worksheet", place / "sheet.csv", "--frac", "1.0") == 0
    sheet = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(place / "sheet.csv"))
    assert sheet.count() == 4 * len(items)
    filled = sheet.withColumns({"human_correct_bool": F.lit("1"), "human_correct_1to5": F.lit("4")})
    filled.write.option("header", True).option("escape", '"').csv(str(place / "filled.csv"))
    assert run("audit", "--agreement", "--worksheet", place / "filled.csv", "--verdicts-dir", place / "verdicts") == 0
    assert json.loads(capsys.readouterr().out.strip().splitlines()[-1])["n_binary"] == 4 * sum(i["question_type"] != "unanswerable" for i in items)
    for metric in ("hit", "claim_grounding"):
        assert run("analyse", "--metric", metric, "--results-dir", place / "retrieval", "--verdicts-dir", place / "verdicts", "--out-dir", place / "analysis", "--resamples", 40) == 0
        report = json.loads((place / "analysis" / f"report.{metric}.json").read_text())
        assert report["metric"] == metric and report["per_arm"] and report["contrasts"] and {x["test"] for x in report["contrasts"]} == {"mcnemar" if metric == "hit" else "permutation"}
    assert run("analyse", "--metric", "hit", "--results-dir", place / "nowhere", "--out-dir", place / "analysis") == 1
    assert run("charts", "--run", place) == 0
    assert "<rect" in (place / "figs" / "retrieval.svg").read_text() and "claim_grounding" in (place / "figs" / "answers.svg").read_text()
    with pytest.raises(SystemExit):
        run("audit")


def test_batches_and_retries(spark, monkeypatch):
    waits = []
    call = models.with_retries(lambda: 1 / 0 if len(waits) > 5 else (_ for _ in ()).throw(models.TransientError()), 9, 4.0, waits.append)
    with pytest.raises(ZeroDivisionError):
        call()
    assert len(waits) == 6 and all(0 <= w <= 5.5 for w in waits) and waits[3] >= 4
    with pytest.raises(TimeoutError):
        models.with_retries(lambda: (_ for _ in ()).throw(TimeoutError()), 2, 0, lambda s: None)()
    df = spark.range(5).select(F.concat(F.lit("apple "), F.col("id").cast("string")).alias("t"))
    got = df.select(models.BatchedEmbedder("tests.fake_models:Vectors", 2).encode(F.col("t")).alias("v")).collect()
    assert all(r.v == [7.0, 1.0, 1.0] for r in got) and len(got) == 5
    assert [r.s for r in df.select(models.BatchedReranker("tests.fake_models:Scores", 2).score(F.lit("apple 3"), F.col("t")).alias("s")).orderBy("s").collect()] == [1.0] * 4 + [2.0]


def test_python_tokenizer(spark):
    df = spark.createDataFrame([("abcd",), ("",), (None,)], "t string")
    assert [r.x for r in df.select(fn.tokenizer("tests.fake_models:halves")(F.col("t")).alias("x")).collect()] == [["ab", "cd"], [], []]
    with pytest.raises(ValueError, match="no tokenizer"):
        fn.tokenizer("nothing")


def test_selector_of_a_model(spark):
    tree = spark.createDataFrame([("r", None, 0, False, "", None), ("a", "r", 0, False, "apples", None), ("b", "r", 1, False, "pears", None), ("a1", "a", 0, True, "red", "1"), ("b1", "b", 0, True, "green", "2"), ("b2", "b", 1, True, "brown", "3")], "node string, parent string, pos int, is_leaf boolean, display string, item_id string")
    asked = spark.createDataFrame([("q", "which?")], "query_id string, text string")
    selector = models.ListedSelector(models.in_batches("tests.fake_models:LastOption", "answer", "string"))
    got = models.Descent(width=1, depth=3, selector=selector).navigate(tree, asked, 1).collect()
    assert [(r.item_id, r["rank"]) for r in got] == [("3", 1)]


def test_rerank_of_unknown_ids_returns_them(spark):
    q = spark.createDataFrame([("a", "x y"), ("b", "x")], "query_id string, text string")
    docs = spark.createDataFrame([("1", "x y"), ("2", "x"), ("3", None)], "item_id string, text string")
    pool = spark.createDataFrame([("a", "9", 1), ("a", "2", 2), ("a", "1", 3), ("a", "3", 4), ("b", "8", 2), ("b", "7", 1), ("b", "6", 3)], "query_id string, item_id string, rank int")
    got = {(r.query_id, r["rank"]): r.item_id for r in retrieval.rerank(pool, q, docs, 2).collect()}
    assert got == {("a", 1): "1", ("a", 2): "2", ("b", 1): "7", ("b", 2): "8"}


def test_outcomes_of_verdicts_and_coverage(spark):
    rows = spark.createDataFrame([("A", "1", ["a", "b"], ["a"], ["b"]), ("A", "2", ["a"], ["a"], ["z", "a"]), ("A", "3", ["a"], [], []), ("A", "4", ["a"], ["a"], None)], "arm string, id string, ranked array<string>, gold array<string>, supporting array<string>")
    assert {r.id: r.v for r in c.outcomes(rows, "coverage").collect()} == {"1": 1.0, "2": 0.0, "4": 1.0}
    flags = "struct<hard_rate:double,soft_rate:double>"
    verdicts = spark.createDataFrame([("A", "1", (0.5, 0.0), [True, False], 4), ("A", "2", (0.0, 1.0), [], None)], f"arm string, id string, hallucination {flags}, grounded array<boolean>, score int")
    want = {"correct": {"1": 1.0}, "claim_grounding": {"1": 0.5}, "hallucination_hard": {"1": 0.5, "2": 0.0}, "hallucination_soft": {"1": 0.0, "2": 1.0}}
    for metric, values in want.items():
        assert {r.id: r.v for r in c.outcomes(verdicts, metric).collect()} == values
    with pytest.raises(ValueError, match="no metric"):
        c.outcomes(verdicts, "nothing")


def test_task_limit(spark):
    rows = [(str(i), "ต้องระวางโทษ", "2", str(i % 2)) for i in range(9)]
    sections = spark.createDataFrame(rows, "section_id string, text string, book string, title string")
    assert c.draft_tasks(sections, {"lookup": 3}, [], [], floor=5, limit=2).count() == 2
    assert evalset.schema_violations(spark.createDataFrame([(0, "")], "pos int, value string")).count() == 0
