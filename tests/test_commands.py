"""Commands end to end on a small statute."""

import json

from pyspark.sql import functions as F

from spindrift.operators import hierarchy, retrieval
from spindrift.plans import commands as c

OFFENCE = "ต้องระวางโทษจำคุก"


def corpus(spark):
    num = lambda b, t: ({"number": b, "heading": f"book {b}"}, {"number": t, "heading": f"title {t}"} if t else None)
    rows = [("1", 0, "h", "หมายความว่า", *num("1", "1"), None), ("80", 1, "h", "มาตรา ๒๘๘", *num("1", "2"), None)]
    rows += [(str(280 + i), 2 + i, "h", f"{OFFENCE} มาตรา {280 + (i + 1) % 6} และ มาตรา 999", *num("2", str(i % 3)), None) for i in range(6)] + [("367", 9, "h", "ปรับ ระวางโทษ", *num("3", None), None)]
    unit = "struct<number:string,heading:string>"
    return spark.createDataFrame(rows, f"section_id string, pos long, heading string, text string, book {unit}, title {unit}, chapter {unit}")


def test_ingest(spark, tmp_path):
    (tmp_path / "a.csv").write_text("article,text,notes\nintro,ignored,\n1,one,\n2,two,\n3,three,\n")
    (tmp_path / "u.json").write_text(json.dumps([{"level": "book", "number": "1", "heading": "b", "start": "1"}, {"level": "title", "number": "7", "heading": "t", "start": "2"}, {"level": "part", "number": "1", "heading": "p", "start": "nowhere"}]))
    out = c.ingest_articles(spark, str(tmp_path / "a.csv"), str(tmp_path / "u.json"))
    got = {r.section_id: r for r in out["sections"].collect()}
    assert [got[i].node_id for i in "123"] == ["B1.S1", "B1.T7.S2", "B1.T7.S3"] and got["1"].title is None and got["3"].title.heading == "t"
    assert out["introduction"].count() == 1 and [r.start for r in out["lost_units"].collect()] == ["nowhere"]
    r = out["report"].first()
    assert (r.n_rows, r.with_book, r.with_title, r.missing_title) == (3, 3, 2, ["1"])
    tree = json.loads(hierarchy.nested(out["tree"], 5).first()[0])
    assert tree["node"] == "root" and tree["nodes"][0]["node"] == "root.B1"


def test_graph_and_rules(spark):
    s = corpus(spark)
    g = c.build_graph(s)
    counts = {r.type: r.n for r in g["counts"].collect()}
    assert counts["CITES"] == 13 and g["edges"].where("type = 'CITES' and not resolved").count() == 7
    assert {r.dst for r in g["edges"].where("src = 'Section:367' and type = 'HAS_PENALTY'").collect()} == {"Penalty:fine"}
    rules = spark.createDataFrame([("attempt", ["80"], "book2", True, None, None), ("all", ["1"], "all_offences", False, None, None)], "label string, general_sections array<string>, scope string, verified boolean, targets array<string>, note string")
    flat = s.withColumn("book", F.col("book.number"))
    assert c.expand_rules(flat, rules)["edges"].count() == 6 + 7
    assert c.expand_rules(flat, rules, verified_only=True)["edges"].count() == 6


def test_tasks_and_gate(spark):
    s = corpus(spark).withColumns({"book": F.col("book.number"), "title": F.col("title.number")})
    tasks = c.draft_tasks(s, {"lookup": 3, "penalty": 2, "definition": 3, "multi_hop": 4, "unanswerable": 2, "exception": 1}, ["80", "none"], ["tax"], floor=16)
    got = {r.question_type: r.n for r in tasks.groupBy("question_type").agg(F.count("*").alias("n")).collect()}
    assert got == {"lookup": 3 + 4, "penalty": 2, "definition": 3, "multi_hop": 2, "unanswerable": 2}
    looked = [r.gold[0] for r in tasks.where("question_type = 'lookup'").collect()]
    assert len(set(looked)) == len(looked)
    ok, found = c.gate(spark.createDataFrame([("a", 0, "question", "lookup", ["1"], [])], "id string, pos int, question string, question_type string, gold array<string>, supporting array<string>"))
    assert ok and found.count() == 0


def test_retrieve_generate_judge_analyse(spark):
    docs = spark.createDataFrame([("1", "red apple pie"), ("2", "green pear tart"), ("3", "apple green tea")], "item_id string, text string")
    queries = spark.createDataFrame([("a", "red apple"), ("b", "pear"), ("u", "nothing")], "query_id string, text string")
    items = spark.createDataFrame([("a", "lookup", ["1"], ["3"]), ("b", "lookup", ["2"], []), ("u", "unanswerable", [], [])], "id string, question_type string, gold array<string>, supporting array<string>")
    run = c.run_retrieval(retrieval.Context(docs, queries), items, ["keyword"], 2)
    m = run["metrics"].first()
    assert (m.arm, m.n, m.n_multihop, m.hit, m.mrr, m.support_recall) == ("R0", 2, 1, 1.0, 1.0, 1.0)
    answers = c.run_generation(run["rankings"], docs, queries.withColumnsRenamed({"query_id": "id", "text": "question"}), 1)
    assert {r.id: r.context for r in answers.collect()} == {"a": "red apple pie", "b": "green pear tart"}
    refs = spark.createDataFrame([("a", "apple pie", ["red apple", "blue"]), ("b", "pear", None)], "id string, reference_answer string, answer_claims array<string>")
    out = c.run_judge(answers, docs.select(F.col("item_id").alias("id")), refs)
    v = {r.id: r for r in out["verdicts"].collect()}
    assert v["a"].grounded == [True, False] and v["a"].score == 5 and v["b"].grounded == []
    assert out["means"].first().claim_rate == 0.5
    values = c.outcomes(run["rankings"], "hit", 2)
    four = None
    for arm in c.INTERACTION:
        part = values.withColumn("arm", F.lit(arm))
        four = part if four is None else four.unionByName(part)
    report = c.analyse(four, "hit", resamples=40)
    assert report["per_arm"].count() == 4 and report["interaction"].first().mean == 0.0
    assert {r.name for r in report["contrasts"].collect()} == {"tree vs hybrid", "graph on hybrid", "graph on tree", "full vs hybrid"}
