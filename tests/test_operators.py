"""Operators on literal cases."""

import hashlib
import json
import math
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.functions.text import word_tokens
from spindrift.operators import evalset, graph, hierarchy, judge, models, retrieval, stats
from spindrift.sources import io

LAW = """ภาค ๑
บทบัญญัติทั่วไป

ลักษณะ ๑
ความผิดทั่วไป
หมวด ๑

มาตรา ๑ ในกฎหมายนี้
ความหมาย
ต่อ
ภาค ๒
ความผิด
ลักษณะ ๑๐
ชีวิต
มาตรา ๒๘๘ ผู้ใดฆ่า
ภาค ๓
มาตรา ๓๓๕ ทวิ ลหุโทษ"""


def test_statute_lines(spark):
    lines = io.lines_of(spark.createDataFrame([(1, LAW)], "doc_id int, value string"))
    got = {r.section_id: r for r in hierarchy.parse_lines(lines, *hierarchy.text_patterns()).collect()}
    assert set(got) == {"1", "288", "335 ทวิ"}
    assert got["1"].text == "ในกฎหมายนี้\nความหมาย\nต่อ" and got["1"].book.heading == "บทบัญญัติทั่วไป" and got["1"].chapter.number == "1" and got["1"].chapter.heading == ""
    assert got["288"].title.number == "10" and got["288"].chapter is None and got["288"].heading == "มาตรา ๒๘๘"
    assert got["335 ทวิ"].book.number == "3" and got["335 ทวิ"].title is None and got["335 ทวิ"].text == "ลหุโทษ"


def test_spans_and_lookup(spark):
    units = spark.createDataFrame([("b1", 0, 0), ("t1", 1, 0), ("t2", 1, 4), ("c1", 2, 4), ("b2", 0, 6), ("lost", 1, None)], "unit string, level_rank int, p0 long")
    spans = hierarchy.unit_spans(units, 10)
    assert {r.unit: r.p1 for r in spans.collect()} == {"b1": 5, "t1": 3, "t2": 5, "c1": 5, "b2": 9}
    at = hierarchy.unit_at(spark.range(10).select(F.col("id").alias("pos")), spans)
    assert {(r.pos, r.level_rank): r.unit for r in at.collect() if r.pos in (3, 5, 7)} == {(3, 0): "b1", (3, 1): "t1", (5, 0): "b1", (5, 1): "t2", (5, 2): "c1", (7, 0): "b2"}


def test_selector_ties_and_fallback(spark):
    rows = [("q", "n", 0, 2), ("q", "n", 1, 2), ("q", "m", 0, 0), ("q", "m", 1, 0), ("q", "m", 2, 0)]
    got = retrieval.select_options(spark.createDataFrame(rows, "query_id string, node string, pos int, overlap int"), 1).collect()
    assert {(r.node, r.pos) for r in got} == {("n", 1), ("m", 2)}


def test_constant_scores_are_zero(spark):
    rows = spark.createDataFrame([("q", 1, 3.0), ("q", 2, 3.0)], "query_id string, item_id int, score double")
    assert {r.norm for r in retrieval.normalized(rows).collect()} == {0.0}


def test_expansion_and_reserved_slots(spark):
    seeds = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, item_id int, rank int")
    adj = spark.createDataFrame([(1, 2), (1, 9), (2, 5), (2, 9)], "src int, dst int")
    assert [r.item_id for r in retrieval.expand(seeds, adj).orderBy("rank").collect()] == [1, 2, 9, 5]
    assert [r.item_id for r in retrieval.expand(seeds, adj, most=1).orderBy("rank").collect()] == [1, 2, 5]
    primary = spark.createDataFrame([("q", i, i) for i in range(1, 7)], "query_id string, item_id int, rank int")
    tail = spark.createDataFrame([("q", 3, 1), ("q", 42, 2)], "query_id string, item_id int, rank int")
    assert [r.item_id for r in retrieval.reserved(primary, tail, 5).orderBy("rank").collect()] == [1, 2, 3, 4, 42]
    assert [r.item_id for r in retrieval.reserved(primary, tail.limit(0), 5).orderBy("rank").collect()] == [1, 2, 3, 4, 5]


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b b"), (2, "a"), (3, "")], "item_id int, text string")
    got = {r.item_id: r.score for r in retrieval.bm25(docs, spark.createDataFrame([("q", "B b")], "query_id string, text string")).collect()}
    idf = math.log(1 + (3 - 1 + 0.5) / 1.5)
    assert got == {1: pytest.approx(idf * 2 * 2.5 / (2 + 1.5 * (0.25 + 0.75 * 3 / (4 / 3))))}


def test_arms(spark):
    assert retrieval.arm_id("hybrid+pi+kg") == "A4B" and retrieval.arm_id("R1") == "R1"
    with pytest.raises(ValueError):
        retrieval.build_arm("closed", None)


def test_graph_rules(spark):
    rules = spark.createDataFrame([("r", ["1", "99"], "all_offences", False, None, "n"), ("s", ["2"], "specific", True, ["2", "3", "77"], None), ("v", ["5"], "needs_review", False, None, "look")], "label string, general_sections array<string>, scope string, verified boolean, targets array<string>, note string")
    corpus = spark.createDataFrame([("1", ["all_offences"]), ("2", []), ("3", ["all_offences"])], "id string, scopes array<string>")
    edges = graph.rule_edges(rules, corpus)
    assert {(r.src, r.dst) for r in edges.collect()} == {("1", "3"), ("2", "3")}
    assert {(r.label, r.n) for r in graph.rule_stats(rules, edges).collect()} == {("r", 1), ("s", 1), ("v", 0)}
    assert {(r.kind, r.id) for r in graph.bad_targets(rules, corpus).collect()} == {("general", "99"), ("target", "77")}
    assert [r.general_section_id for r in graph.review_queue(rules).collect()] == ["5"]


def test_cypher_escapes(spark):
    row = spark.createDataFrame([("Part", "1", "it's \\ x", None)], "label string, id string, name string, gone string")
    assert graph.cypher_nodes(row, "label", "id", ["name", "gone"]).first()[0] == "MERGE (n:Part {id: '1'}) SET n.name = 'it\\'s \\\\ x';"


def test_refusals(spark):
    rows = spark.createDataFrame([(True, "ไม่สามารถตอบได้"), (True, "yes"), (False, "ไม่มีข้อมูล"), (False, "yes")], "should boolean, answer string")
    r = judge.confusion(rows, F.col("should"), judge.is_refusal(F.col("answer"))).first()
    assert tuple(r) == (1, 1, 1, 1, 0.5, 0.5, 0.5)
    r = judge.confusion(rows.where("answer = 'yes' and not should"), F.col("should"), F.lit(False)).first()
    assert (r.precision, r.recall, r.f1) == (None, None, None)


def test_citations_are_judged_against_every_id(spark):
    rows = spark.createDataFrame([(1, ["5", "250", "999"], ["5"]), (2, [], ["1"]), (3, ["777"], ["777"])], "doc_id int, cited array<string>, retrieved array<string>")
    got = {r.doc_id: (sorted(r.hard), sorted(r.soft), r.hard_rate) for r in judge.citation_flags(rows, spark.range(800).select(F.col("id").cast("string").alias("id")), "doc_id").collect()}
    assert got == {1: (["999"], ["250"], pytest.approx(1 / 3)), 2: ([], [], 0.0), 3: ([], [], 0.0)}


def test_flags_of_documents_beyond_the_first_hundred(spark, tmp_path):
    from spindrift.plans.registry import QUERIES

    spark.createDataFrame([(1, "see 150 and 404"), (150, "see 1"), (250, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.n_cited, r.n_hard, r.n_soft) for r in QUERIES["hallucination_flags"](spark, str(tmp_path)).collect()}
    assert got == {1: (2, 1, 1), 150: (1, 0, 0), 250: (0, 0, 0)}


def test_orders_over_whole_tables(spark):
    """Numbers, sums and last values equal those of one sorted list, whatever the ranges are."""
    import random

    from spindrift.operators import ordering

    rng = random.Random(4)
    rows = [(rng.choice(["a", "b", None]), rng.randrange(50), i, rng.choice([None, i])) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, k int, i int, w int").repartition(7)
    key = lambda r: (r[1], r[2])
    whole = {r[2]: n for n, r in enumerate(sorted(rows, key=key))}
    assert {r.i: r.n for r in ordering.numbered(df, ["k", "i"], "n").collect()} == whole
    each = {r[2]: n for g in ("a", "b", None) for n, r in enumerate(sorted((r for r in rows if r[0] == g), key=key))}
    assert {r.i: r.n for r in ordering.numbered(df, ["k", "i"], "n", ["g"]).collect()} == each
    sums, total = {}, 0
    for r in sorted(rows, key=key):
        sums[r[2]] = total
        total += r[1]
    assert {r.i: r.s for r in ordering.summed_before(df, ["k", "i"], F.col("k"), "s").collect()} == sums
    last, want = {}, {}
    for r in sorted(rows, key=key):
        last[r[0]] = r[3] if r[3] is not None else last.get(r[0])
        want[r[2]] = last[r[0]]
    some = df.where("g is not null")
    assert {r.i: r.w for r in ordering.last_known(some, ["k", "i"], "w", ["g"]).collect()} == {r[2]: want[r[2]] for r in rows if r[0]}
    assert ordering.numbered(df.limit(0), ["k"], "n").count() == 0


def test_half_even_sampling(spark):
    assert judge.audit_sample(spark.range(25).withColumn("g", F.lit(1)), "id", ["g"], 0.1).count() == 2
    assert judge.audit_sample(spark.range(2).withColumn("g", F.lit(1)), "id", ["g"], 0.1).count() == 1


def test_agreement(spark):
    p = spark.createDataFrame([(1, 1), (1, 1), (0, 0), (0, 1)], "a int, b int")
    assert judge.kappa(p, "a", "b").first().kappa == pytest.approx(0.5)
    assert judge.kappa(p.where("a = 1"), "a", "b").first().kappa == 1.0 and judge.kappa(p.limit(0), "a", "b").first().kappa is None
    assert judge.spearman(p.where("a = 1"), "a", "b").first().rho is None
    assert judge.spearman(spark.createDataFrame([(1, 10), (2, 20), (3, 15), (4, 40)], "a int, b int"), "a", "b").first().rho == pytest.approx(0.8)


A, B = [1, 1, 1, 0, 1, 1, 0, 1, 1, 1], [0, 0, 1, 0, 1, 0, 0, 1, 0, 0]


def test_mcnemar_and_permutation(spark):
    pairs = spark.createDataFrame(list(zip(range(10), A, B, strict=True)), "id int, a int, b int")
    r = stats.mcnemar(pairs).first()
    assert (r.a_wins, r.b_wins, r.odds_ratio) == (5, 0, math.inf) and r.p == pytest.approx(0.0625)
    p = stats.permutation(pairs.select("id", (F.col("a") - F.col("b")).cast("double").alias("v"))).first()
    assert (p.n, p.m, p.p) == (10, 5, 0.0625)
    many = spark.createDataFrame([(1500, 1400)], "x long, y long").select(stats.binomial_two_sided(F.col("x"), F.col("x") + F.col("y"))).first()[0]
    assert 0.05 < many < 0.08
    assert spark.range(1).select(stats.binomial_two_sided(F.lit(0).cast("long"), F.lit(0).cast("long"))).first()[0] == 1.0


@pytest.mark.parametrize("up, down, same", [(12, 4, 3), (7, 7, 0), (0, 16, 1), (9, 6, 0), (0, 0, 4), (0, 0, 0)])
def test_sign_flips_equal_enumeration(spark, up, down, same):
    v = [1.0] * up + [-1.0] * down + [0.0] * same
    flips = 2 * ((np.arange(2 ** (m := up + down))[:, None] >> np.arange(m)) & 1) - 1
    r = stats.sign_flips(spark.createDataFrame(list(enumerate(v)), "id int, v double")).first()
    assert (r.n, r.m, r.mean) == (len(v), m, pytest.approx(sum(v) / max(1, len(v))))
    assert r.p == pytest.approx(np.mean(np.abs(flips.sum(axis=1)) >= abs(up - down)), abs=1e-12)


def test_sign_flips_of_other_differences(spark):
    with pytest.raises(Exception, match="not 0, 1 or -1"):
        stats.sign_flips(spark.createDataFrame([(1, 0.5)], "id int, v double")).collect()


def test_all_flips_of_more_pairs_than_are_enumerated(spark, tmp_path):
    from spindrift.plans.registry import QUERIES

    spark.createDataFrame([(i, int(i < 560), 0) for i in range(0, 800, 40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(i, 1, "en" if i >= 560 else "de") for i in range(0, 800, 40)], "doc_id long, n_chars int, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    want = (20, 20, 0.4, round(2 * sum(math.comb(20, i) for i in range(7)) / 2**20, 6))
    assert tuple(QUERIES["permutation_exact"](spark, str(tmp_path)).first()) == want


def test_bootstrap(spark):
    v = [1, 0, 1, 0, 0, 1, 0, 0]
    r = stats.bootstrap(spark.createDataFrame(list(zip(range(8), map(float, v), strict=True)), "id int, v double"), 400).first()
    assert r.mean == 0.375 and 0 <= r.lo <= r.mean <= r.hi <= 1 and r.lo < r.hi


@pytest.mark.parametrize("name", ["bootstrap_mean_ci", "bootstrap_delta_ci", "bootstrap_did_ci", "permutation_mc"])
def test_all_resamples_are_drawn(spark, monkeypatch, name):
    from spindrift.plans import statistics

    asked = []
    monkeypatch.setattr(stats, "bootstrap", lambda df, times: asked.append(times) or spark.createDataFrame([(0.0, 0.0, 0.0)], "mean double, lo double, hi double"))
    monkeypatch.setattr(stats, "permutation", lambda df, times: asked.append(times) or spark.createDataFrame([(0.0, 0.0)], "mean double, p double"))
    getattr(statistics, name)(spark, "/root/testdata/sf0.001")
    assert asked == [10_000]


def test_bootstrap_by_group_and_beyond_what_is_sent(spark, monkeypatch):
    rows = [(g, i, float((i * 7 + len(g)) % 5)) for g, n in (("a", 9), ("bb", 4), ("c", 1)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, id int, v double")
    sent = sorted(map(tuple, stats.bootstrap(df, 50, by=["g"]).collect()))
    monkeypatch.setattr(stats, "MOST_SENT", 0)
    assert sorted(map(tuple, stats.bootstrap(df, 50, by=["g"]).collect())) == sent and [r[1] for r in sent] == [9, 4, 1]
    alone = stats.bootstrap(df.where("g = 'bb'").select("id", "v"), 50).first()
    assert (alone.mean, alone.lo, alone.hi) == sent[1][2:]
    assert stats.bootstrap(df.limit(0), 50, by=["g"]).count() == 0


def test_rates_are_permuted(spark):
    """30 pairs of .9 against .2, where McNemar's test sees nothing; few pairs are enumerated."""
    rows = [("A", i, 0.9) for i in range(30)] + [("B", i, 0.2) for i in range(30)] + [("C", i, 0.9 if i else 0.1) for i in range(4)] + [("C", 7, None)]
    out = stats.contrasts(spark.createDataFrame(rows, "arm string, id int, v double"), [("ab", "A", "B"), ("ac", "A", "C"), ("ax", "A", "X"), ("cb", "C", "B")], test="permutation", resamples=500)
    got = {r.name: r for r in out.collect()}
    assert set(got) == {"ab", "ac", "cb"} and got["ab"].n == 30 and got["ab"].p == 0.0 and got["ab"].reject
    assert got["ab"].delta == pytest.approx(0.7) and got["ab"].lo == pytest.approx(0.7) and got["ab"].hi == pytest.approx(0.7)
    assert (got["ac"].n, got["ac"].p) == (4, 1.0) and got["ac"].lo <= got["ac"].delta <= got["ac"].hi
    v = [-0.1, 0.7, 0.7, 0.7]
    flips = [abs(sum(x * (1 if b >> i & 1 else -1) for i, x in enumerate(v))) for b in range(16)]
    assert got["cb"].p == pytest.approx(sum(f >= abs(sum(v)) - 1e-12 for f in flips) / 16)
    assert got["cb"].a_wins is None and got["cb"].test == "permutation"


def test_holm_literal(spark):
    got = {r.name: (round(r.p_adj, 6), r.reject) for r in stats.holm(spark.createDataFrame([("x", 0.01), ("y", 0.04), ("z", 0.2)], "name string, p double")).collect()}
    assert got == {"x": (0.03, True), "y": (0.08, False), "z": (0.2, False)}


def test_holm_is_monotone(spark):
    @settings(max_examples=8, deadline=None)
    @given(st.lists(st.floats(0, 1), min_size=1, max_size=12))
    def check(ps):
        rows = stats.holm(spark.createDataFrame([(f"n{i:02}", p) for i, p in enumerate(ps)], "name string, p double")).orderBy("p", "name").collect()
        adj = [r.p_adj for r in rows]
        assert adj == sorted(adj) and all(r.p <= r.p_adj <= 1 for r in rows)

    check()


def test_mixed_logistic_recovers_signs():
    rng = np.random.default_rng(1)
    n, design = 400, np.array([[1, 0, 0, 0], [1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 1, 1]], float)
    u = rng.normal(0, 0.8, n)
    y = (rng.random((n, 4)) < 1 / (1 + np.exp(-(design @ np.array([-1, 1.5, 0.5, 0.0]) + u[:, None])))).astype(float)
    beta, sigma = stats.fit_mixed_logistic(y.ravel(), np.tile(design, (n, 1)), np.repeat(np.arange(n), 4))
    assert beta[0] < -0.5 and 1 < beta[1] < 2 and 0 < beta[2] < 1 and abs(beta[3]) < 0.6 and 0.3 < sigma < 1.5


def test_pooled_fit_equals_the_fit_of_every_item(spark):
    patterns = [(0, 0, 0, 0), (0, 1, 0, 1), (0, 0, 1, 1), (1, 1, 1, 1), (1, 0, 0, 1), (0, 1, 1, 0)]
    y = np.repeat(np.array(patterns, float), [2600, 900, 1400, 700, 1, 3], axis=0)
    arms = ("A1", "A2", "A3", "A4")
    got = {r.term: r.estimate for r in stats.mixed_effects(spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(y)], ["id", *arms]), arms).collect()}
    design = np.array([[1, 0, 0, 0], [1, 0, 1, 0], [1, 1, 0, 0], [1, 1, 1, 1]], float)
    beta, sigma = stats.fit_mixed_logistic(y.ravel(), np.tile(design, (len(y), 1)), np.repeat(np.arange(len(y)), 4))
    assert [got[t] for t in ("intercept", "base", "extension", "interaction", "item_sd")] == pytest.approx([*beta, sigma], abs=1e-6)


def test_round_robin_exhausts_small_strata(spark):
    rows = spark.createDataFrame([(i, "big" if i else "small") for i in range(10)], "id int, g string")
    got = evalset.stratified(rows, "id", "g", 5).collect()
    assert len(got) == 5 and sum(r.g == "small" for r in got) == 1 and sorted(r.picked for r in got) == [1, 2, 3, 4, 5]


def test_item_violations(spark):
    items = spark.createDataFrame([("a", 0, "question", "lookup", ["1"], []), ("a", 1, "question", "riddle", ["9"], []), ("b", 2, "que", "unanswerable", ["1"], None), ("c", 3, "question", "penalty", None, None)], "id string, pos int, question string, question_type string, gold array<string>, supporting array<string>")
    got = {(r.id, r.rule) for r in evalset.violations(items, spark.createDataFrame([("1",)], "id string")).collect()}
    assert got == {("a", "bad type"), ("a", "duplicate id"), ("a", "unknown section 9"), ("b", "missing question"), ("b", "unanswerable with gold"), ("c", "no gold")}


def test_items_have_their_whole_question(spark, tmp_path):
    from spindrift.plans import sets

    spark.createDataFrame([(1, 0, "user", "a question of some length")], "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    assert sets.items(spark, str(tmp_path)).first().question == "a question of some length"


def test_files(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text(json.dumps({"section_id": "1", "book": {"number": "2", "heading": "h"}}) + "\n\n")
    s = io.read_sections(spark, str(tmp_path / "s.jsonl")).collect()
    assert len(s) == 1 and (s[0].section_id, s[0].text, s[0].book, s[0].title) == ("1", "", "2", None)
    (tmp_path / "R0.jsonl").write_text(json.dumps({"id": "q", "ranked": ["1"], "gold": ["1"]}) + "\n")
    assert io.read_rankings(spark, str(tmp_path / "R0.jsonl")).first().arm == "R0"
    (tmp_path / "a.csv").write_text('article,text,notes\n 1 ,"x\ny",\nnull,z,\n2,,\nintro-1,hello,\n')
    articles, intro = io.read_articles(spark, str(tmp_path / "a.csv"))
    assert [(r.article, r.text) for r in articles.collect()] == [("1", "x\ny")] and intro.count() == 1
    assert io.read_edges(spark, str(tmp_path / "none.jsonl"), ["CITES"]).count() == 0
    (tmp_path / "e.jsonl").write_text('{"src":"Section:1","dst":"Section:2","type":"CITES","resolved":false}\n{"src":"x","dst":"y","type":"OTHER"}\n')
    assert [(r.src, r.dst) for r in io.read_edges(spark, str(tmp_path / "e.jsonl"), ["CITES"]).collect()] == [("1", "2")]
    (tmp_path / "i.jsonl").write_text(json.dumps({"id": "1", "applicable_version_date": "2024-01-31"}) + "\n")
    item = io.read_items(spark, str(tmp_path / "i.jsonl")).first()
    assert item.gold_sections == [] and str(item.applicable_version_date) == "2024-01-31"
    io.write_jsonl(articles, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 1


def test_model_slots(spark):
    with pytest.raises(models.NotConfigured):
        models.Unset("generator").answer
    assert isinstance(models.load("spindrift.operators.models:LexicalJudge", None), models.LexicalJudge) and models.load(None, 5) == 5
    v = spark.range(1).select(models.HashEmbedder(8).encode(F.lit("a b a"))).first()[0]
    assert len(v) == 8 and sum(x * x for x in v) == pytest.approx(1)
    assert spark.range(1).select(models.LexicalJudge().ground(F.array(F.lit("a c"), F.lit("z")), F.lit("a b c"))).first()[0] == [True, False]
    assert spark.range(1).select(retrieval.overlap_score(word_tokens(F.lit("a b")), word_tokens(F.lit("a a c")))).first()[0] == 2


def test_nested_trees_are_read(spark, tmp_path):
    leaf = {"node_type": "section", "number": "7", "heading": "H", "text": "t", "node_id": "B1.S7", "section_id": "7", "nodes": []}
    tree = {"node_type": "root", "heading": "Act", "nodes": [{"node_type": "book", "number": "1", "heading": "One", "node_id": "B1", "nodes": [leaf, leaf | {"node_id": None, "section_id": "8"}]}, leaf | {"node_id": "S9", "section_id": "9"}]}
    (tmp_path / "tree.json").write_text(json.dumps(tree, indent=1))
    got = [(r.node, r.parent, r.depth, r.pos, r.is_leaf, r.display, r.item_id) for r in io.read_tree(spark, str(tmp_path / "tree.json")).orderBy("depth", "pos").collect()]
    assert got == [("root", None, 0, 0, False, "Act", None), ("B1", "root", 1, 0, False, "One", None), ("S9", "root", 1, 1, True, "H t", "9"), ("B1.S7", "B1", 2, 0, True, "H t", "7"), ("B1.1", "B1", 2, 1, True, "H t", "8")]


def test_retrievers_of_ones_own(spark, monkeypatch):
    monkeypatch.setitem(retrieval.RETRIEVERS, "first", lambda ctx, k: ctx.queries.select("query_id", F.lit("1").alias("item_id"), F.lit(1.0).alias("score"), F.lit(1).alias("rank")))
    ctx = retrieval.Context(spark.createDataFrame([("1", "x")], "item_id string, text string"), spark.createDataFrame([("a", "x")], "query_id string, text string"))
    assert retrieval.build_arm("first", ctx).first().item_id == "1"


def test_spans_by_brute_force(spark):
    import random

    rng = random.Random(8)
    rows = [(i, rng.choice([0, 1, 2, 3, None]), rng.choice([None, *range(0, 120)])) for i in range(90)]
    want = {}
    for u, rank, p0 in rows:
        if p0 is not None:
            later = [p for _, r, p in rows if p is not None and r is not None and rank is not None and p > p0 and r <= rank]
            want[u] = min(later, default=130) - 1
    got = hierarchy.unit_spans(spark.createDataFrame(rows, "unit int, level_rank int, p0 long").repartition(5), 130).collect()
    assert {r.unit: r.p1 for r in got} == want


@pytest.mark.parametrize("seed", ["7", "20260729-" * 8])
def test_draws_are_md5(seed):
    """Of messages of any length, over several blocks too."""
    from spindrift.operators import draws

    first = lambda t: int(hashlib.md5(t.encode()).hexdigest()[:8], 16)
    ids = ["", "-7", "-007", "-ä日本", "-" + "x" * 47, "-" + "x" * 55, "-" + "y" * 200]
    for start, end, heads in draws.heads(seed, 8, 12, 5000):
        for places, tails in draws.same_lengths(pa.array(["cut", *ids]).slice(1)):
            want = [[first(f"{seed}-{b}{ids[i]}") for i in places] for b in range(start, end)]
            assert draws.hashes(heads, tails).tolist() == want
    assert [(a, b) for a, b, _ in draws.numbers(8, 102)] == [(8, 10), (10, 100), (100, 102)]


def test_resamples_and_flips_are_as_defined(spark):
    """In groups of the same items and sizes, and of others; nulls are in no mean."""
    first = lambda *t: int(hashlib.md5("-".join(map(str, t)).encode()).hexdigest()[:8], 16)
    rows = [(g, f"i{i:03}", ((i * 7 + len(g)) % 9 - 4.4) / 8) for g, n in (("a", 120), ("bb", 120), ("ccc", 31)) for i in range(n)]
    values = spark.createDataFrame(rows, "name string, id string, v double")
    boot = {r.name: r for r in stats.bootstrap(values, 40, by=["name"]).collect()}
    flips = {r.name: r for r in stats.permutation(values, 40, by=["name"]).collect()}
    for g in ("a", "bb", "ccc"):
        ids, v = zip(*[(i, x) for name, i, x in rows if name == g], strict=True)
        means = sorted(sum(v[first(stats.SEED, b, j) % len(v)] for j in range(len(v))) / len(v) for b in range(40))
        assert (boot[g].n, boot[g].lo, boot[g].hi) == (len(v), pytest.approx(means[1]), pytest.approx(means[39]))
        sums = [sum(x if first(stats.SEED, b, i) & 1 else -x for i, x in zip(ids, v, strict=True)) for b in range(40)]
        assert flips[g].p == sum(abs(x) >= abs(sum(v)) - 1e-12 for x in sums) / 40
    nulls = spark.createDataFrame([(0, None)] + [(i, 2.0) for i in range(1, 9)], "id int, v double")
    assert stats.bootstrap(nulls, 30).select("n", "mean", "lo", "hi").first() == (9, 2.0, 2.0, 2.0)


def test_contrasts_keep_pace_with_their_draws(spark):
    """Three contrasts of 10,000 resamples and flips: under a microsecond of CPU a draw, where the plan of expressions took several."""
    n = 2_000
    long = spark.range(n).select("id", F.explode(F.array(*[F.struct(F.lit(a).alias("arm"), (F.pmod(F.xxhash64("id", F.lit(a)), F.lit(1000)) / 1000.0).alias("v")) for a in "ABCD"])).alias("x")).select("x.arm", "id", "x.v").cache()
    assert long.count() == 4 * n
    started = time.perf_counter()
    out = stats.contrasts(long, [("ab", "A", "B"), ("bc", "B", "C"), ("cd", "C", "D")], test="permutation").collect()
    assert [r.n for r in out] == [n] * 3
    assert (time.perf_counter() - started) * 4 / (6 * n * stats.RESAMPLES) < 1e-6
