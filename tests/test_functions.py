"""Text functions and ranking metrics on literal cases."""

import pytest
from pyspark.sql import functions as F

from spindrift.functions import ranking as m
from spindrift.functions import text as fn


def one(spark, *cols):
    row = spark.range(1).select(*cols).first()
    return row[0] if len(cols) == 1 else tuple(row)


def test_script_tokens(spark):
    got = one(spark, fn.script_tokens(F.lit("มาตรา ๓๓๔ Code-7 ab")))
    assert got == ["มาต", "าตร", "ตรา", "๓๓๔", "๓๓๔", "code", "7", "ab"]
    assert one(spark, fn.script_tokens(F.lit(None).cast("string"))) == []
    with pytest.raises(ValueError):
        fn.tokenizer("nope")


CITES = [
    ("ตามมาตรา ๓๓๔ และมาตรา 335 ทวิ", ["334", "335/2"]),
    ("มาตรา ๓๓๖/๒ ทวิ", ["336/2"]),
    ("มาตรา ๓๓๔ ถึงมาตรา ๓๓๖", ["334", "336", "335"]),
    ("มาตรา 336 ถึงมาตรา 334", ["336", "334"]),
    ("มาตรา 1 ถึงมาตรา 60", ["1", "60"]),
    ("มาตรา 1 ถึง 60", ["1"]),
    ("มาตรา ๕ ทวาทศ", ["5/12"]),
    ("ไม่มี", []),
]


@pytest.mark.parametrize("text, want", CITES)
def test_citations(spark, text, want):
    assert one(spark, fn.citations(F.lit(text))) == want


def test_citing_oneself(spark):
    assert one(spark, fn.citations(F.lit("มาตรา 80 มาตรา 81"), F.lit("80"))) == ["81"]


def test_penalties_overlap(spark):
    assert one(spark, fn.penalty_classes(F.lit("ต้องระวางโทษประหารชีวิต จำคุกตลอดชีวิต"))) == ["death", "life", "imprisonment"]


def test_paths_headings_verdicts(spark):
    assert one(spark, fn.node_path([("B", F.lit("2")), ("T", F.lit(None).cast("string")), ("C", F.lit("1/2"))], F.lit("335/1"))) == "B2.C1_2.S335_1"
    assert one(spark, *fn.split_heading(F.lit("Title  one. Body"), r"[^.]*\.", F.lit("x"))) == ("Title one.", "Body")
    assert one(spark, *fn.split_heading(F.lit("none here"), r"[^.]*\.", F.lit("x"))) == ("x", "none here")
    assert one(spark, fn.padded_verdicts(F.array(F.lit(True)), F.lit(3))) == [True, False, False]
    assert one(spark, fn.padded_verdicts(F.array(F.lit(True), F.lit(True)), F.lit(1))) == [True]
    assert one(spark, fn.json_block(F.lit('<think>{no}</think> so {"a": {"b": 1}} end'))) == '{"a": {"b": 1}}'
    assert one(spark, fn.chosen_numbers(F.lit("3, 9, 3 and 0"), 5, 2)) == [3, 0]


CASES = [("abc", "b", 1.0, 1.0, 0.5, 0.5, 1.0), ("abc", "x", 0.0, 0.0, 0.0, 0.0, 0.0), ("ab", "az", 0.5, 1.0, 1.0, 0.5, 0.0), ("axb", "ab", 1.0, 1.0, 1.0, (1 + 2 / 3) / 2, 1.0), ("", "a", 0.0, 0.0, 0.0, 0.0, 0.0), ("a", "", None, None, None, None, None)]


@pytest.mark.parametrize("ranked, gold, recall, hit, rr, ap, cover", CASES)
def test_metrics(spark, ranked, gold, recall, hit, rr, ap, cover):
    r, g = (F.array(*map(F.lit, x)).cast("array<string>") for x in (ranked, gold))
    got = one(spark, m.recall(r, g, 5), m.hit(r, g, 5), m.reciprocal_rank(r, g), m.average_precision(r, g), m.coverage(r, g, 5))
    assert got == pytest.approx((recall, hit, rr, ap, cover)) if recall is not None else set(got) == {None}


def test_recall_counts_repeated_gold(spark):
    assert one(spark, m.recall(F.array(F.lit("a")), F.array(*map(F.lit, "aab")), 5)) == pytest.approx(2 / 3)


def test_hallucination(spark):
    ids = lambda s: F.array(*map(F.lit, s.split())).cast("array<string>")
    h = one(spark, m.hallucination(ids("334 999 335/2"), ids("334 335 80"), ids("334")))
    assert (h.hard, h.soft, h.hard_rate, h.soft_rate) == (["999", "335/2"], [], pytest.approx(2 / 3), 0.0)
    h = one(spark, m.hallucination(ids("80"), ids("80"), F.lit(None).cast("array<string>")))
    assert (h.hard, h.soft) == ([], [])


def test_citations_of_statutes_and_of_answers(spark):
    """Within a statute the last two ordinal words don't count; an answer has no ranges."""
    text = F.lit("มาตรา ๕ ทวาทศ มาตรา 6 ทวิ มาตรา 7 ถึง 9 มาตรา 10 เอกาทศ")
    assert one(spark, fn.statute_citations(text, F.lit("8"))) == ["5", "6/2", "7", "10", "9"]
    assert one(spark, fn.answer_citations(text)) == ["5/12", "6/2", "7", "10/11"]


def test_words_are_told_before_they_are_lowered(spark):
    assert one(spark, fn.word_tokens(F.lit("\u0130x \u212a9 \uff21b AbC๑"))) == ["x", "9", "b", "abc๑"]


def test_containers_without_one_above_have_no_edge(spark):
    from spindrift.operators.graph import contains_edges

    rows = spark.createDataFrame([("1", "2", "3", "a"), (None, "2", None, "b"), (None, None, "3", "c"), (None, None, None, "d"), ("1", None, "3", "e")], "book string, title string, chapter string, s string")
    got = sorted((r.src, r.dst) for r in contains_edges(rows, ["book", "title", "chapter"], F.col("s")).collect())
    assert got == sorted([("Book:1", "Title:2"), ("Title:2", "Chapter:3"), ("Chapter:3", "a"), ("Title:2", "b"), ("Chapter:3", "c"), ("root", "d"), ("Book:1", "Chapter:3"), ("Chapter:3", "e")])
