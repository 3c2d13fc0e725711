"""Quality rules: line-first cleaning with DataFrame expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, ascii_lower

#: Phrases of lines that are no prose, lower case.
BOILERPLATE = r"(all rights reserved|copyright|licensed under|terms of use|terms of service|privacy policy|cookie|subscribe|sign up|click here|javascript)"
NOT_SYMBOLS = r"[^#*$%&|<>]+"
NOT_MARKS = r"[^#*$%&|<>!]+"
SEPARATORS = r"[|»›]"
ENDS = r"[.!?:;…。][\"'”’)\]]*$"
MOST_BOILERPLATE_WORDS, LEAST_WORDS, SHORT_LINE_WORDS = 20, 50, 4


def _words(line: Column) -> Column:
    return F.array_remove(F.split(line, f"{SPACE}+"), "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def _once(value: Column) -> Column:
    """``value``, closed to the optimizer, which might else copy it into filters and lambdas.

    A partition's number is never negative; that it depends on the partition keeps the expression
    in its place, computed once for a row.
    """
    return F.when(F.spark_partition_id() >= 0, value)


def line_fails(line: Column, n_words: Column) -> Column:
    """Whether a line with ``n_words`` words, one at least, is no prose.

    Punctuation: as many of ``#*$%&|<>!`` as words or more, or a line under four words without an
    ending mark. Navigation: three separators or more, and one for every three words, where lone
    separators are words too. Boilerplate: a
    line of at most twenty words with a fixed phrase.
    """
    separators = F.length(F.regexp_replace(line, f"[^{SEPARATORS[1:-1]}]+", ""))
    marks = F.length(F.regexp_replace(line, NOT_MARKS, ""))
    ended = F.rtrim(line).rlike(ENDS)
    return (marks >= n_words) | ((n_words < SHORT_LINE_WORDS) & ~ended) | ((separators >= 3) & (separators * 3 >= n_words)) | ((n_words <= MOST_BOILERPLATE_WORDS) & ascii_lower(line).rlike(BOILERPLATE))


def measured(text: Column) -> Column:
    """All measures of a text as one struct. Lines, verdicts on lines and words are computed once each."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), _words(x).alias("words")))
    judge = lambda x: F.struct(x["line"].alias("line"), F.size(x["words"]).alias("n"), ((F.size(x["words"]) > 0) & line_fails(x["line"], F.size(x["words"]))).alias("fails"))

    def all_of(checked: Column, words: Column) -> Column:
        full = F.filter(checked, lambda x: x["n"] > 0)
        failed = F.filter(checked, lambda x: x["fails"])
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            (F.size(full) - F.size(F.array_distinct(F.transform(full, lambda x: x["line"])))).cast("long").alias("n_dup_lines"),
            F.when(F.size(words) >= 3, _let(window_hashes(words), lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), repeated_words(words)))).cast("long").alias("n_repeat_words"),
            F.size(full).cast("long").alias("n_lines"),
            F.size(failed).cast("long").alias("n_failed_lines"),
            F.aggregate(failed, F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("lost_words"),
            F.array_join(F.transform(F.filter(checked, lambda x: ~x["fails"]), lambda x: x["line"]), "\n").alias("cleaned"),
        )

    by_words = lambda x: _let(F.flatten(F.transform(x, lambda y: y["words"])), lambda w: _let(F.transform(x, judge), lambda c: all_of(c, w)))
    return _let(lines, by_words)


def window_hashes(words: Column) -> Column:
    """A hash of each window of three words. Equal windows have equal hashes, so with all of them
    different nothing is repeated."""
    return F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(words[i], words[i + 1], words[i + 2]))


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that the array holds twice or more.

    Windows are sorted as text with their place, so equal ones are neighbours.
    """
    windows = F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.struct(F.concat_ws(" ", words[i], words[i + 1], words[i + 2]).alias("w"), i.alias("i")))

    def count(sorted_: Column) -> Column:
        same = lambda s, k: F.coalesce(F.get(sorted_, k)["w"] == s["w"], F.lit(False))
        marked = F.transform(sorted_, lambda s, k: F.when(same(s, k - 1) | same(s, k + 1), s["i"]))
        return F.size(F.array_distinct(F.flatten(F.transform(F.array_compact(marked), lambda i: F.array(i, i + 1, i + 2)))))

    return _let(F.array_sort(windows), count)


def quality_rules(docs: DataFrame, text: str = "text", most_lost: float = 0.5) -> DataFrame:
    """``docs`` with measures, ``cleaned`` text and a verdict ``kept``.

    Words are runs of characters other than ASCII white space. ``n_words``, ``word_chars`` (code
    points in words), ``n_symbols``, ``n_dup_lines`` (lines with a word, equal to an earlier one),
    ``n_repeat_words`` (words in repeated windows of three), ``base_failed`` (under 50 words, or
    over half of them in repeated windows), ``n_lines`` (with a word), ``n_failed_lines``,
    ``lost_words`` (in failed lines), ``cleaned`` (the text without failed lines), and ``kept``:
    not ``base_failed``, and no more than the share ``most_lost`` of the words lost.

    Null and empty texts have no words, fail and are not kept. Rows are independent; older columns
    with these names are replaced. The plan has neither a shuffle nor Python.
    """
    made = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_lines", "n_failed_lines", "lost_words", "cleaned", "kept")
    docs = docs.drop(*made)
    whole = F.coalesce(F.col(text), F.lit(""))
    q = docs.withColumn("__q", _once(measured(whole)))
    q = q.withColumns({n: F.col(f"__q.{n}") for n in made if n not in ("n_symbols", "n_repeat_words", "base_failed", "kept")})
    q = q.withColumns({"n_symbols": F.length(F.regexp_replace(whole, NOT_SYMBOLS, "")).cast("long"), "n_repeat_words": F.coalesce("__q.n_repeat_words", F.lit(0).cast("long"))})
    q = q.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50))
    q = q.withColumn("kept", ~F.col("base_failed") & (F.col("lost_words") <= F.col("n_words") * F.lit(float(most_lost))))
    return q.select(*docs.columns, *made)
