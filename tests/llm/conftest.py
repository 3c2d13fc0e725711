import pytest

ODD = [None, "", " ", "\n\n", "a", "two words", "x" * 30_000, "one two three " * 3_000, "Ünïcode ß 日本語 \U0001f600 ´ `", "same text again and again", "same text again and again", "\x1c\x1d odd \x85 space\x0bhere", "don't I'll ''s <|endoftext|> 3.14159 ==> !!"]


@pytest.fixture(scope="session")
def odd(spark):
    """Null, empty, very long, repeated and unusual texts, a null and a repeated id, and columns with clashing names."""
    rows = [(i, t, "L", None, 1, "clash", i) for i, t in enumerate(ODD)] + [(None, "no id", None, None, None, None, None), (3, "id again", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens int, kept string, component long")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
