"""Text expressions: columns in, columns out, all inside the JVM."""

from __future__ import annotations

import importlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of the two scripts, and ordinal words with the numbers they stand for.
THAI_DIGITS, DIGITS = "๐๑๒๓๔๕๖๗๘๙", "0123456789"
ORDINALS = {"ทวิ": 2, "ตรี": 3, "จัตวา": 4, "เบญจ": 5, "ฉ": 6, "สัตต": 7, "อัฏฐ": 8, "นว": 9, "ทศ": 10, "เอกาทศ": 11, "ทวาทศ": 12}
SECTION_WORD, RANGE_WORD = "มาตรา", "ถึง"
#: The class of a penalty and the word that shows it, most severe first.
PENALTIES = [("death", "ประหารชีวิต"), ("life", "จำคุกตลอดชีวิต"), ("imprisonment", "จำคุก"), ("detention", "กักขัง"), ("fine", "ปรับ")]
#: Substrings that show a refusal.
REFUSALS = ["ไม่อยู่ในขอบเขต", "ไม่สามารถตอบ", "ไม่ครอบคลุม", "อยู่นอกขอบเขต", "ไม่เกี่ยวกับประมวลกฎหมายอาญา", "ไม่ปรากฏในประมวลกฎหมายอาญา", "ตอบจากประมวลกฎหมายอาญาไม่ได้", "ไม่มีข้อมูล"]
#: Cues of an offence, of a definition and of an exception.
OFFENCE_CUE = "ระวางโทษ"
DEFINITION_CUES = ["หมายความว่า", "หมายความรวมถึง"]
EXCEPTION_CUES = ["ไม่ต้องรับโทษ", "ไม่เป็นความผิด", "ไม่มีความผิด", "ผู้นั้นไม่ต้องรับโทษ", "ได้รับยกเว้นโทษ", "ยกเว้นโทษ", "ลดโทษ", "ศาลจะไม่ลงโทษ"]
#: Fixed value: what stands for an empty context.
NO_CONTEXT = "(ไม่มีตัวบทประกอบ)"
THAI_RUN = "[฀-๿]+"
#: Longer words before their beginnings, so that an alternation takes the whole word.
ORDINAL_CHOICE = "|".join(sorted(ORDINALS, key=len, reverse=True))
#: The ordinal words, from the first to the tenth, that a citation within a statute may have.
STATUTE_ORDINALS = [w for w, n in ORDINALS.items() if n <= 10]
NUMBER = "[0-9๐-๙]+(?:/[0-9๐-๙]+)?"


def to_arabic(c: Column) -> Column:
    """Digits of the Thai script to 0-9."""
    return F.translate(c, THAI_DIGITS, DIGITS)


def ngrams_of_runs(text: Column, run: str, n: int = 3) -> Column:
    """Overlapping n-grams of every match of ``run``; a match of at most n characters is one token."""
    grams = lambda s: F.when(F.length(s) <= n, F.array(s)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - (n - 1), F.lit(1))), lambda i: F.substring(s, i, F.lit(n))))
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(run), F.lit(0)), grams))


def word_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits of either script, lower case; splitting at all else is the cheapest way to them.

    What is no ASCII letter before it is lowered is none after it either, such as the Kelvin sign.
    """
    spaced = F.regexp_replace(F.coalesce(text, F.lit("")), "[^A-Za-z0-9๐-๙]+", " ")
    return F.array_remove(F.split(F.lower(spaced), " "), "")


def script_tokens(text: Column) -> Column:
    """Tokens of mixed text: n-grams of Thai runs, then word runs. Null has none."""
    text = F.coalesce(text, F.lit(""))
    return F.concat(ngrams_of_runs(text, THAI_RUN), word_tokens(text))


def python_tokens(spec: str):
    """A tokenizer of a Python function ``module:function`` from a text to its tokens, such as one by a
    dictionary; blank tokens go. It is loaded where a batch is worked on."""
    module, _, name = spec.partition(":")

    def run(texts: pd.Series) -> pd.Series:
        call = getattr(importlib.import_module(module), name)
        return texts.map(lambda t: [x for x in call(t) if x.strip()] if t else [])

    return lambda text: F.pandas_udf(run, "array<string>")(F.coalesce(text, F.lit("")))


#: ``pythainlp`` needs that library where tasks run.
TOKENIZERS = {"char_ngram": script_tokens, "word": word_tokens, "pythainlp": python_tokens("pythainlp:word_tokenize")}


def tokenizer(name: str):
    """The tokenizer registered under ``name``, or that of a function ``module:function``."""
    if name in TOKENIZERS:
        return TOKENIZERS[name]
    if ":" in name:
        return python_tokens(name)
    raise ValueError(f"no tokenizer named {name!r}; there are {', '.join(sorted(TOKENIZERS))}")


def content(heading: Column, text: Column) -> Column:
    return F.concat(F.coalesce(heading, F.lit("")), F.lit("\n"), F.coalesce(text, F.lit("")))


def split_heading(text: Column, pattern: str, fallback: Column) -> tuple[Column, Column]:
    """(heading, body): an anchored pattern's match, white space normalised, and the rest, trimmed."""
    found = F.regexp_extract(text, f"^(?:{pattern})", 0)
    heading = F.trim(F.regexp_replace(found, r"[ \t\r\n]+", " "))
    return F.when(heading != "", heading).otherwise(fallback), F.trim(F.when(heading != "", F.substring(text, F.length(found) + 1, F.length(text))).otherwise(text))


def node_path(levels: list[tuple[str, Column]], leaf: Column) -> Column:
    """``B1.T2.S3``: initial and number of each level that is there, then the leaf; ``/`` becomes ``_``."""
    safe = lambda c: F.replace(c, F.lit("/"), F.lit("_"))
    return F.concat_ws(".", *[F.when(c.isNotNull() & (c != ""), F.concat(F.lit(initial), safe(c))) for initial, c in levels], F.concat(F.lit("S"), safe(leaf)))


def contains_any(text: Column, cues: list[str]) -> Column:
    out = F.lit(False)
    for cue in cues:
        out = out | text.contains(cue)
    return F.coalesce(out, F.lit(False))


def classes(text: Column, keywords: list[tuple[str, str]]) -> Column:
    """The names of all keywords that occur, in the list's order."""
    return F.array_compact(F.array(*[F.when(text.contains(word), F.lit(name)) for name, word in keywords]))


def penalty_classes(text: Column) -> Column:
    return classes(text, PENALTIES)


def citations(text: Column, own: Column | None = None, most: int = 50, words: list[str] | None = None) -> Column:
    """Ids that a text cites, distinct, in order of appearance, ranges after single citations.

    A number with an ordinal word is ``n/2`` and so on, unless it has a slash already. A range
    stands for all its numbers if it ascends by under ``most``; with 0, ranges have no meaning. With
    ``own``, that id is left out. ``words`` are the ordinal words that count, all unless given.
    """
    text = F.coalesce(text, F.lit(""))
    choice = ORDINAL_CHOICE if words is None else "|".join(sorted(words, key=len, reverse=True))
    single = f"{SECTION_WORD}[ \\t\\r\\n]*({NUMBER})[ \\t\\r\\n]*({choice})?"
    suffix = F.create_map(*[F.lit(x) for pair in ORDINALS.items() for x in (pair[0], str(pair[1]))])
    numbers, words = (F.regexp_extract_all(text, F.lit(single), F.lit(i)) for i in (1, 2))
    named = F.zip_with(numbers, words, lambda n, w: F.when((w != "") & ~n.contains("/"), F.concat(to_arabic(n), F.lit("/"), F.try_element_at(suffix, w))).otherwise(to_arabic(n)))
    if not most:
        ids = F.array_distinct(named)
        return F.array_remove(ids, own) if own is not None else ids
    span = f"{SECTION_WORD}[ \\t\\r\\n]*([0-9๐-๙]+)[ \\t\\r\\n]*{RANGE_WORD}[ \\t\\r\\n]*(?:{SECTION_WORD}[ \\t\\r\\n]*)?([0-9๐-๙]+)"
    low, high = (F.transform(F.regexp_extract_all(text, F.lit(span), F.lit(i)), lambda x: to_arabic(x).try_cast("int")) for i in (1, 2))
    inside = F.zip_with(low, high, lambda a, b: F.when((b > a) & (b - a < most), F.transform(F.sequence(a, F.greatest(a, b)), lambda i: i.cast("string"))).otherwise(F.array().cast("array<string>")))
    ids = F.array_distinct(F.concat(named, F.flatten(F.filter(inside, lambda x: x.isNotNull()))))
    return F.array_remove(ids, own) if own is not None else ids


def statute_citations(text: Column, own: Column) -> Column:
    """What a section of a statute cites, itself left out."""
    return citations(text, own, words=STATUTE_ORDINALS)


def answer_citations(text: Column) -> Column:
    """What an answer cites: single sections only."""
    return citations(text, most=0)


def numbers_cited(text: Column, word: str, own: Column | None = None) -> Column:
    """The plain form of citations for any language: digits after ``word``, distinct, in order."""
    ids = F.array_distinct(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"{word}[ ]*([0-9]+)"), F.lit(1)))
    return F.array_remove(ids, own) if own is not None else ids


def json_block(text: Column) -> Column:
    """The outermost ``{...}`` of a model's answer, its thinking blocks removed."""
    return F.regexp_extract(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""), r"(?s)\{.*\}", 0)


def chosen_numbers(text: Column, n_options: int | Column, most: int) -> Column:
    """Option numbers in a model's answer: in range, distinct, the first ``most``."""
    found = F.transform(F.regexp_extract_all(text, F.lit("[0-9]+"), F.lit(0)), lambda x: x.try_cast("int"))
    return F.slice(F.array_distinct(F.filter(found, lambda i: (i >= 0) & (i < n_options))), 1, most)


def padded_verdicts(verdicts: Column, n: Column) -> Column:
    """``n`` verdicts: missing ones are false, surplus ones go."""
    given = F.coalesce(verdicts, F.array().cast("array<boolean>"))
    return F.slice(F.concat(given, F.array_repeat(F.lit(False), F.greatest(n, F.lit(0)))), F.lit(1), F.greatest(n, F.lit(0)))


def portable_hash(*parts: Column) -> Column:
    """32 bits of md5 as a number: the same draw in any engine, for sampling and resampling."""
    return F.conv(F.substring(F.md5(F.concat_ws("-", *[p.cast("string") for p in parts]).cast("binary")), 1, 8), 16, 10).cast("long")
