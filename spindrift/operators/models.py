"""Slots for models, with offline stand-ins. Nothing here touches a network."""

from __future__ import annotations

import importlib
import random
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chosen_numbers, portable_hash, word_tokens


class NotConfigured(RuntimeError):
    """A slot was used that no model fills."""


class TransientError(RuntimeError):
    """A model's call that may succeed later."""


class Embedder(Protocol):
    def encode(self, text: Column) -> Column: ...


class Reranker(Protocol):
    def score(self, query: Column, document: Column) -> Column: ...


class TreeNavigator(Protocol):
    def navigate(self, tree: DataFrame, queries: DataFrame, k: int) -> DataFrame: ...


class NodeSelector(Protocol):
    def select(self, options: DataFrame, most: int) -> DataFrame: ...


class Generator(Protocol):
    def answer(self, prompt: Column) -> Column: ...


class Judge(Protocol):
    def ground(self, claims: Column, context: Column) -> Column: ...

    def correctness(self, answer: Column, reference: Column) -> Column: ...


class Drafter(Protocol):
    def draft(self, prompt: Column) -> Column: ...


def with_retries(call: Callable, attempts: int = 9, longest: float = 30.0, wait: Callable[[float], None] = time.sleep) -> Callable:
    """``call``, tried again after transient errors: it waits twice as long each time, ``longest``
    seconds at most, and a random part of 1.5 s more, so that tasks don't come back together."""

    def run(*args):
        for attempt in range(attempts):
            try:
                return call(*args)
            except (TransientError, ConnectionError, TimeoutError):
                if attempt == attempts - 1:
                    raise
                wait(min(longest, 2.0**attempt) + random.uniform(0, 1.5))

    return run


def in_batches(spec: str, method: str, returns: str, size: int = 64, attempts: int = 9) -> Callable[..., Column]:
    """A method of a Python model as an expression over columns.

    ``spec`` names a class (``module:Class``), made once in each Python worker; ``method`` gets lists
    of at most ``size`` values, one list for each column, and gives a list of results. Calls that
    fail in passing are repeated. This is the place for models behind a network or on a device.
    """

    def run(parts: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        call = with_retries(getattr(load(spec, None), method), attempts)
        for columns in parts:
            lists = [[x.tolist() if isinstance(x, np.ndarray) else x for x in c] for c in columns]
            out: list = []
            for at in range(0, len(columns[0]), size):
                out += list(call(*(x[at : at + size] for x in lists)))
            yield pd.Series(out, dtype=object if not out or isinstance(out[0], (list, str, dict, bool)) else None)

    def one(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from run((p,) for p in parts)

    def expression(*columns: Column) -> Column:
        if len(columns) == 1:
            one.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
            return F.pandas_udf(one, returns)(*columns)
        run.__annotations__ = {"parts": Iterator[tuple[pd.Series, ...]], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, returns)(*columns)

    return expression


class BatchedEmbedder:
    """An ``Embedder`` of a model with ``encode(texts)``, which gives a list of vectors."""

    def __init__(self, spec: str, size: int = 64):
        self.encode = in_batches(spec, "encode", "array<double>", size)


class BatchedReranker:
    """A ``Reranker`` of a model with ``score(queries, documents)``, which gives a list of numbers."""

    def __init__(self, spec: str, size: int = 64):
        self.score = in_batches(spec, "score", "double", size)


class BatchedGenerator:
    """A ``Generator`` of a model with ``answer(prompts)``."""

    def __init__(self, spec: str, size: int = 8):
        self.answer = in_batches(spec, "answer", "string", size)


class BatchedJudge:
    """A ``Judge`` of a model with ``ground(claims, contexts)``, a list of verdicts for each, and ``correctness(answers, references)``."""

    def __init__(self, spec: str, size: int = 8):
        self.ground = in_batches(spec, "ground", "array<boolean>", size)
        self.correctness = in_batches(spec, "correctness", "int", size)


class BatchedDrafter:
    """A ``Drafter`` of a model with ``draft(prompts)``, which gives the text of an answer for each."""

    def __init__(self, spec: str, size: int = 8):
        self.draft = in_batches(spec, "draft", "string", size)


class Descent:
    """The ``TreeNavigator`` that descends by beams; a ``NodeSelector`` may take the place of word overlap."""

    def __init__(self, width: int = 5, depth: int = 5, selector: NodeSelector | None = None):
        self.width, self.depth, self.selector = width, depth, selector

    def navigate(self, tree: DataFrame, queries: DataFrame, k: int) -> DataFrame:
        from .retrieval import descend

        return descend(tree, queries, k, self.width, self.depth, select=self.selector.select if self.selector else None)


class ListedSelector:
    """A ``NodeSelector`` of a model that answers with the numbers of options.

    ``answer`` gets a prompt per query and node, a line of instruction and the numbered options, and
    its answer's numbers choose: out of range ones and repeated ones go, the first ``most`` stay.
    """

    def __init__(self, answer: Callable[[Column], Column], instruction: str = "Choose the numbers of at most {most} headings that matter most for the question."):
        self.answer, self.instruction = answer, instruction

    def select(self, options: DataFrame, most: int) -> DataFrame:
        """Options have query_id, text (the question), node, pos and display; choice is their place among the chosen."""
        w = Window.partitionBy("query_id", "node")
        shown = options.withColumn("__nr", F.row_number().over(w.orderBy("pos")) - 1)
        line = F.concat(F.col("__nr").cast("string"), F.lit(". "), F.coalesce("display", F.lit("")))
        asked = shown.groupBy("query_id", "node").agg(F.max("text").alias("text"), F.count("*").cast("int").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("__nr", line.alias("line")))), lambda x: x["line"]), "\n").alias("list"))
        prompt = F.concat(F.lit(self.instruction.format(most=most)), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit("\n"), F.col("list"))
        chosen = asked.select("query_id", "node", F.posexplode(chosen_numbers(self.answer(prompt), F.col("n"), most)).alias("__c", "__nr"))
        return shown.join(chosen, ["query_id", "node", "__nr"]).withColumn("choice", F.col("__c") + 1).drop("__nr", "__c")


class HashEmbedder:
    """Counts of hashed words, scaled to length 1."""

    def __init__(self, width: int = 64):
        self.width = width

    def encode(self, text: Column) -> Column:
        slots = F.transform(word_tokens(text), lambda t: F.pmod(portable_hash(t), F.lit(self.width)).cast("int"))
        counts = F.transform(F.array(slots), lambda s: F.transform(F.sequence(F.lit(0), F.lit(self.width - 1)), lambda i: F.size(F.filter(s, lambda x: x == i)).cast("double")))[0]
        norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
        return F.transform(F.array(counts), lambda v: F.transform(v, lambda x: x / F.greatest(norm(v), F.lit(1e-12))))[0]


class EchoGenerator:
    """Answers with the beginning of the prompt."""

    def answer(self, prompt: Column) -> Column:
        return F.substring(prompt, 1, 400)


class LexicalJudge:
    """A claim is grounded if all of its words are in the context; correctness from 1 to 5 by shared words."""

    def ground(self, claims: Column, context: Column) -> Column:
        return F.transform(claims, lambda c: F.size(F.array_except(word_tokens(c), word_tokens(context))) == 0)

    def correctness(self, answer: Column, reference: Column) -> Column:
        wanted = F.array_distinct(word_tokens(reference))
        share = F.size(F.array_intersect(wanted, F.array_distinct(word_tokens(answer)))) / F.greatest(F.size(wanted), F.lit(1))
        return (1 + F.bround(share * 4, 0)).cast("int")


class Unset:
    """Raises as soon as a plan wants it."""

    def __init__(self, slot: str):
        self.slot = slot

    def __getattr__(self, name: str):
        raise NotConfigured(f"no model fills the slot {self.slot!r}")


def load(name: str | None, default):
    """``module:Class`` as an instance; None gives the default."""
    if name is None:
        return default
    module, _, cls = name.partition(":")
    return getattr(importlib.import_module(module), cls)()
