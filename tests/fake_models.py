"""Python models as a user would write them: lists in, lists out."""

import json


class Vectors:
    def encode(self, texts):
        assert len(texts) <= 64
        return [[float(len(t)), 1.0, float("apple" in t)] for t in texts]


class Scores:
    def score(self, queries, documents):
        return [float(len(set(q.split()) & set(d.split()))) for q, d in zip(queries, documents, strict=True)]


class Upper:
    def answer(self, prompts):
        return [p.upper() for p in prompts]


class Judge:
    def ground(self, claims, contexts):
        return [[c in x for c in cs] if cs is not None else [] for cs, x in zip(claims, contexts, strict=True)]

    def correctness(self, answers, references):
        return [5 if r and r in a else 1 for a, r in zip(answers, references, strict=True)]


class Drafter:
    def draft(self, prompts):
        return ["Sure: " + json.dumps({"question": f" What is {p.splitlines()[0]}? ", "reference_answer": "so", "answer_claims": ["a", "b"]}) if "broken" not in p else "no" for p in prompts]


class LastOption:
    def answer(self, prompts):
        return [f"I choose 99 and {p.count(chr(10)) - 2}." for p in prompts]


def halves(text):
    return [text[: len(text) // 2], " ", text[len(text) // 2 :]]
