"""Every training-data query on a whole table, against SQL, the libraries or a plain version of its contract."""

import base64
import hashlib
import os
import re
import zlib
from collections import defaultdict
from pathlib import Path

import duckdb
import numpy as np
import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from spindrift.llm import queries as q
from spindrift.llm.oracles import ORACLES

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def con(folder):
    c = duckdb.connect()
    for f in Path(folder).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}{'/*' if f.is_dir() else ''}'")
    return c


@pytest.fixture(scope="module")
def texts():
    return dict(con(DATA).execute("SELECT doc_id, coalesce(text, '') FROM documents").fetchall())


def plain(x):
    return round(x, 9) + 0.0 if isinstance(x, float) else x


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_sql(spark, name):
    df = q.QUERIES[name](spark, DATA)
    want = con(DATA).execute(ORACLES[name])
    names = sorted(x[0] for x in want.description)
    assert sorted(df.columns) == names
    order = [[x[0] for x in want.description].index(n) for n in names]
    got = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall()) and got


def test_all_are_registered():
    assert set(q.QUERIES) | {"pipeline"} == {n for n in __spark_entry__.queries() if re.match(r"op\d+_|pipeline$", n)}
    assert sorted(int(re.match(r"op(\d+)_", n)[1]) for n in q.QUERIES) == list(range(1, 11))


def test_byte_bpe(spark, texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for i, t in texts.items():
        ids = library.encode_ordinary(t)
        want.append((i, len(ids), sha(" ".join(map(str, ids)).encode()), sha(t.encode())))
    assert sorted(map(tuple, q.op2_byte_bpe(spark, DATA).collect())) == sorted(want)


def test_token_counts(spark, texts):
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    n = {i: len(library.encode(t, add_special_tokens=False)) for i, t in texts.items()}
    assert sorted(map(tuple, q.op10_token_counts(spark, DATA).collect())) == sorted((i, len(t.encode()), n[i], n[i] > 512) for i, t in texts.items())


def check_packing(rows, texts):
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t, add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, places = defaultdict(list), defaultdict(list)
    for r in rows:
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and r.doc_tokens == len(ids[r.doc_id]) and r.length > 0
        pieces[r.doc_id].append((r.start, r.length))
        places[r.sequence_id].append((r.offset, r.length))
    for found, ends in ((pieces, {i: len(x) for i, x in ids.items()}), (places, {})):
        for key, parts in found.items():
            at = 0
            for start, length in sorted(parts):
                assert start == at
                at += length
            assert at == ends[key] if ends else at <= 4096
    assert set(pieces) == set(ids)
    return sum(map(len, ids.values())), len(places)


def test_packing(spark, texts):
    tokens, sequences = check_packing(q.op5_packing(spark, DATA).collect(), texts)
    assert sequences <= tokens / 4096 * 1.1 + 1


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.01"
    labels = dict(con(folder).execute("SELECT doc_id, quality FROM labels").fetchall())
    rows = q.op7_quality_classifier(spark, folder).collect()
    assert len(rows) == con(folder).execute("SELECT count(*) FROM documents").fetchone()[0]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in labels]
    assert len(held) > 40 and np.mean([r.predicted == labels[r.doc_id] for r in held]) >= 0.95


def shingles(text, k):
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def test_pipeline_stage_by_stage(spark):
    """Each stage on all that the one before kept, against its plain version; then the whole run."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, DATA)
        assert after.columns == docs.columns
        kept = {r.doc_id: r for r in after.collect()}
        assert set(kept) <= set(before) and all((kept[i].lang, kept[i].source) == (before[i].lang, before[i].source) and kept[i].n_chars == len(kept[i].text) for i in kept)
        if name == "quality_rules":
            judged = con(DATA).execute(f"SELECT doc_id, kept FROM ({ORACLES['op4_quality_rules']})").fetchall()
            assert set(kept) == {i for i, good in judged if good}
            assert all(set(kept[i].text.split("\n")) <= set(before[i].text.split("\n")) for i in kept)
        elif name == "quality_classifier":
            assert len(kept) > 0.9 * len(before) and all(kept[i] == before[i] for i in kept)
        elif name == "minhash_near_dedup":
            sets = {i: shingles(r.text, 5) for i, r in before.items()}
            near = {(i, j) for i in sets for j in sets if i < j and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and sets[i]}
            least = {i: i for i in sets}
            for _ in sets:
                for i, j in near:
                    least[i] = least[j] = min(least[i], least[j])
            assert set(kept) == {i for i in sets if least[i] == i} and near
        elif name == "secret_scan":
            assert set(kept) == set(before)
            assert all(kept[i].text == before[i].text or corpus_pipeline.MASK in kept[i].text for i in kept)
            assert not any(re.search("[0-9a-f]{16}|AKIA[A-Z0-9]{14}", r.text) for r in kept.values())
        docs, before = spark.createDataFrame(list(kept.values()), docs.schema), kept
    rows = corpus_pipeline.run(spark, DATA).collect()
    check_packing(rows, {i: r.text for i, r in before.items()})


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Columns of the operators' names keep their values; null and repeated rows; no rows at all."""
    prose = lambda s, n=100: "\n".join(" ".join(f"{s}{x}" for x in range(y, y + 20)) + "." for y in range(0, n, 20))
    rows = [(1, prose("a"), -7, True, 0.5, "x", [1]), (1, prose("a"), -7, True, 0.5, "x", [1]), (1, prose("b"), -6, False, 0.1, "y", [2]), (2, prose("a") + " end", 1, None, None, None, None), (3, None, 0, None, None, None, None), (3, "", 0, None, None, None, None), (None, prose("c"), 5, None, None, None, None), (None, prose("c"), 5, None, None, None, None), (9, prose("d", 40_000), 0, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, kept boolean, score double, predicted string, base array<int>")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    at = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path))
        assert at.columns == docs.columns
    got = sorted((r.doc_id or 0, r.n_words, r.kept, r.score, r.predicted, r.base) for r in at.collect())
    assert [g[:2] for g in got] == [(0, 5), (0, 5), (1, -7), (1, -6), (9, 0)] and got[2][2:] == (True, 0.5, "x", [1])
    assert corpus_pipeline.run(spark, str(tmp_path)).where("doc_id = 9").agg(F.sum("length")).first()[0] > 4096
    empty = tmp_path / "none"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
