"""Near duplicates, components and packing, against brute force."""

import os
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spindrift.llm.components import components
from spindrift.llm.minhash import NearDuplicates, least_matches, shingle_set, surviving
from spindrift.llm.packing import Slots, WordEncoder, pack_documents, plan_packs
from spindrift.llm.queries import op3_embedding_dedup, op6_minhash
from spindrift.llm.vectors import MetricJoin

DATA = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def brute(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(40)] + [(7, 7), (900, 901), (901, 900), (None, 5)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    full = [x for x in links if x[0] is not None]
    assert got == brute({n for x in full for n in x}, full)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(seed=5, n=60):
    rng = random.Random(seed)
    base = [f"w{rng.randrange(5000)}" for _ in range(120)]
    out = [" ".join(base)]
    for i in range(n):
        words = list(base)
        for _ in range(rng.randrange(0, 14)):
            words[rng.randrange(len(words))] = f"x{rng.randrange(9999)}"
        out.append(" ".join(words).upper() if i % 9 == 0 else " ".join(words))
    return out + [" ".join(f"y{rng.randrange(5000)}" for _ in range(rng.randrange(1, 60))) for _ in range(40)] + out[:3]


def tuples(text, k):
    """The k-word shingles of a text, by the definition."""
    words = re.findall("[^ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_classes(texts, shingle, percent):
    sets = [tuples(t, shingle) for t in texts]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    both = Counter((j, i) for h in holders.values() for n, i in enumerate(h) for j in h[:n])
    links = [p for p, n in both.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return [len(s) for s in sets], brute(range(len(texts)), links), len(links)


@needs_tables
@pytest.mark.parametrize("shingle, percent, bands", [(3, 85, 25), (5, 80, 40)])
def test_recall_on_whole_documents(spark, shingle, percent, bands):
    """Both settings on all documents of a table: the classes are those of the definition."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    sizes, comp, n = plain_classes([r.text for r in rows], shingle, percent)
    got = {r.doc: (r.n_shingles, r.component) for r in NearDuplicates(shingle, percent, bands).classes(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    assert got == {r.doc_id: (sizes[i], rows[comp[i]].doc_id) for i, r in enumerate(rows)} and n > 50


@needs_tables
def test_minhash_query_equals_definition(spark):
    rows = spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").collect()
    sizes, comp, _ = plain_classes([r.text for r in rows], 3, 85)
    want = [(r.doc_id, sizes[i], rows[comp[i]].doc_id, comp[i] == i) for i, r in enumerate(rows)]
    assert sorted(map(tuple, op6_minhash(spark, DATA).collect())) == want


def test_repeated_ids_are_told_apart_by_text(spark):
    base, other = " ".join(f"a{i}" for i in range(80)), " ".join(f"b{i}" for i in range(80))
    near = base.replace("a40", "zz")
    rows = [(1, base), (5, near), (5, "nothing like it at all"), (5, "nothing like it at all"), (6, None), (6, None), (6, "x y"), (7, other), (None, base), (None, base), (-4, other + " end")]
    kept = sorted(map(tuple, NearDuplicates().deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    assert kept == sorted([(5, near), (5, "nothing like it at all"), (6, None), (6, "x y"), (-4, other + " end"), (None, base), (None, base)], key=repr)


@pytest.mark.parametrize("shingle, percent", [(3, 85), (5, 80)])
def test_minhash_equals_brute_force(spark, odd, shingle, percent):
    texts = copies() + [r.text for r in odd.collect()]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = [tuples(t, shingle) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])]
    want = brute(range(len(texts)), links)
    got = NearDuplicates(shingle, percent, block=16, block_shingles=3000).classes(docs).collect()
    assert {r.doc: r.component for r in got} == want and len(got) == len(texts)
    assert all(r.kept == (r.doc == want[r.doc]) and r.n_shingles == len(sets[r.doc]) for r in got)


def test_minhash_odd_rows(odd, none):
    near = NearDuplicates()
    got = near.classes(odd)
    assert got.count() == odd.count()
    assert all(r.component is None and r.kept for r in got.where("doc is null").collect())
    kept = near.deduplicated(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted([i for i in range(13) if i != 10] + [3])
    assert near.classes(none).count() == 0 and near.deduplicated(none).count() == 0


def test_shingles():
    assert len(shingle_set("a b", 3)) == 1 and len(shingle_set("", 3)) == 0 and len(shingle_set(None, 3)) == 0
    assert (shingle_set("A b\tC", 3) == shingle_set("a B  c", 3)).all()
    assert (shingle_set("É x y", 3) != shingle_set("é x y", 3)).all()  # only A-Z are lowered


def test_pruning_bounds():
    least = least_matches([32, 64, 128], 0.85, 1e-6)
    assert least == sorted(least) and 0 < least[0] < 0.85 * 32
    a, b = np.zeros((2, 128), np.uint32), np.zeros((2, 128), np.uint32)
    b[1] = 1
    assert surviving(a, b, [32, 64, 128], least).tolist() == [0]


def plain_links(rows, least=0.95):
    """n_links and component of each row: distinct (id, vector) pairs are compared one by one."""
    unit = lambda v: np.array(v, float) / np.linalg.norm(v)
    ok = {i: unit(v) for i, (n, v) in enumerate(rows) if n is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    first = {i: min(j for j in ok if rows[j][0] == rows[i][0] and len(ok[i]) == len(ok[j]) and np.abs(ok[i] - ok[j]).max() < 1e-12) for i in ok}
    ones = sorted(set(first.values()))
    links = {(i, j) for i in ones for j in ones if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] >= least}
    comp = brute({n for n, _ in rows if n is not None}, [(rows[i][0], rows[j][0]) for i, j in links])
    return [(sum(a == first.get(i) for a, _ in links), comp.get(n)) for i, (n, _) in enumerate(rows)]


@pytest.mark.parametrize("kind, block", [("double", 16 * 8 * 16), ("float", 40 * 8 * 16), ("float", 8 << 20)])
def test_metric_join_equals_brute_force(spark, kind, block):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(40, 16))
    near = base[rng.integers(0, 5, 150)] + rng.normal(scale=0.08, size=(150, 16)) * rng.random((150, 1)) * 2
    all_ = [v.astype(np.float32).tolist() for v in np.concatenate([base, near, near[:6], near[:2]])]
    all_ += [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None], [1.0, 2.0], [1.0, 2.0], [2.0, 4.0]]
    rows = [(i * 3, v) for i, v in enumerate(all_)]
    rows += [rows[0], rows[45], rows[45], (7, rows[50][1]), (9, rows[60][1]), (9, rows[61][1]), (9, [5.0] * 16), (None, rows[45][1]), (None, None)]
    want = sorted(map(repr, [(n, *x, x[1] is None or x[1] == n) for (n, _), x in zip(rows, plain_links(rows), strict=True)]))
    table = spark.createDataFrame([(n, v, 1, "x") for n, v in rows], f"vec_id long, embedding array<{kind}>, n_links int, key string")
    got = MetricJoin(block_bytes=block).classes(table).collect()
    assert sorted(repr((r.vec, r.n_links, r.component, r.kept)) for r in got) == want
    assert sum(r.n_links for r in got) > 300
    assert MetricJoin().classes(table.limit(0)).count() == 0
    assert MetricJoin().classes(spark.createDataFrame([(None, [1.0]), (None, [1.0]), (2, None)], "vec_id long, embedding array<double>")).count() == 3


def test_repeated_rows_are_one_vector(spark):
    rows = [(7, [1.0, 0.0]), (7, [1.0, 0.0]), (5, [0.0, 1.0]), (5, [0.0, 1.0]), (6, [0.01, 1.0]), (8, [-1.0, 0.0]), (4, [-1.0, 0.0])]
    got = {r.vec: (r.n_links, r.component) for r in MetricJoin().classes(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got == {7: (0, 7), 5: (1, 5), 6: (1, 5), 8: (1, 4), 4: (1, 4)}


@needs_tables
def test_embedding_query_equals_brute_force(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    want = sorted((n, *x, x[1] == n) for (n, _), x in zip(rows, plain_links(rows), strict=True))
    assert sorted(map(tuple, op3_embedding_dedup(spark, DATA).collect())) == want


def test_plan_places_every_length():
    rng = random.Random(1)
    histogram = {rng.randrange(1, 200): rng.randrange(1, 50) for _ in range(80)} | {200: 9}
    plan = plan_packs(histogram, 200)
    placed = defaultdict(int)
    for count, lengths in plan:
        assert sum(lengths) <= 200
        for x in lengths:
            placed[x] += count
    assert placed == histogram
    slots, taken = Slots(plan), defaultdict(list)
    for length, n in histogram.items():
        for seq, off, total in zip(*slots.place(np.full(n, length), np.arange(n)), strict=True):
            taken[seq].append((off, length, total))
    assert sorted(taken) == list(range(sum(c for c, _ in plan)))
    for parts in taken.values():
        at = 0
        for off, length, total in sorted(parts):
            assert off == at
            at += length
        assert at == total


def test_words_encode_as_the_library_does(odd):
    path = P.path("word_bpe_49k.json")
    tok, coder = Tokenizer.from_file(path), WordEncoder(path, 1000)
    texts = [r.text for r in odd.collect()] + ["A'b\x1cc  d", "é ́a", "ΑΣ ΟΔΟΣ x", "İ ẛ̣", "don't'll ÀÉ", "word, word. word", " a\u00a0b \u2003 Cc\x85d ", "ÀÖØÞß àöøþß ÿ! Ÿ?!,", "e\u0301 Word,.", "\v\f\rX\t", "\u00d7\u00f7 a\u00d7b"]
    for some in (texts, texts[3:9], texts[-6:], [], [None]):
        ids, bounds = coder.block(pa.array(some, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [tok.encode(t or "", add_special_tokens=False).ids for t in some]
    ids, bounds = coder.block(pa.array(texts, pa.string()).slice(4, 5))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [tok.encode(t or "", add_special_tokens=False).ids for t in texts[4:9]]


def test_packing(odd, none):
    path, most = P.path("word_bpe_49k.json"), 64
    tok = Tokenizer.from_file(path)
    want = sorted(tok.encode(r.text or "", add_special_tokens=False).ids + [2] for r in odd.collect())
    got = pack_documents(odd, path, most, with_ids=True).collect()
    seqs = defaultdict(list)
    for r in got:
        assert r.length == len(r.ids) <= most and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        seqs[r.sequence_id].append((r.offset, r.length, r.sequence_tokens))
    for parts in seqs.values():
        assert [o for o, _, _ in sorted(parts)] == np.cumsum([0] + [n for _, n, _ in sorted(parts)])[:-1].tolist() and sum(n for _, n, _ in parts) == parts[0][2] <= most
    whole = defaultdict(list)
    for r in got:
        whole[(r.doc_id, r.doc_tokens, r.start)].append(r.ids)
    assert sum(r.length for r in got) == sum(map(len, want))
    assert sorted(r.ids for r in got if r.start == 0 and r.length == r.doc_tokens) == [w for w in want if len(w) <= most]
    assert pack_documents(none, path, most).count() == 0
