"""URLs, chats, the classifier and the pipeline."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from spindrift.llm import urls
from spindrift.llm.chat import format_chats, in_reply_order, threads
from spindrift.llm.classifier import WIDTH, AttentionModel, classify, encode_passages, train
from spindrift.llm.queries import RULES

URLS = ["http://a.NET/x", "http://a.net", "http://example.net/en/1", "https://m.example.net/de/", "x://example.com/de/?q", "x://badexample.com/de/", "x://org/fr/", "x://a.b.org/fr/z#t", "x://ORG/FR/", "http://u@h.net:80/p", "://", "nothing", "", None, "a://b://c.net/", "http://x.example.net/en/" + "y" * 20_000, "http://a.NET/x"]


def plain_verdict(url, rules):
    if not url or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    host = rest[: min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))]
    path = rest[len(host) :]
    path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best and best[3], best[2] if best else "allow"


@pytest.mark.parametrize("most_bits, most_shapes", [(1 << 23, 1000), (8, 1000), (1 << 23, 2), (64, 1)])
def test_urls_equal_plain_rules(spark, most_bits, most_shapes):
    rules = RULES + [("b.org", "/", "block"), ("org", "/fr/z", "allow"), ("net", "/x", "allow"), ("net", "/x", "block")]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(URLS)], "page_id int, url string, rule string")
    got = urls.url_filter(pages, urls.rule_table(spark, rules), most_bits=most_bits, most_shapes=most_shapes).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == {i: plain_verdict(u, rules) for i, u in enumerate(URLS)}
    assert len(got) == len(URLS)
    assert urls.url_filter(pages.limit(0), urls.rule_table(spark, rules)).count() == 0
    assert {r.verdict for r in urls.url_filter(pages, urls.rule_table(spark, RULES).limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = keys.where("key like '%7'")
    member = urls.cascade(listed, keys, bits_per_key=3)
    assert keys.where(member(F.col("key")) != F.col("key").like("%7")).count() == 0
    nothing = urls.cascade(keys.limit(0), keys)
    assert keys.where(nothing(F.col("key"))).count() == 0 and keys.limit(0).where(urls.cascade(listed, keys.limit(0))(F.col("key"))).count() == 0


def test_a_level_too_large_is_told(spark):
    """Few listed keys, but too many mistakes of theirs in the universe."""
    keys = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"))
    with pytest.raises(urls.TooLong):
        urls.cascade(keys.where("key like '%77'"), keys, bits_per_key=1, most_bits=512)


def test_many_shapes(spark):
    rules = [(f"h{i % 7}.net", "/" + "p" * (i // 7), "block" if i % 2 else "allow") for i in range(700)]
    pages = spark.createDataFrame([(i, f"http://www.h{i % 9}.net/{'p' * (i % 130)}x") for i in range(300)], "page_id int, url string")
    want = {i: plain_verdict(f"http://www.h{i % 9}.net/{'p' * (i % 130)}x", rules) for i in range(300)}
    for most in (1000, 50):
        got = urls.url_filter(pages, urls.rule_table(spark, rules), most_shapes=most).collect()
        assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in got} == want


MESSAGES = [
    (1, 0, "user", "Hello there friend.\nHow are you today?"), (1, 1, "assistant", "I am fine, thanks a lot."), (1, 2, "user", "Ann wrote:\n> hello  THERE friend.\nGood question\n> How are you today?"),
    (1, 3, "assistant", "> > hello there friend.\n> Good question\nindeed"), (1, 4, "user", "later"), (1, 4, "user", "later"), (2, 5, None, None), (2, 1500, "user", "x\ny"), (2, 4000, "u", "> x y\nz"), (None, 1, "u", "> q"), (3, None, "u", "t"),
]


def test_chats(spark):
    table = spark.createDataFrame([(*m, 0) for m in MESSAGES], "conv_id long, turn long, role string, text string, block int")
    got = {(r.conv_id, r.turn): (r.content, r.linked, r.reply_to, r.branch) for r in format_chats(table).collect()}
    assert got == {
        (1, 0): ("Hello there friend.\nHow are you today?", False, None, 0), (1, 1): ("I am fine, thanks a lot.", False, 0, 0), (1, 2): ("Good question", True, 0, 2), (1, 3): ("indeed", True, 2, 2), (1, 4): ("later", False, 3, 2),
        (2, 5): ("", False, None, 5), (2, 1500): ("x\ny", False, 5, 5), (2, 4000): ("z", True, 1500, 5), (None, 1): ("", False, None, None), (3, None): ("t", False, None, None),
    }
    assert format_chats(table).count() == len(MESSAGES) and format_chats(table.limit(0)).count() == 0
    assert {(r.conv_id, r.turn): (r.root, r.depth) for r in format_chats(table).where("branch is not null").collect()} == {(1, 0): (0, 0), (1, 1): (0, 1), (1, 2): (0, 1), (1, 3): (0, 2), (1, 4): (0, 3), (2, 5): (5, 0), (2, 1500): (5, 1), (2, 4000): (5, 2)}


def test_threads_by_walking(spark):
    """Any tree of answers, deep and wide, in turns far apart: the place is where walking leads."""
    import random

    rng, rows = random.Random(2), []
    for conv in range(3):
        previous, up = None, {}
        for turn in sorted(rng.sample(range(9000), 300)):
            up[turn] = previous if previous is None or rng.random() < 0.5 else rng.choice(list(up))
            rows.append((conv, turn, up[turn], previous))
            previous = turn
    branch, keyed = None, []
    for conv, turn, up, previous in rows:
        branch = turn if previous is None or up != previous else branch
        keyed.append((conv, turn, turn // 1024, up, branch))
    got = {(r.conv, r.turn): (r.root, r.depth) for r in threads(spark.createDataFrame(keyed, "conv long, turn long, block long, reply_to long, branch long")).collect()}
    ups = {(c, t): u for c, t, u, _ in rows}
    for c, t in ups:
        root, depth = t, 0
        while ups[c, root] is not None:
            root, depth = ups[c, root], depth + 1
        assert got[c, t] == (root, depth)


def test_reply_order(spark):
    table = spark.createDataFrame(MESSAGES, "conv_id long, turn long, role string, text string")
    rows = in_reply_order(format_chats(table).where("branch is not null")).collect()
    seen = set()
    for r in rows:
        assert r.reply_to is None or (r.conv_id, r.reply_to) in seen
        seen.add((r.conv_id, r.turn))


def test_chat_oracle(spark):
    import duckdb
    from spindrift.llm.oracles import ORACLES

    full = [m for m in MESSAGES if m[0] is not None and m[1] is not None]
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", [list(m) for m in full])
    want = sorted(map(repr, con.execute(ORACLES["op8_chat_format"]).fetchall()))
    got = format_chats(spark.createDataFrame(full, "conv_id long, turn long, role string, text string"))
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def labelled(n=400):
    rng = np.random.default_rng(0)
    words = ["the", "stone", "river", "of", "and", "light", "house", "tree", "over", "green"]
    rows = []
    for i in range(n):
        good = i % 4 != 0
        text = " ".join(rng.choice(words, rng.integers(20, 300))) if good else " ".join(f"{w.upper()}!!" for w in rng.choice(words, rng.integers(20, 300)))
        rows.append((i, text, int(good)))
    return rows


def test_classifier_learns(spark, odd, none):
    rows = labelled()
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(r[0], r[2], 0) for r in rows] + [(None, 1, 0), (5, None, 0)], "doc_id long, quality int, toxic int")
    model = train(docs, labels, most_labels=200)
    got = {r.doc_id: r.predicted for r in classify(docs, model).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 5 == 0]
    assert np.mean([got[i] == y for i, _, y in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in classify(odd, model).collect()) and classify(odd, model).count() == odd.count()
    assert classify(none, model).count() == 0


def test_labels_of_held_out_rows_are_never_read(spark):
    rows = labelled(100)
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows]
    a, b = (train(docs, spark.createDataFrame(x, "doc_id long, quality int")) for x in ([(i, y) for i, _, y in rows], flip))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def plain_score(model, passages):
    """The network of one document, number by number."""
    import math

    p = {k: v.astype(float) for k, v in model.p.items()}
    tanh, sigmoid = np.tanh, lambda x: 1 / (1 + math.exp(-x))
    hs, es = [], []
    for x in passages:
        x = [min(8.0, max(-8.0, float((a - m) / s))) for a, m, s in zip(x, model.mean, model.scale, strict=True)]
        h = [float(tanh(sum(x[i] * p["W"][i, j] for i in range(len(x))) + p["b"][j])) for j in range(p["W"].shape[1])]
        gate = [float(tanh(sum(h[i] * p["V"][i, j] for i in range(len(h))))) * sigmoid(sum(h[i] * p["U"][i, j] for i in range(len(h)))) for j in range(p["V"].shape[1])]
        hs.append(h)
        es.append(math.exp(sum(g * w for g, w in zip(gate, p["w"], strict=True))))
    z = [sum(e * h[j] for e, h in zip(es, hs, strict=True)) / sum(es) for j in range(len(hs[0]))]
    return sigmoid(sum(a * b for a, b in zip(z, p["c"], strict=True)) + float(p["d"][0]))


def small_model():
    x, counts = encode_passages(["a b c " * 200, "x " * 700, "A!! " * 400, "mixed Text, 12. " * 90, "z"])
    model = AttentionModel(hidden=5, gate=3, seed=3).fit(x, counts, np.array([1, 1, 0, 0, 1], np.float32), epochs=5)
    return model, x, counts


def test_forward_equals_plain_version():
    model, x, counts = small_model()
    ends = np.cumsum(counts)
    want = [plain_score(model, x[e - c : e]) for c, e in zip(counts, ends, strict=True)]
    assert np.allclose(model.forward(x, counts)["score"], want, atol=1e-5) and max(counts) > 2


def test_gradients_equal_finite_differences():
    """One step without momentum shows the gradient that ``fit`` uses."""
    model, x, counts = small_model()
    y = np.array([1, 0, 0, 1, 1], np.float32)
    model.p = {k: v.astype(np.float64) for k, v in model.p.items()}

    def loss():
        s = np.clip(model.forward(x.astype(np.float64), counts)["score"], 1e-12, 1 - 1e-12)
        return float(-(y * np.log(s) + (1 - y) * np.log(1 - s)).mean())

    grads = model.gradients(x.astype(np.float64), counts, y)
    rng = np.random.default_rng(0)
    for k, v in model.p.items():
        for _ in range(6):
            at = tuple(int(rng.integers(0, n)) for n in v.shape)
            old, step = v[at], 1e-5
            v[at] = old + step
            up = loss()
            v[at] = old - step
            down = loss()
            v[at] = old
            assert abs((up - down) / (2 * step) - grads[k][at]) < 1e-6, k


def test_scores_depend_on_the_text_alone():
    texts = ["a b c", None, "x " * 2000, "A!! " * 400, "é" * 3000, ""]
    x, counts = encode_passages(texts)
    for i, t in enumerate(texts):
        assert (encode_passages([t])[0] == x[counts[:i].sum() : counts[: i + 1].sum()]).all()
    whole = pa.array(["before", *texts, "after"], pa.string())
    assert (encode_passages(whole.slice(1, len(texts)))[0] == x).all() and len(encode_passages([])[1]) == 0


def test_memory_for_a_very_long_text(monkeypatch):
    import tracemalloc

    text = "some words and more " * 300_000
    tracemalloc.start()
    AttentionModel().score([text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 3 * len(text) + 100_000_000


def test_texts_beyond_the_sample_are_left_out(spark):
    docs = spark.createDataFrame([(1, "good text here " * 40), (2, "BAD!! " * 100), (3, "x" * 200_000), (1, "again")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 0)], "doc_id long, quality int")
    a, b = (train(d, labels, most_passages=20) for d in (docs, docs.where("doc_id <> 3")))
    assert all((a.p[k] == b.p[k]).all() for k in a.p)


def test_gradients_lower_the_loss_and_empty_training_works(spark):
    x, counts = encode_passages(["a b c", None, "x " * 2000, "A!! " * 400])
    assert x.shape == (counts.sum(), WIDTH) and counts.min() == 1
    y = np.array([1, 1, 1, 0], np.float32)
    m = AttentionModel().fit(x, counts, y, epochs=60)
    assert ((m.forward(x, counts)["score"] > 0.5) == y).all()
    empty = train(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, quality int"))
    assert empty.score(["anything", None]).tolist() == [0.5, 0.5]


def test_stages(spark, tmp_path):
    rng = np.random.default_rng(4)
    prose = lambda: "\n".join(" ".join(f"w{x}" for x in rng.integers(0, 3000, 20)) + "." for _ in range(6))
    one = prose()
    texts = [one, one, one.replace("w1", "w2", 1), prose() + "\npassword = hunter2hunter2x more words here.", "short", "SHOUT!! " * 100, None, prose()]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, 1), (3, 1), (5, 0), (7, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.quality_stage(spark, docs, str(tmp_path))
    assert sorted(r.doc_id for r in kept.collect()) == [0, 1, 2, 3, 7] and kept.columns == docs.columns
    near = corpus_pipeline.near_duplicate_stage(spark, kept, str(tmp_path))
    assert sorted(r.doc_id for r in near.collect()) == [0, 3, 7]
    clean = {r.doc_id: r for r in corpus_pipeline.secret_stage(spark, near, str(tmp_path)).collect()}
    assert corpus_pipeline.MASK in clean[3].text and clean[3].n_chars == len(clean[3].text) and clean[0].text == one
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "minhash_near_dedup", "secret_scan", "packing"]
    assert corpus_pipeline.run(spark, str(tmp_path)).count() >= 1


def test_training_holds_one_part_beside_its_features(monkeypatch):
    """Features stay 16-bit numbers, and parts give what the whole gives."""
    import tracemalloc

    from spindrift.llm import classifier

    r = np.random.default_rng(5)
    counts = r.integers(1, 40, 2_000)
    y = (r.random(2_000) < 0.5).astype(np.float32)
    x = (r.random((counts.sum(), classifier.WIDTH)) * 0.2 + np.repeat(y, counts)[:, None] * 0.05).astype(np.float16)
    whole = classifier.AttentionModel().fit(x, counts, y, epochs=4)
    monkeypatch.setattr(classifier, "LEARNED", 1_000)
    tracemalloc.start()
    parts = classifier.AttentionModel().fit(x, counts, y, epochs=4)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < x.nbytes
    for k, v in whole.p.items():
        assert parts.p[k] == pytest.approx(v, abs=2e-3), k
