"""Operators on single texts, against plain versions of their contracts."""

import base64
import re

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from spindrift.llm import bpe, secret_scan
from spindrift.llm.quality_rules import quality_rules
from spindrift.llm.token_counts import count_lengths, pieces, token_counts

RANKS, JSON = P.path("byte_bpe_50k.tiktoken"), P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_replay_equals_library(reference):
    @settings(max_examples=150, deadline=None)
    @given(st.text(alphabet=st.sampled_from("abeinrst ho\n.A1é日'=-"), max_size=80))
    def same(text):
        assert bpe.encoder(RANKS, P.PATTERN, 1000).block([text]) == [reference.encode_ordinary(text)]

    same()


def test_replay_of_many_words_equals_one_by_one():
    v = bpe.Vocabulary.load(RANKS)
    words = [t + u for t, u in zip([x for x in v.tokens if x][::97], [x for x in v.tokens if x][5::97], strict=False)]
    assert bpe.replay(words, v) == [bpe.one_word(w, v) for w in words]


def test_merge_that_lowers_a_rank_is_redone():
    ranks = {bytes([b]): b for b in range(256)} | {b"abab": 256, b"ab": 257, b"aba": 258}
    v = bpe.Vocabulary(ranks)
    for word in (b"ababab", b"abababab", b"aabab", b"abcab"):
        assert bpe.replay([word], v) == [bpe.one_word(word, v)]


def by_definition(word, ranks):
    parts = [bytes([b]) for b in word]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], 1 << 40), i) for i in range(len(parts) - 1))
        if rank == 1 << 40:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return [ranks[p] for p in parts]


@given(st.lists(st.sampled_from(["ab", "ba", "aa", "bb", "abab", "aba", "bab", "aab", "abb", "aaaa"]), unique=True), st.lists(st.binary(min_size=1, max_size=14).map(lambda b: bytes(97 + x % 2 for x in b)), min_size=1, max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_ranks_equal_the_definition(merges, words):
    v = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {m.encode(): 256 + i for i, m in enumerate(merges)})
    want = [by_definition(w, v.ranks) for w in words]
    assert [bpe.one_word(w, v) for w in words] == want and bpe.replay(words, v) == want


def test_long_words_that_are_redone_take_no_square_of_time():
    import time

    v = bpe.Vocabulary({bytes([b]): b for b in range(256)} | {b"abab": 256, b"ab": 257, b"aba": 258})
    start = time.perf_counter()
    assert len(bpe.replay([b"ab" * 100_000], v)[0]) == 50_000
    assert time.perf_counter() - start < 10


def test_encode_decode_round_trip(odd, none, reference):
    coded = bpe.bpe_decode(bpe.bpe_encode(odd, RANKS, P.PATTERN), RANKS)
    rows = coded.collect()
    texts = [r.text for r in odd.collect()]
    assert sorted(bytes(r.decoded) for r in rows) == sorted((t or "").encode() for t in texts)
    assert sorted(map(list, (r.ids for r in rows))) == sorted(reference.encode_ordinary(t or "") for t in texts)
    assert bpe.bpe_encode(none, RANKS, P.PATTERN).count() == 0


def test_counts_equal_library(odd, none):
    tok = Tokenizer.from_file(JSON)
    got = sorted((r.n_bytes, r.n_tokens) for r in token_counts(odd, JSON).collect())
    want = sorted((len((t or "").encode()), len(tok.encode(t or "", add_special_tokens=False))) for t in (r.text for r in odd.collect()))
    assert got == want
    assert token_counts(none, JSON).count() == 0


def test_long_texts_are_cut_without_changing_counts():
    text = "some words <|endoftext|> and  double  spaces\n and more " * 200
    whole = Tokenizer.from_file(JSON)
    for long in (text, text.replace("o", "ö"), "\u65e5\u672c " * 3000, "x" * 5000):
        cut = pieces(long, 100)
        assert "".join(p for p, _ in cut) == long and all(n == len(p.encode()) for p, n in cut)
        assert count_lengths([long, None, long], JSON, 1000, 100).tolist() == [len(whole.encode(long, add_special_tokens=False)), 0] + [len(whole.encode(long, add_special_tokens=False))]
    assert len(pieces(text, 100)) > 50 and max(n for _, n in pieces(text, 100)) < 150


def test_batches_are_balanced_by_bytes(monkeypatch):
    from spindrift.llm import token_counts as module

    got = []

    class Library:
        def encode_batch_fast(self, parts, add_special_tokens):
            got.append(sum(len(p.encode()) for p in parts))
            return [[0] for _ in parts]

    monkeypatch.setattr(module, "tokenizer", lambda path: Library())
    module.count_lengths(["日本 " * 20, "a b " * 35] * 30, "", 1000, 500)
    assert len(got) > 5 and all(700 <= n <= 1000 for n in got[:-1])


SECRETS = [
    ("password = hunter2hunter2", {"assign": 1}),
    ("token: short", {}),
    ('api_key="ABCdef123456789xyz" AKIAABCDEFGHIJ1234', {"assign": 1, "access": 1}),
    ("AKIA12", {}),
    ("id 0123456789abcdef0", {"hex": 1}),
    ("ＰＡſſword = abcdefghijklmnop", {}),
    ("clean prose: nothing here, at all.", {}),
]


@pytest.mark.parametrize("text, want", SECRETS)
def test_base_patterns(text, want):
    base, _ = secret_scan.find_secrets(text)
    got: dict = {}
    for s in base:
        got[secret_scan.KINDS[s.kind]] = got.get(secret_scan.KINDS[s.kind], 0) + 1
    assert got == want


def test_lexer_adds_literals_and_propagates_constants():
    text = 'DEFAULT = "q7Rt9_zX2-LmN4pW"\nretries = 5\ndb_pwd = DEFAULT\nsigningKey: "aB3$kk9!zzQx1"\ntitle = "q7Rt9_zX2-LmN4pX"\n'
    _, spans = secret_scan.find_secrets(text)
    assert [text[s.start : s.end] for s in spans] == ["q7Rt9_zX2-LmN4pW", "aB3$kk9!zzQx1"]
    assert secret_scan.replaced(text, spans, "#").count("#") == 2


K = "Zk9$Qm2!vTx8#Lp4"
FORMS = [
    (f"DB_PASSWORD={K}\nNEXT=1", [K]),
    (f"db_password: {K} # a comment", [K]),
    (f"[db]\npassword = {K}", [K]),
    (f'api_key: str = "{K}"', [K]),
    (f'const password: string = "{K}";', [K]),
    (f'password: Optional[str]="{K}"', [K]),
    (f'os.environ["DB_PASSWORD"] = "{K}"', [K]),
    (f"config['db']['password'] = '{K}'", [K]),
    (f'passwords[0] = 1; password[0] = "{K}"', [K]),
    (f"const token = `{K}`;", [K]),
    (f'password = """{K}"""', [K]),
    (f"password = '''\n{K}\n'''", [K]),
    (f'password = b"{K}"', [K]),
    ('password = "Zk9$" + "Qm2!vTx8#Lp4"', ["Zk9$", "Qm2!vTx8#Lp4"]),
    ('password = ("Zk9$"\n  "Qm2!vTx8#Lp4")', ["Zk9$", "Qm2!vTx8#Lp4"]),
    ('password = "Zk9$" +\n  "Qm2!vTx8#Lp4"', ["Zk9$", "Qm2!vTx8#Lp4"]),
    (f'self.DEFAULT = "{K}"\npassword = self.DEFAULT', [K]),
    (f'DEFAULT = "{K}"\npassword = self.DEFAULT;', [K]),
    (f'DEFAULT = "{K}"\npassword = "a" + Config.DEFAULT', [K, "a"]),
    (f"u = http://h.example/?password={K}&x=1", [K]),
    (f'x = client(password="{K}", retries=3)', [K]),
    (f'{{"a":{{"password":"{K}"}}}}', [K]),
    (f"{{password: {K}, user: x}}", [K]),
    ('title = "Zk9$Qm2!vTx8#Lp4"', []),
]


@pytest.mark.parametrize("text, want", FORMS)
def test_lexer_forms(text, want):
    assert sorted(text[s.start : s.end] for s in secret_scan.assigned_spans(text)) == sorted(want)


def test_lexer_is_linear_on_runs():
    import time

    for unit in ("a=", "password=", "a[", 'a="', "a:b|", "a=`", "a,", "key='''", 'x+"a"', "a=b,", "a=(", "a=\"b\"+", "token=(a{"):
        start = time.perf_counter()
        secret_scan.assigned_spans(unit * (200_000 // len(unit)))
        assert time.perf_counter() - start < 5, unit


def test_short_match_is_consumed():
    assert secret_scan.base_spans("secret=token=abc") == secret_scan.base_spans("") and secret_scan.base_spans('token: "password: abcdefghijklmno') == []


def test_scan_table(odd, none):
    assert secret_scan.scan_secrets(odd).count() == odd.count() and secret_scan.scan_secrets(none).count() == 0
    kept = secret_scan.scan_secrets(odd, redact="#").collect()
    assert sorted(str(r.text) for r in kept) == sorted(str(r.text) for r in odd.collect())


def plain_measures(text):
    words = [w for w in re.split("[\x09-\x0d ]+", text or "") if w]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    twice = {g for g in grams if grams.count(g) > 1} if len(grams) < 2000 else {g for g in set(grams) if grams.count(g) > 1}
    covered = {p for i, g in enumerate(grams) if g in twice for p in (i, i + 1, i + 2)}
    lines = [x for x in (text or "").split("\n") if re.search("[^\x09-\x0d ]", x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_measures(odd, none):
    got = quality_rules(odd).select("text", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept").collect()
    assert len(got) == odd.count()
    for r in got:
        assert tuple(r[1:6]) == plain_measures(r.text), r.text and r.text[:40]
        assert r.base_failed == (r.n_words < 50 or 2 * r.n_repeat_words > r.n_words) and (not r.kept or not r.base_failed)
    assert quality_rules(none).count() == 0


def test_quality_lines(spark):
    good = "\n".join(" ".join(f"word{i}{j}" for j in range(18)) + "." for i in range(6))
    menu = "Home | News | Sport | About | Contact | More"
    rows = spark.createDataFrame([(0, good + "\n" + menu + "\nLicensed under CC BY 4.0."), (1, good.upper().replace(" ", "!! ") + "!!")], "doc_id int, text string")
    a, b = quality_rules(rows).orderBy("doc_id").collect()
    assert a.kept and a.cleaned == good and a.n_failed_lines == 2
    assert not b.kept and not b.base_failed and b.lost_words == b.n_words


def test_measures_are_computed_once(odd):
    plan = quality_rules(odd).where("kept").select("cleaned")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("[\\x09-\\x0D\\x20]+, -1") == 1
