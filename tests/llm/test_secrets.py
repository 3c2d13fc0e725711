"""The lexer on a labelled corpus of source and configuration syntax, and the base against plain regexes."""

import hashlib
import os
import re
import time

import duckdb
import pytest

from spindrift.llm import secret_scan as s
from spindrift.llm.queries import op1_secret_scan

DATA = "/root/testdata/sf0.001"
K, K2 = "Zk9$Qm2!vTx8#Lp4", "w7Xr/Lq2=Bn5+Tz0Pd"
#: text, the secrets in it
CORPUS = [
    (f"DB_PASSWORD={K}\nNEXT=1", [K]),
    (f"export API_TOKEN='{K}'", [K]),
    (f"password = {K}  # note", [K]),
    (f"[db]\npassword: {K}\nuser: me", [K]),
    (f'"db": {{"password": "{K}"}}', [K]),
    (f'{{"password": {{"value": "{K}"}}}}', [K]),
    (f'- name: DB_PASSWORD\n  value: "{K}"\n- name: USER\n  value: "{K2}"', [K]),
    (f'<add key="DbPassword" value="{K}"/>', [K]),
    (f"<config><password>{K}</password><title>{K2}</title></config>", [K]),
    (f"<db:secret type='x'> {K} </db:secret>", [K]),
    (f"password:\n  {K}\nuser: x", [K]),
    (f"client_secret: >-\n  {K}\n", [K]),
    (f'secret:\n"{K}"', [K]),
    ('password = "Zk9\\"$Qm2!vTx8"', ['Zk9\\"$Qm2!vTx8']),
    ("password = 'it\\'s9$Qm2!vTx8'", ["it\\'s9$Qm2!vTx8"]),
    (f'{{\\"auth_token\\": \\"{K}\\"}}', [K]),
    ('password = "Zk9$" + "Qm2!vTx8#Lp4"', ["Zk9$", "Qm2!vTx8#Lp4"]),
    (f'k = "{K}"\nclient.password(k)', [K]),
    (f'client.set_password("{K}")', [K]),
    (f'os.putenv("DB_PASSWORD", "{K}")', [K]),
    (f'KEY = "{K}"\nconfig.put("auth-token", KEY)', [K]),
    (f'connect(host="h", password="{K}", port=3)', [K]),
    (f"K = '''{K}'''\ndb_password = K\n", [K]),
    (f'A = "{K}"\nB = A\nC = B\nsigning_key = C', [K]),
    (f'$password = "{K}";', [K]),
    (f"$config['password'] = '{K}';", [K]),
    (f'let apiKey: String = "{K}"', [K]),
    (f"dbpassword := `{K}`", [K]),
    (f":secret => '{K}'", [K]),
    ("AUTH_KEY=Zk9Qm2vTx8Lp4abc", ["Zk9Qm2vTx8Lp4abc"]),
    ("auth_token: 550e8400-E29b-41d4-a716-44Zx", ["550e8400-E29b-41d4-a716-44Zx"]),
    (f"mysql://u:p@h/?password={K}&x=1", [K]),
    ("signature = compute_signature_of_body(x)", []),
    ("password = get_password_from_user()", []),
    ("token = token2", []),
    ("password = user_password", []),
    ("auth_key = settings.AUTH_KEY_2024", []),
    ("private_key = rsaKeyPair2048", []),
    (f'title = "{K}"', []),
    (f'if password == "{K}": pass', []),
    ('password = "changeme"', []),
    ('password = "${DB_PASSWORD}"', []),
    ("password = <your-password>", []),
    ('password = ""', []),
    ("password: str\ntoken: Optional[int] = None", []),
    ("The password: it must be long, and the secret: none of your business.", []),
    ('label = "enter the password here please"', []),
    ('password_hint = "the name of my first dog"', []),
    (f"digest: {K}", []),
    (f'name = "{K2}"', []),
    ("tokens:\n  - one\n  - two", []),
    (f"secret:\n  title: {K}", []),
    (f'log("password")\nprint("{K}")', []),
]


def found(text):
    return sorted(text[x.start : x.end] for x in s.assigned_spans(text))


def rates():
    right = wrong = missed = 0
    for text, want in CORPUS:
        got = found(text)
        right += sum(x in want for x in got)
        wrong += sum(x not in want for x in got)
        missed += sum(x not in got for x in want)
    return right / (right + wrong), right / (right + missed)


@pytest.mark.parametrize("text, want", CORPUS)
def test_forms(text, want):
    assert found(text) == sorted(want)


def test_rates():
    precision, recall = rates()
    assert precision >= 0.95 and recall >= 0.95


def test_only_what_no_base_span_covers_is_added():
    at = lambda a, b, k=0: s.Span(a, k, b)
    base = [at(0, 5), at(3, 30), at(10, 12), at(40, 50)]
    more = [at(1, 4), at(4, 30), at(5, 31), at(12, 29), at(31, 33), at(39, 45), at(41, 50), at(45, 51)]
    assert s.uncovered(more, base) == [x for x in more if not any(b.start <= x.start and x.end <= b.end for b in base)]
    assert s.uncovered(more, []) == more and s.uncovered([], base) == []


def test_a_megabyte_of_assignments_takes_a_second():
    for unit in ('password = "Zk9$Qm2!vTx8%d"\n', "token=token+\"Zk9$Qm2!v%d\"\n", "secret_%d: 'x'\n", "<password>%d</password>", 'set("token", k%d) ', "name: password%d\nvalue:\n  x\n"):
        text = "".join(unit % i for i in range(1_000_000 // len(unit)))
        start = time.perf_counter()
        s.find_secrets(text)
        assert time.perf_counter() - start < 4, unit


def test_long_chains_are_scored_and_given_once():
    text = 'k = "Zk9$Qm2!"\n' + "".join(f'k = k + "vTx8{i}"\n' for i in range(3000)) + "password = k\ntoken = k\n"
    assert len(s.assigned_spans(text)) == 3001


PLAIN = [(re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 12), (re.compile("AKIA[A-Z0-9]+"), 0, 18), (re.compile("[0-9a-f]+"), 0, 16)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_query_equals_plain_regexes(spark):
    texts = dict(duckdb.sql(f"SELECT doc_id, text FROM '{DATA}/documents.parquet'").fetchall())
    rows = op1_secret_scan(spark, DATA).collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    for r in rows:
        hits = sorted((m.start(), k, m.end()) for k, (p, g, n) in enumerate(PLAIN) for m in p.finditer(texts[r.doc_id] or "") if len(m[g]) >= n)
        names = ["assign", "access", "hex"]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == i for _, k, _ in hits) for i in range(3)]
        joined = ",".join(f"{names[k]}:{a}:{b}" for a, k, b in hits)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(filter(None, r.spans.split(",")))
