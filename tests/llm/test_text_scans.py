"""Personal data, secrets, licenses, addresses: methods and edge cases."""

from __future__ import annotations

import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from test_corpus_queries import pii_spans, secret_spans

from reelflow.llm import licenses, pii, secrets, url_filter

ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "é" * 200_000), (5, "a@b.co " * 3), (5, "a@b.co " * 3), (None, "+1 (743) 555-3824")]


@settings(deadline=None)
@given(st.text(alphabet="ab1259@.-+ ()_é\n", max_size=80))
def test_personal_data_patterns_equal_the_plain_ones(text):
    raw = text.encode()
    assert pii.code_points(raw, pii.base_spans(raw)) == pii_spans(text)


@settings(deadline=None)
@given(st.lists(st.sampled_from(["password", "TOKEN", "api_key", "apikey", " ", "=", ":", '"', "AKIA", "ABCDEFGHIJKL0", "0123456789abcdef", "deadbeef", "é", "\n"]), max_size=12))
def test_secret_patterns_equal_the_plain_ones(parts):
    text = "".join(parts)
    raw = text.encode()
    assert pii.code_points(raw, secrets.base_spans(raw)) == secret_spans(text)


@pytest.mark.parametrize("text", ["a" * 300_000, "1" * 300_000, "1.2." * 100_000, "+1" * 100_000, "@" * 300_000, "password " * 50_000, "1 " * 200_000, "a=" * 1_000_000, "password=" * 50_000, "x@y.zz token=abcd1234 " * 20_000, "&key=v1" * 100_000])
def test_long_runs_take_linear_time(text):
    began = time.process_time()
    pii.base_spans(text.encode())
    secrets.all_spans(text.encode())
    assert time.process_time() - began < 20


def test_crf_on_held_out_sentences():
    table = pii.labelled_table(seed=123, n=400)
    got = pii.crf_spans(pii.default_model(), [t.encode() for t, _ in table])
    right = sum(len({*g} & {*s}) for g, (_, s) in zip(got, table, strict=True))
    assert right / sum(map(len, got)) > 0.9
    assert right / sum(len(s) for _, s in table) > 0.9


def test_pruned_decoding_equals_full_decoding():
    model = pii.default_model()
    texts = [t.encode() for t, _ in pii.labelled_table(seed=5, n=120)]
    raw = b" ".join([*texts, b""])
    data = np.frombuffer(raw, np.uint8)
    starts, ends = pii._tokens(data)
    edges = np.searchsorted(starts, np.cumsum([0, *(len(t) + 1 for t in texts)]))
    scores = model.scores(*pii._classes(raw, data, starts, ends), edges)
    fast = model.decode(scores, edges)
    slow = np.zeros_like(fast)
    model._viterbi(scores, edges[:-1], np.diff(edges), slow)
    assert (fast == slow).all() and fast.any()


def test_names_addresses_and_numbers():
    text = "My name is Anna Keller and I live at 12 Oak Street. SSN 123-45-6789."
    found = {text[a:b]: k for k, a, b in pii.crf_spans(pii.default_model(), [text.encode()])[0]}
    assert found == {"Anna Keller": "name", "12 Oak Street": "address", "123-45-6789": "id"}


def test_personal_data_edges(docs):
    rows = pii.find_personal_data(docs([(*r, "en", "s", 9) for r in ODD], ", spans long")).collect()
    assert sorted((r["doc_id"] or 0, r["n_email"], r["n_phone"]) for r in rows) == [(0, 0, 1), (1, 0, 0), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 3, 0), (5, 3, 0)]
    assert pii.find_personal_data(docs([])).count() == 0
    assert pii.redact("hé a@b.co!", "email:3:9") == "hé [email]!"


CODE = b"""const base = "Zk3#9vQpL2x8"
db_password = base
user_name = "hello world 123"
password: changeme
"client_secret": 'aB3dE5gH7jK9'
loop = loop
x == y
signing_key := part_a
part_a = part_b
part_b = "q9" + "Wm3xT7rB"
"""


def test_literals_of_sensitive_names():
    base, every = secrets.all_spans(CODE)
    found = [CODE[a:b] for k, a, b in every if k == "literal"]
    assert found == [b"Zk3#9vQpL2x8", b'q9" + "Wm3xT7rB']
    assert [CODE[a:b] for k, a, b in base] == [b"password: changeme", b"secret\": 'aB3dE5gH7jK9"]


@pytest.mark.parametrize(("name", "low", "high"), [("dbPassword", 0.9, 1), ("API_KEY", 0.9, 1), ("token_id", 0, 0), ("primary_key", 0.4, 0.6), ("color", 0, 0), ("aws.secretAccessKey", 0.9, 1)])
def test_name_scores(name, low, high):
    assert low <= secrets.name_score(name) <= high


LITERALS = {
    b'passphrase = "correct horse battery staple 9X"': b"correct horse battery staple 9X",
    b'db_pwd = "hunterhunter"': b"hunterhunter",
    b"pwd=19283746": b"19283746",
    b"auth: q7w3e9r1t5y2": b"q7w3e9r1t5y2",
    b'dsn = "q7w3e9r1t5y2"': b"q7w3e9r1t5y2",
    b"pin = '482913'": b"482913",
    b'key = "Zk3#9vQpL2x8"': b"Zk3#9vQpL2x8",
    b'auth_header = "Bearer Zk3#9vQpL2x8"': b"Bearer Zk3#9vQpL2x8",
    b'pwd = "changeme"': None,
    b'pwd = "short"': None,
    b'auth = "nothing much here"': None,
    b"my pwd: remember.": None,
    b'pin = "top-left"': None,
    b'primary_key = "customer_id"': None,
}


@pytest.mark.parametrize("text", LITERALS)
def test_every_listed_name_can_hold_a_secret(text):
    assert [text[a:b] for _, a, b in secrets.literal_spans(text)] == ([LITERALS[text]] if LITERALS[text] else [])


INSIDE = {
    'conn = "Server=db;Pwd=Zk3#9vQpL2x8"': ["Zk3#9vQpL2x8"],
    'conn = "Server=db;" + "Pwd=Zk3#9vQpL2x8"': ["Zk3#9vQpL2x8"],
    'conn = "Server=db;Pwd=Zk3" + "9vQpL2x8"': ['Zk3" + "9vQpL2x8'],
    """cfg = '{"user": "bob", "pwd": "Zk3#9vQpL2x8", "é": {"passphrase": "one two three"}}'""": ["Zk3#9vQpL2x8", "one two three"],
    r'cfg = "{\"user\": \"bob\", \"pwd\": \"Zk3#9vQpL2x8\"}"': ["Zk3#9vQpL2x8"],
    r'env = "HOST=a\nDB_PWD=Zk3#9vQpL2x8\nX=1"': ["Zk3#9vQpL2x8"],
    r'a = "{\"b\": \"{\\\"pwd\\\": \\\"Zk3#9vQpL2x8\\\"}\"}"': ["Zk3#9vQpL2x8"],
    'pwd = "Server=db;Pwd=Zk3#9vQpL2x8"': ["Server=db;Pwd=Zk3#9vQpL2x8"],
    'conn = "Server=db;Mode=Zk3#9vQpL2x8"': [],
}


@pytest.mark.parametrize("text", INSIDE)
def test_settings_inside_a_quoted_literal(text):
    raw = text.encode()
    assert [raw[a:b].decode() for _, a, b in secrets.literal_spans(raw)] == INSIDE[text]


@pytest.mark.parametrize("name", secrets.NAME_PARTS)
def test_no_name_is_listed_in_vain(name):
    assert secrets.score(name, "Zk3#9vQpL2x8", True) >= secrets.THRESHOLD


def plain_end(found, i):
    """The chain of one start, step by step over all assignments."""
    at, seen = i, {i}
    while at is not None and not found[at][2]:
        options = [j for j, p in enumerate(found) if p[0] == found[at][3] and j not in seen]
        earlier = [j for j in options if j < at]
        at = earlier[-1] if earlier else next(iter(options), None)
        seen.add(at)
    return at


@pytest.mark.parametrize("n", [1, 7, 8, 9, 40, 3000])
def test_a_name_with_many_assignments_stands_for_the_nearest_earlier_one(n):
    lines = ['v = "xxxxxxxx"'] * (n - 1) + ['v = "Zk3#9vQpL2x8"', "db_pwd = v", 'v = "Bq7!mT4wX9c1"']
    text = "\n".join(lines).encode()
    assert [text[a:b] for _, a, b in secrets.literal_spans(text)] == [b"Zk3#9vQpL2x8"]


@settings(deadline=None, max_examples=500)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.sampled_from(["a", "b", "c", "d", None, "a", "b", "c"])), max_size=40))
def test_chains_equal_the_plain_ones(parts):
    found = [(name, 0, [] if other else [(0, 1)], other) for name, other in parts]
    assert secrets.ends_of_chains(found, [*range(len(found))]) == {i: plain_end(found, i) for i in range(len(found))}


@pytest.mark.parametrize("text", ["password = v\nv = v\n" * 15_000, "token=token " * 30_000, "pwd = secret\nsecret = pwd\n" * 12_000, "pwd = a0\n" * 9_000 + "".join(f"a{i} = a{i + 1}\n" for i in range(9_000)), 'v = "Zk3#9vQpL2x8"\ndb_pwd = v\n' * 12_000])
def test_long_chains_take_little_time(text):
    began = time.monotonic()
    secrets.literal_spans(text.encode())
    assert time.monotonic() - began < 20


def test_secret_edges(docs):
    rows = secrets.find_secrets(docs(ODD)).collect()
    assert len(rows) == 7 and all(r["spans"] == "" for r in rows)
    assert secrets.find_secrets(docs([])).count() == 0


def brute_fuzzy(text, notice, k):
    """Whether some substring is within k edits of the notice (Sellers' algorithm)."""
    row = list(range(len(notice) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for j, d in enumerate(notice, 1):
            new.append(min(row[j - 1] + (c != d), row[j] + 1, new[j - 1] + 1))
        row = new
        best = min(best, row[-1])
    return best <= k


def test_fuzzy_notices_equal_brute_force():
    rng = np.random.default_rng(4)
    notices = tuple(("x", "", n) for *_, n in licenses.NOTICES[:5])
    for _ in range(60):
        notice = notices[int(rng.integers(5))][2]
        text = list("some words before " + notice + " and after it")
        for _ in range(int(rng.integers(0, 9))):
            at = int(rng.integers(15, len(text) - 10))
            text[at : at + int(rng.integers(0, 2))] = rng.choice(list("abcx ")) if rng.random() < 0.6 else ""
        text = "".join(text)
        found = {i for i, *_ in licenses.fuzzy_notices(text, notices)}
        assert found == {i for i, (*_, n) in enumerate(notices) if brute_fuzzy(text, n, licenses.edits_of(n))}


def plain_spans(text, notice, k, p=0):
    """Disjoint matches: the best of all, and those of what it leaves on both sides."""
    best = None
    for s in range(len(text)):
        row = list(range(len(notice) + 1))
        for e in range(s + 1, min(len(text), s + len(notice) + k) + 1):
            new = [e - s]
            for j, d in enumerate(notice, 1):
                new.append(min(row[j - 1] + (text[e - 1] != d), row[j] + 1, new[j - 1] + 1))
            row = new
            if row[-1] <= k and (best is None or (row[-1], e, -s) < best):
                best = (row[-1], e, -s)
    if best is None:
        return []
    d, e, s = best[0], best[1], -best[2]
    return [*plain_spans(text[:s], notice, k, p), (p + s, p + e, d), *plain_spans(text[e:], notice, k, p + e)]


def test_close_notices_are_all_found():
    text = "released undar the mit license released undar teh mit license released under the mit license"
    i = [n for *_, n in licenses.NOTICES].index("released under the mit license")
    assert [x for x in licenses.fuzzy_notices(text) if x[0] == i] == [(i, 0, 30, 1), (i, 31, 61, 3), (i, 62, 92, 0)]


@settings(deadline=None, max_examples=200)
@given(st.integers(0, 2**32), st.sampled_from(["abcabdabcabd", "aaaaaaaaaaaaaaaaaaaaaa", "the mit license", "gnu lesser gnu lesser gnu"]))
def test_spans_of_close_notices_equal_brute_force(seed, notice):
    rng = np.random.default_rng(seed)
    text = list((notice + " ") * 3)
    for _ in range(int(rng.integers(0, 14))):
        at = int(rng.integers(0, len(text)))
        text[at : at + int(rng.integers(0, 3))] = rng.choice(list("abx ")) if rng.random() < 0.6 else ""
    text = "".join(text)
    found = licenses.fuzzy_notices(text, (("x", "", notice),))
    assert [x[1:] for x in found] == plain_spans(text, notice, licenses.edits_of(notice))


LABELS = {
    "released under the bsd license": {"bsd"},
    "released under the gpl license": {"gpl"},
    "released under the mpl license": {"mpl"},
    "licensed under the foo license": set(),
    "licensed under cc by sa 4 0": {"cc-by-sa"},
    "licensed under cc by nd 4 0": {"cc-by-nd"},
    "licensed undr cc by nc 4 0": {"cc-by-nc"},
    "licensed under cc by nc sa 4 0": {"cc-by-nc-sa"},
    "gnu leser general public license": set(),
    "gnu lesser genral public license": {"lgpl"},
}


@pytest.mark.parametrize("text", LABELS)
def test_words_that_tell_licenses_apart_are_exact(text):
    found = {licenses.NOTICES[i][0] for i, *_ in licenses.fuzzy_notices(text)}
    assert found == LABELS[text]


def test_every_notice_finds_itself():
    assert len(licenses.NOTICES) >= 60
    for label, _, notice in licenses.NOTICES:
        assert label in {licenses.NOTICES[i][0] for i, *_ in licenses.fuzzy_notices("so " + notice + " it is")}, notice
    assert licenses.fuzzy_notices("released under the mit license", ()) == []


def test_license_edges(docs):
    rows = {r["doc_id"]: r for r in licenses.find_licenses(docs([(1, None), (2, ""), (3, "relased undr the MIT licence"), (4, "CC-BY cc by"), (5, "mit license " * 3)])).collect()}
    assert rows[1]["labels"] == rows[2]["labels"] == "" and rows[1]["first_word"] is None
    assert (rows[3]["base_labels"], rows[3]["labels"]) == ("", "mit") and 0.8 < rows[3]["score"] < 1
    assert (rows[4]["n_base"], rows[4]["last_word"], rows[4]["score"]) == (2, 2, 1.0)
    assert (rows[5]["n_base"], rows[5]["first_word"], rows[5]["last_word"]) == (3, 0, 4)
    assert licenses.find_licenses(docs([])).count() == 0


URLS = {
    "http://a.com/x": ("a.com", "/x", "com/", "allow"),
    "http://a.com": ("a.com", "", None, "allow"),
    "https://WWW.Example.com/en/?q": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://m.example.com/en/1": ("m.example.com", "/en/1", "example.com/en/", "block"),
    "https://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
    "http://x.net/es/#a": ("x.net", "/es/", "net/es/", "block"),
    "ftp://x.org/free-win": ("x.org", "/free-win", None, "allow"),
    "ftp://x.org/free-free-win/deal": ("x.org", "/free-free-win/deal", None, "block"),
    "ftp://casino-bet.org/": ("casino-bet.org", "/", None, "block"),
    "ftp://x.org/freewin": ("x.org", "/freewin", None, "allow"),
    "no address with porn": ("", "", None, "block"),
    "x://y?a://b": ("y", "", None, "allow"),
    None: ("", "", None, "allow"),
    "": ("", "", None, "allow"),
}


def test_addresses(spark):
    pages = spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    rows = url_filter.judge(pages).orderBy("page_id").collect()
    assert [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows] == list(URLS.values())
    assert url_filter.judge(pages.limit(0)).count() == 0
    assert url_filter.judge(pages, terms={}, rules=()).where("verdict = 'allow'").count() == len(URLS)
    own = url_filter.judge(pages, terms={"free": 5, "a": 1, "q": 6}).where("weight > 0").orderBy("page_id").collect()
    assert [(r["page_id"], r["strict_terms"], r["soft_terms"], r["weight"]) for r in own][:2] == [(0, [], ["a"], 1), (1, [], ["a"], 1)]
