from __future__ import annotations

import hashlib
import re

import oracle_check
import pytest

from reelflow.llm import oracle, queries


@pytest.fixture(scope="module")
def con(sf):
    return oracle_check.connect(sf)


@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_query_equals_sql(spark, sf, con, name):
    oracle_check.compare(queries.QUERIES[name](spark, sf), oracle.SQL[name], con)


def spans_digest(spans):
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()


def luhn(d):
    total = 0
    for i, c in enumerate(reversed(d)):
        x = int(c) * (2 if i % 2 else 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def pii_spans(text):
    found = {"email": [], "ip": [], "card": [], "phone": []}
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        found["email"].append(m.span())
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m.group().split(".")):
            found["ip"].append(m.span())
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m.group())
        if 16 <= len(d) <= 19 and luhn(d):
            found["card"].append(m.span())
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 8 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
            found["phone"].append(m.span())
    return [(k, *s) for k, v in found.items() for s in v]


def test_personal_data_base(spark, sf, real):
    got = {r["doc_id"]: r for r in queries.op2_personal_data(spark, sf).collect()}
    for d in real.collect():
        want, r = pii_spans(d["text"] or ""), got[d["doc_id"]]
        assert r["base_sha256"] == spans_digest(want)
        assert r["spans"].startswith(",".join(f"{k}:{a}:{b}" for k, a, b in want))
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(s[0] == k for s in want) for k in ("email", "ip", "card", "phone")]


def secret_spans(text):
    kinds = ["assign", "access", "hex"]
    out = [("assign", *m.span()) for m in re.finditer(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", text) if len(m.group(2)) >= 8]
    out += [("access", *m.span()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 16]
    out += [("hex", *m.span()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 32]
    return sorted(out, key=lambda s: (s[1], kinds.index(s[0])))


def test_secrets_base(spark, sf, real):
    got = {r["doc_id"]: r for r in queries.op3_secrets(spark, sf).collect()}
    for d in real.collect():
        want, r = secret_spans(d["text"] or ""), got[d["doc_id"]]
        assert r["base_sha256"] == spans_digest(want)
        assert [r[f"n_{k}"] for k in ("assign", "access", "hex")] == [sum(s[0] == k for s in want) for k in ("assign", "access", "hex")]
        assert {f"{k}:{a}:{b}" for k, a, b in want} <= set(r["spans"].split(","))


def test_licenses_base(spark, sf, real):
    phrases = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
    got = {r["doc_id"]: r for r in queries.op6_licenses(spark, sf).collect()}
    for d in real.collect():
        low = re.sub("[A-Z]", lambda m: m.group().lower(), d["text"] or "")
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for p, label in phrases.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
        r = got[d["doc_id"]]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min((i for i, _ in places), default=None), max((i for i, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert 0 <= r["score"] <= 1
