"""Quality rules, mixing, decontamination, line dedup, near duplicates, fixity and the pipeline."""

from __future__ import annotations

import math
import random
import re

import pytest
from corpus_text import LOREM
from pyspark.sql import functions as F

from reelflow.llm import decontaminate, line_dedup, mixing, ngram_join, partenum, quality_rules, shingles, warc_fixity

WORDS = LOREM.split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(60)) for _ in range(n))


# --- quality rules -------------------------------------------------------------------------------


def test_counts(spark, docs):
    text = "a b c a b c d\nsame line\nsame line\n\n \nx#y"
    q = quality_rules.rate(docs([(1, text), (2, None), (3, ""), (4, "a a a a")])).orderBy("doc_id").select("quality_counts.*").collect()
    assert (q[0]["n_words"], q[0]["n_symbols"], q[0]["n_dup_lines"], q[0]["n_repeat_words"], q[0]["n_lines"]) == (12, 1, 1, 6, 4)
    assert all(q[i]["n_words"] == 0 and q[i]["base_failed"] for i in (1, 2))
    assert q[3]["n_repeat_words"] == 4 and q[3]["word_chars"] == 4


@pytest.mark.parametrize(("n", "k"), [(0, 0), (10, 0), (200, 1), (5000, 20), (5000, 4999), (100_000, 380)])
def test_binomial_tail(spark, n, k):
    p = 0.004
    got = spark.createDataFrame([(n, k)], "n long, k long").select(quality_rules.binomial_tail(F.col("n"), F.col("k"), p)).first()[0]
    log = lambda i: math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
    want = 1.0 if k > n * p else sum(math.exp(log(i)) for i in range(k + 1))
    assert got == pytest.approx(want, rel=1e-9)


def test_cutoffs_are_certified_per_stratum(spark, docs):
    good = [(i, prose(i, 60), "en") for i in range(400)]
    odd = [(1000 + i, " ".join(w + "##" for w in prose(i, 60).split()), "en") for i in range(5)]
    other = [(2000, odd[0][1], "xx"), (2001, odd[0][1], None), (2002, None, "en")]
    table = docs([*good, *odd, *other])
    labels = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in odd] + [(7, 0), (7, 1)], "doc_id long, quality int")
    rated = quality_rules.rate(table)
    cut = quality_rules.calibrate(rated, labels, alpha=0.2, delta=0.2)
    rows = {(r["stratum"], r["rule"]): r for r in cut.collect()}
    assert {s for s, _ in rows} == {"en"}
    assert rows["en", "symbols_per_word"]["cutoff"] == 0.1
    rows.pop(("en", "none"))
    assert all(r["p_value"] <= 0.2 / 10 and r["holdout"] == 400 for r in rows.values())
    kept = {r["doc_id"]: r["kept"] for r in quality_rules.decide(rated, cut).collect()}
    assert all(kept[i] for i, *_ in good) and not any(kept[i] for i, *_ in odd)
    assert kept[2000] and kept[2001] and not kept[2002]


def test_repeated_rows_and_copies_are_no_trials(spark, docs):
    good = [(i, prose(i, 60), "en") for i in range(60)]
    labels = spark.createDataFrame([(i, 1) for i in range(5000)], "doc_id long, quality int")
    copies = [(60 * k + i, t, lang) for k in range(40) for i, t, lang in good]
    for rows in (good, good * 40, copies):
        cut = quality_rules.calibrate(quality_rules.rate(docs(rows)), labels)
        assert {r["holdout"] for r in cut.collect()} <= {None} and quality_rules.holdout(quality_rules.rate(docs(rows)), labels).count() == 60


def test_columns_of_the_caller_are_kept(spark, docs):
    table = docs([(1, prose(1, 60), "en", "s", 7, 8)], ", kept int, quality_counts int")
    out = quality_rules.judge(table, spark.createDataFrame([], "doc_id long, quality int"))
    assert out.columns == [*table.columns, "_quality_counts", "_kept"]
    assert out.select("kept", "quality_counts", "_kept").first() == (7, 8, True)


def test_no_labels_reject_nothing_more(spark, docs):
    labels = spark.createDataFrame([], "doc_id long, quality int")
    out = quality_rules.judge(docs([(1, prose(1, 60)), (1, prose(1, 60)), (2, "short")]), labels)
    assert sorted((r["doc_id"], r["kept"]) for r in out.collect()) == [(1, True), (1, True), (2, False)]


# --- mixing --------------------------------------------------------------------------------------


def water(sizes):
    total, n = 1.5 * sum(sizes), len(sizes)
    w = [(5, 2, 1)[i % 3] for i in range(n)]
    capped: set = set()
    while True:
        rest = total - sum(2 * sizes[i] for i in capped)
        share = [2 * sizes[i] if i in capped else rest * w[i] / sum(w[j] for j in range(n) if j not in capped) for i in range(n)]
        more = {i for i in range(n) if i not in capped and share[i] > 2 * sizes[i] + 1e-9}
        if not more:
            return share
        capped |= more


def test_mixing(spark, docs):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 50)), "en", rng.choice(["a", "a", "a", "b", "ç", None])) for i in range(400)] + [(None, "x y", "en", "b"), (5, None, "en", "a"), (7, "p q", "en", "b"), (7, "p q", "en", "b")]
    table = docs(rows, "")
    out = mixing.mix(table.withColumn("mix", F.lit("own")).withColumn("target", F.lit(1)))
    got = out.select("doc_id", "source", "mix", "mixed.*").collect()
    assert len(got) == len(rows) and {r["mix"] for r in got} == {"own"}
    by: dict = {}
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        x = by.setdefault(r["source"], [0, 0, r["target"], r["source_size"]])
        x[0] += r["size"]
        x[1] += r["taken"]
    order = sorted(by, key=lambda s: (s is None, s))
    for s, want in zip(order, water([by[s][0] for s in order]), strict=True):
        assert by[s][2] == pytest.approx(want) and by[s][3] == by[s][0] and abs(by[s][1] - want) <= 2
    again = mixing.mix(table.repartition(7), keep_text=False).select("doc_id", "mixed.*")
    key = lambda r: (r["doc_id"] or -1, r["size"], r["taken"])
    assert sorted(map(key, again.collect())) == sorted(map(key, got))
    assert mixing.mix(docs([])).count() == 0
    assert mixing.mix(docs([(1, None), (2, "")])).where("mixed.taken = 0").count() == 2


# --- decontamination -----------------------------------------------------------------------------


def test_decontamination(spark, docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
    bench = spark.createDataFrame([("b1", item), ("b2", "Short Item!"), (None, "null id item"), ("b3", None), ("b4", "")], "item_id string, text string")
    rows = [(1, f"before {item.upper()} after"), (2, "a short item here"), (3, "the null id item"), (4, None), (5, ""), (6, "alpha beta gamma"), (7, prose(1, 200) + " " + item), (7, prose(1, 200) + " " + item), (8, prose(2, 5000) + " short item")]
    table = docs(rows)
    for block in (1 << 20, 40):
        got = {}
        for r in decontaminate.mark(table, bench, block_bytes=block).collect():
            got[r["doc_id"]] = (r["leak"]["n_words"], [(s["start"], s["stop"]) for s in r["leak"]["spans"]], r["leak"]["items"])
        assert got[1] == (17, [(1, 16)], ["b1"])
        assert got[2] == (4, [(1, 3)], ["b2"])
        assert got[3] == (4, [(1, 4)], [])
        assert got[4] == got[5] == (0, [], []) and got[6] == (3, [], [])
        assert got[7] == (215, [(200, 215)], ["b1"])
    for block in (1 << 20, 40):
        kept = {r["doc_id"]: r for r in decontaminate.clean(table, bench, block_bytes=block, flag="cut").collect()}
        assert sorted(kept) == [4, 5, 6, 8]
        assert kept[8]["text"] == prose(2, 5000) + " " and [kept[d]["cut"] for d in (4, 5, 6, 8)] == [False, False, False, True]
        cut = {r["doc_id"]: r["text"] for r in decontaminate.clean(table, bench, spans_only=True, block_bytes=block).collect()}
        assert cut[1] == "before  after" and cut[6] == "alpha beta gamma" and cut[4] is None
    assert decontaminate.mark(docs([]), bench).count() == 0
    assert decontaminate.clean(table, bench.limit(0)).count() == len(rows)


def test_no_window_is_left_where_words_come_together(docs, spark):
    long = prose(9, 13).split()
    bench = spark.createDataFrame([("a", "short item"), ("b", "x y z"), ("c", " ".join(long))], "item_id string, text string")
    nested = "short short item item x short item y z and " + " ".join([*long[:5], "x", "y", "z", *long[5:]])
    table = docs([(1, nested + " " + prose(3, 900)), (2, " ".join(long) + " " + prose(4, 900)), (3, prose(5, 30))], "")
    table = table.withColumn("leak", F.lit(1))
    for block in (1 << 20, 20):
        out = decontaminate.clean(table, bench, block_bytes=block)
        assert out.columns == table.columns
        left = {r["doc_id"]: r["text"] for r in out.collect()}
        assert sorted(left) == [1, 3] and left[1].split() == ["and", *prose(3, 900).split()] and left[3] == prose(5, 30)
        assert decontaminate.mark(out, bench).where(F.size("_leak.spans") > 0).count() == 0


# --- line dedup ----------------------------------------------------------------------------------


def test_line_dedup(docs):
    shared, short = "A line of forty characters, or a few more", "short line"
    table = [(i, f"  {shared.upper() if i % 2 else shared}\t\n{short}\nown {i}") for i in range(5)] + [(9, f"{shared}\n{shared}"), (9, shared), (None, shared), (20, None), (21, ""), (22, "é" * 39)]
    for few in (line_dedup.FEW_KEYS, 0):
        out = line_dedup.drop_shared_lines(docs([(*r, "en", "s", 1) for r in table], ", lost_lines int"), few=few).collect()
        got: dict = {}
        for r in out:
            got.setdefault(r["doc_id"], []).append((r["text"], r["line_counts"]["n_dropped"]))
        assert got[0] == [("short line\nown 0", 1)]
        assert sorted(got[9]) == [(shared, 0), (f"{shared}\n{shared}", 0)] and got[None] == [(shared, 0)]
        assert got[20] == [(None, 0)] and got[21] == [("", 0)]
    assert line_dedup.drop_shared_lines(docs([])).count() == 0


# --- near duplicates -----------------------------------------------------------------------------


def sets_of(texts):
    out = []
    for t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute_components(rows):
    sets = sets_of([t for _, t in rows])
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    best: dict = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            best[find(i)] = min(best.get(find(i), d), d)
    return sorted(((d, len(s), best.get(find(i))) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def edited(text, k, seed):
    rng, w = random.Random(seed), text.split(" ")
    for _ in range(k):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def test_near_duplicates_equal_brute_force(docs):
    rows = [(i, prose(i, n)) for i, n in enumerate((5, 6, 9, 30, 60, 200, 700))]
    nid = 100
    for base, text in rows[2:7]:
        for k in (1, 1, 2, 3, 5, 8, 12):
            rows.append((nid, edited(text, k, nid)))
            nid += 1
    passage = prose(77, 60)
    rows += [(nid + i, prose(1000 + i, 10 + 3 * i) + " " + passage) for i in range(25)]
    big = prose(5, 120)
    rows += [(500 + i, edited(big, 1 + i % 4 * 5, 500 + i)) for i in range(90)]
    rows += [(600, big), (600, big), (601, None), (602, ""), (603, " \n"), (604, "One two"), (605, "one TWO"), (606, "two one"), (None, big), (None, "alone " + prose(9, 40))]
    got = ngram_join.near_duplicates(docs([(*r, "en", "s", 3) for r in rows], ", cid int")).select("doc_id", "n_shingles", "component_id").collect()
    assert sorted(map(tuple, got), key=repr) == brute_components(rows)
    assert ngram_join.near_duplicates(docs([])).count() == 0


def test_whole_table_equals_brute_force(spark, sf, real):
    from reelflow.llm.queries import op9_ngram_join

    rows = [(r["doc_id"], r["text"]) for r in real.collect()]
    got = op9_ngram_join(spark, sf).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute_components(rows)


def test_similar_sets_share_a_signature():
    import numpy as np

    rng = np.random.default_rng(8)
    for n in (1, 2, 3, 4, 7, 8, 15, 16, 33, 120, 500, 1023, 1024, 3000):
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            top = len(a) // 3
            drop = int(rng.integers(0, max(1, len(a) // 4 + 1)))
            b = np.concatenate((a[drop:], rng.integers(0, 2**64, int(rng.integers(0, top + 1)), np.uint64)))
            b = np.unique(b)
            both = len(np.intersect1d(a, b))
            if 7 * both < 3 * (len(a) + len(b)) or not len(b):
                continue
            h, sizes = np.concatenate((a, b)), np.array([len(a), len(b)])
            sig, own = partenum.signatures(h, sizes)
            shared = {*sig[own == 0].tolist()} & {*sig[own == 1].tolist()}
            tags = [int(x) & partenum.TAG for x in shared]
            assert any(tags.count(t) > partenum.slacks()[t >> 2] for t in tags)
            bits = [partenum.parity(s, len(s)) for s in (a, b)]
            x, y = partenum.fold_parities(bits, min(map(len, bits)) // 8)
            assert np.bitwise_count(x ^ y).sum() <= len(a) + len(b) - 2 * both
            assert partenum.may_match(partenum.sketch(a, len(a)), partenum.sketch(b, len(b)), len(a), len(b))


def test_classes_whose_hashes_collide_are_told_apart():
    h, sizes = shingles.shingle_sets([b"a b c d e f", b"", b"g h i", b"g h i"])
    cids, second = ngram_join._told_apart(h, sizes, {})
    assert cids[1] == 0 and cids[2] == cids[3] != cids[0] and second[2] == second[3] != cids[2]
    again, _ = ngram_join._told_apart(h, sizes, {int(cids[2]): int(second[0]), int(cids[0]): int(second[0])})
    assert again.tolist() == [cids[0], 0, second[2], second[2]]


def test_one_row_of_each_group_stays(docs):
    rows = []
    for g in range(3):
        text = prose(40 + g, 60)
        rows += [(g, text), (g, edited(text, 1, g)), (None, prose(80 + g, 60)), (None, edited(prose(80 + g, 60), 1, g)), (20 + g, text), (g, text)]
    rows += [(9, None), (9, None), (9, ""), (30, "same words here"), (30, "same words here")]
    table = docs([(*r, "en", "s", 7, k % 5) for k, r in enumerate(rows)], ", gone boolean, of_id int".replace("gone boolean", "gone int"))
    out = ngram_join.keep_one(table)
    assert out.columns == table.columns
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in out.collect())
    assert kept == sorted([(False, g) for g in range(3)] + [(True, 0)] * 3 + [(False, 9)] * 3 + [(False, 30)])


def test_shingle_hashes_follow_words():
    h, n = shingles.shingle_sets([b"A b c d e f", b"a B\tc\nd  e f ", b"", b"a b", b"b a", b"a", b"x y z v w x y z v w"])
    ends = n.cumsum()
    sets = [h[e - k : e].tolist() for e, k in zip(ends, n, strict=True)]
    assert n.tolist() == [2, 2, 0, 1, 1, 1, 5] and sets[0] == sets[1]
    assert len({x for s in sets[3:6] for x in s}) == 3


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(30)]
    parent = {x: x for e in edges for x in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert {r["node"]: r["root"] for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()} == want


def test_few_links_need_few_jobs(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(90, 80), (80, -7)], "a long, b long")
    want = {i: 0 for i in range(65)} | {90: -7, 80: -7, -7: -7}
    spark.sparkContext.setJobGroup("few-links", "components")
    got = {r["node"]: r["root"] for r in ngram_join.components(edges).collect()}
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few-links"))
    spark.sparkContext._jsc.sc().clearJobGroup()
    assert got == want and jobs <= 12
    assert {r["node"]: r["root"] for r in ngram_join.components(edges, few=0).collect()} == want
    assert ngram_join.components(edges.limit(0)).count() == 0


def test_sides_of_pairs_are_the_same_however_they_are_joined(spark, monkeypatch):
    rows = spark.createDataFrame([(i, bytes([i] * i), i) for i in range(9)], "cid long, set binary, n long")
    pairs = spark.createDataFrame([(1, 2), (1, 8), (3, 4), (0, 7)], "a long, b long")
    want = sorted((a, b, bytes([a] * a), a, bytes([b] * b), b) for a, b in ((1, 2), (1, 8), (3, 4), (0, 7)))
    for most in (1 << 20, 0):
        monkeypatch.setattr(ngram_join, "FEW_BYTES", most)
        both = ngram_join._ends(pairs, rows, "set").select("a", "b", "set_a", "n_a", "set_b", "n_b")
        assert sorted((r[0], r[1], bytes(r[2]), r[3], bytes(r[4]), r[5]) for r in both.collect()) == want


# --- fixity --------------------------------------------------------------------------------------


def test_fixity(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "y" * (i * 37 % 9000)) for i in range(300)] + [(None, None, None), (5000, "u", ""), (5000, "u", "")], "page_id long, url string, html string")
    own = warc_fixity.leaves(pages)
    assert warc_fixity.audit(own, own).count() == 0
    hurt = own.withColumn("sha256", F.when(F.col("page_id").isin(7, 222), "bad").otherwise(F.col("sha256"))).where("page_id is null or page_id <> 100")
    hurt = hurt.unionByName(own.where("page_id = 299").withColumn("offset", F.col("offset") + 10**6))
    place = {r["page_id"]: r["offset"] for r in own.where("page_id < 5000").collect()}
    got = sorted((r["offset"], r["status"]) for r in warc_fixity.audit(own, hurt).collect())
    assert got == sorted([(place[7], "corrupt"), (place[222], "corrupt"), (place[100], "missing"), (place[299] + 10**6, "extra")])
    full = {r["page_id"]: r["status"] for r in warc_fixity.audited(own, hurt).collect()}
    assert len(full) == 302 and full[7] == "corrupt" and full[100] == "missing" and full[8] == "ok" and full[None] == "ok"
    assert warc_fixity.audit(own.limit(0), own.limit(0)).count() == 0
    volume = own.where("volume = 0").orderBy("offset").collect()
    raws = pages.where("page_id < 4096").orderBy("page_id").select(warc_fixity.record_bytes(F.col("page_id"), F.col("url"), F.col("html")).alias("r")).collect()
    (tmp_path / "volume-0.warc").write_bytes(b"".join(bytes(r["r"]) for r in raws))
    read = warc_fixity.read_leaves(spark, str(tmp_path)).orderBy("offset").collect()
    assert [(r["offset"], r["length"], r["sha256"]) for r in read] == [(r["offset"], r["length"], r["sha256"]) for r in volume]
    broken = b"WARC/1.1\r\nContent-Length: 99\r\n\r\nabc"
    assert list(warc_fixity.split_records(broken)) == [(0, broken)]


# --- pipeline ------------------------------------------------------------------------------------


def test_pipeline_equals_brute_force(spark, sf, real):
    import corpus_pipeline
    from reelflow.llm import queries

    docs = {r["doc_id"]: r["text"] for r in real.collect()}
    kept = {r["doc_id"] for r in queries.op1_quality_rules(spark, sf).where("kept").collect()}
    texts = {d: t for d, t in docs.items() if d in kept}
    blank, lower = " \t\n\x0b\x0c\r", str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(lower)
    held: dict = {}
    for d, t in texts.items():
        for x in {key(x) for x in t.split("\n")}:
            held.setdefault(x, set()).add(d)
    gone = lambda x, d: len(key(x)) >= 40 and len(held[key(x)]) >= 5 and d < max(held[key(x)])
    texts = {d: "\n".join(x for x in t.split("\n") if not gone(x, d)) for d, t in texts.items()}
    texts = {d: texts[d] for d, n, c in brute_components(sorted(texts.items())) if n == 0 or d == c}
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    windows = set()
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = word.findall(r["text"].translate(lower))
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    clean = {}
    for d, t in texts.items():
        w = word.findall(t.translate(lower))
        hit = {i + j for n in {len(x) for x in windows} for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for j in range(n)}
        if not hit:  # the items of this table all have 13 words and more
            clean[d] = t
    assert min(map(len, windows)) == 13
    out = corpus_pipeline.run(spark, sf).collect()
    assert {r["doc_id"]: r["text"] for r in out} == clean
    assert all(r["n_chars"] == len(r["text"]) for r in out)
    assert all(r["size"] == len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) and r["taken"] <= 2 * r["size"] for r in out)


def test_stages_keep_columns_and_odd_rows(spark, docs, sf):
    import corpus_pipeline

    extra = ("kept", "quality_counts", "line_counts", "lost_lines", "leak", "was_cut", "mix", "mixed", "size", "target", "is_gone", "of_id")
    rows = [(1, prose(1, 80), "en", "a"), (1, prose(1, 80), "en", "a"), (2, None, None, None), (3, "", "en", "a"), (4, prose(4, 60_000), "en", "a")]
    table = docs([(*r, *range(len(extra))) for r in rows], "".join(f", {c} int" for c in extra))
    left = {"quality rules": [1, 1, 4], "line dedup": [1, 1, 2, 3, 4], "near duplicates": [1, 2, 3, 4], "decontamination": [1, 1, 2, 3, 4], "mixing": [1, 1, 2, 3, 4]}
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, table, sf)
        assert out.columns[: len(table.columns)] == table.columns and (name == "mixing" or out.columns == table.columns)
        got = out.collect()
        assert sorted(r["doc_id"] for r in got) == left[name]
        assert all(r["text"] in {x[1] for x in rows} and r["size"] == extra.index("size") for r in got)
        assert f(spark, table.limit(0), sf).count() == 0
