"""Near duplicates by Jaccard similarity of word shingles, found through PartEnum signatures.

1. Each text becomes its set of shingle hashes; texts with equal sets form a class, and from
   here on a class stands for its copies.
2. Each class emits the signatures of ``partenum``: similar classes share several. Signatures are
   shuffled and sorted; a bucket of up to ``BUCKET`` classes yields its pairs.
3. A larger bucket is hot: a passage or line that many texts share, or a large group of near
   copies. A class with no more hot signatures than two similar classes surely share has met all its
   partners in small buckets. The others emit their elements of half the hash domain: a bucket of up
   to ``FINE_BUCKET`` yields its pairs, others are hot again. A class with more than a quarter of its
   elements emitted and not hot has met all its partners. The others emit all their elements.
4. The few classes that even so are nearly all hot are compared within their hot buckets of step 2: first
   each with the class with which it shares most, in ``ROUNDS`` orders; then each with the
   nearest of another component in its bucket; then, where there were more, all between the components so far,
   by parity bits, in blocks of ``BLOCK`` rows that are spread over tasks. No pair is left out.
5. Pairs that pass sketches or parities (lower bounds of the difference) are verified on the sets.
6. Components come from alternating large and small stars over the verified links, or from the driver if they are few.

Nothing of the size of the corpus reaches the driver. A set is held by 64-bit hashes, a class is told
apart by 128 bits: where sets of one 64-bit class differ in a second hash, all but one take that as their class.

Nulls: a null text, or one without words, has no shingles and no links: its component is its own id.
A null id takes part, but never names a component unless there is no other.
Repeated rows are copies; rows that repeat an id with other texts are texts of their own. An empty table
gives an empty result. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.llm import partenum
from reelflow.llm.common import discard, fresh, hand_on, lean, scratch, small, stage, text_slices
from reelflow.llm.shingles import mix, shingle_sets

#: Classes of a bucket up to which all its pairs are looked at: few at first, as what many texts share is
#: told apart better by the finer partition.
BUCKET, FINE_BUCKET = 4, 16
#: Half the hash domain.
HALF = np.uint64(1 << 63)
#: Rounds in which each class of hot buckets is compared with one other, before all are compared.
ROUNDS = 2
#: Rows that a task holds of each side when it compares within a hot bucket.
BLOCK = 2048
#: Ids that are broadcast at most (16 bytes each); beyond it, the join is left to Spark.
FEW_IDS = 1 << 20
#: Links up to which the driver finds the components (16 bytes each); beyond it, stars do.
FEW_LINKS = 1 << 18
#: Bytes of sketches or sets that are broadcast at most; beyond it, the join is left to Spark.
FEW_BYTES = 16 << 20
#: Parities that are broadcast at most; one has 16 KB at most and four to eight bits an element.
FEW_PARITIES = 1 << 11
#: Classes that a task remembers, not to emit a copy's signatures again.
SEEN = 1 << 17


def _class_ids(h: np.ndarray, sizes: np.ndarray, salt: int = 3) -> np.ndarray:
    """64-bit hash of each set; 0 for an empty one."""
    out = np.zeros(len(sizes), np.uint64)
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = mix(np.add.reduceat(mix(h * np.uint64(salt)), starts) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


#: Classes whose sets differ, and the second hash of the set that stays in each.
Clashes = dict[int, int]


def _told_apart(h: np.ndarray, sizes: np.ndarray, clashes: Clashes) -> tuple[np.ndarray, np.ndarray]:
    """(class, second hash) of each set."""
    cids, second = _class_ids(h, sizes), _class_ids(h, sizes, salt=5)
    for i in np.flatnonzero(np.isin(cids, list(clashes))) if clashes else ():
        if second[i] != clashes[int(cids[i])]:
            cids[i] = second[i]
    return cids, second


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    for rows, texts in text_slices(batches, most=1 << 20):
        yield rows, *shingle_sets(texts)


def _batch(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns.values()], names=list(columns))


def describe(docs: DataFrame, clashes: Clashes) -> DataFrame:
    """(doc_id, th, n, low, cid, second, sketch) per row: hash of the text, size, elements in the lower half, class and sketch of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, sizes in _sets(batches):
            cids, second = _told_apart(h, sizes, clashes)
            ends = np.cumsum(sizes)
            sketches = [partenum.sketch(h[e - n : e], int(n)) if n else None for e, n in zip(ends, sizes, strict=True)]
            low = np.diff(np.concatenate(([0], np.cumsum(h < HALF)))[np.concatenate(([0], ends))])
            yield _batch(doc_id=rows.column(0), th=rows.column(1), n=sizes, low=low, cid=pa.array(cids, mask=sizes == 0), second=second, sketch=pa.array(sketches, pa.binary()))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(lean(run), "doc_id long, th long, n long, low long, cid long, second long, sketch binary")


def coarse_rows(docs: DataFrame, clashes: Clashes) -> DataFrame:
    """(sig, cid): signatures of every text, once per class and task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, h, sizes in _sets(batches):
            cids, _ = _told_apart(h, sizes, clashes)
            new = np.zeros(len(sizes), bool)
            for i, c in enumerate(cids.tolist()):
                if sizes[i] and c not in seen:
                    new[i] = True
                    if len(seen) < SEEN:
                        seen.add(c)
            who = np.flatnonzero(new)
            sig, own = partenum.signatures(partenum.select(h, sizes, who), sizes[who])
            yield _batch(sig=sig.view(np.int64), cid=cids[who][own])

    return docs.select("text").where("text is not null").mapInArrow(lean(run), "sig long, cid long")


def unresolved(hot: DataFrame) -> DataFrame:
    """(cid) of the classes that may have partners in large buckets (sig, cid) alone."""
    slack = F.element_at(F.array(*[F.lit(x) for x in partenum.slacks()]), F.shiftright("tag", 2) + 1)
    counts = hot.groupBy("cid", F.col("sig").bitwiseAND(partenum.TAG).cast("int").alias("tag")).agg(F.count("*").alias("hot"))
    return counts.where(F.col("hot") > slack).select("cid").distinct()


def fine_rows(texts: DataFrame, half: bool) -> DataFrame:
    """(sig, cid) of (cid, text): the set's elements, those of the lower half of the domain alone if ``half``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, sizes in _sets(batches):
            own = np.repeat(rows.column(0).to_numpy(), sizes)
            low = h < HALF if half else np.ones(len(h), bool)
            yield _batch(sig=h[low].view(np.int64), cid=own[low])

    return texts.select("cid", "text").mapInArrow(lean(run), "sig long, cid long")


def poor_classes(classes: DataFrame, members: DataFrame, fine: DataFrame, emitted: str) -> DataFrame:
    """(cid) of ``members`` with no more than a quarter of their elements emitted and not hot in ``fine``."""
    hot = fine.where("b is null").groupBy(F.col("a").alias("cid")).agg(F.count("*").alias("hot"))
    rows = classes.join(members, "cid", "left_semi").join(hot, "cid", "left")
    return rows.where(F.col(emitted) - F.coalesce("hot", F.lit(0)) <= F.floor(F.col("n") / 4)).select("cid")


def _pairs_within(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within groups of rows."""
    rank = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    row = np.repeat(starts, counts) + rank
    left = np.repeat(np.repeat(starts, counts), rank) + np.arange(rank.sum()) - np.repeat(np.cumsum(rank) - rank, rank)
    return left, np.repeat(row, rank)


def bucketed(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """(sig, a, b) from (sig, cid): the pairs a < b of small buckets (sig null), the members a of hot ones (b null).

    Rows stream through in order of sig; no more than ``most`` + 1 of a bucket and a batch are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_s, held_c, burning = np.empty(0, np.int64), np.empty(0, np.int64), None
        for s, c in ((x.column(0).to_numpy(), x.column(1).to_numpy()) for x in batches):
            s, c = np.concatenate((held_s, s)), np.concatenate((held_c, c))
            new = np.ones(len(s), bool)
            new[1:] = (s[1:] != s[:-1]) | (c[1:] != c[:-1])
            s, c = s[new], c[new]
            yield from emit(s, c, burning, last=False)
            tail = np.searchsorted(s, s[-1]) if len(s) else 0
            burning = s[-1] if len(s) and (len(s) - tail > most or s[-1] == burning) else None
            # of a hot bucket only its last row is held, to tell a copy of it
            held_s, held_c = (s[-1:], c[-1:]) if burning is not None else (s[tail:], c[tail:])
        if burning is None:
            yield from emit(held_s, held_c, None, last=True)

    def emit(s: np.ndarray, c: np.ndarray, burning, last: bool) -> Iterator[pa.RecordBatch]:
        if not len(s):
            return
        starts = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        counts = np.diff(np.concatenate((starts, [len(s)])))
        hot = counts > most
        if burning is not None and s[0] == burning:  # its rows so far are out already
            hot[0] = True
        ready = np.ones(len(starts), bool)
        ready[-1] = last or hot[-1]
        little = ready & ~hot & (counts > 1)
        if little.any():
            i, j = _pairs_within(starts[little], counts[little])
            order = np.lexsort((c[j], c[i]))
            a, b = c[i][order], c[j][order]
            once = np.ones(len(a), bool)
            once[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            yield _batch(sig=pa.nulls(int(once.sum()), pa.int64()), a=a[once], b=b[once])
        if hot.any():
            member = np.repeat(hot, counts)
            if burning is not None and s[0] == burning:
                member[0] = False
            yield _batch(sig=s[member], a=c[member], b=pa.nulls(int(member.sum()), pa.int64()))

    return rows.repartition("sig").sortWithinPartitions("sig", "cid").mapInArrow(lean(run), "sig long, a long, b long")


def _ends(pairs: DataFrame, rows: DataFrame, value: str) -> DataFrame:
    """``pairs`` (a, b) with the columns of ``rows`` (cid, ...) for either end, named x_a and x_b.

    ``rows`` are broadcast if all their ``value`` together are ``FEW_BYTES`` at most.
    """
    size = rows.agg(F.sum(F.octet_length(value) + 16)).first()[0] or 0
    near = F.broadcast(rows) if size <= FEW_BYTES else rows
    side = lambda k: near.select(F.col("cid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in rows.columns if c != "cid"])
    return pairs.join(side("a"), "a").join(side("b"), "b")


def sifted(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The distinct pairs (a, b) that their sketches do not rule out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            a, b, x, y, n, m = (rows.column(i).to_pylist() for i in range(6))
            ok = np.array([partenum.may_match(*z) for z in zip(x, y, n, m, strict=True)], bool)
            yield _batch(a=np.array(a, np.int64)[ok], b=np.array(b, np.int64)[ok])

    both = _ends(stage(pairs.distinct(), "candidates"), classes.select("cid", "sketch", "n"), "sketch").where(4 * F.least("n_a", "n_b") >= 3 * F.greatest("n_a", "n_b"))
    return both.select("a", "b", "sketch_a", "sketch_b", "n_a", "n_b").mapInArrow(lean(run), "a long, b long")


def verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of distinct pairs (a, b) whose sets have a Jaccard similarity of 3/4 at least, staged; a pair may come twice."""
    pairs = stage(pairs, "sifted")
    sets = stage(sets_of(texts, pairs.select(F.explode(F.array("a", "b")).alias("cid"))), "sets")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = batch.slice(at, 256)
                ok = np.zeros(rows.num_rows, bool)
                for i, (x, y) in enumerate(zip(rows.column(2).to_pylist(), rows.column(3).to_pylist(), strict=True)):
                    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                    both = np.concatenate((p, q))
                    both.sort()
                    ok[i] = 7 * int((both[1:] == both[:-1]).sum()) >= 3 * (len(p) + len(q))
                yield _batch(a=rows.column(0).to_numpy()[ok], b=rows.column(1).to_numpy()[ok])

    both = _ends(pairs, sets, "set").select("a", "b", "set_a", "set_b")
    return stage(both.mapInArrow(lean(run), "a long, b long"), "edges")


def texts_of(docs: DataFrame, classes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, text) of the wanted classes (cid), each from one row of ``docs`` (or its repeats)."""
    reps = classes.join(wanted, "cid", "left_semi").select("cid", F.col("rep.doc_id").alias("rep_doc"), F.col("rep.th").alias("rep_th"))
    reps = small(stage(reps, "reps"), FEW_IDS)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("th", F.xxhash64("text"))
    return rows.join(reps, (rows["th"] == reps["rep_th"]) & rows["doc_id"].eqNullSafe(reps["rep_doc"])).select("cid", "text")


def sets_of(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, set) of the wanted classes from (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, sizes in _sets(batches):
            ends = np.cumsum(sizes)
            yield _batch(cid=rows.column(0), set=pa.array([h[e - n : e].tobytes() for e, n in zip(ends, sizes, strict=True)], pa.binary()))

    if wanted.limit(FEW_IDS + 1).count() > FEW_IDS:
        wanted = wanted.distinct()
    ids = small(stage(wanted, "wanted"), FEW_IDS)
    return texts.join(ids, "cid", "left_semi").select("cid", "text").mapInArrow(lean(run), "cid long, set binary")


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node reachable from each) of the links u, v."""
    nodes, at = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    root = np.arange(len(nodes))
    while (root[a] != root[b]).any():
        low = np.minimum(root[a], root[b])
        for side in (root[a], root[b]):
            np.minimum.at(root, side, low)
        while (root[root] != root).any():
            root = root[root]
    return nodes, nodes[root]


def components(edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """(node, root) of the nodes of ``edges`` (a, b): root is the smallest node reachable.

    Up to ``few`` links in the driver; else alternating large and small stars, of which each round is staged, so a
    lost executor costs one round.
    """
    links = stage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if links.count() <= few:
        held = links.toArrow()
        nodes, roots = _roots(held.column("u").to_numpy(), held.column("v").to_numpy())
        return stage(edges.sparkSession.createDataFrame(pa.table({"node": nodes, "root": roots})), "roots")
    state = None
    while True:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        star = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        links = stage(star.where("u <> v").distinct(), "links")
        now = tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u") % 1000003)).first())
        if now == state:
            break
        state = now
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def _with_roots(rows: DataFrame, key: str, edges: DataFrame) -> DataFrame:
    roots = small(components(edges), FEW_IDS)
    return rows.join(roots.withColumnRenamed("node", key), key, "left").withColumn("root", F.coalesce("root", key))


def parities_of(texts: DataFrame) -> DataFrame:
    """(cid, n, bits) of (cid, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, h, sizes in _sets(batches):
            ends = np.cumsum(sizes)
            yield _batch(cid=rows.column(0), n=sizes, bits=pa.array([partenum.parity(h[e - n : e], int(n)) for e, n in zip(ends, sizes, strict=True)], pa.binary()))

    return texts.select("cid", "text").mapInArrow(lean(run), "cid long, n long, bits binary").groupBy("cid").agg(F.any_value("n").alias("n"), F.any_value("bits").alias("bits"))


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups of rows that agree in their first columns, from rows in their order."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        last = np.ones(batch.num_rows, bool)
        for i in range(keys):
            last &= batch.column(i).to_numpy() == batch.column(i)[batch.num_rows - 1].as_py()
        tail = int(np.argmax(last))
        same = held and all(held[0].column(i)[0] == batch.column(i)[0] for i in range(keys))
        if tail or (held and not same):
            yield pa.Table.from_batches([*held, batch.slice(0, tail)] if same or not held else [*held])
            if held and not same and tail:
                yield pa.Table.from_batches([batch.slice(0, tail)])
            held = []
        held.append(batch.slice(tail))
    if held:
        yield pa.Table.from_batches(held)


def _apart(x: np.ndarray, y: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, differing bits of some rows of ``x`` with all of ``y``)."""
    step = max(1, (1 << 21) // max(1, y.size))
    for i in range(0, len(x), step):
        yield i, np.bitwise_count(x[i : i + step, None, :] ^ y[None, :, :]).sum(axis=2, dtype=np.int64)


def _candidates(root: np.ndarray, n: np.ndarray, bits: list[bytes], left: np.ndarray, right: np.ndarray, best: bool) -> tuple[np.ndarray, np.ndarray, bool]:
    """(rows, rows, more): pairs of two blocks of a bucket of different components that may match by their parities.

    ``best``: for each row of the first block only the one that differs least, and whether there are ``more``.
    """
    y = partenum.fold_parities(bits, min(map(len, bits)) // 8)
    a, b, total = [], [], 0
    for i, apart in _apart(y[left], y[right]):
        own = left[i : i + len(apart)]
        size, other = n[own][:, None], n[right][None, :]
        ok = (7 * apart <= size + other) & (4 * np.minimum(size, other) >= 3 * np.maximum(size, other)) & (root[own][:, None] != root[right][None, :])
        total += int(ok.sum())
        if best:
            p = np.flatnonzero(ok.any(axis=1))
            q = np.where(ok[p], apart[p], np.iinfo(np.int64).max).argmin(axis=1)
        else:
            p, q = np.nonzero(ok)
        a.append(own[p])
        b.append(right[q])
    a, b = np.concatenate(a), np.concatenate(b)
    a, b = np.minimum(a, b), np.maximum(a, b)
    once = np.unique(a * len(root) + b)
    if np.array_equal(left, right):
        total //= 2  # each pair was seen from both sides
    return once // len(root), once % len(root), total > len(once)


def compared(blocked: DataFrame, best: bool) -> DataFrame:
    """(sig, a, b) from blocks (sig, i, j, at, cid, root, n, bits): pairs (sig null) and, if ``best``, buckets with more (a, b null).

    Blocks that find the same pair again in one task leave it out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for rows in _groups(batches, 3):
            keys = [rows.column(k).to_numpy() for k in range(3)]
            edges = [0, *(np.flatnonzero((keys[0][1:] != keys[0][:-1]) | (keys[1][1:] != keys[1][:-1]) | (keys[2][1:] != keys[2][:-1])) + 1).tolist()]
            at, cid, root, n = (rows.column(k).to_numpy() for k in range(3, 7))
            bits = rows.column(7).to_pylist()
            found: list[tuple[int, int]] = []
            again = []
            for p, q in zip(edges, [*edges[1:], rows.num_rows], strict=True):
                i, j = keys[1][p], keys[2][p]
                left, right = np.flatnonzero(at[p:q] == i), np.flatnonzero(at[p:q] == j)
                if not len(left) or not len(right) or (root[p:q] == root[p]).all():
                    continue
                a, b, more = _candidates(root[p:q], n[p:q], bits[p:q], left, right, best)
                a, b = cid[p:q][a], cid[p:q][b]
                for pair in zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist(), strict=True):
                    if pair not in seen:
                        found.append(pair)
                        if len(seen) < SEEN:
                            seen.add(pair)
                if more:
                    again.append(int(keys[0][p]))
            if found:
                a, b = zip(*found, strict=True)
                yield _batch(sig=pa.nulls(len(a), pa.int64()), a=np.array(a, np.int64), b=np.array(b, np.int64))
            if again:
                yield _batch(sig=np.array(again, np.int64), a=pa.nulls(len(again), pa.int64()), b=pa.nulls(len(again), pa.int64()))

    rows = blocked.select("sig", "i", "j", "at", "cid", "root", "n", "bits")
    return rows.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j").mapInArrow(lean(run), "sig long, a long, b long")


def within_hot(members: DataFrame, edges: DataFrame, texts: DataFrame) -> DataFrame:
    """Links (a, b) between the classes (sig, cid) of hot buckets, as many as are needed for their components.

    ``edges`` are the links known so far and are part of the result; ``texts`` has the classes' (cid, text).
    """
    for k in range(ROUNDS):
        first = members.groupBy("sig").agg(F.min_by("cid", F.xxhash64("cid", F.lit(k))).alias("a"))
        shared = members.join(first, "sig").where("a <> cid").groupBy(F.col("cid").alias("b"), "a").count()
        best = shared.groupBy("b").agg(F.max_by("a", F.struct("count", "a")).alias("a"))
        pairs = best.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        edges = edges.unionByName(verified(pairs.join(edges, ["a", "b"], "left_anti"), texts))
    own = small(stage(members.select("cid").distinct(), "hot-classes"), FEW_IDS)
    bits = small(stage(parities_of(texts.join(own, "cid", "left_semi")), "parities"), FEW_PARITIES)
    for best in (True, False):
        rows = stage(_with_roots(members, "cid", edges), "rooted")
        mixed = rows.groupBy("sig").agg(F.count("*").alias("size"), F.min("root").alias("lo"), F.max("root").alias("hi"))
        mixed = mixed.where("lo <> hi").select("sig", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
        blocked = rows.join(mixed, "sig").withColumn("at", F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int"))
        blocked = blocked.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        both = blocked.select("sig", "cid", "root", "at", F.least("at", "o").alias("i"), F.greatest("at", "o").alias("j"))
        found = stage(compared(both.join(bits, "cid"), best), "compared")
        edges = edges.unionByName(verified(found.where("a is not null").select("a", "b").distinct(), texts))
        members = members.join(found.where("sig is not null").select("sig").distinct(), "sig", "left_semi")
    return edges


def _grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, root, component_id) per row of ``docs``; root is one of the group's classes, null without words."""
    spark = docs.sparkSession
    with scratch(spark):
        clashes: Clashes = {}
        while True:
            rows = stage(describe(docs, clashes), "rows")
            classes = rows.where("n > 0").groupBy("cid").agg(
                F.min(F.struct("doc_id", "th")).alias("rep"), F.min("doc_id").alias("doc"), F.any_value("n").alias("n"), F.any_value("low").alias("low"),
                F.any_value("sketch").alias("sketch"), F.min("second").alias("second"), F.max("second").alias("other"),
            )
            classes = stage(classes, "classes")
            more = {r["cid"]: r["second"] for r in classes.where("second <> other").select("cid", "second").collect()}  # as good as none: 64-bit hashes that collide
            if not more:
                break
            clashes |= more
            discard(rows, classes)
        coarse = stage(bucketed(coarse_rows(docs, clashes)), "coarse")
        hot = coarse.where("b is null").select("sig", F.col("a").alias("cid"))
        first = stage(sifted(coarse.where("b is not null").select("a", "b"), classes), "pairs")
        crowd = stage(unresolved(hot), "crowd")
        wanted = crowd.unionByName(first.select(F.explode(F.array("a", "b")).alias("cid"))).distinct()
        texts = stage(texts_of(docs, classes, wanted), "texts")
        pairs, poor = [first], crowd
        for emitted in ("low", "n"):
            own = texts.join(small(poor, FEW_IDS), "cid", "left_semi")
            fine = stage(bucketed(fine_rows(own, half=emitted == "low"), FINE_BUCKET), "fine")
            pairs.append(stage(sifted(fine.where("b is not null").select("a", "b"), classes), "pairs"))
            poor = stage(poor_classes(classes, poor, fine, emitted), "poor")
            discard(fine)
        edges = verified(pairs[0].unionByName(pairs[1]).unionByName(pairs[2]).distinct(), texts)
        edges = within_hot(stage(hot.join(poor, "cid", "left_semi"), "members"), edges, texts)
        named = _with_roots(classes.select("cid", "doc"), "cid", edges)
        names = named.groupBy("root").agg(F.min("doc").alias("component"))
        by_class = named.join(names, "root").select("cid", "root", "component")
        out = rows.join(by_class, "cid", "left").select("doc_id", "th", F.col("n").alias("n_shingles"), "root", F.coalesce("component", "doc_id").alias("component_id"))
        return hand_on(out, "near-duplicates")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, th, n_shingles, component_id) per row of ``docs``; th is the xxhash64 of the text."""
    return _grouped(docs).drop("root")


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group of near duplicates, that of the smallest id (then of the smallest hash of its text).

    A null id is kept only where no other is in the group. Rows that repeat id and text count as one and one
    of them stays, the first by its other columns. Texts without words have no duplicates and all stay.
    """
    rows = _grouped(docs).where("root is not null")
    nulls_last = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")
    keepers = rows.groupBy("root").agg(F.min(nulls_last).alias("kept"))
    gone = rows.join(keepers, "root").where(nulls_last != F.col("kept")).select("doc_id", "th", F.lit(True).alias("gone"))
    again = rows.groupBy("doc_id", "th").count().where("count > 1").select("doc_id", "th", F.lit(False).alias("gone"))
    marks = gone.unionByName(again).groupBy("doc_id", "th").agg(F.max("gone").alias("is_gone"))
    names = {k: fresh(docs, k) for k in ("text_hash", "own_id", "is_gone", "place", "of_id", "of_th")}
    marks = small(stage(marks, "marks"), FEW_IDS).toDF(names["of_id"], names["of_th"], names["is_gone"])
    own = docs.withColumn(names["text_hash"], F.xxhash64("text")).withColumn(names["own_id"], F.col("doc_id").cast("long"))
    marked = own.join(marks, (F.col(names["text_hash"]) == F.col(names["of_th"])) & F.col(names["own_id"]).eqNullSafe(F.col(names["of_id"])), "left")
    columns = [f"`{c}`" for c in docs.columns]
    single = marked.where(F.col(names["is_gone"]).isNull()).select(*columns)
    orderly = [F.col(f"`{c}`") for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    order = Window.partitionBy(names["own_id"], names["text_hash"]).orderBy(*orderly)
    repeated = marked.where(~F.col(names["is_gone"])).withColumn(names["place"], F.row_number().over(order))
    return single.unionByName(repeated.where(F.col(names["place"]) == 1).select(*columns))
