"""Benchmark passages inside training texts.

The benchmark's windows of ``width`` normalised words form a hash set that is broadcast; each
document's token windows are hashed in numpy and looked up, every hit is verified word by word,
and the words inside verified windows are marked. An item shorter than a window is one window.

The set is broadcast only in blocks of at most ``BLOCK_BYTES`` of benchmark text, whose index takes about
eight times as much (sorted hashes and positions, a filter of bits, the words): a larger benchmark is cut by
hash of its texts and applied block after block, each time over rows staged with the marks so far. There is no
shuffle of documents.

``clean`` drops each document that holds a whole window of ``width`` words, or in which a twentieth of the words
are hit by items shorter than that; elsewhere such short items are cut out, until none is left.

Nulls: a null text has no words and stays null. A null item id marks words but is no item. Repeated ids of the
benchmark count as one item. Rows that repeat a document are each judged. Empty tables give empty results, an
empty benchmark hits nothing. Columns of the caller are kept, whatever their names.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import discard, fresh, lean, stage, text_slices

WIDTH = 13
#: A document is contaminated if at least one word of this many is hit.
SHARE = 20
BLOCK_BYTES = 8 << 20

#: A-Z to a-z, digits and all bytes of non-ASCII characters as they are, the rest to a space.
WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))
MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Windows:
    """The windows of some benchmark items, by length: sorted hashes, where each stands, and a filter."""

    def __init__(self, items: list[tuple[str | None, bytes]], width: int = WIDTH):
        self.vocab: dict[bytes, int] = {}
        self.names = [name for name, _ in items]
        texts = [[self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)] for _, text in items]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.begin = np.cumsum(sizes) - sizes
        self.words = np.fromiter((w for ids in texts for w in ids), np.int32, int(sizes.sum()))
        self.values = np.array([0, *(xxhash.xxh3_64_intdigest(w) for w in self.vocab)], np.uint64)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.minimum(sizes, width)
        for n in np.unique(lengths[lengths > 0]).tolist():
            at = np.concatenate([np.arange(b, b + s - n + 1) for b, s in zip(self.begin[lengths == n], sizes[lengths == n], strict=True)])
            h = self.hashes(self.words, n)[at]
            order = np.argsort(h, kind="stable")
            h, at = h[order], at[order].astype(np.int32)
            bits = max(16, (8 * len(h)).bit_length())
            held = np.zeros(1 << bits, bool)
            held[h >> np.uint64(64 - bits)] = True
            self.tables[n] = (h, at, np.packbits(held, bitorder="little"))

    def hashes(self, ids: np.ndarray, n: int) -> np.ndarray:
        """Hash of each window of ``n`` ids."""
        v = self.values[ids]
        h = v[: len(v) - n + 1].copy()
        for j in range(1, n):
            h *= MIX
            h += v[j : len(v) - n + 1 + j]
        h ^= h >> np.uint64(29)
        h *= MIX
        return h

    def find(self, ids: np.ndarray) -> Iterator[tuple[int, int, str | None]]:
        """(start, length, item) of each verified window in ``ids``; id 0 is in no window."""
        for n, (sorted_hashes, places, held) in self.tables.items():
            if len(ids) < n:
                continue
            h = self.hashes(ids, n)
            cell = h >> np.uint64(64 - (8 * len(held)).bit_length() + 1)
            here = np.flatnonzero(held[cell >> np.uint64(3)] >> (cell & np.uint64(7)).astype(np.uint8) & 1)
            low = np.searchsorted(sorted_hashes, h[here], "left")
            found = np.searchsorted(sorted_hashes, h[here], "right") - low
            start = np.repeat(here, found)
            entry = np.repeat(low, found) + np.arange(found.sum()) - np.repeat(np.cumsum(found) - found, found)
            place = places[entry]
            same = np.ones(len(start), bool)
            for j in range(n):
                same &= ids[start + j] == self.words[place + j]
            item = np.searchsorted(self.begin, place[same], "right") - 1
            for i, k in zip(start[same].tolist(), item.tolist(), strict=True):
                yield i, n, self.names[k]

    def ids(self, text: bytes) -> list[int]:
        return [self.vocab.get(w, 0) for w in words_of(text)]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _marker(index, at_marks: int):
    """Adds the verified ranges and items of one block to the marks that each row brings."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = index.value
        for rows, texts in text_slices(batches):
            counts, ids = [], []
            for text in texts:
                own = windows.ids(text)
                counts.append(len(own))
                ids += own
                ids.append(0)  # no window reaches into the next text
            ends = np.cumsum(np.array(counts) + 1)
            spans: dict[int, list[tuple[int, int]]] = defaultdict(list)
            items: dict[int, set] = defaultdict(set)
            longest: dict[int, int] = defaultdict(int)
            for start, n, item in windows.find(np.array(ids, np.int64)):
                doc = int(np.searchsorted(ends, start, "right"))
                own = start - (int(ends[doc - 1]) if doc else 0)
                spans[doc].append((own, own + n))
                items[doc].add(item)
                longest[doc] = max(longest[doc], n)
            old = rows.column(at_marks).to_pylist()
            new = []
            for i, n_words in enumerate(counts):
                before = old[i] or {"spans": [], "items": [], "longest": 0}
                every = _merged([*((x["start"], x["stop"]) for x in before["spans"]), *spans.get(i, [])])
                owners = sorted({*before["items"], *(x for x in items.get(i, ()) if x is not None)})
                new.append({"n_words": n_words, "spans": [{"start": a, "stop": b} for a, b in every], "items": owners, "longest": max(before["longest"], longest.get(i, 0))})
            span = pa.struct([("start", pa.int64()), ("stop", pa.int64())])
            made = pa.array(new, pa.struct([("n_words", pa.int64()), ("spans", pa.list_(span)), ("items", pa.list_(pa.string())), ("longest", pa.int64())]))
            yield pa.RecordBatch.from_arrays([made if i == at_marks else rows.column(i) for i in range(rows.num_columns)], names=rows.schema.names)

    return mark


def _indexes(benchmark: DataFrame, width: int, block_bytes: int) -> list[Callable]:
    """Per block of the benchmark a function that makes its broadcast index."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("string").alias("item"), "text").where("text is not null")
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    blocks = max(1, math.ceil(total / block_bytes))

    def index(b: int):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == b)
        return spark.sparkContext.broadcast(Windows([(r["item"], r["text"].encode()) for r in part.collect()], width))

    return [lambda b=b: index(b) for b in range(blocks)]


def mark(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, into: str = "leak") -> DataFrame:
    """``docs`` and, last, ``into`` (or a free name like it): struct<n_words, spans array<struct<start, stop>>, items array<string>, longest>.

    Positions are in words, spans do not overlap; ``longest`` is the length of the longest window found.
    """
    into = fresh(docs, into)
    kind = "struct<n_words:long,spans:array<struct<start:long,stop:long>>,items:array<string>,longest:long>"
    df = docs.withColumn(into, F.lit(None).cast(kind))
    for b, index in enumerate(_indexes(benchmark, width, block_bytes)):
        if b:
            df = stage(df, "marks")
        df = df.mapInArrow(lean(_marker(index(), df.columns.index(into))), df.schema)
    return df


def hit_words(leak):
    """Words inside spans; spans of a row never overlap."""
    return F.aggregate(leak["spans"], F.lit(0).cast("long"), lambda a, x: a + x["stop"] - x["start"])


def contaminated(leak, share: int = SHARE):
    n = hit_words(leak)
    return (n > 0) & (share * n >= leak["n_words"])


def remove_spans(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The text without the words of ``spans`` and what stands between them."""
    starts, stops, at = [], [], 0
    raw = text.translate(WORDS)
    for w in raw.split():
        at = raw.index(w, at)
        starts.append(at)
        at += len(w)
        stops.append(at)
    out, last = [], 0
    for a, b in spans:
        out.append(text[last : starts[a]])
        last = stops[b - 1]
    return b"".join([*out, text[last:]])


def without_windows(text: bytes, windows: Windows) -> bytes:
    """The text with all occurrences of windows cut out, those that form where words have come together included."""
    while found := _merged([(i, i + n) for i, n, _ in windows.find(np.array(windows.ids(text), np.int64))]):
        text = remove_spans(text, found)
    return text


def _cutter(index, at_marks: int):
    """Cuts a block's windows out of the texts of rows with marks; ``longest`` becomes -1 where something went."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows: Windows = index.value
        for rows, texts in text_slices(batches):
            at = rows.schema.get_field_index("text")
            column, marks = rows.column(at).to_pylist(), rows.column(at_marks).to_pylist()
            for i, (text, m) in enumerate(zip(texts, marks, strict=True)):
                if m["spans"] and len(new := without_windows(text, windows)) < len(text):
                    column[i], m["longest"] = new.decode(), -1
            cols = {at: pa.array(column, rows.schema.field(at).type), at_marks: pa.array(marks, rows.schema.field(at_marks).type)}
            yield pa.RecordBatch.from_arrays([cols.get(i, rows.column(i)) for i in range(rows.num_columns)], names=rows.schema.names)

    return cut


def clean(docs: DataFrame, benchmark: DataFrame, spans_only: bool = False, width: int = WIDTH, block_bytes: int = BLOCK_BYTES, flag: str | None = None) -> DataFrame:
    """``docs`` without any window of the benchmark: contaminated rows go, short items in other rows are cut out.

    With ``spans_only`` no row goes: every window is cut out. ``flag`` names a boolean column that tells which texts were cut.
    """
    name = fresh(docs, "leak")
    df = mark(docs, benchmark, width, block_bytes, into=name)
    leak = F.col(name)
    if not spans_only:
        df = df.where(~(contaminated(leak) | (leak["longest"] >= width)))
    indexes = _indexes(benchmark, width, block_bytes)
    if len(indexes) == 1:
        df = df.mapInArrow(lean(_cutter(indexes[0](), df.columns.index(name))), df.schema)
    else:
        df = stage(df.withColumn(name, leak.withField("longest", F.lit(0).cast("long"))), "marked")
        left = -1
        while left:  # a cut can bring words of another block together
            before = df.agg(F.sum(F.octet_length("text"))).first()[0]
            for index in indexes:
                done, df = df, stage(df.mapInArrow(lean(_cutter(index(), df.columns.index(name))), df.schema), "cut")
                discard(done)
            left = (before or 0) - (df.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    out = df.select(*[F.col(f"`{c}`") for c in docs.columns], *([(leak["longest"] == -1).alias(flag)] if flag else []))
    return out
