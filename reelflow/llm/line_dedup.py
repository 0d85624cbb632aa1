"""Lines that many documents share are dropped, except in one document.

Each text is exploded to its normalised lines, the lines are hashed to 128 bits, and a count
of distinct documents per hash, combined before the shuffle, finds the shared ones: a hash and the largest
id that holds it. Of these, up to ``FEW_KEYS`` (24 bytes each) are broadcast: each text is then put together again
by position where it stands, no text is shuffled and no line is joined. Beyond that many the lines are joined
with the shared hashes, a hash's rows being dealt out over ``SALTS`` tasks, and texts meet the hashes that they lose.

Nulls and repeats: a null text is one empty line. Rows with a null id count as no document and
stay whole. Rows that repeat an id count as one document and lose lines alike. Short lines stay. A text of any
length is one row. An empty table gives an empty result. Columns of the caller are kept, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.llm.common import discard, fresh, lean, stage, text_slices

BLANK = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
#: Shared hashes that are broadcast at most, 24 bytes each.
FEW_KEYS = 1 << 20
#: Tasks among which the rows of one hash are dealt where hashes are joined.
SALTS = 16


def line_key(line: bytes, min_chars: int = MIN_CHARS) -> bytes | None:
    """128-bit hash of the stripped line with A-Z lower-cased; None below ``min_chars`` code points."""
    key = line.strip(BLANK)
    if len(key) < min_chars or len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_digest(key.lower())


def line_keys(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(k, doc_id): each long line's key once per row of ``docs``."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            keys: list[bytes] = []
            ids: list[int] = []
            for doc, text in zip(rows.column(0).to_pylist(), texts, strict=True):
                own = {line_key(x, min_chars) for x in text.split(b"\n")}
                own.discard(None)
                keys += own
                ids += [doc] * len(own)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], names=["k", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    return rows.mapInArrow(lean(explode), "k binary, doc_id long")


def shared_lines(keys: DataFrame, min_docs: int = MIN_DOCS) -> DataFrame:
    """(k, keeper): keys that ``min_docs`` documents hold, and the largest id among them."""
    return keys.groupBy("k").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs).select("k", "keeper")


class Shared:
    """Shared hashes in order, with the largest id that holds each."""

    def __init__(self, keys: list[bytes], keepers: list[int]) -> None:
        both = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64).reshape(-1, 2)
        order = np.lexsort((both[:, 1], both[:, 0]))
        self.high, self.low, self.keeper = both[order, 0], both[order, 1], np.array(keepers, np.int64)[order]

    def keeper_of(self, key: bytes) -> int | None:
        """The document that keeps a line, None if it is not shared."""
        high, low = np.frombuffer(key, ">u8").astype(np.uint64)
        i = np.searchsorted(self.high, high)
        while i < len(self.high) and self.high[i] == high:
            if self.low[i] == low:
                return int(self.keeper[i])
            i += 1
        return None

    def some(self, keys: list[bytes]) -> set[bytes]:
        """Those of ``keys`` whose first half is that of a shared hash."""
        if not len(self.high) or not keys:
            return set()
        high = np.frombuffer(b"".join(keys), ">u8").astype(np.uint64)[::2]
        i = np.minimum(np.searchsorted(self.high, high), len(self.high) - 1)
        return {keys[j] for j in np.flatnonzero(self.high[i] == high)}


def _lost_by_join(docs: DataFrame, keys: DataFrame, shared: DataFrame, lost: str, own: str) -> DataFrame:
    """``docs`` and, last, ``lost``: the hashes of lines that a row loses (null: none)."""
    salted = shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = keys.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    drops = rows.join(salted, ["k", "salt"]).where("doc_id < keeper").groupBy(F.col("doc_id").alias(own)).agg(F.collect_set("k").alias(lost))
    joined = docs.join(drops, docs["doc_id"] == drops[own], "left").drop(own)
    return joined.select(*[joined[f"`{c}`"] for c in docs.columns], joined[lost])


def drop_shared_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, few: int = FEW_KEYS) -> DataFrame:
    """``docs`` with its texts put together anew and, last, ``line_counts`` struct<n_lines, n_dropped, kept_sha256>.

    A text that loses nothing is returned as it was, null included.
    """
    spark = docs.sparkSession
    keys = stage(line_keys(docs, min_chars), "lines")
    shared = stage(shared_lines(keys, min_docs), "shared")
    lost, counts, own = fresh(docs, "lost_lines"), fresh(docs, "line_counts"), fresh(docs, "line_doc")
    if shared.count() <= few:
        held = shared.collect()
        discard(keys)
        index = spark.sparkContext.broadcast(Shared([bytes(r["k"]) for r in held], [r["keeper"] for r in held]))
        source = docs
    else:
        index, source = None, _lost_by_join(docs, keys, shared, lost, own)
    out = docs.withColumn(counts, F.lit(None).cast("struct<n_lines:long,n_dropped:long,kept_sha256:string>")).schema
    at_text, at_id = docs.columns.index("text"), docs.columns.index("doc_id")

    def losses(rows: pa.RecordBatch, lines: list[list[bytes]]) -> Iterator[tuple[list[bytes | None], set[bytes]]]:
        """Per row the hash of each line, and those that go."""
        every = [[line_key(x, min_chars) for x in own] for own in lines]
        if index is None:
            for own, gone in zip(every, rows.column(rows.num_columns - 1).to_pylist(), strict=True):
                yield own, set(gone or ())
            return
        shared = index.value
        some = shared.some(list({k for own in every for k in own if k}))
        keeper = {k: x for k in some if (x := shared.keeper_of(k)) is not None}
        for own, doc in zip(every, rows.column(at_id).to_pylist(), strict=True):
            yield own, {k for k in own if k in keeper and doc is not None and int(doc) < keeper[k]}

    def reassemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in text_slices(batches):
            lines = [text.split(b"\n") for text in texts]
            new, n_dropped, sha = rows.column(at_text).to_pylist(), [], []
            for i, (own, gone) in enumerate(losses(rows, lines)):
                text = texts[i]
                kept = [x for x, k in zip(lines[i], own, strict=True) if k not in gone] if gone else lines[i]
                n_dropped.append(len(lines[i]) - len(kept))
                if gone:
                    text = b"\n".join(kept)
                    new[i] = text.decode("utf-8", "replace")
                sha.append(hashlib.sha256(text).hexdigest())
            made = pa.StructArray.from_arrays([pa.array(list(map(len, lines)), pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(sha, pa.string())], names=["n_lines", "n_dropped", "kept_sha256"])
            cols = [pa.array(new, rows.schema.field(i).type) if i == at_text else rows.column(i) for i in range(len(docs_columns))]
            yield pa.RecordBatch.from_arrays([*cols, made], names=[*docs_columns, counts])

    docs_columns = docs.columns
    return source.mapInArrow(lean(reassemble), out)
