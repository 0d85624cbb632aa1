"""Helpers that all operators of the subpackage share."""

from __future__ import annotations

import atexit
import ctypes
import functools
import tempfile
import uuid
from bisect import bisect_left
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a Python worker holds as tokens at a time.
SLICE_BYTES = 4 << 20

#: A word ends at a space, tab, line feed, vertical tab, form feed or carriage return.
SPACE_WORD = r"[^\x20\x09-\x0D]+"

#: Deletes the shuffle files of a query when it has ended. A public setting of Spark 4.1.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of a batch that goes to a Python worker, whatever the length of its rows (one row at least), and their number.
_BATCH_BYTES, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local session without that setting (tests, a bench) gets a temporary folder of its own.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="reelflow-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


class Scratch:
    """Folders that were staged while it was open. ``clear`` deletes them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.paths: list[str] = []

    def drop(self, path: str) -> None:
        self.paths.remove(path)
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(hadoop, True)

    def clear(self) -> None:
        for path in list(self.paths):
            self.drop(path)


#: The innermost open scratch, and those around it.
_open: ContextVar[tuple[Scratch, ...]] = ContextVar("open", default=())
_until_exit: list[Scratch] = []


@contextmanager
def scratch(spark: SparkSession, keep: bool = False) -> Iterator[Scratch]:
    """What is staged inside is deleted at the end (or, with ``keep``, by the caller), but for what ``hand_on`` stages."""
    held = Scratch(spark)
    token = _open.set((*_open.get(), held))
    try:
        yield held
    finally:
        _open.reset(token)
        if not keep:
            held.clear()


def _owner(spark: SparkSession, outer: int) -> Scratch:
    around = _open.get()
    if len(around) > outer:
        return around[-1 - outer]
    if not _until_exit or _until_exit[-1].spark is not spark:
        _until_exit.append(Scratch(spark))
    return _until_exit[-1]


def _staged(df: DataFrame, name: str, owner: Scratch) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage-{uuid.uuid4().hex}-{name}"
    ours = {_CLEANUP: "true", _BATCH_BYTES: str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in ours}
    owner.paths.append(path)
    try:
        for k, v in ours.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = (owner, path)
    return out


def bound_batches(spark: SparkSession) -> None:
    """From now on the session's batches for Python workers have ``BATCH_BYTES`` at most, unless it has a bound of its own."""
    if spark.conf.get(_BATCH_BYTES, None) is None:
        spark.conf.set(_BATCH_BYTES, str(BATCH_BYTES))


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: cuts lineage, survives lost executors.

    Its shuffle files go when it is written; the folder goes with the open scratch, else at exit.
    """
    return _staged(df, name, _owner(df.sparkSession, 0))


def hand_on(df: DataFrame, name: str) -> DataFrame:
    """``stage``, into what is around the innermost open scratch: the result of an operator outlives its working folders."""
    return _staged(df, name, _owner(df.sparkSession, 1))


def discard(*staged: DataFrame) -> None:
    """Delete folders of frames that ``stage`` returned and nobody reads any more."""
    for df in staged:
        owner, path = df._staged_at
        owner.drop(path)


@atexit.register
def _clean() -> None:
    for held in _until_exit:
        try:
            held.clear()
        except Exception:  # the session ended first; the folder's owner cleans up
            return


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have, whatever extra columns it brings."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is evaluated once however often ``body`` names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` with a broadcast hint if a count shows at most ``most`` rows; else Spark chooses the join."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def null_safe(df: DataFrame, other: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Equi-join in which null equals null; the keys come once, from ``df``."""
    names = {k: fresh(df, f"{k}__r") for k in on}
    for k, v in names.items():
        other = other.withColumnRenamed(k, v)
    cond = None
    for k, v in names.items():
        c = df[k].eqNullSafe(other[v])
        cond = c if cond is None else cond & c
    return df.join(other, cond, how).drop(*names.values())


class Reach:
    """How far spans reach that begin before a place, in logarithmic time."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        spans = sorted(spans)
        self.starts = [a for a, _ in spans]
        self.ends = list(accumulate((b for _, b in spans), max))

    def end(self, before: int) -> int:
        """The largest end of the spans that begin before ``before``; -1 without any."""
        i = bisect_left(self.starts, before)
        return self.ends[i - 1] if i else -1


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives back what it has freed: idle workers share an executor's memory with those at work."""

    @functools.wraps(run)
    def run_lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
            if trim:
                trim(0)

    return run_lean


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of whole rows with about ``most`` bytes of text each, and their texts as UTF-8 bytes (null: empty)."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(column))
        texts = col.cast(pa.large_binary())
        start, size = 0, 0
        held: list[bytes] = []
        for i in range(batch.num_rows):
            t = texts[i].as_py() or b""
            held.append(t)
            size += len(t) + 64
            if size >= most:
                yield batch.slice(start, i + 1 - start), held
                start, size, held = i + 1, 0, []
        if held:
            yield batch.slice(start), held
