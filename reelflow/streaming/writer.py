"""Writers whose messages are rows: what a program writes becomes a log in a shared folder, which a query encodes."""

from __future__ import annotations

import warnings
from abc import ABC, abstractmethod
from fractions import Fraction

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

LOG_SCHEMA = "writer_id long, seq long, kind string, name string, fps_num long, fps_den long, height int, width int, dtype string, data binary"


class FrameWriter(ABC):
    """What writers of sequences have in common; as a context manager it closes itself, on an interrupt without draining."""

    @abstractmethod
    def start_sequence(self, name: str, fps: float | Fraction) -> None: ...

    @abstractmethod
    def append_data(self, frame: np.ndarray) -> None: ...

    @abstractmethod
    def end_sequence(self, block: bool = True) -> None: ...

    @abstractmethod
    def close(self) -> None: ...

    @abstractmethod
    def shutdown(self) -> None: ...

    @property
    @abstractmethod
    def accepts_new_frames(self) -> bool: ...

    def __enter__(self) -> FrameWriter:
        return self

    def __exit__(self, kind, error, trace) -> None:
        if kind is not None and issubclass(kind, KeyboardInterrupt):
            self.shutdown()
        else:
            self.close()


class LogWriter(FrameWriter):
    """Appends messages to Parquet in ``folder``, ``most`` at a time, for ``encode_sessions`` or a stream over the folder.

    ``query``: the stream that reads the folder, if there is one. Ending a sequence and closing wait for it, and once it
    has failed the next call raises RuntimeError with the name of the sequence, once.
    Frames are arrays (height, width) or (planes, height, width). A start closes a sequence that is open.
    """

    def __init__(self, spark: SparkSession, folder: str, writer_id: int, query: StreamingQuery | None = None, most: int = 32):
        self.spark, self.folder, self.writer_id, self.query, self.most = spark, folder, writer_id, query, most
        self._pending: list[tuple] = []
        self._seq, self._name, self._open, self._closed = 0, None, False, False

    @property
    def accepts_new_frames(self) -> bool:
        return self._open

    def start_sequence(self, name: str, fps: float | Fraction) -> None:
        if fps is None or fps <= 0:
            raise ValueError("a sequence needs a rate above 0")
        rate = Fraction(fps).limit_denominator(100_000)
        self._put("start", name, rate.numerator, rate.denominator)
        self._name, self._open = name, True

    def append_data(self, frame: np.ndarray) -> None:
        if not self._open:
            raise ValueError("start a sequence before appending to it")
        height, width = frame.shape[-2:]
        self._put("append", self._name, None, None, height, width, str(frame.dtype), np.ascontiguousarray(frame).tobytes())

    def end_sequence(self, block: bool = True) -> None:
        if not self._open:
            raise ValueError("start a sequence before ending it")
        self._put("end", self._name)
        self._open = False
        self._flush()
        if block:
            self._drain()

    def close(self) -> None:
        """Write what is pending and wait until it is processed. A second call does nothing."""
        if not self._closed:
            self._open, self._closed = False, True
            self._put("quit", self._name)
            self._flush()
            self._drain()

    def shutdown(self) -> None:
        """Stop at once; messages that are not in the folder yet are discarded, with a warning."""
        if self._pending:
            warnings.warn(f"{len(self._pending)} messages are discarded; close() would write them", RuntimeWarning, stacklevel=2)
        self._pending, self._open, self._closed = [], False, True
        if self.query is not None:
            self.query.stop()

    def _put(self, kind: str, *values) -> None:
        self._raise_failed()
        self._pending.append((self.writer_id, self._seq, kind, *values, *[None] * (7 - len(values))))
        self._seq += 1
        if len(self._pending) >= self.most:
            self._flush()

    def _flush(self) -> None:
        if self._pending:
            self.spark.createDataFrame(self._pending, LOG_SCHEMA).coalesce(1).write.mode("append").parquet(self.folder)
            self._pending = []

    def _drain(self) -> None:
        self._raise_failed()
        if self.query is not None and self.query.isActive:
            try:
                self.query.processAllAvailable()
            except Exception:
                self._raise_failed()
                raise

    def _raise_failed(self) -> None:
        failed = self.query.exception() if self.query is not None else None
        if failed is not None:
            self.query = None
            raise RuntimeError(f"writing {self._name} failed: {failed}") from failed
