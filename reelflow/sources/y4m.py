"""Frames of YUV4MPEG2 files: raw planes with a text header per file and frame. Reading, counting and writing."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow.operators import sessions
from reelflow.plans.errors import DecodeError, EncodeError

FRAME_SCHEMA = "path string, frame_idx long, height int, width int, chroma string, fps_num long, fps_den long, data binary"
_PLANES = {"420": lambda w, h: w * h + 2 * ((w + 1) // 2) * ((h + 1) // 2), "422": lambda w, h: w * h + 2 * ((w + 1) // 2) * h, "444": lambda w, h: 3 * w * h, "mono": lambda w, h: w * h}


def parse_header(line: bytes, path: str = "") -> dict:
    """Width, height, rate and chroma layout of a file header line."""
    if not line.startswith(b"YUV4MPEG2"):
        raise DecodeError(path, 0, ValueError("not a YUV4MPEG2 file"))
    tags = {t[:1]: t[1:].decode() for t in line.split()[1:]}
    num, den = (int(x) for x in tags.get(b"F", "30:1").split(":"))
    chroma = tags.get(b"C", "420")
    return {"width": int(tags[b"W"]), "height": int(tags[b"H"]), "fps_num": num, "fps_den": den or 1, "chroma": next((c for c in _PLANES if chroma.startswith(c)), "420")}


def read_frames(data: bytes, path: str = "", max_frames: int | None = None) -> Iterator[tuple]:
    """Rows of ``FRAME_SCHEMA``; a frame that is cut off ends the file quietly."""
    at = data.find(b"\n")
    head = parse_header(data[: max(at, 0)], path)
    size = _PLANES[head["chroma"]](head["width"], head["height"])
    n = 0
    while max_frames is None or n < max_frames:
        end = data.find(b"\n", at + 1)
        if end < 0 or not data.startswith(b"FRAME", at + 1) or end + 1 + size > len(data):
            return
        yield path, n, head["height"], head["width"], head["chroma"], head["fps_num"], head["fps_den"], data[end + 1 : end + 1 + size]
        at, n = end + size, n + 1


def frames_of(spark: SparkSession, folder: str, pattern: str = "*.y4m", max_frames: int | None = None, decode: Callable | None = None) -> DataFrame:
    """Frames of the files in a folder; a task reads a file at a time.

    ``decode``: another function from (bytes, path, max_frames) to rows of ``FRAME_SCHEMA``, for other formats.
    """
    reader = decode or read_frames

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in FRAME_SCHEMA.split(", ")]
        for files in batches:
            for path, data in zip(files["path"], files["content"], strict=True):
                rows = []
                for row in reader(bytes(data), path, max_frames):
                    rows.append(row)
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, FRAME_SCHEMA)


def encode(frames: list[bytes], width: int, height: int, fps_num: int, fps_den: int, chroma: str = "444") -> bytes:
    head = f"YUV4MPEG2 W{width} H{height} F{fps_num}:{fps_den} Ip A1:1 C{chroma}\n".encode()
    return head + b"".join(b"FRAME\n" + f for f in frames)


def publish(path: str, data: bytes) -> None:
    """Write next to ``path`` and rename, so that the name never shows half a file."""
    temporary = f"{path}.tmp_{uuid.uuid4().hex}"
    try:
        with open(temporary, "wb") as f:
            f.write(data)
        os.replace(temporary, path)
    except OSError as e:
        if os.path.exists(temporary):
            os.unlink(temporary)
        raise EncodeError(path, 0, cause=e) from e


def _encoded(frames: list[tuple[int, int, bytes]], fps: tuple[int, int], chroma: str, path: str | None) -> tuple[str | None, bytes | None, str]:
    """(path, data, error) of one sequence of (height, width, data); with a path, the file is published there and data is None."""
    h, w = int(frames[0][0]), int(frames[0][1])
    if any(len({f[i] for f in frames} - {None}) > 1 for i in (0, 1)):
        return None, None, "mixed shapes"
    if h % 2 or w % 2:
        return None, None, "odd size"
    if any(len(f[2]) != _PLANES[chroma](w, h) for f in frames):
        return None, None, "data does not fit the size"
    data = encode([f[2] for f in frames], w, h, *fps, chroma)
    if path is None:
        return None, data, ""
    publish(path, data)
    return path, None, ""


def _runs(batches: Iterable[pa.RecordBatch], n: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """(the first ``n`` values, rows of the others) of each run of sorted rows; a run may go on in the next batch.

    Far cheaper than a pandas group per sequence, of which there may be very many, each of a few frames.
    """
    rows = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True))
    for key, run in groupby(rows, lambda r: r[:n]):
        yield key, [r[n:] for r in run]


def _batched(rows: Iterator[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows that end in (path, data, error) in batches of 1,024, or of 4 MB of data if that is less."""
    held, size = [], 0
    make = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
    for row in rows:
        held.append(row)
        size += len(row[-2] or b"")
        if len(held) == 1024 or size >= 4 << 20:
            yield make()
            held, size = [], 0
    if held:
        yield make()


def _written(*keys: str) -> tuple[pa.Schema, str]:
    """The columns of written sequences, for Arrow and for Spark."""
    kinds = dict.fromkeys((*keys, "n_frames"), "long") | {"path": "string", "data": "binary", "error": "string"}
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.schema([(c, types[k]) for c, k in kinds.items()]), ", ".join(f"{c} {k}" for c, k in kinds.items())


def encode_sessions(log: DataFrame, folder: str | None = None, chroma: str = "444") -> DataFrame:
    """One file per session of a writer: (writer_id, session, n_frames, path, data, error).

    ``log``: (writer_id, seq, kind, fps_num, fps_den, height, width, dtype, data); starts carry the rate, appends the frames.
    Messages outside a session count for nothing, a session without frames has no row and no file. What cannot be
    written is an error row and leaves no file: a start without rate, types other than uint8, mixed or odd sizes.
    A session must fit a task. With ``folder``, files are published there as ``<writer>_<session>.y4m``.
    """

    schema, ddl = _written("writer_id", "session")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (writer, session), rows in _runs(batches, 2):
            num, den = next(r[2:4] for r in rows if r[1] == "start")
            frames = [r for r in rows if r[1] == "append"]
            if not frames:
                continue
            path, data, error, kinds = None, None, "", {r[6] for r in frames}
            if pd.isna(num) or pd.isna(den):
                error = "start without fps"
            elif len(kinds) > 1:
                error = "mixed dtypes"
            elif frames[0][6] != "uint8":
                error = f"cannot write {frames[0][6]}"
            else:
                path, data, error = _encoded([(r[4], r[5], r[7]) for r in frames], (int(num), int(den)), chroma, folder and f"{folder}/{writer}_{session}.y4m")
            yield writer, session, len(frames), path, data, error

    rows = sessions.sessions(log).where("session > 0 and valid and kind in ('start', 'append')")
    rows = rows.select(F.col("writer_id").cast("long").alias("writer_id"), "session", "seq", "kind", "fps_num", "fps_den", "height", "width", "dtype", "data")
    # The windows of sessions() leave a writer's rows in one task and in this order: no frame is shuffled or sorted again.
    return rows.sortWithinPartitions("writer_id", "seq").mapInArrow(lambda batches: _batched(written(batches), schema), ddl)


def raise_failed(written: DataFrame) -> None:
    """EncodeError for a failed session of ``encode_sessions`` (kept or written before, as this reads it), if there is one."""
    bad = written.where("error <> ''").select("writer_id", "session", "error").first()
    if bad is not None:
        raise EncodeError(f"{bad['writer_id']}_{bad['session']}.y4m", 0, cause=ValueError(bad["error"]))


def encode_sequences(frames: DataFrame, folder: str | None = None, fps: tuple[int, int] = (30, 1), chroma: str = "444") -> DataFrame:
    """One file per seq_id of (seq_id, frame_idx, height, width, data): (seq_id, n_frames, path, data, error).

    With ``folder`` (shared by all executors) files are published there and ``data`` is null; without, the file
    is the result. A sequence of mixed or odd sizes is an error row and leaves no file; one without frames has no row.
    """

    schema, ddl = _written("seq_id")

    def written(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for (seq,), rows in _runs(batches, 1):
            yield seq, len(rows), *_encoded([r[1:] for r in rows], fps, chroma, folder and f"{folder}/{seq}.y4m")

    rows = frames.select(F.col("seq_id").cast("long").alias("seq_id"), "frame_idx", "height", "width", "data")
    return rows.repartition("seq_id").sortWithinPartitions("seq_id", "frame_idx").mapInArrow(lambda batches: _batched(written(batches), schema), ddl)
