"""Packets and streams of ISO base media files (MP4, MOV), from their sample tables, without a decoder.

``spark.dataSource.register(PacketSource)`` once, then ``spark.read.format("reel_packets").option("paths", ...)``.
A partition is a file. For paths that only Spark can read, use ``packets_of(spark, folder)``, which goes through
Spark's own ``binaryFile`` source.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.window import Window

from reelflow.plans.errors import DecodeError

SCHEMA = "path string, stream_idx int, kind string, pos long, pts long, dts long, is_keyframe boolean, size_bytes long, tb_den long, width int, height int, codec string"


def _boxes(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(type, body start, body end) of the boxes in a range; a box that is cut off ends the scan."""
    while start + 8 <= end:
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if start + 16 > end:
                return
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            return
        yield kind, start + head, start + size
        start += size


def _find(data: bytes, start: int, end: int, *path: bytes) -> tuple[int, int] | None:
    for kind, a, b in _boxes(data, start, end):
        if kind == path[0]:
            return (a, b) if len(path) == 1 else _find(data, a, b, *path[1:])
    return None


def _runs(data: bytes, span: tuple[int, int] | None, form: str) -> list[tuple]:
    """Entries of a table box: version and flags, a count, then that many records."""
    if span is None:
        return []
    n = struct.unpack_from(">I", data, span[0] + 4)[0]
    size = struct.calcsize(form)
    return [struct.unpack_from(form, data, span[0] + 8 + i * size) for i in range(min(n, (span[1] - span[0] - 8) // size))]


def movie_header(file: BinaryIO) -> bytes:
    """The movie box of a file that can be sought, without reading the media; empty if there is none."""
    end, at = file.seek(0, 2), 0
    while at + 8 <= end:
        file.seek(at)
        head = file.read(16)
        size, kind = struct.unpack_from(">I4s", head)
        if size == 1 and len(head) == 16:
            size = struct.unpack_from(">Q", head, 8)[0]
        size = size or end - at
        if size < 8 or at + size > end:
            break
        if kind == b"moov":
            file.seek(at)
            return file.read(size)
        at += size
    return b""


def _movie(data: bytes, path: str) -> tuple[int, int]:
    moov = _find(data, 0, len(data), b"moov")
    if moov is None:
        raise DecodeError(path, 0, ValueError("no movie header"))
    return moov


def _scale(data: bytes, head: tuple[int, int]) -> int:
    """Ticks per second of a movie or media header."""
    return struct.unpack_from(">I", data, head[0] + (20 if data[head[0]] == 1 else 12))[0]


def _tracks(data: bytes, moov: tuple[int, int]) -> Iterator[tuple[tuple, tuple, tuple, tuple]]:
    """Spans of each track with samples, its media header, its handler and its sample tables."""
    for kind, a, b in _boxes(data, *moov):
        if kind != b"trak":
            continue
        mdhd, hdlr, stbl = (_find(data, a, b, b"mdia", x) for x in (b"mdhd", b"hdlr", b"minf"))
        stbl = _find(data, *stbl, b"stbl") if stbl else None
        if mdhd and hdlr and stbl:
            yield (a, b), mdhd, hdlr, stbl


def read_packets(data: bytes, path: str = "") -> Iterator[tuple]:
    """Rows of ``SCHEMA``, stream by stream, in order of decoding."""
    for number, (_, mdhd, hdlr, stbl) in enumerate(_tracks(data, _movie(data, path))):
        scale = _scale(data, mdhd)
        media = {b"vide": "video", b"soun": "audio"}.get(data[hdlr[0] + 8 : hdlr[0] + 12], "other")
        table = {k: (x, y) for k, x, y in _boxes(data, *stbl)}
        codec, width, height = "", 0, 0
        if b"stsd" in table:
            x = table[b"stsd"][0] + 8
            codec = data[x + 4 : x + 8].decode("latin-1")
            if media == "video":
                width, height = struct.unpack_from(">HH", data, x + 32)
        sizes: list[int] = []
        if b"stsz" in table:
            x = table[b"stsz"][0]
            fixed, n = struct.unpack_from(">II", data, x + 4)
            sizes = [fixed] * n if fixed else [s for (s,) in struct.iter_unpack(">I", data[x + 12 : x + 12 + 4 * n])]
        keys = {i for (i,) in _runs(data, table.get(b"stss"), ">I")}
        durations = [d for n, d in _runs(data, table.get(b"stts"), ">II") for _ in range(n)]
        offsets = [d for n, d in _runs(data, table.get(b"ctts"), ">Ii") for _ in range(n)]
        dts = 0
        for i, step in enumerate(durations):
            shift = offsets[i] if i < len(offsets) else 0
            yield path, number, media, i, dts + shift, dts, not keys and b"stss" not in table or i + 1 in keys, sizes[i] if i < len(sizes) else None, scale, width, height, codec
            dts += step


def _edits(data: bytes, track: tuple[int, int]) -> list[tuple[int, int]]:
    """(duration in movie ticks, start in media ticks or -1 for a pause) of a track's edit list."""
    span = _find(data, *track, b"edts", b"elst")
    if span is None:
        return []
    return [x[:2] for x in _runs(data, span, ">QqI" if data[span[0]] == 1 else ">IiI")]


def read_shown(data: bytes, path: str = "") -> Iterator[tuple]:
    """(path, stream_idx, frame_idx, pts): when the frames of the video streams are shown after their edit lists.

    A frame before an edit's start or after its end is decoded but not shown; a pause shifts what follows. An edit of
    no duration lasts to the end. Frames are found by their packets: nothing is decoded.
    """
    moov = _movie(data, path)
    mvhd = _find(data, *moov, b"mvhd")
    times: dict[int, list[int]] = {}
    for row in read_packets(data, path):
        if row[2] == "video":
            times.setdefault(row[1], []).append(row[4])
    for number, (track, mdhd, _, _) in enumerate(_tracks(data, moov)):
        own, shown, base = sorted(times.get(number, [])), [], 0
        media, movie, edits = _scale(data, mdhd), _scale(data, mvhd) if mvhd else 1, _edits(data, track)
        for duration, start in edits:
            length = duration * media // movie
            if start >= 0:
                shown += [t - start + base for t in own if start <= t and (not duration or t < start + length)]
            base += length
        shown = shown if edits else own
        yield from ((path, number, i, t) for i, t in enumerate(shown))


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str]):
        self.paths = paths

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            yield from read_packets(movie_header(f), partition.path)


class PacketSource(DataSource):
    """Option ``paths``: files, separated by newlines, that every executor can open."""

    @classmethod
    def name(cls) -> str:
        return "reel_packets"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader([p for p in self.options["paths"].split("\n") if p])


def packets_of(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """Packets of the files in a folder that Spark can list, whatever store it is in."""
    return _rows_of(spark, folder, pattern, read_packets, SCHEMA)


def shown_of(spark: SparkSession, folder: str, pattern: str = "*.mp4") -> DataFrame:
    """``read_shown`` of the files in a folder."""
    return _rows_of(spark, folder, pattern, read_shown, "path string, stream_idx int, frame_idx long, pts long")


def video_of(packets: DataFrame) -> DataFrame:
    """The packets of each path's first video stream; a path without one fails the query."""
    first = F.min(F.when(F.col("kind") == "video", F.col("stream_idx"))).over(Window.partitionBy("path"))
    none = F.raise_error(F.concat("path", F.lit(": no video stream"))).cast("boolean")
    rows = packets.withColumn("first_idx", first)
    return rows.where(F.when(F.col("first_idx").isNull(), none).otherwise(F.col("stream_idx") == F.col("first_idx"))).drop("first_idx")


def _rows_of(spark: SparkSession, folder: str, pattern: str, reader: Callable, schema: str) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in schema.split(", ")]
        for files in batches:
            for path, data in zip(files["path"], files["content"], strict=True):
                yield pd.DataFrame(reader(bytes(data), path), columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return files.select("path", "content").mapInPandas(run, schema)
