"""Bit strings of H.264 headers: Exp-Golomb codes, emulation prevention, NAL units, and the cropping of an SPS.

Written from the public standard (ITU-T H.264, 7.3.2.1.1 and 9.1).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

#: Profiles whose SPS has chroma and scaling fields. Fixed values of the standard.
HIGH_PROFILES = (100, 110, 122, 244, 44, 83, 86, 118, 128, 138, 139, 134, 135)
_START_CODE = re.compile(rb"\x00\x00\x01")


def ue_encode(value: Column) -> Column:
    """Unsigned Exp-Golomb code as a string of 0 and 1."""
    code = F.bin(value + 1)
    return F.concat(F.repeat(F.lit("0"), F.length(code) - 1), code)


def se_encode(value: Column) -> Column:
    """Signed Exp-Golomb code: 1, -1, 2, -2 ... follow 0."""
    return ue_encode(F.when(value > 0, 2 * value - 1).otherwise(-2 * value))


def ue_decode(code: Column) -> Column:
    """The value of an unsigned code that starts the string; what follows is ignored."""
    zeros = F.instr(code, "1") - 1
    return F.conv(code.substr(zeros + 1, zeros + 1), 2, 10).cast("long") - 1


def se_decode(code: Column) -> Column:
    """The value of a signed code that starts the string."""
    v = ue_decode(code)
    return F.when(v % 2 == 1, F.floor((v + 1) / 2)).otherwise(-F.floor(v / 2)).cast("long")


class Bits:
    """A cursor over a string of bits held as an integer."""

    def __init__(self, data: bytes):
        self.size, self.value, self.at = 8 * len(data), int.from_bytes(data, "big"), 0

    def take(self, n: int) -> int:
        if self.at + n > self.size:
            raise ValueError("the bits end early")
        self.at += n
        return self.value >> (self.size - self.at) & ((1 << n) - 1)

    def ue(self) -> int:
        zeros = 0
        while not self.take(1):
            zeros += 1
        return (1 << zeros) - 1 + self.take(zeros)

    def se(self) -> int:
        v = self.ue()
        return (v + 1) // 2 if v % 2 else -(v // 2)


def ue_text(value: int) -> str:
    code = f"{value + 1:b}"
    return "0" * (len(code) - 1) + code


def strip_prevention(data: bytes) -> bytes:
    """00 00 03 becomes 00 00."""
    return re.sub(rb"\x00\x00\x03", b"\x00\x00", data)


def insert_prevention(data: bytes) -> bytes:
    """03 goes between 00 00 and a byte of at most 03."""
    return re.sub(rb"\x00\x00(?=[\x00-\x03])", b"\x00\x00\x03", data)


def split_nals(stream: bytes) -> Iterator[tuple[int, bytes]]:
    """(offset, NAL unit) of an Annex B stream, without start codes and trailing zeros."""
    marks = [m.start() for m in _START_CODE.finditer(stream)]
    for a, b in zip(marks, [*marks[1:], len(stream)], strict=True):
        nal = stream[a + 3 : b].rstrip(b"\x00")
        if nal:
            yield a + 3, nal


def _skip_scaling(bits: Bits, size: int) -> None:
    last = following = 8
    for _ in range(size):
        if following:
            following = (last + bits.se()) % 256
        last = following or last


def parse_sps(nal: bytes) -> dict:
    """Profile, chroma_idc, width and height in pixels before cropping, crop (left, right, top, bottom) and where its flag is."""
    bits = Bits(strip_prevention(nal[1:]))
    out = {"profile": bits.take(8), "chroma_idc": 1}
    bits.take(16)
    bits.ue()
    if out["profile"] in HIGH_PROFILES:
        out["chroma_idc"] = bits.ue()
        if out["chroma_idc"] == 3:
            bits.take(1)
        bits.ue(), bits.ue(), bits.take(1)
        if bits.take(1):
            for i in range(12 if out["chroma_idc"] == 3 else 8):
                if bits.take(1):
                    _skip_scaling(bits, 16 if i < 6 else 64)
    bits.ue()
    order = bits.ue()
    if order == 0:
        bits.ue()
    elif order == 1:
        bits.take(1), bits.se(), bits.se()
        for _ in range(bits.ue()):
            bits.se()
    bits.ue(), bits.take(1)
    out["width"], rows = 16 * (bits.ue() + 1), bits.ue() + 1
    frames_only = bits.take(1)
    out["height"] = 16 * rows * (2 - frames_only)
    if not frames_only:
        bits.take(1)
    bits.take(1)
    out["flag_at"] = bits.at
    out["crop"] = tuple(bits.ue() for _ in range(4)) if bits.take(1) else (0, 0, 0, 0)
    out["rest_at"] = bits.at
    return out


def crop_sps(nal: bytes, right: int, bottom: int) -> bytes:
    """The SPS with its cropping set to (0, right, 0, bottom) crop units."""
    info = parse_sps(nal)
    data = strip_prevention(nal[1:])
    text = f"{int.from_bytes(data, 'big'):0{8 * len(data)}b}"
    rest = text[info["rest_at"] :].rstrip("0")[:-1]  # without the stop bit
    text = text[: info["flag_at"]] + "1" + "".join(map(ue_text, (0, right, 0, bottom))) + rest + "1"
    text += "0" * (-len(text) % 8)
    return nal[:1] + insert_prevention(int(text, 2).to_bytes(len(text) // 8, "big"))


def crop_stream(stream: bytes, right: int, bottom: int) -> bytes:
    """An Annex B stream in which every SPS is cropped so; four-byte start codes."""
    return b"".join(b"\x00\x00\x00\x01" + (crop_sps(n, right, bottom) if n[0] & 31 == 7 else n) for _, n in split_nals(stream))


@F.pandas_udf(T.BinaryType())
def strip_prevention_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else strip_prevention(bytes(x)))


@F.pandas_udf(T.BinaryType())
def insert_prevention_udf(data: pd.Series) -> pd.Series:
    return data.map(lambda x: None if x is None else insert_prevention(bytes(x)))


@F.pandas_udf(T.BinaryType())
def crop_stream_udf(data: pd.Series, right: pd.Series, bottom: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else crop_stream(bytes(x), int(r), int(b)) for x, r, b in zip(data, right, bottom, strict=True)], dtype=object)


@udtf(returnType=T.StructType([T.StructField(n, T.IntegerType()) for n in ("nal_idx", "nal_offset", "nal_type", "size")] + [T.StructField("data", T.BinaryType())]))
class NalUnits:
    """Table function: the NAL units of a stream."""

    def eval(self, stream: bytes):
        for i, (at, nal) in enumerate(split_nals(bytes(stream or b""))):
            yield i, at, nal[0] & 31, len(nal), nal
