"""Pixel types, colour, chroma and size, as expressions on arrays; pandas only for half floats and general resizing.

A plane is an array of numbers, row by row. 8-bit values fit SMALLINT, 16-bit ones INT.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HALF_MAX = 65504.0

#: Coefficients of Cr in R, Cb and Cr in G, and Cb in B, for full range; luma factor 1. Fixed values of the standards.
FULL_RANGE = {"bt601": (1.402, -0.344136, -0.714136, 1.772), "bt709": (1.5748, -0.1873, -0.4681, 1.8556)}
#: The same for limited range; luma factor 1.164384. Fixed values of the standards.
LIMITED_RANGE = {"bt601": (1.596027, -0.391762, -0.812968, 2.017232), "bt709": (1.792741, -0.213249, -0.532909, 2.112402)}
LIMITED_LUMA = 1.164384
#: Y, Cb and Cr of 8-bit R, G and B in limited range, with their offsets. Fixed values.
FROM_RGB = ((0.257, 0.504, 0.098, 16.0), (-0.148, -0.291, 0.439, 128.0), (0.439, -0.368, -0.071, 128.0))


def twist_matrix(space: str, mode: str) -> list[list[float]]:
    """3 x 4 matrix from Y, Cb, Cr to R, G, B; the last column takes the offsets of the source range.

    ``mode``: limited16, full16, full8, or full8to16 (8-bit values in, 16-bit ones out: a factor of 257).
    """
    limited = mode == "limited16"
    rv, gu, gv, bu = (LIMITED_RANGE if limited else FULL_RANGE)[space]
    luma, gain = (LIMITED_LUMA, 1.0) if limited else (1.0, 257.0 if mode == "full8to16" else 1.0)
    y0, c0 = (4096.0 if limited else 0.0), (32768.0 if mode in ("limited16", "full16") else 128.0)
    rows = [(luma, 0.0, rv), (luma, gu, gv), (luma, bu, 0.0)]
    return [[gain * a, gain * b, gain * c, round(-gain * (a * y0 + (b + c) * c0), 6)] for a, b, c in rows]


def colour_twist(y: Column, cb: Column, cr: Column, space: str, mode: str) -> Column:
    """struct<r, g, b>: clamped to the range of the output and rounded half up."""
    top = 255 if mode == "full8" else 65535
    out = [F.floor(F.least(F.greatest(y * m[0] + cb * m[1] + cr * m[2] + m[3], F.lit(0.0)), F.lit(float(top))) + 0.5).cast("int") for m in twist_matrix(space, mode)]
    return F.struct(*[c.alias(n) for c, n in zip(out, "rgb", strict=True)])


def colour_space(asked: Column, tagged: Column, height: Column) -> Column:
    """What is asked for, else the stream's tag, else bt709 from 720 lines on."""
    return F.when(asked.isin("bt601", "bt709"), asked).when(tagged.isin("bt601", "bt709"), tagged).when(height >= 720, "bt709").otherwise("bt601")


def internal_dtype(dtype: str) -> str:
    """What frames are decoded to before conversion: floats are made from 16 bits."""
    return "uint8" if dtype == "uint8" else "uint16"


def to_float(plane: Column, top: int = 65535) -> Column:
    return F.transform(plane, lambda v: v / top)


def from_float(plane: Column) -> Column:
    """Floats to 16 bits: scaled, clipped and truncated."""
    return F.transform(plane, lambda v: F.least(F.greatest(v * 65535, F.lit(0.0)), F.lit(65535.0)).cast("int"))


def widen(plane: Column) -> Column:
    """8 bits to 16: times 257."""
    return F.transform(plane, lambda v: v * 257)


def narrow(plane: Column) -> Column:
    """16 bits to 8: over 257, rounded half up."""
    return F.transform(plane, lambda v: F.floor(v / 257 + 0.5).cast("int"))


def converted(plane: Column, dtype: str) -> Column:
    """A plane of the type ``internal_dtype(dtype)`` as ``dtype``: floats are shares of the greatest value."""
    if dtype == "float16":
        return to_half(plane)
    if dtype.startswith("float"):
        return to_float(plane).cast("array<float>" if dtype == "float32" else "array<double>")
    return plane.cast("array<int>")


@F.pandas_udf(T.ArrayType(T.FloatType()))
def to_half(planes: pd.Series) -> pd.Series:
    """16-bit values as half floats over the greatest half: clipped to 65504, rounded to half, divided in half."""
    top = np.float16(HALF_MAX)
    return planes.map(lambda p: None if p is None else (np.minimum(np.asarray(p, np.float64), HALF_MAX).astype(np.float16) / top).astype(np.float32))


def area_resize(plane: Column, width: int, height: int, fx: int, fy: int) -> Column:
    """Mean of each fx x fy block, rounded half up; sizes must be multiples."""
    if width % fx or height % fy:
        raise ValueError("area averaging needs whole blocks")
    cells = F.sequence(F.lit(0), F.lit((width // fx) * (height // fy) - 1))

    def mean(i: Column) -> Column:
        x, y = (i % (width // fx)) * fx, F.floor(i / (width // fx)).cast("int") * fy
        return sum(F.get(plane, (y + b) * width + x + a) for b in range(fy) for a in range(fx)) / (fx * fy)

    return F.transform(cells, mean)


def rounded(plane: Column) -> Column:
    return F.transform(plane, lambda v: F.floor(v + 0.5).cast("int"))


def chroma_subsample(plane: Column, width: int, height: int, to: str) -> Column:
    """A chroma plane of 444 as one of 422 (half width) or 420 (half width and height)."""
    return rounded(area_resize(plane, width, height, 2, 2 if to == "420" else 1))


def interleave(u: Column, v: Column) -> Column:
    """U0 V0 U1 V1 ..."""
    return F.flatten(F.zip_with(u, v, lambda a, b: F.array(a, b)))


def deinterleave(uv: Column) -> Column:
    """struct<u, v> of interleaved planes."""
    half = F.sequence(F.lit(0), F.floor(F.size(uv) / 2).cast("int") - 1)
    side = lambda k: F.when(F.size(uv) > 0, F.transform(half, lambda i: F.get(uv, 2 * i + k))).otherwise(uv)
    return F.struct(side(0).alias("u"), side(1).alias("v"))


def upsample_chroma(plane: Column, width: int, height: int) -> Column:
    """A chroma plane of 420, each value for its 2 x 2 pixels of a width x height frame."""
    cells = F.sequence(F.lit(0), F.lit(width * height - 1))
    return F.transform(cells, lambda i: F.get(plane, (F.floor(i / (2 * width)) * (width // 2) + F.floor((i % width) / 2)).cast("int")))


def nv12_to_rgb(y: Column, uv: Column, width: int, height: int, space: str = "bt601", mode: str = "full8") -> Column:
    """array<struct<r, g, b>> of a semi-planar 420 frame."""
    parts = deinterleave(uv)
    return rgb_of(y, *(upsample_chroma(parts[k], width, height) for k in "uv"), space, mode)


def rgb_of(y: Column, u: Column, v: Column, space: str, mode: str) -> Column:
    """array<struct<r, g, b>> of planes of the same size (444)."""
    return F.transform(F.arrays_zip(y.alias("y"), u.alias("u"), v.alias("v")), lambda p: colour_twist(p["y"], p["u"], p["v"], space, mode))


def yuv444_to_rgb16(y: Column, u: Column, v: Column, space: str = "bt709") -> Column:
    return rgb_of(y, u, v, space, "limited16")


def p016_to_rgb16(y: Column, uv: Column, width: int, height: int, space: str = "bt709") -> Column:
    return nv12_to_rgb(y, uv, width, height, space, "limited16")


def yuv420_to_nv12(y: Column, u: Column, v: Column) -> Column:
    """struct<y, uv> of three planes."""
    return F.struct(y.alias("y"), interleave(u, v).alias("uv"))


def nv12_to_p016(y: Column, uv: Column) -> Column:
    """struct<y, uv> with the same numbers as 16-bit values, not scaled."""
    return F.struct(y.cast("array<int>").alias("y"), uv.cast("array<int>").alias("uv"))


def rgb_to_nv12(r: Column, g: Column, b: Column, width: int, height: int) -> Column:
    """struct<y, uv> of 8-bit colour planes: limited range, chroma as the mean of 2 x 2 pixels, rounded half up."""
    rgb = F.arrays_zip(r.alias("r"), g.alias("g"), b.alias("b"))
    part = lambda m: lambda p: p["r"] * m[0] + p["g"] * m[1] + p["b"] * m[2] + m[3]
    luma, cb, cr = (F.transform(rgb, part(m)) for m in FROM_RGB)
    u, v = (rounded(area_resize(c, width, height, 2, 2)) for c in (cb, cr))
    return F.struct(rounded(luma).alias("y"), interleave(u, v).alias("uv"))


def output_mode(dtype: Column, chroma: Column, bit_depth: Column) -> Column:
    """struct<source, mode>: the native format of a stream and how it becomes the wanted type."""
    deep = bit_depth > 8
    source = F.when(chroma == "444", F.when(deep, "YUV444_16Bit").otherwise("YUV444")).otherwise(F.when(deep, "P016").otherwise("NV12"))
    mode = F.when(dtype != "uint16", "rgb").when(deep, "yuv_to_rgb16").otherwise("scale_8u_16u")
    return F.struct(source.alias("source"), mode.alias("mode"))


def _between(n: Column, to: Column) -> Column:
    """array<struct<lo, hi, w>> along an axis of ``n`` pixels resized to ``to``: neighbours and the share of the upper one."""
    centre = lambda i: F.greatest(F.lit(0.0), F.least((i + 0.5) * n / to - 0.5, n - 1.0))
    near = lambda t: F.struct(F.floor(t).cast("int").alias("lo"), F.least(F.floor(t) + 1, n - 1).cast("int").alias("hi"), (t - F.floor(t)).alias("w"))
    return F.transform(F.transform(F.sequence(F.lit(0), to - 1), centre), near)


def resize(plane: Column, height: Column, width: Column, to_height: Column, to_width: Column) -> Column:
    """An integer plane resized as ``bilinear`` does, rounded half to even."""

    def value(y: Column, x: Column) -> Column:
        row = lambda k: F.get(plane, y[k] * width + x["lo"]) * (1 - x["w"]) + F.get(plane, y[k] * width + x["hi"]) * x["w"]
        return F.rint(row("lo") * (1 - y["w"]) + row("hi") * y["w"]).cast("int")

    across = _between(width, to_width)
    return F.flatten(F.transform(_between(height, to_height), lambda y: F.transform(across, lambda x: value(y, x))))


def bilinear(frame: np.ndarray, height: int, width: int) -> np.ndarray:
    """A frame (h, w, c) resized with pixel centres aligned; integers are rounded."""
    h, w = frame.shape[:2]
    y = np.clip((np.arange(height) + 0.5) * h / height - 0.5, 0, h - 1)
    x = np.clip((np.arange(width) + 0.5) * w / width - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    f = frame.astype(np.float64)
    top, low = f[y0][:, x0] * (1 - fx) + f[y0][:, x1] * fx, f[y1][:, x0] * (1 - fx) + f[y1][:, x1] * fx
    out = top * (1 - fy) + low * fy
    return np.rint(out).astype(frame.dtype) if frame.dtype.kind in "ui" else out.astype(frame.dtype)
