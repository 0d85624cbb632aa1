"""The logical plan of a view on frame sequences: slices, repetition, size, type and rate as values.

A plan knows no data. ``resolve`` applies it to one length in Python; ``bounds`` gives the same as column
expressions of a length column, so that a chain of slices over many sequences is a single filter.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from fractions import Fraction

from pyspark.sql import Column
from pyspark.sql import functions as F

DTYPES = ("uint8", "uint16", "float16", "float32", "float64")


@dataclass(frozen=True)
class FramePlan:
    """An immutable view; every method returns a new one.

    ``slices``: (start, stop, step) as given, applied in order. ``shape``: (height, width) or None.
    """

    slices: tuple[tuple[int | None, int | None, int | None], ...] = ()
    repeat: int = 1
    shape: tuple[int, int] | None = None
    dtype: str = "uint8"
    constant_rate: bool = False
    target_fps: Fraction | None = None
    device: bool = False

    def __post_init__(self):
        if self.dtype not in DTYPES:
            raise ValueError(f"dtype must be one of {', '.join(DTYPES)}, not {self.dtype!r}")
        lacking = {"float types": self.dtype.startswith("float"), "resizing": self.shape, "repetition": self.repeat != 1, "constant rates": self.constant_rate}
        for what, asked in lacking.items():
            if self.device and asked:
                raise NotImplementedError(f"device views have no {what}")

    def sliced(self, key: slice) -> FramePlan:
        if not isinstance(key, slice):
            raise TypeError(f"a view is sliced or indexed by int, not {type(key).__name__}")
        if self.repeat != 1:
            raise NotImplementedError("slice before repeating frames")
        for x in (key.start, key.stop, key.step):
            if x is not None and type(x) is not int:
                raise TypeError("slice bounds must be int")
        if key.step == 0:
            raise ValueError("slice step cannot be zero")
        if key.step is not None and key.step < 0:
            raise ValueError("negative steps are not supported")
        return replace(self, slices=(*self.slices, (key.start, key.stop, key.step)))

    def resized(self, shape: tuple[int, int]) -> FramePlan:
        """``shape`` is (height, width); the last call wins."""
        if not isinstance(shape, tuple) or len(shape) != 2 or any(type(x) is not int for x in shape):
            raise TypeError("shape must be a tuple of two ints: (height, width)")
        return replace(self, shape=shape)

    def repeat_each_frame(self, n: int) -> FramePlan:
        if n < 1:
            raise ValueError("a frame is repeated once at least")
        return replace(self, repeat=self.repeat * n)

    def at_constant_rate(self, fps: bool | float | Fraction = True) -> FramePlan:
        """False: as recorded; True: the source's own rate; a number: that rate, as a fraction."""
        if fps is False:
            return replace(self, constant_rate=False, target_fps=None)
        rate = None if fps is True else Fraction(fps).limit_denominator(100_000)
        return replace(self, constant_rate=True, target_fps=rate)

    def as_type(self, dtype: str) -> FramePlan:
        return replace(self, dtype=dtype)

    def on_device(self) -> FramePlan:
        """A plan that only allows what a device decoder can do: slices, single frames and integer types."""
        return replace(self, device=True)

    def resolve(self, length: int) -> range:
        """Source ordinals of a sequence of ``length`` frames, before repetition."""
        out = range(length)
        for start, stop, step in self.slices:
            out = out[slice(start, stop, step)]
        return out

    def count(self, length: int) -> int:
        return len(self.resolve(length)) * self.repeat

    def locate(self, index: int, length: int) -> int:
        """Source ordinal of frame ``index`` of the view, which may count from the end."""
        if type(index) is not int:
            raise TypeError(f"an index must be int, not {type(index).__name__}")
        n = self.count(length)
        at = index + n if index < 0 else index
        if not 0 <= at < n:
            raise IndexError(f"frame {index} of {n}")
        return self.resolve(length)[at // self.repeat]

    @property
    def step(self) -> int:
        out = 1
        for _, _, step in self.slices:
            out *= step or 1
        return out

    def bounds(self, length: Column) -> tuple[Column, Column, int]:
        """(first ordinal, number of frames) as columns, and the step."""
        first, count, stride = F.lit(0).cast("long"), length.cast("long"), 1
        for start, stop, step in self.slices:
            step = step or 1
            a, b = _bound(start, count, F.lit(0).cast("long")), _bound(stop, count, count)
            first = first + a * stride
            count = F.greatest(F.lit(0).cast("long"), F.ceil((b - a) / F.lit(step)).cast("long"))
            stride *= step
        return first, count, stride

    def describe(self, height: int, width: int, fps: float, length: int) -> str:
        h, w = self.shape or (height, width)
        kind = f", {self.dtype}" if self.device else ""
        return f"Frames({w}x{h}, {fps / self.step * self.repeat:.4g} fps, {self.count(length)} frames{kind})"


def _bound(given: int | None, length: Column, default: Column) -> Column:
    """A slice bound as Python clamps it."""
    if given is None:
        return default
    at = F.lit(given).cast("long")
    return F.greatest(F.lit(0).cast("long"), length + at) if given < 0 else F.least(at, length)
