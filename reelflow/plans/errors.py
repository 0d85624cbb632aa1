"""Errors that are raised while a plan is built or a sequence is read or written."""

from __future__ import annotations

from reelflow.functions import encoding


class ReelflowError(Exception):
    """Root of this package's errors."""


class DecodeError(ReelflowError):
    """A source could not be read; ``frames`` were read before."""

    def __init__(self, path: str, frames: int, cause: Exception | None = None):
        self.path, self.frames, self.cause = path, frames, cause
        super().__init__(f"{path}: decoding failed after {frames} frames" + (f": {cause}" if cause else ""))


class EncodeError(ReelflowError):
    """A sequence could not be written."""

    def __init__(self, path: str, frames: int, resolution: tuple[int, int] | None = None, codec: str | None = None, cause: Exception | None = None):
        self.path, self.frames, self.resolution, self.codec, self.cause = path, frames, resolution, codec, cause
        size = "" if resolution is None else " of {}x{}".format(*resolution)
        likely = f"; frames this small are too small for {codec}" if resolution and encoding.is_small(codec or "", *resolution) else ""
        super().__init__(f"{path}: {frames} frames{size} were written before encoding failed{likely}" + (f" ({cause})" if cause else ""))


class NoAudioError(ReelflowError):
    """An audio stream is wanted from a source that has none."""


class IndexBuildError(ReelflowError):
    """A sequence has no usable timestamp."""
