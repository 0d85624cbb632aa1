"""Encoder options and the arithmetic of buffers, padding and quantisers, as columns."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Effort presets of the software encoders and the hardware's, both ways. Fixed values.
TO_HARDWARE = {"ultrafast": "p1", "superfast": "p1", "veryfast": "p2", "faster": "p3", "fast": "p3", "medium": "p4", "slow": "p5", "slower": "p6", "veryslow": "p7"}
TO_SOFTWARE = {"p1": "veryfast", "p2": "faster", "p3": "fast", "p4": "medium", "p5": "slow", "p6": "slower", "p7": "veryslow"}
#: Suffixes of raw streams and of containers. Fixed values.
RAW_SUFFIXES = ("264", "265", "avc", "h264", "h265", "hevc")
CONTAINER_SUFFIXES = ("avi", "mkv", "mov", "mp4", "webm")
#: Status codes of the hardware encoder's API, from 0 on. Fixed values.
ENCODER_STATUS = ("NV_ENC_SUCCESS", "NV_ENC_ERR_NO_ENCODE_DEVICE", "NV_ENC_ERR_UNSUPPORTED_DEVICE", "NV_ENC_ERR_INVALID_ENCODERDEVICE", "NV_ENC_ERR_INVALID_DEVICE", "NV_ENC_ERR_DEVICE_NOT_EXIST", "NV_ENC_ERR_INVALID_PTR", "NV_ENC_ERR_INVALID_EVENT", "NV_ENC_ERR_INVALID_PARAM", "NV_ENC_ERR_INVALID_CALL", "NV_ENC_ERR_OUT_OF_MEMORY", "NV_ENC_ERR_ENCODER_NOT_INITIALIZED", "NV_ENC_ERR_UNSUPPORTED_PARAM", "NV_ENC_ERR_LOCK_BUSY", "NV_ENC_ERR_NOT_ENOUGH_BUFFER", "NV_ENC_ERR_INVALID_VERSION", "NV_ENC_ERR_MAP_FAILED", "NV_ENC_ERR_NEED_MORE_INPUT", "NV_ENC_ERR_ENCODER_BUSY", "NV_ENC_ERR_EVENT_NOT_REGISTERED", "NV_ENC_ERR_GENERIC", "NV_ENC_ERR_INCOMPATIBLE_CLIENT_KEY", "NV_ENC_ERR_UNIMPLEMENTED", "NV_ENC_ERR_RESOURCE_REGISTER_FAILED", "NV_ENC_ERR_RESOURCE_NOT_REGISTERED", "NV_ENC_ERR_RESOURCE_NOT_MAPPED")
#: What the status text adds for some codes; part of output that must match. Fixed values.
STATUS_HINTS = {1: " (no NVIDIA GPU with NVENC support found)", 8: " (check resolution, frame rate, or encoding parameters)", 10: " (GPU memory exhausted)", 15: " (driver/SDK version mismatch)"}
#: Status codes of the hardware JPEG decoder, from 0 on. Fixed values.
JPEG_STATUS = ("Success", "Not initialized", "Invalid parameter", "Bad JPEG", "JPEG not supported", "Allocator failure", "Execution failed", "Architecture mismatch", "Internal error", "Implementation not supported", "Incomplete bitstream")
MAX_HARDWARE_SIZE = 4096
#: Sizes below which a failure of a hardware encoder is put down to the size, and what its names have. Fixed values.
SMALL_WIDTH, SMALL_HEIGHT, HARDWARE_MARK = 150, 50, "nvenc"


@dataclass(frozen=True)
class EncoderOptions:
    """Quality (crf), effort, reordering and keyframe interval of an encoder; codec is h264 or hevc."""

    crf: int = 15
    preset: str | None = None
    bframes: int = 2
    gop: int = 250
    codec: str = "h264"

    def with_overrides(self, **changes) -> EncoderOptions:
        return replace(self, **changes)

    def columns(self) -> dict[str, Column]:
        return {"crf": F.lit(self.crf), "preset": F.lit(self.preset).cast("string"), "bframes": F.lit(self.bframes), "gop": F.lit(self.gop), "codec": F.lit(self.codec)}


def _lookup(table: dict, key: Column) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), key)


def preset_for(preset: Column, gpu: Column) -> Column:
    """The preset's name for the target; names of the target and unknown names pass."""
    return F.when(gpu, F.coalesce(_lookup(TO_HARDWARE, preset), preset)).otherwise(F.coalesce(_lookup(TO_SOFTWARE, preset), preset))


def codec_name(codec: Column, gpu: Column) -> Column:
    hevc = codec == "hevc"
    return F.when(gpu, F.when(hevc, "hevc_nvenc").otherwise("h264_nvenc")).otherwise(F.when(hevc, "libx265").otherwise("libx264"))


def options(gpu: Column, crf: Column, preset: Column, bframes: Column, gop: Column) -> Column:
    """map<string,string> of encoder options: rate control first, then preset if any, bf and g."""
    text = lambda c: c.cast("string")
    entry = lambda k, v: F.struct(F.lit(k).alias("key"), v.alias("value"))
    rate = F.when(gpu, F.array(entry("rc", F.lit("vbr")), entry("cq", text(crf)))).otherwise(F.array(entry("crf", text(crf))))
    effort = F.when(preset.isNull(), F.array().cast("array<struct<key:string,value:string>>")).otherwise(F.array(entry("preset", preset_for(preset, gpu))))
    return F.map_from_entries(F.concat(rate, effort, F.array(entry("bf", text(bframes)), entry("g", text(gop)))))


def uses_gpu(gpu: Column, width: Column, height: Column) -> Column:
    """Frames beyond the hardware's limit are encoded in software."""
    return gpu & (width <= MAX_HARDWARE_SIZE) & (height <= MAX_HARDWARE_SIZE)


def too_small(codec: Column, width: Column, height: Column) -> Column:
    """Whether a failure is put down to the size."""
    return codec.contains(HARDWARE_MARK) & ((width < SMALL_WIDTH) | (height < SMALL_HEIGHT))


def is_small(codec: str, width: int, height: int) -> bool:
    """``too_small`` of plain values."""
    return HARDWARE_MARK in codec and not (width >= SMALL_WIDTH and height >= SMALL_HEIGHT)


def padded(size: Column) -> Column:
    return F.ceil(size / 16).cast("long") * 16


def pitch(width: Column) -> Column:
    return F.ceil(padded(width) / 256).cast("long") * 256


def crop_units(chroma: Column) -> tuple[Column, Column]:
    """Pixels per crop unit, horizontal and vertical, of 420, 422 or 444."""
    return F.when(chroma == "444", 1).otherwise(2), F.when(chroma == "420", 2).otherwise(1)


def crop(width: Column, height: Column, chroma: Column) -> Column:
    """struct<right, bottom, ok>: crop offsets in units; not ok (and null) if the padding is no multiple of a unit."""
    ux, uy = crop_units(chroma)
    dw, dh = padded(width) - width, padded(height) - height
    ok = (dw % ux == 0) & (dh % uy == 0)
    part = lambda d, u: F.when(ok, F.floor(d / u)).cast("long")
    return F.struct(part(dw, ux).alias("right"), part(dh, uy).alias("bottom"), ok.alias("ok"))


def buffer_bytes(width: Column, height: Column, chroma: Column) -> Column:
    """Bytes of a frame's planes at the encoder's pitch: 1.5, 2 or 3 times the luma plane."""
    luma = pitch(width) * padded(height)
    return F.when(chroma == "420", F.floor(luma * 3 / 2).cast("long")).when(chroma == "422", luma * 2).when(chroma == "444", luma * 3)


def quantisers(crf: Column) -> Column:
    """struct<i, p, b>: B frames get 1.25 crf + 1.75, truncated."""
    return F.struct(crf.cast("long").alias("i"), crf.cast("long").alias("p"), (crf * 1.25 + 1.75).cast("long").alias("b"))


def in_flight(bframes: Column, lookahead: Column) -> Column:
    """Buffers an encoder holds at most: the frame interval plus its lookahead."""
    return bframes + 1 + lookahead


def status_text(code: Column, context: Column | None = None) -> Column:
    """An encoder status as text, with a hint for common ones."""
    name = F.coalesce(_lookup(dict(enumerate(ENCODER_STATUS)), code.cast("int")), F.concat(F.lit("UNKNOWN_ERROR_"), code.cast("string")))
    text = F.concat(name, F.coalesce(_lookup(STATUS_HINTS, code.cast("int")), F.lit("")))
    return _in_context(text, context)


def jpeg_status_text(code: Column, context: Column | None = None) -> Column:
    """A JPEG decoder status as text."""
    text = F.coalesce(_lookup(dict(enumerate(JPEG_STATUS)), code.cast("int")), F.concat(F.lit("Unknown error "), code.cast("string")))
    return _in_context(text, context)


def _in_context(text: Column, context: Column | None) -> Column:
    if context is None:
        return text
    return F.when(F.coalesce(context, F.lit("")) == "", text).otherwise(F.concat(context, F.lit(": "), text))


def suffix(path: Column) -> Column:
    """The lower-cased file suffix without its dot, empty without one."""
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def container_of(path: Column) -> Column:
    """``raw``, the container's suffix, or ``unknown``."""
    s = suffix(path)
    return F.when(s.isin(*RAW_SUFFIXES), "raw").when(s.isin(*CONTAINER_SUFFIXES), s).otherwise("unknown")
