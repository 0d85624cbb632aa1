"""Facts about streams: rates, durations, counts, and whether and how they can be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reelflow.operators.index import display_index

#: Fixed values.
DEFAULT_FPS = 30.0
UNSEEKABLE_FORMATS = ("dirac", "cavsvideo", "rm")
GPU_UNSAFE_FORMATS = ("flv",)
GPU_CODECS = ("h264", "hevc", "mpeg1video", "mpeg2video", "mpeg4", "av1", "vp8", "vp9", "vc1", "mjpeg")


def fps(guessed: Column, average: Column) -> Column:
    return F.coalesce(guessed, average, F.lit(DEFAULT_FPS))


def fps_is_default(guessed: Column, average: Column) -> Column:
    return guessed.isNull() & average.isNull()


def duration(container_us: Column, stream_ticks: Column, tb_num: Column, tb_den: Column) -> Column:
    """Seconds: of the container, else of the stream, else 0."""
    return F.coalesce(container_us / 1e6, stream_ticks * tb_num / tb_den, F.lit(0.0))


def estimated_frames(seconds: Column, rate: Column) -> Column:
    """Rounded half to even."""
    return F.rint(seconds * rate).cast("long")


def frames_from_header(header: Column, seconds: Column, rate: Column) -> Column:
    """The header's count if it has one, else the product, truncated."""
    return F.when(header > 0, header).otherwise((seconds * rate).cast("long"))


def exact_frames(packets: DataFrame) -> DataFrame:
    """(video_id, n_frames): distinct presentation times from zero on."""
    return display_index(packets).groupBy("video_id").agg(F.count("*").alias("n_frames"))


def count_packets(packets: DataFrame) -> DataFrame:
    """(video_id, n_packets): packets that have a stamp."""
    return packets.where("coalesce(pts, dts) is not null").groupBy("video_id").agg(F.count("*").alias("n_packets"))


def decoded_frames(frames: DataFrame) -> DataFrame:
    """(video_id, n_frames): frames that decoding yields."""
    return frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))


def extents(width: Column, height: Column) -> Column:
    """[width, height]."""
    return F.array(width, height)


def seekable(fmt: Column, average_rate: Column, duration_ticks: Column, target: Column, landed: Column) -> Column:
    """Whether seeking works: not without a rate, not in some formats, not if a probe lands after its target."""
    odd = fmt.contains("image") | fmt.contains("_pipe") | fmt.isin(*UNSEEKABLE_FORMATS)
    probe = F.when(duration_ticks.isNull() | (duration_ticks <= 0), True).otherwise(F.coalesce(landed <= target, F.lit(False)))
    return F.when(average_rate.isNull() | odd, False).otherwise(probe)


def counts_agree(header: Column, packets: Column) -> Column:
    """Whether seeking is safe: header and packets differ by less than half; unknown counts do not matter."""
    ratio = header / packets
    return F.when((header > 0) & (packets > 0), (ratio <= 1.5) & (ratio >= 0.67)).otherwise(True)


def gpu_safe(fmt: Column, codec: Column) -> Column:
    unsafe = F.arrays_overlap(F.split(fmt, ","), F.array(*[F.lit(x) for x in GPU_UNSAFE_FORMATS]))
    return ~unsafe & codec.isin(*GPU_CODECS)
