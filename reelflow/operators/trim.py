"""Cutting a time range out of a sequence and its audio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.operators.index import frame_at_time


def parse_time(text: Column) -> Column:
    """Seconds of ``HH:MM:SS(.f)``, ``MM:SS`` or ``SS``: parts are digits to base 60; ranges are not checked."""
    return F.aggregate(F.split(text, ":"), F.lit(0.0), lambda a, part: a * 60 + part.cast("double"))


def numbered(spans: DataFrame) -> DataFrame:
    """``spans`` with ``span``, its number within the video by start and stop, if it has none."""
    if "span" in spans.columns:
        return spans
    order = Window.partitionBy("video_id").orderBy("start", "stop")
    return spans.withColumn("span", F.row_number().over(order) - 1)


def trim_video(frames: DataFrame, spans: DataFrame, inclusive_end: bool = False) -> DataFrame:
    """(video_id, span, frame_idx, pts, out_idx, out_pts) of frames within (video_id, start, stop), in ticks.

    A video may have several spans, which may overlap; each is cut for itself. Start and stop become frames by
    ``frame_at_time``; the stop frame is left out, so a stop past the end drops the last frame unless
    ``inclusive_end`` is set for such. Times are rebased to the first frame of the span.
    """
    rows = numbered(spans)
    at = frame_at_time(frames, rows.select("video_id", F.explode(F.array("start", "stop")).alias("t")).distinct())
    for name in ("start", "stop"):
        rows = rows.join(at.select("video_id", F.col("t").alias(name), F.col("frame_idx").alias(f"{name}_idx")), ["video_id", name])
    end = F.col("stop_idx")
    if inclusive_end:
        last = frames.groupBy("video_id").agg(F.max("pts").alias("end_pts"))
        rows = rows.join(last, "video_id")
        end = end + F.when(F.col("stop") > F.col("end_pts"), 1).otherwise(0)
    first = frames.select("video_id", F.col("frame_idx").alias("start_idx"), F.col("pts").alias("base"))
    rows = rows.join(first, ["video_id", "start_idx"]).select("video_id", "span", "start_idx", end.alias("end_idx"), "base")
    kept = frames.join(rows, "video_id").where("frame_idx >= start_idx and frame_idx < end_idx")
    return kept.select("video_id", "span", "frame_idx", "pts", (F.col("frame_idx") - F.col("start_idx")).alias("out_idx"), (F.col("pts") - F.col("base")).alias("out_pts"))


def trim_audio(packets: DataFrame, spans: DataFrame) -> DataFrame:
    """(video_id, span, pos, pts, out_pts) of audio packets from start on, up to the first one at or after stop, rebased to start.

    Packets without dts are dropped. Order is that of the file. A video may have several spans.
    """
    rows = packets.where("dts is not null").join(numbered(spans).select("video_id", "span", "start", "stop"), "video_id").where("pts >= start")
    end = rows.where("pts >= stop").groupBy("video_id", "span").agg(F.min("pos").alias("end_pos"))
    kept = rows.join(end, ["video_id", "span"], "left").where("end_pos is null or pos < end_pos")
    return kept.select("video_id", "span", "pos", "pts", (F.col("pts") - F.col("start")).alias("out_pts"))


def even(size: Column) -> Column:
    """Sizes are scaled up to even ones when trimming."""
    return size + size % 2


def audio_status(codec: Column, container: Column, fits: dict[str, tuple[str, ...]]) -> Column:
    """``copied``, or ``skipped`` if the container cannot hold the codec, or ``none`` without audio."""
    ok = F.lit(False)
    for name, codecs in fits.items():
        ok = ok | ((container == name) & codec.isin(*codecs))
    return F.when(codec.isNull(), "none").when(ok, "copied").otherwise("skipped")
