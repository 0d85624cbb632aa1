"""Interleaving audio and video packets, and checks on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.plans.errors import NoAudioError


def interleave(video: DataFrame, audio: DataFrame) -> DataFrame:
    """(video_id, kind, pos, time, mux_pos): before each video packet, the audio that is due by then.

    Both inputs: (video_id, pos, time). Within a stream the order is kept: a packet waits for those before it,
    so it goes by the running maximum of times; on ties audio goes first.
    """
    both = video.select("video_id", F.lit("video").alias("kind"), "pos", "time").unionByName(audio.select("video_id", F.lit("audio").alias("kind"), "pos", "time"))
    due = F.max("time").over(Window.partitionBy("video_id", "kind").orderBy("pos"))
    order = Window.partitionBy("video_id").orderBy("due", "kind", "pos")
    return both.withColumn("due", due).withColumn("mux_pos", (F.row_number().over(order) - 1).cast("long")).drop("due")


def mux(packets: DataFrame, strict: bool = True) -> DataFrame:
    """Interleaved copy of (video_id, kind, pos, pts, dts) packets; those without dts are dropped.

    ``strict``: NoAudioError if a video has no audio; else such videos are copied alone.
    """
    if strict:
        bare = without_audio(packets).first()
        if bare is not None:
            raise NoAudioError(f"video {bare['video_id']} has no audio stream")
    rows = packets.where("dts is not null").select("video_id", "kind", "pos", F.col("dts").alias("time"))
    return interleave(rows.where("kind = 'video'"), rows.where("kind = 'audio'"))


def with_audio(packets: DataFrame) -> DataFrame:
    """(video_id) of videos that have an audio stream."""
    return packets.select("video_id").distinct().join(packets.where("kind = 'audio'"), "video_id", "left_semi")


def without_audio(packets: DataFrame) -> DataFrame:
    return packets.select("video_id").distinct().join(packets.where("kind = 'audio'"), "video_id", "left_anti")


def select_audio(streams: DataFrame, number: int = 0) -> DataFrame:
    """The audio stream ``number`` of each video of (video_id, stream_idx, kind); an error where there is none such."""
    audio = streams.where("kind = 'audio'").withColumn("nth", F.row_number().over(Window.partitionBy("video_id").orderBy("stream_idx")) - 1)
    n = streams.groupBy("video_id").agg(F.count(F.when(F.col("kind") == "audio", 1)).alias("n"))
    bad = n.where(F.col("n") <= number).first()
    if bad is not None:
        if bad["n"] == 0:
            raise NoAudioError(f"video {bad['video_id']} has no audio stream")
        raise ValueError(f"video {bad['video_id']} has {bad['n']} audio streams, no number {number}")
    return audio.where(F.col("nth") == number).drop("nth")
