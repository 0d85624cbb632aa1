"""Indexes over packets: display order, safe seek points and lookups by time.

``packets``: (video_id, pos, pts, dts), pos being the order in the file. Everything is partitioned by
video_id: windows over one video, never over all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.plans.errors import IndexBuildError




def stamp() -> Column:
    """A packet's presentation time: pts, else dts."""
    return F.coalesce("pts", "dts")


def display_index(packets: DataFrame) -> DataFrame:
    """(video_id, frame_idx, pts): distinct presentation times from zero on, in order.

    Repeated times are found by the sort that the rank needs: no hash table of times in the task.
    """
    order = Window.partitionBy("video_id").orderBy("pts")
    rows = packets.select("video_id", stamp().alias("pts")).where("pts >= 0")
    rows = rows.select("video_id", (F.dense_rank().over(order) - 1).cast("long").alias("frame_idx"), "pts", F.lag("pts").over(order).alias("before"))
    return rows.where("before is null or before <> pts").drop("before")


def running_max(packets: DataFrame) -> DataFrame:
    """(video_id, pos, pts, run_max): the greatest time up to each packet in file order, -1 before any."""
    usable = packets.select("video_id", "pos", stamp().alias("pts")).where("pts >= 0")
    return usable.withColumn("run_max", F.greatest(F.lit(-1).cast("long"), F.max("pts").over(Window.partitionBy("video_id").orderBy("pos"))))


def safe_seek(packets: DataFrame, targets: DataFrame | None = None) -> DataFrame:
    """(video_id, frame_idx, pts, safe_pts): where to start reading so that the frame at ``pts`` is not missed.

    It is the last packet in file order whose running maximum does not exceed the target; without one,
    the first packet's time, but no later than 0. A backward as-of join by union: one sort per video.
    """
    targets = display_index(packets) if targets is None else targets
    keys = running_max(packets)
    first = keys.groupBy("video_id").agg(F.least(F.min_by("pts", "pos"), F.lit(0)).alias("fallback"))
    marks = keys.select("video_id", F.col("run_max").alias("k"), F.lit(0).alias("side"), "pos", F.col("pts").alias("seek"), F.lit(None).cast("long").alias("frame_idx"))
    asks = targets.select("video_id", F.col("pts").alias("k"), F.lit(1).alias("side"), F.lit(None).cast("long").alias("pos"), F.lit(None).cast("long").alias("seek"), "frame_idx")
    upto = Window.partitionBy("video_id").orderBy("k", "side", "pos").rowsBetween(Window.unboundedPreceding, 0)
    both = marks.unionByName(asks).withColumn("safe", F.last("seek", ignorenulls=True).over(upto)).where("side = 1")
    return both.join(first, "video_id", "left").select("video_id", "frame_idx", F.col("k").alias("pts"), F.coalesce("safe", "fallback").alias("safe_pts"))


def sequential_index(packets: DataFrame) -> DataFrame:
    """The index of a video that cannot be sought in: every safe point is 0."""
    return display_index(packets).withColumn("safe_pts", F.lit(0).cast("long"))


def synthetic_index(counts: DataFrame, ticks_per_second: int) -> DataFrame:
    """(video_id, frame_idx, pts) from (video_id, n_frames, fps_num, fps_den) where there are no timestamps: i / fps."""
    rows = counts.where("n_frames > 0").withColumn("frame_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_frames") - 1)))
    return rows.select("video_id", "frame_idx", F.expr(f"frame_idx * fps_den * {ticks_per_second}L div fps_num").alias("pts"))


def seek_params(sought: DataFrame) -> DataFrame:
    """(video_id, frame_idx, safe_pts, skip): where to seek and how far to read on, in ticks."""
    return sought.select("video_id", "frame_idx", "safe_pts", (F.col("pts") - F.col("safe_pts")).alias("skip"))


def seek_start(sought: DataFrame, streams: DataFrame) -> DataFrame:
    """(video_id, frame_idx, start, status) by (video_id, seekable): the safe point, or 0, from where one reads on.

    A video that cannot be sought in is opened anew, which reaches time 0 only.
    """
    rows = sought.join(streams.select("video_id", "seekable"), "video_id")
    return rows.select("video_id", "frame_idx", F.when(F.col("seekable"), F.col("safe_pts")).otherwise(F.lit(0)).cast("long").alias("start"), F.when(F.col("seekable"), "seek").otherwise("reopen").alias("status"))


def decode_cost(sought: DataFrame) -> DataFrame:
    """(video_id, frame_idx, cost): frames to read from the safe point to the target, the target included."""
    start = sought.select("video_id", F.col("frame_idx").alias("start_idx"), F.col("pts").alias("safe_pts"))
    joined = sought.join(start, ["video_id", "safe_pts"], "left")
    return joined.select("video_id", "frame_idx", (F.col("frame_idx") - F.coalesce("start_idx", F.lit(0)) + 1).alias("cost"))


def frame_at_time(frames: DataFrame, times: DataFrame) -> DataFrame:
    """(video_id, t, frame_idx): the first frame at or after each time, else the last frame. A forward as-of join."""
    marks = frames.select("video_id", F.col("pts").alias("k"), F.lit(1).alias("side"), "frame_idx", F.lit(None).cast("long").alias("t"))
    asks = times.select("video_id", F.col("t").alias("k"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("frame_idx"), "t")
    on = Window.partitionBy("video_id")
    order = on.orderBy("k", "side", "frame_idx").rowsBetween(0, Window.unboundedFollowing)
    found = marks.unionByName(asks).withColumn("hit", F.first("frame_idx", ignorenulls=True).over(order)).withColumn("last", F.max("frame_idx").over(on))
    return found.where("side = 0 and last is not null").select("video_id", "t", F.coalesce("hit", "last").alias("frame_idx"))


def match_pts(decoded: DataFrame, targets: DataFrame, tolerance: int = 0) -> DataFrame:
    """(video_id, frame_idx, pts): for each target (video_id, frame_idx, target), the first decoded frame (video_id, pts) from it on."""
    t = targets.select("video_id", F.col("frame_idx").alias("want"), (F.col("target") - tolerance).alias("t"))
    ordered = display_index(decoded.select("video_id", F.lit(0).alias("pos"), "pts", F.lit(None).cast("long").alias("dts")))
    last = ordered.groupBy("video_id").agg(F.max("pts").alias("end"))
    hit = frame_at_time(ordered, t.select("video_id", "t").distinct())
    rows = t.join(hit, ["video_id", "t"]).join(ordered, ["video_id", "frame_idx"]).join(last, "video_id").where("t <= end")
    return rows.select("video_id", F.col("want").alias("frame_idx"), "pts")


def checked(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """``frames``, if every one of ``videos`` has some; else IndexBuildError naming one that has none."""
    bare = videos.select("video_id").join(frames, "video_id", "left_anti").first()
    if bare is not None:
        raise IndexBuildError(f"video {bare['video_id']} has no usable timestamp")
    return frames


def index_status(frames: DataFrame, videos: DataFrame) -> DataFrame:
    """(video_id, n_frames, status): ``ok`` or ``no index``, for bulk runs that must not stop."""
    n = frames.groupBy("video_id").agg(F.count("*").alias("n_frames"))
    out = videos.select("video_id").join(n, "video_id", "left").select("video_id", F.coalesce("n_frames", F.lit(0)).alias("n_frames"))
    return out.withColumn("status", F.when(F.col("n_frames") > 0, "ok").otherwise("no index"))
