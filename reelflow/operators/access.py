"""Views on indexed frames: slices, single frames, repetition, and how a reader would get at them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.plans.frame_plan import FramePlan

#: Beyond this step, seeking to each frame beats decoding those between. Fixed value.
SEEK_STEP = 30


def _with_length(frames: DataFrame) -> DataFrame:
    return frames.withColumn("__n", F.max("frame_idx").over(Window.partitionBy("video_id")) + 1)


def _measured(frames: DataFrame, *plans: FramePlan) -> tuple[DataFrame, Column]:
    """``frames`` and their sequence's length, which is taken only if a bound counts from the end."""
    if any(x is not None and x < 0 for plan in plans for s in plan.slices for x in s[:2]):
        return _with_length(frames), F.col("__n")
    return frames, F.lit((1 << 62) - 1)


def _hit(plan: FramePlan, length: Column) -> tuple[Column, Column]:
    """(whether the plan's slices keep a frame, its place among those kept)."""
    first, count, step = plan.bounds(length)
    at = F.col("frame_idx") - first
    kept = (at >= 0) & (at % step == 0) & (F.expr("true") if not plan.slices else at < count * step)
    return kept, F.floor(at / step).cast("long")


def slice_frames(frames: DataFrame, plan: FramePlan) -> DataFrame:
    """``frames`` (video_id, frame_idx, ...) of the plan's slices, with out_idx; one filter, however many slices.

    Bounds that count from the end need a sequence's length; without them there is no window.
    """
    rows, length = _measured(frames, plan)
    kept, out_idx = _hit(plan, length)
    return rows.where(kept).withColumn("out_idx", out_idx).drop("__n")


def slice_all(frames: DataFrame, plans: dict[str, FramePlan]) -> DataFrame:
    """``frames`` of each plan's slices, with out_idx and ask, the plan's name: one index, however many plans.

    A union of views would keep an index per view in one task, as all are partitioned by video.
    """
    rows, length = _measured(frames, *plans.values())
    hits = [F.when(kept, F.struct(out_idx.alias("out_idx"), F.lit(name).alias("ask"))) for name, (kept, out_idx) in ((n, _hit(p, length)) for n, p in plans.items())]
    each = rows.withColumn("__hit", F.explode(F.array(*hits))).where("__hit is not null")
    return each.select(*frames.columns, "__hit.*")


def view_lengths(frames: DataFrame, plan: FramePlan) -> DataFrame:
    """(video_id, n_frames) of the view, from the counts alone."""
    n = frames.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    return n.select("video_id", (plan.bounds(F.col("n"))[1] * plan.repeat).alias("n_frames"))


def frame_at(frames: DataFrame, index: int, plan: FramePlan | None = None) -> DataFrame:
    """The frame ``index`` of each video's view; IndexError if a video has no such frame.

    A negative index counts from the end. Repeated frames count as often as they are repeated.
    """
    plan = plan or FramePlan()
    lengths = view_lengths(frames, plan)
    short = lengths.where(~F.lit(index).between(-F.col("n_frames"), F.col("n_frames") - 1)).first()
    if short is not None:
        raise IndexError(f"frame {index} of {short['n_frames']} in video {short['video_id']}")
    return frame_where(frames, index, plan)


def frame_where(frames: DataFrame, index: int, plan: FramePlan | None = None) -> DataFrame:
    """As ``frame_at``, without a row for videos that have no such frame."""
    return frames_where(frames, {"": index}, plan).drop("ask")


def frames_where(frames: DataFrame, asks: dict[str, int], plan: FramePlan | None = None) -> DataFrame:
    """As ``frame_where`` for each of ``asks``, with ask, its name: one index and no join, however many."""
    plan = plan or FramePlan()
    first, count, step = plan.bounds(F.col("__n"))
    n = count * plan.repeat
    hits = []
    for name, index in asks.items():
        at = F.floor((n + index if index < 0 else F.lit(index)) / plan.repeat).cast("long")
        kept = F.lit(index).between(-n, n - 1) & (F.col("frame_idx") == first + at * step)
        hits.append(F.when(kept, F.struct(at.alias("out_idx"), F.lit(name).alias("ask"))))
    each = _with_length(frames).withColumn("__hit", F.explode(F.array(*hits))).where("__hit is not null")
    return each.select("video_id", "__hit.out_idx", *[c for c in frames.columns if c != "video_id"], "__hit.ask")


def repeat_each(frames: DataFrame, n: int) -> DataFrame:
    """Each frame ``n`` times in a row: rep counts within a frame, out_idx over all. Put this after work on pixels."""
    rows = frames if "out_idx" in frames.columns else frames.withColumn("out_idx", F.col("frame_idx"))
    if n == 1:
        return rows.withColumn("rep", F.lit(0))
    rows = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("out_idx", F.col("out_idx") * n + F.col("rep"))


def strategy(start: Column, step: Column) -> Column:
    """``seek`` per frame, ``range`` from one seek on, or ``scan`` from the start."""
    return F.when(step > SEEK_STEP, "seek").when(start > 0, "range").otherwise("scan")
