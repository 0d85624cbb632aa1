"""The public view on many frame sequences: indexing, slicing and resampling without reading a frame."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reelflow.functions import pixels
from reelflow.operators import access, index, resample
from reelflow.plans.frame_plan import FramePlan


class Frames:
    """``Frames(packets)[10:90:2].resized((64, 64)).repeat_each_frame(2).to_df()``: lazy, immutable, shares its index.

    ``packets``: video_id, pos, pts, dts (ticks). ``streams``: one row per video with fps_num, fps_den,
    width, height; it is needed for rates and sizes only. ``tb``: seconds per tick as a fraction.
    """

    def __init__(self, packets: DataFrame, streams: DataFrame | None = None, tb: Fraction = Fraction(1, 1_000_000), plan: FramePlan | None = None, frame_index: DataFrame | None = None):
        self.packets, self.streams, self.tb = packets, streams, Fraction(tb)
        self.plan = plan or FramePlan()
        self.index = frame_index if frame_index is not None else index.display_index(packets)

    def _with(self, plan: FramePlan) -> Frames:
        return Frames(self.packets, self.streams, self.tb, plan, self.index)

    def __getitem__(self, key):
        if isinstance(key, slice):
            return self._with(self.plan.sliced(key))
        if type(key) is not int:
            raise TypeError(f"a view is sliced or indexed by int, not {type(key).__name__}")
        return access.frame_at(self._sequence(), key, self.plan)

    def resized(self, shape: tuple[int, int]) -> Frames:
        return self._with(self.plan.resized(shape))

    def repeat_each_frame(self, n: int) -> Frames:
        return self._with(self.plan.repeat_each_frame(n))

    def at_constant_rate(self, fps=True) -> Frames:
        return self._with(self.plan.at_constant_rate(fps))

    def as_type(self, dtype: str) -> Frames:
        return self._with(self.plan.as_type(dtype))

    def on_device(self) -> Frames:
        """The view as a device decoder gives it: what that cannot do raises NotImplementedError."""
        return self._with(self.plan.on_device())

    def with_kept_index(self) -> Frames:
        """The view with its index kept by the executors, for it and all views made from it; ``index.unpersist()`` ends that."""
        return Frames(self.packets, self.streams, self.tb, self.plan, self.index.persist())

    def __repr__(self) -> str:
        return f"Frames({self.plan})"

    def _sequence(self) -> DataFrame:
        """(video_id, frame_idx, pts, src_idx): what slices apply to; frame_idx counts slots if resampled."""
        if not self.plan.constant_rate:
            return self.index.withColumn("src_idx", F.col("frame_idx"))
        rate = self.plan.target_fps
        if rate is not None:
            stamped = self.index.withColumn("fps_num", F.lit(rate.numerator).cast("long")).withColumn("fps_den", F.lit(rate.denominator).cast("long"))
        else:
            stamped = self.index.join(self.streams.select("video_id", "fps_num", "fps_den"), "video_id")
        slots = resample.cfr_map(resample.slot_numbers(stamped, self.tb))
        return resample.apply_map(slots, self.index).withColumnRenamed("out_idx", "frame_idx")

    def to_df(self) -> DataFrame:
        """(video_id, out_idx, rep, frame_idx, src_idx, pts) in display order within a video."""
        return access.repeat_each(access.slice_frames(self._sequence(), self.plan), self.plan.repeat)

    def over(self, decoded: DataFrame, bit_depth: int = 8) -> DataFrame:
        """``to_df`` with height, width and plane: the view's frames with their pixels, resized, converted, then repeated.

        ``decoded``: (video_id, frame_idx, height, width, plane) in display order, planes of 8 or 16 bits row by row.
        Frames that were not decoded have no row; a null plane stays null. Other columns are not looked at.
        """
        plan, wide = self.plan, pixels.internal_dtype(self.plan.dtype) == "uint16"
        own = decoded.select("video_id", F.col("frame_idx").alias("src_idx"), "height", "width", "plane")
        rows = access.slice_frames(self._sequence(), plan).join(own, ["video_id", "src_idx"])
        if wide != (bit_depth == 16):
            rows = rows.withColumn("plane", pixels.widen(F.col("plane")) if wide else pixels.narrow(F.col("plane")))
        if plan.shape:
            height, width = map(F.lit, plan.shape)
            rows = rows.withColumn("plane", pixels.resize(F.col("plane"), F.col("height"), F.col("width"), height, width))
            rows = rows.withColumn("height", height).withColumn("width", width)
        rows = rows.withColumn("plane", pixels.converted(F.col("plane"), plan.dtype))
        return access.repeat_each(rows, plan.repeat).select("video_id", "out_idx", "rep", "frame_idx", "src_idx", "pts", "height", "width", "plane")

    def descriptions(self) -> DataFrame:
        """(video_id, text): size, rate to four significant digits (from 0.0001 up to 9999) and length of the view."""
        scale = F.pow(F.lit(10.0), 3 - F.floor(F.log10("fps")))
        rate = F.regexp_replace((F.rint(F.col("fps") * scale) / scale).cast("string"), r"\.0$", "")
        kind = F.lit(f", {self.plan.dtype}" if self.plan.device else "")
        text = F.format_string("Frames(%dx%d, %s fps, %d frames%s)", "width", "height", rate, "n_frames", kind)
        return self.shapes().join(self.rates(), "video_id").join(self.lengths(), "video_id").select("video_id", text.alias("text"))

    def lengths(self) -> DataFrame:
        """(video_id, n_frames) of the view; no frame is listed unless it is resampled."""
        return access.view_lengths(self._sequence(), self.plan)

    def rates(self) -> DataFrame:
        """(video_id, fps) of the view."""
        if self.plan.target_fps is not None:
            own = self.streams.select("video_id", F.lit(float(self.plan.target_fps)).alias("fps"))
        else:
            own = self.streams.select("video_id", (F.col("fps_num") / F.col("fps_den")).alias("fps"))
        return own.select("video_id", (F.col("fps") / self.plan.step * self.plan.repeat).alias("fps"))

    def shapes(self) -> DataFrame:
        """(video_id, height, width) of the view's frames."""
        if self.plan.shape:
            return self.streams.select("video_id", F.lit(self.plan.shape[0]).alias("height"), F.lit(self.plan.shape[1]).alias("width"))
        return self.streams.select("video_id", "height", "width")
