"""Variable to constant frame rate: which source frame each slot of a steady clock shows.

A frame is due at slot x, its time in slots rounded half to even. With n slots filled so far and
d = x - n: up to 2 slots late it fills one slot, more than that it is dropped; one slot early it fills two;
earlier still, the previous frame fills d - 1 slots and it fills two. Before the first frame there is no
previous one: its copies are counted but not shown. At the end the last frame is repeated as often as the
median of the previous frame's last three counts.

All arithmetic is on integers (ticks and rates as fractions).
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames of a video up to which the fold is a higher-order function; it copies its result at each step.
NATIVE_FRAMES = 2048


def slot_numbers(frames: DataFrame, tb: Fraction = Fraction(1, 1_000_000)) -> DataFrame:
    """(video_id, frame_idx, x): the slot at which each frame of (video_id, frame_idx, pts, fps_num, fps_den) is due."""
    a, b = f"(cast(pts as decimal(38,0)) * fps_num * {tb.numerator})", f"(cast(fps_den as decimal(20,0)) * {tb.denominator})"
    rows = frames.select("video_id", "frame_idx", F.expr(f"{a} div {b}").alias("q"), F.expr(f"2 * ({a} % {b})").alias("r"), F.expr(b).alias("b"))
    x = F.col("q") + F.when((F.col("r") > F.col("b")) | ((F.col("r") == F.col("b")) & (F.col("q") % 2 == 1)), 1).otherwise(0)
    return rows.select("video_id", "frame_idx", x.cast("long").alias("x"))


def _step(n: Column, x: Column) -> tuple[Column, Column]:
    """(copies of the previous frame, copies of this one) at slot number x after n slots."""
    d = x - n
    previous = F.when(d >= 2, d - 1).otherwise(F.lit(0).cast("long"))
    own = F.when(d <= -3, F.lit(0)).when(d <= 0, F.lit(1)).otherwise(F.lit(2)).cast("long")
    return previous, own


def _median(a: Column, b: Column, c: Column) -> Column:
    return F.greatest(F.least(a, b), F.least(F.greatest(a, b), c))


def _ordered(slots: DataFrame) -> DataFrame:
    return slots.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "x"))).alias("frames"))


def cfr_count(slots: DataFrame) -> DataFrame:
    """(video_id, n_slots): the slots of a video, counting those that a late first frame leaves without a picture."""
    start = F.expr("named_struct('n', 0L, 'p', 0L, 'q', 0L, 'r', 0L)")

    def fold(s: Column, f: Column) -> Column:
        previous, own = _step(s["n"], f["x"])
        return F.struct((s["n"] + previous + own).alias("n"), s["q"].alias("p"), s["r"].alias("q"), previous.alias("r"))

    total = F.aggregate("frames", start, fold, lambda s: s["n"] + _median(s["p"], s["q"], s["r"]))
    return _ordered(slots).select("video_id", total.alias("n_slots"))


def cfr_map(slots: DataFrame, native_frames: int = NATIVE_FRAMES) -> DataFrame:
    """(video_id, out_idx, src_idx): the source frame of every slot.

    Videos of up to ``native_frames`` frames are folded by a higher-order function, longer ones in pandas,
    a video at a time. A video is one sequence: its fold is not divided.
    """
    ordered = _ordered(slots)
    start = F.expr("named_struct('n', 0L, 'p', 0L, 'q', 0L, 'r', 0L, 'last', -1L, 'out', cast(array() as array<struct<src:bigint,k:bigint>>))")

    def fold(s: Column, f: Column) -> Column:
        previous, own = _step(s["n"], f["x"])
        runs = F.array(F.struct(s["last"].alias("src"), previous.alias("k")), F.struct(f["frame_idx"].alias("src"), own.alias("k")))
        shown = F.filter(runs, lambda r: (r["k"] > 0) & (r["src"] >= 0))
        return F.struct((s["n"] + previous + own).alias("n"), s["q"].alias("p"), s["r"].alias("q"), previous.alias("r"), f["frame_idx"].alias("last"), F.concat(s["out"], shown).alias("out"))

    def finish(s: Column) -> Column:
        return F.concat(s["out"], F.array(F.struct(s["last"].alias("src"), _median(s["p"], s["q"], s["r"]).alias("k"))))

    runs = ordered.where(F.size("frames") <= native_frames).select("video_id", F.aggregate("frames", start, fold, finish).alias("runs"))
    shown = F.flatten(F.transform("runs", lambda r: F.when(r["k"] > 0, F.array_repeat(r["src"], r["k"].cast("int"))).otherwise(F.expr("cast(array() as array<bigint>)"))))
    short = runs.select("video_id", F.posexplode(shown).alias("out_idx", "src_idx")).select("video_id", F.col("out_idx").cast("long").alias("out_idx"), "src_idx")
    return short.unionByName(_long(ordered.where(F.size("frames") > native_frames)))


def fold_slots(xs: list[int]) -> list[tuple[int, int]]:
    """(source, copies) in order for one video's slot numbers: the rule above in plain Python."""
    n, recent, out = 0, [0, 0, 0], []
    for i, x in enumerate(xs):
        d = x - n
        previous = d - 1 if d >= 2 else 0
        own = 0 if d <= -3 else 1 if d <= 0 else 2
        if previous and i:
            out.append((i - 1, previous))
        if own:
            out.append((i, own))
        n += previous + own
        recent = [*recent[1:], previous]
    if xs and (extra := sorted(recent)[1]):
        out.append((len(xs) - 1, extra))
    return out


def _long(ordered: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for video, frames in zip(pdf["video_id"], pdf["frames"], strict=True):
                ids = [f["frame_idx"] for f in frames]
                src = [ids[i] for i, k in fold_slots([f["x"] for f in frames]) for _ in range(k)]
                yield pd.DataFrame({"video_id": video, "out_idx": range(len(src)), "src_idx": src})

    return ordered.mapInPandas(run, "video_id long, out_idx long, src_idx long")


def apply_map(slots: DataFrame, frames: DataFrame) -> DataFrame:
    """The frames (video_id, frame_idx, ...) in the slots (video_id, out_idx, src_idx)."""
    return slots.join(frames.withColumnRenamed("frame_idx", "src_idx"), ["video_id", "src_idx"])


def slot_lookup(slots: DataFrame, wanted: DataFrame) -> DataFrame:
    """(video_id, out_idx, src_idx) of wanted slots (video_id, out_idx); beyond the end, the last frame shown."""
    last = slots.groupBy("video_id").agg(F.max_by("src_idx", "out_idx").alias("end"))
    rows = wanted.join(slots, ["video_id", "out_idx"], "left").join(last, "video_id")
    return rows.select("video_id", "out_idx", F.coalesce("src_idx", "end").alias("src_idx"))
