"""Groups of pictures, decode order, and the stamps of encoded packets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

GOP, BFRAMES = 250, 2


def gop_structure(frames: DataFrame, gop: int = GOP) -> DataFrame:
    """``frames`` with gop_id, gop_pos and is_keyframe."""
    at = F.col("frame_idx")
    return frames.withColumn("gop_id", F.floor(at / gop).cast("long")).withColumn("gop_pos", (at % gop).cast("long")).withColumn("is_keyframe", at % gop == 0)


def decode_key(display: Column, bframes: int = BFRAMES) -> Column:
    """Sort key of decode order: of each group of bframes + 1 frames the last is decoded first (I0 P3 B1 B2 P6 ...)."""
    period = bframes + 1
    return F.when((display == 0) | (bframes == 0), display).when(display % period == 0, display - bframes).otherwise(display + 1)


def reorder(frames: DataFrame, bframes: int = BFRAMES) -> DataFrame:
    """(video_id, frame_idx, out_idx, pts, dts): output order, display ordinal and output ordinal less the delay.

    Ranking anew closes the gaps that an incomplete last group leaves.
    """
    order = Window.partitionBy("video_id").orderBy("key", "frame_idx")
    rows = frames.select("video_id", "frame_idx", decode_key(F.col("frame_idx"), bframes).alias("key"))
    rows = rows.withColumn("out_idx", (F.row_number().over(order) - 1).cast("long"))
    return rows.select("video_id", "frame_idx", "out_idx", F.col("frame_idx").alias("pts"), (F.col("out_idx") - bframes).alias("dts"))
