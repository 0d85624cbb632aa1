"""Directories of still images as frames, and facts from JPEG headers without decoding."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from reelflow.plans.errors import DecodeError

#: Sampling factors of luma over chroma and their names. Fixed values.
SUBSAMPLING = {(1, 1): "444", (2, 1): "422", (2, 2): "420", (1, 2): "440", (4, 1): "411"}


def image_frames(spark: SparkSession, folder: str) -> DataFrame:
    """(path, height, width, channels, data) by Spark's image source: BGR bytes, decoded in the JVM.

    A file that is no image fails the query, with the text of its DecodeError. Spark's readers skip empty files: those
    raise DecodeError at once, from the listing that Spark has made.
    """
    raw = spark.read.format("image").option("dropInvalid", False).load(folder)
    files = raw._jdf.queryExecution().analyzed().collectLeaves().head().relation().location().allFiles().iterator()
    while files.hasNext():
        if (file := files.next()).getLen() == 0:
            raise DecodeError(file.getPath().toString(), 0, ValueError("empty file"))
    i = F.col("image")
    said = str(DecodeError("", 0, ValueError("not an image")))
    broken = F.raise_error(F.concat(F.lit("DecodeError: "), i["origin"], F.lit(said)))
    rows = raw.where(F.when(i["height"] > 0, True).otherwise(broken.cast("boolean")))
    return rows.select(i["origin"].alias("path"), i["height"].alias("height"), i["width"].alias("width"), i["nChannels"].alias("channels"), i["data"].alias("data"))


def image_sequences(frames: DataFrame) -> DataFrame:
    """Images as sequences: the folder is seq_id, the order of names frame_idx."""
    rows = frames.withColumn("seq_id", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))
    return rows.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("seq_id").orderBy("path")) - 1).cast("long"))


def jpeg_info(data: bytes) -> tuple[int, int, int, str] | None:
    """(width, height, components, subsampling) of a JPEG's frame header; None if it has none."""
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data) and data[at] == 0xFF:
        marker = data[at + 1]
        if marker == 0xFF:
            at += 1
            continue
        size = struct.unpack_from(">H", data, at + 2)[0]
        if 0xC0 <= marker <= 0xCF and marker not in (0xC4, 0xC8, 0xCC):
            if at + 10 > len(data):
                return None
            height, width, n = struct.unpack_from(">HHB", data, at + 5)
            factors = [data[at + 11 + 3 * i] for i in range(n) if at + 11 + 3 * i < len(data)]
            if len(factors) < 3:
                return width, height, n, "gray"
            ratio = (factors[0] >> 4) // max(1, factors[1] >> 4), (factors[0] & 15) // max(1, factors[1] & 15)
            return width, height, n, SUBSAMPLING.get(ratio, "unknown")
        at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField(n, T.IntegerType()) for n in ("width", "height", "components")] + [T.StructField("subsampling", T.StringType())]))
def jpeg_info_udf(data: pd.Series) -> pd.DataFrame:
    rows = [jpeg_info(bytes(x)) if x is not None else None for x in data]
    return pd.DataFrame([r or (None, None, None, None) for r in rows], columns=["width", "height", "components", "subsampling"])
