from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from reelflow.functions import bits, encoding, pixels, rational


@given(st.binary(max_size=64))
def test_prevention_round_trip(data):
    safe = bits.insert_prevention(data)
    assert b"\x00\x00\x00" not in safe and b"\x00\x00\x01" not in safe
    assert bits.strip_prevention(safe) == data


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=10))
def test_exp_golomb_round_trip(values):
    text = "".join(map(bits.ue_text, values)) + "1"
    text += "0" * (-len(text) % 8)
    b = bits.Bits(int(text, 2).to_bytes(len(text) // 8, "big"))
    assert [b.ue() for _ in values] == values


def sps(width_mb=5, height_mb=4, profile=66, crop=None):
    ue = bits.ue_text
    text = f"{profile:08b}" + "0" * 8 + f"{30:08b}" + ue(0)
    if profile in bits.HIGH_PROFILES:
        text += ue(1) + ue(0) + ue(0) + "0" + "0"
    text += ue(0) + ue(2) + ue(3) + "0" + ue(width_mb - 1) + ue(height_mb - 1) + "1" + "1"
    text += "0" if crop is None else "1" + "".join(map(ue, crop))
    text += "0" + "1"
    text += "0" * (-len(text) % 8)
    return b"\x67" + bits.insert_prevention(int(text, 2).to_bytes(len(text) // 8, "big"))


@pytest.mark.parametrize("profile", [66, 100])
@pytest.mark.parametrize("crop", [None, (0, 1, 0, 2)])
def test_sps_cropping(profile, crop):
    nal = sps(profile=profile, crop=crop)
    info = bits.parse_sps(nal)
    assert (info["width"], info["height"], info["crop"]) == (80, 64, crop or (0, 0, 0, 0))
    cut = bits.parse_sps(bits.crop_sps(nal, 3, 5))
    assert (cut["width"], cut["height"], cut["crop"]) == (80, 64, (0, 3, 0, 5))
    stream = b"\x00\x00\x00\x01" + nal + b"\x00\x00\x01\x65abc"
    out = list(bits.split_nals(bits.crop_stream(stream, 3, 5)))
    assert [n[0] & 31 for _, n in out] == [7, 5] and out[1][1] == b"\x65abc"


def test_nal_table_function(spark):
    df = bits.NalUnits(F.lit(b"\x00\x00\x01\x67ab\x00\x00\x00\x01\x68c"))
    assert [(r["nal_type"], r["size"]) for r in df.orderBy("nal_idx").collect()] == [(7, 3), (8, 2)]


def test_matrices_absorb_the_offsets():
    for space in ("bt601", "bt709"):
        for mode, black, white, grey in (("limited16", 4096, 60160, 32768), ("full16", 0, 65535, 32768), ("full8", 0, 255, 128), ("full8to16", 0, 255, 128)):
            m = pixels.twist_matrix(space, mode)
            top = 255 if mode == "full8" else 65535
            for row in m:
                at = lambda y, row=row, grey=grey: row[0] * y + (row[1] + row[2]) * grey + row[3]
                assert abs(at(black)) < 1 and abs(at(white) - top) < 300


def test_half_floats(spark):
    df = spark.createDataFrame([([0, 1, 32768, 65504, 65535],), (None,)], "p array<int>")
    got = [r[0] for r in df.select(pixels.to_half("p")).collect()]
    assert got[1] is None
    top = np.float16(65504)
    assert got[0] == [float(np.float16(v) / top) for v in (0, 1, 32768, 65504, 65504)]


def test_nv12(spark):
    df = spark.createDataFrame([(list(range(0, 64, 8)), [128, 128, 200, 90])], "y array<int>, uv array<int>")
    rgb = df.select(pixels.nv12_to_rgb(F.col("y"), F.col("uv"), 4, 2).alias("p")).first()["p"]
    assert len(rgb) == 8 and (rgb[1]["r"], rgb[1]["g"], rgb[1]["b"]) == (8, 8, 8)
    assert rgb[2]["b"] > rgb[2]["r"]


def test_bilinear():
    x = np.arange(16, dtype=np.uint8).reshape(4, 4, 1)
    assert (pixels.bilinear(x, 4, 4) == x).all()
    assert pixels.bilinear(x, 2, 2)[..., 0].tolist() == [[2, 4], [10, 12]]
    assert pixels.bilinear(np.full((3, 5, 3), 7, np.uint16), 8, 2).tolist() == np.full((8, 2, 3), 7).tolist()


def test_presets_are_not_inverse(spark):
    df = spark.createDataFrame([("ultrafast",), ("p1",), ("odd",)], "p string")
    there = df.select(encoding.preset_for(F.col("p"), F.lit(True)).alias("p"))
    assert [r["p"] for r in there.collect()] == ["p1", "p1", "odd"]
    assert [r["p"] for r in there.select(encoding.preset_for(F.col("p"), F.lit(False)).alias("p")).collect()] == ["veryfast", "veryfast", "odd"]


def test_options_without_preset(spark):
    o = encoding.EncoderOptions().with_overrides(crf=20)
    c = o.columns()
    row = spark.range(1).select(encoding.options(F.lit(False), c["crf"], c["preset"], c["bframes"], c["gop"]).alias("o")).first()
    assert row["o"] == {"crf": "20", "bf": "2", "g": "250"}


def test_fractions_and_ticks(spark):
    df = spark.createDataFrame([(29.97,), (None,)], "f double").select(rational.fraction_udf()("f").alias("q"))
    assert [tuple(r["q"]) if r["q"] else None for r in df.collect()][0] == (2997, 100)
    assert spark.range(1).select(rational.rescale("90001L", "1L", "90000L", "1L", "1000L").alias("t")).first()["t"] == 1000


@pytest.mark.parametrize(("h", "w", "to_h", "to_w"), [(4, 4, 2, 2), (3, 5, 8, 2), (1, 1, 3, 3), (5, 4, 5, 4)])
def test_planes_are_resized_as_frames(spark, h, w, to_h, to_w):
    x = np.random.default_rng(h * w).integers(0, 65536, (h, w, 1)).astype(np.uint16)
    df = spark.createDataFrame([(x.ravel().tolist(), h, w)], "p array<int>, h int, w int")
    got = df.select(pixels.resize(F.col("p"), F.col("h"), F.col("w"), F.lit(to_h), F.lit(to_w)).alias("p")).first()["p"]
    assert got == pixels.bilinear(x, to_h, to_w).ravel().tolist()


def test_cropping_a_stream_as_a_column(spark):
    stream = b"\x00\x00\x01" + sps()
    df = spark.createDataFrame([(stream, 3, 5), (None, 1, 1)], "d binary, r int, b int").select(bits.crop_stream_udf("d", "r", "b").alias("d"))
    got = [r["d"] for r in df.collect()]
    assert bytes(got[0]) == bits.crop_stream(stream, 3, 5) and got[1] is None
