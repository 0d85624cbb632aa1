from __future__ import annotations

import bisect
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as fn

from reelflow.operators import gop, index, metadata, mux, resample, sessions, trim
from reelflow.plans.errors import IndexBuildError, NoAudioError


def packets(spark, stamps, video=1):
    return spark.createDataFrame([(video, i, p, d) for i, (p, d) in enumerate(stamps)], "video_id long, pos long, pts long, dts long")


def test_index_drops_missing_negative_and_repeated_times(spark):
    p = packets(spark, [(5, 0), (None, 7), (None, None), (-3, 1), (5, 9), (0, 0)])
    assert [(r["frame_idx"], r["pts"]) for r in index.display_index(p).orderBy("pts").collect()] == [(0, 0), (1, 5), (2, 7)]
    assert metadata.count_packets(p).first()["n_packets"] == 5


def test_safe_seek_falls_back_to_the_first_packet(spark):
    p = packets(spark, [(x, x) for x in (3, 1, 2, 6, 4, 5)])
    assert [r["safe_pts"] for r in index.safe_seek(p).orderBy("frame_idx").collect()] == [0, 0, 2, 2, 2, 5]


def test_safe_seek_equals_bisection(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for v in range(30):
        order = np.argsort(np.arange(40) + rng.normal(0, 2.5, 40))
        pts = [int(x) * 10 + v % 3 for x in order]
        rows += [(v, i, t, t) for i, t in enumerate(pts)]
        run = list(np.maximum.accumulate(pts))
        for t in sorted(set(pts)):
            k = bisect.bisect_right(run, t) - 1
            want[v, t] = pts[k] if k >= 0 else min(pts[0], 0)
    df = spark.createDataFrame(rows, "video_id long, pos long, pts long, dts long")
    assert {(r["video_id"], r["pts"]): r["safe_pts"] for r in index.safe_seek(df).collect()} == want


def test_empty_index(spark):
    videos = spark.createDataFrame([(1,), (2,)], "video_id long")
    f = index.display_index(packets(spark, [(1, 1)]))
    with pytest.raises(IndexBuildError):
        index.checked(f, videos)
    assert {r["video_id"]: r["status"] for r in index.index_status(f, videos).collect()} == {1: "ok", 2: "no index"}


def clock(n, fps):
    return [Fraction(i, fps) for i in range(n)]


def slots(times, fps):
    return [round(Fraction(t) * fps) for t in times]


F = Fraction
GOLDEN = [
    (clock(60, 30), 60, 119, 119, [0, 1, 1, 2, 2, 3, 3, 4, 4]),
    (clock(60, 30), 15, 33, 33, [0, 1, 2, 3, 4, 6, 7, 10, 11, 14, 15]),
    (clock(30, 30), 15, 17, 17, [0, 1, 2, 3, 4, 6, 7, 10, 11, 14]),
    (clock(30, 30), 60, 59, 59, [0, 1, 1, 2, 2, 3, 3]),
    (clock(30, 30), 30, 30, 30, list(range(30))),
    (clock(12, 24), 10, 8, 8, [0, 1, 2, 3, 4, 7, 9, 11]),
    ([F(x, 10) for x in (0, 1, 2, 7, 8, 20)], 10, 24, 24, [0, 1, 2, 2, 2, 2, 3, 3] + [4] * 11 + [5] * 5),
    ([F(x, 10) for x in (0, 5, 10, 15)], 10, 19, 19, [0] * 4 + [1] * 5 + [2] * 5 + [3] * 5),
    ([F(x, 10) for x in (5, 6, 7, 8)], 10, 5, 9, [0, 0, 1, 2, 3]),
]


def test_resampling_golden_values(spark):
    rows = [(v, i, int(t * 360_000), fps, 1) for v, (times, fps, *_) in enumerate(GOLDEN) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "video_id long, frame_idx long, pts long, fps_num long, fps_den long")
    s = resample.slot_numbers(df, Fraction(1, 360_000))
    counts = {r["video_id"]: r["n_slots"] for r in resample.cfr_count(s).collect()}
    for native in (2048, 0):
        got = {}
        for r in resample.cfr_map(s, native).orderBy("video_id", "out_idx").collect():
            got.setdefault(r["video_id"], []).append(r["src_idx"])
        for v, (_, _, length, count, head) in enumerate(GOLDEN):
            assert (len(got[v]), counts[v]) == (length, count)
            assert got[v][: len(head)] == head


def test_slots_round_half_to_even(spark):
    df = spark.createDataFrame([(1, i, p, 1, 2) for i, p in enumerate((1, 3, 5, 7, 8))], "video_id long, frame_idx long, pts long, fps_num long, fps_den long")
    assert [r["x"] for r in resample.slot_numbers(df, Fraction(1)).orderBy("frame_idx").collect()] == [0, 2, 2, 4, 4]


@given(st.lists(st.integers(0, 40), max_size=30))
def test_fold_never_shows_frames_out_of_order(xs):
    runs = resample.fold_slots(sorted(xs))
    assert [i for i, _ in runs] == sorted(i for i, _ in runs)
    assert all(k > 0 for _, k in runs)


@given(st.lists(st.integers(0, 20), max_size=12), st.lists(st.integers(0, 20), max_size=12))
def test_running_maxima_give_the_head_of_line_order(video, audio):
    queue, want = list(enumerate(audio)), []
    for i, t in enumerate(video):
        while queue and queue[0][1] <= t:
            want.append(("audio", queue.pop(0)[0]))
        want.append(("video", i))
    want += [("audio", i) for i, _ in queue]
    run = lambda xs: np.maximum.accumulate(xs) if xs else []
    keyed = [(m, 0, i, "audio") for i, m in enumerate(run(audio))] + [(m, 1, i, "video") for i, m in enumerate(run(video))]
    assert [(k, i) for _, _, i, k in sorted(keyed)] == want


def test_interleave(spark):
    rows = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 5)], "video_id long, pos long, time long")
    audio = spark.createDataFrame([(1, 0, 0), (1, 1, 10), (1, 2, 30)], "video_id long, pos long, time long")
    got = [(r["kind"][0], r["pos"]) for r in mux.interleave(rows, audio).orderBy("mux_pos").collect()]
    assert got == [("a", 0), ("v", 0), ("a", 1), ("v", 1), ("v", 2), ("a", 2)]


def test_audio_is_required(spark):
    p = spark.createDataFrame([(1, "video", 0, 0, 0), (2, "video", 0, 0, 0), (2, "audio", 0, 0, 0)], "video_id long, kind string, pos long, pts long, dts long")
    with pytest.raises(NoAudioError):
        mux.mux(p)
    assert mux.mux(p, strict=False).count() == 3
    s = spark.createDataFrame([(1, 0, "video"), (1, 1, "audio")], "video_id long, stream_idx int, kind string")
    assert mux.select_audio(s).first()["stream_idx"] == 1
    with pytest.raises(ValueError):
        mux.select_audio(s, 1)


def test_reordering(spark):
    f = spark.createDataFrame([(1, i) for i in range(7)], "video_id long, frame_idx long")
    rows = gop.reorder(f).orderBy("out_idx").collect()
    assert [r["frame_idx"] for r in rows] == [0, 3, 1, 2, 6, 4, 5]
    assert [r["dts"] for r in rows] == list(range(-2, 5))
    assert [r["frame_idx"] for r in gop.reorder(f, 0).orderBy("out_idx").collect()] == list(range(7))


def test_spans_of_a_video_are_cut_each_for_itself(spark):
    f = spark.createDataFrame([(1, i, i * 10) for i in range(9)], "video_id long, frame_idx long, pts long")
    spans = spark.createDataFrame([(1, 10, 40), (1, 30, 60), (1, 30, 60)], "video_id long, start long, stop long")
    got = sorted((r["span"], r["frame_idx"], r["out_idx"], r["out_pts"]) for r in trim.trim_video(f, spans).collect())
    assert got == [(0, 1, 0, 0), (0, 2, 1, 10), (0, 3, 2, 20), *[(s, 3 + k, k, 10 * k) for s in (1, 2) for k in range(3)]]
    audio = f.select("video_id", fn.col("frame_idx").alias("pos"), "pts", fn.col("pts").alias("dts"))
    got = sorted((r["span"], r["pos"], r["out_pts"]) for r in trim.trim_audio(audio, spans).collect())
    assert got == [(0, 1, 0), (0, 2, 10), (0, 3, 20), *[(s, 3 + k, 10 * k) for s in (1, 2) for k in range(3)]]


def test_audio_that_does_not_fit_is_skipped(spark):
    rows = spark.createDataFrame([("aac", "mp4"), ("opus", "avi"), (None, "mp4")], "codec string, container string")
    got = rows.select(trim.audio_status(fn.col("codec"), fn.col("container"), {"mp4": ("aac", "opus"), "avi": ("mp3",)}).alias("s")).collect()
    assert [r["s"] for r in got] == ["copied", "skipped", "none"]


def test_trim_past_the_end_drops_the_last_frame_unless_told(spark):
    f = spark.createDataFrame([(1, i, i * 10) for i in range(5)], "video_id long, frame_idx long, pts long")
    span = spark.createDataFrame([(1, 11, 99)], "video_id long, start long, stop long")
    assert [(r["frame_idx"], r["out_pts"]) for r in trim.trim_video(f, span).orderBy("frame_idx").collect()] == [(2, 0), (3, 10)]
    assert trim.trim_video(f, span, inclusive_end=True).count() == 3


def test_sessions(spark):
    kinds = ["append", "start", "append", "append", "end", "append", "start", "start", "append", "quit"]
    log = spark.createDataFrame([(1, i, k) for i, k in enumerate(kinds)], "writer_id long, seq long, kind string")
    got = {r["session"]: (r["n_frames"], r["ended"], r["n_invalid"]) for r in sessions.summary(log).collect()}
    assert got == {1: (2, True, 1), 2: (0, False, 0), 3: (1, True, 0)}
    assert {r["seq"] for r in sessions.protocol_errors(log).collect()} == {0, 5}
