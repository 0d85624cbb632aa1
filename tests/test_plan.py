from __future__ import annotations

from fractions import Fraction

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelflow.operators import access, index
from reelflow.plans.errors import EncodeError
from reelflow.plans.frame_plan import FramePlan
from reelflow.plans.frames import Frames

bound = st.one_of(st.none(), st.integers(-60, 60))
slices = st.lists(st.builds(slice, bound, bound, st.one_of(st.none(), st.integers(1, 7))), max_size=4)


def chain(keys):
    plan = FramePlan()
    for k in keys:
        plan = plan.sliced(k)
    return plan


@given(slices, st.integers(0, 80))
def test_slices_are_those_of_a_list(keys, n):
    want = list(range(n))
    for k in keys:
        want = want[k]
    assert list(chain(keys).resolve(n)) == want


@settings(max_examples=12, deadline=None)
@given(slices)
def test_column_bounds_equal_the_list(spark, keys):
    lengths = [0, 1, 7, 30, 64]
    df = spark.createDataFrame([(n,) for n in lengths], "n long")
    first, count, step = chain(keys).bounds(df["n"])
    for n, a, c in df.select("n", first, count).collect():
        assert list(range(a, a + c * step, step)) == list(chain(keys).resolve(n))


@pytest.mark.parametrize(("n", "keys", "want"), [(50, [slice(10, 10)], 0), (50, [slice(40, 1000)], 10), (50, [slice(-10, None)], 10), (50, [slice(None, -10)], 40), (50, [slice(None, None, 100)], 1), (100, [slice(10, 90), slice(5, 40), slice(None, None, 2)], 18)])
def test_known_lengths(n, keys, want):
    assert chain(keys).count(n) == want


def test_repeat_multiplies():
    p = FramePlan().repeat_each_frame(2).repeat_each_frame(3)
    assert p.count(10) == 60
    assert [p.locate(i, 10) for i in (0, 5, 6, -1)] == [0, 0, 1, 9]


def test_what_a_plan_refuses():
    p = FramePlan()
    with pytest.raises(ValueError, match="zero"):
        p.sliced(slice(None, None, 0))
    with pytest.raises(ValueError):
        p.sliced(slice(None, None, -1))
    with pytest.raises(TypeError):
        p.sliced("x")
    with pytest.raises(TypeError):
        p.resized([4, 4])
    with pytest.raises(TypeError):
        p.resized((4.0, 4))
    with pytest.raises(ValueError):
        p.repeat_each_frame(0)
    with pytest.raises(NotImplementedError):
        p.repeat_each_frame(2).sliced(slice(1, 2))
    with pytest.raises(ValueError):
        FramePlan(dtype="int32")
    for i in (5, -6):
        with pytest.raises(IndexError):
            p.locate(i, 5)
    with pytest.raises(TypeError):
        p.locate(1.0, 5)


@pytest.mark.parametrize(("fps", "want"), [(29.97, (2997, 100)), (23.976, (2997, 125)), (30000 / 1001, (30000, 1001)), (29.123456789, (2359, 81)), (0.5, (1, 2))])
def test_rates_become_fractions(fps, want):
    f = FramePlan().at_constant_rate(fps).target_fps
    assert (f.numerator, f.denominator) == want


def test_description():
    assert FramePlan().sliced(slice(None, None, 2)).describe(64, 48, 10.0, 30) == "Frames(48x64, 5 fps, 15 frames)"


def test_encode_error_names_small_sizes():
    assert "too small" in str(EncodeError("x", 0, (100, 40), "h264_nvenc"))
    assert "too small" not in str(EncodeError("x", 0, (100, 40), "libx264"))


@pytest.fixture(scope="module")
def packets(spark):
    rows = [(v, i, None if i % 3 == 1 else i * 100, i * 100) for v, n in ((1, 30), (2, 5)) for i in range(n)]
    return spark.createDataFrame(rows, "video_id long, pos long, pts long, dts long")


def test_views_do_not_change_each_other(spark, packets):
    streams = spark.createDataFrame([(1, 10, 1, 64, 48), (2, 10, 1, 64, 48)], "video_id long, fps_num long, fps_den long, width int, height int")
    a = Frames(packets, streams)
    b = a[::2]
    assert b.index is a.index
    assert {r["video_id"]: r["n_frames"] for r in b.lengths().collect()} == {1: 15, 2: 3}
    assert {r["fps"] for r in b.rates().collect()} == {5.0}
    assert a.lengths().where("video_id = 1").first()["n_frames"] == 30
    assert {(r["height"], r["width"]) for r in b.resized((8, 6)).shapes().collect()} == {(8, 6)}


def test_single_frames(packets):
    a = Frames(packets)
    assert {(r["video_id"], r["pts"]) for r in a[-1].collect()} == {(1, 2900), (2, 400)}
    with pytest.raises(IndexError):
        a[7]
    with pytest.raises(TypeError):
        a["x"]


def test_resampled_view_follows_the_source_rate(spark, packets):
    streams = spark.createDataFrame([(1, 10, 1, 64, 48), (2, 10, 1, 64, 48)], "video_id long, fps_num long, fps_den long, width int, height int")
    view = Frames(packets, streams, tb=Fraction(1, 1000)).at_constant_rate()
    got = sorted((r["video_id"], r["out_idx"], r["src_idx"]) for r in view.to_df().collect())
    assert got == sorted((v, i, i) for v, n in ((1, 30), (2, 5)) for i in range(n))


def test_slices_without_negative_bounds_need_no_window(spark, packets):
    plan = lambda p: access.slice_frames(Frames(packets).index, p)._jdf.queryExecution().executedPlan().toString()
    assert plan(chain([slice(3, 9), slice(1, None, 2)])).count("Window ") < plan(chain([slice(-5, None)])).count("Window ") + 1


def test_many_slices_at_once_equal_each_alone(spark, packets):
    frames = index.display_index(packets)
    plans = {str(k): FramePlan().sliced(k) for k in (slice(1, 4, 2), slice(-2, None), slice(None, -1), slice(3, 3))} | {"all": FramePlan()}
    want = sorted((*r, name) for name, p in plans.items() for r in access.slice_frames(frames, p).collect())
    assert sorted(map(tuple, access.slice_all(frames, plans).collect())) == want


def test_many_frames_at_once_equal_each_alone(spark, packets):
    frames, plan = index.display_index(packets), FramePlan().sliced(slice(1, None)).repeat_each_frame(2)
    rows = access.frames_where(frames, {str(k): k for k in (0, 3, -1, 99, -99)}, plan).collect()
    lengths = {r["video_id"]: r["n_frames"] for r in access.view_lengths(frames, plan).collect()}
    asked = {(r["video_id"], int(r["ask"])): (r["frame_idx"], r["out_idx"]) for r in rows}
    want = {(v, k): ((k % n) // 2 + 1, (k % n) // 2) for v, n in lengths.items() for k in (0, 3, -1, 99, -99) if -n <= k < n}
    assert want and asked == want and len(rows) == len(want)


def test_device_views_refuse_what_a_device_lacks():
    p = FramePlan().on_device()
    for change in (lambda q: q.resized((4, 4)), lambda q: q.repeat_each_frame(2), lambda q: q.at_constant_rate(), lambda q: q.as_type("float32")):
        with pytest.raises(NotImplementedError):
            change(p)
        with pytest.raises(NotImplementedError):
            change(FramePlan()).on_device()
    assert p.sliced(slice(2, None)).as_type("uint16").describe(64, 48, 25.0, 10) == "Frames(48x64, 25 fps, 8 frames, uint16)"


@pytest.mark.parametrize(("dtype", "depth", "want"), [("uint8", 8, [0, 255]), ("uint8", 16, [0, 1]), ("uint16", 8, [0, 65535]), ("uint16", 16, [0, 255]), ("float64", 8, [0.0, 1.0]), ("float32", 16, [0.0, 255 / 65535])])
def test_types_of_pixels(spark, packets, dtype, depth, want):
    decoded = spark.createDataFrame([(1, i, 1, 2, [0, 255], "x") for i in range(30)] + [(2, 0, 1, 2, None, "x")], "video_id long, frame_idx long, height int, width int, plane array<int>, out_idx string")
    rows = Frames(packets).as_type(dtype).over(decoded, depth).orderBy("video_id", "out_idx").collect()
    assert len(rows) == 31 and rows[-1]["plane"] is None
    assert rows[0]["plane"] == pytest.approx(want, rel=1e-6)


def test_half_floats_and_sizes_through_a_view(spark, packets):
    decoded = spark.createDataFrame([(2, i, h, w, [7] * (h * w)) for i, (h, w) in enumerate([(2, 2), (1, 3), (4, 1)])], "video_id long, frame_idx long, height int, width int, plane array<int>")
    rows = Frames(packets).resized((2, 3)).repeat_each_frame(2).over(decoded).collect()
    assert len(rows) == 6 and all(r["plane"] == [7] * 6 and (r["height"], r["width"]) == (2, 3) for r in rows)
    half = Frames(packets).as_type("float16").over(decoded).where("frame_idx = 0").first()["plane"]
    assert half == pytest.approx([7 * 257 / 65504] * 4, rel=1e-3)


def test_a_kept_index_is_shared(packets):
    view = Frames(packets).with_kept_index()
    assert view[::2].resized((2, 2)).index is view.index and view.index.is_cached
    assert "step" in repr(view[::2]) or "slices" in repr(view[::2])
    view.index.unpersist()
