from __future__ import annotations

import base64
import struct

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from reelflow.operators import index
from reelflow.plans.errors import DecodeError, EncodeError
from reelflow.sources import images, packets, y4m
from reelflow.streaming import live
from reelflow.streaming.writer import LOG_SCHEMA, LogWriter

PNG = base64.b64decode("iVBORw0KGgoAAAANSUhEUgAAAAEAAAABCAYAAAAfFcSJAAAADUlEQVR42mP8z8BQDwAEhQGAhKmMIQAAAABJRU5ErkJggg==")


def box(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), kind) + body


def table(kind, *rows):
    return box(kind, struct.pack(">II", 0, len(rows)), *rows)


def track(kind, scale, steps, shifts, keys, sizes, size=(0, 0), edits=()):
    entry = struct.pack(">I4s", 86, b"avc1" if kind == b"vide" else b"mp4a") + b"\0" * 24 + struct.pack(">HH", *size) + b"\0" * 50
    stbl = box(b"stbl", table(b"stsd", entry), table(b"stts", *(struct.pack(">II", n, d) for n, d in steps)), *([table(b"ctts", *(struct.pack(">Ii", n, d) for n, d in shifts))] if shifts else []), *([table(b"stss", *(struct.pack(">I", k) for k in keys))] if keys else []), box(b"stsz", struct.pack(">III", 0, 0, len(sizes)), *(struct.pack(">I", s) for s in sizes)))
    mdhd = box(b"mdhd", struct.pack(">IIIII", 0, 0, 0, scale, 0), b"\0" * 4)
    hdlr = box(b"hdlr", b"\0" * 8, kind, b"\0" * 12)
    edts = [box(b"edts", table(b"elst", *(struct.pack(">IiI", d, t, 1 << 16) for d, t in edits)))] if edits else []
    return box(b"trak", *edts, box(b"mdia", mdhd, hdlr, box(b"minf", stbl)))


MP4 = box(b"ftyp", b"isom") + box(b"moov", track(b"vide", 30, [(5, 1)], [(1, 1), (1, 3), (1, 0), (1, 0), (1, 1)], [1], [9, 8, 7, 6, 5], (64, 48)), track(b"soun", 48000, [(2, 1024)], [], [], [4, 4]))


def test_packets_of_a_movie(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(MP4)
    (tmp_path / "b.mp4").write_bytes(MP4)
    df = packets.packets_of(spark, str(tmp_path))
    video = df.where("kind = 'video' and path like '%a.mp4'").orderBy("pos").collect()
    assert [(r["pts"], r["dts"]) for r in video] == [(1, 0), (4, 1), (2, 2), (3, 3), (5, 4)]
    assert [r["is_keyframe"] for r in video] == [True, False, False, False, False]
    assert (video[0]["width"], video[0]["height"], video[0]["codec"], video[0]["size_bytes"]) == (64, 48, "avc1", 9)
    assert df.where("kind = 'audio'").agg(F.count("*"), F.min(F.col("is_keyframe"))).first()[:] == (4, True)
    spark.dataSource.register(packets.PacketSource)
    again = spark.read.format("reel_packets").option("paths", f"{tmp_path}/a.mp4\n{tmp_path}/b.mp4").load()
    assert again.rdd.getNumPartitions() == 2 and again.count() == df.count()
    own = index.display_index(again.where("kind = 'video'").withColumn("video_id", F.xxhash64("path")))
    assert own.count() == 10


@pytest.mark.parametrize("data", [b"", b"text, not a movie", MP4[:40]])
def test_broken_movies(data):
    with pytest.raises(DecodeError):
        list(packets.read_packets(data, "x"))


def frames(spark, seqs):
    rows = [(s, i, h, w, bytes([i]) * (3 * w * h)) for s, n, h, w in seqs for i in range(n)]
    return spark.createDataFrame(rows, "seq_id long, frame_idx long, height int, width int, data binary")


def test_sequences_round_trip(spark, tmp_path):
    out = y4m.encode_sequences(frames(spark, [(1, 5, 4, 6), (2, 2, 5, 6)]), str(tmp_path), (30000, 1001)).orderBy("seq_id").collect()
    assert [(r["n_frames"], r["error"]) for r in out] == [(5, ""), (2, "odd size")]
    assert [p.name for p in tmp_path.iterdir()] == ["1.y4m"]
    back = y4m.frames_of(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [bytes(r["data"])[0] for r in back] == [0, 1, 2, 3, 4]
    assert (back[0]["fps_num"], back[0]["fps_den"], back[0]["height"], back[0]["width"]) == (30000, 1001, 4, 6)
    assert y4m.frames_of(spark, str(tmp_path), max_frames=2).count() == 2
    inline = y4m.encode_sequences(frames(spark, [(1, 2, 4, 6)])).first()
    assert inline["path"] is None and len(list(y4m.read_frames(bytes(inline["data"])))) == 2


def test_a_frame_cut_off_ends_the_file():
    data = y4m.encode([b"a" * 12, b"b" * 12], 2, 2, 30, 1)
    assert len(list(y4m.read_frames(data[:-1]))) == 1
    with pytest.raises(DecodeError):
        list(y4m.read_frames(b"nothing\n"))


def test_publish_leaves_nothing_behind(tmp_path):
    y4m.publish(str(tmp_path / "x"), b"1")
    assert [p.name for p in tmp_path.iterdir()] == ["x"]
    with pytest.raises(EncodeError):
        y4m.publish(str(tmp_path / "no" / "x"), b"1")


def test_images(spark, tmp_path):
    for name in ("s1/b.png", "s1/a.png", "s2/c.png"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(PNG)
    df = images.image_sequences(images.image_frames(spark, str(tmp_path / "*")))
    assert sorted((r["seq_id"], r["frame_idx"], r["height"]) for r in df.collect()) == [("s1", 0, 1), ("s1", 1, 1), ("s2", 0, 1)]


@pytest.mark.parametrize("data", [b"", b"text, not an image", PNG[:40]])
def test_broken_images_do_not_vanish(spark, tmp_path, data):
    (tmp_path / "s1").mkdir()
    for name, held in (("a", PNG), ("b", data), ("c", PNG)):
        (tmp_path / "s1" / f"{name}.png").write_bytes(held)
    for run in ("collect", "count"):
        with pytest.raises(Exception, match="s1/b.png: decoding failed"):
            getattr(images.image_sequences(images.image_frames(spark, str(tmp_path / "*"))).select("frame_idx"), run)()


def test_jpeg_headers(spark):
    sof = b"\xff\xc0" + struct.pack(">HBHHB", 17, 8, 48, 64, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1])
    data = b"\xff\xd8\xff\xe0\x00\x04ab" + sof
    assert images.jpeg_info(data) == (64, 48, 3, "420")
    assert images.jpeg_info(b"GIF") is None and images.jpeg_info(data[:12]) is None
    df = spark.createDataFrame([(data,), (None,)], "d binary").select(images.jpeg_info_udf("d").alias("i")).select("i.*")
    assert [r["subsampling"] for r in df.collect()] == ["420", None]


def test_streams_give_what_batches_give(spark, tmp_path):
    rows = [(v, p, None if p % 6 == 4 else (p * 7) % 20, (p * 7) % 20) for v in (1, 2) for p in range(20)]
    for k in range(2):
        part = [r for r in rows if r[1] // 10 == k]
        spark.createDataFrame(part, "video_id long, pos long, pts long, dts long").toPandas().astype({"pts": "Int64"}).to_parquet(tmp_path / f"{k}.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    got: list = []
    q = live.write_batches(live.running_max(live.file_stream(spark, str(tmp_path), schema, 1)), lambda df, _: got.extend(map(tuple, df.collect())), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    whole = spark.read.parquet(str(tmp_path / "*.parquet"))
    assert sorted(got) == sorted(map(tuple, index.running_max(whole).select("video_id", "pos", "pts", "run_max").collect()))


def test_writer_stream(spark, tmp_path):
    kinds = ["start", "append", "append", "end", "append", "start", "append", "start", "quit"]
    for k in range(3):
        pd.DataFrame([(1, i, x) for i, x in enumerate(kinds) if i // 3 == k], columns=["writer_id", "seq", "kind"]).to_parquet(tmp_path / f"{k}.parquet")
    schema = spark.read.parquet(str(tmp_path)).schema
    got: list = []
    q = live.write_batches(live.writer_sessions(live.file_stream(spark, str(tmp_path), schema, 1)), lambda df, _: got.extend(tuple(r)[1:] for r in df.collect()), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert sorted(got) == [(1, 0, "error"), (1, 2, "ended"), (2, 1, "replaced"), (3, 0, "quit")]


def movie(edits):
    video = track(b"vide", 30, [(5, 10)], [(1, 10), (1, 30), (1, 0), (1, 0), (1, 10)], [1], [1] * 5, (64, 48), edits)
    return box(b"ftyp", b"isom") + box(b"moov", box(b"mvhd", struct.pack(">IIII", 0, 0, 0, 60)), track(b"soun", 48000, [(2, 1024)], [], [], [4, 4]), video)


@pytest.mark.parametrize(("edits", "want"), [
    ((), [10, 20, 30, 40, 50]),
    (((0, 10),), [0, 10, 20, 30, 40]),
    (((80, 20),), [0, 10, 20, 30]),
    (((60, -1), (0, 10)), [30, 40, 50, 60, 70]),
    (((20, 10), (40, 40)), [0, 10, 20]),
])
def test_edit_lists(spark, tmp_path, edits, want):
    (tmp_path / "a.mp4").write_bytes(movie(edits))
    rows = packets.shown_of(spark, str(tmp_path)).orderBy("frame_idx").collect()
    assert [r["pts"] for r in rows] == want and {r["stream_idx"] for r in rows} == {1}


def test_first_video_stream(spark, tmp_path):
    (tmp_path / "a.mp4").write_bytes(movie(()))
    assert {r["stream_idx"] for r in packets.video_of(packets.packets_of(spark, str(tmp_path))).collect()} == {1}
    (tmp_path / "a.mp4").write_bytes(box(b"moov", track(b"soun", 48000, [(2, 1024)], [], [], [4, 4])))
    with pytest.raises(Exception, match="no video stream"):
        packets.video_of(packets.packets_of(spark, str(tmp_path))).collect()


def test_only_the_movie_header_is_read(tmp_path):
    path = tmp_path / "a.mp4"
    for media in (box(b"mdat", b"x" * 100_000), struct.pack(">I4sQ", 1, b"mdat", 116) + b"x" * 100):
        path.write_bytes(box(b"ftyp", b"isom") + media + MP4)
        with path.open("rb") as f:
            assert list(packets.read_packets(packets.movie_header(f))) == list(packets.read_packets(MP4))
    path.write_bytes(MP4[:40])
    with path.open("rb") as f:
        assert packets.movie_header(f) == b""


def test_a_writer_and_its_files(spark, tmp_path):
    log, out = str(tmp_path / "log"), tmp_path / "out"
    out.mkdir()
    with LogWriter(spark, log, 7, most=3) as w:
        with pytest.raises(ValueError):
            w.append_data(np.zeros((3, 4, 6), np.uint8))
        with pytest.raises(ValueError):
            w.end_sequence()
        with pytest.raises(ValueError):
            w.start_sequence("x", 0)
        w.start_sequence("a", 29.97)
        for i in range(5):
            w.append_data(np.full((3, 4, 6), i, np.uint8))
        assert w.accepts_new_frames
        w.start_sequence("b", 25)
        w.append_data(np.zeros((3, 4, 6), np.uint16))
        w.end_sequence()
        assert not w.accepts_new_frames
        w.start_sequence("empty", 25)
        w.start_sequence("c", 25)
        w.append_data(np.zeros((3, 5, 6), np.uint8))
    done = y4m.encode_sessions(spark.read.parquet(log), str(out))
    rows = [(r["session"], r["n_frames"], r["error"]) for r in done.orderBy("session").collect()]
    assert rows == [(1, 5, ""), (2, 1, "cannot write uint16"), (4, 1, "odd size")]
    assert [p.name for p in out.iterdir()] == ["7_1.y4m"]
    back = y4m.frames_of(spark, str(out)).orderBy("frame_idx").collect()
    assert [bytes(r["data"])[0] for r in back] == [0, 1, 2, 3, 4] and (back[0]["fps_num"], back[0]["fps_den"]) == (2997, 100)
    with pytest.raises(EncodeError, match="7_"):
        y4m.raise_failed(done)
    y4m.raise_failed(done.where("session = 1"))


def test_sessions_are_encoded_in_one_pass_over_batches(spark):
    key, rows, want = "spark.sql.execution.arrow.maxRecordsPerBatch", [], {}
    for w in range(3):
        kinds = ["append", "start", *["append"] * 7, "end", "append", "start", "append", "start", *["append"] * 4, "quit"]
        session = 0
        for seq, kind in enumerate(kinds):
            session += kind == "start"
            rows.append((w, seq, kind, 25, 1, 2, 2, "uint8", bytes([w, seq, 0, 0])))
            if kind == "append" and seq not in (0, 10):
                want.setdefault((w, session), []).append(bytes([w, seq, 0, 0]))
    log = spark.createDataFrame(rows[::-1], "writer_id long, seq long, kind string, fps_num long, fps_den long, height int, width int, dtype string, data binary")
    before = spark.conf.get(key)
    spark.conf.set(key, "2")
    try:
        done = y4m.encode_sessions(log, chroma="mono")
        plan = done._jdf.queryExecution().executedPlan().toString()
        got = {(r["writer_id"], r["session"]): (r["n_frames"], bytes(r["data"])) for r in done.collect()}
    finally:
        spark.conf.set(key, before)
    assert got == {k: (len(v), y4m.encode(v, 2, 2, 25, 1, "mono")) for k, v in want.items()}
    assert "InPandas" not in plan and plan.count("Sort [") == 1


def test_a_writer_drains_discards_and_passes_errors_on(spark, tmp_path):
    from pyspark.sql.types import StructType

    log, seen = str(tmp_path / "log"), []
    (tmp_path / "log").mkdir()
    schema = StructType.fromDDL(LOG_SCHEMA)
    run = lambda write, name: live.write_batches(live.file_stream(spark, log, schema), write, str(tmp_path / name))
    query = run(lambda df, _: seen.extend(r["kind"] for r in df.orderBy("seq").collect()), "cp1")
    w = LogWriter(spark, log, 1, query)
    w.start_sequence("a", 25)
    w.append_data(np.zeros((2, 2), np.uint8))
    w.end_sequence()
    assert seen == ["start", "append", "end"]
    w.start_sequence("b", 25)
    with pytest.warns(RuntimeWarning, match="1 messages"):
        w.shutdown()
    assert not w.accepts_new_frames and not query.isActive and spark.read.parquet(log).count() == 3

    def broken(df, _):
        raise ValueError("disk gone")

    w = LogWriter(spark, log, 2, run(broken, "cp2"))
    w.start_sequence("c", 25)
    with pytest.raises(RuntimeError, match="writing c failed.*"):
        w.end_sequence()
    w.close()


def test_images_as_they_appear(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.png").write_bytes(PNG)
    (tmp_path / "in" / "b.txt").write_bytes(b"no")
    got = []
    live.write_batches(live.image_stream(spark, str(tmp_path / "in"), "*.png"), lambda df, _: got.extend(bytes(r["content"]) for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert got == [PNG]


def test_late_frames_are_dropped(spark, tmp_path):
    times = ["2024-01-01 00:00:01", "2024-01-01 00:10:00", "2024-01-01 00:00:02", "2024-01-01 00:30:00"]
    for k, t in enumerate(times):
        spark.createDataFrame([(1, t)], "video_id long, t string").selectExpr("video_id", "cast(t as timestamp) as t").coalesce(1).write.parquet(str(tmp_path / f"in{k}"))
    got: list = []
    folder = tmp_path / "in"
    folder.mkdir()
    for k in range(len(times)):
        next((tmp_path / f"in{k}").glob("*.parquet")).rename(folder / f"{k}.parquet")
        schema = spark.read.parquet(str(folder)).schema
        stream = live.late_frames(live.file_stream(spark, str(folder), schema, 1), "t", "1 minute", "1 minute")
        live.write_batches(stream, lambda df, _: got.extend((r["window"]["start"].minute, r["n_frames"]) for r in df.collect()), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert (0, 1) in got and (0, 2) not in got
