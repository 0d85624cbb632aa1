"""Queries over the driver's tables, each with the same in DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from fractions import Fraction

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelflow import views
from reelflow.functions import bits, encoding, pixels, rational
from reelflow.operators import access, gop, index, metadata, mux, resample, sessions, trim
from reelflow.plans.frame_plan import FramePlan
from reelflow.plans.frames import Frames
from reelflow.sources import y4m
from reelflow.views import CLIPS_SQL, LOG_SQL, PACKETS_SQL, PLANES_SQL, SHIPMENTS_SQL, STREAMS_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
Query = Callable[[SparkSession, str], DataFrame]


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.display_index(views.packets(spark, sf_dir))


# --- metadata ------------------------------------------------------------------------------------


@query(STREAMS_SQL + """
SELECT video_id, coalesce(guessed_fps, average_fps, 30.0) AS fps, guessed_fps IS NULL AND average_fps IS NULL AS fps_is_default,
  coalesce(container_us / 1e6, stream_ticks * 1 / 90000, 0.0) AS duration, [width, height][1] AS width, [width, height][2] AS height FROM streams""")
def q01_stream_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.streams(spark, sf_dir)
    seconds = metadata.duration(F.col("container_us"), F.col("stream_ticks"), F.lit(1), F.lit(90000))
    size = metadata.extents(F.col("width"), F.col("height"))
    g, a = F.col("guessed_fps"), F.col("average_fps")
    return s.select("video_id", metadata.fps(g, a).alias("fps"), metadata.fps_is_default(g, a).alias("fps_is_default"), seconds.alias("duration"), size[0].alias("width"), size[1].alias("height"))


@query(STREAMS_SQL + """,
m AS (SELECT video_id, coalesce(guessed_fps, average_fps, 30.0) AS fps, coalesce(container_us / 1e6, stream_ticks * 1 / 90000, 0.0) AS duration, header_frames FROM streams)
SELECT video_id, round_even(duration * fps, 0)::BIGINT AS n_estimated, CASE WHEN header_frames > 0 THEN header_frames ELSE trunc(duration * fps)::BIGINT END AS n_header FROM m""")
def q02_num_frames_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.streams(spark, sf_dir)
    rate = metadata.fps(F.col("guessed_fps"), F.col("average_fps"))
    seconds = metadata.duration(F.col("container_us"), F.col("stream_ticks"), F.lit(1), F.lit(90000))
    return s.select("video_id", metadata.estimated_frames(seconds, rate).alias("n_estimated"), metadata.frames_from_header(F.col("header_frames"), seconds, rate).alias("n_header"))


@query(PACKETS_SQL + " SELECT video_id, count(DISTINCT pts) AS n_frames FROM keyed GROUP BY 1")
def q03_num_frames_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metadata.exact_frames(views.packets(spark, sf_dir))


@query(PACKETS_SQL + """ SELECT video_id, count(*) AS n_packets, count(*) FILTER (WHERE kind = 'video') AS n_frames FROM packets
WHERE coalesce(pts, dts) IS NOT NULL GROUP BY 1""")
def q04_num_frames_decoded(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.packets(spark, sf_dir)
    decoded = metadata.decoded_frames(p.where("kind = 'video'"))
    return metadata.count_packets(p).join(decoded, "video_id")


@query(STREAMS_SQL + """
SELECT video_id,
  CASE WHEN average_fps IS NULL OR contains(format, 'image') OR contains(format, '_pipe') OR format IN ('dirac', 'cavsvideo', 'rm') THEN false
    WHEN stream_ticks IS NULL OR stream_ticks <= 0 THEN true ELSE coalesce(landed <= target, false) END AS seekable,
  CASE WHEN header_frames > 0 AND n_packets > 0 THEN header_frames / n_packets <= 1.5 AND header_frames / n_packets >= 0.67 ELSE true END AS counts_agree,
  NOT list_contains(string_split(format, ','), 'flv') AND codec IN ('h264', 'hevc', 'mpeg1video', 'mpeg2video', 'mpeg4', 'av1', 'vp8', 'vp9', 'vc1', 'mjpeg') AS gpu_safe
FROM streams""")
def q38_seekability(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    return views.streams(spark, sf_dir).select(
        "video_id",
        metadata.seekable(c("format"), c("average_fps"), c("stream_ticks"), c("target"), c("landed")).alias("seekable"),
        metadata.counts_agree(c("header_frames"), c("n_packets")).alias("counts_agree"),
        metadata.gpu_safe(c("format"), c("codec")).alias("gpu_safe"),
    )


# --- index ---------------------------------------------------------------------------------------


@query(PACKETS_SQL + " SELECT * FROM frames")
def q05_frame_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frames(spark, sf_dir)


@query(SHIPMENTS_SQL + " SELECT * FROM frames")
def q05b_frame_index_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.display_index(views.shipments(spark, sf_dir))


@query(PACKETS_SQL + " SELECT video_id, pos, pts, max(pts) OVER (PARTITION BY video_id ORDER BY pos) AS run_max FROM keyed")
def q06_running_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.running_max(views.packets(spark, sf_dir))


_SOUGHT = """,
run AS (SELECT video_id, pos, pts, max(pts) OVER (PARTITION BY video_id ORDER BY pos) AS k FROM keyed),
latest AS (SELECT video_id, k, arg_max(pts, pos) AS seek FROM run GROUP BY 1, 2),
fallback AS (SELECT video_id, least(arg_min(pts, pos), 0) AS seek FROM keyed GROUP BY 1),
sought AS (
  SELECT f.video_id, f.frame_idx, f.pts, coalesce(l.seek, b.seek) AS safe_pts FROM frames f
  ASOF LEFT JOIN latest l ON f.video_id = l.video_id AND f.pts >= l.k JOIN fallback b ON f.video_id = b.video_id)"""


@query(PACKETS_SQL + _SOUGHT + " SELECT * FROM sought")
def q07_safe_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.safe_seek(views.packets(spark, sf_dir))


@query(PACKETS_SQL + _SOUGHT + """ SELECT s.video_id, s.frame_idx, s.safe_pts, s.pts - s.safe_pts AS skip, s.frame_idx - coalesce(f.frame_idx, 0) + 1 AS cost
FROM sought s LEFT JOIN frames f ON f.video_id = s.video_id AND f.pts = s.safe_pts""")
def q08_seek_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    sought = index.safe_seek(views.packets(spark, sf_dir))
    return index.seek_params(sought).join(index.decode_cost(sought), ["video_id", "frame_idx"])


@query(PACKETS_SQL + " SELECT *, 0::BIGINT AS safe_pts FROM frames")
def q08b_sequential_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.sequential_index(views.packets(spark, sf_dir))


@query(PACKETS_SQL + _SOUGHT + """ SELECT video_id, frame_idx, CASE WHEN video_id % 4 <> 0 THEN safe_pts ELSE 0 END AS start, CASE WHEN video_id % 4 <> 0 THEN 'seek' ELSE 'reopen' END AS status FROM sought""")
def q08c_seek_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = views.packets(spark, sf_dir)
    streams = p.select("video_id", (F.col("video_id") % 4 != 0).alias("seekable")).distinct()
    return index.seek_start(index.safe_seek(p), streams)


@query("""SELECT p_partkey AS video_id, i AS frame_idx, i * 1001 * 90000 // 30000 AS pts FROM part, generate_series(0, p_size - 1) AS g(i)""")
def q19_synthetic_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("video_id"), F.col("p_size").cast("long").alias("n_frames"), F.lit(30000).cast("long").alias("fps_num"), F.lit(1001).cast("long").alias("fps_den"))
    return index.synthetic_index(counts, 90_000)


def _hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times asked of every video: each 100 hours, beyond its end too."""
    videos = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    return videos.withColumn("t", F.explode(F.sequence(F.lit(0), F.lit(8)))).select("video_id", (F.col("t") * 360_000_000_000).cast("long").alias("t"))


@query(PACKETS_SQL + """, asks AS (SELECT DISTINCT video_id, i * 360000000000 AS t FROM frames, generate_series(0, 8) AS g(i))
SELECT a.video_id, a.t, coalesce(min(f.frame_idx) FILTER (WHERE f.pts >= a.t), max(f.frame_idx)) AS frame_idx FROM asks a JOIN frames f ON f.video_id = a.video_id GROUP BY 1, 2""")
def q21_frame_at_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    return index.frame_at_time(_frames(spark, sf_dir), _hours(spark, sf_dir))


@query(PACKETS_SQL + """, asks AS (SELECT DISTINCT video_id, i AS frame_idx, i * 360000000000 AS t FROM frames, generate_series(0, 8) AS g(i))
SELECT a.video_id, a.frame_idx, min(f.pts) AS pts FROM asks a JOIN frames f ON f.video_id = a.video_id AND f.pts >= a.t - 1 GROUP BY 1, 2""")
def q21b_match_pts(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = _hours(spark, sf_dir).select("video_id", F.expr("t div 360000000000").alias("frame_idx"), F.col("t").alias("target"))
    return index.match_pts(_frames(spark, sf_dir), asks, tolerance=1)


# --- views ---------------------------------------------------------------------------------------


@query(PACKETS_SQL + """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1)
SELECT video_id, frame_idx, pts, 'seven' AS ask FROM frames WHERE frame_idx = 7
UNION ALL SELECT f.video_id, frame_idx, pts, 'last but two' FROM frames f JOIN n USING (video_id) WHERE frame_idx = n - 3""")
def q09_frame_at_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return access.frames_where(_frames(spark, sf_dir), {"seven": 7, "last but two": -3}).select("video_id", "frame_idx", "pts", "ask")


@query(PACKETS_SQL + """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1)
SELECT video_id, frame_idx, pts, (frame_idx - 5) // 2 AS out_idx, 'step' AS ask FROM frames WHERE frame_idx BETWEEN 5 AND 39 AND (frame_idx - 5) % 2 = 0
UNION ALL SELECT video_id, frame_idx, pts, frame_idx - 40, 'beyond' FROM frames WHERE frame_idx >= 40
UNION ALL SELECT f.video_id, frame_idx, pts, frame_idx - greatest(n - 10, 0), 'last' FROM frames f JOIN n USING (video_id) WHERE frame_idx >= n - 10
UNION ALL SELECT f.video_id, frame_idx, pts, frame_idx, 'but last' FROM frames f JOIN n USING (video_id) WHERE frame_idx < n - 10""")
def q10_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    asks = {"step": slice(5, 40, 2), "beyond": slice(40, 1000), "last": slice(-10, None), "but last": slice(None, -10), "empty": slice(10, 10)}
    plans = {name: FramePlan().sliced(s) for name, s in asks.items()}
    return access.slice_all(_frames(spark, sf_dir), plans).select("video_id", "frame_idx", "pts", "out_idx", "ask")


@query(PACKETS_SQL + """ SELECT video_id, frame_idx, pts, (frame_idx - 15) // 2 AS out_idx FROM frames
WHERE frame_idx BETWEEN 15 AND 49 AND (frame_idx - 15) % 2 = 0""")
def q11_slice_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Frames(views.packets(spark, sf_dir))[10:90][5:40][::2]
    return view.to_df().select("video_id", "frame_idx", "pts", "out_idx")


@query(PACKETS_SQL + """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1), v AS (
SELECT video_id, n, unnest([{'name': 'all', 'a': 0, 's': 1}, {'name': 'later', 'a': 20, 's': 1}, {'name': 'sparse', 'a': 0, 's': 31}]) AS v FROM n)
SELECT video_id, v.name AS name, CASE WHEN v.s > 30 THEN 'seek' WHEN v.a > 0 THEN 'range' ELSE 'scan' END AS strategy, greatest(0, ceil((n - v.a) / v.s))::BIGINT AS n_frames FROM v""")
def q12_access_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _frames(spark, sf_dir)
    plans = {"all": FramePlan(), "later": FramePlan().sliced(slice(20, None)), "sparse": FramePlan().sliced(slice(None, None, 31))}
    n = f.groupBy("video_id").agg((F.max("frame_idx") + 1).alias("n"))
    rows = []
    for name, p in plans.items():
        first, count, step = p.bounds(F.col("n"))
        rows.append(F.struct(F.lit(name).alias("name"), access.strategy(first, F.lit(step)).alias("strategy"), count.alias("n_frames")))
    return n.select("video_id", F.explode(F.array(*rows)).alias("v")).select("video_id", "v.*")


@query(PACKETS_SQL + " SELECT video_id, frame_idx * 3 + rep AS out_idx, rep, frame_idx, pts FROM frames, generate_series(0, 2) AS g(rep)")
def q13_repeat_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = Frames(views.packets(spark, sf_dir)).repeat_each_frame(3).to_df()
    return rows.select("video_id", "out_idx", F.col("rep").cast("long").alias("rep"), "frame_idx", "pts")


@query(STREAMS_SQL + """ SELECT video_id, coalesce(guessed_fps, average_fps, 30.0) / 4 * 3 AS fps,
  64 AS height, 48 AS width FROM streams""")
def q14_effective_fps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = views.streams(spark, sf_dir).withColumn("fps_num", metadata.fps(F.col("guessed_fps"), F.col("average_fps")).cast("long")).withColumn("fps_den", F.lit(1))
    view = Frames(views.packets(spark, sf_dir), s)[::2][::2].repeat_each_frame(3).resized((64, 48))
    return view.rates().join(view.shapes(), "video_id")


@query(PACKETS_SQL + """, n AS (SELECT video_id, count(*) AS n FROM frames GROUP BY 1)
SELECT video_id, greatest(0, ceil((n - 5 - 3) / 4))::BIGINT * 2 AS n_frames FROM n WHERE n >= 8""")
def q14b_view_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Frames(views.packets(spark, sf_dir))[5:-3:4].repeat_each_frame(2).lengths().where("n_frames > 0")


# --- resampling ----------------------------------------------------------------------------------

_SLOTS = """,
scaled AS (SELECT video_id, frame_idx, pts::HUGEINT * 1 AS a, 36000::HUGEINT * 1000000 AS b FROM frames),
slots AS (SELECT video_id, frame_idx, (a // b + CASE WHEN 2 * (a % b) > b OR (2 * (a % b) = b AND (a // b) % 2 = 1) THEN 1 ELSE 0 END)::BIGINT AS x FROM scaled),
fold AS (
  SELECT video_id, -1::BIGINT AS i, 0::BIGINT AS n, 0::BIGINT AS pv, 0::BIGINT AS own, 0::BIGINT AS p1, 0::BIGINT AS p2 FROM (SELECT DISTINCT video_id FROM slots)
  UNION ALL
  SELECT f.video_id, s.frame_idx,
    f.n + CASE WHEN s.x - f.n >= 2 THEN s.x - f.n - 1 ELSE 0 END + CASE WHEN s.x - f.n <= -3 THEN 0 WHEN s.x - f.n <= 0 THEN 1 ELSE 2 END,
    CASE WHEN s.x - f.n >= 2 THEN s.x - f.n - 1 ELSE 0 END, CASE WHEN s.x - f.n <= -3 THEN 0 WHEN s.x - f.n <= 0 THEN 1 ELSE 2 END, f.pv, f.p1
  FROM fold f JOIN slots s ON s.video_id = f.video_id AND s.frame_idx = f.i + 1),
ends AS (SELECT video_id, max(i) AS last, arg_max(n, i) AS n, arg_max(list_sort([pv, p1, p2])[2], i) AS extra FROM fold GROUP BY 1)"""
_CFR = _SLOTS + """,
runs AS (
  SELECT video_id, i AS step, 0 AS part, i - 1 AS src, pv AS k FROM fold WHERE i > 0 UNION ALL
  SELECT video_id, i, 1, i, own FROM fold WHERE i >= 0 UNION ALL
  SELECT video_id, last, 2, last, extra FROM ends),
shown AS (SELECT video_id, step, part, src, unnest(range(k)) AS j FROM runs WHERE k > 0),
cfr AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY step, part, j) - 1 AS out_idx, src AS src_idx FROM shown)"""
_REC = lambda s: s.replace("WITH ", "WITH RECURSIVE ", 1)


def _slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    num, den = views.SLOW_FPS
    return resample.slot_numbers(_frames(spark, sf_dir).withColumn("fps_num", F.lit(num).cast("long")).withColumn("fps_den", F.lit(den).cast("long")))


@query(_REC(PACKETS_SQL + _SLOTS + " SELECT video_id, n + extra AS n_slots FROM ends"))
def q15_cfr_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.cfr_count(_slots(spark, sf_dir))


@query(_REC(PACKETS_SQL + _CFR + " SELECT * FROM cfr"))
def q16_cfr_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.cfr_map(_slots(spark, sf_dir))


@query(_REC(PACKETS_SQL + _CFR + " SELECT c.video_id, c.out_idx, c.src_idx, f.pts FROM cfr c JOIN frames f ON f.video_id = c.video_id AND f.frame_idx = c.src_idx"))
def q17_cfr_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.apply_map(resample.cfr_map(_slots(spark, sf_dir)), _frames(spark, sf_dir)).select("video_id", "out_idx", "src_idx", "pts")


@query(_REC(PACKETS_SQL + _CFR + """ SELECT c.video_id, (c.out_idx - 12) // 3 AS out_idx, c.out_idx AS frame_idx, c.src_idx, f.pts
FROM cfr c JOIN frames f ON f.video_id = c.video_id AND f.frame_idx = c.src_idx WHERE c.out_idx BETWEEN 12 AND 59 AND (c.out_idx - 12) % 3 = 0"""))
def q18_cfr_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = Frames(views.packets(spark, sf_dir)).at_constant_rate(Fraction(*views.SLOW_FPS))[12:60:3]
    return view.to_df().select("video_id", "out_idx", "frame_idx", "src_idx", "pts")


@query(_REC(PACKETS_SQL + _CFR + """, asks AS (SELECT video_id, unnest([0, 10, 100000]) AS out_idx FROM ends)
SELECT a.video_id, a.out_idx, coalesce(c.src_idx, e.src) AS src_idx FROM asks a LEFT JOIN cfr c ON c.video_id = a.video_id AND c.out_idx = a.out_idx
JOIN (SELECT video_id, arg_max(src_idx, out_idx) AS src FROM cfr GROUP BY 1) e ON e.video_id = a.video_id"""))
def q18b_slot_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    slots = resample.cfr_map(_slots(spark, sf_dir))
    asks = slots.select("video_id").distinct().withColumn("out_idx", F.explode(F.array(F.lit(0).cast("long"), F.lit(10).cast("long"), F.lit(100_000).cast("long"))))
    return resample.slot_lookup(slots, asks)


# --- trim, mux, GOP, sessions --------------------------------------------------------------------

_TIMES = ("90", "1:30", "01:02:03.5", "0:00", "100:00:00", "2:5", ".5")


@query("SELECT p_partkey AS id, t AS text, list_reduce(list_transform(list_prepend('0', string_split(t, ':')), lambda x: x::DOUBLE), lambda a, x: a * 60 + x) AS seconds FROM (SELECT p_partkey, [" + ", ".join(f"'{t}'" for t in _TIMES) + f"][p_partkey % {len(_TIMES)} + 1] AS t FROM part)")
def q20_parse_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.element_at(F.array(*[F.lit(t) for t in _TIMES]), (F.col("p_partkey") % len(_TIMES) + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.alias("text"), trim.parse_time(text).alias("seconds"))


def _spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of each video, which overlap."""
    videos = views.table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id")).distinct()
    rows = videos.withColumn("span", F.explode(F.array(F.lit(0), F.lit(1))))
    start = (F.col("video_id") % 20) * 36_000_000_000 + F.col("span") * 500_000_000_000
    return rows.select("video_id", "span", start.alias("start"), (start + F.when(F.col("video_id") % 4 == 0, 10**13).otherwise(1_000_000_000_000)).cast("long").alias("stop"))


_SPANS = """,
spans AS (SELECT video_id, span, start, start + CASE WHEN video_id % 4 = 0 THEN 10000000000000 ELSE 1000000000000 END AS stop
  FROM (SELECT user_id AS video_id, span, (user_id % 20) * 36000000000 + span * 500000000000 AS start FROM (SELECT DISTINCT user_id FROM events), (VALUES (0), (1)) AS t(span)))"""


@query(PACKETS_SQL + _SPANS + """,
bounds AS (SELECT s.video_id, s.span, coalesce(min(frame_idx) FILTER (WHERE pts >= start), max(frame_idx)) AS a, coalesce(min(frame_idx) FILTER (WHERE pts >= stop), max(frame_idx)) AS b
  FROM spans s JOIN frames f ON f.video_id = s.video_id GROUP BY 1, 2)
SELECT f.video_id, span, f.frame_idx, f.pts, f.frame_idx - a AS out_idx, f.pts - min(f.pts) OVER (PARTITION BY f.video_id, span) AS out_pts FROM frames f JOIN bounds ON bounds.video_id = f.video_id WHERE frame_idx >= a AND frame_idx < b""")
def q22_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trim_video(_frames(spark, sf_dir), _spans(spark, sf_dir))


@query(PACKETS_SQL + _SPANS + """,
a AS (SELECT p.video_id, span, pos, coalesce(pts, dts) AS pts, start, stop FROM packets p JOIN spans s ON s.video_id = p.video_id WHERE kind = 'audio' AND dts IS NOT NULL AND coalesce(pts, dts) >= start),
e AS (SELECT video_id, span, min(pos) AS end_pos FROM a WHERE pts >= stop GROUP BY 1, 2)
SELECT a.video_id, a.span, a.pos, a.pts, a.pts - a.start AS out_pts FROM a LEFT JOIN e ON e.video_id = a.video_id AND e.span = a.span WHERE end_pos IS NULL OR pos < end_pos""")
def q23_trim_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    audio = views.packets(spark, sf_dir).where("kind = 'audio'").withColumn("pts", index.stamp())
    return trim.trim_audio(audio, _spans(spark, sf_dir))


@query(PACKETS_SQL + """, due AS (SELECT video_id, kind, pos, dts AS time, max(dts) OVER (PARTITION BY video_id, kind ORDER BY pos) AS due FROM packets WHERE dts IS NOT NULL)
SELECT video_id, kind, pos, time, row_number() OVER (PARTITION BY video_id ORDER BY due, kind, pos) - 1 AS mux_pos FROM due""")
def q24_mux_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mux.mux(views.packets(spark, sf_dir), strict=False)


@query(PACKETS_SQL + """, few AS (SELECT * FROM packets WHERE kind = 'video' OR video_id % 3 <> 0)
SELECT DISTINCT video_id, video_id IN (SELECT video_id FROM few WHERE kind = 'audio') AS has_audio FROM few""")
def q25_has_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    few = views.packets(spark, sf_dir).where("kind = 'video' or video_id % 3 <> 0")
    return mux.with_audio(few).withColumn("has_audio", F.lit(True)).unionByName(mux.without_audio(few).withColumn("has_audio", F.lit(False)))


@query(PACKETS_SQL + " SELECT video_id, frame_idx // 12 AS gop_id, count(*) AS n_frames, count(*) FILTER (WHERE frame_idx % 12 = 0) AS n_keyframes, min(pts) AS pts FROM frames GROUP BY 1, 2")
def q26_gop_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = gop.gop_structure(_frames(spark, sf_dir), gop=12)
    return rows.groupBy("video_id", "gop_id").agg(F.count("*").alias("n_frames"), F.count(F.when(F.col("is_keyframe"), 1)).alias("n_keyframes"), F.min("pts").alias("pts"))


@query(PACKETS_SQL + """, o AS (SELECT video_id, frame_idx, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN frame_idx = 0 THEN 0 WHEN frame_idx % 3 = 0 THEN frame_idx - 2 ELSE frame_idx + 1 END, frame_idx) - 1 AS out_idx FROM frames)
SELECT video_id, frame_idx, out_idx, frame_idx AS pts, out_idx - 2 AS dts FROM o""")
def q27_reorder_pts_dts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gop.reorder(_frames(spark, sf_dir))


@query(LOG_SQL + """ SELECT writer_id, session, count(*) FILTER (WHERE kind = 'append' AND valid) AS n_frames, max(CASE WHEN kind = 'end' AND valid THEN 1 ELSE 0 END) = 1 AS ended,
count(*) FILTER (WHERE NOT valid) AS n_invalid FROM sessions WHERE session > 0 GROUP BY 1, 2""")
def q28_writer_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.summary(views.writer_log(spark, sf_dir))


@query(LOG_SQL + " SELECT writer_id, seq, kind || ' without start' AS error FROM sessions WHERE NOT valid")
def q28b_protocol_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.protocol_errors(views.writer_log(spark, sf_dir))


@query(LOG_SQL + " SELECT writer_id, seq, kind, session, valid, row_number() OVER (PARTITION BY writer_id, session ORDER BY seq) - 1 AS pts FROM sessions WHERE kind = 'append' AND valid")
def q28c_frame_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.frame_stamps(views.writer_log(spark, sf_dir))


@query("""WITH f AS (SELECT l_suppkey AS seq_id, CASE WHEN l_suppkey % 3 = 0 THEN 65 ELSE 64 END AS height, CASE WHEN l_suppkey % 4 = 0 THEN 60 + l_linenumber ELSE 80 END AS width, CASE WHEN l_suppkey % 5 = 0 AND l_linenumber > 3 THEN 'uint16' ELSE 'uint8' END AS dtype FROM lineitem),
g AS (SELECT seq_id, count(*) AS n_frames, min(height) h0, max(height) h1, min(width) w0, max(width) w1, min(dtype) d0, max(dtype) d1 FROM f GROUP BY 1),
e AS (SELECT seq_id, n_frames, CASE WHEN d0 <> d1 THEN 'mixed dtypes' WHEN h0 <> h1 OR w0 <> w1 THEN 'mixed shapes' WHEN h0 % 2 <> 0 OR w0 % 2 <> 0 THEN 'odd size' ELSE '' END AS error FROM g)
SELECT seq_id, n_frames, error = '' AS ok, error FROM e""")
def q29_writer_shape_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("l_suppkey"), F.col("l_linenumber")
    rows = views.table(spark, sf_dir, "lineitem").select(s.alias("seq_id"), F.when(s % 3 == 0, 65).otherwise(64).alias("height"), F.when(s % 4 == 0, 60 + n).otherwise(80).alias("width"), F.when((s % 5 == 0) & (n > 3), "uint16").otherwise("uint8").alias("dtype"))
    return sessions.shape_check(rows)


# --- options and arithmetic ----------------------------------------------------------------------

_case = lambda table, key: "CASE " + key + " " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in table.items()) + f" ELSE {key} END"
_PRESET = f"CASE WHEN gpu THEN {_case(encoding.TO_HARDWARE, 'preset')} ELSE {_case(encoding.TO_SOFTWARE, 'preset')} END"


@query(STREAMS_SQL + f""" SELECT video_id, {_PRESET} AS preset, CASE WHEN gpu THEN CASE WHEN codec = 'hevc' THEN 'hevc_nvenc' ELSE 'h264_nvenc' END WHEN codec = 'hevc' THEN 'libx265' ELSE 'libx264' END AS codec_name,
  CASE WHEN gpu THEN 'bf=' || bframes || ';cq=' || crf || ';g=250;preset=' || {_PRESET} || ';rc=vbr' ELSE 'bf=' || bframes || ';crf=' || crf || ';g=250;preset=' || {_PRESET} END AS options,
  gpu AND width <= 4096 AND height <= 4096 AS uses_gpu, CASE WHEN gpu THEN width < 150 OR height < 50 ELSE false END AS too_small FROM streams""")
def q30_encoder_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    name = encoding.codec_name(c("codec"), c("gpu"))
    chosen = encoding.options(c("gpu"), c("crf"), c("preset"), c("bframes"), F.lit(250))
    text = F.array_join(F.transform(F.array_sort(F.map_entries(chosen)), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return views.streams(spark, sf_dir).select("video_id", encoding.preset_for(c("preset"), c("gpu")).alias("preset"), name.alias("codec_name"), text.alias("options"), encoding.uses_gpu(c("gpu"), c("width"), c("height")).alias("uses_gpu"), encoding.too_small(name, c("width"), c("height")).alias("too_small"))


@query(STREAMS_SQL + """, p AS (SELECT *, (width + 15) // 16 * 16 AS pw, (height + 15) // 16 * 16 AS ph, CASE WHEN chroma = '444' THEN 1 ELSE 2 END AS ux, CASE WHEN chroma = '420' THEN 2 ELSE 1 END AS uy FROM streams),
c AS (SELECT *, (pw - width) % ux = 0 AND (ph - height) % uy = 0 AS ok, (pw + 255) // 256 * 256 AS pitch FROM p)
SELECT video_id, pw AS padded_width, ph AS padded_height, ok AS crop_ok, CASE WHEN ok THEN (pw - width) // ux END AS crop_right, CASE WHEN ok THEN (ph - height) // uy END AS crop_bottom,
  CASE chroma WHEN '420' THEN pitch * ph * 3 // 2 WHEN '422' THEN pitch * ph * 2 ELSE pitch * ph * 3 END AS buffer_bytes, crf AS qp_i, trunc(crf * 1.25 + 1.75)::BIGINT AS qp_b, bframes + 1 + 8 AS in_flight,
  width + width % 2 AS even_width FROM c""")
def q31_pad_crop_qp(spark: SparkSession, sf_dir: str) -> DataFrame:
    w, h, c = F.col("width"), F.col("height"), F.col("chroma")
    cut, qp = encoding.crop(w, h, c), encoding.quantisers(F.col("crf"))
    return views.streams(spark, sf_dir).select("video_id", encoding.padded(w).alias("padded_width"), encoding.padded(h).alias("padded_height"), cut["ok"].alias("crop_ok"), cut["right"].alias("crop_right"), cut["bottom"].alias("crop_bottom"), encoding.buffer_bytes(w, h, c).alias("buffer_bytes"), qp["i"].alias("qp_i"), qp["b"].alias("qp_b"), encoding.in_flight(F.col("bframes"), F.lit(8)).alias("in_flight"), trim.even(w).alias("even_width"))


_STATUS = "[" + ", ".join(f"'{x}'" for x in encoding.ENCODER_STATUS) + "]"


@query(f"""WITH s AS (SELECT p_partkey AS id, p_partkey % 28 AS code FROM part)
SELECT id, code, 'encode: ' || coalesce({_STATUS}[code + 1], 'UNKNOWN_ERROR_' || code) || CASE code {' '.join(f"WHEN {k} THEN '{v}'" for k, v in encoding.STATUS_HINTS.items())} ELSE '' END AS text FROM s""")
def q37_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("p_partkey") % 28
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code.alias("code"), encoding.status_text(code, F.lit("encode")).alias("text"))


_JPEG = "[" + ", ".join(f"'{x}'" for x in encoding.JPEG_STATUS) + "]"


@query(f"""WITH s AS (SELECT p_partkey AS id, p_partkey % 13 AS code FROM part)
SELECT id, code, coalesce({_JPEG}[code + 1], 'Unknown error ' || code) AS text FROM s""")
def q37c_jpeg_status_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.col("p_partkey") % 13
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), code.alias("code"), encoding.jpeg_status_text(code).alias("text"))


_PATHS = ("a.MP4", "b/c.h264", "d.mkv", "plain", "x.y.webm", "e.txt")


@query("SELECT p_partkey AS id, lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) AS suffix, CASE WHEN lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) IN ('264', '265', 'avc', 'h264', 'h265', 'hevc') THEN 'raw' WHEN lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) IN ('avi', 'mkv', 'mov', 'mp4', 'webm') THEN lower(regexp_extract(p, '\\.([A-Za-z0-9]+)$', 1)) ELSE 'unknown' END AS container FROM (SELECT p_partkey, [" + ", ".join(f"'{x}'" for x in _PATHS) + f"][p_partkey % {len(_PATHS)} + 1] AS p FROM part)")
def q37b_container(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*[F.lit(x) for x in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), encoding.suffix(path).alias("suffix"), encoding.container_of(path).alias("container"))


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 1000 AS v FROM part), b AS (SELECT id, v, bin(v + 1) AS c, bin(CASE WHEN v > 0 THEN 2 * v ELSE 1 - 2 * v END) AS s FROM v)
SELECT id, v, repeat('0', len(c) - 1) || c AS ue, repeat('0', len(s) - 1) || s AS se, v AS decoded FROM b""")
def q36_exp_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_partkey") % 1000
    code = bits.ue_encode(v)
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), v.alias("v"), code.alias("ue"), bits.se_encode(v).alias("se"), bits.ue_decode(F.concat(code, F.lit("0110"))).alias("decoded"))


# --- pixels --------------------------------------------------------------------------------------


@query(PLANES_SQL + """
SELECT vec_id, list_transform(plane, lambda v: v / 65535) AS unit, list_transform(plane, lambda v: trunc(least(greatest((v / 32768 - 0.25) * 65535, 0.0), 65535.0))::INTEGER) AS clipped, list_transform(plane, lambda v: (v % 256) * 257) AS wide FROM planes""")
def q32_convert_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("plane")
    return views.planes(spark, sf_dir).select("vec_id", pixels.to_float(p).alias("unit"), pixels.from_float(F.transform(p, lambda v: v / 32768 - 0.25)).alias("clipped"), pixels.widen(F.transform(p, lambda v: v % 256)).alias("wide"))


#: The colour matrices as the standards have them, written out for the SQL. Fixed values.
_TWIST_ROWS = {
    "bt601 limited16": ((1.164384, 0.0, 1.596027, -57067.9296), (1.164384, -0.391762, -0.812968, 34707.275776), (1.164384, 2.017232, 0.0, -70869.97504)),
    "bt601 full16": ((1.0, 0.0, 1.402, -45940.736), (1.0, -0.344136, -0.714136, 34677.456896), (1.0, 1.772, 0.0, -58064.896)),
    "bt601 full8": ((1.0, 0.0, 1.402, -179.456), (1.0, -0.344136, -0.714136, 135.458816), (1.0, 1.772, 0.0, -226.816)),
    "bt601 full8to16": ((257.0, 0.0, 360.314, -46120.192), (257.0, -88.442952, -183.532952, 34812.915712), (257.0, 455.404, 0.0, -58291.712)),
    "bt709 limited16": ((1.164384, 0.0, 1.792741, -63513.853952), (1.164384, -0.213249, -0.532909, 19680.78848), (1.164384, 2.112402, 0.0, -73988.5056)),
    "bt709 full16": ((1.0, 0.0, 1.5748, -51603.0464), (1.0, -0.1873, -0.4681, 21476.1472), (1.0, 1.8556, 0.0, -60804.3008)),
    "bt709 full8": ((1.0, 0.0, 1.5748, -201.5744), (1.0, -0.1873, -0.4681, 83.8912), (1.0, 1.8556, 0.0, -237.5168)),
    "bt709 full8to16": ((257.0, 0.0, 404.7236, -51804.6208), (257.0, -48.1361, -120.3017, 21560.0384), (257.0, 476.8892, 0.0, -61041.8176)),
}


def _twist_sql(twist: str) -> str:
    top = 255 if twist.endswith("full8") else 65535
    value = lambda m: f"plane[i] * {m[0]!r}::DOUBLE + plane[i + 21] * {m[1]!r}::DOUBLE + plane[i + 42] * {m[2]!r}::DOUBLE + {m[3]!r}::DOUBLE"
    rows = [f"list_transform(range(1, 22), lambda i: floor(least(greatest({value(m)}, 0.0), {top}.0) + 0.5)::INTEGER) AS {n}" for m, n in zip(_TWIST_ROWS[twist], "rgb", strict=True)]
    return f"SELECT vec_id, '{twist}' AS twist, {', '.join(rows)} FROM {'narrow' if 'full8' in twist else 'planes'}"


@query(PLANES_SQL + ", narrow AS (SELECT vec_id, list_transform(plane, lambda v: v // 257) AS plane FROM planes) " + " UNION ALL ".join(map(_twist_sql, _TWIST_ROWS)))
def q33_colour_twist(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each plane as 21 pixels of three values, under all eight matrices, in one scan."""
    both = F.struct(F.col("plane").alias("wide"), F.transform("plane", lambda v: F.floor(v / 257).cast("int")).alias("narrow"))
    rows = views.planes(spark, sf_dir).select("vec_id", both.alias("p"))

    def twisted(twist: str) -> Column:
        space, mode = twist.split()
        p = F.col("p")["narrow" if mode.startswith("full8") else "wide"]
        rgb = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda i: pixels.colour_twist(F.get(p, i), F.get(p, i + 21), F.get(p, i + 42), space, mode))
        return F.struct(F.lit(twist).alias("twist"), rgb.alias("rgb"))

    each = rows.select("vec_id", F.explode(F.array(*map(twisted, _TWIST_ROWS))).alias("t"))
    return each.select("vec_id", "t.twist", *[F.transform("t.rgb", _field(n)).alias(n) for n in "rgb"])


def _field(name: str):
    return lambda x: x[name]


@query(STREAMS_SQL + """ SELECT video_id, CASE WHEN video_id % 3 = 0 THEN 'bt601' WHEN video_id % 4 = 0 THEN 'bt709' WHEN height >= 720 THEN 'bt709' ELSE 'bt601' END AS space,
  CASE WHEN chroma = '444' THEN CASE WHEN bit_depth > 8 THEN 'YUV444_16Bit' ELSE 'YUV444' END WHEN bit_depth > 8 THEN 'P016' ELSE 'NV12' END AS source,
  CASE WHEN video_id % 2 = 1 AND video_id % 5 <> 0 THEN 'rgb' WHEN video_id % 5 <> 0 AND bit_depth > 8 THEN 'yuv_to_rgb16' WHEN bit_depth > 8 THEN 'yuv_to_rgb16' ELSE 'scale_8u_16u' END AS mode FROM streams""")
def q33b_colour_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("video_id")
    asked, tagged = F.when(v % 3 == 0, "bt601"), F.when(v % 4 == 0, "bt709")
    out = pixels.output_mode(F.when((v % 2 == 1) & (v % 5 != 0), "uint8").otherwise("uint16"), F.col("chroma"), F.col("bit_depth"))
    return views.streams(spark, sf_dir).select("video_id", pixels.colour_space(asked, tagged, F.col("height")).alias("space"), out["source"].alias("source"), out["mode"].alias("mode"))


@query(PLANES_SQL + """ SELECT vec_id,
  list_transform(range(0, 16), lambda i: (plane[(i // 4) * 16 + (i % 4) * 2 + 1] + plane[(i // 4) * 16 + (i % 4) * 2 + 2] + plane[(i // 4) * 16 + (i % 4) * 2 + 9] + plane[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4) AS quarter,
  list_transform(range(0, 32), lambda i: floor((plane[(i // 4) * 8 + (i % 4) * 2 + 1] + plane[(i // 4) * 8 + (i % 4) * 2 + 2]) / 2 + 0.5)::INTEGER) AS half FROM planes""")
def q34_area_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("plane")
    return views.planes(spark, sf_dir).select("vec_id", pixels.area_resize(p, 8, 8, 2, 2).alias("quarter"), pixels.chroma_subsample(p, 8, 8, "422").alias("half"))


@query(PLANES_SQL + """ SELECT vec_id, flatten(list_transform(range(1, 33), lambda i: [plane[i], plane[i + 32]])) AS uv, plane[1:32] AS u, plane[33:64] AS v FROM planes""")
def q35_uv_interleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, v = F.slice("plane", 1, 32), F.slice("plane", 33, 32)
    uv = pixels.interleave(u, v)
    back = pixels.deinterleave(F.col("uv"))
    return views.planes(spark, sf_dir).select("vec_id", uv.alias("uv")).select("vec_id", "uv", back["u"].alias("u"), back["v"].alias("v"))


_QUANTUM = "pow(2, greatest(floor(log2({x})) - 10, -24))"
_HALF = "CASE WHEN {x} = 0 THEN 0.0 ELSE round_even({x} / " + _QUANTUM + ", 0) * " + _QUANTUM + " END"


@query(PLANES_SQL + f""", clipped AS (SELECT vec_id, list_transform(plane, lambda v: least(v, 65504)::DOUBLE) AS p FROM planes),
halves AS (SELECT vec_id, list_transform(list_transform(p, lambda v: {_HALF.format(x="v")}), lambda v: v / 65504) AS p FROM clipped)
SELECT vec_id, list_transform(p, lambda v: ({_HALF.format(x="v")})::FLOAT) AS half FROM halves""")
def q39_to_float16(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.planes(spark, sf_dir).select("vec_id", pixels.to_half(F.col("plane")).alias("half"))


@query("""SELECT p_partkey AS id, nal_idx::INTEGER AS nal_idx, CASE nal_idx WHEN 0 THEN 4 WHEN 1 THEN strlen(p_name) + 12 ELSE strlen(p_name) + 18 END::INTEGER AS nal_offset,
  CASE nal_idx WHEN 0 THEN 7 WHEN 1 THEN 8 ELSE ord(p_type[1:1]) % 32 END::INTEGER AS nal_type, CASE nal_idx WHEN 0 THEN strlen(p_name) + 4 WHEN 1 THEN 3 ELSE strlen(p_type) END::INTEGER AS size
FROM part, (VALUES (0), (1), (2)) AS t(nal_idx)""")
def q40_nal_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams made of three units each, split again."""
    spark.udtf.register("reel_nal_units", bits.NalUnits)
    unit = F.concat(F.unhex(F.lit("000000016742C01E")), F.encode("p_name", "utf-8"), F.unhex(F.lit("00000001680102000001")), F.encode("p_type", "utf-8"))
    views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), unit.alias("stream")).createOrReplaceTempView("reel_streams")
    return spark.sql("select id, nal_idx, nal_offset, nal_type, size from reel_streams, lateral reel_nal_units(stream)")


@query("""WITH v AS (SELECT p_partkey AS id, p_partkey % 1000 - 500 AS v FROM part), b AS (SELECT id, v, bin(CASE WHEN v > 0 THEN 2 * v ELSE 1 - 2 * v END) AS s FROM v)
SELECT id, v, repeat('0', len(s) - 1) || s AS code, v AS decoded FROM b""")
def q36b_signed_exp_golomb(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("p_partkey") % 1000 - 500
    code = bits.se_encode(v)
    return views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), v.alias("v"), code.alias("code"), bits.se_decode(F.concat(code, F.lit("0110"))).alias("decoded"))


@query("""WITH p AS (SELECT p_partkey AS id, '00000' || p_partkey % 7 || 'FF00000' || p_partkey % 5 || 'FF00000' || p_partkey % 4 || 'FF' AS raw FROM part)
SELECT id, raw, regexp_replace(raw, '0000(0[0-3])FF', '000003\\1FF', 'g') AS safe, raw AS again FROM p""")
def q40b_emulation_prevention(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [F.concat(F.lit("00000"), (F.col("p_partkey") % k).cast("string"), F.lit("FF")) for k in (7, 5, 4)]
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.unhex(F.concat(*parts)).alias("raw"))
    rows = rows.withColumn("safe", bits.insert_prevention_udf("raw")).withColumn("again", bits.strip_prevention_udf("safe"))
    return rows.select("id", *[F.hex(c).alias(c) for c in ("raw", "safe", "again")])


def _axis_sql(name: str, size: int, to: int) -> str:
    at = f"greatest(0::DOUBLE, least((i + 0.5::DOUBLE) * {size} / {to} - 0.5::DOUBLE, {size - 1}::DOUBLE))"
    return f"{name} AS (SELECT i, floor(t)::INTEGER AS lo, least(floor(t)::INTEGER + 1, {size - 1}) AS hi, t - floor(t) AS w FROM (SELECT i, {at} AS t FROM range({to}) AS r(i)))"


@query(CLIPS_SQL + f", {_axis_sql('down', 8, 6)}, {_axis_sql('across', 8, 5)}" + """, dots AS (
  SELECT video_id, frame_idx, d.i AS y, a.i AS x, round_even((plane[d.lo * 8 + a.lo + 1] * (1 - a.w) + plane[d.lo * 8 + a.hi + 1] * a.w) * (1 - d.w)
    + (plane[d.hi * 8 + a.lo + 1] * (1 - a.w) + plane[d.hi * 8 + a.hi + 1] * a.w) * d.w, 0) AS v
  FROM clips, down AS d, across AS a WHERE frame_idx IN (1, 3, 5)),
small AS (SELECT video_id, frame_idx, list((v / 65535)::FLOAT ORDER BY y, x) AS plane FROM dots GROUP BY ALL)
SELECT video_id, frame_idx - 1 + rep AS out_idx, rep::INTEGER AS rep, frame_idx, 6 AS height, 5 AS width, plane FROM small, range(2) AS r(rep)""")
def q41_view_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slices, resizing, conversion to floats and repetition on pixels."""
    clips = views.clips(spark, sf_dir)
    packets = clips.select("video_id", F.col("frame_idx").alias("pos"), "pts", F.col("pts").alias("dts"))
    view = Frames(packets)[1:7:2].resized((6, 5)).as_type("float32").repeat_each_frame(2)
    return view.over(clips, 16).select("video_id", "out_idx", "rep", "frame_idx", "height", "width", "plane")


@query(CLIPS_SQL + """, own AS (SELECT video_id, frame_idx, list_transform(plane, lambda v: floor(v / 257 + 0.5)::INTEGER) AS plane, max(frame_idx) OVER (PARTITION BY video_id) + 1 AS n FROM clips),
slots AS (SELECT video_id, n, unnest(range(2 * n - 1)) AS out_idx FROM own WHERE frame_idx = 0)
SELECT s.video_id, s.out_idx, o.frame_idx AS src_idx, o.plane FROM slots AS s JOIN own AS o ON o.video_id = s.video_id AND o.frame_idx = (s.out_idx + 1) // 2 WHERE s.out_idx >= s.n""")
def q41b_resampled_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of 25 a second in slots of 50 a second, as 8 bits, from the middle on. Every frame but the first is one slot early and fills two."""
    clips = views.clips(spark, sf_dir)
    packets = clips.select("video_id", F.col("frame_idx").alias("pos"), "pts", F.col("pts").alias("dts"))
    out = Frames(packets).at_constant_rate(50).over(clips, 16)
    n = clips.groupBy("video_id").agg(F.count("*").alias("n"))
    return out.join(n, "video_id").where("out_idx >= n").select("video_id", "out_idx", "src_idx", "plane")


@query(PACKETS_SQL + """, n AS (SELECT video_id, count(*) // 3 * 2 AS n, video_id % 700 + 2 AS h, video_id % 900 + 16 AS w, (video_id % 50 + 1) / (video_id % 3 + 1)::DOUBLE AS fps FROM frames GROUP BY video_id)
SELECT video_id, format('Frames({}x{}, {:.4g} fps, {} frames)', w, h, fps / 3 * 2, n) AS text FROM n""")
def q42_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    packets, v = views.packets(spark, sf_dir), F.col("video_id")
    streams = packets.select("video_id").distinct().select("video_id", (v % 50 + 1).alias("fps_num"), (v % 3 + 1).alias("fps_den"), (v % 900 + 16).cast("int").alias("width"), (v % 700 + 2).cast("int").alias("height"))
    return Frames(packets, streams)[2::3].repeat_each_frame(2).descriptions()


def _rgb_sql(y: str, u: str, v: str, n: int, matrix: str) -> str:
    value = lambda m: f"{y} * {m[0]!r}::DOUBLE + {u} * {m[1]!r}::DOUBLE + {v} * {m[2]!r}::DOUBLE + {m[3]!r}::DOUBLE"
    return ", ".join(f"list_transform(range(0, {n}), lambda i: floor(least(greatest({value(m)}, 0.0), 65535.0) + 0.5)::INTEGER) AS {c}" for m, c in zip(_TWIST_ROWS[matrix], "rgb", strict=True))


_CHROMA = "plane[(i // 16) * 4 + (i % 8) // 2 + {at}]"


@query(PLANES_SQL + f""" SELECT vec_id, 'p016' AS kind, flatten(list_transform(range(33, 41), lambda i: [plane[i], plane[i + 8]])) AS uv, {_rgb_sql("plane[i + 1]", _CHROMA.format(at=33), _CHROMA.format(at=41), 32, "bt709 limited16")} FROM planes
UNION ALL SELECT vec_id, 'yuv444' AS kind, NULL AS uv, {_rgb_sql("plane[i + 1]", "plane[i + 17]", "plane[i + 33]", 16, "bt601 limited16")} FROM planes""")
def q43_planar_to_rgb16(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes as 420 frames of 8 x 4 by way of the semi-planar layouts, and as 444 frames of 4 x 4."""
    part = lambda at, n: F.slice("plane", at, n)
    semi = pixels.yuv420_to_nv12(part(1, 32), part(33, 8), part(41, 8))
    wide = pixels.nv12_to_p016(F.col("semi.y"), F.col("semi.uv"))
    rows = views.planes(spark, sf_dir).withColumn("semi", semi).withColumn("wide", wide)
    p016 = F.struct(F.lit("p016").alias("kind"), F.col("wide.uv").alias("uv"), pixels.p016_to_rgb16(F.col("wide.y"), F.col("wide.uv"), 8, 4).alias("rgb"))
    full = F.struct(F.lit("yuv444").alias("kind"), F.lit(None).cast("array<int>").alias("uv"), pixels.yuv444_to_rgb16(part(1, 16), part(17, 16), part(33, 16), "bt601").alias("rgb"))
    each = rows.select("vec_id", F.explode(F.array(p016, full)).alias("t"))
    return each.select("vec_id", "t.kind", "t.uv", *[F.transform("t.rgb", _field(n)).alias(n) for n in "rgb"])


@query(PLANES_SQL + """, c AS (SELECT vec_id, list_transform(plane, lambda v: v % 256) AS p FROM planes),
k AS (SELECT vec_id, list_transform(range(1, 17), lambda i: p[i] * 0.257::DOUBLE + p[i + 16] * 0.504::DOUBLE + p[i + 32] * 0.098::DOUBLE + 16::DOUBLE) AS y,
  list_transform(range(1, 17), lambda i: p[i] * -0.148::DOUBLE + p[i + 16] * -0.291::DOUBLE + p[i + 32] * 0.439::DOUBLE + 128::DOUBLE) AS u,
  list_transform(range(1, 17), lambda i: p[i] * 0.439::DOUBLE + p[i + 16] * -0.368::DOUBLE + p[i + 32] * -0.071::DOUBLE + 128::DOUBLE) AS v FROM c)
SELECT vec_id, list_transform(y, lambda v: floor(v + 0.5)::INTEGER) AS y, flatten(list_transform([1, 3, 9, 11], lambda i: [floor((u[i] + u[i + 1] + u[i + 4] + u[i + 5]) / 4 + 0.5)::INTEGER, floor((v[i] + v[i + 1] + v[i + 4] + v[i + 5]) / 4 + 0.5)::INTEGER])) AS uv,
  list_transform(range(0, 16), lambda i: floor((p[(i // 4) * 16 + (i % 4) * 2 + 1] + p[(i // 4) * 16 + (i % 4) * 2 + 2] + p[(i // 4) * 16 + (i % 4) * 2 + 9] + p[(i // 4) * 16 + (i % 4) * 2 + 10]) / 4 + 0.5)::INTEGER) AS quarter
FROM k JOIN c USING (vec_id)""")
def q44_rgb_to_nv12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three colour planes of 4 x 4 as a semi-planar frame, and a chroma plane of 8 x 8 as one of 420."""
    p = F.transform("plane", lambda v: v % 256)
    rows = views.planes(spark, sf_dir).select("vec_id", p.alias("p"))
    out = pixels.rgb_to_nv12(F.slice("p", 1, 16), F.slice("p", 17, 16), F.slice("p", 33, 16), 4, 4)
    return rows.select("vec_id", out.alias("o"), pixels.chroma_subsample(F.col("p"), 8, 8, "420").alias("quarter")).select("vec_id", "o.y", "o.uv", "quarter")


@query(LOG_SQL + """, kept AS (SELECT *, sha256(writer_id || ':' || seq) AS frame FROM sessions WHERE kind = 'append' AND valid),
files AS (SELECT writer_id, session, count(*) AS n_frames, string_agg('FRAME' || chr(10) || frame, '' ORDER BY seq) AS body FROM kept GROUP BY ALL)
SELECT writer_id, session, n_frames, CASE WHEN writer_id % 4 = 3 THEN 'start without fps' ELSE '' END AS error,
  CASE WHEN writer_id % 4 <> 3 THEN md5('YUV4MPEG2 W8 H8 F25:' || writer_id % 4 + 1 || ' Ip A1:1 Cmono' || chr(10) || body) END AS file_md5 FROM files""")
def q45_session_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sessions of the logs as files, each frame the 64 characters of a hash."""
    w, start = F.col("writer_id"), F.col("kind") == "start"
    frame = F.encode(F.sha2(F.concat_ws(":", "writer_id", "seq"), 256), "utf-8")
    rate = F.when(start & (w % 4 != 3), F.lit(25))
    log = views.writer_log(spark, sf_dir).select("writer_id", "seq", "kind", rate.alias("fps_num"), F.when(start, w % 4 + 1).alias("fps_den"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.lit("uint8").alias("dtype"), frame.alias("data"))
    return y4m.encode_sessions(log, chroma="mono").select("writer_id", "session", "n_frames", "error", F.md5("data").alias("file_md5"))


@query("""SELECT p_partkey AS id, p_partkey * 100003 AS ticks, p_partkey * 100003 * 30000 // (90000 * 1001) AS frames, p_partkey * 100003 * 1000 // 90000 AS ms,
  CASE p_partkey % 5 WHEN 0 THEN 2997 WHEN 1 THEN 2997 WHEN 2 THEN 30000 WHEN 3 THEN 2359 ELSE 1 END AS num, CASE p_partkey % 5 WHEN 0 THEN 100 WHEN 1 THEN 125 WHEN 2 THEN 1001 WHEN 3 THEN 81 ELSE 2 END AS den FROM part""")
def q46_rational_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ticks of 1/90000 s in frames of 30000/1001 a second and in milliseconds, and rates as fractions."""
    rate = F.element_at(F.array(*[F.lit(x) for x in (29.97, 23.976, 30000 / 1001, 29.123456789, 0.5)]), (F.col("p_partkey") % 5 + 1).cast("int"))
    rows = views.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") * 100_003).alias("ticks"), rational.fraction_udf()(rate).alias("q"))
    frames, ms = rational.rescale("ticks", "1", "90000", "1001", "30000"), rational.rescale("ticks", "1", "90000", "1", "1000")
    return rows.select("id", "ticks", frames.cast("long").alias("frames"), ms.cast("long").alias("ms"), "q.num", "q.den")
