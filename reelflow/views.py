"""The driver's tables read as packets, streams, planes and logs; ticks are microseconds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from reelflow.operators.gop import decode_key

#: Slots per second of the resampling queries: one in ten hours.
SLOW_FPS = (1, 36_000)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(ts: str) -> str:
    """Microseconds of a timestamp without time zone, whatever the session's zone."""
    return f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', {ts})"


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as the packets of a video: (video_id, pos, pts, dts, kind, event_id, value), pos in decode order.

    Every 17th event has no pts but a dts; each video's first packet is one tick early.
    """
    own = Window.partitionBy("video_id")
    order = own.orderBy("us", "event_id")
    rows = table(spark, sf_dir, "events").select(F.col("user_id").alias("video_id"), "event_id", "event_type", "value", F.expr(micros("ts")).alias("us"))
    rows = rows.select("*", (F.col("us") - F.first("us", ignorenulls=True).over(order)).alias("t"), (F.row_number().over(order) - 1).alias("d"))
    rows = rows.withColumn("t", F.when(F.col("t") == 0, -1).otherwise(F.col("t")))
    rows = rows.withColumn("pos", (F.row_number().over(own.orderBy(decode_key(F.col("d")), "d")) - 1).cast("long"))
    late = F.when(F.col("event_id") % 17 != 0, F.col("t"))
    kind = F.when(F.col("event_type") == "click", "audio").otherwise("video")
    return rows.select("video_id", "pos", late.alias("pts"), F.col("t").alias("dts"), kind.alias("kind"), "event_id", "value")


#: The same in DuckDB, as the head of a query.
PACKETS_SQL = """
WITH ev AS (
  SELECT user_id AS video_id, event_id, event_type, value, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id) AS t0 FROM events),
disp AS (
  SELECT *, CASE WHEN t0 = 0 THEN -1 ELSE t0 END AS t FROM ev),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY t, event_id) - 1 AS d FROM disp),
packets AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY CASE WHEN d = 0 THEN 0 WHEN d % 3 = 0 THEN d - 2 ELSE d + 1 END, d) - 1 AS pos,
    CASE WHEN event_id % 17 <> 0 THEN t END AS pts, t AS dts, CASE WHEN event_type = 'click' THEN 'audio' ELSE 'video' END AS kind, event_id, value
  FROM ranked),
keyed AS (
  SELECT video_id, pos, coalesce(pts, dts) AS pts FROM packets WHERE coalesce(pts, dts) >= 0),
frames AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pts) - 1 AS frame_idx, pts FROM (SELECT DISTINCT video_id, pts FROM keyed))"""


def shipments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items of a supplier as packets; ship dates repeat, as times of packets may."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("video_id"), F.expr(micros("l_shipdate")).alias("us"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    order = Window.partitionBy("video_id").orderBy("us", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    pts = F.col("us") - F.first("us", ignorenulls=True).over(Window.partitionBy("video_id").orderBy("us"))
    return rows.select("video_id", (F.row_number().over(order) - 1).cast("long").alias("pos"), pts.alias("pts"), pts.alias("dts"))


SHIPMENTS_SQL = """
WITH packets AS (
  SELECT l_suppkey AS video_id, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) - 1 AS pos,
    epoch_us(l_shipdate) - min(epoch_us(l_shipdate)) OVER (PARTITION BY l_suppkey) AS pts FROM lineitem),
frames AS (
  SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY pts) - 1 AS frame_idx, pts FROM (SELECT DISTINCT video_id, pts FROM packets))"""


def streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as stream descriptions: sizes, rates (some missing), formats and codecs from their columns."""
    k = F.col("p_partkey")
    pick = lambda names, by: F.element_at(F.array(*[F.lit(x) for x in names]), (by % len(names) + 1).cast("int"))
    return table(spark, sf_dir, "part").select(
        k.alias("video_id"),
        (16 + k % 4000 * 2 + k % 3).alias("width"),
        (16 + k % 1100 + k % 2).alias("height"),
        F.when(k % 5 != 0, (k % 60 + 1).cast("double")).alias("guessed_fps"),
        F.when(k % 7 != 0, (k % 50 + 1).cast("double")).alias("average_fps"),
        F.when(k % 3 != 0, k * 100_003).alias("container_us"),
        F.when(k % 4 != 0, k * 90).alias("stream_ticks"),
        (k % 13).alias("header_frames"),
        (k % 11 + 1).alias("n_packets"),
        pick(FORMATS, k).alias("format"),
        pick(CODECS, k).alias("codec"),
        pick(("420", "422", "444"), k).alias("chroma"),
        F.when(k % 2 == 0, 10).otherwise(8).alias("bit_depth"),
        F.when(k % 6 != 0, k * 45).alias("landed"),
        (k * 40).alias("target"),
        (k % 52).alias("crf"),
        (k % 5).alias("bframes"),
        pick(PRESETS, k).alias("preset"),
        (k % 2 == 0).alias("gpu"),
    )


FORMATS = ("mov,mp4", "image2", "png_pipe", "flv", "matroska,webm", "rm", "dirac", "mpegts")
CODECS = ("h264", "hevc", "vp9", "theora", "mjpeg")
PRESETS = ("ultrafast", "p1", "medium", "p7", "slow", "fancy", "veryslow", "p4", "faster")
_LIST = lambda names: "[" + ", ".join(f"'{x}'" for x in names) + "]"

STREAMS_SQL = f"""
WITH streams AS (
  SELECT p_partkey AS video_id, 16 + k % 4000 * 2 + k % 3 AS width, 16 + k % 1100 + k % 2 AS height,
    CASE WHEN k % 5 <> 0 THEN (k % 60 + 1)::DOUBLE END AS guessed_fps, CASE WHEN k % 7 <> 0 THEN (k % 50 + 1)::DOUBLE END AS average_fps,
    CASE WHEN k % 3 <> 0 THEN k * 100003 END AS container_us, CASE WHEN k % 4 <> 0 THEN k * 90 END AS stream_ticks,
    k % 13 AS header_frames, k % 11 + 1 AS n_packets,
    {_LIST(FORMATS)}[k % {len(FORMATS)} + 1] AS format, {_LIST(CODECS)}[k % {len(CODECS)} + 1] AS codec, ['420', '422', '444'][k % 3 + 1] AS chroma,
    CASE WHEN k % 2 = 0 THEN 10 ELSE 8 END AS bit_depth, CASE WHEN k % 6 <> 0 THEN k * 45 END AS landed, k * 40 AS target,
    k % 52 AS crf, k % 5 AS bframes, {_LIST(PRESETS)}[k % {len(PRESETS)} + 1] AS preset, k % 2 = 0 AS gpu
  FROM (SELECT *, p_partkey AS k FROM part))"""


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as 8 x 8 planes of 16-bit values: (vec_id, plane)."""
    scale = lambda v: F.floor((v.cast("double") + 1) * 32767).cast("int")
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", scale).alias("plane"))


PLANES_SQL = """
WITH planes AS (SELECT vec_id, list_transform(embedding, lambda v: floor((v::DOUBLE + 1) * 32767)::INTEGER) AS plane FROM embeddings)"""


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planes as videos of eight frames, 40 ms apart: (video_id, frame_idx, pts, height, width, plane)."""
    video = F.floor(F.col("vec_id") / 8)
    rows = planes(spark, sf_dir).select(video.alias("video_id"), "vec_id", "plane")
    rows = rows.withColumn("frame_idx", (F.row_number().over(Window.partitionBy("video_id").orderBy("vec_id")) - 1).cast("long"))
    return rows.select("video_id", "frame_idx", (F.col("frame_idx") * 40_000).alias("pts"), F.lit(8).alias("height"), F.lit(8).alias("width"), "plane")


CLIPS_SQL = PLANES_SQL + """,
clips AS (SELECT vec_id // 8 AS video_id, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS frame_idx, plane FROM planes)"""


def writer_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as writer logs: (writer_id, seq, kind); six conversations share a writer, their last turns end a session or not."""
    rows = table(spark, sf_dir, "conversations").select(F.floor(F.col("conv_id") / 6).alias("writer_id"), "conv_id", "turn")
    last = F.col("turn") == F.max("turn").over(Window.partitionBy("conv_id"))
    kind = F.when(F.col("turn") == 0, "start").when(last & (F.col("conv_id") % 3 != 0), "end").otherwise("append")
    rows = rows.withColumn("kind", F.when((F.col("turn") == 0) & (F.col("conv_id") % 5 == 4), "append").otherwise(kind))
    return rows.select("writer_id", (F.row_number().over(Window.partitionBy("writer_id").orderBy("conv_id", "turn")) - 1).cast("long").alias("seq"), "kind")


LOG_SQL = """
WITH c AS (SELECT conv_id // 6 AS writer_id, conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations),
log AS (
  SELECT writer_id, row_number() OVER (PARTITION BY writer_id ORDER BY conv_id, turn) - 1 AS seq,
    CASE WHEN turn = 0 AND conv_id % 5 = 4 THEN 'append' WHEN turn = 0 THEN 'start' WHEN turn = last AND conv_id % 3 <> 0 THEN 'end' ELSE 'append' END AS kind FROM c),
opened AS (
  SELECT *, (sum(CASE WHEN kind = 'start' THEN 1 ELSE 0 END) OVER (PARTITION BY writer_id ORDER BY seq))::BIGINT AS session FROM log),
marked AS (
  SELECT *, coalesce(max(CASE WHEN kind IN ('end', 'quit') THEN 1 ELSE 0 END) OVER (PARTITION BY writer_id, session ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM opened),
sessions AS (SELECT writer_id, seq, kind, session, session > 0 AND closed = 0 AS valid FROM marked)"""
