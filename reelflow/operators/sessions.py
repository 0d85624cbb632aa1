"""Writer sessions from logs of messages, and checks of what is written in them.

A log: (writer_id, seq, kind, ...), kind being start, append, end or quit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

def sessions(log: DataFrame) -> DataFrame:
    """``log`` with session (from 1; 0 before any start) and valid: appends and ends need an open session.

    A start closes a session that is open; an end or quit closes its own. One sort by writer and seq is all it takes.
    """
    order = Window.partitionBy("writer_id").orderBy("seq")
    before, upto = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    at = lambda *kinds: F.when(F.col("kind").isin(*kinds), F.col("seq"))
    session = F.sum((F.col("kind") == "start").cast("int")).over(upto).cast("long")
    rows = log.select("*", session.alias("session"), (F.max(at("end", "quit")).over(before) > F.max(at("start")).over(upto)).alias("__closed"))
    return rows.withColumn("valid", (F.col("kind") == "quit") | ((F.col("session") > 0) & ~F.coalesce("__closed", F.lit(False)))).drop("__closed")


def summary(log: DataFrame) -> DataFrame:
    """(writer_id, session, n_frames, ended, n_invalid) per session."""
    rows = sessions(log).where("session > 0")
    return rows.groupBy("writer_id", "session").agg(F.count(F.when((F.col("kind") == "append") & F.col("valid"), 1)).alias("n_frames"), F.max((F.col("kind").isin("end", "quit")) & F.col("valid")).alias("ended"), F.count(F.when(~F.col("valid"), 1)).alias("n_invalid"))


def protocol_errors(log: DataFrame) -> DataFrame:
    """(writer_id, seq, error): appends and ends outside a session, and starts without a rate (column fps, if any)."""
    rows = sessions(log)
    error = F.when(~F.col("valid"), F.concat(F.col("kind"), F.lit(" without start")))
    if "fps" in log.columns:
        error = error.when((F.col("kind") == "start") & F.col("fps").isNull(), F.lit("start without fps"))
    return rows.withColumn("error", error).where("error is not null").select("writer_id", "seq", "error")


def frame_stamps(log: DataFrame) -> DataFrame:
    """Valid appends with pts = 0, 1, 2, ... within their session."""
    order = Window.partitionBy("writer_id", "session").orderBy("seq")
    return sessions(log).where("kind = 'append' and valid").withColumn("pts", (F.row_number().over(order) - 1).cast("long"))


def shape_check(frames: DataFrame) -> DataFrame:
    """(seq_id, n_frames, ok, error) of (seq_id, height, width, dtype): one type and size, and even sizes."""
    each = frames.groupBy("seq_id").agg(
        F.count("*").alias("n_frames"),
        F.min("height").alias("h0"), F.max("height").alias("h1"), F.min("width").alias("w0"), F.max("width").alias("w1"),
        F.min("dtype").alias("d0"), F.max("dtype").alias("d1"),
    )
    error = F.when(F.col("d0") != F.col("d1"), "mixed dtypes").when((F.col("h0") != F.col("h1")) | (F.col("w0") != F.col("w1")), "mixed shapes").when((F.col("h0") % 2 != 0) | (F.col("w0") % 2 != 0), "odd size")
    return each.select("seq_id", "n_frames", error.isNull().alias("ok"), F.coalesce(error, F.lit("")).alias("error"))
