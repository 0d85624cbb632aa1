"""The same operators on streams: index and writer sessions with state per key, admission by files, and sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

from reelflow.operators.index import stamp


def file_stream(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 32) -> DataFrame:
    """A stream over Parquet files as they appear; ``files_per_trigger`` bounds what a batch admits."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def image_stream(spark: SparkSession, folder: str, pattern: str = "*.jpg", files_per_trigger: int = 32) -> DataFrame:
    """(path, modificationTime, length, content) of image files as they appear in a folder."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    return reader.option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_trigger).load(folder)


def running_max(packets: DataFrame) -> DataFrame:
    """(video_id, pos, pts, run_max) of a stream of (video_id, pos, pts, dts); state: one number per video.

    As in batches, a packet without pts stands at its dts; without both it is left out. Packets of a video must
    come in file order between batches; within one they are sorted.
    """

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (top,) = state.get if state.exists else (-1,)
        rows = pd.concat(list(pdfs)).sort_values("pos")
        run = rows["pts"].cummax().clip(lower=top)
        state.update((int(run.iloc[-1]),))
        yield pd.DataFrame({"video_id": key[0], "pos": rows["pos"], "pts": rows["pts"], "run_max": run})

    rows = packets.select("video_id", "pos", stamp().alias("pts")).where("pts >= 0")
    return rows.groupBy("video_id").applyInPandasWithState(update, "video_id long, pos long, pts long, run_max long", "top long", "append", GroupStateTimeout.NoTimeout)


def writer_sessions(log: DataFrame) -> DataFrame:
    """(writer_id, session, n_frames, how) of a stream of (writer_id, seq, kind), once a session is over.

    ``how``: ended, quit, or replaced by the next start. State: session number, frames so far, open or not.
    Appends and ends without an open session make rows with how = error and no frames.
    """

    def update(key: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        session, frames, is_open = state.get if state.exists else (0, 0, False)
        out = []
        for kind in pd.concat(list(pdfs)).sort_values("seq")["kind"]:
            if kind == "start":
                if is_open:
                    out.append((session, frames, "replaced"))
                session, frames, is_open = session + 1, 0, True
            elif kind == "quit":
                if is_open:
                    out.append((session, frames, "quit"))
                is_open = False
            elif not is_open:
                out.append((session, 0, "error"))
            elif kind == "append":
                frames += 1
            elif kind == "end":
                out.append((session, frames, "ended"))
                is_open = False
        state.update((session, frames, is_open))
        yield pd.DataFrame([(key[0], *x) for x in out], columns=["writer_id", "session", "n_frames", "how"])

    return log.select("writer_id", "seq", "kind").groupBy("writer_id").applyInPandasWithState(update, "writer_id long, session long, n_frames long, how string", "session long, frames long, is_open boolean", "append", GroupStateTimeout.NoTimeout)


def late_frames(frames: DataFrame, time: str, delay: str, window: str) -> DataFrame:
    """(video_id, window, n_frames) per tumbling window of a stream; frames later than ``delay`` are dropped."""
    return frames.withWatermark(time, delay).groupBy("video_id", F.window(time, window)).agg(F.count("*").alias("n_frames"))


def write_batches(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start ``write`` on every batch. ``once``: all that is there, then stop. Errors surface as StreamingQueryException.

    ``query.processAllAvailable()`` is the barrier, ``query.stop()`` after it drains, without it discards.
    """
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
